"""Article ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedlake.functions.text import _col, normalize_title, text_or_empty


def article_id(url: Column | str, title: Column | str | None = None, null_url_policy: str = "reference") -> Column:
    """First 16 hex digits of the SHA-256 of the URL.

    Under the ``reference`` policy every empty URL has the same id, so all such items are
    duplicates of each other. ``title_hash`` derives their id from the title instead.
    """
    url = text_or_empty(url)
    if null_url_policy == "title_hash":
        if title is None:
            raise ValueError("title_hash needs a title")
        url = F.when(url == "", F.concat(F.lit("title:"), normalize_title(_col(title)))).otherwise(url)
    elif null_url_policy != "reference":
        raise ValueError(f"unknown null_url_policy: {null_url_policy}")
    return F.substring(F.sha2(url, 256), 1, 16)
