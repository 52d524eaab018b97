"""Calls to external text providers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from feedlake.functions.text import rewrite_or_fallback
from feedlake.session import ship

ship(__name__)

# A provider is made once per task by its factory and then called per text.
ProviderFactory = Callable[[], Callable[[str], str]]

RESULT_FIELDS = [
    T.StructField("text", T.StringType()),
    T.StructField("provider_used", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
]


def call_with_retry(fn, text: str, retries: int, delay: float, backoff: float, sleep=time.sleep) -> tuple[str, int]:
    """Result and number of attempts; the last error carries its attempts."""
    for attempt in range(1, retries + 1):
        try:
            return fn(text), attempt
        except Exception as error:
            if attempt == retries:
                error.attempts = attempt
                raise
            sleep(delay * backoff ** (attempt - 1))
    raise ValueError("retries must be at least 1")


def enrich_with_providers(
    df: DataFrame,
    text_col: str,
    providers: Mapping[str, ProviderFactory],
    retries: int = 3,
    delay: float = 1.0,
    backoff: float = 2.0,
    keep_input: bool = True,
) -> DataFrame:
    """Adds ``text``, ``provider_used``, ``attempts``, ``errors``.

    Providers are tried in order and the first that answers wins. When all fail the input
    comes back unchanged (or null, without ``keep_input``) and ``provider_used`` is null.
    """
    if retries < 1:
        raise ValueError("retries must be at least 1")
    factories = dict(providers)
    schema = T.StructType(df.schema.fields + RESULT_FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str, Callable[[str], str]] = {}
        for batch in batches:
            yield batch.assign(**_answers(batch[text_col], clients))

    def _answers(texts: pd.Series, clients: dict) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in RESULT_FIELDS}
        for text in texts:
            answer, used, attempts, errors = (text if keep_input else None), None, 0, []
            for name, factory in factories.items():
                try:
                    if name not in clients:
                        clients[name] = factory()
                    answer, tries = call_with_retry(clients[name], text, retries, delay, backoff)
                except Exception as error:
                    attempts += getattr(error, "attempts", 0)
                    errors.append(f"{name}: {error}")
                    continue
                attempts += tries
                used = name
                break
            for field, value in zip(out, (answer, used, attempts, errors)):
                out[field].append(value)
        return out

    return df.mapInPandas(run, schema)


def rewrite_with_fallback(
    df: DataFrame,
    prompt_col: str,
    content_col: str,
    providers: Mapping[str, ProviderFactory],
    out: str = "rewritten_content",
    **retry,
) -> DataFrame:
    """Rewritten text, or the marked original where every provider failed."""
    answered = enrich_with_providers(df, prompt_col, providers, keep_input=False, **retry)
    kept = [c for c in df.columns if c != out]
    return answered.select(
        *kept,
        rewrite_or_fallback("text", content_col).alias(out),
        F.col("provider_used").isNull().alias("used_fallback"),
    )
