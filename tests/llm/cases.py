"""Rows that every operator must take, and the tables they stand in."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

WORDS = "the quick brown fox jumps over a lazy dog near the old river bank while seven sleepy cats watch from warm stones".split()
PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"{WORDS[i % len(WORDS)]}{i % 977}" for i in range(30_000))

ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\v\f\r ", "de", "b"), (4, "one", "en", None), (5, LONG, "en", "b"),
    (6, f"start {PASSAGE} end", "en", "b"), (7, f"other {PASSAGE} tail", "fr", "b"), (7, f"other {PASSAGE} tail", "fr", "b"),
    (8, "Ünï   çodé 😀 text glued", "fr", ""), (None, " ".join(WORDS), None, None), (None, None, None, None),
    (9, " ".join(WORDS), "de", "é"), (10, " ".join(WORDS).upper(), "de", "z"), (11, "... !!! ???", "en", "z"),
]
#: Columns that documents do not have, named like ones that operators add or use inside.
CLASHES = ("size", "target", "slice", "kept", "score", "node", "part", "label", "key", "text_key", "n_rows", "mix_rate", "hit_id")


def odd_documents(spark, clashes=True):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").repartition(3)
    if clashes:
        for i, name in enumerate(CLASHES):
            docs = docs.selectExpr("*", f"{i} AS `{name}`")
    return docs


def no_documents(spark):
    return odd_documents(spark).where("doc_id < 0")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
