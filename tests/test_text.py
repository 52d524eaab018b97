"""Text functions against their rules restated in plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from feedlake.functions import text as X
from feedlake.functions.ids import article_id
from feedlake.functions.responses import extract_completion
from feedlake.functions.rounding import round_exact

SAMPLES = [
    "", " a   b ", " x y　", "<p>One\r\n\r\n two</p> three\x1cfour\x85 five",
    "a<b", "<<a>b>", "<>x", "a > b < c > d", "\n\n\t \n", "Persian متن‌فارسی", "\U0001f600 <i>ok</i>",
    "x" * 50 + " " * 500 + "y", "tail <unclosed", "\x1f\x1e\x1d mixed \x0b\x0c end",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i INT, s STRING")


def values(frame, column):
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_whitespace(frame):
    assert values(frame, X.normalize_whitespace("s")) == [" ".join(s.split()) for s in SAMPLES]
    assert values(frame, X.strip("s")) == [s.strip() for s in SAMPLES]


def test_markup(frame):
    bare = [re.sub("<[^>]+>", "", s) for s in SAMPLES]
    assert values(frame, X.strip_markup("s")) == bare
    assert values(frame, X.sanitize_title("s")) == [" ".join(s.split()) for s in bare]
    expected = ["\n".join(x for x in (" ".join(line.split()) for line in s.splitlines()) if x) for s in bare]
    assert values(frame, X.sanitize_content("s")) == expected


def test_tokens(frame):
    assert values(frame, X.tokens("s")) == [[w for w in re.split(r"\W+", s.lower()) if w] for s in SAMPLES]


def test_null_title_is_empty(spark):
    row = spark.range(1).select(X.normalize_title(F.lit(None).cast("string")).alias("t")).first()
    assert row.t == ""


def test_ids(spark):
    one = spark.range(1)
    assert one.select(article_id(F.lit(""))).first()[0] == "e3b0c44298fc1c14"
    assert one.select(article_id(F.lit("http://identical.url"))).first()[0] == "de70a7094d1697cd"
    a, b = one.select(
        article_id(F.lit(""), F.lit("A"), "title_hash"), article_id(F.lit(""), F.lit("B"), "title_hash")
    ).first()
    assert a != b
    with pytest.raises(ValueError):
        article_id(F.lit(""), null_url_policy="other")


def test_templates(spark):
    row = spark.createDataFrame([("T", "C" * 70, None)], "t STRING, c STRING, n STRING").select(
        X.prompt("t", "c"), X.prompt("t", "n"), X.render_template("[P]: {c} {t}{c}", {"c": "c", "t": "t"}),
        X.prompt_template({"a": "<{t}>"}, "a", {"t": "t"}), X.prompt_template({}, "b", {}),
        X.rewrite_or_fallback("n", "t"), X.rewrite_or_fallback("t", "c"),
    ).first()
    assert list(row) == [
        "Title: T\nContent: " + "C" * 70, "Title: T\nContent: ", "[P]: " + "C" * 70 + " T" + "C" * 70, "<T>", "", "[Rewritten Failed - Fallback]: T", "T",
    ]


def test_tags(spark):
    df = spark.createDataFrame(
        [("x", "He said so", "r"), ("x", "other", "r"), ("Python Release", "said", None), ("Software", "x", "")],
        "t STRING, c STRING, r STRING",
    )
    tags = X.tag_keywords("t", "c")
    got = [(r[0], r[1]) for r in df.select(tags, X.append_tags("r", tags)).collect()]
    assert got == [(["ai"], "r\n\nTags: #ai"), ([], "r"), (["ai", "tech", "news"], None), (["tech"], "")]


BODIES = [
    ("chat", '{"choices":[{"message":{"content":"hello"}}]}', "", ("hello", True)),
    ("chat", '{"choices":[{"message":{"content":""}}]}', "", ("", True)),
    ("chat", '{"choices":[]}', "", (None, False)),
    ("chat", '{"choices":[{"message":{}}]}', "", (None, False)),
    ("chat", "not json", "", (None, False)),
    ("generation", '[{"generated_text":"Prompt  text "}]', "Prompt", ("text", True)),
    ("generation", '[{"generated_text":" other "}]', "Prompt", (" other ", True)),
    ("generation", '{"generated_text":"Prompt x"}', "Prompt", ("x", True)),
    ("generation", '{"error":"busy"}', "Prompt", (None, False)),
    ("generation", "[{}]", "Prompt", (None, False)),
    ("generation", "{}", "Prompt", (None, False)),
    ("canonical", '{"success":true,"text":"  t \\n"}', "", ("t", True)),
    ("canonical", '{"success":true,"text":"  "}', "", (None, False)),
    ("canonical", '{"success":false,"error":"down","text":"t"}', "", (None, False)),
]


@pytest.mark.parametrize("kind, body, prompt, expected", BODIES)
def test_completions(spark, kind, body, prompt, expected):
    df = spark.createDataFrame([(body, prompt)], "b STRING, p STRING")
    r = df.select(extract_completion("b", kind, "p").alias("r")).first().r
    assert (r.text, r.error is None) == expected
    if '"error"' in body:
        assert r.error in ("busy", "down")


def test_rounding_equals_python(spark):
    pairs = [(p, q) for q in range(1, 201) for p in range(0, q + 1)]
    df = spark.createDataFrame(pairs, "p INT, q INT").withColumn("x", F.col("p") / F.col("q"))
    for r in df.select("p", "q", round_exact(F.col("x"), 2).alias("a"), round_exact(-F.col("x") * 37, 1).alias("b")).collect():
        assert r.a == round(r.p / r.q, 2)
        assert r.b == round(-r.p / r.q * 37, 1)


def test_every_space_character_and_run_is_replaced(spark):
    """Single spaces are no match, runs and every other space character are; compared with the plain rules."""
    texts = ["a" + c + d + "b" for c in X.ALL_SPACES for d in ("", " ", "\t", c)] + [" a  b ", " ", "", None, "‐a⯿b、"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    inline = X.INLINE_SPACES
    for row in df.select("t", X.plain_spaces("t").alias("p"), X.normalize_whitespace("t").alias("n"), X.sanitize_content("t").alias("s")).collect():
        if row.t is None:
            assert row.p is row.n is row.s is None
            continue
        assert row.p == "".join(" " if c in X.ALL_SPACES else c for c in row.t)
        assert row.n == " ".join(row.p.split())
        lines = re.sub(f" ?[{X.LINE_BREAKS}][{X.LINE_BREAKS} ]*", "\n", re.sub(f"[{inline}]+", " ", row.t))
        assert row.s == lines.strip(" \n")
