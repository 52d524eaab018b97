"""Duplicate groups and merging, normal and skewed, against a sequential restatement."""

import random
import re
from collections import defaultdict

import pytest

from feedlake.operators import dedup, merge
from feedlake.plans.jobs import merged_items

SCHEMA = (
    "arrival BIGINT, id STRING, source_id STRING, source_name STRING, source_priority INT, source_weight DOUBLE, "
    "source_reliability_score DOUBLE, title STRING, content STRING, url STRING, published_at TIMESTAMP"
)


def item(arrival, id_, title, content="c", source="s", priority=1, weight=1.0, reliability=1.0):
    return (arrival, id_, source, source.upper(), priority, weight, reliability, title, content, "u" + id_, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def greedy(rows):
    """Group of each item; groups as lists, searched in order of creation."""
    groups, label = [], {}
    for r in rows:
        title = " ".join((r[7] or "").lower().split())
        for g in groups:
            if any(x[1] == r[1] or (title and " ".join((x[7] or "").lower().split()) == title) for x in g):
                g.append(r)
                break
        else:
            groups.append([r])
    for g in groups:
        for r in g:
            label[r[0]] = g[0][0]
    return label, groups


def labels(df):
    return {r.arrival: r.group_id for r in df.collect()}


def test_bridging_item(spark):
    rows = [item(1, "1", "t1"), item(2, "2", "t2"), item(3, "2", "t1")]
    df = frame(spark, rows)
    assert labels(dedup.group_duplicates(df)) == {1: 1, 2: 2, 3: 1}
    assert labels(dedup.group_duplicates(df, "transitive")) == {1: 1, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        dedup.group_duplicates(df, "other")


def test_empty_urls_and_titles(spark):
    rows = [item(1, "e", "a"), item(2, "e", "b"), item(3, "x", ""), item(4, "y", ""), item(5, "z", None)]
    assert labels(dedup.group_duplicates(frame(spark, rows))) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot_rows, blocks", [(1_000_000, None), (4, 5)])
def test_greedy_equals_sequential(spark, seed, hot_rows, blocks):
    """A third of the rows share an id and a third a title."""
    rng = random.Random(seed)
    rows = []
    for n in range(150):
        hot = rng.random()
        id_ = "hot" if hot < 0.33 else f"i{rng.randrange(60)}"
        title = "Hot  Title" if hot > 0.67 else f"T {rng.randrange(60)}"
        rows.append(item(n, id_, title))
    expected, _ = greedy(rows)
    assert labels(dedup.group_duplicates(frame(spark, rows), hot_rows=hot_rows, blocks=blocks)) == expected


def test_long_chain(spark):
    """A path of alternating ids and titles, laid out so labels must travel its whole length."""
    n = 24
    edges = [(f"i{k}", f"t{k}") for k in range(n)] + [(f"i{k + 1}", f"t{k}") for k in range(n - 1)]
    rows = [item(a, i, t) for a, (i, t) in enumerate(edges)]
    expected, _ = greedy(rows)
    assert labels(dedup.group_duplicates(frame(spark, rows))) == expected
    assert set(labels(dedup.group_duplicates(frame(spark, rows), "transitive")).values()) == {0}


def test_priority_order_and_ties(spark):
    rows = [
        item(1, "1", "Same", "low", priority=1), item(2, "1", " same ", "high", priority=10),
        item(3, "3", "x", "first"), item(4, "4", "x", "second"),
        item(5, "5", "y", "light", weight=1.0), item(6, "6", "y", "heavy", weight=2.0, reliability=0.1),
        item(7, "7", "z", "bad", reliability=0.2), item(8, "8", "z", "good", reliability=0.9),
    ]
    got = {r.content for r in merge.aggregate_sources(frame(spark, rows)).collect()}
    assert got == {"high", "first", "heavy", "good"}
    unknown = {r.content for r in merge.aggregate_sources(frame(spark, rows), "whatever").collect()}
    assert unknown == got
    assert merge.aggregate_sources(frame(spark, [])).count() == 0


def combine(groups):
    out = []
    for g in groups:
        ranked = sorted(g, key=lambda r: (r[4], r[5], r[6]), reverse=True)
        text, seen = ranked[0][8] or "", {(ranked[0][8] or "").strip()}
        for r in ranked[1:]:
            extra = r[8] or ""
            if extra.strip() and extra.strip() not in seen:
                text += f"\n\n--- [Alternative Content from {r[3]}] ---\n{extra}"
                seen.add(extra.strip())
        out.append((ranked[0][1], text))
    return sorted(out)


def test_combine(spark):
    """One group holds a third of the rows; the result is the same over any number of partitions."""
    rng = random.Random(7)
    rows = []
    for n in range(120):
        title = "hot" if n % 3 == 0 else f"t{rng.randrange(50)}"
        content = rng.choice(["", "  ", None, f" text {rng.randrange(40)} ", f"text {rng.randrange(40)}", "long " * rng.randrange(9)])
        rows.append(item(n, f"i{n}", title, content, f"s{rng.randrange(5)}", rng.randrange(3), rng.random() // 0.5, 1.0))
    df = frame(spark, rows)
    groups = dedup.group_duplicates(df)
    want = combine(greedy(rows)[1])
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert sorted((r.id, r.content) for r in merge.merge_combine(df, groups).collect()) == want
            pieces = merge.combine_pieces(df, groups).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        by_group = defaultdict(list)
        for p in sorted(pieces, key=lambda p: (p.group_id, p.position)):
            by_group[p.group_id].append(p)
        assert all([p.position for p in ps] == list(range(len(ps))) for ps in by_group.values())
        assert sorted("".join(p.piece for p in ps) for ps in by_group.values()) == sorted(text for _, text in want)


def test_folded_texts_are_not_shuffled_again(spark):
    """No exchange lies above the aggregate that folds a group's text."""
    rows = [item(n, f"i{n}", "hot" if n % 3 == 0 else f"t{n % 7}", f"text {n}", f"s{n % 5}", n % 2) for n in range(60)]
    df = frame(spark, rows)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = merge.merge_combine(df, dedup.group_duplicates(df))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    depth = lambda line: re.search(r"\w", line).start()
    at = next(i for i, line in enumerate(plan) if "collect_list" in line and "Aggregate" in line)
    above, least = [], depth(plan[at])
    for line in plan[at - 1::-1]:
        if line.strip() and depth(line) < least:
            least = depth(line)
            above.append(line)
    assert any("Join" in line for line in above)
    assert not any("Exchange" in line for line in above)


def test_pieces_have_the_winners_fields(spark):
    """Joined by position they are the one-row articles, and no plan gathers a group into a row."""
    rows = [item(n, f"i{n}", "hot" if n % 3 == 0 else f"t{n % 7}", f"text {n}", f"s{n % 5}", n % 2) for n in range(60)]
    df = frame(spark, rows)
    for get in (merge.aggregate_sources, merged_items):
        got = get(df, "pieces")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan
        articles = defaultdict(list)
        for r in sorted(got.collect(), key=lambda r: (r.group_id, r.position)):
            articles[r.id, r.source_id, r.title, r.url, r.published_at].append((r.position, r.piece))
        assert all([p for p, _ in ps] == list(range(len(ps))) for ps in articles.values())
        one = {(r.id, r.source_id, r.title, r.url, r.published_at): r.content for r in get(df, "combine").collect()}
        assert {k: "".join(x for _, x in ps) for k, ps in articles.items()} == one


def test_duplicate_report(spark):
    rows = [item(1, "1", "a", source="x"), item(2, "2", "a", source="y", priority=5), item(3, "3", "A", source="y"), item(4, "4", "b")]
    df = frame(spark, rows)
    report = dedup.duplicate_report(df, dedup.group_duplicates(df)).collect()
    assert [(r.group_id, r.n_items, r.n_sources, r.id) for r in report] == [(1, 3, 2, "2")]


def test_dedup_exact_keeps_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, "")], "arrival INT, content STRING")
    assert sorted(r.arrival for r in dedup.dedup_exact(df).collect()) == [1, 2, 4]


def test_merged_items_have_unique_ids(spark):
    """Greedy groups {1,3} and {2} both win with id 2: the older group keeps it."""
    rows = [item(1, "1", "t1", "one"), item(2, "2", "t2", "two"), item(3, "2", "t1", "three", priority=9)]
    for strategy in ("priority", "combine"):
        got = merged_items(frame(spark, rows), strategy).collect()
        assert [r.id for r in got] == ["2"]
        assert got[0].content.startswith("three")


def test_top_one_is_pruned_before_the_shuffle(spark):
    df = frame(spark, [item(1, "1", "a")])
    plan = merge.winners(df, df.selectExpr("arrival", "arrival AS group_id"))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
