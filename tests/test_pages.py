"""Published pages: each file parses on its own, the pages together hold all articles."""

import datetime as dt
import glob
import json
import xml.etree.ElementTree as ET

from feedlake.sources import pages

SCHEMA = "id STRING, title STRING, content STRING, original_url STRING, published_at TIMESTAMP, rewritten_content STRING, rewrite_status STRING"


def articles(spark, n):
    rows = [(f"a{i:03}", f"T <{i}> & ü", "line\nline ]]>", f"http://x/{i}?a=1&b=2", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None, "pending") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def files(path):
    return {int(f.split("page=")[1].split("/")[0]): open(f, encoding="utf-8").read() for f in glob.glob(f"{path}/items-*/page=*/part-*")}


def test_rss_pages(spark, tmp_path):
    path = str(tmp_path)
    assert pages.write_rss_pages(articles(spark, 23), path, "http://f", "N & N", "http://x", "d", "now", page_items=5) == 5
    found, links = files(path), {}
    assert sorted(found) == list(range(5))
    guids = []
    for n, text in sorted(found.items()):
        channel = ET.fromstring(text).find("channel")
        assert channel.findtext("title") == "N & N"
        guids += [i.findtext("guid") for i in channel.findall("item")]
        links[n] = {e.get("rel"): e.get("href") for e in channel.findall("{http://www.w3.org/2005/Atom}link")}
        assert all(i.findtext("description") == "line\nline ]]>" for i in channel.findall("item"))
    assert guids == [f"a{i:03}" for i in reversed(range(23))]
    assert links[0] == {"next": "http://f/page=1"} and links[4] == {"previous": "http://f/page=3"}
    assert links[2] == {"previous": "http://f/page=1", "next": "http://f/page=3"}


def test_json_pages_and_removal_of_old_ones(spark, tmp_path):
    path = str(tmp_path)
    for n in (7, 0, 12):
        assert pages.write_json_pages(articles(spark, n), path, "http://f", "now", page_items=6, keep=1) == max(1, -(-n // 6))
        documents = {k: json.loads(t) for k, t in files(path).items()}
        assert [len(d["items"]) for _, d in sorted(documents.items())] == ([6, n - 6] if n else [0])
        assert all(d["count"] == n for d in documents.values())
    assert documents[0]["next"] == "http://f/page=1" and documents[0]["previous"] is None
    assert {i["title"] for d in documents.values() for i in d["items"]} == {f"T <{i}> & ü" for i in range(12)}
    assert pages.read_pages(spark, path).count() == 2


def test_page_index_reads_a_range_of_positions(spark, tmp_path):
    df = articles(spark, 57)
    index = pages.PageIndex(str(tmp_path), "id")
    assert index.build(df) == 57
    for page in (1, 3, 6, 7):
        rows = index.page(df, page, 10).collect()
        assert [r.id for r in rows] == [f"a{i:03}" for i in range((page - 1) * 10, min(page * 10, 57))]
        assert all(r.total == 57 for r in rows)
    keys, _ = index.keys(spark, 50, 10)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(position,50), LessThan(position,60)" in plan and "Sort" not in plan
    assert index.build(df.where("id < 'a020'")) == 20
    assert [r.id for r in index.page(df, 2, 15).collect()] == [f"a{i:03}" for i in range(15, 20)]
