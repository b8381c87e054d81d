"""Holds: every criterion alone, all together, and what is preserved once."""

import datetime

from pyspark.sql import functions as F

from tidemark.operators import holds

DAY = datetime.datetime(2024, 5, 5, 12)
SCHEMA = "id long, title string, content string, source string, topics array<string>, author_name string, url string, published_at timestamp, hold string"


def hold(name, status="active", keywords=None, sources=None, topics=None, authors=None, domains=None, date_from=None, date_to=None):
    return (name, status, keywords, sources, topics, authors, domains, date_from, date_to)


def test_held(spark):
    items = spark.createDataFrame([
        (1, "A Report", "on merging", "blog", ["AI", "Law"], "ann", "http://a.example/x", DAY, "clash"),
        (2, None, None, None, None, None, None, None, None), (3, "Other", "text", "news", [], "bob", "http://b.example", DAY + datetime.timedelta(1), ""), (3, "Other", "text", "news", [], "bob", "http://b.example", DAY + datetime.timedelta(1), ""),
    ], SCHEMA)
    table = spark.createDataFrame([
        hold("words", keywords=["MERG", "nothing"]), hold("title", keywords=["a rep"]), hold("source", sources=["blog"]), hold("topic", topics=["law"]), hold("author", authors=["bob", "eve"]), hold("domain", domains=["b.example"]),
        hold("from", date_from=DAY + datetime.timedelta(1)), hold("to", date_to=DAY), hold("all"), hold("none", keywords=[], sources=[]), hold("released", "released", sources=["blog"]),
        hold("both", keywords=["merging"], sources=["blog"], topics=["ai"], authors=["ann"], domains=["a."], date_from=DAY, date_to=DAY), hold("miss", keywords=["merging"], sources=["news"]), hold("in source", keywords=["news"]),
    ], holds.HOLDS)
    got = {}
    for r in holds.held(items, table).collect():
        got.setdefault(r["hold"], []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "words": [1], "title": [1], "source": [1], "topic": [1], "author": [3], "domain": [3], "from": [2, 3], "to": [1, 2], "all": [1, 2, 3], "none": [1, 2, 3], "both": [1], "in source": [3],
    }
    assert holds.held(items.limit(0), table).count() == 0 and holds.held(items, table.limit(0)).count() == 0


def test_preserved_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "t", "old", "s", [], "a", "u", DAY, ""), (2, "t", "two", "s", [], "a", "u", None, "")], SCHEMA)
    first = holds.preserved(items, spark.createDataFrame([("h", 1)], "hold string, id long"), F.lit("2024-01-01"))
    changed = items.withColumn("content", F.lit("new"))
    both = holds.preserved(changed, spark.createDataFrame([("h", 1), ("h", 2), ("g", 2), ("g", 9)], "hold string, id long"), F.lit("2024-02-01"), first).collect()
    assert sorted((r["hold"], r["id"], r["preserved_at"].month, '"new"' in r["snapshot"]) for r in both) == [("g", 2, 2, True), ("h", 1, 1, False), ("h", 2, 2, True)]
    holds.export(first, f"{tmp_path}/out")
    assert [(r["hold"], r["id"]) for r in spark.read.json(f"{tmp_path}/out").collect()] == [("h", 1)]
