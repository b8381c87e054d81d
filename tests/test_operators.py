"""Transforms on hand-made rows: empty tables, nulls, ties, flat series, and text that the tables don't hold."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import compliance, dedup, filters, series, text_stats, vectors
from tidemark.sources import readers, writers
from tidemark.streaming import activity


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.normal_url(F.col("u")), u="https://www.Example.com/A/?utm_source=x&ref=y#top") == "example.com/a"
    assert one(spark, X.normal_url(F.col("u")), u="http://a.b/c?id=1&utm_x=2&z=3") == "a.b/c?id=1&z=3"
    assert one(spark, X.mentions(F.col("t")), t="hi @ann and @bob_2, not a@c @ann") == ["ann", "bob_2"]
    assert one(spark, X.hashtags(F.col("t")), t="#One #two #one") == ["one", "two"]
    assert one(spark, X.links(F.col("t")), t="see https://a.b/c. and https://a.b/c") == ["https://a.b/c"]
    assert one(spark, X.mask_email(F.col("t")), t="to ann.b@c.de now") == "to a***@c.de now"
    assert one(spark, X.read_minutes(F.col("t")), t="") == 0
    assert one(spark, X.flesch(F.col("t")), t="") == 50.0
    assert one(spark, X.meta_description(F.col("t"), 12), t="One two. Three four. Five.") == "One two."
    assert one(spark, X.meta_description(F.col("t"), 12), t="Onetwothree four five. Six.") == "Onetwothree" and one(spark, X.meta_description(F.col("t")), t=None) == ""
    assert one(spark, X.clean_markup(F.col("t")), t="<p>a  <b>b</b>§</p>") == "a b"


def test_series_edges(spark):
    days = [(k, date(2024, 1, d), n) for k, v in {"flat": [5, 5, 5, 5], "jump": [5, 5, 5, 9], "one": [3]}.items() for d, n in enumerate(v, 1)]
    df = spark.createDataFrame(days, "k string, day date, n long")
    labels = {(r["k"], r["day"].day): r["label"] for r in series.zscores(df, ["k"]).collect()}
    assert labels["flat", 4] == "normal" and labels["jump", 4] == "spike" and labels["one", 1] == "normal"
    assert {r["k"]: r["autocorrelation"] for r in series.autocorrelation(df, ["k"], 1).collect()}["flat"] == 0.0
    assert series.dense(df.where("false"), ["k"], ["n"]).count() == 0
    assert series.dense(df, ["k"], ["n"]).count() == 3 * 4 and series.dense(df.where("k = 'one'"), ["k"], ["n"]).count() == 1
    assert {r["k"]: (r["label"], r["z"]) for r in series.last_against_rest(df, ["k"], F.col("n")).collect()}["one"] == ("normal", 0.0)
    assert {r["k"]: r["is_shift"] for r in series.half_shift(df, ["k"], "n", 0.3, True).collect()} == {"flat": False, "jump": True, "one": True}
    assert {r["k"]: r["growth"] for r in series.compound_growth(df, ["k"]).collect()} == {"flat": 0.0, "jump": round(1.4**0.5 - 1, 6), "one": 0.0}
    assert {r["stage"] for r in series.lifecycle(df, ["k"]).collect()} == {"emerging"} and {r["trend"] for r in series.direction(df, ["k"]).collect()} == {"stable"}
    assert series.trend_changes(df, ["k"], 2).count() == 0


def test_components_and_content_links(spark):
    from tidemark.operators.graph import components

    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (7, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {k: 0 for k in range(31)} | {40: 40, 50: 40}
    assert components(links.where("false")).count() == 0
    texts = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha beta gamma omega"), (4, "other words entirely"), (5, ""), (6, None)]
    found = dedup.cosine_links(text_stats.tfidf(spark.createDataFrame(texts, "id long, t string"), "id", X.words(F.col("t"))), "id", 0.6).collect()
    assert {(r["a"], r["b"]) for r in found} >= {(1, 2)} and all(r["b"] < 4 for r in found)


def test_words_and_syllables(spark):
    assert one(spark, X.words(F.col("t"), 3, ("the", "and")), t="The then AND andes a bb ccc http://x.y/the z9z") == ["then", "andes", "ccc", "z9z"]
    assert round(one(spark, X.flesch(F.col("t")), t="The be queue rhythm e. Fly be!"), 3) == round(206.835 - 1.015 * 7 / 2 - 84.6 * 7 / 7, 3)


def test_readability_near_ties(spark, tmp_path):
    """120 words, 6 sentences, 177 syllables lie just below a tie; 125, 7, 200 do so until they are multiplied."""
    from tidemark.plans.text import readability

    made = lambda words, ends, syllables: " ".join(("baba" if i < syllables - words else "ba") + ("." if i % (words // ends) == 0 and i // (words // ends) < ends - 1 else "") for i in range(words))
    spark.createDataFrame([(1, made(120, 6, 177)), (2, made(125, 7, 200)), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["flesch"] for r in readability(spark, str(tmp_path)).collect()} == {1: 61.7, 2: 53.4, 3: 50.0}


def test_boolean_search(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, "red pear"), (3, None)], "id long, t string")
    rows = filters.boolean_search(df, F.lit(1.0), {"t": ["red"]}, {"t": ["apple", "plum"]}, {"t": ["pear"]}).collect()
    assert [(r["id"], r["score"]) for r in rows] == [(1, 1.1)]


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "")], "id long, t string")
    w = text_stats.tfidf(df, "id", X.words(F.col("t"))).groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert {r["id"]: round(r["s"], 9) for r in w} == {1: 1.0, 2: 1.0}


@pytest.mark.parametrize("known", [100, 0])
def test_tfidf_exchanges_texts_alone(spark, monkeypatch, known):
    """Weights and their totals by hand, with repeated ids and words of one text; no word is exchanged where the shared ones are sent."""
    import math

    monkeypatch.setattr(text_stats, "KNOWN", known)
    df = spark.createDataFrame([(1, "a b b"), (2, "a c"), (2, "c d"), (3, ""), (4, None)], "id long, t string")
    idf = lambda n: math.log((1 + 4) / (1 + n)) + 1
    raw = {(1, "a"): idf(2), (1, "b"): 2 * idf(1), (2, "a"): idf(2), (2, "c"): 2 * idf(1), (2, "d"): idf(1)}
    norm = {k: math.sqrt(sum(v * v for (i, _), v in raw.items() if i == k)) for k in (1, 2)}
    weights = text_stats.tfidf(df, "id", X.words(F.col("t")))
    assert {(r["id"], r["word"]): round(r["weight"], 9) for r in weights.collect()} == {k: round(v / norm[k[0]], 9) for k, v in raw.items()}
    totals = text_stats.tfidf_totals(df, "id", text_stats.hashed(X.words(F.col("t"))))
    got = {r["id"]: (r["terms"], round(r["strongest"], 9), round(r["mass"], 9)) for r in totals.collect()}
    assert got == {k: (n, round(max(v for (i, _), v in raw.items() if i == k) / norm[k], 9), round(sum(v for (i, _), v in raw.items() if i == k) / norm[k], 9)) for k, n in ((1, 2), (2, 3))}
    if known:
        plan = totals._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" in plan and ", word" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_dedup(spark):
    df = spark.createDataFrame([(1, "A ", "x"), (2, "a", "yy"), (3, "b", None)], "id long, t string, body string")
    assert [r["id"] for r in dedup.keep_first(df, F.lower(F.trim("t")), ["id"]).orderBy("id").collect()] == [1, 3]
    assert dedup.groups_by_key(df, F.lower(F.trim("t")), "id").first()["n"] == 2


def test_mmr_prefers_what_differs(spark):
    rows = [(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.89, [1.0, 0.01]), (0, 3, 0.5, [0.0, 1.0])]
    out = vectors.mmr(spark.createDataFrame(rows, "query long, id long, score double, v array<double>"), 2, 0.5).collect()
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"])] == [1, 3]


def test_hash_chain_finds_a_change(spark):
    df = spark.createDataFrame([("a", i, f"p{i}") for i in range(4)], "c string, i int, p string")
    chain = compliance.chained(df, "c", ["i"], F.col("p"))
    changed = compliance.chained(df.withColumn("p", F.when(F.col("i") == 2, "no").otherwise(F.col("p"))), "c", ["i"], F.col("p"))
    assert compliance.verified(chain, chain, "c").first()["intact"] is True
    assert compliance.verified(chain, changed, "c").first()["intact"] is False


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "posts.json").write_text('{"title":"T","body":"hello #Tag","url":"u1","author":{"name":"ann"},"time":1704067200,"likes":3}\n{"text":"x","user":{"name":"bob"},"created_at":"2024-01-02T00:00:00"}\n')
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>F</title><link>u2</link><description>d &lt;b&gt;x&lt;/b&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    items = readers.collect(spark, [("posts", f"{tmp_path}/posts.json", "p"), ("feed", f"{tmp_path}/feed.xml", "f"), ("csv", "missing", "off")], ["p", "f"])
    rows = {r["source"]: r for r in items.orderBy("url").collect()}
    assert items.count() == 3 and rows["p"]["author_name"] == "ann" and rows["p"]["hashtags"] == ["tag"] and rows["f"]["published_at"].hour == 10
    writers.to_csv(items, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 3
    assert writers.append_new(items, items, "id").count() == 0
    kept = writers.archive_before(items, "published_at", "2024-01-02", f"{tmp_path}/old")
    assert kept.count() == 1 and spark.read.json(f"{tmp_path}/old").count() == 2


def test_streams_equal_batch(spark, tmp_path):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    raw.repartition(3).write.parquet(f"{tmp_path}/events")
    batch = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = activity.events(spark, f"{tmp_path}/events", late="60 days")
    for name, build, mode in (("daily", activity.daily_counts, "complete"), ("sessions", activity.sessions, "complete"), ("errors", activity.escalation_levels, "update"), ("once", activity.distinct_events, "append")):
        activity.to_table(build(stream), name, f"{tmp_path}/{name}", mode).awaitTermination()
    day = spark.table("daily").select("day", "event_type", "n")
    expect = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert day.exceptAll(expect).isEmpty() and expect.exceptAll(day).isEmpty()
    assert spark.table("sessions").count() == activity.sessions(batch).count()
    assert spark.table("errors").groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == (batch.where("event_type = 'error'").count() or None)
    assert spark.table("once").count() == batch.count()


def test_summaries_exchange_nothing(spark):
    """Sentences by their words' counts in the text; ties go to the earlier one, null and empty texts have no row."""
    df = spark.createDataFrame([(1, "Rare one here. Sea sea sea. Sky blue. Sea sky. Last word!"), (2, "One two. One two. One two."), (3, ""), (4, None), (5, "no end")], "id long, t string")
    found = text_stats.summaries(df, "id", "t", 2)
    assert {r["id"]: r["summary"] for r in found.collect()} == {1: "Rare one here. Sea sea sea.", 2: "One two. One two.", 5: "no end"}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    twice = df.unionByName(spark.createDataFrame([(5, "no end"), (None, "no id")], "id long, t string"))
    rows = [(r["id"], r["summary"]) for r in text_stats.summaries(twice, "id", "t", 2).collect()]
    alone = [(r["id"], r["summary"]) for r in text_stats._shared_summaries(twice, "id", "t", 2).collect()]
    assert sorted(rows, key=str) == sorted(alone, key=str) and len(rows) == 4
