"""Lexicons given as tables: sentiment, tones and trends on hand-made texts."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexicons


@pytest.mark.parametrize("known", [100_000, 0])
def test_sentiment_and_tones(spark, monkeypatch, known):
    monkeypatch.setattr(lexicons, "KNOWN", known)
    texts = [(1, "good good bad fine"), (2, "nothing said"), (3, None), (4, ""), (5, "bad awful"), (6, "good " * 200)]
    df = spark.createDataFrame([(k, t, "clash", 9) for k, t in texts], "id long, text string, word string, weight int")
    split = F.filter(F.split("text", " "), lambda w: w != "")
    words = spark.createDataFrame([("good", 1.0), ("fine", 0.5), ("bad", -1.0), ("awful", -2.0), ("awful", 0.5), ("even", 0.0), (None, 1.0)], "word string, weight double")
    got = {r["id"]: r for r in lexicons.sentiment(df, "id", split, words).collect()}
    expect = {1: (2, 1, 1 / math.sqrt(5)), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (0, 0, 0.0), 5: (0, 2, -1.0), 6: (1, 0, 1 / math.sqrt(201))}
    assert got.keys() == expect.keys()
    for k, (p, n, s) in expect.items():
        assert (got[k]["positive"], got[k]["negative"]) == (p, n) and math.isclose(got[k]["score"], s, abs_tol=1e-12)
    assert [got[k]["label"] for k in range(1, 7)] == ["positive", "neutral", "neutral", "neutral", "negative", "positive"]
    kinds = spark.createDataFrame([("good", "warm"), ("fine", "warm"), ("bad", "cold"), ("awful", "cold"), ("good", "bright")], "word string, category string")
    tone = {r["id"]: (r["tone"], r["hits"]) for r in lexicons.tones(df, "id", split, kinds).collect()}
    assert tone == {1: ("warm", 2), 2: ("neutral", 0), 3: ("neutral", 0), 4: ("neutral", 0), 5: ("cold", 2), 6: ("bright", 1)}
    assert lexicons.sentiment(df.limit(0), "id", split, words).count() == 0 and lexicons.tones(df, "id", split, kinds.limit(0)).where("tone <> 'neutral'").count() == 0


def test_trends(spark):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    rows = [("up", day(k), k / 10) for k in range(10)] + [("down", day(k), -k / 5) for k in range(4)] + [("flat", day(k), 0.3) for k in range(5)] + [("one", day(0), 1.0), ("none", None, 1.0), ("none", day(1), None), ("up", day(0), 0.2)]
    daily = lexicons.score_trend(spark.createDataFrame(rows, "k string, day date, score double"), ["k"])
    first = daily.where("k = 'up'").orderBy("day").first()
    assert (first["n"], round(first["mean"], 9)) == (2, 0.1)
    assert {r["k"]: (r["days"], r["n"], r["trend"]) for r in lexicons.score_direction(daily, ["k"]).collect()} == {"up": (10, 11, "rising"), "down": (4, 4, "falling"), "flat": (5, 5, "stable"), "one": (1, 1, "stable")}


def test_hits_of_keys_that_are_not_repeated_keep_no_words(spark):
    """Words are told apart only where rows share a key (document_tones)."""
    lexicon = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "word string, category string")
    texts = [(1, "a b c c"), (2, "c"), (3, None)]
    for rows, distinct in ((texts, False), (texts + [(1, "a c"), (None, "b")], True)):
        got = lexicons.tones(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", F.split("text", " "), lexicon)
        assert distinct == ("count(distinct" in got._jdf.queryExecution().analyzed().toString())
        assert {(r["doc_id"], r["tone"], r["hits"]) for r in got.collect() if r["doc_id"]} == {(1, "x", 2), (2, "y", 1), (3, "neutral", 0)}
