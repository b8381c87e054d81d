"""Sentiment, tones and their trends by lexicons that the caller gives as tables, joined to the distinct words of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import checkpoints
from tidemark.operators.series import _numbered

#: A lexicon of so many rows or fewer is sent to the tasks; any other is joined by its words.
KNOWN = 100_000
#: Means of the halves of a series further apart than this are a trend; scores beyond the band are positive or negative.
SHIFT, BAND = 0.1, 0.05


def _hits(df: DataFrame, key: str, words: Column, lexicon: DataFrame) -> DataFrame:
    """``key, word`` and the lexicon's columns for each distinct word of a text that the lexicon has."""
    checkpoints(df.sparkSession)
    known = lexicon.where("word is not null").distinct().checkpoint()
    rows = df.select(key, F.explode(F.array_distinct(words)).alias("word"))
    return rows.join(F.broadcast(known) if known.count() <= KNOWN else known, "word")


def _counter(df: DataFrame, key: str):
    """How hits of a key are counted: where no two rows share it each word of a text is one row, so no task keeps words; else words are told apart."""
    again = df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    if again.isEmpty():
        return lambda which: F.count(F.when(which, 1))
    return lambda which: F.countDistinct(F.when(which, F.col("word")))


def sentiment(df: DataFrame, key: str, words: Column, lexicon: DataFrame) -> DataFrame:
    """``key, positive, negative, score, label`` of every row's text: distinct words of the lexicon (``word, weight``) above and below 0, and (positive - negative) / sqrt(words + 1) within -1 and 1.

    A word that the lexicon has more than once counts by the sum of its weights. Texts that are null or without its words score 0. Rows that share a key share its hits.
    """
    weights = lexicon.groupBy("word").agg(F.sum("weight").alias("weight"))
    count = _counter(df, key)
    found = _hits(df, key, words, weights).groupBy(F.col(key).alias("_key")).agg(count(F.col("weight") > 0).alias("positive"), count(F.col("weight") < 0).alias("negative"))
    n = df.select(key, F.coalesce(F.size(words), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))
    out = n.join(found, F.col(key) == F.col("_key"), "left").select(key, "n", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("positive", "negative")))
    out = out.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("positive") - F.col("negative")) / F.sqrt(F.col("n") + 1.0))))
    label = F.when(F.col("score") > BAND, "positive").when(F.col("score") < -BAND, "negative").otherwise("neutral")
    return out.select(key, "positive", "negative", "score", label.alias("label"))


def tones(df: DataFrame, key: str, words: Column, lexicon: DataFrame, default: str = "neutral") -> DataFrame:
    """``key, tone, hits``: the category of the lexicon (``word, category``) with the most distinct words in the text, the least of equals; ``default`` and 0 where there is none."""
    found = _hits(df, key, words, lexicon.select("word", "category")).groupBy(key, "category").agg(_counter(df, key)(F.lit(True)).alias("hits"))
    best = found.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct((-F.col("hits")).alias("less"), "category")).alias("b"))
    return df.select(key).distinct().join(best, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("b.category", F.lit(default)).alias("tone"), F.coalesce(-F.col("b.less"), F.lit(0).cast("long")).alias("hits"))


def score_trend(scored: DataFrame, keys: list[str], day: str = "day", score: str = "score") -> DataFrame:
    """``keys, day, n, mean``: the mean score of each day."""
    return scored.where(F.col(day).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(day).alias("day")).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))


def score_direction(daily: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, days, n, mean, trend`` of daily means: rising or falling where the second half of the days differs from the first by more than SHIFT, else stable. One day is stable."""
    half = F.floor(F.col("_c") / 2)
    mean = lambda which: F.sum(F.when(which, F.col("mean") * F.col("n"))) / F.sum(F.when(which, F.col("n")))
    m = _numbered(daily, keys).groupBy(*keys).agg(F.count("*").alias("days"), F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), mean(F.col("_i") <= half).alias("a"), mean(F.col("_i") > half).alias("b"))
    diff = F.col("b") - F.col("a")
    return m.select(*keys, "days", "n", "mean", F.when(diff > SHIFT, "rising").when(diff < -SHIFT, "falling").otherwise("stable").alias("trend"))
