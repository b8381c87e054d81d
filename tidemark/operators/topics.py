"""How good topics are and how alike: co-occurrence of their top words, divergence of their word distributions, and merges of like ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.graph import checkpoints, components

#: So many top words of all topics, or fewer, are sent to the tasks; more are joined by the word.
KNOWN = 100_000
#: So many different top words, or fewer, are counted in one pass by a square of numbers in each task.
FEW = 1_000


def top_words(topics: DataFrame, n: int) -> DataFrame:
    """``topic, word, weight, rank``: the ``n`` words of greatest weight of each topic, of equals the least."""
    best = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    return topics.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _counted(held: DataFrame, listed: list[str], top: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The number of texts, ``word, n`` and ``topic, a, b, both`` in one pass over the texts: each task counts its texts by word and by pair of words, whatever their topic, and only these sums are exchanged."""
    kept = held.select(F.filter("w", lambda w: w.isin(listed)).alias("w")) if listed else held.select(F.array().cast("array<string>").alias("w"))
    size = len(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, sums, texts = {w: i for i, w in enumerate(listed)}, np.zeros((size, size), np.int64), 0
        for batch in batches:
            for begin in range(0, len(batch), 1_000):
                part = batch["w"].iloc[begin : begin + 1_000]
                held = np.zeros((len(part), size), np.float32)
                for i, words in enumerate(part):
                    held[i, [place[w] for w in words]] = 1
                sums += (held.T @ held).astype(np.int64)
            texts += len(batch)
        a, b = np.nonzero(np.triu(sums))
        yield pd.DataFrame({"a": [-1, *a], "b": [-1, *b], "n": [texts, *sums[a, b]]})

    spark = held.sparkSession
    counts = kept.mapInPandas(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).checkpoint()  # FEW squared at most
    words = spark.createDataFrame(list(enumerate(listed)), "i int, word string")
    total = counts.where("a = -1").select(F.col("n").alias("texts"))
    alone = counts.where("a = b and a >= 0").join(words, F.col("a") == F.col("i")).select("word", "n")
    numbered = top.join(words, "word").select("topic", "i")
    wanted = numbered.select("topic", F.col("i").alias("a")).join(numbered.select("topic", F.col("i").alias("b")), "topic").where("a < b")
    first, other = words.select(F.col("i").alias("a"), F.col("word").alias("wa")), words.select(F.col("i").alias("b"), F.col("word").alias("wb"))
    both = wanted.join(counts, ["a", "b"]).join(first, "a").join(other, "b").select("topic", F.least("wa", "wb").alias("a"), F.greatest("wa", "wb").alias("b"), F.col("n").alias("both"))
    return total, alone, both


def coherence(topics: DataFrame, texts: DataFrame, key: str, words: Column, n: int = 10) -> DataFrame:
    """``topic, pairs, coherence``: the mean lift (both * texts / (one * other), in texts that hold them) of all pairs of the topic's ``n`` top words.

    topics: ``topic, word, weight``. Texts without words don't count; words in no text are left out of the pairs, topics without a pair have no row.
    """
    checkpoints(texts.sparkSession)
    top = top_words(topics, n).select("topic", "word").checkpoint()
    held = texts.select(key, F.array_distinct(words).alias("w")).where(F.size("w") > 0)
    listed = [r["word"] for r in top.select("word").distinct().orderBy("word").limit(FEW + 1).collect()]
    again = texts.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())  # pairs of texts that share a key are met across them
    if len(listed) <= FEW and again.isEmpty():
        total, alone, both = _counted(held.select("w"), listed, top)
        one = top.join(alone, "word")
    else:
        total = held.agg(F.count("*").alias("texts"))
        rows = held.select(key, F.explode("w").alias("word")).join(F.broadcast(top) if top.count() <= KNOWN else top, "word")
        one = rows.groupBy("topic", "word").agg(F.count("*").alias("n"))
        lists = rows.groupBy("topic", key).agg(F.array_sort(F.collect_list("word")).alias("w"))  # n words at most
        pair = F.flatten(F.transform("w", lambda a, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        both = lists.select("topic", F.explode(pair).alias("p")).groupBy("topic", "p.a", "p.b").agg(F.count("*").alias("both"))
    known = one.select("topic", F.col("word").alias("a"), F.col("n").alias("na")).join(one.select("topic", F.col("word").alias("b"), F.col("n").alias("nb")), "topic").where("a < b")
    lifts = known.join(both, ["topic", "a", "b"], "left").crossJoin(F.broadcast(total))  # one row
    lift = F.coalesce("both", F.lit(0)) * F.col("texts") / (F.col("na") * F.col("nb"))
    return lifts.groupBy("topic").agg(F.count("*").alias("pairs"), F.avg(lift).alias("coherence"))


def divergences(topics: DataFrame) -> DataFrame:
    """``a, b, divergence`` (a < b): the Jensen-Shannon divergence (natural logarithm) of every two topics' word distributions.

    topics: ``topic, word, weight``, weights above 0. Only shared words are joined: what a topic has alone adds half its share times ln 2.
    """
    share = topics.where("weight > 0").withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("topic"))).select("topic", "word", "p")
    names = share.select("topic").distinct()
    pairs = names.select(F.col("topic").alias("a")).join(names.select(F.col("topic").alias("b")), F.col("a") < F.col("b"))  # topics, not texts
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    gain = (p * F.log(p / m) + q * F.log(q / m)) / 2 - (p + q) / 2 * math.log(2)
    shared = share.select(F.col("topic").alias("a"), "word", "p").join(share.select(F.col("topic").alias("b"), "word", F.col("p").alias("q")), "word").where("a < b").groupBy("a", "b").agg(F.sum(gain).alias("gain"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.greatest(F.lit(0.0), math.log(2) + F.coalesce("gain", F.lit(0.0))).alias("divergence"))


def merged_topics(topics: DataFrame, most: float) -> DataFrame:
    """``topic, merged``: topics that diverge by ``most`` or less, directly or through others, take the least of their names."""
    links = divergences(topics).where(F.col("divergence") <= most)
    groups = components(links).select(F.col("node").alias("topic"), F.col("component").alias("merged"))
    return topics.select("topic").distinct().join(groups, "topic", "left").withColumn("merged", F.coalesce("merged", "topic"))
