"""Corpus statistics on exploded words; counts combine before any shuffle."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.operators.graph import checkpoints

#: So many words that texts share, or fewer, are sent to the tasks; more are joined by the word.
KNOWN = 1_000_000


def word_rows(df: DataFrame, key: str, words: Column) -> DataFrame:
    """``key, word`` for every word."""
    return df.select(key, F.explode(words).alias("word"))


def frequencies(df: DataFrame, words: Column, per: str) -> DataFrame:
    """``word, n`` and in how many values of ``per`` it occurs."""
    return word_rows(df, per, words).groupBy("word", per).agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_" + per))


def bigrams(df: DataFrame, words: Column) -> DataFrame:
    """``bigram, n`` of adjacent words."""
    w = df.select(words.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - 1)), F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 1)), lambda a, b: F.concat_ws(" ", a, b))
    return w.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def _weighted(df: DataFrame, key: str, words: Column) -> DataFrame:
    """``key, word, w``: tf * (ln((1 + n) / (1 + df)) + 1). Rows come dealt out by ``key``, so what is grouped by it needs no exchange.

    Texts are dealt out by key, not their words. Words in more than one text, up to KNOWN of them, are sent to the tasks with their numbers; more are joined by the word.
    """
    checkpoints(df.sparkSession)
    tf = word_rows(df.repartition(key), key, words).groupBy(key, "word").agg(F.count("*").alias("tf"))
    shared = tf.groupBy("word").agg(F.count("*").alias("df")).where("df > 1").checkpoint()  # any other word is in one text
    total = df.select(key).distinct().agg(F.count("*").alias("n"))
    known = tf.join(F.broadcast(shared) if shared.count() <= KNOWN else shared, "word", "left").crossJoin(F.broadcast(total))  # one row
    return known.select(key, "word", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(1)))) + 1)).alias("w"))


def tfidf(df: DataFrame, key: str, words: Column) -> DataFrame:
    """``key, word, weight``: tf * (ln((1 + n) / (1 + df)) + 1), rows of unit length."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return _weighted(df, key, words).select(key, "word", (F.col("w") / norm).alias("weight"))


def tfidf_totals(df: DataFrame, key: str, words: Column) -> DataFrame:
    """``key, terms, strongest, mass`` of the rows of ``tfidf``: how many, the greatest and the sum, by sums of a key alone."""
    of = _weighted(df, key, words).groupBy(key).agg(F.count("*").alias("terms"), F.max("w").alias("most"), F.sum("w").alias("all"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return of.select(key, "terms", (F.col("most") / F.col("norm")).alias("strongest"), (F.col("all") / F.col("norm")).alias("mass"))


def hashed(words: Column) -> Column:
    """Words as 64-bit hashes, which are shuffled and sent at a fraction of the size."""
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon_sentiment(words: Column, positive: list[str], negative: list[str]) -> Column:
    """(distinct positive - distinct negative) / sqrt(n + 1), within -1 and 1."""
    d = F.array_distinct(words)
    n = lambda lexicon: F.size(F.array_intersect(d, F.array(*map(F.lit, lexicon))))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n(positive) - n(negative)) / F.sqrt(F.size(words) + 1.0)))


def topic_scores(text: Column, topics: dict[str, list[str]]) -> Column:
    """Array of (topic, score) by occurrences, terms of up to five letters at half weight; greatest first, those above 0."""
    low = F.lower(text)
    scores = []
    for topic, terms in topics.items():
        score = sum((X.occurrences(low, t) * (1.0 if len(t) > 5 else 0.5) for t in terms), F.lit(0.0))
        scores.append(F.struct((-score).alias("less"), F.lit(topic).alias("topic")))
    ranked = F.filter(F.array_sort(F.array(*scores)), lambda s: s["less"] < 0)
    return F.transform(ranked, lambda s: F.struct(s["topic"].alias("topic"), (-s["less"]).alias("score")))


def _best_sentences(n: int):
    """Places of the ``n`` sentences whose words (``found``, lists of a text's sentences) are most frequent in the text, with less for late ones; earlier ones win ties."""

    def picked(found: pd.Series) -> pd.Series:
        out = []
        for text in found:
            counts = Counter(w for words in text for w in words)
            total = [sum(counts[w] for w in words) * (10 if i == 0 else 8 if i < 3 else 5) for i, words in enumerate(text)]
            out.append(sorted(sorted(range(len(total)), key=lambda i: -total[i])[:n]))
        return pd.Series(out)

    return F.pandas_udf(picked, "array<int>")


def _own_summaries(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key, summary`` in the row that holds the text, so nothing is exchanged."""
    runs = lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    s = df.select(key, X.sentences(F.trim(F.col(text))).alias("s")).where(F.size("s") > 0)
    places = _best_sentences(n)(F.transform("s", lambda x: F.filter(runs(x), lambda w: w.rlike("^[a-z]{3,}$"))))
    return s.withColumn("at", places).select(key, F.array_join(F.transform("at", lambda i: F.get("s", i)), " ").alias("summary"))


def _shared_summaries(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key, summary`` of rows that may share a key: all their sentences count as one text's."""
    s = df.select(key, F.posexplode(X.sentences(F.trim(F.col(text)))).alias("i", "sentence"))
    w = s.select(key, "i", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).where(F.col("word").rlike("^[a-z]{3,}$"))
    counts = w.groupBy(key, "word").agg(F.count("*").alias("n"))
    total = w.join(counts, [key, "word"]).groupBy(key, "i").agg(F.sum("n").alias("total"))
    less = -F.coalesce("total", F.lit(0)) * F.when(F.col("i") == 0, 10).when(F.col("i") < 3, 8).otherwise(5)
    best = Window.partitionBy(key).orderBy("less", "i")  # ranked before they are gathered
    top = s.join(total, [key, "i"], "left").withColumn("less", less).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))


def summaries(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """``key, summary``: the ``n`` sentences whose words are most frequent in the text, with less for late ones, in their order; earlier ones win ties.

    A text is worked out in its row, which exchanges nothing but keys; only rows whose key is null or repeated are grouped. Texts without a sentence have no row.
    """
    many = df.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_key"))
    if many.isEmpty():
        return _own_summaries(df, key, text, n)
    same = df[key].eqNullSafe(many["_key"])
    return _own_summaries(df.join(many, same, "left_anti"), key, text, n).unionByName(_shared_summaries(df.join(many, same, "left_semi"), key, text, n))
