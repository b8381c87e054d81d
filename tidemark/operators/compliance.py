"""Retention, holds, subjects, moderation and a hash chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired(df: DataFrame, ts: str, as_of: str, days: Column) -> DataFrame:
    """Rows older than their own number of days at ``as_of``."""
    return df.where(F.datediff(F.lit(as_of).cast("date"), F.col(ts)) > days)


def classified(text: Column, levels: list[tuple[str, list[str]]], default: str = "public") -> Column:
    """The first level of which a pattern matches."""
    out = F.when(F.lit(False), default)
    for level, patterns in levels:
        out = out.when(reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns)), level)
    return out.otherwise(default)


def moderation(text: Column, words: list[str]) -> dict[str, Column]:
    """Scores of 0 or 1 for shouting, runs of one character, links and listed words; a text is approved below 0.5 on average."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "shouting": F.when((letters > 20) & (upper * 2 > letters), 1.0).otherwise(0.0),
        "runs": F.when(text.rlike("!{4,}|[?]{4,}|[*]{4,}"), 1.0).otherwise(0.0),
        "links": F.when(F.regexp_count(text, F.lit("https?://")) >= 3, 1.0).otherwise(0.0),
        "words": F.when(F.lower(text).rlike("(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)"), 1.0).otherwise(0.0),
    }


def chained(df: DataFrame, chain: str, order: list[str], payload: Column) -> DataFrame:
    """``chain, seq, hash``: sha256 of the hash before it and the payload, within each chain.

    Rows of a chain follow each other within one partition and pass in batches, with the last hash carried on: time is linear in a chain, memory
    doesn't grow with it. A null payload is empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seq, last = None, 0, ""
        for batch in batches:
            seqs, hashes = [], []
            for key, text in zip(batch["chain"], batch["payload"], strict=True):
                if at is None or key != at:
                    at, seq, last = key, 0, ""
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                seqs.append(seq)
                hashes.append(last)
                seq += 1
            yield pd.DataFrame({chain: batch["chain"], "seq": seqs, "hash": hashes})

    rows = df.select(F.col(chain).alias("chain"), *order, F.coalesce(payload, F.lit("")).alias("payload")).where("chain is not null")
    return rows.repartition("chain").sortWithinPartitions("chain", *order).select("chain", "payload").mapInPandas(run, f"`{chain}` {df.schema[chain].dataType.simpleString()}, seq int, hash string")


def verified(chains: DataFrame, stored: DataFrame, chain: str) -> DataFrame:
    """``chain, intact``: whether every stored hash is the recomputed one."""
    both = chains.join(stored.withColumnRenamed("hash", "stored"), [chain, "seq"], "full")
    return both.groupBy(chain).agg(F.min(F.coalesce(F.col("hash") == F.col("stored"), F.lit(False))).alias("intact"))


def escalations(df: DataFrame, ts: str, as_of: str, levels: list[int]) -> DataFrame:
    """Level of every open alert at ``as_of``: how many of ``levels`` (minutes) it has stayed unanswered."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / 60e6
    return df.withColumn("level", sum(((age >= m).cast("int") for m in levels), F.lit(0)))
