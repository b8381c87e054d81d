"""Streams over activity files: windows with watermarks, sessions, duplicates, alerts, escalation state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, late: str = "1 hour", files_per_trigger: int = 1) -> DataFrame:
    """Activity as a stream; ``ts`` is cast, since a watermark needs an instant."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def daily_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def request_rate(df: DataFrame) -> DataFrame:
    """Requests of a user in sliding minutes."""
    return df.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def distinct_events(df: DataFrame) -> DataFrame:
    """Each event once, with state bounded by the watermark."""
    return df.dropDuplicatesWithinWatermark(["event_id"])


def alerts(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Events against a static table of rules (rule_id, event_type, least)."""
    return df.join(rules, "event_type").where("value >= least").select("rule_id", "event_id", "user_id", "ts", "value")


def escalation_levels(df: DataFrame, every: int = 3, most: int = 4) -> DataFrame:
    """``user_id, n, level``: a user's level rises by one with every ``every`` errors, up to ``most``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "level": [min(most, n // every)]})

    errors = df.where("event_type = 'error'")
    return errors.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, level int", "n long", "update", GroupStateTimeout.NoTimeout)


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Everything there is now, into a memory table (tests) of that name."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
