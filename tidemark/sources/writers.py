"""Sinks. Each is a write of Spark's own; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, times as ISO text."""
    cells = []
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct")):
            cells.append(F.to_json(name).alias(name))
        elif kind.startswith("timestamp"):
            cells.append(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name))
        else:
            cells.append(F.col(name))
    return df.select(*cells)


def to_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, *order) -> DataFrame:
    """``line`` of a listing, in order."""
    ranked = df.orderBy(*order)
    return ranked.select(F.concat(F.lit("- **"), F.coalesce(F.col(title), F.lit("untitled")), F.lit("**")).alias("line"))


def append_new(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't there yet, once each: the first write wins."""
    return df.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def archive_before(df: DataFrame, ts: str, cutoff: str, path: str) -> DataFrame:
    """Writes rows older than ``cutoff`` to ``path``, partitioned by day, and returns the rest."""
    old = F.col(ts) < F.lit(cutoff).cast("timestamp")
    df.where(old).withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").json(path)
    return df.where(~old | F.col(ts).isNull())
