"""Helpers shared by the training-data operators: tables, lineage cuts, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One crc32 remainder is held out of all label learning.
HELD_OUT_REMAINDER = 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of texts that a Python worker gets at once, as a setting of Spark: workers share an executor's memory with its heap.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; of texts, its rows are dealt out to all cores where it has fewer partitions (a file of one row group is one)."""
    shared_dir(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Python workers get smaller batches from here on, unless the session has chosen. Where the folder is unset a local master (tests) gets a folder of its own below the warehouse; on a cluster
    there is no folder that is known to be shared, so the call fails.
    """
    if spark.conf.get(BATCH_SETTING) == "67108864b":  # Spark's own default, and no choice of the session's
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written``, once all that was derived from them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of each written table once that is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT_REMAINDER, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; the plain function does so where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled ids that aren't held out, one text for each.

    The ids with the smallest hashes are taken; an id with two labels has the greater, one with several texts the least of them (null last). The
    picked labels are at most ``bound`` rows of two numbers (``bound`` is a parameter of the fit), so they are broadcast and
    only the picked texts are shuffled. Rows with a null id or another label than 0 or 1 aren't picked.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def of_least_hash(rows: DataFrame, n: int) -> DataFrame:
    """The rows whose hash (column ``at``) is among the ``n`` least, one for each hash (the least); only hashes meet in one task, ``n`` of each other at most."""
    last = rows.select("at").orderBy("at").limit(n).agg(F.max("at")).first()[0]
    rest = [c for c in rows.columns if c != "at"]
    return rows.where(F.col("at") <= F.lit(last)).groupBy("at").agg(F.min(F.struct(*rest)).alias("r")).select("at", "r.*")


def commonest(counts: DataFrame, key: str, most: int) -> np.ndarray:
    """The values of ``key``, sorted, whose count ``n`` (above 1) is greatest: about ``most`` of them at most, in the last eighth of a power of two those of least hash.

    How far down that reaches is found from how many keys have counts of each eighth of a power of two (a few hundred numbers), so no more than the result meets on the driver.
    """
    counts = written(counts.where("n > 1"))
    level = F.floor(F.log2("n") * 8 + 1e-9).cast("int")
    found, picked = 0, F.lit(False)
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        room = most - found
        if r["count"] > room:  # a share of this level, a hundredth below what there is room for
            picked = picked | ((level == r["level"]) & (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(room / r["count"] * 990_000)))
            break
        found += r["count"]
        picked = picked | (level == r["level"])
    keys = counts.where(picked).select(key).toPandas()[key].to_numpy(np.int64)
    discard(counts)
    return np.sort(keys)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links`` (src, dst: long).

    Alternating large-star and small-star rounds until nothing changes; each is two aggregations with
    partial sums and a join that Spark may split where a node has many links.
    The links are written to the shared folder after every round, and the round before is deleted; rounds grow
    with the logarithm of the longest path. Repeated links, links both ways and links of a node with itself are one or none.
    """
    edges = written(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
            out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct())
            discard(edges)
            return out
        before = state
        # large star: greater neighbours of u to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours to the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        after = written(small.where("u <> v").distinct())
        discard(edges, low, large, least)
        edges = after
