"""Connected components of links."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that ``spark.checkpoint.dir`` names. Unset, a local master (tests) uses one below the warehouse; on a cluster no folder is known to be shared, so the call fails."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(at or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Rows go to Python workers in batches of about ``size``: a worker and the buffers of its batches share an executor's memory with the heap. For what is written inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table beside the checkpoints and read again, which cuts its lineage."""
    spark = df.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written``, once all that was derived from them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node reachable) of every node that has a link.

    Each round gives every node the least label of its neighbours and then that label's own label, until none changes; paths shrink by half
    a round. Labels are checkpointed, which needs ``spark.checkpoint.dir`` on a cluster.
    """
    checkpoints(links.sparkSession)
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    label = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")).checkpoint()
    while True:
        near = edges.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        new = label.join(near, label["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        own = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = new.join(own, "label").select("node", "old", F.least("label", "further").alias("label")).checkpoint()
        if new.where("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        label = new.select("node", "label")


def paths(links: DataFrame, pairs: DataFrame, depth: int, a: str = "a", b: str = "b") -> DataFrame:
    """``start, end, path``: all paths of at most ``depth`` steps between the given pairs (``start, end``) over links read both ways, none of which meets a node twice.

    A step goes on only where the end can still be reached in the steps that are left, which is worked out backwards first, so no dead end is
    carried along. Pairs of a node with itself, and null nodes, have none; repeated links and pairs are one.
    """
    checkpoints(links.sparkSession)
    g = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    g = g.unionByName(g.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    wanted = pairs.select("start", "end").where("start <> end").distinct()
    far = [wanted.select("end", F.col("end").alias("node")).distinct()]
    for _ in range(depth - 1):
        further = far[-1].join(g, F.col("node") == F.col("u")).select("end", F.col("v").alias("node"))
        far.append(far[-1].unionByName(further).distinct())
    open_, found = wanted.select("start", "end", F.array("start").alias("path")), None
    for left in range(depth - 1, -1, -1):
        step = open_.withColumn("last", F.element_at("path", -1)).join(g, F.col("last") == F.col("u")).where(~F.array_contains("path", F.col("v")))
        near = far[left].select(F.col("end").alias("_end"), F.col("node").alias("_node"))
        step = step.join(near, (F.col("end") == F.col("_end")) & (F.col("v") == F.col("_node")), "left_semi").select("start", "end", F.concat("path", F.array("v")).alias("path")).checkpoint()
        done = step.where(F.element_at("path", -1) == F.col("end"))
        found = done if found is None else found.unionByName(done)
        open_ = step.where(F.element_at("path", -1) != F.col("end"))
    return found
