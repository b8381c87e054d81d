"""The life of alerts: a hand-made log, and the stream against the batch, in pieces, out of order and over a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import escalations

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "alert_id long, ts timestamp, kind string, severity string, actor string"
RULES = [("critical", 1, 0.0), ("critical", 2, 300.0), ("critical", 3, 900.0), ("low", 1, 3600.0)]


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def told(rows):
    return sorted((r["alert_id"], r["ts"], r["action"], r["level"], r["actor"] or "") for r in rows)


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "severity string, level int, after double")


def test_log(spark, rules):
    rows = [
        (1, at(0), "created", "critical", None), (1, at(400), "acknowledged", None, "ann"), (1, at(390), "acknowledged", None, "bob"), (1, at(5000), "resolved", None, "ann"),
        (2, at(0), "created", "low", None), (2, at(3600), "resolved", None, "eve"), (2, at(4000), "acknowledged", None, "late"), (2, at(100), "created", "critical", None),
        (3, at(9), "acknowledged", None, "x"), (4, at(0), "created", "other", None), (None, at(0), "created", "low", None), (5, None, "created", "low", None), (6, at(5), "created", "low", None), (6, at(1), "resolved", None, "early"),
    ]
    got = told(escalations.log(spark.createDataFrame(rows, SCHEMA), rules).collect())
    assert got == sorted([
        (1, at(0), "created", 0, ""), (1, at(0), "escalated", 1, ""), (1, at(300), "escalated", 2, ""), (1, at(390), "acknowledged", 2, "bob"), (1, at(5000), "resolved", 2, "ann"),
        (2, at(0), "created", 0, ""), (2, at(3600), "resolved", 0, "eve"), (4, at(0), "created", 0, ""), (6, at(5), "created", 0, ""), (6, at(3605), "escalated", 1, ""),
    ])
    assert escalations.log(spark.createDataFrame([], SCHEMA), rules).count() == 0


def test_stream_equals_batch_over_a_restart(spark, rules, tmp_path):
    rng = random.Random(7)
    rows = []
    for k in range(40):
        t = rng.randrange(0, 20_000)
        rows.append((k, at(t), "created", rng.choice(["critical", "low", "other"]), None))
        if rng.random() < 0.6:
            rows.append((k, at(t + rng.randrange(0, 2000)), "acknowledged", None, rng.choice(["ann", "bob"])))
        if rng.random() < 0.6:
            rows.append((k, at(t + rng.randrange(0, 5000)), "resolved", None, "eve"))
    rows.sort(key=lambda r: r[1] + datetime.timedelta(seconds=rng.randrange(0, 500)))  # out of order by less than the watermark
    pieces = [rows[k : k + 12] for k in range(0, len(rows), 12)] + [[(9999, at(200_000), "acknowledged", None, "clock")], [(9999, at(200_001), "acknowledged", None, "clock")]]
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "20 minutes")
        escalations.stream_log(stream, rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    half = len(pieces) // 2
    for part in (pieces[:half], pieces[half:]):
        for piece in part:
            spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    run()  # nothing new: nothing is told twice
    expect = escalations.log(spark.createDataFrame(rows, SCHEMA), rules).where(F.col("ts") < at(190_000))
    assert told(spark.read.parquet(out).collect()) == told(expect.collect())
