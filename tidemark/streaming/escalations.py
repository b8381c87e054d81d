"""The life of alerts, as a batch and as a stream: created, escalated while nobody reacts, acknowledged, resolved.

Events are ``alert_id, ts, kind, severity, actor``: kind is created, acknowledged or resolved. Rules are a table ``severity, level, after``: an alert of that severity rises
to the level ``after`` seconds after its creation unless it was acknowledged or resolved before. Both forms give the same log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "alert_id {id}, ts timestamp, action string, level int, actor string"
#: Times in microseconds: created, acknowledged, resolved; who did the latter two; the severity; the level and time that the log has reached.
STATE = "created long, acknowledged long, resolved long, acknowledger string, resolver string, severity string, level int, told long"


def log(events: DataFrame, rules: DataFrame) -> DataFrame:
    """``alert_id, ts, action, level, actor``: one row for each step of each alert's life; level is the one that holds then.

    The first creation of an id counts, and the first acknowledgement and resolution from then on; an acknowledgement after the resolution doesn't. At the very time of a
    reaction an alert no longer rises. Of events of one kind and time the least severity or actor is taken. Events of ids that were never created, and with null ids or times, give nothing.
    """
    e = events.where("alert_id is not null and ts is not null")
    e = e.select("alert_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "severity", "actor")
    made = e.where("kind = 'created'").groupBy("alert_id").agg(F.min(F.struct("ts", "severity")).alias("c")).select("alert_id", F.col("c.ts").alias("created"), F.col("c.severity").alias("severity"))
    after = e.where("kind in ('acknowledged', 'resolved')").join(made, "alert_id").where("ts >= created")
    one = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("ts", "actor"))).alias(kind)
    reacted = after.groupBy("alert_id").agg(one("acknowledged"), one("resolved"))
    life = made.join(reacted, "alert_id", "left").withColumn("acknowledged", F.when(F.col("resolved").isNull() | (F.col("acknowledged.ts") <= F.col("resolved.ts")), F.col("acknowledged")))
    life = life.withColumn("stop", F.least("acknowledged.ts", "resolved.ts"))
    rises = life.join(rules.select("severity", "level", "after"), "severity").withColumn("at", F.timestamp_micros(F.unix_micros("created") + (F.col("after") * 1_000_000).cast("long")))
    rises = rises.where("stop is null or at < stop").select("alert_id", F.col("at").alias("ts"), F.lit("escalated").alias("action"), F.col("level").cast("int").alias("level"), F.lit(None).cast("string").alias("actor"))
    top = rises.groupBy("alert_id").agg(F.max("level").alias("top"))
    life = life.join(top, "alert_id", "left").withColumn("top", F.coalesce("top", F.lit(0)))
    steps = F.array(
        F.struct(F.col("created").alias("ts"), F.lit("created").alias("action"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("actor")),
        F.struct(F.col("acknowledged.ts").alias("ts"), F.lit("acknowledged").alias("action"), F.col("top").alias("level"), F.col("acknowledged.actor").alias("actor")),
        F.struct(F.col("resolved.ts").alias("ts"), F.lit("resolved").alias("action"), F.col("top").alias("level"), F.col("resolved.actor").alias("actor")),
    )
    return life.select("alert_id", F.explode(steps).alias("s")).select("alert_id", "s.*").where("ts is not null").unionByName(rises)


def stream_log(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The same log of a stream with a watermark on ``ts``: a step is told once the watermark has passed it, so nothing that may still come can undo it.

    Rules are read once when the stream starts (severities times levels, a small table). State is one row for each alert that isn't resolved; it ends with the resolution. An alert
    whose id is used again after its resolution has passed begins anew.
    """
    waits: dict[str, list[tuple[int, int]]] = {}
    for r in rules.select("severity", "level", "after").collect():
        waits.setdefault(r["severity"], []).append((int(r["after"] * 1_000_000), r["level"]))
    key_type = dict(events.dtypes)["alert_id"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ("created", "acknowledged", "resolved", "acknowledger", "resolver", "severity", "level", "told")
        now = dict(zip(names, state.get, strict=True)) if state.exists else dict.fromkeys(names)
        for batch in batches:
            for ts, kind, severity, actor in zip(batch["micros"], batch["kind"], batch["severity"], batch["actor"], strict=True):
                ts = int(ts)
                if kind == "created" and (now["created"] is None or (ts, severity) < (now["created"], now["severity"])):
                    now["created"], now["severity"] = ts, severity
                elif kind in ("acknowledged", "resolved"):
                    who = "acknowledger" if kind == "acknowledged" else "resolver"
                    if now[kind] is None or (ts, actor) < (now[kind], now[who]):
                        now[kind], now[who] = ts, actor
        passed = state.getCurrentWatermarkMs() * 1000
        created, told = now["created"], -1 if now["told"] is None else now["told"]
        rows, pending = [], []
        if created is not None:
            ack = now["acknowledged"] if now["acknowledged"] is not None and created <= now["acknowledged"] <= (now["resolved"] if now["resolved"] is not None else now["acknowledged"]) else None
            end = now["resolved"] if now["resolved"] is not None and now["resolved"] >= created else None
            stop = min((t for t in (ack, end) if t is not None), default=None)
            due = [(created + after, 1, "escalated", level, None) for after, level in waits.get(now["severity"], []) if stop is None or created + after < stop]
            due += [(created, 0, "created", 0, None)] + [(t, k, a, None, who) for t, k, a, who in ((ack, 2, "acknowledged", now["acknowledger"]), (end, 3, "resolved", now["resolver"])) if t is not None]
            level = now["level"] or 0
            for t, _, action, to, who in sorted(due, key=lambda d: d[:2]):
                if t >= passed:
                    pending.append(t)
                elif t > told:
                    level = max(level, to or 0)
                    rows.append((key[0], pd.Timestamp(t, unit="us", tz="UTC"), action, level if to is None else to, who))
            now["level"] = level
        if created is not None and passed > 0:
            now["told"] = max(told, passed - 1)
        if created is not None and now["resolved"] is not None and now["resolved"] >= created and not pending:
            state.remove()
        else:
            state.update(tuple(now[n] for n in names))
            if pending:
                state.setTimeoutTimestamp(max(min(pending) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["alert_id", "ts", "action", "level", "actor"])

    keyed = events.where("alert_id is not null and ts is not null").withColumn("micros", F.unix_micros("ts"))
    return keyed.groupBy("alert_id").applyInPandasWithState(step, LOG.format(id=key_type), STATE, "append", GroupStateTimeout.EventTimeTimeout)
