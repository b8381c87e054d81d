"""A vector index of inverted centroid lists: probe the nearest lists, rank by exact cosine, and with ``exact`` probe every list that could still hold a nearer vector."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.vectors import dot

#: Lists: about the root of the number of vectors, within these bounds. Centres are learned from PER_LIST vectors for each list at most (by the hash of the id), in ROUNDS rounds.
LEAST_LISTS, MOST_LISTS, PER_LIST, ROUNDS = 8, 4096, 32, 8
#: Lists are dealt out in parts of about PART vectors, so that a list of many copies is many tasks.
PART = 4096
#: Probes are as many lists as hold RECALL of the NEAREST neighbours of JUDGED sampled vectors within the sample, which is sparser than the table.
RECALL, NEAREST, JUDGED = 0.93, 10, 256


@dataclass
class Index:
    """``rows``: ``id, unit, list, angle`` of every usable vector; the lists' centres; and how many lists a query looks into."""

    rows: DataFrame
    centres: np.ndarray
    probes: int


def _usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, unit``: vectors of length 1; those that are null, empty, zero, or hold null or non-finite entries are left out."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & good).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).where("norm > 0 and norm < double('Infinity')")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _learned(units: DataFrame, lists: int | None) -> tuple[np.ndarray, int]:
    """Centres of the lists by spherical k-means on the bounded sample, and the number of probes."""
    if lists is None:
        lists = int(min(MOST_LISTS, max(LEAST_LISTS, 2 ** round(np.log2(max(1, units.count()) ** 0.5)))))
    rows = units.orderBy(F.xxhash64("id"), "id").limit(PER_LIST * lists).select("unit").toPandas()["unit"]
    if not len(rows):
        return np.zeros((0, 0)), 1
    size = pd.Series([len(v) for v in rows]).mode().max()
    x = np.stack([v for v in rows if len(v) == size])
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(lists, len(c))).astype(int)]
    for _ in range(ROUNDS):
        at = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, len(x) // 8192 + 1)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    at = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, len(x) // 8192 + 1)])
    judged = x[:JUDGED]
    like = judged @ x.T
    like[np.arange(len(judged)), np.arange(len(judged))] = -2
    near = np.argpartition(-like, min(NEAREST, len(x) - 1), axis=1)[:, :NEAREST]
    place = np.argsort(np.argsort(-(judged @ c.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, at[near], axis=1).ravel()
    return c, int(np.quantile(needed, RECALL, method="higher")) + 1


def build(df: DataFrame, id_col: str, vector: str, lists: int | None = None) -> Index:
    """Every usable vector with its nearest list and its angle to that centre.

    Vectors of another length than the centres are left out. The centres are MOST_LISTS vectors at most, so tasks get them whole.
    """
    units = _usable(df, id_col, vector)
    c, probes = _learned(units, lists)
    shared = df.sparkSession.sparkContext.broadcast(c)
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[len(v) == shared.value.shape[1] for v in batch["unit"]]]
            if len(batch):
                like = np.stack(batch["unit"].to_numpy()) @ shared.value.T
                at = like.argmax(axis=1)
                yield batch.assign(list=at, angle=np.arccos(np.clip(like[np.arange(len(at)), at], -1, 1)))

    return Index(units.mapInPandas(run, f"id {id_type}, unit array<double>, list int, angle double"), c, probes)


def search(queries: DataFrame, id_col: str, vector: str, index: Index, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """``query, id, score, rank``: the ``k`` nearest indexed vectors of each query by cosine, without the query itself; ties (to nine decimals) by id.

    A part of a list (PART vectors at most, or about so many) meets a part of the queries as a product of two matrices, of which the ``k`` best of each query are kept. Each query looks into its ``probes`` nearest lists (the index's own number by default). exact: it looks, once more, into each list whose best possible cosine (the angle to the centre less the
    list's radius) isn't below its k-th best so far, so no nearer vector is missed. Queries that aren't usable find nothing.
    """
    c, probes = index.centres, index.probes if probes is None else probes
    sizes = index.rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    known = {r["list"]: (-(-r["n"] // PART), r["radius"]) for r in sizes.collect()}  # a row for each list
    shared = queries.sparkSession.sparkContext.broadcast((c, known))
    id_type = dict(queries.dtypes)[id_col]
    parts = F.create_map(*(F.lit(x) for i, (n, _) in known.items() for x in (i, n))) if known else F.create_map(F.lit(-1), F.lit(1))
    base = index.rows.select(F.col("list"), F.pmod(F.xxhash64("id"), parts[F.col("list")]).cast("int").alias("part"), "id", "unit")
    blocks = max(1, -(-queries.count() // PART))
    base = base.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = _usable(queries, id_col, vector).select(F.col("id").alias("query"), F.col("unit").alias("q"))

    def routed(rows: DataFrame, choose) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c, known = shared.value
            for batch in batches:
                batch = batch[[len(v) == c.shape[1] for v in batch["q"]]]
                if len(batch):
                    like = np.clip(np.stack(batch["q"].to_numpy()) @ c.T, -1, 1)
                    picked = choose(like, batch, known)
                    out = [(query, v, i, p) for query, v, to in zip(batch["query"], batch["q"], picked, strict=True) for i in to if i in known for p in range(known[i][0])]
                    yield pd.DataFrame(out, columns=["query", "q", "list", "part"])

        return rows.mapInPandas(run, f"query {id_type}, q array<double>, list int, part int")

    def ranked(pairs: DataFrame) -> DataFrame:
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")  # a rank limit is pushed below the exchange
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], b["id"].to_numpy()
        vectors = np.stack(b["unit"].to_numpy()) if len(b) else None
        for at in range(0, len(q) if len(b) else 0, 256):
            some = q.iloc[at : at + 256]
            like = np.round(np.stack(some["q"].to_numpy()) @ vectors.T, 9)
            for query, s in zip(some["query"], like, strict=True):
                s[ids == query] = -np.inf
                good = np.flatnonzero(s >= (np.partition(s, -k)[-k] if len(s) > k else -2))
                best = good[np.lexsort((ids[good], -s[good]))[:k]]
                out += [(query, ids[i], s[i]) for i in best]
        return pd.DataFrame(out, columns=["query", "id", "score"])

    def met(to: DataFrame) -> DataFrame:
        dealt = to.withColumn("asked", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).groupBy("list", "part", "asked")
        return dealt.cogroup(base.groupBy("list", "part", "asked")).applyInPandas(meet, f"query {id_type}, id {dict(index.rows.dtypes)['id']}, score double")

    def nearest(like: np.ndarray, batch: pd.DataFrame, known: dict) -> list:
        return np.argsort(-like, axis=1, kind="stable")[:, :probes].tolist()

    def missed(like: np.ndarray, batch: pd.DataFrame, known: dict) -> list:
        order = np.argsort(-like, axis=1, kind="stable")
        radius = np.array([known[i][1] if i in known else -np.inf for i in range(like.shape[1])])
        best = np.where(np.arccos(like) <= radius, 1.0, np.cos(np.maximum(np.arccos(like) - radius, 0.0)))
        could = best >= batch["kth"].to_numpy()[:, None] - 1e-9
        np.put_along_axis(could, order[:, :probes], False, axis=1)
        return [np.flatnonzero(row).tolist() for row in could]

    first = ranked(met(routed(asked, nearest)))
    if not exact:
        return first
    kth = first.groupBy("query").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    rest = asked.join(kth, "query", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    return ranked(first.drop("rank").unionByName(met(routed(rest, missed))))
