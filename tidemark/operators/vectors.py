"""Nearest neighbours of a stated set of queries, and clusters by centroid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.vectors import cosine, dot

#: Vectors in a block, queries whose scores with a block are held at once, and queries that are sent to the tasks.
BLOCK, TILE, KNOWN = 4096, 32, 32_768


def _packed(df: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    """Blocks of BLOCK vectors at most, of one length each: ``<name>_d, <name>_ids`` (ascending) and ``<name>_x``, their components as bytes. Vectors that are null or hold a null have length 0."""

    def pack(frames):
        for rows in frames:
            rows["d"] = [0 if v is None else len(v) for v in rows["v"]]
            for d, part in rows.sort_values("id").groupby("d"):
                for at in range(0, len(part), BLOCK):
                    some = part.iloc[at : at + BLOCK]
                    x = np.stack(some["v"].to_numpy()) if d else np.zeros((len(some), 0))
                    yield pd.DataFrame({f"{name}_d": [d], f"{name}_ids": [some["id"].to_numpy()], f"{name}_x": [x.astype(float).tobytes()]})

    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.when(F.forall(v, lambda x: x.isNotNull()), v).alias("v"))
    return rows.mapInPandas(pack, f"{name}_d int, {name}_ids array<{rows.schema['id'].dataType.simpleString()}>, {name}_x binary")


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of every column of ``x`` with every one of ``y`` (components x vectors), summed component by component as ``functions.vectors.dot`` does, so equal vectors tie."""
    out, part = np.zeros((x.shape[1], y.shape[1])), np.empty((x.shape[1], y.shape[1]))
    for a, b in zip(x, y, strict=True):
        out += np.multiply(a[:, None], b[None, :], out=part)
    return out


def _length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for a in x:
        out += a * a
    return np.sqrt(out)


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """``query, id, score, rank``: the k nearest of ``base`` to every query by cosine, without the query itself.

    The stated queries meet all rows, block against block of BLOCK vectors, in double precision; up to KNOWN queries are sent to the tasks. Of each pair of blocks the k best of every query go on.
    Equal scores rank by id; a score is null, and last, where a vector has no length or lengths differ.
    """

    def best(frames):
        for rows in frames:
            for qd, qi, qx, bd, bi, bx in zip(*(rows[c] for c in ("q_d", "q_ids", "q_x", "b_d", "b_ids", "b_x")), strict=True):
                qi, bi = np.asarray(qi), np.asarray(bi)
                q, b = np.frombuffer(qx).reshape(len(qi), qd).T.copy(), np.frombuffer(bx).reshape(len(bi), bd).T.copy()
                long_b, found = _length(b), []
                for at in range(0, len(qi), TILE):
                    some = q[:, at : at + TILE]
                    with np.errstate(all="ignore"):
                        size = _length(some)[:, None] * long_b[None, :]
                        score = _folded(some, b) / size if qd == bd else np.zeros(size.shape)
                    none = (size == 0) | (qd != bd)
                    key = np.where(none, np.inf, np.where(np.isnan(score), -np.inf, -score))
                    key[qi[at : at + TILE][:, None] == bi[None, :]] = np.nan  # itself; behind all others
                    limits = np.partition(key, k - 1, axis=1)[:, k - 1] if k < len(bi) else np.full(len(key), np.inf)
                    for r, limit in enumerate(limits):
                        near = np.flatnonzero(key[r] <= (np.inf if np.isnan(limit) else limit))
                        near = near[np.argsort(key[r, near], kind="stable")][:k]
                        found.append(pd.DataFrame({"query": qi[at + r], "id": bi[near], "s": score[r, near], "none": none[r, near]}))
                yield pd.concat(found)

    n = queries.count()
    asked = _packed(queries.repartition(n // BLOCK + 1), id_col, vector, "q")
    asked = F.broadcast(asked) if n <= KNOWN else asked.repartition(n // BLOCK + 1)  # beyond, block files of a shuffle are read by each task
    pairs = _packed(base, id_col, vector, "b").repartition(base.sparkSession.sparkContext.defaultParallelism * 4).crossJoin(asked)  # blocks, not rows
    kind = base.schema[id_col].dataType.simpleString()
    scores = pairs.mapInPandas(best, f"query {kind}, id {kind}, s double, none boolean")
    score = F.when(~F.col("none"), F.coalesce("s", F.lit(float("nan"))))  # NaN comes back from Python as null
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")  # a rank limit is pushed below the exchange
    return scores.select("query", "id", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mmr(candidates: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """``query, id, rank`` by maximal marginal relevance; candidates: ``query, id, score, v``, a short list for each query."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        x = np.stack(rows["v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        score, like = rows["score"].to_numpy(), np.zeros(len(rows))
        chosen: list[int] = []
        while len(chosen) < min(k, len(rows)):
            value = trade * score - (1 - trade) * like
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
            like = np.maximum(like, x @ x[chosen[-1]])
        return pd.DataFrame({"query": rows["query"].iloc[chosen], "id": rows["id"].iloc[chosen], "rank": range(1, len(chosen) + 1)})

    return candidates.groupBy("query").applyInPandas(pick, "query long, id long, rank int")


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, centroid, n``: the mean of every component."""
    means = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(label).agg(F.transform(ordered, lambda p: p["m"]).alias("centroid"), F.max("n").alias("n"))


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))


def assigned(df: DataFrame, id_col: str, vector: str, centres: DataFrame, label: str) -> DataFrame:
    """``id, nearest, distance``: the centre of least cosine distance, the least label where they tie. centres: ``label, centroid``, one row a cluster."""
    known = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid").alias("c")))).alias("centres"))  # clusters x components
    each = F.transform("centres", lambda z: F.struct((1 - cosine(F.col(vector), z["c"])).alias("d"), z["label"].alias("label")))
    return df.select(id_col, vector).crossJoin(F.broadcast(known)).select(id_col, F.array_min(each).alias("m")).select(id_col, F.col("m.label").alias("nearest"), F.col("m.d").alias("distance"))


def silhouettes(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``id, label, silhouette`` by mean cosine distances, in linear time: a mean over a cluster is a product with its sum of unit vectors.

    Points alone in their cluster, and all points of a single cluster, have none.
    """
    u = df.select(F.col(id_col), F.col(label).alias("label"), _unit(F.col(vector)).alias("e"))
    parts = u.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("s"), F.max("n").alias("n"))
    known = sums.agg(F.collect_list(F.struct("label", "s", "n")).alias("all"))  # clusters x components
    own = F.filter("all", lambda z: z["label"] == F.col("label"))[0]
    other = F.array_min(F.transform(F.filter("all", lambda z: z["label"] != F.col("label")), lambda z: 1 - dot(F.col("e"), z["s"]) / z["n"]))
    out = u.crossJoin(F.broadcast(known)).withColumns({"o": own, "b": other}).where("o.n > 1 and b is not null")
    out = out.withColumn("a", 1 - (dot(F.col("e"), F.col("o.s")) - 1) / (F.col("o.n") - 1))
    score = F.when(F.col("a") < F.col("b"), 1 - F.col("a") / F.col("b")).when(F.col("a") > F.col("b"), F.col("b") / F.col("a") - 1).otherwise(0.0)
    return out.select(id_col, F.col("label").alias(label), score.alias("silhouette"))
