"""Near-duplicate embeddings through a pivot-permutation index.

Every vector is described by its nearest reference points in order: NEAREST of the fewest pivots,
and MORE_NEAREST more for each doubling of their number, since neighbours share fewer of many pivots.
An inverted list for each (label, pivot) holds the vectors that have the pivot among them; two vectors that
share at least SHARED pivots are candidates, and a candidate pair is verified in double
precision in the list of the least pivot it shares.

Vectors within half the link angle of their nearest pivot (its ball) all link with each
other by the triangle inequality, so those links are counted without comparing. A group of copies, however
large, is one ball. Long lists are dealt out in pairs of blocks, without the pairs
of one ball; tasks return counts and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import components, table, written

LINK, NEAREST, MORE_NEAREST, SHARED, BLOCK = 0.93, 6, 3, 1, 1024
#: Pivots: one for PER_PIVOT vectors, within these bounds; the sample that they come from is as large.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 800, 64, 4096


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(vectors: list) -> list[bytes]:
    """Each vector's components as 4-byte numbers where that loses nothing, else as 8-byte ones."""
    out = []
    for v in vectors:
        x = np.asarray(v, np.float64)
        with np.errstate(over="ignore"):
            short = x.astype("<f4")
        out.append((short if (short == x).all() else x).tobytes())
    return out


def _unpacked(packed: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    return _unit([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8") for b in packed])


def _pivots(vectors: DataFrame, n: int, near: float) -> dict[int, np.ndarray]:
    """Reference points by dimension: at most n, those of least hash, without ones in another's ball."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("dim", "vector").limit(n).collect()
    out = {}
    for dim in {r["dim"] for r in sample}:
        kept: list[np.ndarray] = []
        for v in _unit([r["vector"] for r in sample if r["dim"] == dim]):
            if not kept or (np.array(kept) @ v).max() < near:
                kept.append(v)
        out[dim] = np.array(kept)
    return out


def _described(vectors: DataFrame, pivots: dict[int, np.ndarray], nearest: int, near: float) -> DataFrame:
    """``vec_id, label, dim, packed, near, ball``; a dimension that no pivot has is one list (pivot 0)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x, at = _unit(part["vector"].tolist()), shared.value.get(dim)
                if at is None:
                    order, ball = np.zeros((len(x), 1), int), np.full(len(x), -1)
                else:
                    cos = x @ at.T
                    order = np.argsort(-cos, axis=1, kind="stable")[:, :nearest]
                    ball = np.where(np.take_along_axis(cos, order[:, :1], 1)[:, 0] >= near, order[:, 0], -1)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "packed": _packed(part["vector"]), "near": [*order.astype("int32")], "ball": ball})

    return vectors.mapInPandas(run, "vec_id long, label string, dim int, packed binary, near array<int>, ball int")


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes over the links i-j."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _compare(link: float, shared: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, x_side, y_side = key[2], rows[rows["side"] == 0], rows[rows["side"] == 1]
        same = not len(y_side) and key[3] == key[4]
        if same:
            y_side = x_side
        if not len(x_side) or not len(y_side):
            return pd.DataFrame({"vec_id": [], "n": [], "to": []}).astype("int64")
        seen = np.unique(np.concatenate([*x_side["near"], *y_side["near"]]))
        x, y = (_unpacked(s["packed"], key[1]) for s in (x_side, y_side))
        has = [np.zeros((len(s), len(seen)), np.float32) for s in (x_side, y_side)]
        for h, s in zip(has, (x_side, y_side), strict=True):
            for r, near in enumerate(s["near"]):
                h[r, np.searchsorted(seen, near)] = 1
        low = seen < pivot
        need = min(shared, max(len(v) for v in x_side["near"]))  # as many pivots as there are, at most
        ball_x, ball_y = x_side["ball"].to_numpy(), y_side["ball"].to_numpy()
        linked = (x @ y.T >= link) & (has[0] @ has[1].T >= need) & (has[0][:, low] @ has[1][:, low].T == 0)
        linked &= ~((ball_x[:, None] == ball_y[None, :]) & (ball_x[:, None] >= 0))
        ids = x_side["vec_id"].to_numpy(), y_side["vec_id"].to_numpy()
        if same:
            np.fill_diagonal(linked, False)
            all_ids, counts = ids[0], linked.sum(1)
            i, j = np.nonzero(np.triu(linked))
        else:
            all_ids, counts = np.concatenate(ids), np.concatenate([linked.sum(1), linked.sum(0)])
            i, j = np.nonzero(linked)
            j = j + len(ids[0])
        to = all_ids[_spanning(len(all_ids), i, j)]
        return pd.DataFrame({"vec_id": all_ids, "n": counts, "to": to})[counts > 0].astype("int64")

    return run


def near_duplicates(embeddings: DataFrame, link: float = LINK, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of embeddings (``vec_id, embedding, label``; other columns aren't read).

    Vectors link when their labels and dimensions are equal, the label isn't null and their cosine is ``link`` or more. Null or empty vectors, zero
    vectors and ones with null or non-finite components link with nothing. Rows that repeat an id are one vector (the greatest);
    a null id has no links and isn't kept. ``nearest`` holds for LEAST_PIVOTS pivots.
    """
    spark = embeddings.sparkSession
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").cast("string").alias("label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    valid = valid.groupBy("vec_id").agg(F.max(F.struct("vector", "label")).alias("v")).select("vec_id", "v.*", F.size("v.vector").alias("dim"))
    near = math.sqrt((1 + link) / 2) + 1e-9
    n_pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, rows.count() // PER_PIVOT))
    nearest += math.ceil(MORE_NEAREST * math.log2(n_pivots / LEAST_PIVOTS))
    described = written(_described(valid, _pivots(valid, n_pivots, near), nearest, near))

    # links within a ball: all pairs of its members
    ball = ["label", "dim", "ball"]
    balls = written(described.where("ball >= 0").groupBy(*ball).agg(F.count("*").alias("n_ball"), F.min("vec_id").alias("first")))
    in_ball = described.where("ball >= 0").select("vec_id", *ball).join(balls, ball).select("vec_id", (F.col("n_ball") - 1).alias("n"), F.col("first").alias("to"))

    # other links: lists, cut in blocks; a ball with many members in a list has blocks of its own
    posts = described.withColumn("pivot", F.explode("near"))
    one = ["label", "dim", "pivot"]
    cells = posts.groupBy(*one, "ball").count().withColumn("cell", F.when((F.col("ball") >= 0) & (F.col("count") > BLOCK), F.col("ball")).otherwise(-1))
    cells = cells.groupBy(*one, "cell").agg(F.sum("count").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    cells = written(cells)
    other = cells.select(*one, F.col("cell").alias("cell_y"), F.col("blocks").alias("blocks_y"))
    pairs = cells.join(other, one).where("cell < cell_y or (cell = cell_y and cell = -1)")
    pairs = pairs.select(*one, "cell", "cell_y", F.col("blocks"), F.col("blocks_y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    pairs = pairs.select(*one, "cell", "cell_y", "blocks", "blocks_y", "x", F.explode(F.sequence(F.lit(0), F.col("blocks_y") - 1)).alias("y")).where("cell < cell_y or x <= y")
    part = lambda c, k: F.concat_ws(":", c, k)
    pairs = pairs.withColumns({"from": part("cell", "x"), "with": part("cell_y", "y")})
    sides = pairs.select(*one, "from", "with", F.col("cell").alias("cell"), F.col("x").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.where(F.col("from") != F.col("with")).select(*one, "from", "with", F.col("cell_y").alias("cell"), F.col("y").alias("block"), F.lit(1).alias("side"))
    )
    large = cells.where("cell >= 0").select(*one, F.col("cell").alias("ball"), F.lit(True).alias("large"))
    placed = posts.join(written(large), [*one, "ball"], "left").withColumn("cell", F.when(F.col("large"), F.col("ball")).otherwise(-1)).drop("large")
    counts = cells.select(*one, "cell", "blocks")
    placed = written(placed.join(counts, [*one, "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks"))
    compared = placed.join(written(sides), [*one, "cell", "block"]).groupBy(*one, "from", "with").applyInPandas(_compare(link, shared), "vec_id long, n long, to long")

    found = written(in_ball.unionByName(compared))
    classes = components(found.select(F.col("vec_id").alias("src"), F.col("to").alias("dst")))
    degree = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    known = written(degree.join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left"))
    out = rows.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings``.

    Vectors that are null, empty, zero, or hold null or non-finite entries, those without a label, and rows without an id link with nothing. Rows that repeat an id and a vector are
    copies of one node; equal vectors of different ids link. Other columns aren't read; an empty table gives none.
    """
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1), c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
