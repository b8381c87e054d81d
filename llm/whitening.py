"""Whitening of embeddings: covariance by one aggregation of generated column expressions, decomposed with LAPACK.

1. Vectors become whole numbers ``x``; each different one is in the fit list once.
2. One aggregation sums each dimension, a second sums the centred products of every pair of dimensions of the upper triangle.
3. The covariance, a square of the dimension, is assembled on the driver and decomposed (``numpy.linalg.eigh``).
4. Every vector is projected in batches, and a last aggregation of the same kind over the fit list measures how far the whitened covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import discard, table, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries of 2 to the LARGEST or more count as non-finite: their ``x`` has no exact double.
LARGEST = 46
#: Components whose eigenvalue is below RANK times the trace have no length to divide by.
RANK = 1e-12


def _whole(vector: str) -> Column:
    """``x`` of a vector, or null where the vector is null or holds a null or non-finite entry."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**LARGEST)))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return F.when(F.col(vector).isNotNull() & good, x)


def _upper(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def _moments(rows: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """The sums of products of all pairs of columns by ``n``, from one aggregation over the upper triangle."""
    pairs = _upper(len(columns))
    found = rows.selectExpr(*(f"sum({columns[i]} * {columns[j]}) AS s{i}_{j}" for i, j in pairs)).first()
    out = np.zeros((len(columns),) * 2)
    for (i, j), value in zip(pairs, found, strict=True):
        out[i, j] = out[j, i] = value / n
    return out


def _centred(sums: list[int], n: int) -> list[Column]:
    """``x - S / n`` of each dimension: the whole part by whole numbers, then the rest."""
    return [F.expr(f"CAST(x[{i}] - {s // n}L AS DOUBLE) - {(s % n) / n!r}D").alias(f"y{i}") for i, s in enumerate(sums)]


def _projection(sums: list[int], n: int, weights: np.ndarray):
    """A function of batches of ``vec_id, x`` to ``vec_id, deviation, z``; deviations by 64-bit numbers where those hold them, else by whole numbers of any size."""
    mean, rest, total = np.array([s // n for s in sums]), np.array([(s % n) / n for s in sums]), np.array(sums, object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy())
            z = ((x - mean).astype(np.float64) - rest) @ weights
            if len(sums) * (n * (int(np.abs(x - mean).max()) + 1)) ** 2 < 2**62:
                apart = ((n * (x - mean) - (total - n * mean.astype(object)).astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                apart = ((n * x.astype(object) - total) ** 2).sum(axis=1).tolist()
            yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": pd.array([a if a < 2**63 else None for a in apart], "Int64"), "z": list(z)})

    return run


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every vector and each of the first ``components`` components.

    embeddings: ``vec_id, embedding``; other columns aren't read. Vectors that are null or hold null or non-finite entries have no rows. Vectors of
    another length than the commonest (of equals the longer) have none either. Rows that repeat, and vectors that are equal, weigh once in the fit and
    have rows each; null ids are kept. Components number from 1 by falling eigenvalue; those without variance (fewer different vectors than
    dimensions, constant dimensions) have no rows, so one vector alone, vectors of no entries, and an empty table give none. Signs are such that the largest weight of a
    component is positive. ``deviation`` is null where it exceeds a long.
    """
    rows = embeddings.select("vec_id", _whole("embedding").alias("x")).where("x is not null and size(x) > 0")
    fit = written(rows.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    id_type = dict(embeddings.dtypes)["vec_id"]
    none = rows.sparkSession.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if lengths is None:
        return none
    d, n = lengths
    alike = fit.where(F.size("x") == d)
    sums = [int(s) for s in alike.agg(*(F.expr(f"sum(CAST(x[{i}] AS DECIMAL(20, 0)))") for i in range(d))).first()]
    centred = alike.select(*_centred(sums, n))
    covariance = _moments(centred, centred.columns, n)
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if trace > 0 and values[k] > RANK * trace]
    if not order:
        return none
    chosen = vectors[:, order]
    weights = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), range(len(order))]) / np.sqrt(values[order])
    project = _projection(sums, n, weights)
    of_fit = alike.select(F.lit(0).alias("vec_id"), "x").mapInPandas(project, "vec_id int, deviation long, z array<double>")
    of_fit = of_fit.select(*(F.col("z")[k].alias(f"c{k}") for k in range(len(order))))
    error = float(np.abs(_moments(of_fit, of_fit.columns, n) - np.eye(len(order))).max())
    discard(fit)
    out = rows.where(F.size("x") == d).mapInPandas(project, f"vec_id {id_type}, deviation long, z array<double>")
    explained = F.array(*(F.lit(float(values[k] / trace)) for k in order))
    out = out.select("vec_id", "deviation", F.posexplode(F.arrays_zip("z", explained.alias("e"))).alias("k", "c"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("c.z").alias("whitened"), F.col("c.e").alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened vectors of all embeddings; edge cases as in ``whitened``."""
    return whitened(table(spark, sf_dir, "embeddings"))
