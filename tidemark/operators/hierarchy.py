"""Ward's hierarchy over micro-clusters, and the number of clusters by silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import index

#: The hierarchy has so many leaves at most: a larger table is first gathered into about so many lists of the vector index.
MICRO = 1024
MERGES = "merge int, left int, right int, height double, size long"


def micro_clusters(df: DataFrame, id_col: str, vector: str, most: int = MICRO) -> tuple[DataFrame, list[tuple[int, np.ndarray]]]:
    """``id, unit, micro`` of every usable vector (see the index), and each micro-cluster's size and sum of unit vectors.

    A table of ``most`` vectors or fewer has one for each vector, in the order of ids; a larger one has the index's lists. Sums are ``most`` vectors at most.
    """
    few = df.select(F.col(id_col)).count() <= most
    units = index._usable(df, id_col, vector) if few else index.build(df, id_col, vector, most).rows.select("id", "unit", "list")
    rows = units.withColumn("micro", F.expr("CAST(row_number() OVER (ORDER BY id) - 1 AS INT)")) if few else units.withColumnRenamed("list", "micro")  # ``most`` rows in one task
    parts = rows.select("micro", F.posexplode("unit").alias("i", "x")).groupBy("micro", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = parts.groupBy("micro").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("s")).orderBy("micro").collect()
    number = {r["micro"]: k for k, r in enumerate(sums)}
    if sorted(number) != list(range(len(number))):  # lists that hold nothing have no number
        rows = rows.withColumn("micro", F.create_map(*(F.lit(x) for pair in number.items() for x in pair))[F.col("micro")])
    return rows.select("id", "unit", "micro"), [(r["n"], np.array(r["s"])) for r in sums]


def ward(clusters: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, float, int]]:
    """Merges ``(left, right, height, size)`` in the order of height; leaves are 0 to n - 1, merge k makes n + k.

    Nearest-neighbour chains on the distance sqrt(2 * a * b / (a + b)) * |centre - centre| of clusters of a and b vectors, which never falls
    from a merge to the one above it.
    """
    n = len(clusters)
    size = np.array([c[0] for c in clusters], float)
    centre = np.array([c[1] / c[0] for c in clusters])
    alive, found, chain = np.ones(n, bool), [], []

    def distances(i: int) -> np.ndarray:
        d = 2 * size * size[i] / (size + size[i]) * ((centre - centre[i]) ** 2).sum(axis=1)
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            d = distances(chain[-1])
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        i = chain.pop()
        chain.pop()
        a, b = min(i, j), max(i, j)
        found.append((float(np.sqrt(d[j])), a, b))
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    name, total, out = list(range(n)), [c[0] for c in clusters], []
    for k, (height, a, b) in enumerate(sorted(found)):
        total[a] += total[b]
        out.append((min(name[a], name[b]), max(name[a], name[b]), height, total[a]))
        name[a] = n + k
    return out


def cut(n: int, merges: list[tuple[int, int, float, int]], k: int) -> np.ndarray:
    """The cluster of each of ``n`` leaves when ``k`` are left, numbered from 0 by their least leaf."""
    root = list(range(n + len(merges)))
    for m, (a, b, _, _) in enumerate(merges[: n - k]):
        root[a] = root[b] = n + m
    for at in range(n + len(merges) - 1, -1, -1):
        root[at] = root[root[at]]
    first: dict[int, int] = {}
    return np.array([first.setdefault(root[leaf], len(first)) for leaf in range(n)])


def hierarchy(df: DataFrame, id_col: str, vector: str, most: int = MICRO) -> DataFrame:
    """``merge, left, right, height, size`` of Ward's hierarchy of unit vectors (see ``micro_clusters`` and ``ward``). Tables of fewer than two usable vectors have no merge."""
    _, clusters = micro_clusters(df, id_col, vector, most)
    rows = [(len(clusters) + k, a, b, h, int(s)) for k, (a, b, h, s) in enumerate(ward(clusters))]
    return df.sparkSession.createDataFrame(rows, MERGES)


def cluster_counts(df: DataFrame, id_col: str, vector: str, most_k: int = 20, most: int = MICRO) -> DataFrame:
    """``k, silhouette, chosen`` for cuts of the hierarchy into 2 to ``most_k`` clusters: the mean silhouette by cosine distance, and the best one (the fewest of equals).

    One pass over the vectors scores all cuts: the mean distance to a cluster follows from the sum of its unit vectors. Vectors alone in their cluster count as 0.
    """
    rows, clusters = micro_clusters(df, id_col, vector, most)
    spark, n = df.sparkSession, len(clusters)
    if n < 3:
        return spark.createDataFrame([], "k int, silhouette double, chosen boolean")
    merges = ward(clusters)
    cuts = {k: cut(n, merges, k) for k in range(2, min(most_k, n - 1) + 1)}
    known = {}
    for k, label in cuts.items():
        sums, sizes = np.zeros((k, len(clusters[0][1]))), np.zeros(k)
        for (size, s), at in zip(clusters, label, strict=True):
            sums[at] += s
            sizes[at] += size
        known[k] = (label, sums, sizes)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: [0.0, 0] for k in shared.value}
        for batch in batches:
            if not len(batch):
                continue
            x, micro = np.stack(batch["unit"].to_numpy()), batch["micro"].to_numpy()
            for k, (label, sums, sizes) in shared.value.items():
                own, like = label[micro], x @ sums.T
                at = np.arange(len(x))
                inside = 1 - (like[at, own] - 1) / np.maximum(sizes[own] - 1, 1)
                other = 1 - like / sizes
                other[at, own] = np.inf
                nearest = other.min(axis=1)
                top = np.maximum(inside, nearest)
                s = np.where((sizes[own] > 1) & (top > 0), (nearest - inside) / np.where(top > 0, top, 1), 0.0)
                total[k][0] += float(s.sum())
                total[k][1] += len(x)
        yield pd.DataFrame([(k, s, n) for k, (s, n) in total.items()], columns=["k", "s", "n"])

    means = rows.mapInPandas(run, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
    best = means.agg(F.max(F.struct(F.round("silhouette", 12).alias("s"), (-F.col("k")).alias("less"))).alias("b")).select((-F.col("b.less")).alias("best"))
    return means.crossJoin(F.broadcast(best)).select("k", "silhouette", (F.col("k") == F.col("best")).alias("chosen"))  # one row
