"""Ward's hierarchy, the number of clusters and the likeness of topics against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hierarchy, topics


def brute_ward(x):
    """The least growth of the sum of squares at each step, over all pairs."""
    groups, out = {i: [i] for i in range(len(x))}, []
    sse = lambda g: ((x[g] - x[g].mean(axis=0)) ** 2).sum()
    for k in range(len(x) - 1):
        a, b = min(((a, b) for a in groups for b in groups if a < b), key=lambda p: sse(groups[p[0]] + groups[p[1]]) - sse(groups[p[0]]) - sse(groups[p[1]]))
        height = math.sqrt(2 * (sse(groups[a] + groups[b]) - sse(groups[a]) - sse(groups[b])))
        groups[len(x) + k] = groups.pop(a) + groups.pop(b)
        out.append((a, b, height, len(groups[len(x) + k])))
    return out


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * x.shape[1], 1)], "vec long, v array<double>, micro int")


def points(n=40, d=6, seed=1):
    rng = np.random.default_rng(seed)
    hubs = np.array([[3, 0, 0, 0, 0, 0], [0, 3, 0, 0, 0, 0], [0, 0, 3, 0, 0, 0], [0, 0, 0, 3, 0, 0]], float)
    return hubs[np.arange(n) % 4] + rng.normal(size=(n, d)) * 0.4


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_is_wards(spark, seed):
    x = points(seed=seed)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = [(r["left"], r["right"], r["height"], r["size"]) for r in hierarchy.hierarchy(table(spark, x), "vec", "v").orderBy("merge").collect()]
    expect = brute_ward(units)
    assert [g[:2] + g[3:] for g in got] == [e[:2] + e[3:] for e in expect]
    assert np.allclose([g[2] for g in got], [e[2] for e in expect])


def test_weighted_leaves_merge_like_their_vectors():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(6, 3)), [5, 1, 2, 7, 1, 3], axis=0)
    sums = [(n, x[at : at + n].sum(axis=0)) for n, at in zip([5, 1, 2, 7, 1, 3], [0, 5, 6, 8, 15, 16], strict=True)]
    assert np.allclose([m[2] for m in hierarchy.ward(sums)], [m[2] for m in brute_ward(x)][-5:])


def test_number_of_clusters(spark):
    x = points()
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = {r["k"]: r for r in hierarchy.cluster_counts(table(spark, x), "vec", "v", 8).collect()}
    far = 1 - units @ units.T
    merges = hierarchy.ward([(1, u) for u in units])
    for k, r in rows.items():
        label = hierarchy.cut(len(x), merges, k)
        assert len(set(label)) == k
        s = []
        for i in range(len(x)):
            own = [j for j in range(len(x)) if label[j] == label[i] and j != i]
            b = min(far[i][label == c].mean() for c in set(label) - {label[i]})
            a = far[i][own].mean() if own else 0.0
            s.append((b - a) / max(a, b) if own else 0.0)
        assert math.isclose(r["silhouette"], sum(s) / len(s), abs_tol=1e-9)
    assert [k for k, r in rows.items() if r["chosen"]] == [4] and rows.keys() == set(range(2, 9))


def test_larger_tables_are_gathered_first(spark):
    x = points(400)
    rows = hierarchy.hierarchy(table(spark, x), "vec", "v", 32).collect()
    assert 8 <= len(rows) < 32 and max(r["size"] for r in rows) == 400
    best = [r["k"] for r in hierarchy.cluster_counts(table(spark, x), "vec", "v", 8, 32).collect() if r["chosen"]]
    assert best == [4]
    assert hierarchy.hierarchy(table(spark, x).limit(0), "vec", "v").count() == 0 and hierarchy.cluster_counts(table(spark, x).limit(0), "vec", "v").count() == 0


def test_topics(spark):
    words = {"a": {"x": 4.0, "y": 3.0, "z": 3.0}, "b": {"x": 4.0, "y": 3.0, "q": 3.0}, "c": {"m": 1.0, "n": 1.0}, "d": {"alone": 2.0}}
    of = spark.createDataFrame([(t, w, k) for t, ws in words.items() for w, k in ws.items()], "topic string, word string, weight double")
    texts = ["x y", "x y z", "z", "m", "n q", "", None, "x x q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set((t or "").split()) for t in texts if t]
    got = {r["topic"]: r for r in topics.coherence(of, docs, "id", F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")).collect()}
    for t in ("a", "b", "c"):
        ws = sorted(words[t])
        count = lambda *of: sum(s.issuperset(of) for s in sets)
        lifts = [count(u, v) * len(sets) / (count(u) * count(v)) for i, u in enumerate(ws) for v in ws[i + 1 :]]
        assert math.isclose(got[t]["coherence"], sum(lifts) / len(lifts)) and got[t]["pairs"] == len(lifts)
    assert "d" not in got
    js = {(r["a"], r["b"]): r["divergence"] for r in topics.divergences(of).collect()}

    def brute(p, q):
        p, q = ({w: k / sum(d.values()) for w, k in d.items()} for d in (p, q))
        half = lambda u, v: sum(k * math.log(k / ((k + v.get(w, 0)) / 2)) for w, k in u.items()) / 2
        return half(p, q) + half(q, p)

    assert len(js) == 6 and all(math.isclose(v, brute(words[a], words[b]), abs_tol=1e-12) for (a, b), v in js.items())
    merged = {r["topic"]: r["merged"] for r in topics.merged_topics(of, 0.25).collect()}
    assert merged == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_coherence_counts_each_text_once_without_exchanging_words(spark, monkeypatch):
    """One pass by words and pairs equals the joined way, which texts that share a key take; it exchanges no rows of texts."""
    of = spark.createDataFrame([("s", "x", 3.0), ("s", "y", 2.0), ("t", "y", 5.0), ("t", "z", 1.0), ("u", "q", 1.0)], "topic string, word string, weight double")
    texts = spark.createDataFrame([(1, "x y"), (2, "x y z"), (3, "y z"), (4, "x"), (5, ""), (6, None)], "id long, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    one_pass = topics.coherence(of, texts, "id", words)
    assert "MapInPandas" not in one_pass._jdf.queryExecution().optimizedPlan().toString() and "split" not in one_pass._jdf.queryExecution().optimizedPlan().toString()
    got = {r["topic"]: (r["pairs"], r["coherence"]) for r in one_pass.collect()}
    monkeypatch.setattr(topics, "FEW", 0)
    assert got == {r["topic"]: (r["pairs"], r["coherence"]) for r in topics.coherence(of, texts, "id", words).collect()} == {"s": (1, 2 * 4 / 9), "t": (1, 2 * 4 / 6)}
    monkeypatch.setattr(topics, "FEW", 1_000)
    shared = topics.coherence(of, spark.createDataFrame([(1, "x"), (1, "y"), (2, "x y")], "id long, text string"), "id", words)
    assert [tuple(r) for r in shared.where("topic = 's'").collect()] == [("s", 1, 2 * 3 / 4)]
