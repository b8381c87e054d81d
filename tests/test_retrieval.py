"""Chunks, the vector index and the centroid classifier: properties on whole texts, brute force and recall."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import plans
from tidemark.functions import text as X
from tidemark.operators import blocks, chunks, classifiers, index
from tidemark.operators import text_stats as T


def recursive_pieces(text, size, overlap, ladder):
    """The recursion as it is told: what is too long is cut after each separator, its parts at the next one."""
    if len(text) <= size:
        return [text] if text else []
    if not ladder:
        step = overlap or size
        return [text[k : k + step] for k in range(0, len(text), step)]
    parts = text.split(ladder[0])
    parts = [p + ladder[0] for p in parts[:-1]] + parts[-1:]
    return [x for p in parts if p for x in recursive_pieces(p, size, overlap, ladder[1:])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \nü", max_size=300), st.integers(2, 40), st.data())
def test_chunks_have_the_size_and_cover_the_text(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    ends = chunks.pieces(text, size, overlap) if text else []
    parts = recursive_pieces(text, size, overlap, chunks.LADDER)
    assert [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] == parts
    found = chunks.spans(text, size, overlap)
    assert bool(found) == bool(text)
    if text:
        assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, d) in zip(found, found[1:], strict=False):
        assert b - overlap <= c <= b and a < c and b < d
    for k, (a, b) in enumerate(found):
        assert 0 < b - a <= size and {a, b} <= {0, *ends}
        if k + 1 < len(found):  # the next piece didn't fit
            assert next(e for e in ends if e > b) - a > size


def test_chunks_of_tables(spark):
    texts = [("a", "x" * 1234), ("b", None), ("c", ""), ("d", "One. Two.\n\n" * 400), ("d", "again")]
    got = chunks.chunked(spark.createDataFrame([(k, t, 3) for k, t in texts], "id string, body string, chunk int"), "id", "body", 100, 20).collect()
    assert {r["id"] for r in got} == {"a", "d"} and max(len(r["text"]) for r in got) <= 100
    by = [r for r in got if r["id"] == "a"]
    assert [(r["start"], r["end"]) for r in sorted(by, key=lambda r: r["chunk"])][:2] == [(0, 100), (80, 180)]
    with pytest.raises(ValueError):
        chunks.chunked(spark.createDataFrame(texts, "id string, body string"), "id", "body", 10, 10)


def clusters(seed, n=1500, d=24):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(30, d))
    return hubs[rng.integers(0, 30, n)] + rng.normal(size=(n, d)) * 0.5


@pytest.mark.parametrize("seed", [1, 2])
def test_index(spark, monkeypatch, seed):
    monkeypatch.setattr(index, "PART", 40)
    x = clusters(seed)
    x[50:80] = x[0]  # copies: ties by id
    rows = [(k, v.tolist(), "id") for k, v in enumerate(x)]
    bad = [(5000, None, ""), (5001, [0.0] * 24, ""), (5002, [None] * 24, ""), (5003, [float("nan")] * 24, ""), (5004, [1.0] * 3, ""), (5005, [], "")]
    df = spark.createDataFrame(rows + bad, "vec long, v array<float>, list string")
    found = index.build(df, "vec", "v", 32)
    found.rows = found.rows.persist()
    asked = df.where("vec % 25 = 0")
    units = x.astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    truth = {}
    for q in range(0, len(x), 25):
        like = np.round(units @ units[q], 9)
        truth[q] = [(k, like[k]) for k in sorted(set(range(len(x))) - {q}, key=lambda k: (-like[k], k))[:10]]
    exact = index.search(asked, "vec", "v", found, 10, probes=4, exact=True)
    plan = exact._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in exact.collect():
        got.setdefault(r["query"], {})[r["rank"]] = r
    assert got.keys() == truth.keys()
    for q, best in truth.items():
        assert np.allclose([got[q][k + 1]["score"] for k in range(10)], [s for _, s in best], atol=1e-6)
    quick = index.search(asked, "vec", "v", found, 10).collect()
    met = sum(r["score"] >= truth[r["query"]][-1][1] - 1e-9 for r in quick)
    assert met >= 0.9 * 10 * len(truth)
    assert index.search(df.where("vec >= 5000"), "vec", "v", found, 10, exact=True).count() == 0


def test_index_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec long, v array<float>")
    found = index.build(df, "vec", "v")
    assert index.search(df, "vec", "v", found, 3, exact=True).count() == 0


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = index.build(df, "vec_id", "embedding")
    asked, found.rows = df.where("vec_id % 10 = 0"), found.rows.persist()
    key = lambda rows: {(r["query"], r["id"]) for r in rows.collect()}
    exact, quick = (key(index.search(asked, "vec_id", "embedding", found, 10, exact=e)) for e in (True, False))
    assert len(exact & quick) >= 0.9 * len(exact)


def test_centroid_classifier(spark):
    rng = random.Random(4)
    topics = {"sea": "wave tide harbor sail anchor".split(), "sky": "cloud wing pilot thunder altitude".split()}
    rows = []
    for k in range(200):
        label = rng.choice(list(topics))
        rows.append((k, " ".join(rng.choices(topics[label], k=6) + rng.choices("common shared plain words here".split(), k=6)), label))
    rows += [(900, None, "sea"), (901, "", "sky"), (902, "nothing known", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    weights = T.tfidf(df, "id", X.words(df["text"], 3, X.STOP_WORDS))
    centroids = classifiers.label_centroids(weights, df.where("id < 100"), "id", "label")
    got = {r["id"]: r["predicted"] for r in classifiers.nearest_label(weights, centroids, "id").collect()}
    assert all(got[k] == label for k, _, label in rows[:200]) and not {900, 901, 902} & got.keys()


@pytest.mark.parametrize("entries", [1 << 21, 60])
def test_classified_texts_equal_the_joins(spark, monkeypatch, entries):
    """In one block and in many: texts that share an id or have none, several labels of a text, ties, and no label at all; nothing for each word of each text stays on disk."""
    monkeypatch.setattr(blocks, "ENTRIES", entries)
    monkeypatch.setattr(blocks, "LEAST", min(entries, 1 << 17))
    rng = random.Random(5)
    rows = [(f"k{i:03}", " ".join(rng.choices("wave tide harbor sail cloud wing pilot common shared plain".split(), k=rng.randint(0, 12)))) for i in range(120)]
    df = spark.createDataFrame([*rows, ("k200", "wave"), ("k200", "cloud"), ("k201", None), ("k202", "nothing known"), (None, "wave wave")], "id string, text string").repartition(3)
    names = [None, "sea", "sky", "land"]
    labels = spark.createDataFrame([(f"k{rng.randrange(90):03}", rng.choice(names)) for _ in range(70)] + [("k003", "sea"), ("k003", "sea"), ("k999", "sky"), (None, "sky")], "id string, label string")
    words = T.hashed(X.words(F.col("text"), 3, X.STOP_WORDS))
    for known in (labels, labels.where("false")):
        texts = df.groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
        n = df.count()
        tf = T.word_rows(texts, "id", words).groupBy("id", "word").agg(F.count("*").alias("tf"))
        w = tf.join(tf.groupBy("word").agg(F.count("*").alias("df")), "word").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
        w = w.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).where("id is not null").select("id", "word", "weight")
        expect = classifiers.nearest_label(w, classifiers.label_centroids(w, known, "id", "label"), "id")
        key = lambda found: sorted((r["id"], r["predicted"], round(r["score"], 6)) for r in found.collect())
        assert key(classifiers.classified_texts(df, "id", words, known, "label")) == key(expect)


def test_disk_of_classified_texts(spark):
    """What the query returns is read from its written labels: its plan exchanges no words."""
    table = "/root/testdata/sf0.01"
    found = plans.QUERIES["centroid_classifier"](spark, table)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 900
