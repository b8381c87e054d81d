"""The pivot index against brute force, and the pipeline's stages."""

import numpy as np
import pytest

import corpus_pipeline
from llm import pivots


def brute(rows, link=0.93):
    ok = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, float) / np.linalg.norm(v), label)
    links = {i: {j for j in ok if j != i and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] >= link} for i in ok}
    root = {i: i for i in ok}
    changed = True
    while changed:
        changed = False
        for i, to in links.items():
            low = min([root[i], *(root[j] for j in to)])
            if low < root[i]:
                root[i], changed = low, True
    return links, root


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((k, (centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.25, 0.4])).tolist(), int(rng.integers(0, 3))))
            k += 1
    hot = rng.normal(size=16)
    for _ in range(700):  # one large group, beyond a block
        rows.append((k, (hot + rng.normal(size=16) * 0.02).tolist(), 0))
        k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 16, 1), (k + 2, [float("nan")] * 16, 1), (k + 3, [None] * 16, 1), (k + 4, [1.0] * 16, None), (k + 5, [1.0] * 8, 1), (k + 6, [1.0] * 8, 1), (k + 7, [], 1), (None, [1.0] * 16, 1), (0, rows[0][1], rows[0][2])]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links, root = brute(rows)
    assert len(got) == len(rows)
    truth, found = sum(map(len, links.values())), sum(r["n_links"] for r in {r["vec_id"]: r for r in got}.values())
    assert 0.97 * truth <= found <= truth
    for r in got:
        assert r["n_links"] <= len(links.get(r["vec_id"], ()))
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
    agree = sum(r["component_id"] == root.get(r["vec_id"], r["vec_id"]) for r in got)
    assert agree >= 0.97 * len(got)
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_recall_with_many_pivots(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PER_PIVOT", 4)  # about as many pivots as 0.8 million vectors have
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    hub, alike, planted = unit(rng.normal(size=64)), 0.85, (0.935 - 0.85) / 0.15
    noise = unit(rng.normal(size=(700, 64)))
    near = planted * noise + np.sqrt(1 - planted**2) * unit(rng.normal(size=(700, 64)))
    hot = np.sqrt(alike) * hub + np.sqrt(1 - alike) * np.concatenate([noise, near])
    vectors = np.concatenate([hot, rng.normal(size=(2800, 64))])
    rows = [(k, v.tolist(), int(k >= len(hot))) for k, v in enumerate(vectors)]
    ok = unit(hot)
    truth = int((ok @ ok.T >= 0.93).sum()) - len(ok)
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).agg({"n_links": "sum"}).first()[0]
    assert truth > 700 and 0.95 * truth <= got <= truth


def test_whole_table_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    links, root = brute(rows)
    got = {r["vec_id"]: r for r in pivots.op1_embedding_near_dedup(spark, "/root/testdata/sf0.1").collect()}
    assert all(got[i]["n_links"] == len(to) and got[i]["component_id"] == root[i] for i, to in links.items())


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= n, name
        n = out.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n


def test_one_copy_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "s", 1), (2, text.upper(), "en", "s", 1), (3, "other words here", "en", "s", 1), (3, "other words here", "en", "s", 1), (4, None, "en", "s", 0), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_copy(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, 1), (False, 3), (False, 4)] and kept.count() == 4


def test_rows_that_share_an_id(spark):
    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(30))
    rows = [(1, text, "a"), (2, text, "b"), (2, other, "c"), (3, None, "d"), (3, None, "e"), (4, "", "f"), (5, other.upper(), "g"), (5, other, "h"), (6, "some few words", "i"), (6, "some few words", "j"), (None, text, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["source"] for r in corpus_pipeline.keep_one_copy(spark, docs, "").collect()}
    assert kept in ({"a", "c", "d", "e", "f", "i", "k"}, {"a", "c", "d", "e", "f", "j", "k"})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, tmp_path, name):
    for t, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).count() == 0
