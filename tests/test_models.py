"""What the fitted queries are worth: held-out accuracy, inertia, topics that follow languages, and diverse neighbours against brute force."""

from collections import Counter, defaultdict

import numpy as np

from tidemark import plans

SF = "/root/testdata/sf0.01"


def test_text_classifier_on_held_out_rows(spark):
    rows = [r for r in plans.QUERIES["text_classifier"](spark, SF).collect() if r["doc_id"] % 5 == 0]
    assert len(rows) > 50 and sum(r["label"] == r["prediction"] for r in rows) >= 0.9 * len(rows)


def test_centroid_classifier_tells_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in plans.QUERIES["centroid_classifier"](spark, SF).collect() if r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.8 * len(rows)


def test_vector_clusters_are_tighter_than_chance(spark):
    x = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    at = {r["vec_id"]: r["cluster"] for r in plans.QUERIES["vector_clusters"](spark, SF).collect()}
    assert at.keys() == x.keys() and len(set(at.values())) == 10

    def inertia(label):
        groups = defaultdict(list)
        for k, c in label.items():
            groups[c].append(x[k])
        return sum(((np.array(g) - np.mean(g, axis=0)) ** 2).sum() for g in groups.values())

    shuffled = dict(zip(at, np.random.default_rng(1).permutation(list(at.values())), strict=True))
    assert inertia(at) < 0.95 * inertia(shuffled)


def test_topics_follow_languages(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = plans.QUERIES["topic_model"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == lang.keys()
    by = defaultdict(Counter)
    for r in rows:
        by[r["topic"]][lang[r["doc_id"]]] += 1
    agree, chance = sum(c.most_common(1)[0][1] for c in by.values()), Counter(lang.values()).most_common(1)[0][1]
    assert agree > chance  # topics tell more of the language than the commonest language does


def test_diverse_neighbours_are_the_greedy_choice(spark):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in x.items()}
    got = defaultdict(dict)
    for r in plans.QUERIES["diverse_neighbours"](spark, SF).collect():
        got[r["query"]][r["rank"]] = r["id"]
    for q, picks in got.items():
        near = sorted((k for k in unit if k != q), key=lambda k: (-(unit[q] @ unit[k]), k))[:30]
        chosen = []
        while len(chosen) < 5:
            value = lambda k: 0.7 * (unit[q] @ unit[k]) - 0.3 * max([unit[k] @ unit[c] for c in chosen], default=0.0)
            best = max(value(k) for k in near if k not in chosen)
            assert value(picks[len(chosen) + 1]) >= best - 1e-6
            chosen.append(picks[len(chosen) + 1])
