"""Dictionary entities, sentences, relations and paths against brute force on hand-made texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import entities, graph
from tidemark.plans.governance import dates

WORDS = "new york city hall united states états Größe of the a 42".split()


def brute(text, names):
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "")]
    spans, around = set(), {}
    for i, j in ((i, i + n) for n in range(4) for i in range(len(words) - n)):
        name = " ".join(text[a:b].lower() for a, b in words[i : j + 1])
        if name in names:
            spans.add((words[i][0], words[j][1], name))
            for k in range(i, j + 1):
                around.setdefault(words[k][0], set()).add((words[i][0], words[j][1]))
    return {s for s in spans if not any((a, b) != (s[0], s[1]) for a, b in around.get(s[0], ()) if a <= s[0] and s[1] <= b)}


@pytest.mark.parametrize(("seed", "known"), [(1, 100_000), (2, 3)])
def test_dictionary_spans(spark, monkeypatch, seed, known):
    monkeypatch.setattr(entities, "KNOWN", known)
    rng = random.Random(seed)
    names = {" ".join(rng.choices(WORDS, k=rng.randint(1, 4))).lower() for _ in range(40)}
    texts = [(k, "".join(rng.choice(WORDS).title() + rng.choice([" ", "-", ", ", ".  ", "\n"]) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, "..."), (103, "York " * 5000), (104, "New_York newyork")]
    dictionary = [(n.title(), "KIND", 0.9) for n in names] + [(next(iter(names)), "OTHER", 0.5), (None, "X", 1.0), ("--", "X", 1.0)]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in texts], "doc_id long, text string, name string, start int")
    got = entities.dictionary_spans(df, "doc_id", "text", spark.createDataFrame(dictionary, "name string, type string, confidence double")).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["name"]) for r in got) == sorted((k, *s) for k, t in texts for s in brute(t, names))
    assert {r["type"] for r in got} == {"KIND"}


def test_dictionary_of_no_names(spark):
    df = spark.createDataFrame([("k", "some text")], "id string, body string")
    empty = spark.createDataFrame([], "name string, type string, confidence double")
    assert entities.dictionary_spans(df, "id", "body", empty).count() == 0
    assert entities.dictionary_spans(df.limit(0), "id", "body", spark.createDataFrame([("some", "T", 1.0)], empty.schema)).count() == 0


@pytest.mark.parametrize("known", [100_000, 0])
def test_relations(spark, monkeypatch, known):
    monkeypatch.setattr(entities, "KNOWN", known)
    names = spark.createDataFrame([("Ada Byron", "PERSON", 0.9), ("Engine Works", "ORG", 0.95), ("Analytical Engine", "PRODUCT", 0.9), ("Engine", "PRODUCT", 0.5)], "name string, type string, confidence double")
    phrases = spark.createDataFrame([("works at", "works_at", 0.85), ("works", "does", 0.7), ("built", "develops", 0.75)], names.schema)
    texts = [
        (1, "Ada Byron works at Engine Works. The Analytical Engine was slowly built by Engine Works!  Ada Byron met nobody."),
        (2, "Ada Byron and Engine Works? Ada Byron works at Engine Works. ADA BYRON works at Engine Works."),
        (3, None), (4, "Ada Byron"), (5, "Ada Byron. Engine Works"),
    ]
    out = entities.relations(spark.createDataFrame(texts, "id long, text string"), "id", "text", names, phrases).collect()
    got = sorted((r["id"], r["subject"], r["relation"], r["object"], r["confidence"], r["sentence_start"]) for r in out)
    assert got == [
        (1, "ada byron", "works_at", "engine works", 0.85, 0),
        (1, "analytical engine", "develops", "engine works", 0.6, 33),
        (2, "ada byron", "collaborates_with", "engine works", 0.4, 0),
        (2, "ada byron", "works_at", "engine works", 0.85, 28),
    ]
    assert {(r["subject_type"], r["object_type"]) for r in out} == {("PERSON", "ORG"), ("PRODUCT", "ORG")}


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_paths(spark, depth):
    rng = random.Random(depth)
    links = [(rng.randrange(9), rng.randrange(9)) for _ in range(18)] + [(1, 1), (None, 2)]
    pairs = [(a, b) for a in range(4) for b in range(9)] + [(None, 1), (0, 77)]
    g = {(a, b) for a, b in links if a is not None and a != b} | {(b, a) for a, b in links if a is not None and a != b}

    def walk(path, end):
        if path[-1] == end:
            return [tuple(path)] if len(path) > 1 else []
        return [p for b in range(9) if len(path) <= depth and (path[-1], b) in g and b not in path for p in walk([*path, b], end)]

    expect = sorted(p for a, b in set(pairs) if a is not None and a != b for p in walk([a], b))
    got = graph.paths(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(pairs, "start long, end long"), depth).collect()
    assert sorted(tuple(r["path"]) for r in got) == expect


def test_dates(spark):
    text = "On March 5, 2024 and sep 2023, 2024-01-31 or 3/4/24; q3 2022. Last week, 3 days ago, yesterday. Marches 5 2024, next day, 12 years ago"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(F.explode(dates(F.col("t"))).alias("d")).collect()
    assert [(r["d"]["value"], r["d"]["sure"]) for r in rows] == [
        ("march 5, 2024", 0.95), ("sep 2023", 0.85), ("2024-01-31", 0.9), ("3/4/24", 0.85), ("q3 2022", 0.9), ("last week", 0.7), ("3 days ago", 0.7), ("yesterday", 0.6),
    ]


def test_sentences_by_place(spark):
    df = spark.createDataFrame([("a", "One two. Three!  Four"), ("b", None), ("c", ""), ("d", "No end"), ("e", "Ends. ")], "id string, text string")
    sentences = entities.sentence_spans(df, "id", "text")
    assert sorted((r["id"], r["start"], r["end"], r["sentence"]) for r in sentences.collect()) == [("a", 0, 8, "One two."), ("a", 9, 15, "Three!"), ("a", 17, 21, "Four"), ("d", 0, 6, "No end"), ("e", 0, 5, "Ends.")]
    spans = spark.createDataFrame([("a", 0, "w"), ("a", 8, "x"), ("a", 9, "y"), ("a", 20, "z"), ("d", 3, "v")], "id string, start long, what string")
    assert sorted((r["what"], r["sentence_start"]) for r in entities.in_sentences(spans, sentences, "id").collect()) == [("v", 0), ("w", 0), ("x", 0), ("y", 9), ("z", 17)]
