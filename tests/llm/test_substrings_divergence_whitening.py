"""Repeated passages, source divergences and whitened vectors against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import divergence, substrings, whitening
from llm.common import CLEANUP

WORD = r"[^\x20\x09-\x0D]+"


def removed(rows, window=13):
    """Brute force: covered word places of each row."""
    words = [re.findall(WORD, t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def passages(seed):
    rng = random.Random(seed)
    pool = [" ".join(f"p{j}w{k}" for k in range(rng.choice((12, 13, 14, 40)))) for j in range(6)]
    rows = []
    for i in rng.sample(range(-50, 5000), 120):
        parts = [" ".join(rng.choice("abc") + str(rng.randrange(40)) for _ in range(rng.randrange(0, 12))) for _ in range(4)]
        for at in range(3):
            if rng.random() < 0.5:
                parts.insert(at, rng.choice(pool))
        rows.append((i, rng.choice(" \t\n").join(parts)))
    copies = [(9000 + k, pool[3] + " and so on " + pool[5]) for k in range(80)]
    edges = [(7000, None), (7001, ""), (7002, " \x0b\x0c "), (7003, "x " * 20_000), (7004, "x " * 400), (7005, "Ünïcode 😀 " * 20), (7006, "Ünïcode 😀 " * 20), (None, pool[3]), (None, pool[3]), (9000, pool[4] * 2), (9000, copies[0][1]), (7007, "a b " * 13)]
    return rows + copies + edges


@pytest.mark.parametrize(("seed", "hot"), [(1, 1 << 18), (2, 0), (3, 5)])
def test_repeated_passages(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(substrings, "HOT", max(hot, 1))
    monkeypatch.setattr(substrings, "SAMPLE_ONE_IN", 2 if hot else 1 << 30)
    rows = passages(seed)
    table = spark.createDataFrame([(i, t, 5, "w", i) for i, t in rows], "doc_id long, text string, window long, hot string, doc long").repartition(5)
    got = substrings.repeated_passages(table).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == removed(rows)
    for r in got:
        assert all(a["end"] < b["start"] for a, b in zip(r["intervals"], r["intervals"][1:], strict=False))
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["intervals"]) and hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_the_exchange_of_windows_is_deleted_once_written(spark, monkeypatch):
    """Windows are written while Spark deletes the shuffle files of what is written; the session's own choice is as before afterwards (op11_substring_dedup)."""
    write, chosen, before = substrings.written, [], spark.conf.get(CLEANUP, None)
    monkeypatch.setattr(substrings, "written", lambda df: chosen.append(spark.conf.get(CLEANUP, None)) or write(df))
    rows = passages(3)
    assert substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert chosen == ["true"] and spark.conf.get(CLEANUP, None) == before


def test_repeated_passages_of_an_empty_table(spark):
    assert substrings.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rolling_hashes_know_windows():
    hasher = substrings.Hasher(4)
    words = hasher.words(["a b a b a b a b c", None, "x a b a b y", "b a b a"])
    text, start, key = hasher.windows(words)
    by = defaultdict(set)
    for t, s, k in zip(text, start, key, strict=True):
        by[tuple(words[t][s : s + 4])].add(int(k))
    assert len(text) == 6 + 0 + 3 + 1 and all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)


def audit(rows):
    """Brute force in whole numbers of any size."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= 3]
        share = lambda c: (lambda total: {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p = share(n[lang, source])
        pairs = [(s, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for g, s in groups if g == lang and s != source for q in [share(n[g, s])]]
        whole = share(sum((n[g] for g in groups if g[0] == lang), Counter()))
        words = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if n[lang, source][t] > 0 and p[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", words, 200)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(8192, 8), (7, 2), (50, 1), (20, 3)])
def test_source_divergence(spark, monkeypatch, shard, block):
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TOGETHER", 60)
    rng = random.Random(shard)
    vocabulary = [f"{a}{b}" for a in "abcdéфZ" for b in "xyzß名"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) + ". A-b_c 1x2", rng.choice(["en", "de"]), f"s{rng.randrange(7)}") for _ in range(150)]
    rows += [("many different " + " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)), "en", "s0")] * 3  # more than 200 terms, and ties
    rows += [(None, "en", "none"), ("", "fr", None), ("one two", "fr", ""), ("x", "fr", "b"), (None, None, None), ("alone here", None, "s1"), ("Long " * 30_000, "en", "s3")]
    table = spark.createDataFrame([(k, *r, 1, 2, 3) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term long, shard long, home long").repartition(4)
    assert sorted(tuple(r) for r in divergence.source_divergence(table).collect()) == audit(rows)


def test_source_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_beyond_small_counts():
    counts, total = [0, 1, 7, 10**12, 8 * 10**14], 9 * 10**14 + 7
    assert divergence.per_unit(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def vectors(seed, n=300, d=9):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(base)]
    rows += [(k + 1000, rows[0][1], 2) for k in range(200)] + [(0, rows[0][1], 1), (None, rows[1][1], 1)]
    return rows, [(5000, None, 1), (5001, [None] * d, 1), (5002, [float("nan")] * d, 1), (5003, [float("inf")] * d, 1), (5004, [1e300] * d, 1), (5005, [1.0] * (d + 1), 1), (5006, [], 1)]


@pytest.mark.parametrize(("seed", "d"), [(1, 9), (2, 20), (3, 1)])
def test_whitened(spark, seed, d):
    good, bad = vectors(seed, d=d)
    got = whitening.whitened(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, x int").repartition(3)).collect()
    x = np.floor(64 * np.array([v for _, v, _ in good])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    k = min(16, d)
    assert len(got) == len(good) * k and all(r["n"] == n and r["identity_error"] <= 1e-9 for r in got)
    apart = Counter((i, int(((n * v - sums).astype(object) ** 2).sum())) for (i, _, _), v in zip(good, x, strict=True))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == apart
    mine = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, k + 1):
        z = (x - sums / n) @ axes[:, -c] / np.sqrt(values[-c])
        ours = np.array([mine[i, c]["whitened"] for i, _, _ in good])
        assert min(np.abs(z - ours).max(), np.abs(z + ours).max()) < 1e-6
        assert abs(mine[0, c]["explained"] / (values[-c] / values.sum()) - 1) < 1e-9


def test_whitened_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])], schema)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(k, [float(k), 3.0, 2.0 * k]) for k in range(5)], schema)).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 5


def test_deviations_of_any_size():
    run = whitening._projection([4 * 10**12 + 1, 5], 4_000_000, np.ones((2, 1)))
    import pandas as pd

    out = next(iter(run(iter([pd.DataFrame({"vec_id": [1, 2], "x": [np.array([10**6, 1]), np.array([2 * 10**6, 1])]})]))))
    assert out["deviation"][0] == 1 + (4_000_000 - 5) ** 2 and out["deviation"].isna()[1]
