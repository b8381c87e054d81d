"""Toxic passages by maximum-scoring segments.

Token weights are log-odds of toxic against other labelled texts with an informative Dirichlet
prior (PRIOR times the pooled counts); a token counts when its log-odds lie SURE standard errors from zero. All other
tokens weigh a little below zero. One linear scan finds every maximal-scoring segment. A segment's
score s becomes rate * s - ln(size * n), which follows the extreme-value law for ordinary text of n tokens, so
its chance there is 1 - exp(-exp(-x)). The largest x of a text, and how many of its segments are significant, give
the score through a logistic curve fitted on the same labelled texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import held_out, labelled_sample, table, written

#: At most BOUND labelled rows are learned from; a token needs LEAST toxic or other uses and SURE standard errors.
BOUND, LEAST, SURE, PRIOR, DRIFT, SIGNIFICANT, CUT = 20_000, 3, 3.0, 0.1, -0.05, 0.01, 0.7
STEMS, CACHE = (7, 6, 5, 4), 100_000
TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def forms(token: str) -> list[str]:
    """What a token may be known as, most specific first: itself, or how it begins (rare inflections share a stem)."""
    return [token, *(f"{token[:k]}~" for k in STEMS if len(token) > k)]


class Known(dict):
    """Weight of every token met: that of its most specific known form, or 0. Emptied when it has CACHE tokens."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) > CACHE:
            self.clear()
        self[token] = w = next((self.weights[f] for f in forms(token) if f in self.weights), 0.0)
        return w

    def along(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), float, len(words))


def segments(places: list[int], weights: list[float], n: int, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of n tokens: ``weights`` at ``places``, ``drift`` elsewhere.

    The stack algorithm of Ruzzo and Tompa; runs of drift are taken at once, so time is linear in ``places``.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    total, after = 0.0, 0
    for at, w in zip(places, weights, strict=True):
        total += drift * (at - after)
        after = at + 1
        before, total = total, total + w
        if w <= 0:
            continue
        first, left, right = at, before, total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                stack.append((first, after, left, right))
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, right - left) for a, b, left, right in stack]


def token_weights(sample: DataFrame) -> dict[str, float]:
    """Log-odds of the tokens that tell; ``sample``: ``text, label``, of bounded size, so its vocabulary is bounded."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for t in {f for t in set(tokens(text)) for f in forms(t)}:  # uses by text: a repeated passage tells no more
                    seen.setdefault(t, [0, 0])[label] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in seen.items()], columns=["token", "clean", "toxic"])

    counts = sample.mapInPandas(count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts)
    clean, toxic = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    if not clean or not toxic:
        return {}
    prior = PRIOR * (F.col("clean") + F.col("toxic"))
    odds = lambda n, total: F.log((n + prior) / (total + PRIOR * (clean + toxic) - n - prior))
    delta = odds(F.col("toxic"), toxic) - odds(F.col("clean"), clean)
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    rows = counts.where(F.greatest("clean", "toxic") >= LEAST).select("token", delta.alias("w"), z.alias("z")).where(F.abs("z") >= SURE)
    return {r["token"]: r["w"] for r in rows.collect()}  # tokens of a bounded sample


def tail_rate(shares: dict[float, float], drift: float = DRIFT) -> float:
    """The rate of the score's tail in ordinary text: the positive root of E[exp(rate * weight)] = 1.

    shares: of the ordinary tokens that have each weight; the others have ``drift``.
    """
    rest = 1 - sum(shares.values())
    f = lambda r: rest * math.exp(r * drift) + sum(p * math.exp(min(700.0, r * w)) for w, p in shares.items()) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return (low + high) / 2


def features(text: str | None, known: Known, rate: float) -> tuple[float, int, list[tuple[int, int, float]]]:
    """The largest normalised segment score, how many tokens significant segments gain, and those segments."""
    words = tokens(text)
    w = known.along(words)
    places = np.nonzero(w)[0].tolist()
    found = segments(places, w[places].tolist(), len(words)) if places else []
    base = math.log(max(1, len(words)))
    x = [(a, b, rate * s - base) for a, b, s in found]
    sure = [v for v in x if 1 - math.exp(-math.exp(-min(50.0, max(-6.0, v[2])))) <= SIGNIFICANT]
    return max((v[2] for v in x), default=-base), int(sum((w[a:b] > 0).sum() for a, b, _ in sure)), sure


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
    return w


def rising_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic curve of both measures, none of which may lower a score: one that would is left out, and the other fitted alone (flat if it would too)."""
    w = _logistic(x, y)
    for k in (0, 1):
        if w[1 + k] < 0:
            other = 1 - k
            rest = _logistic(x[:, [other]], y)
            if rest[1] < 0:
                return np.array([_logistic(x[:, :0], y)[0], 0.0, 0.0])
            w = np.array([rest[0], 0.0, 0.0])
            w[1 + other] = rest[1]
            break
    return w


class Model:
    """Weights, the tail's rate, and the curve; ``score`` needs nothing else."""

    def __init__(self, weights: dict[str, float], rate: float, curve: np.ndarray):
        self.known, self.rate, self.curve = Known(weights), rate, curve

    def __reduce__(self):
        return Model, (self.known.weights, self.rate, self.curve)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        x, n, sure = features(text, self.known, self.rate)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve @ [1, min(x, 40.0), math.log1p(n)]))))), sure


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """Without labels of both kinds, a model that scores every text by the labels' mean (0 if there are none)."""
    sample = written(labelled_sample(documents, labels, "toxic", bound))
    weights = token_weights(sample)
    y_mean = sample.agg(F.avg("label")).first()[0] or 0.0
    if not weights:
        return Model({}, 1.0, np.array([math.log((y_mean + 1e-6) / (1 - y_mean + 1e-6)), 0, 0]))

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(weights)
        for batch in batches:
            w = np.concatenate([np.zeros(0), *(known.along(tokens(t)) for t in batch["text"])])
            value, n = np.unique(w, return_counts=True)
            yield pd.DataFrame({"w": value, "n": n})

    clean = {r["w"]: r["n"] for r in sample.where("label = 0").mapInPandas(used, "w double, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    total = sum(clean.values()) or 1
    rate = tail_rate({w: n / total for w, n in clean.items() if w})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(weights)
        for batch in batches:
            yield pd.DataFrame([(*features(t, known, rate)[:2], y) for t, y in zip(batch["text"], batch["label"], strict=True)], columns=["x", "n", "y"])

    at = sample.mapInPandas(measure, "x double, n long, y long").toPandas()  # `bound` rows of three numbers
    return Model(weights, rate, rising_curve(np.column_stack([at["x"].clip(upper=40.0), np.log1p(at["n"])]), at["y"].to_numpy(float)))


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """documents with ``toxic_score`` and ``toxic_passages`` (token ranges of significant segments with their normalised scores).

    Null and empty texts have no tokens and get the curve's value there. Other columns pass through; columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # tokens of a bounded sample

    @F.pandas_udf("score double, passages array<struct<first:int,end:int,score:double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.score(t) for t in texts]
        return pd.DataFrame({"score": [r[0] for r in rows], "passages": [[{"first": a, "end": b, "score": s} for a, b, s in r[1]] for r in rows]})

    kept = [c for c in documents.columns if c not in ("toxic_score", "toxic_passages")]
    both = "scored_" + "_".join(kept)  # longer than any column's name
    out = documents.select(*kept, scored(F.col("text").cast("string")).alias(both))
    return out.select(*kept, out[both]["score"].alias("toxic_score"), out[both]["passages"].alias("toxic_passages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; rows that share an id are scored by their own texts, and one of them is learned from."""
    documents = table(spark, sf_dir, "documents")
    scored = toxicity(documents.select("doc_id", "text"), fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= CUT).cast("int").alias("predicted"))
