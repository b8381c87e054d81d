"""Quality by a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairs
of features interact through RANK factors, in time linear in the features that a text has. The machine is
fitted by AdaGrad on at most BOUND labelled rows; every text is scored in its own task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import held_out, labelled_sample, table, written

BOUND, BUCKETS, RANK, EPOCHS, BATCH, RATE, DECAY, CUT, CACHE = 8_000, 1 << 12, 8, 12, 64, 0.05, 1e-4, 0.5, 500_000
STATS = ("log_words", "log_chars", "mean_word", "distinct", "upper", "digits", "marks", "odd_marks", "repeated_lines", "short_lines", "blank", "bars", "not_ascii", "letters", "sentence", "top_word")
_ODD, _MARKS = re.compile(r"[#$%&*|<>{}\\^~=_+!]"), re.compile(r"[^\w\s]")
_UPPER, _DIGITS, _LETTERS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+")


class Features:
    """Sparse features of texts: structure statistics first, then hashed words of unit length."""

    def __init__(self, buckets: int = BUCKETS):
        import xxhash

        hashed = xxhash.xxh3_64_intdigest

        class Known(dict):
            def __missing__(self, word: str) -> int:
                self[word] = value = hashed(word) % buckets
                return value

        self.known = Known()

    def stats(self, text: str, words: list[str]) -> list[float]:
        n, m = max(1, len(text)), max(1, len(words))
        lines = text.split("\n")
        counts = np.bincount(np.unique(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), return_inverse=True)[1]) if words else np.zeros(1)
        return [
            np.log1p(len(words)), np.log1p(len(text)), min(20.0, (n - text.count(" ")) / m), len(set(words)) / m, len(_UPPER.findall(text)) / n,
            len(_DIGITS.findall(text)) / n, len(_MARKS.findall(text)) / n, len(_ODD.findall(text)) / n, 1 - len(set(lines)) / len(lines),
            sum(len(x) < 30 for x in lines) / len(lines), text.count(" ") / n, text.count("|") / m, (len(text.encode("utf-8", "replace")) - len(text)) / n,
            len(_LETTERS.findall(text)) / n, (text.count(".") + text.count("?")) / m, counts.max() / m,
        ]

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.lower().split()
        if len(self.known) > CACHE:
            self.known.clear()
        at, n = np.unique(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), return_counts=True)
        value = np.log1p(n)
        return np.concatenate([np.arange(len(STATS)), at + len(STATS)]), np.concatenate([self.stats(text, words), value / max(1e-9, np.sqrt((value**2).sum()))])


class Machine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.bias, self.linear, self.factors, self.mean, self.spread = bias, linear, factors, mean, spread

    def scaled(self, value: np.ndarray) -> np.ndarray:
        value = value.copy()
        value[: len(STATS)] = np.clip((value[: len(STATS)] - self.mean) / self.spread, -4, 4) / 4
        return value

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[at] * value[:, None]
        return float(self.bias + self.linear[at] @ value + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum()))


def _fitted(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, in mini-batches of texts."""
    rng = np.random.default_rng(seed)
    n = len(STATS) + BUCKETS
    stats = np.array([v[: len(STATS)] for _, v in rows])
    m = Machine(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(n), rng.normal(0, 0.02, (n, RANK)), stats.mean(0), stats.std(0) + 1e-6)
    xs = [m.scaled(v) for _, v in rows]
    g_bias, g_linear, g_factors = 1e-8, np.full(n, 1e-8), np.full((n, RANK), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([xs[i] for i in part])
            starts = np.cumsum([0, *(len(rows[i][0]) for i in part)])[:-1]
            lengths = np.diff([*starts, len(at)])
            vx = m.factors[at] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            margin = m.bias + np.add.reduceat(m.linear[at] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
            each = np.repeat(error, lengths)
            d_linear = np.bincount(at, each * x, n) + DECAY * m.linear
            d_each = each[:, None] * (x[:, None] * np.repeat(sums, lengths, 0) - vx * x[:, None])
            d_factors = np.stack([np.bincount(at, d_each[:, f], n) for f in range(RANK)], 1) + DECAY * m.factors
            d_bias = error.sum()
            g_bias, g_linear, g_factors = g_bias + d_bias**2, g_linear + d_linear**2, g_factors + d_factors**2
            m.bias -= RATE * d_bias / np.sqrt(g_bias)
            m.linear -= RATE * d_linear / np.sqrt(g_linear)
            m.factors -= RATE * d_factors / np.sqrt(g_factors)
    return m


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> Machine:
    """Without labels of both kinds, a machine that scores every text by the labels' mean (one half if there are none)."""
    sample = labelled_sample(documents, labels, "quality", bound)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            rows = [features.of(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "at": [r[0].astype("<i4").tobytes() for r in rows], "value": [r[1].astype("<f4").tobytes() for r in rows], "label": batch["label"]})

    made = sample.mapInPandas(run, "doc_id long, at binary, value binary, label int")
    rows = sorted(written(made).collect(), key=lambda r: (r["doc_id"], r["at"]))  # `bound` sparse rows
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        n = len(STATS) + BUCKETS
        return Machine(float(np.log(mean / (1 - mean))), np.zeros(n), np.zeros((n, RANK)), np.zeros(len(STATS)), np.ones(len(STATS)))
    return _fitted([(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in rows], y)


def quality(documents: DataFrame, machine: Machine) -> DataFrame:
    """documents with ``quality_score`` (0 to 1). Null and empty texts have structure statistics of zero words. Other columns pass through; one of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, machine = Features(), shared.value
        for texts in batches:
            margins = []
            for text in texts:
                at, value = features.of(text)
                margins.append(machine.margin(at, machine.scaled(value)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(margins, float), -30, 30))))

    return documents.drop("quality_score").withColumn("quality_score", scored(F.col("text").cast("string")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; rows that share an id are scored by their own texts, and one of them is learned from."""
    documents = table(spark, sf_dir, "documents")
    scored = quality(documents.select("doc_id", "text"), fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
