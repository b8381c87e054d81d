"""Removal of repeated passages by Rabin-Karp hashes of every window of WINDOW words.

1. Texts are exploded to the distinct hashes of their windows: ``window, doc``. Hashes roll over the words of many texts at once (prefix sums of
   word hashes times powers of an odd base, modulo 2 to the 64th).
2. Rows are dealt out by window; the least document of each window stands beside each row, and rows of later documents are kept.
3. They return to their documents, whose windows are hashed once more; the repeated ones merge into maximal intervals of words, which go.

The HOT commonest windows of one document in SAMPLE_ONE_IN are combined where they are exploded: one row for each task. What is left of any window
is below one row in HOT, so no key is large. Their least documents, HOT numbers at most, are broadcast for step 3.
Windows are known by a 64-bit hash (of 10 billion different ones about three pairs share one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import commonest, shuffles_cleaned, table, written

WINDOW, HOT, SAMPLE_ONE_IN, CACHE, TOGETHER = 13, 1 << 18, 32, 200_000, 1 << 17
BASE = 0x9E3779B97F4A7C15
INTERVALS = "array<struct<start:long,end:long>>"


class Hasher:
    """Word hashes with a bounded memory of words met, and the rolling hashes of windows."""

    def __init__(self, window: int):
        import xxhash

        hashed = xxhash.xxh64_intdigest

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = value = hashed(word)
                return value

        self.window, self.known = window, Known()
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, texts: list[str | None]) -> list[list[bytes]]:
        """Words by ASCII blanks; a null text has none."""
        return [text.encode("utf-8", "surrogatepass").split() if text else [] for text in texts]

    def windows(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``text, start, hash`` of every window of every text."""
        if len(self.known) > CACHE:
            self.known.clear()
        w = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if len(self.up) < len(w) + self.window:
            n = 2 * (len(w) + self.window)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))
        sums = np.append(np.uint64(0), np.cumsum(w * self.down[: len(w)]))
        k = max(0, len(w) - self.window + 1)
        rolled = (sums[self.window : self.window + k] - sums[:k]) * self.up[self.window - 1 : self.window - 1 + k]
        text = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = (start + self.window <= np.repeat(sizes, sizes))[:k]
        return text[:k][inside], start[:k][inside], rolled[inside].view(np.int64)


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with about TOGETHER words at once, or one long text."""
    for batch in batches:
        size = batch["text"].str.len().fillna(0).to_numpy(np.int64) + 1
        block = np.cumsum(size) // (7 * TOGETHER)
        for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(block)) + 1):
            if len(at):
                yield batch.iloc[at]


def _found(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _hot(docs: DataFrame, window: int, most: int) -> np.ndarray:
    """The hashes, sorted, of the ``most`` commonest windows of the sampled documents; ids are sampled, so copies are met by their share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(window)
        for rows in _together(batches):
            text, _, key = hasher.windows(hasher.words(rows["text"].tolist()))
            key, n = np.unique(key, return_counts=True)
            yield pd.DataFrame({"window": key, "n": n})

    picked = docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE_ONE_IN)) == 0)
    return commonest(picked.mapInPandas(run, "window long, n long").groupBy("window").agg(F.sum("n").alias("n")), "window", most)


def _exploded(docs: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """``window, doc, hot``: each document's distinct windows; of hot ones the least document of the task."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, keys = Hasher(window), shared.value
        least = np.full(len(keys), np.iinfo(np.int64).max)
        met = np.zeros(len(keys), bool)
        for rows in _together(batches):
            text, _, key = hasher.windows(hasher.words(rows["text"].tolist()))
            doc = rows["doc"].to_numpy(np.int64)[text]
            at = _found(keys, key)
            known = at >= 0
            np.minimum.at(least, at[known], doc[known])
            met[at[known]] = True
            key, doc = key[~known], doc[~known]
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            first = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
            yield pd.DataFrame({"window": key[first], "doc": doc[first], "hot": False})
        yield pd.DataFrame({"window": keys[met], "doc": least[met], "hot": True})

    return docs.where("doc is not null").mapInPandas(run, "window long not null, doc long not null, hot boolean not null")


def _covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words (end exclusive) that windows from the sorted ``starts`` cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + window).tolist(), strict=True))


def repeated_passages(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, intervals, n_removed, kept, kept_sha256`` for every row of documents (``doc_id, text``; other columns aren't read).

    intervals: the maximal runs of words (from 0, end exclusive) of windows that start in a document of a smaller id too; kept: the other words,
    joined by one space. Null and empty texts, and those of fewer words than a window, lose nothing. Rows that share an id are judged each by its own text,
    and neither is smaller. Rows with a null id lose nothing and take nothing from others. Texts are read whole; one very long text is one row of a batch.
    An empty table gives none.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    first = F.expr("min(doc) OVER (PARTITION BY window)")
    with shuffles_cleaned(docs.sparkSession):  # the exchange of windows is the largest, and gone before texts are dealt out
        exploded = _exploded(docs, window, _hot(docs, window, HOT)).repartition("window")
        later = written(exploded.withColumn("first", first).where("hot OR first < doc").withColumn("first", F.expr("if(hot, first, null)")))
    firsts = later.where("hot").groupBy("window").agg(F.min("first").alias("first")).toPandas().sort_values("window")  # HOT rows at most
    shared = docs.sparkSession.sparkContext.broadcast((firsts["window"].to_numpy(np.int64), firsts["first"].to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, (keys, least) = Hasher(window), shared.value
        for rows in _together(batches):
            words = hasher.words(rows["text"].tolist())
            text, start, key = hasher.windows(words)
            bounds = np.searchsorted(text, np.arange(len(words) + 1))
            out = []
            for i, (doc, ours, w) in enumerate(zip(rows["doc"].astype("Int64"), rows["windows"], words, strict=True)):
                k, places = key[bounds[i] : bounds[i + 1]], start[bounds[i] : bounds[i + 1]]
                gone = np.zeros(len(k), bool)
                if len(k) and doc is not pd.NA:
                    at = _found(keys, k)
                    gone = (at >= 0) & (least[at] < doc) if len(keys) else gone
                    if ours is not None:
                        gone = gone | (_found(np.sort(np.asarray(ours, np.int64)), k) >= 0)
                spans, kept, end = _covered(places[gone], window), [], 0
                for a, b in spans:
                    kept += w[end:a]
                    end = b
                kept = b" ".join(kept + w[end:] if spans else w)
                out.append((doc, len(w), [{"start": a, "end": b} for a, b in spans], sum(b - a for a, b in spans), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "intervals", "n_removed", "kept", "kept_sha256"]).astype({"doc_id": "Int64"})

    ours = later.where("NOT hot").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("window").alias("windows"))  # at most a document's own windows
    dealt = F.when(F.col("doc").isNull(), F.xxhash64("text")).otherwise(F.col("doc"))  # null ids are dealt out by their texts, and lose nothing whatever they meet
    texts = docs.join(ours, dealt == F.col("_doc"), "left").select("doc", "text", "windows")
    return texts.mapInPandas(run, f"doc_id long, n_words long, intervals {INTERVALS}, n_removed long, kept string, kept_sha256 string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of all documents; edge cases as in ``repeated_passages``."""
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_OP11 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM s),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM p GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN p ON e.doc_id = p.doc_id AND e.i = p.p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
