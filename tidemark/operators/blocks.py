"""Texts' words by blocks of texts. A block lists its distinct words once, so a word meets the other blocks once for each block, not once for each text, and a text's words stay beside it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.operators.graph import written

#: Texts and different words of texts in a block at most (one text may have more words), and blocks that a table is cut into if that makes them no smaller than LEAST words.
TEXTS, ENTRIES, LEAST, CUTS = 8192, 1 << 21, 1 << 17, 16


def arrow(schema: str) -> pa.Schema:
    """A schema as Python workers give it back."""
    return to_arrow_schema(StructType.fromDDL(schema))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes."""
    return pickle.dumps([(x.dtype.str, x.nbytes, pa.compress(np.ascontiguousarray(x), "zstd", asbytes=True) if x.nbytes else b"") for x in arrays])


def unpacked(data: bytes) -> list[np.ndarray]:
    return [np.frombuffer(pa.decompress(x, size, "zstd", asbytes=True) if size else b"", kind) for kind, size, x in pickle.loads(data)]


def one(kind: pa.DataType, values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type), type=kind)


def starts_of(doc: np.ndarray, texts: int) -> np.ndarray:
    return np.r_[0, np.cumsum(np.bincount(doc, minlength=texts))].astype(np.int64)


def texts_of(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each word is in ``known``, which is in order; -1 where it isn't."""
    if not len(known):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _counter(schema: pa.Schema, most: int):
    """Batches of ``key, h`` become rows of blocks."""

    def row(number: int, keys: list, docs: list, words: list, counts: list, texts: int) -> pa.RecordBatch:
        doc, word, n = np.concatenate(docs), np.concatenate(words), np.concatenate(counts)
        known, at = np.unique(word, return_inverse=True)
        mix = _mixed(word.astype(np.uint64) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        signs = [np.zeros(texts, np.uint64) for _ in range(2)]
        for sign, more in zip(signs, (mix, _mixed(mix + np.uint64(1))), strict=True):
            starts = starts_of(doc, texts)
            full = np.flatnonzero(np.diff(starts))
            if len(full):
                sign[full] = np.add.reduceat(more, starts[full])
        block = (TaskContext.get().partitionId() << 32) + number
        data = packed(starts_of(doc, texts).astype(np.int32), at.astype(np.int32), n.astype(np.int32))
        column = lambda x, name: one(schema.field(name).type, pa.array(x))
        many = np.bincount(at, minlength=len(known))
        return pa.record_batch([pa.array([block]), pa.array([len(doc)]), one(schema.field("keys").type, pa.concat_arrays(keys)), *(column(s.view(np.int64), k) for k, s in zip(("s1", "s2"), signs, strict=True)), column(known, "words"), column(many, "texts"), pa.array([data], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, words, counts, texts, entries, number = [], [], [], [], 0, 0, 0
        for batch in batches:
            low, ends = 0, batch.column(1).offsets.to_numpy()
            while low < len(batch):
                high = max(low + 1, min(low + 1024, int(np.searchsorted(ends, ends[low] + most // 2)) - 1))
                part, low = batch.slice(low, high - low), high
                h = part.column(1)
                size = np.diff(h.offsets.to_numpy())
                doc, word = np.repeat(np.arange(len(part)), size), h.flatten().to_numpy(zero_copy_only=False)
                order = np.lexsort((word, doc))
                doc, word = doc[order], word[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]) if len(doc) else np.zeros(0, int)
                keys, docs, words, counts = [*keys, part.column(0)], [*docs, doc[new] + texts], [*words, word[new]], [*counts, np.diff(np.r_[new, len(doc)])]
                texts, entries = texts + len(part), entries + len(new)
                if texts >= TEXTS or entries >= most:
                    yield row(number, keys, docs, words, counts, texts)
                    keys, docs, words, counts, texts, entries, number = [], [], [], [], 0, 0, number + 1
        if texts:
            yield row(number, keys, docs, words, counts, texts)

    return run


def counted(df: DataFrame, key: str, words: Column, most: int | None = None) -> DataFrame:
    """``block, grp, entries, keys, s1, s2, words, texts, data``, written: a row for each block of texts, whose distinct words (64-bit hashes, in order) stand beside the texts that have them.

    ``data`` has the entries: where each text's begin, places of words and counts. ``s1, s2`` are 128 bits of each text's words and counts. Texts that share a key are one. Small blocks that follow each other have one ``grp``, of ``most`` entries (ENTRIES) or little more.
    """
    most = most or ENTRIES
    rows = df.select(F.col(key).alias("key"), F.coalesce(words, F.array().cast("array<long>")).alias("h"))
    many = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key")
    if not many.isEmpty():
        same = F.col("key").eqNullSafe(F.col("_key"))
        again = rows.join(many, same, "left_semi").groupBy("key").agg(F.flatten(F.collect_list("h")).alias("h"))
        rows = rows.join(many, same, "left_anti").unionByName(again)
    kind = df.schema[key].dataType.simpleString()
    schema = f"block long, entries long, keys array<{kind}>, s1 array<long>, s2 array<long>, words array<long>, texts array<int>, data binary"
    spark = df.sparkSession
    blocks = written(rows.mapInArrow(_counter(arrow(schema), most), schema))
    sizes = sorted((r["block"], r["entries"], r["n"]) for r in blocks.select("block", "entries", F.size("keys").alias("n")).collect())
    most, grp, texts, entries, of = min(most, max(LEAST, sum(s[1] for s in sizes) // CUTS)), 0, 0, 0, []
    for block, e, n in sizes:
        if texts and (texts + n > TEXTS or entries + e > most):
            grp, texts, entries = grp + 1, 0, 0
        of, texts, entries = [*of, (block, grp)], texts + n, entries + e
    out = blocks.join(F.broadcast(spark.createDataFrame(of, "block long, grp long")), "block")
    out._written_to = blocks._written_to
    return out


def merged(left: pa.Table, shared: np.ndarray, many: np.ndarray, total: int, dropped: pa.Table | None = None, shared_only: bool = False) -> tuple:
    """Blocks of a group as one: keys, words, starts, places of words, counts, weights of words, lengths of whole texts, and where a text of a block is (-1: it has no key or no word, or is ``dropped``).

    shared: words of more than one text, in order; many: how many texts have them. A word's weight is ln((1 + total) / (1 + texts)) + 1.
    """
    lists = [w.values.to_numpy(zero_copy_only=False) for w in left.column("words")]
    known = shared if shared_only else np.unique(np.concatenate([np.zeros(0, np.int64), *lists]))
    weight = lambda at: np.log((1 + total) / (1 + (np.where(at >= 0, many[at], 1) if len(many) else np.ones(len(at))))) + 1
    keys, docs, ats, counts, norms, where, texts = [], [], [], [], [], {}, 0
    out = {}
    if dropped is not None:
        block, pos = (dropped.column(k).to_numpy() for k in ("x", "y"))
        out = {b: pos[block == b] for b in np.unique(block)}
    for i, block in enumerate(left.column("block").to_pylist()):
        starts, at, n = unpacked(left.column("data")[i].as_py())
        doc, own = texts_of(starts), left.column("keys")[i].values
        keep = (np.diff(starts) > 0) & own.is_valid().to_numpy(zero_copy_only=False)
        keep[out.get(block, [])] = False
        norm = np.sqrt(np.bincount(doc, (n * weight(places(lists[i], shared))[at]) ** 2, minlength=len(keep)))
        place = places(lists[i], known)[at]
        of = np.where(keep, np.cumsum(keep) - 1 + texts, -1)
        entry = keep[doc] & (place >= 0)
        keys, docs, ats, counts, norms = [*keys, own.filter(pa.array(keep))], [*docs, of[doc[entry]]], [*ats, place[entry]], [*counts, n[entry]], [*norms, norm[keep]]
        where[block], texts = of, texts + int(keep.sum())
    return pa.concat_arrays(keys), known, starts_of(np.concatenate(docs), texts), np.concatenate(ats), np.concatenate(counts), weight(places(known, shared)), np.concatenate(norms), where


def shared_words(blocks: DataFrame) -> DataFrame:
    """``grp, kind (0), x, y``: words of each group that more than one text has, and how many have them."""
    asked = blocks.select("grp", F.explode(F.arrays_zip("words", "texts")).alias("w")).groupBy("grp", F.col("w.words").alias("x")).agg(F.sum("w.texts").alias("n"))
    return asked.select("grp", F.lit(0).alias("kind"), "x", F.sum("n").over(Window.partitionBy("x")).alias("y")).where("y > 1")


def of_kind(right: pa.Table, kind: int) -> pa.Table:
    return right.filter(pa.array(right.column("kind").to_numpy() == kind)) if len(right) else right


def known_words(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Words in order and how many texts have them, of the rows of ``shared_words``."""
    rows = of_kind(right, 0)
    x, y = (rows.column(k).to_numpy() for k in ("x", "y"))
    order = np.argsort(x)
    return x[order], y[order]
