"""Best-fit packing: documents become token sequences of a fixed length with as little padding as best-fit decreasing leaves.

Every task tokenizes its own texts and cuts what is longer than a sequence. The
packing itself depends only on how many pieces have each length, and there are at
most ``capacity`` lengths, whatever the size of the corpus: the driver gets that
histogram and runs best-fit decreasing on it, taking all pieces of one length at
once. A segment tree over remaining capacities gives the tightest open bin class in
logarithmic time. The moves it makes (length, rank range, bin range, offset) go back
to the pieces, which are numbered within their length in salted groups.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from llm.common import table, written

CAPACITY, END_ID, CACHE = 4096, 1, 400_000
#: Text of one byte pair model: what a word-level piece is.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts, equal to the tokenizer's own, with a bounded cache by chunk.

    White space never reaches the model, so a text's ids are those of its chunks between
    ASCII blanks. A chunk of Latin letters, digits and marks is encoded by rank merges; one with
    other characters, or with what may be a special token, by the tokenizer itself.
    """

    def __init__(self, path: str):
        import json
        import os

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.plain = regex.compile(r"[\x21-\x7E\xA1-ɏ]+").fullmatch
        self.find = regex.compile(PIECES).findall
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printed)]
        byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {}
        for token, rank in vocab.items():
            if token.startswith("<|"):
                continue
            ended = token.endswith("</w>") and token != "</w>"
            ranks[bytes(byte_of[c] for c in (token[:-4] if ended else token)) + b"\0" * ended] = rank
        self.fast = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {"": b""}

    def chunk(self, word: str) -> bytes:
        if self.plain(word) and "<|" not in word:
            ids = self.fast.encode_ordinary("\0".join(self.find(unicodedata.normalize("NFC", word).lower())) + "\0")
        else:
            ids = self.slow.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        words = re.split("[ \n\t\r]+", text)
        cache = self.cache
        if len(cache) > CACHE:
            cache = self.cache = {"": b""}
        for word in set(words).difference(cache):
            cache[word] = self.chunk(word)
        return b"".join([cache[w] for w in words])


def token_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as binary, if asked for) of every document.

    A null or empty text is the closing id alone. Repeated rows give repeated pieces.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(path)
        close = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = encoder.encode(text) + close
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part), part)[: 5 + ids])
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, fields)


class CapacityTree:
    """Segment tree over remaining capacities 0..n: does any bin have it; the smallest one at or above a length in O(log n)."""

    def __init__(self, n: int):
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.some = np.zeros(2 * self.size, bool)

    def put(self, capacity: int, some: bool) -> None:
        k = self.size + capacity
        self.some[k] = some
        while k > 1:
            k //= 2
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def tightest(self, length: int) -> int:
        """-1 if there is none."""
        k = self.size + length
        if self.some[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.some[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k + (not self.some[2 * k])
                return k - self.size
            k //= 2
        return -1


def best_fit_moves(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on (length -> count): moves (length, first rank, end rank, first bin, offset).

    Equal pieces are placed together: the open bins of one remaining capacity are ranges of bin
    numbers. A piece that finds no open bin opens a new one.
    """
    tree, open_bins, moves, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.tightest(length)
            if room < 0:
                room, first, n = capacity, bins, count - rank
                bins += -(-n // (capacity // length))
                n = bins - first
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
            each = room // length  # a bin that took one is the tightest for the next, until it is full
            full = min(n, (count - rank) // each)
            for layer in range(each if full else 0):
                moves.append((length, rank, rank + full, first, capacity - room + layer * length))
                rank += full
            _open(open_bins, tree, room - each * length, first, full)
            if full < n:
                rest = min(count - rank, each - 1)
                for layer in range(rest):
                    moves.append((length, rank, rank + 1, first + full, capacity - room + layer * length))
                    rank += 1
                _open(open_bins, tree, room - rest * length, first + full, 1)
                _open(open_bins, tree, room, first + full + 1, n - full - 1)
    return moves


def _open(open_bins: dict, tree: CapacityTree, room: int, first: int, n: int) -> None:
    if room > 0 and n > 0:
        open_bins.setdefault(room, []).append((first, n))
        tree.put(room, True)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``piece`` and ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    The histogram has at most ``capacity`` rows. Pieces of one length may be most of the
    table, so they are numbered in salted groups whose first ranks come from the groups' counts;
    the salt is a hash of the id and repeats of a row stay apart by row number.
    An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    sized = pieces.groupBy("length").count().collect()  # one row for each length: at most `capacity`
    total = sum(r["count"] for r in sized)
    moves = best_fit_moves({r["length"]: r["count"] for r in sized}, capacity)
    salts = max(64, total // 50_000)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    first = counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_at", F.row_number().over(within)).join(first, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_at") - 1).drop("_salt", "_first", "_at")
    plan = np.array(moves, "int64").reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)  # bounded by the number of lengths, not by the corpus
    schema = T.StructType([*(f for f in ranked.schema if f.name != "_rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        width = plan[:, 2].max() + 1 if len(plan) else 1
        keys = plan[:, 0] * width + plan[:, 1]
        for batch in batches:
            k = np.searchsorted(keys, batch["length"].to_numpy() * width + batch["_rank"].to_numpy(), "right") - 1
            yield batch.drop(columns="_rank").assign(sequence_id=plan[k, 3] + batch["_rank"].to_numpy() - plan[k, 1], offset=plan[k, 4])

    return ranked.mapInPandas(place, schema)


def best_fit_packing(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Packs all documents; see ``token_pieces`` and ``pack``. With ``ids``, the token ids of every piece come along.

    Columns of the input other than ``doc_id`` and ``text`` aren't read.
    """
    return pack(written(token_pieces(documents, path or tokenizer_path(), capacity, end_id, ids)), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents`` with their sequences and offsets.

    Null and empty texts are one piece of the closing id alone; long texts are cut into whole pieces of 4,096 ids and the rest. Repeated rows and ids are packed each; pieces of equal length take
    their places in any order. Other columns aren't read; an empty table gives none.
    """
    return best_fit_packing(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
