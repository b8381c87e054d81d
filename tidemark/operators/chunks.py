"""Texts cut into overlapping chunks for retrieval, at the coarsest separators that let a chunk fit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paragraphs, lines, sentences, words.
LADDER = ("\n\n", "\n", ". ", " ")


def pieces(text: str, size: int, overlap: int, ladder: tuple[str, ...] = LADDER) -> list[int]:
    """Ends of consecutive pieces of at most ``size`` characters: what is longer is cut after each separator, what still is at the next finer one.

    A stretch without any separator is cut every ``overlap`` characters (``size`` without overlap).
    """
    ends: list[int] = []
    open_ = [(0, len(text), 0)]
    while open_:
        a, b, level = open_.pop()
        if b - a <= size:
            ends.append(b)
        elif level == len(ladder):
            ends += [*range(a + (overlap or size), b, overlap or size), b]
        else:
            cuts, at = [a], text.find(ladder[level], a, b)
            while at >= 0:
                cuts.append(at + len(ladder[level]))
                at = text.find(ladder[level], cuts[-1], b)
            if cuts[-1] != b:
                cuts.append(b)
            open_ += [(x, y, level + 1) for x, y in zip(cuts[-2::-1], cuts[:0:-1], strict=True)]
    return ends


def spans(text: str, size: int, overlap: int, ladder: tuple[str, ...] = LADDER) -> list[tuple[int, int]]:
    """Chunks as (start, end): as many whole pieces as fit, starting again with the pieces that lie within the last ``overlap`` characters and leave room for the next."""
    ends = pieces(text, size, overlap, ladder) if text else []
    starts, out, i = [0, *ends[:-1]], [], 0
    j = 0  # pieces before j are in a chunk
    while j < len(ends):
        while i < j and (starts[i] < ends[j - 1] - overlap or ends[j] - starts[i] > size):
            i += 1
        while j < len(ends) and ends[j] - starts[i] <= size:
            j += 1
        out.append((starts[i], ends[j - 1]))
    return out


def chunked(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50, ladder: tuple[str, ...] = LADDER) -> DataFrame:
    """``key, chunk, start, end, text`` (chunk from 0; code points, end exclusive) for every text.

    A chunk has ``size`` characters at most. Chunks cover the whole text; the next one starts within the last ``overlap`` characters of the one before, or where it ends. Null and
    empty texts have none.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is at least 0 and below the size")
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, value in zip(batch["k"], batch["t"], strict=True):
                found = spans(value or "", size, overlap, ladder)
                if found:
                    yield pd.DataFrame({"key": pd.Series([k] * len(found), dtype="Int64" if key_type in ("bigint", "int") else "object"), "chunk": range(len(found)), "start": [a for a, _ in found], "end": [b for _, b in found], "text": [value[a:b] for a, b in found]})

    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(run, f"key {key_type}, chunk int, start long, end long, text string")
    return out.withColumnRenamed("key", key)
