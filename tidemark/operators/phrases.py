"""Weighted key words and phrases of each text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stem import Stems

#: How many words and how many pairs of words are candidates, and the weight of a pair against a word.
WORDS, PAIRS, PAIR_WEIGHT = 30, 20, 1.5


def key_phrases(df: DataFrame, key: str, words: Column, n: int = 10, stemmed: bool = False) -> DataFrame:
    """``key, rank, phrase, weight``: the ``n`` heaviest of each text's commonest words and pairs of neighbouring words, of equals the least.

    stemmed: words of one stem count together, and are shown as the commonest of them (then the least). Counts never leave the row of their text, so nothing is shuffled.
    Texts without words have no rows.
    """
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stems = Stems()
        for batch in batches:
            rows = []
            for k, ws in zip(batch["k"], batch["w"], strict=True):
                if ws is None or not len(ws):
                    continue
                ws = list(ws)
                if stemmed:
                    forms: dict[str, tuple[int, str]] = {}
                    for w, c in Counter(ws).items():
                        forms[stems[w]] = min(forms.get(stems[w], (0, "")), (-c, w))
                    ws = [forms[stems[w]][1] for w in ws]
                ranked = lambda c, most: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]
                found = [(-float(c), w) for w, c in ranked(Counter(ws), WORDS)] + [(-PAIR_WEIGHT * c, p) for p, c in ranked(Counter(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)), PAIRS)]
                rows += [(k, i + 1, p, -less) for i, (less, p) in enumerate(sorted(found)[:n])]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "rank", "phrase", "weight"])

    out = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), words.alias("w")).mapInPandas(run, f"key {key_type}, rank int, phrase string, weight double")
    return out.withColumnRenamed("key", key)
