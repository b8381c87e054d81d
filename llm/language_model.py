"""Stupid-backoff scores of every document under the n-gram counts of a whole corpus, as joins of tables.

score(w | context) is count(context w) / count(context) where ``context w`` occurs LEAST times or more, else
ALPHA * score(w | the context without its first word); a word alone has count(w) / tokens. A document's score is the
sum of the natural logs over its words.

1. Texts are exploded to n-grams of all orders, combined by document: ``gram, doc, m`` (occurrences) and ``w``, how often
   the document's score adds the log of the gram's count (as a numerator) less how often it takes it off (as a context).
2. The count table sums ``m`` by gram; tables and exploded n-grams are dealt out by the gram's hash, in one exchange.
3. Counts are joined to the exploded n-grams, and ``w * log(count)`` is summed by document.

Where rare n-grams don't count (LEAST above 1, as in the query) whole chunks of texts are dealt with instead: see ``_returned_scores``.

In 1 to 3 the counts of the HOT n-grams that are commonest in one text in SAMPLE_ONE_IN come first, over all texts; that table of
fixed size is broadcast, and its n-grams are scored where they are exploded, so no key holds a large share of the exchange.
An n-gram is known by a 64-bit hash of 63-bit word hashes (of 10 billion different n-grams about three pairs share one).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import UPPER, commonest, discard, shuffles_cleaned, table, written

ORDER, LEAST, ALPHA, HOT, SAMPLE_ONE_IN, CACHE, TOGETHER = 3, 1, 0.4, 1 << 18, 32, 200_000, 1 << 16
#: Words of a chunk of texts, and n-grams of a range of keys at most.
CHUNK, PART = 1 << 19, 1 << 20
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Words:
    """Word hashes of texts; words by ASCII blanks, A-Z lower-cased."""

    def __init__(self):
        import xxhash

        hashed = xxhash.xxh64_intdigest

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = value = hashed(word) >> 1
                return value

        self.known = Known()

    def of(self, *texts: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of the texts, one text after the other, and each text's number of words."""
        words = [text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else [] for text in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64), np.fromiter(map(len, words), np.int64, len(words))


def together(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str | None]]]:
    """The ``doc`` and ``text`` columns in lists of about TOGETHER words, or of one long text."""
    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc"].astype("Int64"), batch["text"], strict=True):
            docs.append(doc)
            texts.append(text)
            size += len(text or "") + 20
            if size >= 6 * TOGETHER:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The keys of all n-grams, from each place but the last n - 1."""
    k = max(0, len(words) - n + 1)
    h = np.full(k, n, np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + k]) * _ODD[0]
        h ^= h >> np.uint64(29)
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def weighted(words: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every n-gram of 1 to ``order`` words of texts put together: the text's number, the key, and its weight where nothing backs off.

    The word at place p is scored with the min(order, p + 1) words up to it, and its context takes its count off.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    out = []
    for n in range(1, order + 1):
        k = max(0, len(words) - n + 1)
        inside = place[:k] + n <= size[:k]
        p, m = place[:k][inside], size[:k][inside]
        if n == order:
            w = np.ones(len(p), np.int64)
        else:
            w = (p == 0).astype(np.int64) - ((p + n < m) & ((n == order - 1) | (p == 0)))
        out.append((text[:k][inside], grams(words, n)[inside], w))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def combined(text: np.ndarray, key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, key, m, w``: how often each key occurs in each text, and its weights' sum."""
    order = np.lexsort((key, text))
    text, key, w = text[order], key[order], w[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return text[first], key[first], np.diff(np.append(first, len(key))), np.add.reduceat(w, first) if len(first) else w


class Places:
    """Places of keys in a sorted list, by a table of their leading bits; what shares a slot there is searched for."""

    def __init__(self, keys: np.ndarray, bits: int | None = None):
        self.bits = bits = max(16, min(22, len(keys).bit_length() + 2)) if bits is None else bits
        self.keys, self.place = keys, np.full(1 << bits, -1, np.int32)
        slots = self._slots(keys)
        self.place[slots[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.shared = np.bincount(slots, minlength=1 << bits) > 1
        self.held = np.zeros(1 << bits, np.int64)
        self.held[slots[::-1]] = keys[::-1]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """-1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        slots = self._slots(keys)
        hit = self.held[slots] == keys
        at = np.where(hit, self.place[slots], -1)
        rest = np.flatnonzero(~hit & self.shared[slots])
        k = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
        at[rest] = np.where(self.keys[k] == keys[rest], k, -1)
        return at


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def _commonest(docs: DataFrame, order: int, most: int) -> np.ndarray:
    """The keys, sorted, of the ``most`` commonest n-grams of the sampled texts (sampled by their own hash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for _, texts in together(batches):
            key, n = np.unique(weighted(*words.of(*texts), order)[1], return_counts=True)
            yield pd.DataFrame({"gram": key, "n": n})

    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0)
    return commonest(picked.mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "gram", most)


def _hot_counts(docs: DataFrame, order: int, keys: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of ``keys`` occurs in all texts, and how many words there are."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)  # HOT at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, places, total = Words(), Places(shared.value), 0
        seen = np.zeros(len(places.keys) + 1, np.int64)  # the last for keys that aren't there
        for _, texts in together(batches):
            w, sizes = words.of(*texts)
            total += len(w)
            seen += np.bincount(places.of(weighted(w, sizes, order)[1]) % len(seen), minlength=len(seen))
        place = np.flatnonzero(seen[:-1])
        yield pd.DataFrame({"place": np.append(place, -1), "n": np.append(seen[place], total)})

    rows = docs.mapInPandas(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    place, n = rows["place"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    counts = np.zeros(len(keys), np.int64)
    counts[place[place >= 0]] = n[place >= 0]
    return counts, int(n[place < 0].sum())


def _exploded(docs: DataFrame, order: int, keys: np.ndarray, counts: np.ndarray, tokens: int) -> DataFrame:
    """``gram, doc, m, w, part, n``: a row for each document and n-gram that isn't hot, and one for each row of ``docs`` (m and w 0) with its words ``n``
    and the part of its score that needs no other count."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, np.log(np.maximum(counts, 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, places, logs, made = Words(), Places(shared.value[0]), shared.value[1], 0
        for docs, texts in together(batches):
            w, n = words.of(*texts)
            text, key, weight = weighted(w, n, order)
            at = places.of(key)
            known = at >= 0
            part = np.bincount(text[known], weight[known] * logs[at[known]] if known.any() else np.zeros(0), len(n)).astype(float) - np.log(tokens) * (n if order == 1 else np.minimum(n, 1))
            text, key, m, weight = combined(text[~known], key[~known], weight[~known])
            doc, zeros = pd.array(docs, "Int64"), np.zeros(len(n), np.int64)
            spread = grams(np.arange(made, made + len(n), dtype=np.uint64), 1)  # any key does: these rows count nothing
            made += len(n)
            yield pd.concat([pd.DataFrame({"gram": key, "doc": doc[text], "m": m, "w": weight, "part": 0.0, "n": 0}), pd.DataFrame({"gram": spread, "doc": doc, "m": zeros, "w": zeros, "part": part, "n": n})])

    return docs.mapInPandas(run, "gram long not null, doc long, m long not null, w long not null, part double not null, n long not null")


def _closed_scores(docs: DataFrame, order: int) -> DataFrame:
    """Scores of texts under their own counts, where every n-gram occurs and nothing backs off."""
    keys = _commonest(docs, order, HOT)
    counts, tokens = _hot_counts(docs, order, keys)
    dealt = _exploded(docs, order, keys, counts, max(1, tokens)).repartition("gram")
    # `served` asks for all columns (and no key is null), so that one exchange serves the counts and the join
    served = F.count_if(F.col("doc").isNotNull() | (F.col("w") + F.col("n") > F.col("part")))
    table_of = dealt.groupBy("gram").agg(F.sum("m").alias("count"), served.alias("served")).where("count > 1 and served >= 0").drop("served")
    found = dealt.join(table_of, "gram", "left").where("count is not null or m = 0")  # the log of 1 is 0
    score = F.sum(F.col("part") + F.when(F.col("w") != 0, F.col("w") * F.log("count")).otherwise(0.0))
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.sum("n").alias("n_words"), score.alias("score"))


def ngram_counts(corpus: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, count`` of all n-grams of 1 to ``order`` words of the corpus. Null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for _, texts in together(batches):
            key, m = np.unique(weighted(*words.of(*texts), order)[1], return_counts=True)
            yield pd.DataFrame({"gram": key, "m": m})

    return _texts(corpus).mapInPandas(run, "gram long, m long").groupBy("gram").agg(F.sum("m").alias("count"))


def _open_scores(docs: DataFrame, counts: DataFrame, tokens: int, order: int, least: int, alpha: float) -> DataFrame:
    """Scores under any counts. A row is a place's n-gram with its shorter forms; those not seen go on to the next round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            for doc, text in zip(batch["doc"].astype("Int64"), batch["text"], strict=True):
                w = words.of(text)[0]
                by_n = [grams(w, n) for n in range(1, order + 1)]
                rows = [([by_n[n - 1][p - n + 1] for n in range(min(order, p + 1), 0, -1)], [by_n[n - 2][p - n + 1] for n in range(min(order, p + 1), 1, -1)]) for p in range(len(w))]
                yield pd.DataFrame({"doc": pd.array([doc] * (len(rows) + 1), "Int64"), "grams": [[], *(r[0] for r in rows)], "contexts": [[], *(r[1] for r in rows)]})

    at = written(docs.mapInPandas(run, "doc long, grams array<long>, contexts array<long>").groupBy("doc", "grams", "contexts").agg(F.count("*").alias("m")))
    done = [at.groupBy("doc").agg(F.sum(F.when(F.size("grams") > 0, F.col("m")).otherwise(0)).alias("n"), F.lit(0.0).alias("part"))]
    at, tables = at.where("size(grams) > 0"), [at]
    lookup = counts.withColumnRenamed("gram", "key")
    for _ in range(order):
        met = written(at.join(lookup, F.col("grams")[0] == F.col("key"), "left").drop("key"))
        tables.append(met)
        seen = (F.coalesce("count", F.lit(0)) >= least) | (F.size("grams") == 1)
        known = met.where(seen & (F.size("grams") > 1)).withColumnRenamed("count", "c").join(lookup, F.col("contexts")[0] == F.col("key"))
        done.append(known.select("doc", F.lit(0).cast("long").alias("n"), (F.col("m") * (F.log("c") - F.log("count"))).alias("part")))
        done.append(met.where(F.size("grams") == 1).select("doc", F.lit(0).cast("long").alias("n"), (F.col("m") * (F.log(F.coalesce("count", F.lit(1))) - F.log(F.lit(float(max(1, tokens)))))).alias("part")))
        rest = met.where(~seen)
        done.append(rest.select("doc", F.lit(0).cast("long").alias("n"), (F.col("m") * F.log(F.lit(alpha))).alias("part")))
        at = rest.select("doc", "m", *(F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1)).alias(c) for c in ("grams", "contexts")))
    every = done[0].select("doc", "n", "part")
    for d in done[1:]:
        every = every.unionByName(d)
    out = written(every.groupBy(F.col("doc").alias("doc_id")).agg(F.sum("n").alias("n_words"), F.sum("part").alias("score")))
    discard(*tables)
    return out


def backoff_scores(documents: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, n_words, score`` for every id of documents, under the counts of ``corpus`` (documents themselves if there is none).

    With ``least`` above 1 and no other corpus there is ``n_backed`` too: how often words step to a shorter context.

    An id's rows are summed, those with a null id too. Null and empty texts have no words and score 0. A word has the context that the text gives it: none
    for the first. A word that the corpus lacks counts as one that it has once. Columns other than ``doc_id`` and ``text`` aren't read. Empty tables give none.
    """
    docs = _texts(documents)
    if corpus is None:
        return _closed_scores(docs, order) if least == 1 else _returned_scores(documents, order, least, alpha)
    counts = written(ngram_counts(corpus, order))
    tokens = _hot_counts(_texts(corpus), 1, np.zeros(0, np.int64))[1]
    return _open_scores(docs, counts, tokens, order, least, alpha)


def packed(values: np.ndarray, kind: str = "<i8") -> bytes:
    """Whole numbers by their bytes of equal rank, so that zeros stand together and compress."""
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, int(kind[2:])).T.tobytes()


def unpacked(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(int(kind[2:]), -1).T).view(kind).ravel()


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """A row for each ``size`` words of whole texts: ``chunk`` (its number), ids and sizes of its texts, its words, and each place's word among them."""

    def row(docs: list, known: list, hashes: list[np.ndarray], sizes: list[np.ndarray]) -> pd.DataFrame:
        words, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        one = {"chunk": uuid.uuid4().int >> 65, "n": len(codes), "docs": packed(np.concatenate(docs)), "known": packed(np.concatenate(known)), "sizes": packed(np.concatenate(sizes)), "words": words.tobytes(), "codes": packed(codes, "<u4")}
        return pd.DataFrame([one])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, n = Words(), [], 0
        for batch in batches:
            for at in range(0, len(batch), 256):  # texts of one batch are no more than BATCH_BYTES or one long text
                part = batch.iloc[at : at + 256]
                hashes, sizes = words.of(*part["text"])
                held.append((part["doc"].to_numpy(np.int64), part["known"].to_numpy(bool), hashes, sizes))
                n += len(hashes)
                if n >= size:
                    yield row(*map(list, zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield row(*map(list, zip(*held, strict=True)))

    given = docs.select(F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNotNull().alias("known"), "text")
    return given.mapInPandas(run, "chunk long, n long, docs binary, known binary, sizes binary, words binary, codes binary")


def _places(row, orders: Iterable[int]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of a row of chunks: each place's text, and for every n of ``orders`` the places where n-grams begin and their keys."""
    words = np.frombuffer(row.words, np.uint64)[unpacked(row.codes, "<u4")]
    text = np.repeat(np.arange(len(row.sizes) // 8), unpacked(row.sizes))
    starts, keys = [], []
    for n in orders:
        k = max(0, len(words) - n + 1)
        inside = text[:k] == text[n - 1 : n - 1 + k]
        starts.append(np.flatnonzero(inside))
        keys.append(grams(words, n)[inside])
    return text, starts, keys


def _counted(chunks: DataFrame, n: int, parts: int) -> DataFrame:
    """``chunk, part, totals``: how often each n-gram of n words of a chunk occurs in all, by ranges (``part``) of the keys and in their order.

    A chunk sends each of its n-grams once, with its number there, so that a common one has no more rows than there are chunks.
    """
    bounds = np.array([-(1 << 63) + i * ((1 << 64) // parts) for i in range(1, parts)], np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                keys, m = np.unique(_places(row, [n])[2][0], return_counts=True)
                ends = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                rows = [(row.chunk, p, packed(np.diff(keys[i:j], prepend=np.int64(0))), packed(m[i:j], "<u4")) for p, (i, j) in enumerate(pairwise(ends)) if i < j]
                yield pd.DataFrame(rows, columns=["chunk", "part", "keys", "m"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpacked(k)) for k in group["keys"]]
        place = np.unique(np.concatenate(keys), return_inverse=True)[1]
        totals = np.bincount(place, np.concatenate([unpacked(m, "<u4") for m in group["m"]])).astype(np.int64)[place]
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"chunk": group["chunk"], "part": group["part"], "totals": [packed(t) for t in np.split(totals, ends[:-1])]})

    dealt = chunks.select("chunk", "sizes", "words", "codes").mapInPandas(deal, "chunk long, part int, keys binary, m binary")
    return dealt.groupBy("part").applyInPandas(count, "chunk long, part int, totals binary")


def _returned_scores(documents: DataFrame, order: int, least: int, alpha: float) -> DataFrame:
    """Scores of texts under their own counts where n-grams of fewer than ``least`` occurrences aren't counted, so that words back off.

    Texts are put together in chunks of CHUNK words. A chunk's distinct n-grams with their numbers are dealt out by ranges of the keys, where they are summed;
    the sums go back to the chunk in the order of its keys, and each place is scored with the counts that it finds.
    """
    spark = documents.sparkSession
    with shuffles_cleaned(spark):
        chunks = written(_chunks(_texts(documents), CHUNK))
        tokens = chunks.agg(F.sum("n")).first()[0] or 0
        levels = [written(_counted(chunks, n, max(1, -(-tokens // PART))).withColumn("n", F.lit(n))) for n in range(order, 0, -1)]  # one after the other, so that one order's exchange is on disk
        totals = levels[0]
        for level in levels[1:]:
            totals = totals.unionByName(level)

        def score(chunk: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            row = next(chunk.itertuples())
            text, starts, keys = _places(row, range(1, order + 1))
            parts, counts = parts.sort_values("part"), []
            for n, key in enumerate(keys, 1):
                found = [np.empty(0, np.int64), *map(unpacked, parts.loc[parts["n"] == n, "totals"])]
                counts.append(np.concatenate(found)[np.unique(key, return_inverse=True)[1]])
            size = len(row.sizes) // 8
            value, backed, before = np.log(counts[0]) - np.log(max(1, tokens)), np.zeros(size, np.int64), counts[0]
            for n in range(2, order + 1):
                at, c = starts[n - 1], counts[n - 1]
                seen = c >= max(1, least)
                backed += np.bincount(text[at[~seen]], minlength=size)
                value[at + n - 1] = np.where(seen, np.log(c) - np.log(before[at]), np.log(alpha) + value[at + n - 1])
                before = np.zeros(len(text), np.int64)
                before[at] = c
            known = unpacked(row.known) == 1
            return pd.DataFrame({"doc": unpacked(row.docs), "known": known, "n": unpacked(row.sizes), "part": np.bincount(text, value, size), "backed": backed})

        scored = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInPandas(score, "doc long, known boolean, n long, part double, backed long")
        doc = F.when(F.col("known"), F.col("doc")).alias("doc_id")
        out = written(scored.groupBy(doc).agg(F.sum("n").alias("n_words"), F.sum("part").alias("score"), F.sum("backed").alias("n_backed")))
    discard(chunks, *levels)
    return out


#: The query's order and the least number of occurrences that count.
QUERY_ORDER, QUERY_LEAST = 3, 2


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_backed, score`` (to three decimals) of all documents under their own counts: order 3, n-grams from two occurrences on; ``n_backed`` is how often the scores step to a shorter context."""
    scores = backoff_scores(table(spark, sf_dir, "documents"), order=QUERY_ORDER, least=QUERY_LEAST)
    return scores.select("doc_id", "n_words", "n_backed", F.round("score", 3).alias("score"))


ORACLE_OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT * FROM (SELECT doc_id, unnest(w) AS c, unnest(list_prepend(NULL, w[: -2])) AS b, unnest(list_prepend(NULL, list_prepend(NULL, w[: -3]))) AS a FROM d) WHERE c IS NOT NULL),
x AS (SELECT *, count(*) OVER (PARTITION BY c) AS n1, CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b, c) END AS n2, CASE WHEN a IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, c) END AS n3 FROM p),
u AS (SELECT c AS w, count(*) AS u FROM p GROUP BY 1), v AS (SELECT b, c, count(*) AS v FROM p WHERE b IS NOT NULL GROUP BY 1, 2),
s AS (SELECT doc_id, CASE WHEN n3 >= 2 THEN ln(n3) - ln(v.v) ELSE CASE WHEN n3 IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN n2 >= 2 THEN ln(n2) - ln(u.u) ELSE CASE WHEN n2 IS NULL THEN 0 ELSE ln(0.4) END + ln(n1) - ln((SELECT count(*) FROM p)) END END AS s,
  CASE WHEN n3 < 2 THEN 1 ELSE 0 END + CASE WHEN n2 < 2 THEN 1 ELSE 0 END AS k FROM x LEFT JOIN u ON u.w = x.b LEFT JOIN v ON v.b = x.a AND v.c = x.b)
SELECT d.doc_id, CAST(coalesce(max(len(d.w)), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_backed, round(coalesce(sum(s), 0), 3) AS score FROM d LEFT JOIN s USING (doc_id) GROUP BY 1
"""
