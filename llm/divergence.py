"""How the sources of each language differ in their words: an exact chi-squared divergence of every two sources, and the terms that set a source apart.

Counts of terms are cut into shards of about SHARD terms by the hash of the term, so no vector is larger than a shard, however large a vocabulary.
Within a shard, sources are dealt into blocks of BLOCK; a block stays in its partition, and the packed vectors of the other blocks come by in the
rounds of a round-robin tournament (the circle method: B blocks meet in B - 1 rounds, or B). A meeting is held once, at either block's home by turns, and gives both
directions of each pair. Residents also meet each other and the language's own vector, from which heaps take the RANKS terms of
greatest value. Values of shards are summed and ranked afterwards.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import UPPER, table, written

UNIT, LEAST_DOCUMENTS, RANKS, SHARD, BLOCK, TOGETHER, DOCUMENT = 1_000_000_000, 3, 200, 8192, 8, 500_000, 1 << 44
#: Bytes of UTF-8 that belong to no term become blanks; A-Z are lower-cased.
_TABLE = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def per_unit(count: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / total)`` by long division, exact for totals below 9e15."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + 1, max(1, total))
    for _ in range(3):  # UNIT is 1000 three times
        more, rest = np.divmod(rest * 1000, max(1, total))
        whole = whole * 1000 + more
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<i4").tobytes() + counts.astype("<i8").tobytes(), 1)


def _dense(blob: bytes | None, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    if blob is not None:
        raw = zlib.decompress(blob)
        n = len(raw) // 12
        out[np.cumsum(np.frombuffer(raw, "<i4", n))] = np.frombuffer(raw, "<i8", n, 4 * n)
    return out


def _counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of each term in each group, combined in the task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], dict[bytes, int]] = {}  # a term's occurrences and, DOCUMENT each, its documents

        def rows() -> pd.DataFrame:
            columns = [[], [], [], [], []]
            for (lang, source), of in known.items():
                columns[0] += [lang] * len(of)
                columns[1] += [source] * len(of)
                columns[2] += b" ".join(of).decode("utf-8", "surrogatepass").split(" ") if of else []
                columns[3] += [k % DOCUMENT for k in of.values()]
                columns[4] += [k // DOCUMENT for k in of.values()]
            known.clear()
            return pd.DataFrame(dict(zip(("lang", "source", "term", "n", "df"), columns, strict=True)))

        added = 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                found = Counter(terms(text))
                of = known.setdefault((lang, source), {})
                before = of.get
                for term, k in found.items():
                    of[term] = before(term, 0) + k + DOCUMENT
                added += len(found)
                if added > TOGETHER:
                    held = sum(map(len, known.values()))
                    added = held // 2  # looked at again once half as many were added
                    if held > TOGETHER:
                        yield rows()
                        added = 0
        if any(known.values()):
            yield rows()

    sums = docs.mapInPandas(run, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term")
    return sums.agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _partner(block: Column, round_: Column, players: Column) -> Column:
    """Whom a block meets in a round of the circle method with an even number of players: the last one stands still."""
    ring = players - 1
    met = F.pmod(round_ - block, ring)
    still = F.pmod(round_ * F.expr("div(ring + 1, 2)"), ring)
    return F.when(block == ring, still).when(met == block, ring).otherwise(met)


def _circulated(vectors: DataFrame) -> DataFrame:
    """Each vector once at home (round -1) and once for every meeting that is held elsewhere: ``home, round`` beside its columns."""
    out = vectors.withColumn("block", F.expr(f"div(g, {BLOCK})")).withColumn("blocks", F.expr(f"div(groups + {BLOCK - 1}, {BLOCK})"))
    out = out.withColumn("ring", F.expr("blocks + blocks % 2 - 1")).withColumn("round", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("ring") - 1)))
    out = out.withColumn("partner", _partner(F.col("block"), F.col("round"), F.col("ring") + 1))
    away = F.when(F.col("round") % 2 == 0, F.least("block", "partner")).otherwise(F.greatest("block", "partner"))
    out = out.withColumn("home", F.when(F.col("round") < 0, F.col("block")).otherwise(away))
    return out.where("round < 0 or (partner < blocks and partner <> block and home <> block)")


def _meetings(dealt: DataFrame) -> DataFrame:
    """``lang, source, other, id, shard, value``: sums over a shard for two sources (``other``), and values of terms (``id``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, size, whole, residents = None, 0, None, []

        def pairs(lang: str, one: tuple, others: list[tuple], shard: int) -> list[tuple]:
            out = []
            for source, p in others:
                out.append((lang, one[0], source, None, shard, int(divergence(one[1], p).sum())))
                out.append((lang, source, one[0], None, shard, int(divergence(p, one[1]).sum())))
            return out

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if at != (row.lang, row.shard, row.home):
                    at, residents, whole, size = (row.lang, row.shard, row.home), [], None, 0
                if row.round == -2:  # the language itself comes first
                    size = int(row.terms)
                    whole = per_unit(_dense(row.vector, size), row.total + row.vocabulary)
                    continue
                counts = _dense(row.vector, size)
                p = per_unit(counts, row.total + row.vocabulary)
                out += pairs(row.lang, (row.source, p), residents, row.shard)
                if row.round == -1:
                    residents.append((row.source, p))
                    if whole is not None:
                        ids = np.flatnonzero((counts > 0) & (p > whole))
                        best = heapq.nsmallest(RANKS, zip((-divergence(p[ids], whole[ids])).tolist(), ids.tolist(), strict=True))
                        out += [(row.lang, row.source, None, i, row.shard, -less) for less, i in best]
            yield pd.DataFrame(out, columns=["lang", "source", "other", "id", "shard", "value"]).astype({"id": "Int64", "value": "int64", "shard": "int64"})

    return dealt.mapInPandas(run, "lang string, source string, other string, id long, shard long, value long")


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    out = rows.withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT)"))
    return out if most is None else out.where(F.col("rank") <= most)


def source_divergence(documents: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group of documents (``text, lang, source``; other columns aren't read).

    A language keeps the terms of LEAST_DOCUMENTS of its rows or more. Part ``pair``: each other source of the language and the divergence of the group
    from it, all ranks; part ``term``: the RANKS terms of the group whose share exceeds the language's, by their part of the divergence from it.
    Null texts, languages and sources read as empty. Groups without terms have pairs like others; where a language keeps no term all values are 0. Ties
    rank by item in the order of UTF-8. Repeated rows are documents of their own. Very long texts are one row of a batch. An empty table gives none.
    """
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    spark = documents.sparkSession
    counts = written(_counted(docs))
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("df") >= LEAST_DOCUMENTS).drop("df"))
    names = docs.select("lang", "source").distinct()
    langs = written(
        names.groupBy("lang").agg(F.count("*").alias("groups"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("total")), "lang", "left")
        .select("lang", "groups", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("vocabulary", "total")))
        .withColumn("shards", F.expr(f"greatest(1L, div(vocabulary + {SHARD - 1}, {SHARD}))"))
    )
    in_shard = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.expr("pmod(xxhash64(term), shards)"))
    words = written(in_shard.withColumn("id", F.expr("CAST(row_number() OVER (PARTITION BY lang, shard ORDER BY term) - 1 AS INT)")).select("lang", "term", "shard", "id", "n"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blobs = [_packed(np.array([e["id"] for e in v], np.int64), np.array([e["n"] for e in v], np.int64)) for v in batch["entries"]]
            yield batch.drop(columns="entries").assign(vector=blobs)

    entries = F.sort_array(F.collect_list(F.struct("id", "n"))).alias("entries")  # a shard's terms at most
    sizes = (F.sum("n").alias("n"), F.count("*").alias("terms"))
    schema = "shard long, n long, terms long, vector binary"
    of_lang = words.groupBy("lang", "shard").agg(*sizes, entries).mapInPandas(packed, f"lang string, {schema}")
    found = counts.select("lang", "source", "term", F.col("n")).join(words.drop("n"), ["lang", "term"])
    vectors = written(found.groupBy("lang", "source", "shard").agg(*sizes, entries).mapInPandas(packed, f"lang string, source string, {schema}"))
    totals = vectors.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.withColumn("g", F.expr("row_number() OVER (PARTITION BY lang ORDER BY source) - 1L")).join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    grid = groups.join(langs.drop("total"), "lang").withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)")))
    columns = ["lang", "shard", "home", "round", "g", "source", "total", "vocabulary", "terms", "vector"]
    peers = _circulated(grid.join(vectors.select("lang", "source", "shard", "terms", "vector"), ["lang", "source", "shard"], "left")).select(columns)
    homes = langs.withColumn("home", F.explode(F.expr(f"sequence(0L, div(groups - 1, {BLOCK}))")))
    whole = of_lang.join(homes, "lang").select("lang", "shard", "home", F.lit(-2).cast("long").alias("round"), F.lit(-1).cast("long").alias("g"), F.lit("").alias("source"), "total", "vocabulary", "terms", "vector")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.unionByName(peers).repartition(n, "lang", "shard", "home").sortWithinPartitions("lang", "shard", "home", "round", "g")
    values = written(_meetings(dealt))
    pair = values.where("id IS NULL").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    best = values.where("id IS NOT NULL").join(words.select("lang", "shard", F.col("id").cast("long").alias("id"), F.col("term").alias("item")), ["lang", "shard", "id"]).select("lang", "source", "item", "value")
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", _ranked(pair)), ("term", _ranked(best, RANKS)))]
    return parts[0].unionByName(parts[1])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources of ``documents``; edge cases as in ``source_divergence``."""
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE_OP12 = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (v.n + v.v) AS q FROM k JOIN v USING (lang)),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(m.n, 0) + v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN m ON m.lang = g.lang AND m.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM x JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
