"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Documents and items are read as lower-cased words. Of every ``SPAN - GRAM + 1``
consecutive word GRAMs the one with the least hash is kept, so a shared run of SPAN
words has a fingerprint in common on both sides. The fingerprints of documents are
joined to those of the items, which leaves the documents that may share a span;
there every hit is extended by joining all SPAN-word windows exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import ascii_lower, table, written

SPAN, GRAM = 10, 4
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shifted(array: Column, by: int, merge) -> Column:
    """``merge`` of every entry and the one ``by`` later; as many entries fewer."""
    kept = lambda a: F.greatest(F.lit(0), F.size(a) - by)
    return _let(array, lambda a: F.zip_with(F.slice(a, F.lit(1), kept(a)), F.slice(a, F.lit(1 + by), kept(a)), merge))


def _fingerprints(column: str) -> Column:
    """The distinct winnowed fingerprints of the word array ``column``."""
    merged = lambda x, y: F.xxhash64(x, y)
    least = lambda x, y: F.least(x, y)
    marks = F.transform(column, lambda w: F.xxhash64(w))
    for by, merge in ((1, merged), (2, merged), (1, least), (2, least), (3, least)):  # hashes of 4 words, least of 7
        marks = _shifted(marks, by, merge)
    return F.array_distinct(marks)


def _windows(df: DataFrame, key: str, size: Column) -> DataFrame:
    """``key, size, at, gram, gram2``: two hashes of the ``size`` consecutive words from each place (from 0) of ``words``."""
    out = df.select(key, "words", size.cast("int").alias("size")).where("size(words) >= size and size > 0")
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.concat_ws(" ", F.slice("words", i, F.col("size"))))
    out = out.select(key, "size", F.posexplode(grams).alias("at", "text"))
    return out.select(key, "size", "at", F.xxhash64("text").alias("gram"), F.xxhash64(F.lit(SPAN), "text").alias("gram2"))


def winnowing_hits(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(doc_id, n_words)`` for each row of documents, the window hits ``(doc_id, at, size, item_set)``, and ``(item_set, items)``.

    A window that many items share is one row with the number of its set of items, so a common passage costs a document its places, not
    places times items.

    documents: ``doc_id, text``; items: ``item_id, text``; other columns aren't read. A window is SPAN
    consecutive item words, or all words of a shorter item that isn't empty. Null texts have no words; rows
    that share an id share their hits. Windows are compared by 128 bits of hash.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    windows = _windows(items, "item_id", F.least(F.lit(SPAN), F.size("words"))).groupBy("size", "gram", "gram2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    windows = written(windows.withColumn("item_set", F.xxhash64("items")))
    marks = written(items.where(F.size("words") >= SPAN).select(F.explode(_fingerprints("words")).alias("mark")).distinct())
    docs = documents.select("doc_id", words(F.col("text")).alias("words"))
    # A row for the document itself, with its size, and one for each fingerprint; those without a match go.
    size = F.struct(F.xxhash64("doc_id").alias("mark"), F.size("words").cast("long").alias("n_words"))
    prints = F.transform(_fingerprints("words"), lambda m: F.struct(m.alias("mark"), F.lit(None).cast("long").alias("n_words")))
    rows = docs.select("doc_id", F.explode(F.concat(F.array(size), prints)).alias("p")).select("doc_id", "p.mark", "p.n_words")
    found = written(rows.join(marks.withColumn("hit", F.lit(True)), "mark", "left").where("n_words is not null or hit").select("doc_id", "n_words"))
    candidates = found.where("n_words is null").select("doc_id").distinct()
    # Items of fewer words have no sure fingerprint: each is looked for by the word of least hash, then by all of them.
    short = items.where(F.size("words") < SPAN)
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # SPAN of them at most
    if any(n < SPAN for n in sizes):
        anchors = written(short.select(F.element_at(F.array_sort("words", lambda a, b: F.when(F.xxhash64(a) < F.xxhash64(b), -1).when(F.xxhash64(a) > F.xxhash64(b), 1).otherwise(0)), 1).alias("word")).distinct())
        anchored = docs.select("doc_id", F.explode(F.array_distinct("words")).alias("word")).join(anchors, "word", "left_semi")
        candidates = candidates.unionByName(anchored.select("doc_id").distinct()).distinct()
    candidates = written(candidates.withColumnRenamed("doc_id", "_id"))
    docs = documents.join(candidates, documents["doc_id"].eqNullSafe(candidates["_id"]), "left_semi").select("doc_id", words(F.col("text")).alias("words"))
    hits = None
    for n in sorted(sizes):
        of = _windows(docs, "doc_id", F.lit(n)).join(windows.where(F.col("size") == n).select("gram", "gram2", "item_set"), ["gram", "gram2"]).select("doc_id", "at", "size", "item_set")
        hits = of if hits is None else hits.unionByName(of)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], "doc_id long, at int, size int, item_set long")
    return found.where("n_words is not null"), hits, windows.select("item_set", "items").distinct()


def decontaminate(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of documents (see ``winnowing_hits``)."""
    sizes, hits, sets = winnowing_hits(documents, items)
    places = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "size")), lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))
    at = written(hits.groupBy(F.col("doc_id").alias("_id")).agg(F.size(places).cast("long").alias("n_hit"), F.collect_set("item_set").alias("sets")))
    named = at.select("_id", F.explode("sets").alias("item_set")).join(sets, "item_set").groupBy(F.col("_id").alias("_named")).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    by_doc = at.join(named, F.col("_id").eqNullSafe(F.col("_named")), "left").select("_id", "n_hit", "items")
    out = sizes.join(by_doc, sizes["doc_id"].eqNullSafe(by_doc["_id"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of all ``documents`` against ``benchmark``.

    Null and empty texts have no words and no hit; texts are read whole. Rows that share an id share their hits and have a row each; repeated items count once by their id. Other columns aren't
    read; an empty table of documents gives none, an empty benchmark no hits.
    """
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_OP10 = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM di),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
