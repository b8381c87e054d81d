"""Dictionary entities with their places, and relations between them.

A dictionary is a table, so it may have any size: a small one is sent to the tasks, another meets the texts on word n-grams in an equi-join. Each match carries the start
of its sentence; other spans find theirs by place, in one window over a document's spans without a range join.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.graph import checkpoints

#: A dictionary of so many names, of so many characters each at most, is sent to the tasks.
KNOWN, LONGEST = 100_000, 200
#: Letters and digits; marks and everything else part words.
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?]\s+")
#: Certainty of a relation whose words stand somewhere between two names, and of two names that only share a sentence.
BETWEEN, TOGETHER = 0.6, 0.4


def _normal(name: str):
    return F.array_join(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def _dictionary(dictionary: DataFrame, role: int) -> DataFrame:
    """``name, role, type, confidence``, one row for each name that is alike: the most certain, then the least type."""
    names = dictionary.select(_normal("name").alias("name"), "type", F.col("confidence").cast("double").alias("confidence")).where("name <> ''")
    names = names.groupBy("name").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "type")).alias("r"))
    return names.select("name", F.lit(role).alias("role"), "r.type", (-F.col("r.less")).alias("confidence"))


def _grams(df: DataFrame, key: str, text: str, sizes: list[int], longest: int, known: set[str] | None) -> DataFrame:
    """``key, start, end, sentence_start, name``: runs of as many words as ``sizes`` has, of at most ``longest`` characters, in lower case; of a known dictionary its names alone."""
    key_type = dict(df.dtypes)[key]
    shared = None
    if known is not None:
        begins: dict[str, set[int]] = {}
        for name in known:
            first, *rest = name.split(" ")
            begins.setdefault(first, set()).add(len(rest) + 1)
        shared = df.sparkSession.sparkContext.broadcast((known, {k: sorted(v) for k, v in begins.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, begins = shared.value if shared else (None, None)
        for batch in batches:
            rows = []
            for k, value in zip(batch["k"], batch["t"], strict=True):
                sentences = [0, *(m.end() for m in SENTENCE_END.finditer(value or ""))]
                words = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(value or "")]
                for i, (start, _, word) in enumerate(words):
                    for n in sizes if begins is None else begins.get(word, ()):
                        if i + n <= len(words):
                            name = word if n == 1 else " ".join(w[2] for w in words[i : i + n])
                            if len(name) <= longest and (known is None or name in known):
                                rows.append((k, start, words[i + n - 1][1], sentences[bisect_right(sentences, start) - 1], name))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["key", "start", "end", "sentence_start", "name"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["key", "start", "end", "sentence_start", "name"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(run, f"key {key_type}, start long, end long, sentence_start long, name string")


def _matches(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, role, start, end, sentence_start, name, type, confidence``; within a role the longest match wins.

    A dictionary of KNOWN names or fewer is sent to the tasks, which keep its names alone; any other is joined on the word n-grams of the texts.
    """
    names = names.checkpoint()
    shape = names.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("name", " "))).alias("sizes"), F.max(F.length("name")).alias("longest")).first()  # a few numbers: lengths of names in words
    few = shape["n"] <= KNOWN and (shape["longest"] or 0) <= LONGEST
    known = {r["name"] for r in names.select("name").distinct().collect()} if few else None
    found = _grams(df, key, text, sorted(shape["sizes"] or []), shape["longest"] or 0, known)
    found = found.join(F.broadcast(names) if few else names, "name").distinct()
    before = Window.partitionBy("key", "role").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("end").over(before)).where("reach is null or reach < end").drop("reach")


def dictionary_spans(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """``key, start, end, name, type, confidence`` of every place where a name of the dictionary stands in a text.

    dictionary: ``name, type, confidence``, any number of rows; names match as whole words whatever their case and the marks between words, and names that are
    alike are one (the most certain, then the least type). Places are code points from 0, the end exclusive. The longest match wins: a match within
    another is dropped; two that overlap otherwise both stay. Null and empty texts and names match nothing, and rows without a key have none; of rows that repeat a key and a
    text each match is one.
    """
    checkpoints(df.sparkSession)
    return _matches(df, key, text, _dictionary(dictionary, 0)).select(F.col("key").alias(key), "start", "end", "name", "type", "confidence")


def sentence_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, start, end, sentence``: a sentence ends with a full stop, exclamation or question mark that white space follows."""
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, value in zip(batch["k"], batch["t"], strict=True):
                if value:
                    ends = [(m.start() + 1, m.end()) for m in SENTENCE_END.finditer(value)]
                    starts, stops = [0, *(e for _, e in ends)], [*(s for s, _ in ends), len(value)]
                    out = pd.DataFrame({"start": starts, "end": stops, "sentence": [value[a:b] for a, b in zip(starts, stops, strict=True)]})
                    out.insert(0, "key", pd.Series([k] * len(out), dtype="Int64" if key_type in ("bigint", "int") else "object"))
                    yield out[out["end"] > out["start"]]

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(run, f"key {key_type}, start long, end long, sentence string").withColumnRenamed("key", key)


def in_sentences(spans: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """``spans`` with ``sentence_start``, the start of the sentence that each begins in (the last that starts at or before it)."""
    starts = sentences.select(key, "start", F.col("start").alias("sentence_start"), F.lit(0).alias("after"), F.lit(None).alias("span"))
    rows = spans.select(key, "start", F.lit(None).cast("long").alias("sentence_start"), F.lit(1).alias("after"), F.struct(*[c for c in spans.columns if c != key]).alias("span"))
    at = Window.partitionBy(key).orderBy("start", "after").rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(rows).withColumn("sentence_start", F.last("sentence_start", ignorenulls=True).over(at)).where("after = 1")
    return met.select(key, "sentence_start", "span.*")


def relations(df: DataFrame, key: str, text: str, dictionary: DataFrame, phrases: DataFrame, default: str = "collaborates_with") -> DataFrame:
    """``key, subject, subject_type, relation, object, object_type, confidence, sentence_start`` of the names that share a sentence.

    phrases: ``name, type, confidence``: words of a relation, the relation, and how certain it is. The first places of every two different names of a sentence
    are related in their order: by the longest phrase that stands between them (then the earliest), or by ``default``. A phrase that fills the gap counts with its own certainty, less for
    a stretch of below ten characters; one that stands elsewhere between counts BETWEEN, and none TOGETHER. Of equal triples of a text the most certain stays, of
    those the first.
    """
    checkpoints(df.sparkSession)
    both = _matches(df, key, text, _dictionary(dictionary, 0).unionByName(_dictionary(phrases, 1))).withColumnRenamed("key", key).checkpoint()
    first = both.where("role = 0").groupBy(key, "sentence_start", "name").agg(F.min(F.struct("start", "end", "type")).alias("s"))
    words = both.where("role = 1")
    side = lambda p: first.select(key, "sentence_start", F.col("name").alias(f"{p}_name"), *(F.col(f"s.{c}").alias(f"{p}_{c}") for c in ("start", "end", "type")))
    pairs = side("a").join(side("b"), [key, "sentence_start"]).where("a_start < b_start and a_end <= b_start")
    said = words.select(F.col(key).alias("_key"), F.col("sentence_start").alias("_sentence"), F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.length("name").alias("size"), F.col("type").alias("relation"), "confidence")
    inside = (F.col(key) == F.col("_key")) & (F.col("sentence_start") == F.col("_sentence")) & (F.col("w_start") >= F.col("a_end")) & (F.col("w_end") <= F.col("b_start"))
    fills = (F.col("w_start") - F.col("a_end") <= 1) & (F.col("b_start") - F.col("w_end") <= 1)
    sure = F.when(fills, F.round(F.col("confidence") * F.least(F.lit(1.0), (F.col("b_end") - F.col("a_start")) / 10), 4)).otherwise(BETWEEN)
    ends = ["a_name", "a_type", "b_name", "b_type", "a_start"]
    found = pairs.join(said, inside, "left").groupBy(key, "sentence_start", *ends, "a_end", "b_start", "b_end").agg(F.max(F.when(F.col("size").isNotNull(), F.struct("size", (-F.col("w_start")).alias("less"), sure.alias("sure"), "relation"))).alias("w"))
    found = found.select(key, "sentence_start", *ends, F.coalesce("w.relation", F.lit(default)).alias("relation"), F.coalesce("w.sure", F.lit(TOGETHER)).alias("confidence"))
    strongest = F.min(F.struct((-F.col("confidence")).alias("less"), "sentence_start", "a_type", "b_type")).alias("r")
    out = found.groupBy(key, "a_name", "relation", "b_name").agg(strongest)
    return out.select(key, F.col("a_name").alias("subject"), F.col("r.a_type").alias("subject_type"), "relation", F.col("b_name").alias("object"), F.col("r.b_type").alias("object_type"), (-F.col("r.less")).alias("confidence"), F.col("r.sentence_start").alias("sentence_start"))


def relation_statistics(triples: DataFrame, key: str) -> DataFrame:
    """``relation, n, texts, subjects, objects, mean``: how often, in how many texts and between how many names each relation is found, and its mean certainty."""
    return triples.groupBy("relation").agg(
        F.count("*").alias("n"), F.countDistinct(key).alias("texts"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"), F.avg("confidence").alias("mean")
    )
