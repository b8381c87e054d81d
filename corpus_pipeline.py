"""A corpus pipeline: toxic documents go, one of each class of near copies stays, contaminated documents go, personal data is redacted, the rest is packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontamination, jaccard, packing, pii, toxicity
from llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the cut go; the model is fitted on labelled rows of this stage's input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).where(F.col("toxic_score") < toxicity.CUT).select(docs.columns)


def _text_key(docs: DataFrame) -> Column:
    """One key for rows that share id and text: a hash of both."""
    return F.xxhash64(docs["doc_id"], docs["text"].cast("string"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts the one with the least id stays, once; texts without words and rows without an id all stay.

    Where an id is repeated with other texts, texts are told apart by a hash of id and text, and of one class the row of the least id and then
    the least hash stays. Rows of one id and text with words are copies too.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1)
    if repeated.isEmpty():
        classes = written(jaccard.shingle_classes(docs))
        gone = written(classes.where("component_id <> doc_id").select("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    keyed = docs.where("doc_id is not null").select("doc_id", "text", _text_key(docs).alias("key"))
    classes = written(jaccard.shingle_classes(keyed.select(F.col("key").alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct())
    ids = keyed.select("key", "doc_id").distinct().join(classes, "key")
    first = written(ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key")).select("key"))
    key = F.when(docs["doc_id"].isNotNull(), _text_key(docs))
    worded = docs.join(first, key == first["key"], "left_semi").dropDuplicates(["doc_id", "text"])
    return worded.unionByName(docs.join(classes, key == classes["key"], "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; of rows that share an id only those whose own text holds one."""
    keyed = docs.select(_text_key(docs).alias("doc_id"), "text")
    found = decontamination.decontaminate(keyed, table(spark, sf_dir, "benchmark"))
    gone = written(found.where("contaminated").select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(gone, _text_key(docs) == gone["gone"], "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; null and empty texts, and all other columns, stay as they are, repeated rows too. An empty table gives none."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of packed token sequences; null and empty texts are one piece, long ones several, and repeated rows are packed each. An empty table gives none."""
    return packing.best_fit_packing(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_copy), ("benchmark_decontamination", drop_contaminated), ("pii", redact), ("best_fit_packing", pack)]
#: Learned scores and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
