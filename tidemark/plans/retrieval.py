"""Chunks, the vector index, the centroid classifier, and key phrases."""

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import chunks, classifiers, index, phrases
from tidemark.operators import text_stats as T
from tidemark.plans.registry import query, read, read_texts
from tidemark.plans.text import w


@query()
def retrieval_chunks(spark, sf):
    """Chunks of 500 characters with an overlap of 50; tested against a recursive split."""
    return chunks.chunked(read_texts(spark, sf), "doc_id", "text")


COSINE = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query(f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS id, {COSINE} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10""")
def indexed_neighbours(spark, sf):
    """Ten nearest of every hundredth vector, through the index and by its exact way."""
    vectors = read(spark, sf, "embeddings")
    found = index.build(vectors, "vec_id", "embedding")
    return index.search(vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", found, 10, exact=True).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT doc_id, unnest({w(3, True)}) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
r AS (SELECT doc_id, word, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1),
v AS (SELECT doc_id, word, w / norm AS w FROM r JOIN n USING (doc_id)),
c AS (SELECT quality AS label, word, sum(w) AS w FROM v JOIN labels USING (doc_id) GROUP BY 1, 2), m AS (SELECT label, sqrt(sum(w * w)) AS norm FROM c GROUP BY 1),
s AS (SELECT doc_id, label, round(sum(v.w * c.w / norm), 9) AS score FROM v JOIN c USING (word) JOIN m USING (label) GROUP BY 1, 2),
b AS (SELECT doc_id, label AS predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS k FROM s) WHERE k = 1)
SELECT doc_id, predicted, round(score, 4) AS score FROM b""")
def centroid_classifier(spark, sf):
    """The nearer of the centroids of labelled texts of high and low quality, for every text."""
    words = T.hashed(X.words(F.col("text"), 3, X.STOP_WORDS))
    found = classifiers.classified_texts(read_texts(spark, sf), "doc_id", words, read(spark, sf, "labels"), "quality")
    return found.withColumn("score", F.round("score", 4))


@query(f"""WITH d AS (SELECT doc_id, {w(3, True)} AS w FROM documents), o AS (SELECT doc_id, 1.0 AS per, 30 AS most, unnest(w) AS phrase FROM d UNION ALL SELECT doc_id, 1.5, 20, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
c AS (SELECT doc_id, per, most, phrase, count(*) AS n FROM o GROUP BY ALL), r AS (SELECT doc_id, phrase, per * n AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, per ORDER BY n DESC, phrase) AS k FROM c) WHERE k <= most)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, phrase, CAST(weight AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, phrase) AS rank FROM r) WHERE rank <= 10""")
def key_phrases(spark, sf):
    return phrases.key_phrases(read_texts(spark, sf), "doc_id", X.words(F.col("text"), 3, X.STOP_WORDS))


@query()
def stemmed_key_phrases(spark, sf):
    """Key phrases whose words count by their stems; tested against a plain count."""
    return phrases.key_phrases(read_texts(spark, sf), "doc_id", X.words(F.col("text"), 3, X.STOP_WORDS), stemmed=True)
