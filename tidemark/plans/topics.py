"""Quality and likeness of topics (a source's commonest words are its topic), and the hierarchy of vectors."""

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import hierarchy, topics
from tidemark.plans.registry import TIE, query, read, read_texts
from tidemark.plans.text import w

#: Words kept of a source, and the words that coherence is measured on.
KEPT, TOP = 50, 10
SQL = f"""WITH d AS (SELECT doc_id, source, {w(3, True)} AS w FROM documents), t AS (SELECT source AS topic, word, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT source, unnest(w) AS word FROM d) GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank FROM t) WHERE rank <= {KEPT}), s AS (SELECT topic, word, weight / sum(weight) OVER (PARTITION BY topic) AS p FROM k),
js AS (SELECT a.topic AS a, b.topic AS b, greatest(0.0, 0.5 * sum(CASE WHEN x.p > 0 THEN x.p * ln(x.p / ((x.p + coalesce(y.p, 0)) / 2)) ELSE 0 END) + 0.5 * (SELECT sum(v.p * ln(v.p / ((v.p + coalesce(u.p, 0)) / 2))) FROM s v LEFT JOIN s u ON u.topic = a.topic AND u.word = v.word WHERE v.topic = b.topic)) AS js
  FROM (SELECT DISTINCT topic FROM s) a JOIN (SELECT DISTINCT topic FROM s) b ON a.topic < b.topic JOIN s x ON x.topic = a.topic LEFT JOIN s y ON y.topic = b.topic AND y.word = x.word GROUP BY 1, 2)"""


def _topics(spark, sf):
    docs = read_texts(spark, sf)
    counted = docs.select(F.col("source").alias("topic"), F.explode(X.words(F.col("text"), 3, X.STOP_WORDS)).alias("word")).groupBy("topic", "word").agg(F.count("*").cast("double").alias("weight"))
    return docs, topics.top_words(counted, KEPT).drop("rank")


@query(SQL + f""", h AS (SELECT doc_id, list_distinct(w) AS w FROM d WHERE len(w) > 0), top AS (SELECT topic, word FROM k WHERE rank <= {TOP}), r AS (SELECT topic, doc_id, word FROM (SELECT doc_id, unnest(w) AS word FROM h) JOIN top USING (word)),
o AS (SELECT topic, word, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT x.topic, x.word AS a, y.word AS b, count(*) AS n FROM r x JOIN r y ON x.topic = y.topic AND x.doc_id = y.doc_id AND x.word < y.word GROUP BY 1, 2, 3)
SELECT x.topic, count(*) AS pairs, round(avg(coalesce(b.n, 0) * (SELECT count(*) FROM h) / (x.n * y.n)) + 1e-9, 4) AS coherence FROM o x JOIN o y ON x.topic = y.topic AND x.word < y.word LEFT JOIN b ON b.topic = x.topic AND b.a = x.word AND b.b = y.word GROUP BY 1""")
def topic_coherence(spark, sf):
    docs, of = _topics(spark, sf)
    return topics.coherence(of, docs, "doc_id", X.words(F.col("text"), 3, X.STOP_WORDS), TOP).withColumn("coherence", F.round(F.col("coherence") + TIE, 4))


@query(SQL + " SELECT a, b, round(js + 1e-9, 5) AS divergence FROM js")
def topic_divergences(spark, sf):
    return topics.divergences(_topics(spark, sf)[1]).withColumn("divergence", F.round(F.col("divergence") + TIE, 5))


@query(SQL.replace("WITH d", "WITH RECURSIVE d", 1) + """, l AS (SELECT a, b FROM js WHERE js <= 0.15 UNION SELECT b, a FROM js WHERE js <= 0.15), g AS (SELECT DISTINCT topic AS node, topic AS root FROM s UNION SELECT l.b, g.root FROM g JOIN l ON l.a = g.node)
SELECT node AS topic, min(root) AS merged FROM g GROUP BY 1""")
def merged_topics(spark, sf):
    return topics.merged_topics(_topics(spark, sf)[1], 0.15)


@query()
def ward_hierarchy(spark, sf):
    """Merges of the embeddings by Ward's criterion; tested against brute force."""
    return hierarchy.hierarchy(read(spark, sf, "embeddings"), "vec_id", "embedding")


@query()
def cluster_counts(spark, sf):
    """The silhouette of each number of clusters from 2 to 20; tested against brute force."""
    return hierarchy.cluster_counts(read(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("silhouette", F.round("silhouette", 6))
