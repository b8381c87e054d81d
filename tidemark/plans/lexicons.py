"""Sentiment and tones by lexicons that are derived from the labelled texts and from the languages of the documents."""

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import lexicons as L
from tidemark.plans.registry import TIE, query, read, read_texts
from tidemark.plans.text import w


def _words():
    return X.words(F.col("text"), 3)


#: Words whose share of the clean and of the toxic labelled texts differs by a twentieth or more.
SQL = f"""WITH d AS (SELECT doc_id, lang, source, {w(3)} AS w FROM documents), t AS (SELECT doc_id, lang, unnest(list_distinct(w)) AS word FROM d), y AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IN (0, 1) GROUP BY 1),
n AS (SELECT count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS bad FROM d JOIN y USING (doc_id)), x AS (SELECT word, count(*) FILTER (toxic = 0) AS a, count(*) FILTER (toxic = 1) AS b FROM t JOIN y USING (doc_id) GROUP BY 1),
lex AS (SELECT word, a / clean - b / bad AS weight FROM x, n WHERE abs(a / clean - b / bad) >= 0.05),
h AS (SELECT doc_id, count(*) FILTER (weight > 0) AS positive, count(*) FILTER (weight < 0) AS negative FROM t JOIN lex USING (word) GROUP BY 1),
s AS (SELECT doc_id, source, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, greatest(-1.0, least(1.0, (coalesce(positive, 0) - coalesce(negative, 0)) / sqrt(len(w) + 1.0))) AS score FROM d LEFT JOIN h USING (doc_id))"""


def _lexicon(spark, sf, docs):
    labels = read(spark, sf, "labels").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = docs.join(labels, "doc_id")
    clean, bad = F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)
    total = of.agg(clean.alias("clean"), bad.alias("bad"))
    counted = of.select("toxic", F.explode(F.array_distinct(_words())).alias("word")).groupBy("word").agg(clean.alias("a"), bad.alias("b"))
    shares = counted.crossJoin(F.broadcast(total)).select("word", (F.col("a") / F.col("clean") - F.col("b") / F.col("bad")).alias("weight"))  # one row
    return shares.where(F.abs("weight") >= 0.05)


@query(SQL + " SELECT doc_id, positive, negative, round(score, 4) AS score, CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM s")
def lexicon_sentiment(spark, sf):
    docs = read_texts(spark, sf)
    return L.sentiment(docs, "doc_id", _words(), _lexicon(spark, sf, docs)).withColumn("score", F.round("score", 4))


#: A day stands for a document: days go round in sixty.
DAILY = SQL + ", e AS (SELECT source, CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS day, score FROM s), g AS (SELECT source, day, count(*) AS n, avg(score) AS mean FROM e GROUP BY 1, 2)"


def _daily(spark, sf):
    docs = read_texts(spark, sf)
    scored = L.sentiment(docs, "doc_id", _words(), _lexicon(spark, sf, docs)).join(docs.select("doc_id", "source"), "doc_id")
    return L.score_trend(scored.withColumn("day", F.expr("date_add(DATE '2024-01-01', CAST(doc_id % 60 AS INT))")), ["source"])


@query(DAILY + " SELECT source, day, n, round(mean + 1e-9, 3) AS mean FROM g")
def sentiment_by_day(spark, sf):
    return _daily(spark, sf).withColumn("mean", F.round(F.col("mean") + TIE, 3))


@query(DAILY + """, i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day) AS i, count(*) OVER (PARTITION BY source) AS c FROM g),
m AS (SELECT source, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, sum(mean * n) / sum(n) AS mean, sum(mean * n) FILTER (i <= c // 2) / sum(n) FILTER (i <= c // 2) AS a, sum(mean * n) FILTER (i > c // 2) / sum(n) FILTER (i > c // 2) AS b FROM i GROUP BY 1)
SELECT source, days, n, round(mean + 1e-9, 3) AS mean, CASE WHEN b - a > 0.1 THEN 'rising' WHEN b - a < -0.1 THEN 'falling' ELSE 'stable' END AS trend FROM m""")
def sentiment_direction(spark, sf):
    return L.score_direction(_daily(spark, sf), ["source"]).withColumn("mean", F.round(F.col("mean") + TIE, 3))


@query(SQL + """, k AS (SELECT word, lang, count(*) AS n FROM t GROUP BY 1, 2), o AS (SELECT word, lang AS category FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS total FROM k) WHERE total >= 5 AND n >= 0.9 * total),
b AS (SELECT doc_id, category, count(*) AS hits FROM t JOIN o USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, category) AS k FROM b)
SELECT d.doc_id, coalesce(category, 'neutral') AS tone, coalesce(hits, 0) AS hits FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND k = 1""")
def document_tones(spark, sf):
    """The language whose own words (nine tenths of their texts are of it) a text has most of."""
    docs = read_texts(spark, sf)
    counted = docs.select("lang", F.explode(F.array_distinct(_words())).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    total = counted.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "lang")).alias("m"))
    return L.tones(docs, "doc_id", _words(), total.where("total >= 5 and m.n >= 0.9 * total").select("word", F.col("m.lang").alias("category")))
