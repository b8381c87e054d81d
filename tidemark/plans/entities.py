"""Dictionary entities and relations of documents. The dictionary is made of the benchmark's items: what an item begins with and its long words are names."""

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import entities as E
from tidemark.plans.registry import TIE, query, read, read_texts


def _names(spark, sf):
    """The first two, three and four words of every item (the type is the number of words), and words of eight letters or more."""
    w = read(spark, sf, "benchmark").select("item_id", X.words(F.col("text"), 1).alias("w")).where("size(w) >= 4")
    sized = w.select("item_id", "w", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("n"))
    begun = sized.select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("name"), F.concat(F.lit("W"), F.col("n")).alias("type"), (F.lit(0.5) + F.col("n") * 0.1).alias("confidence"))
    return begun.unionByName(w.select(F.explode(F.array_distinct(F.filter("w", lambda x: F.length(x) >= 8))).alias("name"), F.lit("LONG").alias("type"), F.lit(0.55).alias("confidence")))


def _phrases(spark, sf):
    """The ten words that most items hold, each a relation of its own."""
    w = read(spark, sf, "benchmark").select(F.explode(F.array_distinct(X.words(F.col("text"), 2))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return w.orderBy(F.desc("n"), "name").limit(10).select("name", F.upper("name").alias("type"), F.lit(0.8).alias("confidence"))


#: Words with their places, by running lengths; names and their longest matches; sentences by place.
SQL = r"""
WITH RECURSIVE bw AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), 'https?://[^\s]+', ' ', 'g'), '[^a-z0-9]+'), lambda x: length(x) >= 1) AS w FROM benchmark),
names AS (SELECT array_to_string(w[1 : n], ' ') AS name, n, 'W' || n AS type, max(0.5 + n * 0.1)::DOUBLE AS confidence FROM bw, (VALUES (2), (3), (4)) v(n) WHERE len(w) >= 4 GROUP BY 1, 2, 3
  UNION ALL SELECT DISTINCT unnest(list_filter(w, lambda x: length(x) >= 8)), 1, 'LONG', 0.55::DOUBLE FROM bw WHERE len(w) >= 4),
phrases AS (SELECT name, 1 AS n, upper(name) AS type, 0.8::DOUBLE AS confidence FROM (SELECT DISTINCT item_id, unnest(list_filter(w, lambda x: length(x) >= 2)) AS name FROM bw) GROUP BY name ORDER BY count(*) DESC, name LIMIT 10),
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS word, unnest(regexp_split_to_array(text, '[\p{L}\p{N}]+')[: -2]) AS gap, unnest(range(1, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) + 1)) AS i FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')),
w AS (SELECT doc_id, i, lower(word) AS word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop, length(word) AS size FROM p),
g AS (SELECT doc_id, stop - size AS start, lead(stop, n - 1) OVER q AS stop, CASE n WHEN 1 THEN word WHEN 2 THEN word || ' ' || lead(word, 1) OVER q WHEN 3 THEN word || ' ' || lead(word, 1) OVER q || ' ' || lead(word, 2) OVER q
  ELSE word || ' ' || lead(word, 1) OVER q || ' ' || lead(word, 2) OVER q || ' ' || lead(word, 3) OVER q END AS gram FROM w, (VALUES (1), (2), (3), (4)) v(n) WINDOW q AS (PARTITION BY doc_id, n ORDER BY i)),
m AS (SELECT doc_id, start, stop, name, type, confidence FROM g JOIN names ON gram = name),
e AS (SELECT * FROM (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m) WHERE reach IS NULL OR reach < stop)
"""


@query(SQL + """SELECT doc_id, start, stop AS "end", name, type, confidence FROM e""")
def dictionary_entities(spark, sf):
    return E.dictionary_spans(read_texts(spark, sf), "doc_id", "text", _names(spark, sf))


TRIPLES = SQL + r""",
s0 AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2)) AS parts FROM documents),
s1 AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s0),
s AS (SELECT doc_id, CAST(coalesce(sum(length(replace(part, chr(1), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence_start, length(split_part(part, chr(1), 1)) AS size FROM s1),
t AS (SELECT doc_id, sentence_start FROM s WHERE size > 0),
es AS (SELECT e.*, sentence_start FROM e ASOF JOIN t ON e.doc_id = t.doc_id AND e.start >= t.sentence_start),
ps AS (SELECT x.doc_id, x.start, x.stop, x.name, x.type, x.confidence, sentence_start FROM (SELECT doc_id, start, stop, name, type, confidence FROM g JOIN phrases ON gram = name) x ASOF JOIN t ON x.doc_id = t.doc_id AND x.start >= t.sentence_start),
f AS (SELECT doc_id, sentence_start, name, arg_min(stop, start) AS stop, arg_min(type, start) AS type, min(start) AS start FROM es GROUP BY 1, 2, 3),
r AS (SELECT a.doc_id, a.sentence_start, a.name AS subject, a.type AS subject_type, a.start AS a_start, a.stop AS a_stop, b.name AS object, b.type AS object_type, b.start AS b_start, b.stop AS b_stop FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.sentence_start = b.sentence_start AND a.start < b.start AND a.stop <= b.start),
c AS (SELECT r.*, coalesce(ps.type, 'together') AS relation, CASE WHEN ps.name IS NULL THEN 0.4 WHEN ps.start - a_stop <= 1 AND b_start - ps.stop <= 1 THEN round(ps.confidence * least(1.0, (b_stop - a_start) / 10), 4) ELSE 0.6 END::DOUBLE AS confidence,
  row_number() OVER (PARTITION BY r.doc_id, r.sentence_start, subject, object ORDER BY length(ps.name) DESC NULLS LAST, ps.start) AS k FROM r LEFT JOIN ps ON ps.doc_id = r.doc_id AND ps.sentence_start = r.sentence_start AND ps.start >= a_stop AND ps.stop <= b_start),
z AS (SELECT doc_id, subject, subject_type, relation, object, object_type, confidence, sentence_start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, subject, relation, object ORDER BY confidence DESC, sentence_start) AS q FROM c WHERE k = 1) WHERE q = 1)
"""


def _triples(spark, sf):
    return E.relations(read_texts(spark, sf), "doc_id", "text", _names(spark, sf), _phrases(spark, sf), "together")


@query(TRIPLES + "SELECT * FROM z")
def relation_triples(spark, sf):
    return _triples(spark, sf)


@query(TRIPLES + "SELECT relation, count(*) AS n, count(DISTINCT doc_id) AS texts, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, round(avg(confidence) + 1e-9, 4) AS mean FROM z GROUP BY 1")
def relation_statistics(spark, sf):
    return E.relation_statistics(_triples(spark, sf), "doc_id").withColumn("mean", F.round(F.col("mean") + TIE, 4))
