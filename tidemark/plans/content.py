"""Deduplication, vectors, compliance, alerting and workflow queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions.vectors import cosine
from tidemark.operators import compliance as C
from tidemark.operators import dedup as D
from tidemark.operators import text_stats as T
from tidemark.operators import vectors as V
from tidemark.operators.graph import components
from tidemark.plans.registry import TIE, query, read, read_texts

AS_OF = "2024-01-31"


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# -- deduplication -------------------------------------------------------------------------------------------------

URL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\.)?', ''), '#.*$', ''), '([?&])((utm_[a-z]+|ref|source)=[^&]*(&|$))+', '\1', 'g'), '[?&]+$', ''), '/+$', '')"""


@query(f"""SELECT {URL} AS key, min(page_id) AS leader, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 1""")
def url_duplicates(spark, sf):
    return D.groups_by_key(read(spark, sf, "pages"), X.normal_url(F.col("url")), "page_id", 1)


@query("""SELECT md5(text) AS key, min(doc_id) AS leader, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, sf):
    return D.groups_by_key(read(spark, sf, "documents"), F.md5("text"), "doc_id")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(lower(a.p_name), lower(b.p_name)) * 1.0 / greatest(length(a.p_name), length(b.p_name), 1), 4) AS ratio FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
WHERE 1 - levenshtein(lower(a.p_name), lower(b.p_name)) * 1.0 / greatest(length(a.p_name), length(b.p_name), 1) >= 0.6""")
def similar_titles(spark, sf):
    return D.similar_titles(read(spark, sf, "part"), "p_partkey", "p_name", F.struct("p_brand", "p_type", "p_size"), 0.6).withColumn("ratio", F.round("ratio", 4))


#: Unit TF-IDF vectors of whole texts, their links of cosine 0.85 or more, and the classes that links close transitively.
CLASSES = r"""t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT doc_id, word, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word)), v AS (SELECT doc_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS cosine FROM v a JOIN v b ON a.word = b.word AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.85),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), c AS (SELECT node AS doc_id, min(root) AS grp FROM r GROUP BY 1)"""


def _content_links(spark, sf, spanning=False):
    return D.content_links(read_texts(spark, sf), "doc_id", T.hashed(X.words(F.col("text"), 3)), 0.85, spanning)


@query(f"""WITH RECURSIVE {CLASSES} SELECT a, b, round(cosine, 4) AS cosine FROM l WHERE a < b""")
def content_duplicates(spark, sf):
    return D.all_pairs(*_content_links(spark, sf)).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query(f"""WITH RECURSIVE {CLASSES} SELECT grp, CAST(max_by(doc_id, (length(text), n_chars, -doc_id)) AS BIGINT) AS survivor, CAST(max(length(text)) AS INTEGER) AS length, max(n_chars) AS greatest, count(*) AS n FROM documents JOIN c USING (doc_id) GROUP BY 1""")
def merged_duplicates(spark, sf):
    """The survivor of each class of texts that link by content, directly or through others."""
    docs = read(spark, sf, "documents")
    copies, links = _content_links(spark, sf, spanning=True)
    links = links.select("a", "b").unionByName(copies.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")))
    groups = components(links).select(F.col("node").alias("doc_id"), "component")
    return D.merged(docs.join(groups, "doc_id", "left").withColumn("grp", F.coalesce("component", "doc_id")), "grp", "doc_id", "text", "n_chars")


@query("""SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS r FROM part) WHERE r = 1""")
def first_by_title(spark, sf):
    return D.keep_first(read(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), F.lower(F.trim("p_name")), ["p_partkey"])


# -- vectors -------------------------------------------------------------------------------------------------------

KNN = "SELECT q.vec_id AS query, b.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0"


@query(f"""SELECT query, id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ({KNN})) WHERE rank <= 10""")
def nearest_neighbours(spark, sf):
    e = read(spark, sf, "embeddings")
    return V.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10).withColumn("score", F.round("score", 4))


@query()
def diverse_neighbours(spark, sf):
    e = read(spark, sf, "embeddings")
    near = V.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 30)
    return V.mmr(near.join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").select("query", "id", "score", "v"), 5)


@query("""SELECT label, i, round(avg(x), 4) + 0.0 AS mean, count(*) AS n FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2""")
def cluster_centers(spark, sf):
    c = V.centroids(read(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x"), "n").select("label", F.col("i").cast("long").alias("i"), (F.round("x", 4) + F.lit(0.0)).alias("mean"), "n")


@query("""WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)
SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], c), 4) AS distance FROM embeddings JOIN c USING (label) WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], c) > 0.3""")
def cluster_outliers(spark, sf):
    e = read(spark, sf, "embeddings")
    out = e.join(V.centroids(e, "label", "embedding"), "label").select("vec_id", "label", (1 - cosine(F.col("embedding"), F.col("centroid"))).alias("d"))
    return out.where("d > 0.3").select("vec_id", "label", F.round("d", 4).alias("distance"))


@query("""WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1), d AS (SELECT vec_id, c.label, 1 - list_cosine_similarity(embedding::DOUBLE[], c) AS d FROM embeddings, c)
SELECT vec_id, CAST(min_by(label, (d, label)) AS INTEGER) AS nearest, round(min(d) + 1e-9, 3) AS distance FROM d GROUP BY 1""")
def cluster_assignment(spark, sf):
    e = read(spark, sf, "embeddings")
    return V.assigned(e, "vec_id", "embedding", V.centroids(e, "label", "embedding"), "label").withColumn("distance", F.round(F.col("distance") + TIE, 3))


@query("""WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(1 - list_cosine_similarity(a.e, b.e)) AS m FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), s AS (SELECT vec_id, own, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM d GROUP BY 1, 2)
SELECT own AS label, round(avg(CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) + 1e-9, 3) AS silhouette, count(*) AS n FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def cluster_silhouettes(spark, sf):
    s = V.silhouettes(read(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return s.groupBy("label").agg(F.round(F.avg("silhouette") + TIE, 3).alias("silhouette"), F.count("*").alias("n"))


SYNONYMS = {"the": ("a", "this"), "and": ("plus", "with"), "not": ("no",)}


@query("SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split(lower(text), ' '), lambda w: w <> ''), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '({' OR '.join((k, *v))})'" for k, v in SYNONYMS.items()) + " ELSE w END), ' ') AS expanded FROM conversations WHERE role = 'user'")
def expanded_queries(spark, sf):
    """Each word that has synonyms becomes a choice of all of them."""
    known = F.create_map(*(F.lit(x) for k, v in SYNONYMS.items() for x in (k, f"({' OR '.join((k, *v))})")))
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    return read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(known, w), w)), " ").alias("expanded"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT source, CAST(r AS INTEGER) AS rank, '- **document ' || doc_id || '** (' || lang || ', ' || n_chars || ' characters)' AS line FROM r WHERE r <= 5""")
def source_digest(spark, sf):
    """The lines of a listing for each source: its five longest texts."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    r = read(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return r.select("source", "rank", F.format_string("- **document %d** (%s, %d characters)", "doc_id", "lang", "n_chars").alias("line"))


# -- compliance ----------------------------------------------------------------------------------------------------

LEVELS = [("restricted", ["token = ", "password"]), ("confidential", [r"\+1 \([0-9]{3}\)", "@mail[0-9]"]), ("internal", ["[0-9]{1,3}([.][0-9]{1,3}){3}"])]


@query(r"""SELECT CASE WHEN regexp_matches(text, 'token = |password') THEN 'restricted' WHEN regexp_matches(text, '\+1 \([0-9]{3}\)|@mail[0-9]') THEN 'confidential' WHEN regexp_matches(text, '[0-9]{1,3}([.][0-9]{1,3}){3}') THEN 'internal' ELSE 'public' END AS level, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1""")
def classification_levels(spark, sf):
    d = read_texts(spark, sf).select("doc_id", C.classified(F.col("text"), LEVELS).alias("level"))
    return d.groupBy("level").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 20 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 1.0 ELSE 0.0 END AS shouting, CASE WHEN regexp_matches(text, '!{4,}|[?]{4,}|[*]{4,}') THEN 1.0 ELSE 0.0 END AS runs,
CASE WHEN len(regexp_extract_all(text, 'https?://')) >= 3 THEN 1.0 ELSE 0.0 END AS links, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(moron|idiot|scum)([^a-z]|$)') THEN 1.0 ELSE 0.0 END AS words FROM documents)
SELECT doc_id, CAST(shouting AS DOUBLE) AS shouting, CAST(runs AS DOUBLE) AS runs, CAST(links AS DOUBLE) AS links, CAST(words AS DOUBLE) AS words, shouting + runs + links + words = 0 AS approved FROM s""")
def moderation(spark, sf):
    scores = C.moderation(F.col("text"), ["moron", "idiot", "scum"])
    return read_texts(spark, sf).select("doc_id", *(c.alias(k) for k, c in scores.items())).withColumn("approved", F.col("shouting") + F.col("runs") + F.col("links") + F.col("words") == 0)


@query(f"""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(min(ts) AS VARCHAR) AS oldest FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '{AS_OF}') > CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 14 ELSE 21 END GROUP BY 1""")
def retention_dry_run(spark, sf):
    days = F.when(F.col("event_type") == "click", 7).when(F.col("event_type") == "view", 14).otherwise(21)
    return C.expired(_events(spark, sf), "ts", AS_OF, days).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").cast("string").alias("oldest"))


@query("""SELECT 'customer' AS tbl, c_custkey AS subject, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'orders', o_custkey, count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 2 UNION ALL SELECT 'lineitem', o_custkey, count(*) FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 2""")
def subject_access(spark, sf):
    """How many rows of each table belong to each subject; lines are counted by order before they meet the orders."""
    subjects = read(spark, sf, "customer").select(F.col("c_custkey").alias("subject"))
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    owned = orders.groupBy("subject").agg(F.count("*").alias("orders"), F.sum("lines").alias("lineitem")).join(subjects.distinct(), "subject", "left_semi")
    each = owned.select("subject", F.explode(F.create_map(F.lit("orders"), "orders", F.lit("lineitem"), "lineitem")).alias("tbl", "n")).where("n > 0")
    return subjects.groupBy("subject").agg(F.count("*").alias("n")).select(F.lit("customer").alias("tbl"), "subject", "n").unionByName(each.select("tbl", "subject", "n"))


@query("""WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id || ':' || event_type AS p FROM events), c AS (SELECT user_id, seq, sha256('|' || p) AS hash FROM r WHERE seq = 0 UNION ALL SELECT r.user_id, r.seq, sha256(c.hash || '|' || r.p) FROM c JOIN r ON r.user_id = c.user_id AND r.seq = c.seq + 1)
SELECT user_id, CAST(seq AS INTEGER) AS seq, hash FROM c""")
def audit_hash_chain(spark, sf):
    return C.chained(_events(spark, sf), "user_id", ["ts", "event_id"], F.concat_ws(":", "event_id", "event_type"))


@query("""SELECT conv_id, turn, CAST(contains(lower(text), 'ignore')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'system')::INT AS INTEGER) AS hits FROM conversations WHERE role = 'user'""")
def prompt_scan(spark, sf):
    low = F.lower("text")
    return read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", sum((low.contains(p).cast("int") for p in ("ignore", "the", "system")), F.lit(0)).alias("hits"))


# -- alerting and workflow -----------------------------------------------------------------------------------------

@query("""SELECT user_id, CAST(max(ts) AS VARCHAR) AS newest, round((SELECT epoch(max(ts)) FROM events) / 3600 - epoch(max(ts)) / 3600, 3) AS age_hours, (SELECT epoch(max(ts)) FROM events) - epoch(max(ts)) > 24 * 3600 AS stale FROM events GROUP BY 1""")
def freshness_sla(spark, sf):
    e = _events(spark, sf)
    newest = e.agg(F.max("ts").alias("now"))
    out = e.groupBy("user_id").agg(F.max("ts").alias("newest")).crossJoin(newest)  # one row
    age = (F.unix_micros("now") - F.unix_micros("newest")) / 1e6
    return out.select("user_id", F.col("newest").cast("string").alias("newest"), F.round(age / 3600, 3).alias("age_hours"), (age > 24 * 3600).alias("stale"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events WHERE value > 50) SELECT user_id, event_type, count(*) AS fired, count(*) FILTER (before IS NOT NULL AND epoch(ts) - epoch(before) < 86400) AS suppressed FROM o GROUP BY 1, 2""")
def alert_suppression(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    o = _events(spark, sf).where("value > 50").withColumn("gap", F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)))
    return o.groupBy("user_id", "event_type").agg(F.count("*").alias("fired"), F.count_if(F.col("gap") < 86_400_000_000).alias("suppressed"))


@query("""SELECT event_type, CASE WHEN value >= 80 THEN 'critical' WHEN value >= 40 THEN 'normal' ELSE 'low' END AS branch, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def workflow_branches(spark, sf):
    branch = F.when(F.col("value") >= 80, "critical").when(F.col("value") >= 40, "normal").otherwise("low")
    return _events(spark, sf).groupBy("event_type", branch.alias("branch")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT event_id, user_id, CASE WHEN value < 2 THEN 'too small' ELSE 'bad type' END AS error FROM events WHERE value < 2 OR event_type = 'error'""")
def dead_letters(spark, sf):
    error = F.when(F.col("value") < 2, "too small").when(F.col("event_type") == "error", "bad type")
    return _events(spark, sf).select("event_id", "user_id", error.alias("error")).where("error is not null")
