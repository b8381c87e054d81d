"""Joins, grouped reports, rankings and set operations on activity, orders and documents."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.operators import filters as P
from tidemark.plans.registry import TIE, query, read

AS_OF = "2024-01-31"


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _share(n, total, digits=4):
    return F.round(n * 100.0 / total, digits)


# -- joins ---------------------------------------------------------------------------------------------------------

@query("""WITH v AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT user_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(coalesce(clicks, 0)) AS BIGINT) AS clicks, round(sum(coalesce(clicks, 0)) * 1.0 / sum(views), 4) AS ctr FROM v LEFT JOIN c USING (user_id, h) GROUP BY 1""")
def click_through_rate(spark, sf):
    hour = F.date_trunc("hour", "ts").alias("h")
    e = _events(spark, sf)
    views = e.where("event_type = 'view'").groupBy("user_id", hour).agg(F.count("*").alias("views"))
    clicks = e.where("event_type = 'click'").groupBy("user_id", hour).agg(F.count("*").alias("clicks"))
    n = F.sum(F.coalesce("clicks", F.lit(0)))
    return views.join(clicks, ["user_id", "h"], "left").groupBy("user_id").agg(F.sum("views").alias("views"), n.alias("clicks"), F.round(n / F.sum("views"), 4).alias("ctr"))


@query("""SELECT o_orderkey, count(l_orderkey) AS lines, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def groups_with_member_counts(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))  # before the join: one row for each key
    out = read(spark, sf, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_orderkey LIMIT 1""")
def largest_group(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_orderkey").limit(1)


@query("""SELECT o_orderkey, l_linenumber, o_orderpriority, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) > 90""")
def sla_breaches(spark, sf):
    days = F.datediff("l_shipdate", "o_orderdate").alias("days")
    return read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "o_orderpriority", days).where("days > 90")


@query("""SELECT s_suppkey, s_name, count(l_orderkey) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, round(coalesce(avg(l_quantity), 0), 4) AS mean_quantity, CASE WHEN count(l_orderkey) = 0 THEN 'idle' WHEN count(*) FILTER (l_returnflag = 'R') > 0.26 * count(l_orderkey) THEN 'warning' ELSE 'healthy' END AS status FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def source_health(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.avg("l_quantity").alias("mean_quantity"))
    out = read(spark, sf, "supplier").select("s_suppkey", "s_name").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").fillna(0, ["lines", "returned", "mean_quantity"])
    status = F.when(F.col("lines") == 0, "idle").when(F.col("returned") > 0.26 * F.col("lines"), "warning").otherwise("healthy")
    return out.select("s_suppkey", "s_name", "lines", "returned", F.round("mean_quantity", 4).alias("mean_quantity"), status.alias("status"))


@query("""SELECT c_custkey, c_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' GROUP BY 1, 2""")
def pending_reviews(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus = 'O' and o_orderpriority like '1%'")
    return o.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def membership_semi_join(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity > 40)""")
def unseen_items_anti_join(spark, sf):
    seen = read(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz '1996-01-01' and l_quantity > 40")
    return read(spark, sf, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query("""SELECT doc_id, t.term, CAST((length(lower(text)) - length(replace(lower(text), t.term, ''))) / length(t.term) AS BIGINT) AS hits FROM documents JOIN (VALUES ('the '), ('moron'), ('555-'), ('@mail')) t(term) ON contains(lower(text), t.term)""")
def theta_join_mentions(spark, sf):
    terms = spark.createDataFrame([(t,) for t in ("the ", "moron", "555-", "@mail")], "term string")
    d = read(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    hits = ((F.length("low") - F.length(F.replace("low", F.col("term"), F.lit("")))) / F.length("term")).cast("long")
    return d.join(F.broadcast(terms), F.col("low").contains(F.col("term"))).select("doc_id", "term", hits.alias("hits"))  # four terms


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS by_text, b.doc_id IS NOT NULL AS by_label, round((CASE WHEN a.doc_id IS NULL THEN 0 ELSE 1 END + CASE WHEN b.doc_id IS NULL THEN 0 ELSE 1 END) / 2.0, 4) AS score
FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'clown')) a FULL JOIN (SELECT doc_id FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id""")
def merged_results_full_outer(spark, sf):
    a = read(spark, sf, "documents").where(P.any_term("text", ["clown"])).select("doc_id", F.lit(True).alias("by_text"))
    b = read(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("by_label"))
    no = lambda c: F.coalesce(c, F.lit(False))
    out = a.join(b, "doc_id", "full").select("doc_id", no("by_text").alias("by_text"), no("by_label").alias("by_label"))
    return out.withColumn("score", F.round((F.col("by_text").cast("int") + F.col("by_label").cast("int")) / 2, 4))


@query("""WITH t AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations) SELECT conv_id, turn, role, parent, count(*) OVER (PARTITION BY conv_id) AS turns, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM t""")
def comment_threads(spark, sf):
    w = Window.partitionBy("conv_id")
    o = w.orderBy("turn")
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("turn").over(o).alias("parent"), F.count("*").over(w).alias("turns"), (F.row_number().over(o) - 1).cast("long").alias("depth"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT least(n.n_regionkey, CAST(n.n_nationkey // 5 AS INTEGER)) AS a, greatest(n.n_regionkey, CAST(n.n_nationkey // 5 AS INTEGER)) AS b FROM nation n WHERE n.n_regionkey <> CAST(n.n_nationkey // 5 AS INTEGER)), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT 0 AS node, 0 AS depth UNION SELECT g.b, w.depth + 1 FROM w JOIN g ON g.a = w.node WHERE w.depth < 3) SELECT CAST(node AS INTEGER) AS node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def relation_graph_bfs(spark, sf):
    read(spark, sf, "nation").createOrReplaceTempView("_nation")
    return spark.sql("""WITH RECURSIVE e AS (SELECT DISTINCT least(n_regionkey, CAST(n_nationkey div 5 AS INT)) AS a, greatest(n_regionkey, CAST(n_nationkey div 5 AS INT)) AS b FROM _nation WHERE n_regionkey <> CAST(n_nationkey div 5 AS INT)), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    w AS (SELECT 0 AS node, 0 AS depth UNION ALL SELECT g.b, w.depth + 1 FROM w JOIN g ON g.a = w.node WHERE w.depth < 3) SELECT CAST(node AS INT) AS node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node""")


# -- aggregations --------------------------------------------------------------------------------------------------

@query("""SELECT source, lang, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 4) AS pct, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1, 2""")
def source_breakdown(spark, sf):
    d = read(spark, sf, "documents")
    out = d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    return out.crossJoin(d.agg(F.count("*").alias("total"))).select("source", "lang", "n", _share(F.col("n"), F.col("total")).alias("pct"), "mean_chars")  # one total


@query("""SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2 UNION ALL
SELECT 'size', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END, count(*) FROM documents GROUP BY 2""")
def facets(spark, sf):
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    d = read(spark, sf, "documents").select("source", "lang", size.alias("size"))
    sets = d.select(F.expr("stack(3, 'source', source, 'lang', lang, 'size', size) AS (facet, value)"))
    return sets.groupBy("facet", "value").agg(F.count("*").alias("n"))  # one pass over the rows for all facets


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, count(*) FILTER (value = 0) AS zeros, CAST(max(ts) AS VARCHAR) AS last_seen, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def popular_searches(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.count_if(F.col("value") == 0).alias("zeros"), F.max("ts").cast("string").alias("last_seen"), F.countDistinct("user_id").alias("users"))


@query("""SELECT user_id, count(*) AS actions, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days, round(sum(value), 2) AS total, CAST(max_by(event_type, (n, event_type)) AS VARCHAR) AS favourite FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) GROUP BY 1""")
def user_activity(spark, sf):
    by_type = _events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.collect_set(F.to_date("ts")).alias("days"))
    return by_type.groupBy("user_id").agg(F.sum("n").alias("actions"), F.count("*").alias("kinds"), F.size(F.array_distinct(F.flatten(F.collect_list("days")))).cast("long").alias("days"), F.round(F.sum("v"), 2).alias("total"), F.max(F.struct("n", "event_type"))["event_type"].alias("favourite"))


@query("""SELECT isodow(ts) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def activity_heatmap(spark, sf):
    return _events(spark, sf).groupBy((F.weekday("ts") + 1).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT k.key || ':' || (props::JSON ->> k.key) AS facet, count(*) AS n FROM events, (SELECT unnest(json_keys(props::JSON)) AS key, event_id AS id FROM events) k WHERE k.id = event_id GROUP BY 1""")
def facets_used_in_json(spark, sf):
    pairs = _events(spark, sf).select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return pairs.groupBy(F.concat_ws(":", "key", "value").alias("facet")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partly, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 2) AS progress FROM orders GROUP BY 1""")
def review_status_pivot(spark, sf):
    status = read(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    total = F.col("F") + F.col("O") + F.col("P")
    return status.select("o_orderpriority", total.alias("total"), F.col("F").alias("done"), F.col("O").alias("open"), F.col("P").alias("partly"), F.round(F.col("F") * 100.0 / total, 2).alias("progress"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean FROM events GROUP BY GROUPING SETS ((CAST(ts AS DATE), event_type), (CAST(ts AS DATE)), (event_type), ())""")
def activity_cube(spark, sf):
    return _events(spark, sf).withColumn("day", F.to_date("ts").cast("string")).cube("day", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value") + TIE, 4).alias("mean"))


@query("""WITH r AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error' OR value < 5) AS noise, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) AS night FROM events GROUP BY 1), s AS (SELECT *, least(100, 100 * (0.5 * least(1, n / 100.0) + 0.3 * noise / n + 0.2 * night / n)) AS score FROM r)
SELECT user_id, n, round(noise * 1.0 / n, 4) AS noise_ratio, round(night * 1.0 / n, 4) AS night_ratio, round(score, 4) AS score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS tier FROM s""")
def alert_fatigue(spark, sf):
    r = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if((F.col("event_type") == "error") | (F.col("value") < 5)).alias("noise"), F.count_if((F.hour("ts") >= 22) | (F.hour("ts") < 6)).alias("night"))
    score = F.least(F.lit(100.0), 100 * (0.5 * F.least(F.lit(1.0), F.col("n") / 100.0) + 0.3 * F.col("noise") / F.col("n") + 0.2 * F.col("night") / F.col("n")))
    r = r.withColumn("score", score)
    return r.select("user_id", "n", F.round(F.col("noise") / F.col("n"), 4).alias("noise_ratio"), F.round(F.col("night") / F.col("n"), 4).alias("night_ratio"), F.round("score", 4).alias("score"), F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low").alias("tier"))


# -- filters, ranking, paging --------------------------------------------------------------------------------------

@query("""SELECT doc_id, source, lang, n_chars FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'que')) AND lang IN ('en', 'es') AND source <> 'src3' AND n_chars BETWEEN 200 AND 4000""")
def filtered_search(spark, sf):
    d = read(spark, sf, "documents").where(F.col("lang").isin("en", "es") & (F.col("source") != "src3") & F.col("n_chars").between(200, 4000))
    return d.where(P.any_term("text", ["the", "que"])).select("doc_id", "source", "lang", "n_chars")


@query("""SELECT doc_id, round(ln(n_chars + 1) * (1 + 0.2 * ((contains(lower(text), 'with'))::INT + (contains(lower(text), 'this'))::INT) / 2), 4) AS score FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' AND NOT contains(lower(text), 'moron')""")
def must_should_must_not(spark, sf):
    d = read(spark, sf, "documents").where("lang = 'en'")
    return P.boolean_search(d, F.log(F.col("n_chars") + 1), {"text": ["the"]}, {"text": ["with", "this"]}, {"text": ["moron"]}).select("doc_id", F.round("score", 4).alias("score"))


@query("""SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50""")
def page_of_results(spark, sf):
    return P.page(read(spark, sf, "documents").select("doc_id", "n_chars"), 3, 25, F.desc("n_chars"), F.col("doc_id"))


@query(f"""SELECT event_id, round(value * greatest(0.1, 1 - (epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 3600 / 720), 4) AS temporal, round(value + 0.1 * ln(value + 1), 4) AS engagement,
round(value * (1 + 0.5 * CASE WHEN (epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 3600 <= 24 THEN 1 WHEN (epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 3600 >= 168 THEN 0 ELSE (168 - (epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 3600) / 144 END), 4) AS fresh FROM events""")
def score_boosts(spark, sf):
    hours = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("ts")) / 1e6 / 3600
    e = _events(spark, sf).withColumn("h", hours)
    fresh = F.when(F.col("h") <= 24, 1.0).when(F.col("h") >= 168, 0.0).otherwise((168 - F.col("h")) / 144)
    return e.select("event_id", F.round(F.col("value") * F.greatest(F.lit(0.1), 1 - F.col("h") / 720), 4).alias("temporal"), F.round(F.col("value") + 0.1 * F.log(F.col("value") + 1), 4).alias("engagement"), F.round(F.col("value") * (1 + 0.5 * fresh), 4).alias("fresh"))


@query("""SELECT user_id, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3""")
def top_items_per_user(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return _events(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("user_id", "event_id", "value", "rank")


@query("""SELECT o_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_version(spark, sf):
    last = F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(last).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.date_format("m.o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("""SELECT user_id, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0) AS gap_us, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def request_gaps(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    return _events(spark, sf).select("user_id", "event_id", gap.alias("g")).select("user_id", "event_id", F.coalesce(F.col("g"), F.lit(0)).alias("gap_us"), F.when(F.col("g").isNull() | (F.col("g") > 1_800_000_000), 1).otherwise(0).alias("starts"))


@query("""SELECT user_id, CAST(max(c) AS BIGINT) AS busiest_minute FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS c FROM events) GROUP BY 1""")
def rate_limit_window(spark, sf):
    w = Window.partitionBy("user_id").orderBy((F.unix_micros("ts") / 1e6).cast("double")).rangeBetween(-60, 0)
    return _events(spark, sf).withColumn("c", F.count("*").over(w)).groupBy("user_id").agg(F.max("c").alias("busiest_minute"))


# -- set operations and diffs --------------------------------------------------------------------------------------

@query("""SELECT p_partkey, CASE WHEN p_size <= 10 AND p_retailprice > 1000 THEN 'both' WHEN p_size <= 10 THEN 'removed' ELSE 'added' END AS change FROM part WHERE p_size <= 10 OR p_retailprice > 1000""")
def version_diff(spark, sf):
    p = read(spark, sf, "part")
    old, new = p.where("p_size <= 10").select("p_partkey", F.lit(1).alias("old")), p.where("p_retailprice > 1000").select("p_partkey", F.lit(1).alias("new"))
    change = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), "both").when(F.col("old").isNotNull(), "removed").otherwise("added")
    return old.join(new, "p_partkey", "full").select("p_partkey", change.alias("change"))


@query("""SELECT source, text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT source, md5(text) AS text_hash, doc_id FROM documents) GROUP BY 1, 2""")
def insert_or_ignore(spark, sf):
    d = read(spark, sf, "documents").select("source", F.md5("text").alias("text_hash"), "doc_id")
    return d.groupBy("source", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT user_id, max(event_id) AS event_id, CAST(max_by(event_type, (ts, event_id)) AS VARCHAR) AS last_type FROM events GROUP BY 1""")
def upsert_last_write_wins(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("last_type"))


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2) EXCEPT SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)""")
def changed_since(spark, sf):
    n = lambda c: _events(spark, sf).where(c).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n("ts < '2024-01-16'").exceptAll(n("ts >= '2024-01-16'")).distinct()
