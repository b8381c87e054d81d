"""Dashboards, holds, approvals, corrections, budgets, paths and dated entities, each on the tables that stand for its input."""

import calendar
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import graph as G
from tidemark.operators import holds as H
from tidemark.plans.registry import TIE, query, read, read_texts
from tidemark.plans.series import _events
from tidemark.sources.snapshots import Snapshot

# -- dashboards ----------------------------------------------------------------------------------------------------


@query("""SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) AS n FROM events GROUP BY 1""")
def items_per_hour(spark, sf):
    return _events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT trim(unnest(string_split(p_type, ' '))) AS topic FROM part) SELECT topic, count(*) AS n FROM t WHERE topic <> '' GROUP BY 1 ORDER BY n DESC, topic LIMIT 10""")
def top_topics(spark, sf):
    topics = read(spark, sf, "part").select(F.explode(F.transform(F.split("p_type", " "), F.trim)).alias("topic"))
    return topics.where("topic <> ''").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query("""SELECT round(avg(value) + 1e-9, 2) AS mean_value, round(count(*) / (24 * 3600.0) + 1e-9, 4) AS items_per_second, round(count(*) FILTER (event_type = 'error') * 1.0 / greatest(count(*), 1) + 1e-9, 4) AS error_rate, count(*) AS items FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def performance_metrics(spark, sf):
    e = _events(spark, sf)
    day = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS"))  # one row
    errors = F.count_if(F.col("event_type") == "error") / F.greatest(F.count("*"), F.lit(1))
    return day.agg(F.round(F.avg("value") + TIE, 2).alias("mean_value"), F.round(F.count("*") / (24 * 3600.0) + TIE, 4).alias("items_per_second"), F.round(errors + TIE, 4).alias("error_rate"), F.count("*").alias("items"))


@query("""WITH s AS (SELECT avg(CASE WHEN date_diff('day', o_orderdate, l_shipdate) <= 90 THEN 100.0 ELSE 0.0 END) AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT avg(up) AS up FROM (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 100.0 END) AS up FROM lineitem GROUP BY l_suppkey)), e AS (SELECT round(count(*) FILTER (event_type = 'error') * 1.0 / greatest(count(*), 1), 4) AS er FROM events)
SELECT round((ok + up + greatest(0, 100 - er * 100)) / 3 + 1e-9, 2) AS health FROM s, u, e""")
def health_score(spark, sf):
    """Mean of service-level compliance, mean availability of sources, and what errors leave of 100."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf, "lineitem")
    ok = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.avg(F.when(F.datediff("l_shipdate", "o_orderdate") <= 90, 100.0).otherwise(0.0)).alias("ok"))
    up = lines.groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(100.0)).alias("up")).agg(F.avg("up").alias("up"))
    errors = _events(spark, sf).agg(F.round(F.count_if(F.col("event_type") == "error") / F.greatest(F.count("*"), F.lit(1)), 4).alias("er"))
    return ok.crossJoin(up).crossJoin(errors).select(F.round((F.col("ok") + F.col("up") + F.greatest(F.lit(0.0), 100 - F.col("er") * 100)) / 3 + TIE, 2).alias("health"))  # one row each


@query("""SELECT source, count(*) AS items, count(DISTINCT lang) AS topics, round(count(*) / 30.0 + 1e-9, 2) AS a_day, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def workspace_overview(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("items"), F.countDistinct("lang").alias("topics"), F.round(F.count("*") / 30.0 + TIE, 2).alias("a_day"), F.sum("n_chars").cast("long").alias("chars"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS actors, CAST(max(ts) AS VARCHAR) AS latest FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def workspace_summary(spark, sf):
    e = _events(spark, sf)
    week = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS"))  # one row
    return week.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("actors"), F.max("ts").cast("string").alias("latest"))


@query("""WITH t(name) AS (VALUES ('the'), ('license'), ('und')), m AS (SELECT name, source, n_chars FROM documents, t WHERE regexp_matches(lower(text), '(^|[^a-z])' || name || '([^a-z]|$)')) SELECT name, count(*) AS mentions, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS engagement FROM m GROUP BY 1""")
def competitor_summary(spark, sf):
    """Each text is read once; names are whole words."""
    found = F.filter(F.array(*map(F.lit, ("the", "license", "und"))), lambda n: F.array_contains(F.col("w"), n))
    m = read_texts(spark, sf).select("source", "n_chars", F.split(F.lower("text"), "[^a-z]+").alias("w")).select("source", "n_chars", F.explode(found).alias("name"))
    return m.groupBy("name").agg(F.count("*").alias("mentions"), F.countDistinct("source").alias("sources"), F.sum("n_chars").cast("long").alias("engagement"))


# -- holds, approvals, corrections ---------------------------------------------------------------------------------

HOLDS = (("licenses", "license", 0), ("long", "", 5000))


@query("WITH h(hold, term, least) AS (VALUES " + ", ".join(map(str, HOLDS)) + ") SELECT hold, count(*) AS held, min(doc_id) AS first, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN h ON contains(lower(text), term) AND n_chars >= least GROUP BY 1")
def legal_holds(spark, sf):
    """Documents that meet each hold's term and length; the holds are a short list, so each text is read once for all."""
    text = F.lower("text")
    met = F.filter(F.array(*(F.when(text.contains(term) & (F.col("n_chars") >= least), F.lit(hold)) for hold, term, least in HOLDS)), lambda x: x.isNotNull())
    return read_texts(spark, sf).select("doc_id", "n_chars", F.explode(met).alias("hold")).groupBy("hold").agg(F.count("*").alias("held"), F.min("doc_id").alias("first"), F.sum("n_chars").cast("long").alias("chars"))


#: Documents as items: a source is its own domain and, with the language, its author; days go round in a year.
HELD = """WITH i AS (SELECT doc_id AS id, lower(substr(text, 1, 40) || ' ' || text || ' ' || source) AS txt, source, lang, source || '-' || lang AS author, 'http://' || source || '.example/' || doc_id AS url, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS published FROM documents),
h AS (SELECT DISTINCT source AS hold FROM documents), m AS (SELECT hold, id FROM h JOIN i ON i.source = h.hold AND contains(url, '//' || hold || '.') AND lang IN ('en', 'fr') AND author IN (hold || '-en', hold || '-fr') AND published >= DATE '2024-02-01' AND published <= DATE '2024-10-31' AND (contains(txt, 'license') OR contains(txt, 'the ')))"""


def _items_and_holds(spark, sf):
    d = read_texts(spark, sf)
    items = d.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), "source", F.array("lang").alias("topics"), F.concat_ws("-", "source", "lang").alias("author_name"),
        F.concat(F.lit("http://"), "source", F.lit(".example/"), "doc_id").alias("url"), F.expr("CAST(date_add(DATE '2024-01-01', CAST(doc_id % 365 AS INT)) AS TIMESTAMP)").alias("published_at"),
    )
    words = F.array(F.lit("License"), F.lit("the "))
    holds = d.select(F.col("source").alias("hold")).distinct().select(
        "hold", F.lit("active").alias("status"), words.alias("keywords"), F.array("hold").alias("sources"), F.array(F.lit("EN"), F.lit("fr")).alias("topics"), F.array(F.concat("hold", F.lit("-en")), F.concat("hold", F.lit("-fr"))).alias("authors"),
        F.array(F.concat(F.lit("//"), "hold", F.lit("."))).alias("domains"), F.lit("2024-02-01").cast("timestamp").alias("date_from"), F.lit("2024-10-31").cast("timestamp").alias("date_to"),
    )
    return items, holds


@query(HELD + " SELECT hold, id FROM m")
def hold_matches(spark, sf):
    """Items that meet all seven criteria of a hold; each source has one."""
    return H.held(*_items_and_holds(spark, sf))


@query(HELD + " SELECT hold, count(*) AS n, min(id) AS first FROM m GROUP BY 1")
def preserved_by_hold(spark, sf):
    """What is preserved for each hold, once more preserved, exported by hold and read back."""
    G.checkpoints(spark)
    items, holds = _items_and_holds(spark, sf)
    matches = H.held(items, holds).checkpoint()
    kept = H.preserved(items, matches, F.lit("2024-06-01"))
    at = f"{spark.sparkContext.getCheckpointDir()}/export-{uuid.uuid4().hex}"
    H.export(H.preserved(items, matches, F.lit("2024-07-01"), kept.checkpoint()), at)
    return spark.read.schema("id long, snapshot string, preserved_at timestamp, hold string").json(at).groupBy("hold").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("""SELECT doc_id, sha256(text) AS sha256, n_chars FROM documents WHERE contains(lower(text), 'license')""")
def preserved_content(spark, sf):
    return read_texts(spark, sf).where(F.lower("text").contains("license")).select("doc_id", F.sha2("text", 256).alias("sha256"), "n_chars")


@query("""SELECT o_orderpriority, count(*) AS pending, CAST(min(o_orderdate) AS VARCHAR) AS oldest FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') GROUP BY 1""")
def pending_approvals(spark, sf):
    waiting = read(spark, sf, "lineitem").where("l_linestatus = 'O'").select("l_orderkey")
    open_ = read(spark, sf, "orders").where("o_orderstatus = 'O'").join(waiting, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return open_.groupBy("o_orderpriority").agg(F.count("*").alias("pending"), F.min("o_orderdate").cast("string").alias("oldest"))


@query("""SELECT o_custkey, count(*) AS submitted, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'O') AS waiting FROM orders GROUP BY 1""")
def submissions(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("submitted"), F.count_if(F.col("o_orderstatus") == "F").alias("approved"), F.count_if(F.col("o_orderstatus") == "O").alias("waiting"))


@query("""SELECT CASE WHEN o_orderstatus <> 'O' THEN 'reviewed' WHEN o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY THEN 'revoked' ELSE 'pending' END AS action, count(*) AS n FROM orders GROUP BY 1""")
def auto_remediation(spark, sf):
    o = read(spark, sf, "orders").select("o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    late = F.col("at") < F.col("now") - F.expr("INTERVAL 365 DAYS")
    action = F.when(F.col("o_orderstatus") != "O", "reviewed").when(late, "revoked").otherwise("pending")
    return o.crossJoin(F.broadcast(o.agg(F.max("at").alias("now")))).groupBy(action.alias("action")).agg(F.count("*").alias("n"))  # one row


@query("""SELECT n_name, count(c_custkey) AS members, count(*) FILTER (c_mktsegment = 'BUILDING') AS builders, round(coalesce(avg(c_acctbal), 0) + 1e-9, 2) AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def workspaces(spark, sf):
    """Members are counted by workspace before the join, so every workspace is there."""
    counts = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("builders"), F.avg("c_acctbal").alias("balance"))
    out = read(spark, sf, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna(0, ["members", "builders", "balance"])
    return out.select("n_name", "members", "builders", F.round(F.col("balance") + TIE, 2).alias("balance"))


@query("""WITH fix AS (SELECT o_custkey AS k, max(o_orderpriority) AS segment FROM orders GROUP BY 1 HAVING count(*) > 20) SELECT c_custkey, coalesce(fix.segment, c_mktsegment) AS segment, fix.k IS NOT NULL AS corrected FROM customer LEFT JOIN fix ON k = c_custkey""")
def rectified_customers(spark, sf):
    """Corrections win over what is there; rows without one stay."""
    fix = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("segment"), F.count("*").alias("n")).where("n > 20")
    return read(spark, sf, "customer").join(fix, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.coalesce("segment", "c_mktsegment").alias("segment"), F.col("k").isNotNull().alias("corrected"))


@query("""WITH r AS (SELECT user_id, event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events) SELECT user_id, count(*) AS calls, count(*) FILTER (spent <= 100000) AS allowed, CAST(max(spent) AS BIGINT) AS spent FROM r GROUP BY 1""")
def budget_checks(spark, sf):
    """Calls that a user's running total of cents leaves within the budget."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = _events(spark, sf).select("user_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("spent"))
    return r.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("spent") <= 100_000).alias("allowed"), F.max("spent").alias("spent"))


# -- order, paths, entities ----------------------------------------------------------------------------------------

@query("""SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS position FROM part""")
def reordered_items(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, sf, "part").select("p_partkey", "p_brand", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("""SELECT lower(p_name) AS entity, CAST(max_by(p_partkey, (p_retailprice, -p_partkey)) AS BIGINT) AS best, count(*) AS n FROM part GROUP BY 1""")
def deduplicated_entities(spark, sf):
    """The most certain of the rows that share a name, the least id where they tie."""
    best = F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("less")))
    return read(spark, sf, "part").groupBy(F.lower("p_name").alias("entity")).agg((-best["less"]).alias("best"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS a, CAST(100 + o_custkey % 3 AS INTEGER) AS b FROM customer JOIN orders ON o_custkey = c_custkey), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), p1 AS (SELECT a, b, CAST(a AS VARCHAR) || '>' || b AS path FROM g WHERE a = 0),
p2 AS (SELECT p.a, g.b, p.path || '>' || g.b AS path FROM p1 p JOIN g ON g.a = p.b WHERE g.b <> p.a) SELECT path FROM (SELECT path FROM p1 WHERE b = 1 UNION ALL SELECT path FROM p2 WHERE b = 1)""")
def paths_between(spark, sf):
    """All paths without repeats of at most two steps between two nodes of an undirected graph."""
    customer, orders = read(spark, sf, "customer"), read(spark, sf, "orders")
    e = customer.join(orders, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("a"), (100 + F.col("o_custkey") % 3).cast("int").alias("b")).distinct()
    g = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = g.where("a = 0").select(F.array("a", "b").alias("path"))
    found = reached
    for _ in range(1):
        step = reached.join(g, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b")))
        reached = step.select(F.concat("path", F.array("b")).alias("path"))
        found = found.unionByName(reached)
    return found.where(F.element_at("path", -1) == 1).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, CAST(100 + o_custkey % 3 AS INTEGER) AS b FROM customer JOIN orders ON o_custkey = c_custkey), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT a.n_nationkey AS s, b.n_nationkey AS t FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 5),
r AS (SELECT s, t, [s] AS path FROM w UNION ALL SELECT s, t, list_append(path, g.b) FROM r JOIN g ON g.a = path[-1] WHERE path[-1] <> t AND len(path) <= 4 AND NOT list_contains(path, g.b))
SELECT s AS start, t AS "end", array_to_string(path, '>') AS path FROM r WHERE path[-1] = t AND s <> t""")
def paths_of_pairs(spark, sf):
    """All paths of at most four steps between neighbouring nations of a region, over shared groups of customers."""
    customer, orders, nation = read(spark, sf, "customer"), read(spark, sf, "orders"), read(spark, sf, "nation")
    links = customer.join(orders, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("a"), (100 + F.col("o_custkey") % 3).cast("int").alias("b"))
    ends = nation.select(F.col("n_nationkey").alias("end"), F.col("n_regionkey").alias("region"))
    pairs = nation.select(F.col("n_nationkey").alias("start"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") + 5).alias("end")).join(ends, ["region", "end"])
    return G.paths(links, pairs, 4).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("""SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_acctbal < -500) AS restored, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal >= 0 OR c_acctbal < -500 GROUP BY 1""")
def erased_and_restored(spark, sf):
    """A snapshot of the customers, without those in debt, of whom those of large debts come back from their archive."""
    G.checkpoints(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/snapshot-{uuid.uuid4().hex}"
    table, customers = Snapshot(spark, f"{at}/table"), read(spark, sf, "customer")
    table.create(customers, "c_custkey", 8)
    table.erase(customers.where("c_acctbal < 0 and c_acctbal >= -500").select("c_custkey"))
    table.erase(customers.where("c_acctbal < -500").select("c_custkey"), f"{at}/archive")
    table.restore(f"{at}/archive")
    return table.read().groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < -500).alias("restored"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def _any(*forms):
    return "(?:" + "|".join(forms) + ")"


#: A small grammar of dates. Months are the calendar's names or their first three letters.
YEAR, DAY, GAP = "[0-9]{4}", "[0-9]{1,2}", r"\s+"
MONTH = _any(*(name for full in calendar.month_name[1:] for name in (full.lower(), full[:3].lower())))
UNIT = {"near": ("week", "month", "quarter", "year"), "past": ("minute", "hour", "day", "week", "month")}
FORMS = {
    "date in words": MONTH + GAP + DAY + ",?" + GAP + YEAR,
    "month in words": MONTH + GAP + YEAR,
    "date in digits": "-".join((YEAR, "[0-9]{2}", "[0-9]{2}")),
    "date with strokes": "/".join((DAY, DAY, "[0-9]{2,4}")),
    "quarter": "q[1-4]" + GAP + YEAR,
    "near period": _any("last", "this", "next") + GAP + _any(*UNIT["near"]),
    "time ago": DAY + GAP + _any(*(f"{u}s?" for u in UNIT["past"])) + GAP + "ago",
    "day": _any("yesterday", "today", "tomorrow"),
}
#: How certain each form is.
CERTAINTY = {"date in words": 0.95, "date in digits": 0.9, "quarter": 0.9, "date with strokes": 0.85, "month in words": 0.85, "near period": 0.7, "time ago": 0.7, "day": 0.6}
#: One pass over a text finds every form; a match is told apart afterwards.
DATE = r"\b" + _any(*FORMS.values()) + r"\b"


def dates(text):
    """All dates of a text, leftmost and longest form first, with their certainty, in lower case."""

    def sure(x):
        out = F.lit(None).cast("double")
        for form in reversed(FORMS):
            out = F.when(x.rlike(f"^{FORMS[form]}$"), CERTAINTY[form]).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(DATE), F.lit(0)), lambda x: F.struct(x.alias("value"), sure(x).alias("sure")))


@query("WITH t AS (SELECT text || ' ' || (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AS text FROM documents), e AS (SELECT unnest(regexp_extract_all(lower(text), '" + DATE + "')) AS value FROM t) SELECT value, CASE "
       + " ".join(f"WHEN regexp_full_match(value, '{p}') THEN {CERTAINTY[form]}::DOUBLE" for form, p in FORMS.items()) + " END AS sure, count(*) AS n FROM e GROUP BY 1, 2")
def date_entities(spark, sf):
    first = read(spark, sf, "orders").agg(F.min(F.to_date("o_orderdate")).cast("string").alias("first"))
    t = read_texts(spark, sf).crossJoin(F.broadcast(first)).select(F.concat_ws(" ", "text", "first").alias("text"))  # one row
    return t.select(F.explode(dates(F.col("text"))).alias("e")).groupBy("e.value", "e.sure").agg(F.count("*").alias("n"))
