"""Shifts and anomalies of series, service levels, escalations, alert noise, audits and erasure; ``event_type`` stands for a topic, ``user_id`` for a source or user."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import series as S
from tidemark.plans.registry import TIE, query, read
from tidemark.plans.series import DENSE, _dense, _events

NUMBERED = "i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM s)"


def _rounded(df, keys, *columns, digits=3):
    """The keys, the columns rounded, and the rest as it is."""
    return df.select(*keys, *(F.round(F.col(c) + TIE, digits).alias(c) for c in columns), *(c for c in df.columns if c not in (*keys, *columns)))


# -- series --------------------------------------------------------------------------------------------------------

@query(f"""WITH {DENSE}, {NUMBERED}, x AS (SELECT event_type, day, i, c, avg(n) OVER b AS mb, avg(n) OVER a AS ma, var_pop(n) OVER b * 7 AS sb, var_pop(n) OVER a * 7 AS sa FROM i WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
t AS (SELECT *, (ma - mb) / greatest(sqrt((sb + sa) / 12 * (2 / 7.0)), 0.001) AS t FROM x WHERE i > 7 AND i <= c - 7) SELECT event_type, CAST(day AS VARCHAR) AS day, CASE WHEN t > 0 THEN 'up' ELSE 'down' END AS kind, round(abs(ma - mb) + 1e-9, 2) AS magnitude, round(t + 1e-9, 3) AS t FROM t WHERE abs(t) > 2""")
def trend_changes(spark, sf):
    x = S.trend_changes(_dense(spark, sf), ["event_type"])
    return x.select("event_type", F.col("day").cast("string").alias("day"), "kind", F.round(F.col("magnitude") + TIE, 2).alias("magnitude"), F.round(F.col("t") + TIE, 3).alias("t"))


@query(f"""WITH {DENSE}, {NUMBERED}, m AS (SELECT event_type, any_value(c) AS c, avg(n) FILTER (i > c - 7) AS r, avg(n) FILTER (i <= 7) AS o FROM i GROUP BY 1) SELECT event_type, CASE WHEN c < 7 THEN 'stable' WHEN r - o > greatest(0.5, o * 0.1) THEN 'up' WHEN r - o < -greatest(0.5, o * 0.1) THEN 'down' ELSE 'stable' END AS trend FROM m""")
def trend_direction(spark, sf):
    return S.direction(_dense(spark, sf), ["event_type"])


HALVES = "m AS (SELECT event_type, avg({v}) FILTER (i <= c // 2) AS previous, avg({v}) FILTER (i > c // 2) AS current FROM i GROUP BY 1)"


@query(f"""WITH {DENSE}, {NUMBERED}, {HALVES.format(v="n")}, x AS (SELECT *, CASE WHEN previous > 0 THEN (current - previous) / previous WHEN current > 0 THEN 1.0 ELSE 0.0 END AS change FROM m)
SELECT event_type, round(previous + 1e-9, 3) AS previous, round(current + 1e-9, 3) AS current, round(change + 1e-9, 3) AS change, abs(change) > 0.5 AS is_shift FROM x""")
def topic_shift(spark, sf):
    return _rounded(S.half_shift(_dense(spark, sf), ["event_type"], "n", 0.5, True), ["event_type"], "previous", "current", "change")


@query("""WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) / 100 AS mood FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM s), m AS (SELECT event_type, avg(mood) FILTER (i <= c // 2) AS previous, avg(mood) FILTER (i > c // 2) AS current FROM i GROUP BY 1)
SELECT event_type, round(previous + 1e-9, 3) AS previous, round(current + 1e-9, 3) AS current, round(current - coalesce(previous, 0) + 1e-9, 3) AS change, abs(current - coalesce(previous, 0)) > 0.3 AS is_shift FROM m""")
def sentiment_shift(spark, sf):
    daily = S.daily(_events(spark, sf), "ts", ["event_type"], F.col("value")).withColumn("mood", F.col("total") / F.col("n") / 100)
    return _rounded(S.half_shift(daily, ["event_type"], "mood", 0.3, False), ["event_type"], "previous", "current", "change")


LAST = """m AS (SELECT {k}, max(v) FILTER (i = c) AS current, coalesce(avg(v) FILTER ({rest}), max(v) FILTER (i = c)) AS expected, stddev_pop(v) FILTER ({rest}) AS sd FROM i GROUP BY 1), z AS (SELECT *, CASE WHEN sd > 1e-12 THEN (current - expected) / sd ELSE 0.0 END AS z FROM m)
SELECT {k}, round(current + 1e-9, 3) AS current, round(expected + 1e-9, 3) AS expected, round(z + 1e-9, 3) AS z, CASE WHEN z > 2 THEN 'spike' WHEN z < -2 THEN 'drop' ELSE 'normal' END AS label FROM z"""


@query(f"""WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM s), {LAST.format(k="event_type", rest="i < c")}""")
def engagement_anomalies(spark, sf):
    daily = S.daily(_events(spark, sf), "ts", ["event_type"], F.col("value"))
    return _rounded(S.last_against_rest(daily, ["event_type"], F.col("total") / F.col("n")), ["event_type"], "current", "expected", "z")


@query(f"""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM s), {LAST.format(k="user_id", rest="true")}""")
def new_source_checks(spark, sf):
    daily = S.daily(_events(spark, sf), "ts", ["user_id"])
    return _rounded(S.last_against_rest(daily, ["user_id"], F.col("n").cast("double"), with_last=True), ["user_id"], "current", "expected", "z")


@query(f"""WITH {DENSE}, {NUMBERED}, {HALVES.format(v="n")}, e AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), j AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM e),
a AS (SELECT event_type, max(v) FILTER (i = c) AS v, avg(v) FILTER (i < c) AS m, stddev_pop(v) FILTER (i < c) AS sd FROM j GROUP BY 1)
SELECT 'topic_shift' AS kind, event_type, CASE WHEN previous > 0 THEN abs(current - previous) / previous > 0.5 ELSE current > 0 END AS found FROM m UNION ALL SELECT 'engagement', event_type, CASE WHEN sd > 1e-12 THEN abs((v - m) / sd) > 2 ELSE false END FROM a""")
def all_checks(spark, sf):
    shift = S.half_shift(_dense(spark, sf), ["event_type"], "n", 0.5, True).select(F.lit("topic_shift").alias("kind"), "event_type", F.col("is_shift").alias("found"))
    daily = S.daily(_events(spark, sf), "ts", ["event_type"], F.col("value"))
    engaged = S.last_against_rest(daily, ["event_type"], F.col("total") / F.col("n")).select(F.lit("engagement").alias("kind"), "event_type", (F.col("label") != "normal").alias("found"))
    return shift.unionByName(engaged)


# -- service levels and escalations --------------------------------------------------------------------------------

@query("""WITH c AS (SELECT o_orderpriority AS sla, date_diff('day', o_orderdate, l_shipdate) <= 90 AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT count(DISTINCT sla) AS slas, count(*) AS checks, count(*) FILTER (ok) AS compliant, round(count(*) FILTER (ok) * 100.0 / greatest(count(*), 1) + 1e-9, 2) AS rate FROM c""")
def sla_summary(spark, sf):
    c = _sla_checks(spark, sf)
    return c.agg(F.countDistinct("sla").alias("slas"), F.count("*").alias("checks"), F.count_if("ok").alias("compliant")).withColumn("rate", F.round(F.col("compliant") * 100.0 / F.greatest("checks", F.lit(1)) + TIE, 2))


def _sla_checks(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("sla"), "o_orderdate")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("sla", (F.datediff("l_shipdate", "o_orderdate") <= 90).alias("ok"))


@query("""SELECT o_orderpriority AS sla, count(*) AS breaches FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) > 90 GROUP BY 1 ORDER BY breaches DESC, sla LIMIT 10""")
def top_breaching_slas(spark, sf):
    return _sla_checks(spark, sf).where("not ok").groupBy("sla").agg(F.count("*").alias("breaches")).orderBy(F.desc("breaches"), "sla").limit(10)


@query("""WITH e AS (SELECT o_orderkey, any_value(o_orderpriority) AS policy, any_value(o_orderdate) AS started, min(l_shipdate) AS acknowledged, max(l_shipdate) AS resolved FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT policy, count(*) AS escalations, round(avg(epoch(acknowledged) - epoch(started)) + 1e-9, 1) AS to_acknowledge, round(avg(epoch(resolved) - epoch(started)) + 1e-9, 1) AS to_resolve FROM e GROUP BY 1""")
def escalation_stats(spark, sf):
    """An order is an escalation: acknowledged by its first shipment, resolved by its last."""
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    shipped = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    e = read(spark, sf, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    mean = lambda c: F.round(F.avg(seconds(c) - seconds("o_orderdate")) + TIE, 1)
    return e.groupBy(F.col("o_orderpriority").alias("policy")).agg(F.count("*").alias("escalations"), mean("first").alias("to_acknowledge"), mean("last").alias("to_resolve"))


# -- alert noise ---------------------------------------------------------------------------------------------------

NOISE, SIGNAL = ("error", "view"), ("purchase", "signup")


def _noise(df):
    noise, signal = F.count_if(F.col("event_type").isin(*NOISE)), F.count_if(F.col("event_type").isin(*SIGNAL))
    return df.agg(noise.alias("noise"), signal.alias("signal")).withColumn("ratio", F.when(F.col("noise") + F.col("signal") > 0, F.round(F.col("noise") / (F.col("noise") + F.col("signal")) + TIE, 3)).otherwise(0.0))


NOISE_SQL = f"count(*) FILTER (event_type IN {NOISE}) AS noise, count(*) FILTER (event_type IN {SIGNAL}) AS signal, CASE WHEN count(*) FILTER (event_type IN {NOISE + SIGNAL}) > 0 THEN round(count(*) FILTER (event_type IN {NOISE}) * 1.0 / count(*) FILTER (event_type IN {NOISE + SIGNAL}) + 1e-9, 3) ELSE 0.0 END AS ratio"


@query(f"""SELECT {NOISE_SQL} FROM events""")
def noise_ratio(spark, sf):
    return _noise(_events(spark, sf).groupBy())


@query(f"""SELECT user_id, {NOISE_SQL} FROM events GROUP BY 1""")
def noise_ratio_by_rule(spark, sf):
    return _noise(_events(spark, sf).groupBy("user_id"))


@query(f"""SELECT user_id, count(*) FILTER (event_type IN {NOISE}) AS noise, count(*) AS total, round(count(*) FILTER (event_type IN {NOISE}) * 1.0 / count(*) + 1e-9, 3) AS ratio FROM events GROUP BY 1 HAVING count(*) FILTER (event_type IN {NOISE}) > 0 ORDER BY noise DESC, user_id LIMIT 10""")
def top_noise_sources(spark, sf):
    g = _events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type").isin(*NOISE)).alias("noise"), F.count("*").alias("total")).where("noise > 0")
    return g.withColumn("ratio", F.round(F.col("noise") / F.col("total") + TIE, 3)).orderBy(F.desc("noise"), "user_id").limit(10)


@query("""WITH n AS (SELECT max(ts) AS now FROM events), u AS (SELECT user_id, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) / 24.0 AS rate, least(100.0, count(*) FILTER (value < 5) * 100.0 / count(*)) AS fatigue FROM events, n GROUP BY 1)
SELECT user_id, round(rate + 1e-9, 2) AS rate, fatigue > 50 OR rate > 3 AS recommend, CASE WHEN NOT (fatigue > 50 OR rate > 3) THEN 'realtime' WHEN rate > 10 THEN 'hourly' WHEN rate > 3 THEN 'daily' ELSE 'every_6h' END AS frequency FROM u""")
def digest_suggestions(spark, sf):
    e = _events(spark, sf)
    now = e.agg(F.max("ts").alias("now"))
    g = e.crossJoin(F.broadcast(now)).groupBy("user_id").agg((F.count_if(F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS")) / 24.0).alias("rate"), F.least(F.lit(100.0), F.count_if(F.col("value") < 5) * 100.0 / F.count("*")).alias("fatigue"))  # one row
    recommend = (F.col("fatigue") > 50) | (F.col("rate") > 3)
    frequency = F.when(~recommend, "realtime").when(F.col("rate") > 10, "hourly").when(F.col("rate") > 3, "daily").otherwise("every_6h")
    return g.select("user_id", F.round(F.col("rate") + TIE, 2).alias("rate"), recommend.alias("recommend"), frequency.alias("frequency"))


# -- audits, shares, erasure ---------------------------------------------------------------------------------------

@query("""SELECT 'day' AS section, CAST(CAST(ts AS DATE) AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'action', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'total', 'events', count(*) FROM events UNION ALL SELECT 'total', 'actors', count(DISTINCT user_id) FROM events""")
def audit_summary(spark, sf):
    """One scan with grouping sets for days and actions, and one for the totals."""
    e = _events(spark, sf).select(F.to_date("ts").cast("string").alias("day"), "event_type", "user_id")
    sets = e.groupingSets([["day"], ["event_type"]], "day", "event_type").agg(F.count("*").alias("n"), F.grouping("day").alias("no_day"))
    sections = sets.select(F.when(F.col("no_day") == 0, "day").otherwise("action").alias("section"), F.when(F.col("no_day") == 0, F.col("day")).otherwise(F.col("event_type")).alias("key"), "n")
    totals = e.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("actors")).select(F.lit("total").alias("section"), F.explode(F.create_map(F.lit("events"), "events", F.lit("actors"), "actors")).alias("key", "n"))
    return sections.unionByName(totals)


@query("""SELECT coalesce(round(count(*) FILTER (o_orderstatus <> 'O') * 100.0 / nullif(count(*), 0) + 1e-9, 2), 100.0) AS score FROM orders""")
def compliance_score(spark, sf):
    return read(spark, sf, "orders").agg(F.coalesce(F.round(F.try_divide(F.count_if(F.col("o_orderstatus") != "O") * 100.0, F.count("*")) + TIE, 2), F.lit(100.0)).alias("score"))


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def reactions(spark, sf):
    return _events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, count(*) AS accesses, count(DISTINCT event_type) AS visitors, CAST(max(ts) AS VARCHAR) AS last_access, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 20) AS latest FROM r GROUP BY 1""")
def share_analytics(spark, sf):
    """The latest 20 are ranked before they are gathered, so no list grows with a share's accesses."""
    ranked = _events(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    latest = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 20, F.struct("r", "event_id")))), lambda x: x["event_id"].cast("string")))
    return ranked.groupBy("user_id").agg(F.count("*").alias("accesses"), F.countDistinct("event_type").alias("visitors"), F.max("ts").cast("string").alias("last_access"), latest.alias("latest"))


@query("""SELECT p_brand, count(*) AS versions, CAST(max(p_size) AS INTEGER) AS newest, CAST(min(p_size) AS INTEGER) AS oldest, count(*) FILTER (p_retailprice > 1500) AS changed FROM part GROUP BY 1""")
def version_stats(spark, sf):
    return read(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("versions"), F.max("p_size").alias("newest"), F.min("p_size").alias("oldest"), F.count_if(F.col("p_retailprice") > 1500).alias("changed"))


@query("""SELECT event_type, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean, round(sum(value), 2) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def boost_impact(spark, sf):
    e = _events(spark, sf)
    recent = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS"))  # one row
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value") + TIE, 4).alias("mean"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'customer' AS tbl, count(*) FILTER (c_custkey IN (SELECT c_custkey FROM gone)) AS erased, count(*) FILTER (c_custkey NOT IN (SELECT c_custkey FROM gone)) AS kept FROM customer UNION ALL SELECT 'orders', count(*) FILTER (o_custkey IN (SELECT c_custkey FROM gone)), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM gone)) FROM orders""")
def erasure_counts(spark, sf):
    """What erasing the subjects of a request (here: with a debt) removes from each table and leaves."""
    gone = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("subject"), F.lit(True).alias("gone"))
    def counted(name, key):
        df = read(spark, sf, name).select(F.col(key).alias("subject")).join(gone, "subject", "left")
        return df.agg(F.count_if("gone").alias("erased"), F.count_if(F.col("gone").isNull()).alias("kept")).select(F.lit(name).alias("tbl"), "erased", "kept")
    return counted("customer", "c_custkey").unionByName(counted("orders", "o_custkey"))


# -- texts by script -----------------------------------------------------------------------------------------------

SCRIPTS = {"latin": r"[A-Za-z\x{C0}-\x{24F}]", "cyrillic": r"[\x{400}-\x{4FF}]", "arabic": r"[\x{600}-\x{6FF}]", "han": r"[\x{4E00}-\x{9FFF}]", "kana": r"[\x{3040}-\x{30FF}]", "hangul": r"[\x{AC00}-\x{D7AF}]", "thai": r"[\x{E00}-\x{E7F}]"}


@query("SELECT script, count(*) AS docs, CAST(sum(n) AS BIGINT) AS letters FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS script, len(regexp_extract_all(text, '{v}')) AS n FROM documents" for k, v in SCRIPTS.items()) + ") WHERE n > 0 GROUP BY 1")
def script_counts(spark, sf):
    """Letters of each script: every text is read once."""
    counts = F.array(*(F.struct(F.lit(k).alias("script"), F.regexp_count("text", F.lit(v)).alias("n")) for k, v in SCRIPTS.items()))
    return read(spark, sf, "documents").select(F.explode(counts).alias("s")).where("s.n > 0").groupBy("s.script").agg(F.count("*").alias("docs"), F.sum("s.n").cast("long").alias("letters"))
