"""Time series, forecasts and anomalies over events."""

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.plans.registry import query, read

FIRST, LAST = "2024-01-01", "2024-01-30"  # the periods that top_movers compares
#: Every day from the table's first to its last, for every key.
DENSE = """days AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS day),
keys AS (SELECT DISTINCT event_type FROM events),
counts AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2),
s AS (SELECT k.event_type, d.day, CAST(coalesce(c.n, 0) AS BIGINT) AS n, coalesce(c.total, 0.0) AS total FROM keys k CROSS JOIN days d LEFT JOIN counts c ON c.event_type = k.event_type AND c.day = d.day)"""


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _dense(spark, sf):
    return S.dense(S.daily(_events(spark, sf), "ts", ["event_type"], F.col("value")), ["event_type"], ["n", "total"])


@query(f"""WITH {DENSE}, b AS (SELECT *, count(n) OVER w AS days_before, avg(n) OVER w AS m, stddev_pop(n) OVER w AS sd FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN days_before < 3 THEN NULL WHEN sd <> 0 THEN (n - m) / sd WHEN n = m THEN 0.0 WHEN n > m THEN 99.0 ELSE -99.0 END AS z FROM b)
SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(m, 4) AS baseline_mean, round(sd, 4) AS baseline_std, round(z, 4) AS z,
CASE WHEN z > 2 THEN 'spike' WHEN z < -2 THEN 'drop' ELSE 'normal' END AS label FROM z""")
def volume_anomalies(spark, sf):
    out = S.zscores(_dense(spark, sf), ["event_type"])
    return out.select("event_type", F.col("day").cast("string").alias("day"), "n", *(F.round(c, 4).alias(c) for c in ("baseline_mean", "baseline_std", "z")), "label")


@query(f"""WITH {DENSE} SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(total, 4) AS total FROM s""")
def dense_daily_series(spark, sf):
    return _dense(spark, sf).select("event_type", F.col("day").cast("string").alias("day"), "n", F.round("total", 4).alias("total"))


@query(f"""WITH {DENSE} SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving_average FROM s""")
def moving_average_7d(spark, sf):
    out = S.moving_average(_dense(spark, sf), ["event_type"], "n", 7)
    return out.select("event_type", F.col("day").cast("string").alias("day"), "n", F.round("moving_average", 4).alias("moving_average"))


@query(f"""WITH RECURSIVE {DENSE}, i AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM s),
e AS (SELECT event_type, i, CAST(n AS DOUBLE) AS s FROM i WHERE i = 1 UNION ALL SELECT i.event_type, i.i, 0.3 * i.n + 0.7 * e.s FROM e JOIN i ON i.event_type = e.event_type AND i.i = e.i + 1)
SELECT event_type, round(s, 4) AS last FROM e WHERE i = (SELECT max(i) FROM i)""")
def exponential_smoothing(spark, sf):
    return S.smoothed(_dense(spark, sf), ["event_type"], "n", 0.3).select("event_type", F.round("last", 4).alias("last"))


@query(f"""WITH {DENSE}, i AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM s),
f AS (SELECT event_type, count(*) AS days, regr_slope(n, i) AS slope, regr_intercept(n, i) AS intercept, max(i) AS last_i FROM i GROUP BY 1),
r AS (SELECT i.event_type, stddev_pop(n - slope * i - intercept) AS sd FROM i JOIN f USING (event_type) GROUP BY 1)
SELECT event_type, h AS day_ahead, round(greatest(0, intercept + slope * (last_i + h)), 4) AS forecast, round(greatest(0, intercept + slope * (last_i + h) - 2 * sd), 4) AS low, round(greatest(0, intercept + slope * (last_i + h) + 2 * sd), 4) AS high
FROM f JOIN r USING (event_type) CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS h)""")
def linear_forecast(spark, sf):
    fit = S.trend_line(_dense(spark, sf), ["event_type"]).withColumn("day_ahead", F.explode(F.sequence(F.lit(1), F.lit(7))))
    at = F.col("intercept") + F.col("slope") * (F.col("last_i") + F.col("day_ahead"))
    bound = lambda c: F.round(F.greatest(F.lit(0.0), c), 4)
    return fit.select("event_type", "day_ahead", bound(at).alias("forecast"), bound(at - 2 * F.col("residual_std")).alias("low"), bound(at + 2 * F.col("residual_std")).alias("high"))


@query(f"""WITH {DENSE}, i AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM s),
h AS (SELECT event_type, avg(n) FILTER (i <= c // 2) AS a, avg(n) FILTER (i > c // 2) AS b FROM i GROUP BY 1)
SELECT event_type, round(a, 4) AS first_mean, round(b, 4) AS second_mean, round(CASE WHEN a > 0 THEN (b - a) / a END, 4) AS growth FROM h""")
def half_over_half_growth(spark, sf):
    return S.halves(_dense(spark, sf), ["event_type"]).select("event_type", *(F.round(c, 4).alias(c) for c in ("first_mean", "second_mean", "growth")))


@query(f"""WITH {DENSE}, c AS (SELECT event_type, day, n - avg(n) OVER (PARTITION BY event_type) AS x FROM s), p AS (SELECT *, lag(x, 7) OVER (PARTITION BY event_type ORDER BY day) AS y FROM c)
SELECT event_type, CAST(7 AS INTEGER) AS lag, round(CASE WHEN sum(x * x) > 0 THEN coalesce(sum(x * y), 0) / sum(x * x) ELSE 0 END, 4) AS autocorrelation FROM p GROUP BY 1""")
def weekly_autocorrelation(spark, sf):
    return S.autocorrelation(_dense(spark, sf), ["event_type"], 7).select("event_type", "lag", F.round("autocorrelation", 4).alias("autocorrelation"))


@query(f"""WITH {DENSE} SELECT x.event_type AS a, y.event_type AS b, round(coalesce(CASE WHEN stddev_pop(x.n) > 0 AND stddev_pop(y.n) > 0 THEN corr(x.n, y.n) END, 0), 4) AS r FROM s x JOIN s y ON x.day = y.day AND x.event_type < y.event_type GROUP BY 1, 2""")
def topic_correlations(spark, sf):
    return S.correlations(_dense(spark, sf), "event_type").select("a", "b", F.round("r", 4).alias("r"))


@query("""SELECT event_type, count(*) FILTER (d >= DATE '2024-01-16') AS current, count(*) FILTER (d < DATE '2024-01-16') AS previous,
round(CASE WHEN count(*) FILTER (d < DATE '2024-01-16') > 0 THEN (count(*) FILTER (d >= DATE '2024-01-16') - count(*) FILTER (d < DATE '2024-01-16')) * 100.0 / count(*) FILTER (d < DATE '2024-01-16') WHEN count(*) FILTER (d >= DATE '2024-01-16') > 0 THEN 100.0 ELSE 0.0 END, 2) AS change_pct
FROM (SELECT event_type, CAST(ts AS DATE) AS d FROM events) WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1""")
def top_movers(spark, sf):
    return S.movers(_events(spark, sf), "ts", "event_type", "2024-01-16", FIRST, LAST)


@query(f"""WITH {DENSE}, d AS (SELECT isodow(day) AS weekday, sum(n) AS n FROM s GROUP BY day), k AS (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS weekday)
SELECT k.weekday, round(coalesce(avg(n), 0), 4) AS mean, round(coalesce(stddev_pop(n), 0), 4) AS std, CAST(coalesce(min(n), 0) AS BIGINT) AS low, CAST(coalesce(max(n), 0) AS BIGINT) AS high, count(n) AS days FROM k LEFT JOIN d ON d.weekday = k.weekday GROUP BY 1""")
def weekday_pattern(spark, sf):
    days = _dense(spark, sf).groupBy("day").agg(F.sum("n").alias("n")).withColumn("weekday", F.weekday("day") + 1)
    all_days = spark.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return all_days.join(days, "weekday", "left").groupBy("weekday").agg(
        F.round(zero(F.avg("n")), 4).alias("mean"), F.round(zero(F.stddev_pop("n")), 4).alias("std"), zero(F.min("n")).cast("long").alias("low"), zero(F.max("n")).cast("long").alias("high"), F.count("n").alias("days"))


@query("""WITH h AS (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour), c AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1)
SELECT h.hour, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM events), 4) AS pct, coalesce(n, 0) * 100.0 / (SELECT count(*) FROM events) > 1.5 * 100 / 24 AS is_peak FROM h LEFT JOIN c USING (hour)""")
def peak_hours(spark, sf):
    counts = _events(spark, sf).groupBy(F.hour("ts").alias("hour")).count()
    total = counts.agg(F.sum("count").alias("total"))
    out = spark.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").crossJoin(total)  # 24 rows, one total
    pct = F.coalesce("count", F.lit(0)) * 100.0 / F.col("total")
    return out.select("hour", F.coalesce("count", F.lit(0)).cast("long").alias("n"), F.round(pct, 4).alias("pct"), (pct > 1.5 * 100 / 24).alias("is_peak"))


GROWTH = """i AS (SELECT event_type, day, n, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM s),
g AS (SELECT event_type, any_value(c) AS c, avg(n) FILTER (i > c - 30 AND i <= c - least(c, 30) + least(c, 30) // 2) AS a, avg(n) FILTER (i > c - least(c, 30) + least(c, 30) // 2) AS b, least(any_value(c), 30) // 2 AS periods FROM i GROUP BY 1),
r AS (SELECT event_type, c, CASE WHEN c < 2 THEN 0.0 WHEN a = 0 THEN CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END ELSE round(pow(b / a, 1.0 / greatest(periods, 1)) - 1, 6) END AS growth FROM g)"""


@query(f"""WITH {DENSE}, {GROWTH} SELECT event_type, round(growth + 1e-9, 5) AS growth FROM r""")
def compound_growth(spark, sf):
    return S.compound_growth(_dense(spark, sf), ["event_type"]).select("event_type", F.round(F.col("growth") + 1e-9, 5).alias("growth"))


@query(f"""WITH {DENSE}, {GROWTH}, m AS (SELECT event_type, sum(n) FILTER (i > c - 10) / 10.0 AS recent, sum(n) FILTER (i > greatest(0, c // 2 - 5) AND i <= c // 2 + 5) / 10.0 AS mid, sum(n) FILTER (i <= 10) / 10.0 AS early, sum(n) AS volume FROM i WHERE c - i < 90 GROUP BY 1)
SELECT event_type, recent, mid, early, CASE WHEN c < 10 OR volume < 5 THEN 'emerging' WHEN growth > 0.03 AND recent > early * 2 THEN 'growing' WHEN growth > 0.003 AND recent > mid * 0.7 THEN 'mature' WHEN growth < -0.01 AND recent < early * 0.5 THEN 'declining'
WHEN growth > 0.01 AND recent > mid * 1.3 AND early < mid * 0.5 THEN 'resurging' WHEN recent > mid * 0.7 THEN 'mature' WHEN recent < early * 0.3 THEN 'declining' WHEN growth > 0 THEN 'growing' ELSE 'mature' END AS stage FROM m JOIN r USING (event_type)""")
def topic_lifecycle(spark, sf):
    return S.lifecycle(_dense(spark, sf), ["event_type"])


@query(f"""WITH {DENSE}, f AS (SELECT event_type, n, avg(n) OVER w AS p, lag(n) OVER o AS naive FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, round(avg(abs(n - p)), 4) AS mae, round(sqrt(avg((n - p) * (n - p))), 4) AS rmse, round(avg(CASE WHEN n > 0 THEN abs(n - p) * 100.0 / n END), 4) AS mape, round(avg(abs(n - p)) / nullif(avg(abs(n - naive)), 0), 4) AS mase FROM f WHERE p IS NOT NULL GROUP BY 1""")
def forecast_accuracy(spark, sf):
    f = _dense(spark, sf).withColumns({"p": F.avg("n").over(S.ordered(["event_type"]).rowsBetween(-7, -1)), "naive": F.lag("n").over(S.ordered(["event_type"]))}).where("p is not null")
    error = F.abs(F.col("n") - F.col("p"))
    return f.groupBy("event_type").agg(
        F.round(F.avg(error), 4).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"), F.round(F.avg(F.when(F.col("n") > 0, error * 100.0 / F.col("n"))), 4).alias("mape"),
        F.round(F.avg(error) / F.nullif(F.avg(F.abs(F.col("n") - F.col("naive"))), F.lit(0)), 4).alias("mase"))
