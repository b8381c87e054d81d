"""Forecasts of the daily counts of each kind of event."""

from pyspark.sql import functions as F

from tidemark.operators import forecasts as P
from tidemark.operators import series as S
from tidemark.plans.registry import query, read


def _rows(spark, sf):
    return P.series_rows(S.dense(S.daily(read(spark, sf, "events"), "ts", ["event_type"]), ["event_type"], ["n"]), ["event_type"])


def _shown(df, *names):
    return df.select("event_type", "day", *(F.round(c, 2).alias(c) for c in ("predicted", "low_80", "high_80", "low_95", "high_95")), *names)


SERIES = """c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT min(day) AS a, max(day) AS b FROM c),
d AS (SELECT event_type, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT event_type FROM c), e),
s AS (SELECT event_type, max(day) AS last_day, list(CAST(coalesce(n, 0) AS DOUBLE) ORDER BY day) AS x FROM d LEFT JOIN c USING (event_type, day) GROUP BY 1)"""
BOUNDS = "round(greatest(0.0, p - 1.282 * d), 2) AS low_80, round(p + 1.282 * d, 2) AS high_80, round(greatest(0.0, p - 1.96 * d), 2) AS low_95, round(p + 1.96 * d, 2) AS high_95"
#: A step of Holt-Winters for every set of weights, as a recursion over days; the seasonal terms are a list whose head is the oldest.
HOLT_WINTERS = """WITH RECURSIVE """ + SERIES + """, w AS (SELECT * FROM {weights}),
q AS (SELECT event_type, last_day, x, len(x) AS n, least(7, greatest(2, len(x) // 2)) AS m FROM s), u AS (SELECT *, n >= 2 * m AS seasonal FROM q),
r AS (SELECT event_type, x, n, m, seasonal, a, b, g, CASE WHEN seasonal THEN m ELSE 1 END AS t, CASE WHEN seasonal THEN list_avg(x[1 : m]) ELSE x[1] END AS l,
  CASE WHEN seasonal THEN (list_avg(x[m + 1 : 2 * m]) - list_avg(x[1 : m])) / m ELSE coalesce(x[2] - x[1], 0.0) END AS f,
  list_transform(x[1 : m], lambda v: CASE WHEN seasonal THEN v - list_avg(x[1 : m]) ELSE 0.0 END) AS z, 0.0::DOUBLE AS e FROM u, w
  UNION ALL SELECT event_type, x, n, m, seasonal, a, b, g, t + 1, k, b * (k - l) + (1 - b) * f, z[2 :] || [CASE WHEN seasonal THEN g * (x[t + 1] - k) + (1 - g) * z[1] ELSE 0.0 END], e + (x[t + 1] - (l + f + z[1])) * (x[t + 1] - (l + f + z[1]))
  FROM (SELECT *, a * (x[t + 1] - z[1]) + (1 - a) * (l + f) AS k FROM r WHERE t < n)),
h AS (SELECT r.event_type, last_day, a, b, g, e / greatest(1, r.n - CASE WHEN r.seasonal THEN r.m ELSE 1 END) AS mse, r.m, l, f, z FROM r JOIN u USING (event_type) WHERE t = r.n),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(mse, 9), a, b, g) AS o FROM h) WHERE o = 1),
y AS (SELECT event_type, CAST(last_day + CAST(i AS INTEGER) AS DATE) AS day, greatest(0.0, l + i * f + z[(i - 1) % m + 1]) AS p, sqrt(mse) AS d, a, b, g FROM k, range(1, 8) v(i))
SELECT event_type, day, round(p, 2) AS predicted, """ + BOUNDS + "{columns} FROM y"


@query(HOLT_WINTERS.format(weights="(VALUES (0.3::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE)) v(a, b, g)", columns=""))
def holt_winters_forecast(spark, sf):
    """A week by additive Holt-Winters of stated weights."""
    return _shown(P.holt_winters(_rows(spark, sf), ["event_type"], 7, (0.3, 0.1, 0.2)))


@query()
def holt_winters_fitted(spark, sf):
    """A week by additive Holt-Winters of weights fitted for each series; tested against an exhaustive search of the grid."""
    return _shown(P.holt_winters(_rows(spark, sf), ["event_type"], 7), "alpha", "beta", "gamma")


#: The errors of ARIMA(1, 1, 1) as a recursion over days.
@query("WITH RECURSIVE " + SERIES + """, r AS (SELECT event_type, last_day, x, 2 AS t, 0.0::DOUBLE AS e, 0.0::DOUBLE AS total FROM s
  UNION ALL SELECT event_type, last_day, x, t + 1, err, total + err * err FROM (SELECT *, (x[t + 1] - x[t]) - 0.4 * (x[t] - x[t - 1]) - -0.3 * e AS err FROM r WHERE t < len(x))),
h AS (SELECT event_type, last_day, x, e, total / greatest(1, len(x) - 2) AS mse FROM r WHERE t = greatest(2, len(x))),
b AS (SELECT event_type, last_day, x[-1] AS y, CASE WHEN len(x) > 1 THEN 0.4 * (x[-1] - x[-2]) ELSE 0.0 END + -0.3 * e AS step, mse, i FROM h, range(1, 8) v(i)),
g AS (SELECT event_type, CAST(last_day + CAST(i AS INTEGER) AS DATE) AS day, greatest(0.0, y + step * list_sum(list_transform(range(0, i), lambda j: pow(0.4, j)))) AS p,
  sqrt(mse * list_sum(list_transform(range(1, i + 1), lambda j: pow(1 + coalesce(list_sum(list_transform(range(1, j), lambda k: (0.4 - 0.3) * pow(0.4, k - 1))), 0), 2)))) AS d FROM b)
SELECT event_type, day, round(p, 2) AS predicted, """ + BOUNDS + " FROM g")
def arima_forecast(spark, sf):
    """A week by ARIMA(1, 1, 1) of stated weights."""
    return _shown(P.arima(_rows(spark, sf), ["event_type"], 7, (0.4, -0.3)))


@query()
def arima_fitted(spark, sf):
    """A week by ARIMA(1, 1, 1) of weights fitted for each series; tested against an exhaustive search of the grid."""
    return _shown(P.arima(_rows(spark, sf), ["event_type"], 7), "ar", "ma")
