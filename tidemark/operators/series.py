"""Daily series, baselines, forecasts and anomalies. A series is (key, day, n) and is short: days, not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily(df: DataFrame, ts: str, keys: list[str], value: Column | None = None) -> DataFrame:
    """``keys, day, n`` and with ``value`` its ``total``."""
    out = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value is not None else [])]
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(*out)


def dense(series: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every day from the series' first to its last for every key, with 0 where the series has none."""
    span = series.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = series.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(F.sequence("first", "last")).alias("day"))  # one row
    return days.join(series, [*keys, "day"], "left").fillna(0, values)


def ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("day")


def moving_average(series: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Trailing mean of ``width`` days; over what there is at the start."""
    return series.withColumn("moving_average", F.avg(value).over(ordered(keys).rowsBetween(1 - width, 0)))


def smoothed(series: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """Exponential smoothing s = alpha * x + (1 - alpha) * s, from the first value: ``keys, last`` of each series."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("day", F.col(value).cast("double").alias("x")))), lambda p: p["x"])
    fold = F.aggregate(F.slice("points", F.lit(2), F.size("points")), F.element_at("points", 1), lambda s, x: alpha * x + (1 - alpha) * s)
    return series.groupBy(*keys).agg(points.alias("points")).select(*keys, fold.alias("last"))


def zscores(series: DataFrame, keys: list[str], value: str = "n", least: int = 3, threshold: float = 2.0) -> DataFrame:
    """Each day against the days before it: ``baseline_mean, baseline_std, z`` and a label.

    Fewer than ``least`` days before, or a flat baseline at the same value, is normal; a flat baseline at another is a spike or drop.
    """
    before = ordered(keys).rowsBetween(Window.unboundedPreceding, -1)
    out = series.withColumns({"days_before": F.count(value).over(before), "baseline_mean": F.avg(value).over(before), "baseline_std": F.stddev_pop(value).over(before)})
    flat = F.col("baseline_std") == 0
    z = F.when(~flat, (F.col(value) - F.col("baseline_mean")) / F.col("baseline_std")).when(F.col(value) == F.col("baseline_mean"), 0.0).when(F.col(value) > F.col("baseline_mean"), 99.0).otherwise(-99.0)
    out = out.withColumn("z", F.when(F.col("days_before") >= least, z))
    return out.withColumn("label", F.when(F.col("z") > threshold, "spike").when(F.col("z") < -threshold, "drop").otherwise("normal"))


def trend_line(series: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Least squares on the day's number: ``keys, days, slope, intercept, residual_std, last_i``."""
    numbered = series.withColumn("i", F.row_number().over(ordered(keys)) - 1)
    fit = numbered.groupBy(*keys).agg(F.count("*").alias("days"), F.regr_slope(value, "i").alias("slope"), F.regr_intercept(value, "i").alias("intercept"), F.max("i").alias("last_i"))
    residual = numbered.join(fit, keys).groupBy(*keys).agg(F.stddev_pop(F.col(value) - F.col("slope") * F.col("i") - F.col("intercept")).alias("residual_std"))
    return fit.join(residual, keys)


def halves(series: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Mean of the first and the second half of the days: ``keys, first_mean, second_mean, growth``."""
    w = Window.partitionBy(*keys)
    out = series.withColumns({"_i": F.row_number().over(ordered(keys)), "_n": F.count("*").over(w)})
    first = F.avg(F.when(F.col("_i") <= F.floor(F.col("_n") / 2), F.col(value)))
    second = F.avg(F.when(F.col("_i") > F.floor(F.col("_n") / 2), F.col(value)))
    out = out.groupBy(*keys).agg(first.alias("first_mean"), second.alias("second_mean"))
    return out.withColumn("growth", F.when(F.col("first_mean") > 0, (F.col("second_mean") - F.col("first_mean")) / F.col("first_mean")))


def autocorrelation(series: DataFrame, keys: list[str], lag: int, value: str = "n") -> DataFrame:
    """``keys, lag, autocorrelation``: 0 for a flat series."""
    w = Window.partitionBy(*keys)
    centred = series.withColumn("_x", F.col(value) - F.avg(value).over(w))
    pairs = centred.withColumn("_y", F.lag("_x", lag).over(ordered(keys)))
    total = F.sum(F.col("_x") * F.col("_x"))
    return pairs.groupBy(*keys).agg(F.when(total > 0, F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0.0)) / total).otherwise(0.0).alias("autocorrelation")).withColumn("lag", F.lit(lag))


def correlations(series: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Pearson correlation of every two keys' aligned series: ``a, b, r`` (a < b); 0 where a series is flat."""
    a, b = series.select(F.col(key).alias("a"), "day", F.col(value).alias("x")), series.select(F.col(key).alias("b"), "day", F.col(value).alias("y"))
    r = F.coalesce(F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y")), F.lit(0.0))
    return a.join(b, "day").where("a < b").groupBy("a", "b").agg(r.alias("r"))


def movers(df: DataFrame, ts: str, key: str, split: str, first: str, last: str) -> DataFrame:
    """Counts from ``split`` to ``last`` against ``first`` to ``split``, and the change in per cent (100 from nothing)."""
    at = F.to_date(ts)
    now, then = F.count_if((at >= split) & (at <= last)), F.count_if((at >= first) & (at < split))
    out = df.where((at >= first) & (at <= last)).groupBy(key).agg(now.alias("current"), then.alias("previous"))
    change = F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")) * 100.0 / F.col("previous")).when(F.col("current") > 0, 100.0).otherwise(0.0)
    return out.withColumn("change_pct", F.round(change, 2))


def _numbered(series: DataFrame, keys: list[str]) -> DataFrame:
    """With ``_i`` (from 1) and ``_c``, the number of days."""
    return series.withColumns({"_i": F.row_number().over(ordered(keys)), "_c": F.count("*").over(Window.partitionBy(*keys))})


def _mean(condition: Column, value: str = "n") -> Column:
    return F.avg(F.when(condition, F.col(value)))


def compound_growth(series: DataFrame, keys: list[str], days: int = 30) -> DataFrame:
    """``keys, growth``: growth a day from the first half's mean to the second's, over the last ``days`` days; 1 from nothing, 0 for one day."""
    i, width = F.col("_i"), F.least(F.col("_c"), F.lit(days))
    start = F.col("_c") - width
    half = start + F.floor(width / 2)
    g = _numbered(series, keys).groupBy(*keys).agg(_mean((i > start) & (i <= half)).alias("a"), _mean(i > half).alias("b"), F.max("_c").alias("c"))
    periods = F.greatest(F.floor(F.least(F.col("c"), F.lit(days)) / 2), F.lit(1))
    rate = F.round(F.pow(F.col("b") / F.col("a"), 1.0 / periods) - 1, 6)
    return g.select(*keys, F.when(F.col("c") < 2, 0.0).when(F.col("a") == 0, F.when(F.col("b") > 0, 1.0).otherwise(0.0)).otherwise(rate).alias("growth"))


def lifecycle(series: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, recent, mid, early, stage`` from the means of ten days at the end, in the middle and at the start of the last 90, and the growth rate."""
    i, c = F.col("_i"), F.col("_c")
    ten = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)) / 10.0
    m = _numbered(series, keys).where(c - i < 90).groupBy(*keys).agg(
        ten(i > c - 10).alias("recent"), ten((i > F.greatest(F.lit(0), F.floor(c / 2) - 5)) & (i <= F.floor(c / 2) + 5)).alias("mid"), ten(i <= 10).alias("early"), F.sum("n").alias("volume"), F.max("_c").alias("days"))
    recent, mid, early, growth = (F.col(x) for x in ("recent", "mid", "early", "growth"))
    stage = (
        F.when((F.col("days") < 10) | (F.col("volume") < 5), "emerging").when((growth > 0.03) & (recent > early * 2), "growing").when((growth > 0.003) & (recent > mid * 0.7), "mature")
        .when((growth < -0.01) & (recent < early * 0.5), "declining").when((growth > 0.01) & (recent > mid * 1.3) & (early < mid * 0.5), "resurging").when(recent > mid * 0.7, "mature")
        .when(recent < early * 0.3, "declining").when(growth > 0, "growing").otherwise("mature")
    )
    return m.join(compound_growth(series, keys), keys).select(*keys, "recent", "mid", "early", stage.alias("stage"))


def trend_changes(series: DataFrame, keys: list[str], window: int = 7, threshold: float = 2.0, value: str = "n") -> DataFrame:
    """``keys, day, kind, magnitude, t`` of the days where the means of the ``window`` days before and from then on differ by a pooled t above ``threshold``."""
    before, after = ordered(keys).rowsBetween(-window, -1), ordered(keys).rowsBetween(0, window - 1)
    x = _numbered(series, keys).withColumns({"mb": F.avg(value).over(before), "ma": F.avg(value).over(after), "sb": F.var_pop(value).over(before) * window, "sa": F.var_pop(value).over(after) * window})
    t = (F.col("ma") - F.col("mb")) / F.greatest(F.sqrt((F.col("sb") + F.col("sa")) / (2 * window - 2) * (2 / window)), F.lit(0.001))
    x = x.where((F.col("_i") > window) & (F.col("_i") <= F.col("_c") - window)).withColumn("t", t).where(F.abs("t") > threshold)
    return x.select(*keys, "day", F.when(F.col("t") > 0, "up").otherwise("down").alias("kind"), F.abs(F.col("ma") - F.col("mb")).alias("magnitude"), "t")


def direction(series: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """``keys, trend``: the last seven days' mean against the first seven's; stable below seven days."""
    m = _numbered(series, keys).groupBy(*keys).agg(_mean(F.col("_i") > F.col("_c") - 7, value).alias("recent"), _mean(F.col("_i") <= 7, value).alias("older"), F.max("_c").alias("days"))
    diff, limit = F.col("recent") - F.col("older"), F.greatest(F.lit(0.5), F.col("older") * 0.1)
    return m.select(*keys, F.when(F.col("days") < 7, "stable").when(diff > limit, "up").when(diff < -limit, "down").otherwise("stable").alias("trend"))


def half_shift(series: DataFrame, keys: list[str], value: str, threshold: float, relative: bool) -> DataFrame:
    """``keys, previous, current, change, is_shift``: the first half of the days against the second, in shares of the first or in units.

    A relative change from nothing is 1, or 0 to nothing.
    """
    half = F.floor(F.col("_c") / 2)
    m = _numbered(series, keys).groupBy(*keys).agg(_mean(F.col("_i") <= half, value).alias("previous"), _mean(F.col("_i") > half, value).alias("current"))
    diff = F.col("current") - F.coalesce("previous", F.lit(0.0))
    share = F.when(F.col("previous") > 0, diff / F.col("previous")).when(F.col("current") > 0, 1.0).otherwise(0.0)
    return m.withColumn("change", share if relative else diff).withColumn("is_shift", F.abs("change") > threshold)


def last_against_rest(series: DataFrame, keys: list[str], value: Column, threshold: float = 2.0, with_last: bool = False) -> DataFrame:
    """``keys, current, expected, z, label``: the last day's value against the mean and deviation of the days before (with_last: of all days); 0 for a flat series."""
    x = _numbered(series.withColumn("_v", value), keys)
    rest = F.lit(True) if with_last else F.col("_i") < F.col("_c")
    m = x.groupBy(*keys).agg(F.max(F.when(F.col("_i") == F.col("_c"), F.col("_v"))).alias("current"), _mean(rest, "_v").alias("expected"), F.stddev_pop(F.when(rest, F.col("_v"))).alias("std"))
    m = m.withColumn("expected", F.coalesce("expected", "current")).withColumn("z", F.when(F.col("std") > 1e-12, (F.col("current") - F.col("expected")) / F.col("std")).otherwise(0.0)).drop("std")
    return m.withColumn("label", F.when(F.col("z") > threshold, "spike").when(F.col("z") < -threshold, "drop").otherwise("normal"))
