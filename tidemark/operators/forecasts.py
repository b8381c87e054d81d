"""Fitted forecasts of many short series: additive Holt-Winters, and ARIMA(1, 1, 1) by conditional least squares.

A series is one row with its values in an array, so series are dealt out over all tasks; a task fits each by trying a whole grid of parameters at once (one
vector operation for each time step), then finer grids around the best. Fixed parameters take the same path with a grid of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights tried first, and how often the grid around the best is halved.
GRID, FINER = tuple(k / 10 for k in range(1, 10)), 4
#: Autoregressive and moving-average weights tried first.
WEIGHTS = tuple(k / 10 for k in range(-9, 10))


def series_rows(series: DataFrame, keys: list[str], value: str = "n", day: str = "day") -> DataFrame:
    """``keys, last_day, points``: each series in the order of its days; days without a value count as 0 only if the table says so."""
    of = series.groupBy(*keys).agg(F.max(day).alias("last_day"), F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).cast("double").alias("x")))).alias("s"))
    return of.select(*keys, "last_day", F.transform("s", lambda p: p["x"]).alias("points"))


def season_length(n: int, longest: int = 7) -> int:
    """Days of a season: half of the series, from 2 to ``longest``."""
    return min(longest, max(2, n // 2))


def holt_winters_errors(x: np.ndarray, season: int, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of squared one-step errors, level, trend and seasonal terms (latest ``season`` of them, the next one first) for each set of weights.

    The start: the mean of the first season, the mean step from the first to the second season, and the first season's distance from its mean. A series of
    fewer than two seasons has no seasonal terms, and starts with its first value and first step.
    """
    g = len(alpha)
    seasonal = len(x) >= 2 * season
    if seasonal:
        level = np.full(g, x[:season].mean())
        trend = np.full(g, (x[season : 2 * season].mean() - x[:season].mean()) / season)
        terms = np.repeat((x[:season] - x[:season].mean())[:, None], g, axis=1)
        first = season
    else:
        level, trend, terms, first = np.full(g, x[0]), np.full(g, x[1] - x[0] if len(x) > 1 else 0.0), np.zeros((season, g)), 1
    total = np.zeros(g)
    for t in range(first, len(x)):
        at = t % season
        s = terms[at].copy()
        error = x[t] - (level + trend + s)
        total += error * error
        before = level
        level = alpha * (x[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        if seasonal:
            terms[at] = gamma * (x[t] - level) + (1 - gamma) * s
    order = [(len(x) + k) % season for k in range(season)]
    return total, level, trend, terms[order]


def arima_errors(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squared errors of the first differences under each pair of weights, from the second difference on, and the last error."""
    d = np.diff(x)
    total, error = np.zeros(len(ar)), np.zeros(len(ar))
    for t in range(1, len(d)):
        error = d[t] - ar * d[t - 1] - ma * error
        total += error * error
    return total, error


def _best(errors, first: tuple[tuple[float, ...], ...], low: float, high: float, finer: int) -> tuple[float, ...]:
    """The weights of least error: of the first grid, then of ``finer`` grids around the best, each of half the step. Of equals the least weights."""

    def least(grid: list[tuple[float, ...]]) -> tuple[float, ...]:
        e = errors(*np.array(grid).T)
        return grid[int(np.flatnonzero(e <= e.min() * (1 + 1e-12))[0])]

    best = least(sorted(product(*first)))
    step = min(np.diff(first[0])) if len(first[0]) > 1 else 0.0
    for _ in range(finer if step else 0):
        step /= 2
        best = least(sorted(product(*([round(w + k * step, 9) for k in (-1, 0, 1) if low <= w + k * step <= high] for w in best))))
    return best


def holt_winters(rows: DataFrame, keys: list[str], ahead: int, weights: tuple[float, float, float] | None = None, longest: int = 7) -> DataFrame:
    """``keys, day, predicted, low_80, high_80, low_95, high_95, alpha, beta, gamma, mse`` for the ``ahead`` days after each series.

    rows: ``keys, last_day, points`` (see ``series_rows``). Without ``weights`` they are fitted for each series by least squared one-step errors. Predictions and lower bounds are at least 0; bounds are as wide as the errors' root mean square. Series of fewer
    than four points have no seasonal terms and trend weights; one without points gives no rows.
    """

    def one(x: np.ndarray) -> tuple:
        season = season_length(len(x), longest)
        grid = tuple((w,) for w in weights) if weights else (GRID, GRID, GRID if len(x) >= 2 * season else (0.0,))
        best = _best(lambda a, b, c: holt_winters_errors(x, season, a, b, c)[0], grid, 0.0, 1.0, FINER)
        total, level, trend, terms = holt_winters_errors(x, season, *(np.array([w]) for w in best))
        steps = len(x) - (season if len(x) >= 2 * season else 1)
        mse = float(total[0]) / max(1, steps)
        return best, mse, [max(0.0, float(level[0] + (k + 1) * trend[0] + terms[k % season, 0])) for k in range(ahead)], [mse**0.5] * ahead

    return _forecast(rows, keys, one, ("alpha", "beta", "gamma"))


def arima(rows: DataFrame, keys: list[str], ahead: int, weights: tuple[float, float] | None = None) -> DataFrame:
    """``keys, day, predicted, low_80, high_80, low_95, high_95, ar, ma, mse``: ARIMA(1, 1, 1) without a constant, fitted by conditional least squares.

    Bounds widen with the sums of the model's weights. Series of fewer than three points stay at their last value.
    """

    def one(x: np.ndarray) -> tuple:
        best = _best(lambda a, m: arima_errors(x, a, m)[0], tuple((w,) for w in weights) if weights else (WEIGHTS, WEIGHTS), -0.99, 0.99, FINER)
        ar, ma = best
        total, error = arima_errors(x, np.array([ar]), np.array([ma]))
        mse = float(total[0]) / max(1, len(x) - 2)
        step = ar * (x[-1] - x[-2] if len(x) > 1 else 0.0) + ma * float(error[0])
        level, psi, summed, spread, out, deviations = float(x[-1]), 1.0, 0.0, 0.0, [], []
        for k in range(ahead):
            level += step
            step *= ar
            psi = 1.0 if k == 0 else (ar + ma) * ar ** (k - 1)
            summed += psi
            spread += summed * summed
            out.append(max(0.0, level))
            deviations.append((mse * spread) ** 0.5)
        return best, mse, out, deviations

    return _forecast(rows, keys, one, ("ar", "ma"))


def _forecast(rows: DataFrame, keys: list[str], one, names: tuple[str, ...]) -> DataFrame:
    columns = [*names, "mse"]
    kept = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {kept[k]}" for k in keys), "last_day date", *(f"{c} double" for c in columns), "steps array<struct<predicted: double, deviation: double>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[len(p) > 0 for p in batch["points"]]]
            found = [one(np.asarray(p, np.float64)) for p in batch["points"]]
            out = batch[[*keys, "last_day"]].copy()
            for i, name in enumerate(names):
                out[name] = [float(f[0][i]) for f in found]
            out["mse"] = [f[1] for f in found]
            out["steps"] = [[{"predicted": p, "deviation": d} for p, d in zip(f[2], f[3], strict=True)] for f in found]
            yield out

    out = rows.select(*keys, F.col("last_day").cast("date").alias("last_day"), "points").mapInPandas(run, schema)
    out = out.select(*keys, "last_day", *columns, F.posexplode("steps").alias("_step", "_s"))
    p, d = F.col("_s.predicted"), F.col("_s.deviation")
    bounds = [b for name, z in (("80", 1.282), ("95", 1.96)) for b in (F.greatest(F.lit(0.0), p - z * d).alias(f"low_{name}"), (p + z * d).alias(f"high_{name}"))]
    return out.select(*keys, F.date_add("last_day", F.col("_step") + 1).alias("day"), p.alias("predicted"), *bounds, *columns)
