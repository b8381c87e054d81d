"""Fitted forecasts against plain recursions and exhaustive searches."""

import datetime
import math
from itertools import product

import numpy as np
import pytest

from tidemark.operators import forecasts as P

DAY = datetime.date(2024, 3, 1)


def holt_winters(x, m, a, b, g):
    """One series and one set of weights, as it is told."""
    seasonal = len(x) >= 2 * m
    if seasonal:
        level, trend = sum(x[:m]) / m, (sum(x[m : 2 * m]) - sum(x[:m])) / m / m
        s, first = [v - sum(x[:m]) / m for v in x[:m]], m
    else:
        level, trend, s, first = x[0], (x[1] - x[0] if len(x) > 1 else 0.0), [0.0] * m, 1
    sse = 0.0
    for t in range(first, len(x)):
        old = s[t % m]
        sse += (x[t] - level - trend - old) ** 2
        new = a * (x[t] - old) + (1 - a) * (level + trend)
        trend, level = b * (new - level) + (1 - b) * trend, new
        if seasonal:
            s[t % m] = g * (x[t] - level) + (1 - g) * old
    return sse, lambda k: max(0.0, level + k * trend + s[(len(x) + k - 1) % m])


def series(kind, n=40):
    rng = np.random.default_rng(len(kind))
    t = np.arange(n)
    return {"season": 50 + t + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n), "walk": 100 + np.cumsum(rng.normal(size=n)), "flat": np.full(n, 5.0), "zero": np.zeros(n), "short": np.array([3.0, 4.0, 8.0]), "one": np.array([7.0]), "none": np.array([])}[kind].tolist()


KINDS = ("season", "walk", "flat", "zero", "short", "one", "none")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, DAY, series(k), 1.5) for k in KINDS], "kind string, last_day date, points array<double>, mse double")


def by_kind(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["kind"], []).append(r)
    return {k: sorted(v, key=lambda r: r["day"]) for k, v in out.items()}


def test_holt_winters_of_stated_weights(rows):
    got = by_kind(P.holt_winters(rows, ["kind"], 10, (0.3, 0.1, 0.2)))
    assert got.keys() == set(KINDS) - {"none"}
    for kind, found in got.items():
        sse, ahead = holt_winters(series(kind), P.season_length(len(series(kind))), 0.3, 0.1, 0.2)
        assert [r["day"] for r in found] == [DAY + datetime.timedelta(k + 1) for k in range(10)]
        for k, r in enumerate(found):
            assert math.isclose(r["predicted"], ahead(k + 1), abs_tol=1e-9)
            wide = r["mse"] ** 0.5
            assert math.isclose(r["high_95"], r["predicted"] + 1.96 * wide, abs_tol=1e-9) and r["low_80"] == max(0.0, r["predicted"] - 1.282 * wide)


def test_holt_winters_fit_is_the_best_of_the_grid(rows):
    got = by_kind(P.holt_winters(rows, ["kind"], 2))
    for kind in ("season", "walk", "flat", "short"):
        x, r = series(kind), got[kind][0]
        m = P.season_length(len(x))
        grid = product(P.GRID, P.GRID, P.GRID if len(x) >= 2 * m else (0.0,))
        least = min(holt_winters(x, m, *w)[0] for w in grid)
        assert holt_winters(x, m, r["alpha"], r["beta"], r["gamma"])[0] <= least * (1 + 1e-9) + 1e-12
    assert all(abs(r["predicted"] - 5) < 1e-9 for r in got["flat"]) and all(r["predicted"] == 0 for r in got["zero"])
    x = series("season") # the season is found again
    truth = 50 + 41 + 10 * np.sin(2 * np.pi * 41 / 7)
    assert abs(got["season"][1]["predicted"] - truth) < 4


def arima_sse(x, ar, ma):
    d = [b - a for a, b in zip(x, x[1:], strict=False)]
    e, total = 0.0, 0.0
    for t in range(1, len(d)):
        e = d[t] - ar * d[t - 1] - ma * e
        total += e * e
    return total, e, d


def test_arima(rows):
    fixed, fitted = by_kind(P.arima(rows, ["kind"], 5, (0.5, -0.2))), by_kind(P.arima(rows, ["kind"], 5))
    for kind in KINDS[:-1]:
        x = series(kind)
        total, e, d = arima_sse(x, 0.5, -0.2)
        step, level = 0.5 * (d[-1] if d else 0.0) + -0.2 * e, x[-1]
        for k, r in enumerate(fixed[kind]):
            level += step * 0.5**k
            psi = [1.0, *(0.3 * 0.5 ** (j - 1) for j in range(1, k + 1))]
            variance = total / max(1, len(x) - 2) * sum(sum(psi[: j + 1]) ** 2 for j in range(k + 1))
            assert math.isclose(r["predicted"], max(0.0, level), abs_tol=1e-9) and math.isclose(r["high_95"], r["predicted"] + 1.96 * variance**0.5, abs_tol=1e-9)
        r = fitted[kind][0]
        assert arima_sse(x, r["ar"], r["ma"])[0] <= min(arima_sse(x, a, m)[0] for a in P.WEIGHTS for m in P.WEIGHTS) * (1 + 1e-9) + 1e-12
    assert all(r["predicted"] == 7.0 for r in fitted["one"]) and all(r["predicted"] == 5.0 for r in fitted["flat"])


def test_forecasts_of_no_series(rows):
    assert P.holt_winters(rows.limit(0), ["kind"], 3).count() == 0 and P.arima(rows.limit(0), ["kind"], 3).count() == 0


def test_weights_of_a_known_process(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=3000)
    d = np.zeros(3000)
    for t in range(1, 3000):
        d[t] = 0.6 * d[t - 1] + e[t] - 0.3 * e[t - 1]
    rows = spark.createDataFrame([(1, DAY, (1000 + np.cumsum(d)).tolist())], "k long, last_day date, points array<double>")
    r = P.arima(rows, ["k"], 1).first()
    assert abs(r["ar"] - 0.6) < 0.1 and abs(r["ma"] + 0.3) < 0.12
