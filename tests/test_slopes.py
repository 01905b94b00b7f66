"""Exact median slopes against all pairs, in one task and in cells of blocks."""

import numpy as np
import pytest

from tilth.operators import robust, slopes


def all_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    keep = x[i] != x[j]
    return float(np.median((y[j[keep]] - y[i[keep]]) / (x[j[keep]] - x[i[keep]]))) if keep.any() else None


def data(kind, n, rng):
    x = rng.integers(0, max(2, n // 3), n).astype(float) if kind % 2 else rng.random(n) * 100
    return x, [2 * x + rng.standard_normal(n), np.round(x + rng.integers(0, 3, n)), rng.standard_cauchy(n), np.zeros(n), x * 3.0, rng.integers(0, 4, n).astype(float), -1e6 * x + rng.random(n), np.exp(rng.standard_normal(n) * 5)][kind]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40, 60, 400, 5000])
@pytest.mark.parametrize("kind", range(8))
def test_equals_all_pairs(n, kind):
    x, y = data(kind, n, np.random.default_rng(n * 10 + kind))
    got, want = slopes.median_slope(x, y), all_pairs(x, y)
    assert got == want or abs(got - want) <= 1e-9 * max(1.0, abs(want))
    if kind in (0, 2) and n > 1:
        assert got == want


def test_counts_and_lists_of_passed_pairs():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 60))
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 12, n).astype(float)
        i, j = np.triu_indices(n, 1)
        keep = x[i] != x[j]
        s = (y[j[keep]] - y[i[keep]]) / (x[j[keep]] - x[i[keep]])
        lo, hi = sorted(rng.standard_normal(2))
        assert slopes.passed(x, y, lo) == (s <= lo).sum() and slopes.passed(x, y, np.inf) == len(s) and slopes.passed(x, y, -np.inf) == 0
        a, b = slopes.between(x, y, lo, hi)
        assert sorted(slopes.slopes_of(x, y, a, b)) == sorted(s[(s > lo) & (s <= hi)])


def test_groups_and_cells(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g, (kind, n) in enumerate([(0, 900), (1, 700), (5, 650), (2, 40), (3, 8), (0, 1)]):
        x, y = data(kind, n, rng)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
        want[g] = all_pairs(x, y)
    rows += [(None, 1.0, 2.0), (None, 3.0, 8.0), (7, 1.0, 1.0), (7, 1.0, 2.0), (0, None, 1.0), (0, 1.0, None)]
    points = spark.createDataFrame(rows, "g int, x double, y double")
    want = {**{k: v for k, v in want.items() if v is not None}, None: 3.0}
    for block in (10_000, 300):
        got = {r["g"]: r["slope"] for r in slopes.median_slopes(points, ["g"], "x", "y", block).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_fit_and_outliers_without_group_windows(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(x), float(x * (g + 1) + e + 50 * (i % 97 == 0))) for g in range(3) for i, (x, e) in enumerate(zip(rng.integers(1, 60, 500), rng.random(500), strict=True))]
    points = spark.createDataFrame(rows, "g int, x double, y double")
    fits, odd = [], []
    for large in (200_000, 100):
        fit = robust.theil_sen(points, ["g"], "x", "y", large=large)
        fits.append(sorted(map(tuple, fit.collect())))
        found = robust.outliers(points, fit, ["g"], "x", "y", 0.4, 6.0, 0.5, 2.0, large=large)
        odd.append(sorted(tuple(r) for r in found.where("outlier").select("g", "x", "y", "reason").collect()))
        if large > 1000:
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in plan
    assert odd[0] == odd[1] and len(odd[0]) >= 10 and all(a == pytest.approx(b) for a, b in zip(*fits, strict=True))
    for g, n, slope, intercept in fits[0]:
        x, y = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        assert n == 500 and slope == pytest.approx(all_pairs(x, y)) and intercept == pytest.approx(float(np.median(y - slope * x)))


def test_kept_sides_are_bounded_and_released(spark):
    robust.release()
    for i in range(robust.MOST_KEPT + 5):
        robust.few_rows(spark.range(i + 1).groupBy("id").count())
    assert len(robust.KEPT) == robust.MOST_KEPT
    assert robust.release() == robust.MOST_KEPT and not robust.KEPT
