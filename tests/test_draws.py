"""Draws split down a tree, and corrections of p values, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.operators import draws, resample


@pytest.mark.parametrize("n", [1, 7, 30, 33])
@pytest.mark.parametrize("back", [True, False])
def test_blocks_share_out_every_draw(n, back):
    told = np.array([0, 1, n // 2, n] * 5)
    parts = [draws.fall(b, n, 4, told, back, 3) for b in range(-(-n // 4))]
    assert (sum(parts) == told).all() and all((p >= 0).all() for p in parts)
    if not back:
        assert all((p <= min(n, 4 * b + 4) - 4 * b).all() for b, p in enumerate(parts))
        assert all((p[told == n] == min(n, 4 * b + 4) - 4 * b).all() for b, p in enumerate(parts))
    for b, p in enumerate(parts):
        inside = draws.within(p, min(n, 4 * b + 4) - 4 * b, back, np.random.default_rng(b))
        assert (inside.sum(axis=1) == p).all() and (back or inside.max() <= 1)


def test_blocks_are_drawn_like_cases():
    """Mean and variance of a block's share of 20,000 draws of 40 of 40 cases, or of 10 without return."""
    back = draws.fall(2, 40, 4, np.full(20_000, 40), True, 1)
    assert back.mean() == pytest.approx(4, abs=0.05) and back.var() == pytest.approx(40 * 0.1 * 0.9, rel=0.05)
    less = draws.fall(9, 40, 4, np.full(20_000, 10), False, 1)
    assert less.mean() == pytest.approx(1, abs=0.03) and less.var() == pytest.approx(10 * 0.1 * 0.9 * 30 / 39, rel=0.05)


def _cases(spark, n):
    return spark.createDataFrame([(c, a, b, 1 + c % 3) for c in range(n) for a, b in (("x", "y"), ("y", "x"), ("x", "x")) if (c + len(b)) % 4 or a == b], "case long, src string, dst string, count long")


def test_counts_of_whole_draws(spark):
    """Cases with one edge each, counted once: the counts of a draw add up to its size; all drawn gives all counts; reruns agree."""
    n = 2500
    cases = spark.createDataFrame([(c, "a", "b", 1) for c in range(n)], "case long, src string, dst string, count long")
    placed = draws.numbered(cases)
    back = draws.drawn_counts(cases, [n], n, placed, 70, True, 5)
    assert {(r.draw, r["count"]) for r in back.collect()} == {(0, n)} and back.count() == 70
    varied = _cases(spark, n)
    placed = draws.numbered(varied)
    every = draws.drawn_counts(varied, [n, 0, n // 3], n, placed, 3, False, 5)
    whole = {(r.src, r.dst): r.s for r in varied.groupBy("src", "dst").agg(F.sum("count").alias("s")).collect()}
    found = every.collect()
    assert {(r.iter, r.src, r.dst, r["count"]) for r in found if r.draw == 0} == {(i, *k, s) for i in (1, 2, 3) for k, s in whole.items()}
    assert not [r for r in found if r.draw == 1]
    third = [r["count"] / whole[r.src, r.dst] for r in found if r.draw == 2]
    assert len(third) == 9 and all(0.27 < t < 0.4 for t in third)
    assert sorted(map(tuple, found)) == sorted(map(tuple, every.collect()))


def test_bootstrap_like_drawing_rows(spark):
    cases = _cases(spark, 60)
    rows = cases.toPandas()
    found = {(r.src, r.dst): r for r in resample.bootstrap_edges(cases, 600).collect()}
    edges = sorted(found)
    table = np.zeros((60, len(edges)))
    for r in rows.itertuples():
        table[r.case, edges.index((r.src, r.dst))] += r.count
    rng = np.random.default_rng(0)
    sums = np.array([table[rng.integers(0, 60, 60)].sum(axis=0) for _ in range(4000)])
    of = np.array([[s == t for t, _ in edges] for s, _ in edges])
    shares = sums / (sums @ of)
    for i, e in enumerate(edges):
        assert found[e].mean == pytest.approx(shares[:, i].mean(), abs=0.01)
        assert found[e].sd == pytest.approx(shares[:, i].std(ddof=1), rel=0.12, abs=1e-12)


def test_bootstrap_options(spark):
    cases = _cases(spark, 40)
    counts = {(r.src, r.dst): r.s for r in cases.groupBy("src", "dst").agg(F.sum("count").alias("s")).collect()}
    often = {(r.src, r.dst): r for r in resample.bootstrap_edges(cases, 50, kind="frequency").collect()}
    assert {k: r.weight for k, r in often.items()} == {k: float(v) for k, v in counts.items()}
    below = resample.bootstrap_edges(cases, 50, method="threshold", threshold=0.0).collect()
    assert {r.p_value for r in below} == {1 / 51}
    above = resample.bootstrap_edges(cases, 50, method="threshold", threshold=2.0).collect()
    assert {r.p_value for r in above} == {1.0}
    # Four cells, one of them empty: the first decile is 0.3 of the way from 0 to the least weight.
    assert {r.p_value for r in resample.bootstrap_edges(cases, 50, method="threshold").collect()} == {1 / 51}
    with pytest.raises(ValueError):
        resample.bootstrap_edges(cases, 5, method="other")
    with pytest.raises(ValueError):
        resample.bootstrap_edges(cases, 5, kind="other")


def test_permutation_finds_a_difference(spark):
    rows = [(c, a, b, n) for c in range(40) for a, b, n in (("x", "y", 1 + 4 * (c % 2)), ("x", "x", 3), ("y", "x", 2))]
    cases = spark.createDataFrame(rows, "case long, src string, dst string, count long")
    groups = spark.createDataFrame([(c, "ab"[c % 2]) for c in range(42)], "case long, grp string")  # two have no edges
    found = {(r.src, r.dst): r for r in resample.permutation_edges(cases, groups, 99).collect()}
    assert found["x", "y"]["diff"] == pytest.approx(1 / 4 - 5 / 8) and found["x", "y"].p_value == 0.01 and found["x", "y"].effect < -3
    assert found["y", "x"]["diff"] == 0.0 and found["y", "x"].p_value == 1.0


def _plain(p, method):
    n, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    h = sum(1 / i for i in range(1, n + 1))
    out = [0.0] * n
    for at, i in enumerate(order):
        steps = {
            "bonferroni": [n * p[i]], "none": [p[i]],
            "holm": [max((n - j) * p[order[j]] for j in range(at + 1))],
            "hochberg": [(n - j) * p[order[j]] for j in range(at, n)],
            "BH": [n / (j + 1) * p[order[j]] for j in range(at, n)],
            "BY": [h * n / (j + 1) * p[order[j]] for j in range(at, n)],
        }
        out[i] = min(1.0, min(steps["BH" if method == "fdr" else method]))
    return out


@pytest.mark.parametrize("method", resample.CORRECTIONS)
def test_corrections(spark, method):
    p = [0.001, 0.04, 0.04, 0.03, 0.9, 0.5, 0.0004, 0.04, 1.0, 0.012]
    df = spark.createDataFrame([*enumerate(p), (99, None)], "id int, p_value double")
    found = {r.id: r.p_value for r in resample.adjust(df, method).collect()}
    assert found.pop(99) is None
    assert [found[i] for i in range(len(p))] == pytest.approx(_plain(p, method))
    assert resample.adjust(df.limit(0), method).count() == 0


def test_running_extremes_over_several_runs(spark):
    value = [5, 3, 8, 1, 9, 2, 7]
    df = spark.createDataFrame(list(enumerate(value, 1)), "r int, v int")
    up = [r.v for r in resample.extreme(df, "r", "v", True, run=2).orderBy("r").collect()]
    down = [r.v for r in resample.extreme(df, "r", "v", False, run=2).orderBy("r").collect()]
    assert up == [5, 5, 8, 8, 9, 9, 9] and down == [1, 1, 1, 1, 2, 2, 7]
