import numpy as np
import pytest

from cellweave import Count, Cov, Grid, Max, Mean, Min, Moments, Sliding, Std, Sum, Var, WindowConfig, reduce_stats, rolling, rolling_stats
from cellweave.functions.statistics import geometric_mean, log_sum_exp, total_variation
from cellweave.operators import queues
from cellweave.operators.blocks import base_reduce, coarsen, materialize
from cellweave.operators.sliding import placed_windows

STATS = [Count(), Sum(), Mean(), Var(), Std(False), Min(), Max(), Moments(2)]


def table(state, dims, stats):
    df = materialize(state, dims, stats)
    return {tuple(r[d] for d in dims): [r[c] for c in df.columns if c not in dims] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        np.testing.assert_allclose(np.array(a[k], float), np.array(b[k], float), rtol=1e-9, atol=1e-9, err_msg=str(k))


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(queues, "BUCKET_CELLS", 16)


@pytest.mark.parametrize("skipna", [False, True])
@pytest.mark.parametrize(("w", "s", "first", "n"), [(2, 1, 0, 149), (7, 1, -6, 156), (7, 3, -3, 52), (50, 4, 0, 26), (20, 25, 5, 6), (5, 5, 0, 30), (150, 1, -149, 299)])
def test_a_line_equals_expansion(spark, w, s, first, n, skipna):
    x = np.random.default_rng(w).normal(1e3, 1, 150)
    if skipna:
        x[::6] = np.nan
        x[40:60] = np.nan
    g = Grid.from_numpy(spark, x)
    args = (g, (n,), (w,), (s,), (first,), STATS, skipna)
    same(table(placed_windows(*args, executor="queues"), g.dims, STATS), table(placed_windows(*args, executor="expand"), g.dims, STATS))


@pytest.mark.parametrize("skipna", [False, True])
def test_several_axes_with_gaps_equal_expansion(spark, skipna):
    x = np.random.default_rng(3).normal(50, 2, (40, 21))
    if skipna:
        x[np.random.default_rng(4).random(x.shape) < 0.4] = np.nan
        x[10:20, 3:9] = np.nan
    g = Grid.from_numpy(spark, x)
    args = (g, (18, 27), (9, 7), (2, 1), (0, -6), [*STATS], skipna)
    same(table(placed_windows(*args, executor="queues"), g.dims, STATS), table(placed_windows(*args, executor="expand"), g.dims, STATS))
    pair = Grid.from_numpy(spark, x, np.roll(x, 3, 1) ** 2)
    args = (pair, (18, 15), (6, 7), (2, 1), (0, 0), [Cov(), Cov(False)], skipna)
    same(table(placed_windows(*args, executor="queues"), g.dims, [Cov(), Cov(False)]), table(placed_windows(*args, executor="expand"), g.dims, [Cov(), Cov(False)]))


def test_sparse_lines_with_repeated_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(a), float(v)) for k, a, v in zip(rng.integers(0, 3, 90), rng.integers(0, 200, 90), rng.normal(size=90), strict=True)]
    g = Grid.from_table(spark.createDataFrame(rows, "k long, a long, v double"), ["k", "a"], ["v"], (3, 200))
    args = (g, (3, 191), (1, 30), (1, 1), (0, -10), STATS)
    same(table(placed_windows(*args, executor="queues"), g.dims, STATS), table(placed_windows(*args, executor="expand"), g.dims, STATS))
    with pytest.raises(ValueError):
        placed_windows(g, (2, 191), (2, 30), (1, 1), (0, 0), STATS, executor="queues")


def test_users_statistics_in_order(spark):
    x = np.abs(np.random.default_rng(6).normal(size=130)) + 0.1
    g = Grid.from_numpy(spark, x)
    stats = [geometric_mean(), log_sum_exp(), total_variation(), Mean()]
    for w, s, first, n in ((1, 1, 0, 130), (13, 1, 0, 118), (40, 7, -20, 19)):
        got = table(placed_windows(g, (n,), (w,), (s,), (first,), stats, executor="queues"), g.dims, stats)
        for k in range(n):
            own = x[max(0, first + k * s) : first + k * s + w]
            np.testing.assert_allclose(got[(k,)], [np.exp(np.log(own).mean()), np.log(np.exp(own).sum()), np.abs(np.diff(own)).sum(), own.mean()], rtol=1e-9)


def test_public_ways_take_queues(spark):
    x = np.random.default_rng(7).normal(size=(60, 30))
    x[5:9, 4:20] = np.nan
    g = Grid.from_numpy(spark, x, dims=("a", "b"))
    got = rolling(g, {"a": 21, "b": 12}, "std", min_periods=30).df.toPandas().set_index(["a", "b"]).iloc[:, 0]
    for a, b in ((0, 0), (7, 12), (30, 29), (59, 3)):
        own = x[max(0, a - 10) : a + 11, max(0, b - 6) : b + 6]
        assert np.isclose(got[a, b], np.nanstd(own))
    line = Grid.from_numpy(spark, np.arange(200.0))
    r = reduce_stats(line, Sliding(60, 1), [Mean()])
    assert [v.mean for v in r[r.factors[0]].orderBy("d0").limit(2).collect()] == [29.5, 30.5]
    assert rolling_stats(line, WindowConfig((60,), (1,), "full"), "count").count() == 259


def test_row_growth_does_not_depend_on_the_window(spark):
    """Two halves a window at most: no operator makes more rows than that and the cells' copies."""
    g = Grid.from_numpy(spark, np.random.default_rng(8).normal(size=4000))
    for w in (64, 512):
        df = placed_windows(g, (4001 - w,), (w,), (1,), (0,), [Var(), Min()], executor="queues")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "collect" not in plan


@pytest.mark.parametrize(("offset", "tolerance"), [(1e6, 1e-9), (1e9, 1e-6)])  # a mean near 1e9 has steps of 1.2e-7
def test_large_offsets_and_unequal_counts_merge_without_cancellation(spark, offset, tolerance):
    rng = np.random.default_rng(9)
    rows = [(int(a), float(v), float(u)) for a, v, u in zip(np.minimum(rng.geometric(0.02, 3000), 159), rng.integers(0, 50, 3000) + offset, rng.integers(0, 9, 3000) - offset, strict=True)]
    g = Grid.from_table(spark.createDataFrame(rows, "a long, v double, u double"), ["a"], ["v", "u"], (160,))
    fine = base_reduce(g, (1,), [Cov()])
    merged = coarsen(fine, g.dims, (160,), (20,), [Cov()])
    got = {r.a: r.cov for r in materialize(merged, g.dims, [Cov()]).collect()}
    for k, v in got.items():
        own = np.array([(v - offset, u + offset) for a, v, u in rows if a // 20 == k])
        assert np.isclose(v, np.cov(own.T)[0, 1], rtol=tolerance)
    one = Grid.from_table(spark.createDataFrame(rows, "a long, v double, u double"), ["a"], ["v"], (160,))
    state = coarsen(base_reduce(one, (1,), [Var()]), ["a"], (160,), (80,), [Var()])
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "partial_regrreplacement" in plan and plan.index("partial_regrreplacement") > plan.index("Exchange")
    for r in materialize(state, ["a"], [Var()]).collect():
        assert np.isclose(r["var"], np.var([v - offset for a, v, _ in rows if a // 80 == r.a], ddof=1), rtol=tolerance)


@pytest.mark.parametrize("window", [1, 2, 5, 16, 37])
def test_folding_by_position_equals_a_sequential_fold(spark, window):
    x = np.random.default_rng(10).normal(size=111)
    g = Grid.from_numpy(spark, x)
    tv = total_variation()
    state = coarsen(base_reduce(g, (1,), [tv, Mean()]), g.dims, (111,), (window,), [tv, Mean()])
    got = table(state, g.dims, [tv, Mean()])
    assert len(got) == 111 // window
    for (k,), (steps, mean) in got.items():
        own = x[k * window : (k + 1) * window]
        assert np.isclose(steps, np.abs(np.diff(own)).sum()) and np.isclose(mean, own.mean())


def test_folding_has_one_shuffle(spark):
    g = Grid.from_numpy(spark, np.random.default_rng(11).normal(size=(48, 30)))
    fine = base_reduce(g, (1, 1), [log_sum_exp()])
    plan = coarsen(fine, g.dims, (48, 30), (12, 10), [log_sum_exp()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "collect_list" in plan  # of cells into states, and of states into blocks


@pytest.mark.parametrize("dense", [True, False])
def test_partitions_of_users_states_are_bounded(spark, monkeypatch, dense):
    """What a task of the doubling rounds holds doesn't grow with the line: partitions are as many as its cells need."""
    monkeypatch.setattr(queues, "PARTITION_CELLS", 64, raising=False)
    x = np.random.default_rng(9).normal(size=1500)
    g = Grid.from_numpy(spark, x, dense=dense)
    stats = [total_variation()]
    got = placed_windows(g, (1494,), (7,), (1,), (0,), stats, executor="queues")
    assert got.rdd.getNumPartitions() >= 1500 // 64
    values = {k: v for k, (v,) in table(got, g.dims, stats).items()}
    want = {(k,): np.abs(np.diff(x[k : k + 7])).sum() for k in range(1494)}
    assert values.keys() == want.keys() and all(np.isclose(values[k], want[k]) for k in want)
