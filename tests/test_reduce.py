import numpy as np
import pytest

from cellweave import Count, Cov, Grid, Max, Mean, Median, Min, Moments, Sliding, Std, Sum, Tower, Var, reduce_stats
from cellweave.functions.statistics import geometric_mean, subsumes
from cellweave.operators.blocks import base_reduce, check_laws, check_merge, coarsen, inverse_merge, materialize
from cellweave.plans.lattice import factor_shape

RNG = np.random.default_rng(42)


def blocks(x, f):
    x = x[tuple(slice(0, n // k * k) for n, k in zip(x.shape, f, strict=True))]
    shape = [v for n, k in zip(x.shape, f, strict=True) for v in (n // k, k)]
    y = x.reshape(shape).transpose([*range(0, 2 * x.ndim, 2), *range(1, 2 * x.ndim, 2)])
    return y.reshape(*y.shape[: x.ndim], -1)


def array(df, dims, name, shape):
    p = df.toPandas()
    out = np.full(shape, np.nan)
    out[tuple(p[d] for d in dims)] = p[name].astype(float)
    return out


@pytest.mark.parametrize(("shape", "factor"), [((101,), (5,)), ((25, 26), (4, 4)), ((24, 24), (2, 3)), ((13, 9, 7), (3, 3, 3)), ((12, 8, 6), (2, 2, 1))])
def test_blocks_truncate_and_match_numpy(spark, shape, factor):
    x = RNG.standard_normal(shape)
    g = Grid.from_numpy(spark, x)
    stats = [Count(), Sum(), Mean(), Var(), Var(False), Std(), Min(), Max(), Moments(3), Median()]
    df = reduce_stats(g, [factor], stats)[factor].cache()
    b, size = blocks(x, factor), factor_shape(shape, factor)
    want = {"count": b.shape[-1] + 0 * b[..., 0], "sum": b.sum(-1), "mean": b.mean(-1), "var": b.var(-1, ddof=1), "var_pop": b.var(-1), "std": b.std(-1, ddof=1), "min": b.min(-1), "max": b.max(-1), "m2": (b**2).mean(-1), "m3": (b**3).mean(-1), "median": np.median(b, -1)}
    for name, w in want.items():
        np.testing.assert_allclose(array(df, g.dims, name, size), w, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("strategy", ["tower", "direct", "grouping_sets"])
def test_strategies_agree(spark, strategy):
    x = RNG.standard_normal((40, 36))
    g = Grid.from_numpy(spark, x)
    result = reduce_stats(g, [4, 6, 9], [Mean(), Var()], strategy=strategy)
    assert result.factors == [(4, 4), (6, 6), (9, 9)] and len(result) == 3 and (4, 4) in result
    for f in result:
        np.testing.assert_allclose(array(result[f], g.dims, "var", result.shapes[f]), blocks(x, f).var(-1, ddof=1), rtol=1e-9)
    assert set(result((6, 6), Mean()).columns) == {"d0", "d1", "mean"}


def test_tower_and_plan_reuse(spark):
    x = RNG.standard_normal((24, 18))
    g = Grid.from_numpy(spark, x)
    result = reduce_stats(g, Tower(2, [2, 3], 6), [Mean(), Std()])
    assert all(np.allclose(array(result[f], g.dims, "std", result.shapes[f]), blocks(x, f).std(-1, ddof=1)) for f in result)
    again = reduce_stats(Grid.from_numpy(spark, x + 1), None, [Mean()], plan=result.plan)
    np.testing.assert_allclose(array(again[2], g.dims, "mean", (12, 9)), blocks(x + 1, (2, 2)).mean(-1))
    with pytest.raises(ValueError):
        reduce_stats(Grid.from_numpy(spark, x[:5]), None, [Mean()], plan=result.plan)


def test_pairs_covariance_and_arity(spark):
    x, y = RNG.standard_normal((2, 30, 20))
    g = Grid.from_numpy(spark, x, y)
    df = reduce_stats(g, [5, 10], [Cov(), Cov(False)])
    for f in (5, 10):
        a, b = blocks(x, (f, f)), blocks(y, (f, f))
        want = ((a - a.mean(-1, keepdims=True)) * (b - b.mean(-1, keepdims=True))).sum(-1) / (f * f - 1)
        np.testing.assert_allclose(array(df[f], g.dims, "cov", want.shape), want, rtol=1e-9)
    for grid, stat in ((g, Mean()), (Grid.from_numpy(spark, x), Cov())):
        with pytest.raises(ValueError):
            reduce_stats(grid, 5, [stat])
    with pytest.raises(ValueError):
        Grid.from_numpy(spark, x).pair(Grid.from_numpy(spark, y[:3]))


def test_float_narrows_and_degenerate_cells(spark):
    x = RNG.standard_normal((10, 10)).astype(np.float32)
    g = Grid.from_numpy(spark, x)
    df = reduce_stats(g, 5, [Mean(), Var(), Count(), Min()])[5]
    assert dict(df.dtypes) == {"d0": "bigint", "d1": "bigint", "mean": "float", "var": "float", "count": "bigint", "min": "float"}
    one = reduce_stats(g, 1, [Var(), Var(False), Mean()])[1].first()
    assert np.isnan(one["var"]) and one["var_pop"] == 0
    ints = Grid.from_numpy(spark, np.arange(12))
    assert dict(reduce_stats(ints, 5, [Sum(), Mean(), Max()])[5].dtypes) == {"d0": "bigint", "sum": "bigint", "mean": "double", "max": "bigint"}


def test_nan_policies(spark):
    x = np.array([1, 2, np.nan, 4, 5, np.nan, np.nan, np.nan, np.nan, np.nan])
    g = Grid.from_numpy(spark, x)
    skip = reduce_stats(g, 5, [Count(), Sum(), Mean(), Min(), Max()], skipna=True)[5].orderBy("d0").collect()
    assert (skip[0]["count"], skip[0]["sum"], skip[0]["mean"], skip[0]["min"], skip[0]["max"]) == (4, 12.0, 3.0, 1.0, 5.0)
    assert skip[1]["count"] == 0 and skip[1]["sum"] == 0 and np.isnan(skip[1]["mean"])
    keep = reduce_stats(g, 5, [Count(), Mean(), Min(), Max()])[5].orderBy("d0").collect()
    assert keep[0]["count"] == 5 and all(np.isnan(keep[0][c]) for c in ("mean", "min", "max"))


def test_merging_laws_on_sparse_data(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), float(v), float(w)) for a, b, v, w in zip(rng.integers(0, 24, 300), rng.integers(0, 6, 300), rng.normal(1e6, 1, 300), rng.normal(size=300), strict=True)]
    df = spark.createDataFrame(rows, "a long, b long, v double, w double")
    g = Grid.from_table(df, ["a", "b"], ["v"], (24, 6))
    assert check_merge(g, (2, 1), (3, 2), [Count(), Sum(), Mean(), Var(), Min(), Max(), Moments(2)])
    pair = Grid.from_table(df, ["a", "b"], ["v", "w"], (24, 6))
    assert check_merge(pair, (2, 3), (4, 2), [Cov()])
    every = check_laws(g, (6, 3), [Count(), Sum(), Mean(), Var(), Min(), Max(), Moments(2)])
    assert set(every) == {"identity", "commutativity", "associativity", "homomorphism"} and all(every.values())
    for grid, stats in ((g, [Count(), Mean(), Var()]), (pair, [Cov()])):
        laws = check_laws(grid, (12, 3), stats, 1e-6)
        assert all(laws.values()) and "inverse" in laws, laws
    with pytest.raises(ValueError):
        coarsen(base_reduce(g, (2, 1), [Median()]), g.dims, (12, 6), (2, 1), [Median()])


def test_broken_laws_are_told(spark):
    from pyspark.sql import functions as F

    from cellweave import CustomStatistic

    g = Grid.from_numpy(spark, RNG.standard_normal((24, 12)) + 3)
    broken = CustomStatistic("mean_of_means", {"m": lambda v: F.avg(v)}, {"m": lambda s: F.avg(s("m"))}, lambda s: s("m"))
    laws = check_laws(g, (6, 6), [broken])
    assert laws["identity"] and laws["commutativity"] and not laws["associativity"] and not laws["homomorphism"]


def test_inverse_merge(spark):
    x = RNG.standard_normal(60)
    g = Grid.from_numpy(spark, x)
    part = Grid(g.df.where("d0 % 4 = 0"), g.dims, g.extent, g.values)
    stats = [Count(), Mean(), Var()]
    got = materialize(inverse_merge(base_reduce(g, (20,), stats), base_reduce(part, (20,), stats), g.dims, stats), g.dims, stats).orderBy("d0").collect()
    for k, r in enumerate(got):
        own = [x[i] for i in range(20 * k, 20 * k + 20) if i % 4]
        assert r["count"] == 15 and np.isclose(r["mean"], np.mean(own)) and np.isclose(r["var"], np.var(own, ddof=1))
    with pytest.raises(ValueError):
        inverse_merge(g.df, g.df, g.dims, [Min()])


def test_custom_statistic_and_subsumption(spark):
    x = np.abs(RNG.standard_normal((16, 16))) + 0.5
    g = Grid.from_numpy(spark, x)
    result = reduce_stats(g, [4, 8, 16], [geometric_mean(), Mean()])
    for f in (4, 8, 16):
        np.testing.assert_allclose(array(result[f], g.dims, "geomean", result.shapes[f, f]), np.exp(np.log(blocks(x, (f, f))).mean(-1)), rtol=1e-9)
    assert subsumes(Var(), Mean()) and subsumes(Std(), Count()) and not subsumes(Mean(), Var())


@pytest.mark.parametrize("executor", ["frames", "expand"])
@pytest.mark.parametrize(("window", "stride", "origin"), [((4, 4), (1, 1), (0, 0)), ((8, 6), (2, 3), (0, 0)), ((5, 5), (3, 2), (2, 1)), ((1, 3), (1, 1), (0, 2))])
def test_sliding_2d(spark, executor, window, stride, origin):
    x = RNG.standard_normal((20, 16))
    g = Grid.from_numpy(spark, x)
    result = reduce_stats(g, Sliding(window, stride, origin), [Mean(), Var(False), Min(), Max(), Count()], executor=executor)
    key = result.factors[0]
    views = np.lib.stride_tricks.sliding_window_view(x, window)[origin[0] :: stride[0], origin[1] :: stride[1]]
    assert result.shapes[key] == views.shape[:2]
    flat = views.reshape(*views.shape[:2], -1)
    for name, want in (("mean", flat.mean(-1)), ("var_pop", flat.var(-1)), ("min", flat.min(-1)), ("max", flat.max(-1))):
        np.testing.assert_allclose(array(result[key], g.dims, name, want.shape), want, rtol=1e-9, atol=1e-12)


def test_sliding_long_line_is_cut_into_buckets(spark, monkeypatch):
    from cellweave.operators import sliding

    monkeypatch.setattr(sliding, "_BUCKET", 16)
    x = RNG.standard_normal(200)
    g = Grid.from_numpy(spark, x)
    for w in (1, 2, 7, 50):
        result = reduce_stats(g, Sliding(w, 1), [Mean(), Var(False)], executor="frames")
        views = np.lib.stride_tricks.sliding_window_view(x, w)
        got = array(result[result.factors[0]], g.dims, "var_pop", (len(views),))
        np.testing.assert_allclose(got, views.var(-1), rtol=1e-9, atol=1e-12)


def test_two_slidings_of_one_window_and_errors(spark):
    g = Grid.from_numpy(spark, RNG.standard_normal((12, 12)))
    assert len(reduce_stats(g, [Sliding(4, 1), Sliding(4, 2)], [Mean()])) == 2
    for bad in (Sliding(13), Sliding(0), Sliding(4, 0), Sliding((4, 4, 4))):
        with pytest.raises(ValueError):
            reduce_stats(g, bad, [Mean()])
    with pytest.raises(ValueError):
        reduce_stats(g, 4, [Mean()], backend="abacus")
    with pytest.raises(ValueError):
        reduce_stats(g, 4, [Mean()], strategy="guess")


def test_pairwise_merge_and_kept_scales(spark):
    from cellweave.functions.statistics import log_sum_exp

    x = np.random.default_rng(6).standard_normal((24, 16)) * 30
    result = reduce_stats(Grid.from_numpy(spark, x), [2, 4, 8], [log_sum_exp()], use_cache=True)
    for f in (2, 4, 8):
        got = result[f].toPandas().sort_values(["d0", "d1"])["log_sum_exp"].to_numpy()
        blocks = x.reshape(24 // f, f, 16 // f, f).transpose(0, 2, 1, 3).reshape(-1, f * f)
        np.testing.assert_allclose(got, np.logaddexp.reduce(blocks, axis=1), rtol=1e-12)
    assert len(result._kept) == 2
    result.unpersist()
    assert not result._kept
