import glob
import os

import numpy as np
import pytest

from cellweave import Chunks, Count, Cov, Grid, Max, Mean, Median, Min, Moments, Product, Sliding, Std, Sum, Var, read_tiled, reduce_stats, scatter_along_curve, write_tiled
from cellweave.sources import layout

STATS = [Count(), Sum(), Mean(), Var(), Std(False), Min(), Max(), Moments(3)]


def table(df, dims):
    keys = [c for c in df.columns if c.startswith("f_") or c in dims]
    return {tuple(r[k] for k in keys): [r[c] for c in df.columns if c not in keys] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        np.testing.assert_allclose(np.array(a[k], float), np.array(b[k], float), rtol=1e-9, atol=1e-9, err_msg=str(k))


@pytest.mark.parametrize(("shape", "chunk", "scales"), [((37,), (8,), [2, 4, 12]), ((26, 31), (8, 12), [(2, 2), (4, 4), (6, 6), (9, 5)]), ((13, 12, 9), (4, 6, 4), [(2, 2, 1), (4, 4, 3), (5, 1, 2)])])
def test_scales_that_chunks_hold_and_that_cross_them(spark, shape, chunk, scales):
    x = np.random.default_rng(1).normal(5, 2, shape)
    grid = Grid.from_numpy(spark, x)
    result = Chunks.from_grid(grid, chunk).reduce_stats(scales, STATS)
    want = reduce_stats(grid, scales, STATS)
    same(table(result.to_dataframe(), grid.dims), table(want.to_dataframe(), grid.dims))
    f = result.factors[-1]
    same(table(result[f], grid.dims), table(want[f], grid.dims))


def test_gaps_and_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 18))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[4:8, 6:12] = np.nan
    grid = Grid.from_numpy(spark, x)
    for skip in (True, False):
        want = reduce_stats(grid, [2, 4, 3], STATS[:-1], skipna=skip).to_dataframe().fillna(np.nan)
        got = Chunks.from_grid(grid, (8, 6)).reduce_stats([2, 4, 3], STATS[:-1], skipna=skip).to_dataframe()
        same({k: [np.nan if u is None else u for u in v] for k, v in table(got, grid.dims).items()}, {k: [np.nan if u is None else u for u in v] for k, v in table(want, grid.dims).items()})
    pair = Grid.from_numpy(spark, np.nan_to_num(x), rng.normal(size=x.shape))
    stats = [Cov(), Cov(False), Product()]
    same(table(Chunks.from_grid(pair, (8, 6)).reduce_stats([2, 4, 5], stats).to_dataframe(), pair.dims), table(reduce_stats(pair, [2, 4, 5], stats).to_dataframe(), pair.dims))
    for bad in ([Median()], [Cov()]):
        with pytest.raises(ValueError):
            Chunks.from_grid(grid, 4).reduce_stats(2, bad)
    with pytest.raises(ValueError):
        Chunks.from_grid(grid, 4096)


def test_scales_inside_chunks_need_no_shuffle(spark):
    grid = Grid.from_numpy(spark, np.random.default_rng(3).normal(size=(32, 32)))
    chunks = Chunks.from_grid(grid, 16)
    stored = Chunks(chunks.df.persist(), chunks.dims, chunks.extent, chunks.shape)
    plan = stored.reduce_stats([2, 4, 8, 16]).to_dataframe()._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("Exchange") == 0
    chunks.df.unpersist()


@pytest.mark.parametrize(("shape", "chunk", "spec"), [((50,), (8,), Sliding(9, 1)), ((23, 30), (8, 10), Sliding((4, 7), (2, 3), (1, 0))), ((12, 10, 9), (5, 4, 4), Sliding((3, 5, 1), (1, 2, 2)))])
def test_windows_over_chunks(spark, shape, chunk, spec):
    grid = Grid.from_numpy(spark, np.random.default_rng(4).normal(size=shape))
    want = reduce_stats(grid, spec, STATS, executor="expand")
    same(table(Chunks.from_grid(grid, chunk).sliding(spec, STATS), grid.dims), table(want[want.factors[0]], grid.dims))


def test_periodic_windows_and_pairs(spark):
    x, y = np.random.default_rng(5).normal(size=(2, 12, 16))
    grid = Grid.from_numpy(spark, x, y)
    got = table(Chunks.from_grid(grid, (6, 8)).sliding(Sliding((4, 5), 1), [Cov(False)], periodic=True), grid.dims)
    a, b = np.pad(x, ((0, 3), (0, 4)), "wrap"), np.pad(y, ((0, 3), (0, 4)), "wrap")
    assert len(got) == 12 * 16
    for (i, j), (c,) in got.items():
        u, v = a[i : i + 4, j : j + 5], b[i : i + 4, j : j + 5]
        assert np.isclose(c, (u * v).mean() - u.mean() * v.mean())
    whole = Chunks.from_grid(Grid.from_numpy(spark, x), (12, 16))
    assert whole.sliding(Sliding(3, 1), [Mean()], periodic=True).count() == 192
    for spec, periodic in ((Sliding(8, 1), False), (Sliding(3, 1), True)):
        with pytest.raises(ValueError):
            Chunks.from_grid(Grid.from_numpy(spark, x), 5).sliding(spec, periodic=periodic)


@pytest.mark.parametrize(("shape", "chunk", "window"), [((12, 16), 5, 3), ((11, 16), (5, 8), (5, 4)), ((13, 7), (4, 3), (5, 4)), ((6, 9), (5, 4), (6, 5)), ((4, 9), (6, 9), (3, 1)), ((21,), (10,), (10,))])
def test_periodic_windows_over_a_short_last_chunk(spark, shape, chunk, window):
    """Windows go over the last chunk into the first, also where it is shorter than they are."""
    x = np.random.default_rng(8).normal(size=shape)
    sizes = (window,) * len(shape) if isinstance(window, int) else window
    wrapped = np.pad(x, [(0, w - 1) for w in sizes], "wrap")
    want = np.lib.stride_tricks.sliding_window_view(wrapped, sizes).mean(tuple(range(-len(shape), 0)))
    chunks = Chunks.from_grid(Grid.from_numpy(spark, x), chunk)
    got = table(chunks.sliding(Sliding(sizes, 1), [Mean()], periodic=True, strict=False), chunks.dims)
    assert len(got) == x.size and all(np.isclose(v[0], want[k if isinstance(k, tuple) else (k,)]) for k, v in got.items())
    with pytest.raises(ValueError):
        Chunks.from_grid(Grid.from_numpy(spark, np.zeros(21)), 10).sliding(Sliding(3, 1), periodic=True)


def test_only_borders_are_shuffled(spark, tmp_path):
    """Of a field stored by chunk, what is shuffled is the borders: other cells stay where they are."""
    grid = Grid.from_numpy(spark, np.random.default_rng(6).normal(size=(256, 256)))
    chunks = Chunks.from_grid(grid, 64).stored("chunked_field", f"file://{tmp_path}/field", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = chunks.sliding(Sliding(3, 1), [Mean()])
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1
        jvm = spark._jvm
        sizes = []

        def walk(node):
            if node.nodeName().startswith("Exchange"):
                sizes.append(node.metrics().apply("shuffleBytesWritten").value())
            for kids in (node.children(),):
                for k in range(kids.size()):
                    walk(kids.apply(k))
            if node.nodeName().startswith(("AdaptiveSparkPlan", "ResultQueryStage", "ShuffleQueryStage")):
                walk(node.executedPlan() if node.nodeName().startswith("Adaptive") else node.plan())

        walk(df._jdf.queryExecution().executedPlan())
        border = 4 * 4 * (2 * 64 * 2 + 4) * 8
        assert jvm is not None and sizes and sum(sizes) < 2 * border < 256 * 256 * 8 / 4
        assert df.count() == 254 * 254
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE chunked_field")


def test_codes_are_the_same_in_columns_and_alone(spark):
    rows = [(a, b, c) for a in (0, 1, 5, 100) for b in (0, 3, 77) for c in (0, 2, 9)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    from pyspark.sql import functions as F

    got = df.select("a", "b", "c", layout.morton_column([F.col(x) for x in "abc"], (100, 77, 9)).alias("m")).collect()
    assert all(r.m == layout.morton((r.a, r.b, r.c)) for r in got) and len({r.m for r in got}) == len(rows)


@pytest.mark.parametrize("listed", [4096, 1])
def test_a_box_reads_the_tiles_that_it_meets(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(layout, "MAX_LISTED", listed)
    x = np.random.default_rng(7).normal(size=(64, 48))
    grid = Grid.from_numpy(spark, x)
    path = f"file://{tmp_path}/tiled"
    write_tiled(grid, path, 8)
    assert len(glob.glob(f"{tmp_path}/tiled/cells/tile=*")) == 48
    box = read_tiled(spark, path, (16, 8), (32, 20))
    assert box.df.count() == 16 * 12 and box.extent == (64, 48)
    leaf = box.df._jdf.queryExecution().executedPlan()
    box_df = box.df
    box_df.collect()
    leaf = box_df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    files = leaf.metrics().apply("numFiles").value()
    assert files == 4 if listed > 1 else files < 48 / 2
    means = reduce_stats(box, 4, [Mean(), Count()])[4].toPandas()
    assert len(means) == 12 and (means["count"] == 16).all()
    for d0, d1, mean in means[["d0", "d1", "mean"]].itertuples(index=False):
        assert np.isclose(mean, x[int(d0) * 4 : int(d0) * 4 + 4, int(d1) * 4 : int(d1) * 4 + 4].mean())
    whole = read_tiled(spark, path)
    assert whole.dense and whole.df.count() == 64 * 48 and read_tiled(spark, path, (0, 0), (0, 5)).df.count() == 0
    with pytest.raises(ValueError):
        read_tiled(spark, path, (0, 0), (65, 1))
    assert os.path.isdir(f"{tmp_path}/tiled/about")


def test_a_tiled_grid_without_cells(spark, tmp_path):
    grid = Grid.from_numpy(spark, np.ones((16, 16)))
    path = f"file://{tmp_path}/tiled"
    write_tiled(Grid(grid.df.where("false"), grid.dims, grid.extent, grid.values), path, 8)
    for box in ((), ((0, 0), (3, 9))):
        found = read_tiled(spark, path, *box)
        assert found.df.count() == 0 and found.df.columns == ["d0", "d1", "v"] and not found.dense


def test_scatter_along_the_curve_keeps_blocks_together(spark):
    from pyspark.sql import functions as F

    grid = Grid.from_numpy(spark, np.zeros((64, 64)))
    dealt = scatter_along_curve(grid, 4, 8)
    assert dealt.df.rdd.getNumPartitions() == 8
    spread = dealt.df.withColumn("p", F.spark_partition_id()).groupBy(F.expr("d0 div 16"), F.expr("d1 div 16")).agg(F.count_distinct("p").alias("n")).agg(F.max("n")).first()[0]
    assert spread <= 3
