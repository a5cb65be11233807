import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import Count, Cov, Grid, IncrementalState, LazyPlan, Mean, Min, Var, WindowConfig, blockwise, blockwise_stats, blockwise_windows, center_coordinates, gather, map_reduce, materialize, merge_stats, multiresolution_stats, product_mean, product_moments, rechunk, resample, resolve_backend, rolling, rolling_stats, rolling_windows, scatter, tiled_stats, tree_reduce, tree_reduce_labelled, validate_window_config, window_coordinates, window_stat
from cellweave.operators import labels, sliding
from cellweave.operators.labels import result_attrs, seconds_of


def values(df, *dims):
    p = df.toPandas().sort_values(list(dims))
    return p["value"].to_numpy(float)


@pytest.mark.parametrize(("n", "w", "s", "count"), [(20, 5, 2, 8), (12, 5, 5, 2), (5, 10, 10, 0)])
def test_window_counts(spark, n, w, s, count):
    assert rolling_windows((n,), WindowConfig((w,), (s,)), spark).count() == count


def test_strict_validation(spark):
    for shape, config in (((105, 100), WindowConfig((10, 10))), ((100, 100), WindowConfig((5, 5), (2, 2))), ((4,), WindowConfig((5,)))):
        with pytest.raises(ValueError):
            validate_window_config(shape, config, True)
        assert validate_window_config(shape, config)
    with pytest.raises(ValueError):
        WindowConfig((5,), (0,))
    with pytest.raises(ValueError):
        WindowConfig((5,), padding="mirror")
    with pytest.raises(ValueError):
        blockwise_windows((7,), (3,), spark)


def test_known_values(spark):
    line = Grid.from_numpy(spark, np.arange(20.0))
    assert values(blockwise_stats(line, (5,), "mean"), "d0").tolist() == [2, 7, 12, 17]
    ones = Grid.from_numpy(spark, np.ones((10, 10)))
    assert values(blockwise_stats(ones, (5, 5), "sum"), "d0", "d1").tolist() == [25] * 4
    square = Grid.from_numpy(spark, np.arange(100.0).reshape(10, 10))
    assert values(blockwise_stats(square, (5, 5), "max"), "d0", "d1")[0] == 44
    assert values(blockwise_stats(square, (1, 1), "mean"), "d0", "d1").tolist() == list(range(100))
    with pytest.raises(ValueError):
        blockwise_stats(square, (5, 5), "mode")


@pytest.mark.parametrize(("padding", "align"), [("valid", "shifted"), ("same", "shifted"), ("same", "centered"), ("full", "shifted")])
@pytest.mark.parametrize("stat", ["mean", "count", "sum", "median"])
def test_padding(spark, padding, align, stat):
    x = np.random.default_rng(1).standard_normal(23)
    w, s = 6, 4
    got = values(rolling_stats(Grid.from_numpy(spark, x), WindowConfig((w,), (s,), padding), stat, same_align=align), "d0")
    first = {"valid": 0, "same": (w - 1) // 2 if align == "shifted" else -((w - 1) // 2), "full": 1 - w}[padding]
    n = {"valid": (23 - w) // s + 1, "same": 22 // s + 1, "full": (23 + w - 2) // s + 1}[padding]
    want = []
    for k in range(n):
        own = x[max(0, first + k * s) : max(0, min(23, first + k * s + w))]
        want.append({"mean": own.mean() if len(own) else np.nan, "count": len(own), "sum": own.sum(), "median": np.median(own) if len(own) else np.nan}[stat])
    np.testing.assert_allclose(got, want)


def test_periodic_boundary(spark):
    x = np.arange(6.0)
    got = values(rolling_stats(Grid.from_numpy(spark, x), WindowConfig((3,), (1,)), "sum", boundary="periodic"), "d0")
    assert got.tolist() == [3, 6, 9, 12, 9, 6]


def test_skipping_window_stat(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, float("nan"), 4.0, 5.0)], "g int, v double")
    assert window_stat(df, "v", "mean").first()["mean"] == 3.0
    assert window_stat(df, "v", "median", ["g"]).first()["median"] == 3.0


def test_tiles_and_merges(spark):
    g = Grid.from_numpy(spark, np.arange(16.0).reshape(4, 4))
    t = tiled_stats(g, (2, 2), "mean").orderBy("d0", "d1").collect()
    assert [(r.value, r.n) for r in t] == [(2.5, 4), (4.5, 4), (10.5, 4), (12.5, 4)]
    a, b = blockwise_stats(g, (2, 2), "mean"), blockwise_stats(g, (2, 2), "max")
    assert values(merge_stats([a, b], g.dims, "mean"), *g.dims)[0] == 3.75
    assert merge_stats([a], g.dims) is a
    for bad in ([], [a, b]):
        with pytest.raises(ValueError):
            merge_stats(bad, g.dims, "mode" if bad else "mean")
    assert tree_reduce(range(1, 9), lambda x, y: x + y) == 36 and tree_reduce([], max) is None and tree_reduce([42], max) == 42


def test_products(spark):
    x = np.arange(16.0).reshape(4, 4)
    g = Grid.from_numpy(spark, x, 2 * x)
    assert values(product_mean(g, (2, 2)), "d0", "d1")[0] == 21.0
    r = product_moments(g, (4, 4)).first()
    assert np.isclose(r.mean_xy, (x * 2 * x).mean()) and np.isclose(r.var_x, x.var(ddof=1)) and np.isclose(r.cov_xy, 2 * x.var(ddof=1)) and np.isclose(r.var_y, 4 * x.var(ddof=1))
    biased = product_moments(g, (4, 4), compat_mean_xy=True).first()
    assert np.isclose(biased.mean_xy, biased.mean_x * biased.mean_y + biased.cov_xy)


def test_multiresolution(spark):
    x = np.random.default_rng(2).standard_normal((16, 16))
    got = multiresolution_stats(Grid.from_numpy(spark, x), [2, 4], ("mean", "std"))
    assert set(got) == {2, 4} and set(got[2]) == {"mean", "std"}
    with pytest.raises(ValueError):
        multiresolution_stats(Grid.from_numpy(spark, x), [2], ("mode",))


def coords(spark, *xs):
    return spark.createDataFrame(list(enumerate(map(float, xs))), "idx long, coord double")


def test_labels(spark):
    g = Grid.from_numpy(spark, np.ones((10, 10)), dims=("x", "y"), name="u", coords={"x": coords(spark, *range(0, 100, 10)), "y": coords(spark, *range(0, 50, 5))}, attrs={"units": "m/s"})
    out = blockwise(g, {"x": 5, "y": 5}, "var")
    assert out.name == "u_var_blockwise" and out.attrs["units"] == "(m/s)^2" and out.df.schema[out.name].metadata["units"] == "(m/s)^2"
    assert [r.coord for r in out.coords["x"].orderBy("idx").collect()] == [20, 70]
    assert [r.coord for r in out.coords["y"].orderBy("idx").collect()] == [10, 35]
    with pytest.raises(ValueError):
        blockwise(g, {"x": 3}, "mean")
    with pytest.raises(ValueError):
        blockwise(g, {"z": 3}, "mean")
    r = rolling(g, {"x": 3}, "mean").df.where("y = 0").orderBy("x").toPandas()
    assert np.isnan(r.iloc[0, 2]) and np.isnan(r.iloc[-1, 2]) and (r.iloc[1:-1, 2] == 1).all()
    trailing = rolling(g, {"x": 3}, "count", min_periods=1, center=False).df.where("y = 0").orderBy("x").toPandas()
    assert trailing.iloc[:, 2].tolist() == [1, 2] + [3] * 8
    w = window_coordinates(g, blockwise_stats(g, (5, 5), "mean"), WindowConfig((5, 5))).where("x = 1 AND y = 0").first()
    assert (w.x_window_start, w.x_window_center, w.x_window_end) == (50, 70, 90)
    assert result_attrs({"units": "m"}, "std")["units"] == "m"


def test_center_coordinates(spark):
    line = coords(spark, *range(20))
    assert [r.coord for r in center_coordinates(line, 20, 5, 5).orderBy("idx").collect()] == [2, 7, 12, 17]
    assert center_coordinates(coords(spark, *range(10)), 10, 3, 2, "same").count() == 5


def test_tree_of_grids(spark):
    g = [Grid.from_numpy(spark, np.ones((5, 5)), dims=("x", "y"), coords={"x": coords(spark, *range(5))}) for _ in range(4)]
    out = tree_reduce_labelled(g)
    assert out.attrs["tree_reduced_from"] == 4 and {r[0] for r in out.df.select(out.values[0]).collect()} == {4.0}
    assert tree_reduce_labelled(g, lambda a, b: F.greatest(a, b)).df.count() == 25
    moved = Grid.from_numpy(spark, np.ones((5, 5)), dims=("x", "y"), coords={"x": coords(spark, *range(1, 6))})
    with pytest.raises(ValueError):
        tree_reduce_labelled([g[0], moved])


def test_resample(spark):
    df = spark.range(100).select(F.timestamp_seconds(F.lit(1577836800) + F.col("id") * 3600).alias("time"), F.col("id").cast("double").alias("v"))
    got = resample(df, "time", "v", "6h", "mean").orderBy("bin").collect()
    assert len(got) == 17 and got[0].value == 2.5
    gaps = resample(df.where("v < 6 OR v >= 24"), "time", "v", "6h", "sum").orderBy("bin").collect()
    assert [r.value for r in gaps[1:4]] == [0, 0, 0] and len(gaps) == 17
    assert seconds_of("15min") == 900
    with pytest.raises(ValueError):
        seconds_of("1 fortnight")


def test_resample_by_the_calendar(spark):
    import pandas as pd

    times = pd.date_range("2019-11-20 05:00", periods=300, freq="37h").delete(slice(60, 140))
    series = pd.Series(np.arange(len(times), dtype=float), index=times)
    df = spark.createDataFrame([(str(t), float(v)) for t, v in series.items()], "t string, v double").select(F.col("t").cast("timestamp").alias("time"), "v")
    for freq, pandas_freq in (("1M", "ME"), ("MS", "MS"), ("2MS", "2MS"), ("W", "W"), ("QS", "QS"), ("Q", "QE"), ("Y", "YE"), ("YS", "YS"), ("2M", "2ME"), ("5ME", "5ME"), ("2Q", "2QE"), ("3QE", "3QE"), ("2Y", "2YE"), ("2QS", "2QS"), ("2YS", "2YS")):
        want = series.resample(pandas_freq).sum()
        got = {r.bin: r.value for r in resample(df, "time", "v", freq, "sum").select(F.date_format("bin", "yyyy-MM-dd").alias("bin"), "value").collect()}
        assert got == {f"{t:%Y-%m-%d}": v for t, v in want.items()}, freq
    with pytest.raises(ValueError):
        resample(df, "time", "v", "0M", "sum")


def test_movement_and_backends(spark):
    g = Grid.from_numpy(spark, np.arange(64.0).reshape(8, 8))
    assert scatter(g, 2).df.rdd.getNumPartitions() == 2
    assert gather(rechunk(g, (4, 4), 3)).shape == (64, 3)
    assert resolve_backend("distributed").is_distributed and resolve_backend(None).name == "auto"
    with pytest.raises(ValueError):
        resolve_backend("abacus")
    total = map_reduce(g.df, lambda p: p[["v"]] * 2, "v double", lambda d: d.agg(F.sum("v").alias("s"))).first()["s"]
    assert total == 64 * 63
    plan = LazyPlan().add("w", "window", lambda d: d.where("d0 < 4"), "in").add("s", "stats", lambda d: d.agg(F.count("*").alias("n")), "w")
    assert plan.execute("s", **{"in": g.df}).first()["n"] == 32
    with pytest.raises(ValueError):
        plan.add("x", "fold", lambda d: d)


def test_incremental_state_over_frames_and_stream(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((3, 20))
    state = IncrementalState(f"file://{tmp_path}/state", ["d0"], (20,), (5,), [Mean(), Var()])
    for k, frame in enumerate(x):
        state(Grid.from_numpy(spark, frame).df, k)
    state(Grid.from_numpy(spark, x[0]).df, 1)  # a batch seen before
    again = IncrementalState(f"file://{tmp_path}/state", ["d0"], (20,), (5,), [Mean(), Var()])  # after a restart
    again(Grid.from_numpy(spark, x[0]).df, 2)
    assert len([p for p in (tmp_path / "state").iterdir()]) <= 2
    got = again.result(spark).orderBy("d0").collect()
    for k, r in enumerate(got):
        own = x[:, 5 * k : 5 * k + 5].ravel()
        assert np.isclose(r["mean"], own.mean()) and np.isclose(r["var"], own.var(ddof=1))
    for k in range(3):
        Grid.from_numpy(spark, x[k]).df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/frames")
    streamed = IncrementalState(f"file://{tmp_path}/streamed", ["d0"], (20,), (5,), [Mean()])
    query = spark.readStream.schema("d0 long, v double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/frames").writeStream.foreachBatch(streamed).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert np.isclose(streamed.result(spark).where("d0 = 0").first()["mean"], x[:, :5].mean())


@pytest.mark.parametrize("bucket", [4, 100_000])
@pytest.mark.parametrize(("padding", "align"), [("same", "shifted"), ("same", "centered"), ("full", "shifted")])
def test_frames_equal_expansion_beyond_the_edges(spark, monkeypatch, bucket, padding, align):
    monkeypatch.setattr(sliding, "_BUCKET", bucket)
    rng = np.random.default_rng(4)
    grid = Grid.from_numpy(spark, 1e6 + rng.standard_normal((23, 9)), rng.standard_normal((23, 9)))
    config, stats = WindowConfig((5, 12), (3, 2), padding), [Count(), Mean(), Cov()]
    one = Grid(grid.df, grid.dims, grid.extent, ("x",), True)
    for g, asked in ((grid, stats[:1] + stats[2:]), (one, [Count(), Mean(), Var(), Min()])):
        a, b = (materialize(sliding.window_state(g, config, asked, same_align=align, executor=e)[0], g.dims, asked).toPandas().sort_values(["d0", "d1"], ignore_index=True) for e in ("frames", "expand"))
        assert len(a) == len(b)
        np.testing.assert_allclose(a.to_numpy(float), b[a.columns].to_numpy(float), rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("stat", ["mean", "count", "min", "sum", "var"])
@pytest.mark.parametrize(("center", "few"), [(True, 16), (True, 1), (False, 1)])
def test_rolling_with_gaps(spark, monkeypatch, stat, center, few):
    monkeypatch.setattr(sliding, "FEW_WINDOWS", few)
    x = np.random.default_rng(5).standard_normal((11, 7))
    x[3:6, 2:5] = np.nan
    grid = Grid.from_numpy(spark, x)
    out = rolling(grid, {"d0": 3, "d1": 4}, stat, min_periods=2, center=center)
    got = out.df.select(*grid.dims, F.col(out.values[0]).alias("value"))
    a, b = (1, 2) if center else (2, 3)
    want = []
    with np.errstate(all="ignore"):
        for i in range(11):
            for j in range(7):
                w = x[max(0, i - a) : i - a + 3, max(0, j - b) : j - b + 4]
                w = w[~np.isnan(w)]
                want.append(np.nan if len(w) < 2 else {"mean": np.mean, "count": len, "min": np.min, "sum": np.sum, "var": np.var}[stat](w))
    np.testing.assert_allclose(values(got, "d0", "d1"), want, rtol=1e-9)
