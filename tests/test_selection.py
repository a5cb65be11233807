import numpy as np
import pytest

from cellweave import Grid, Mean, Median, reduce_stats, window_stat
from cellweave.operators import blocks, selection

INF, NAN = float("inf"), float("nan")


def got(df):
    return {r.k: r.median for r in df.collect()}


@pytest.mark.parametrize("few", [True, False])
def test_medians_of_awkward_groups(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(selection, "MAX_BROADCAST", 0)
    rng = np.random.default_rng(1)
    groups = {
        "one": [3.5],
        "two": [1.0, 2.0],
        "ties": [5.0] * 400 + [7.0] * 399,
        "normal": rng.normal(size=1501).tolist(),
        "offset": (1e12 + rng.normal(size=1000)).tolist(),
        "wide": (rng.normal(size=999) * 10.0 ** rng.integers(-300, 300, 999)).tolist(),
        "tiny": [5e-324, -5e-324, 0.0, -0.0, 1e-310, 2e-310],
        "ends": [INF, -INF, 1.0, 2.0, INF],
        "near": (1.0 + np.arange(5000) * 2.0**-52).tolist(),
        "signs": [-1.0] * 500 + [1.0] * 500,
        None: [1.0, 4.0, 9.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    out = got(selection.medians(df, ["k"], "v"))
    assert out == {k: float(np.median(v)) for k, v in groups.items()}


def test_nan_counts_as_the_greatest(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, NAN, NAN)] + [("b", v) for v in (1.0, 2.0, NAN)], "k string, v double")
    out = got(selection.medians(df, ["k"], "v"))
    assert np.isnan(out["a"]) and out["b"] == 2.0
    skipped = got(window_stat(spark.createDataFrame([("a", 1.0), ("a", NAN), ("a", 5.0), ("b", NAN)], "k string, v double"), "v", "median", ["k"]))
    assert skipped["a"] == 3.0 and np.isnan(skipped["b"])
    assert np.isnan(window_stat(df.where("false"), "v", "median").first()["median"]) and window_stat(df.where("false"), "v", "median", ["k"]).count() == 0


def test_large_blocks_are_selected(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SELECT_FROM", 100)
    x = np.random.default_rng(2).normal(size=(44, 30))
    g = Grid.from_numpy(spark, x)
    r = reduce_stats(g, [(20, 10)], [Median(), Mean()])[20, 10].toPandas()
    for d0, d1, median, mean in r[["d0", "d1", "median", "mean"]].itertuples(index=False):
        own = x[int(d0) * 20 : int(d0) * 20 + 20, int(d1) * 10 : int(d1) * 10 + 10]
        assert np.isclose(median, np.median(own)) and np.isclose(mean, own.mean())
    assert len(r) == 6 and list(reduce_stats(g, (20, 10), [Median()])[20, 10].columns) == ["d0", "d1", "median"]


def test_a_round_keeps_counts_and_not_values(spark):
    rows = spark.range(200_000).selectExpr("id % 3 AS k", "cast(hash(id) AS double) AS v")
    wanted = rows.groupBy("k").count().selectExpr("k AS __key0", "0 AS __key1", "cast(-3e9 AS double) AS __low", "cast(3e9 AS double) AS __high", "0 AS __side", "count div 2 AS __rank")
    cells = rows.selectExpr("k AS __key0", "0 AS __key1", "v AS __v")
    plan = selection._narrowed(cells, wanted, ["__key0", "__key1"], True)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "percentile" not in plan and "collect" not in plan
    out = got(selection.medians(rows, ["k"], "v"))
    assert out == got(rows.groupBy("k").agg({"v": "median"}).withColumnRenamed("median(v)", "median"))
