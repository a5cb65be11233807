import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import Count, Cov, Grid, Max, Mean, Min, Moments, Sum, Tower, Var, reduce_stats
from cellweave.functions.statistics import geometric_mean
from cellweave.operators.blocks import materialize, value_columns
from cellweave.operators.towers import SCALE, all_scales, box
from cellweave.plans import solver_plan, tower_plan

STATS = [Count(), Sum(), Mean(), Var(), Min(), Max(), Moments(2), geometric_mean()]


def table(df, keys):
    return {tuple(r[k] for k in keys): [r[c] for c in df.columns if c not in keys] for r in df.collect()}


def check(grid, plan, stats, skipna=False, **kwargs):
    got = table(materialize(all_scales(grid, plan, stats, value_columns(grid, skipna), skipna, **kwargs), [SCALE, *grid.dims], stats), [SCALE, *grid.dims])
    want = {}
    direct = reduce_stats(grid, None, stats, skipna=skipna, plan=plan, strategy="direct")
    for k, step in enumerate(plan.steps):
        if step.wanted:
            want |= {(k, *b): v for b, v in table(direct[step.factor], grid.dims).items()}
    assert got.keys() == want.keys() and got
    for k in got:
        np.testing.assert_allclose(np.array(got[k], float), np.array(want[k], float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("least", [1, 8, 10_000])
@pytest.mark.parametrize("factors", [[(2, 2), (4, 4), (8, 8), (16, 16)], [(4, 4), (6, 6), (9, 9)], [(3, 1)], [(5, 2), (10, 2), (5, 6), (10, 6)]])
def test_one_pass_equals_a_pass_for_each_scale(spark, least, factors):
    x = np.abs(np.random.default_rng(1).normal(size=(45, 37))) + 0.5
    grid = Grid.from_numpy(spark, x)
    check(grid, solver_plan((45, 37), factors), STATS, least_boxes=least)


def test_gaps_pairs_and_sparse_grids(spark):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(30, 24))) + 0.5
    x[rng.random(x.shape) < 0.3] = np.nan
    x[8:16, 0:8] = np.nan
    plan = tower_plan((30, 24), (2, 2), [[2, 3], [2]], (12, 8))
    check(Grid.from_numpy(spark, x), plan, STATS[:-1], skipna=True)
    check(Grid.from_numpy(spark, np.nan_to_num(x), np.nan_to_num(x.T.reshape(x.shape)) ** 2), plan, [Cov(), Cov(False)])
    rows = [(int(a), int(b), float(v)) for a, b, v in zip(np.minimum(rng.geometric(0.1, 800) - 1, 29), rng.integers(0, 24, 800), rng.normal(100, 1, 800), strict=True)]
    check(Grid.from_table(spark.createDataFrame(rows, "a long, b long, v double"), ["a", "b"], ["v"], (30, 24)), plan, STATS)


def test_boxes_hold_whole_blocks_and_leave_enough_tasks():
    plan = solver_plan((4096, 4096), [(f, f) for f in (2, 4, 8, 16, 32, 64)])
    assert box(plan, 16) == ((64, 64), [0, 1, 2, 3, 4, 5])
    size, inner = box(plan, 100_000)
    assert size == (8, 8) and [plan.steps[k].factor[0] for k in inner] == [2, 4, 8]
    assert box(solver_plan((96, 96), [(4, 4), (6, 6)]), 4)[0] == (12, 12)


@pytest.mark.parametrize("scales", [[2, 4, 8, 16, 32, 64], Tower((5, 2), [[2], [3]], (20, 6))])
def test_the_plan_has_one_scan_and_one_shuffle(spark, tmp_path, scales):
    path = f"file://{tmp_path}/cells.parquet"
    spark.range(1024 * 64).select(F.expr("id div 64").alias("i"), (F.col("id") % 64).alias("j"), F.rand(1).alias("v"), F.lit("x").alias("unused")).write.parquet(path)
    grid = Grid.from_table(spark.read.parquet(path), ["i", "j"], ["v"], (1024, 64), dense=True)
    df = reduce_stats(grid, scales).to_dataframe()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert final.count("FileScan") == 1 or final.split("== Initial Plan ==")[0].count("FileScan") == 1
    final = final.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "ReusedExchange" not in final and "Union" not in final
    assert "unused" not in final


def test_frames_of_single_scales_and_the_whole_agree(spark):
    x = np.random.default_rng(3).normal(size=(64, 40))
    result = reduce_stats(Grid.from_numpy(spark, x), [4, 8, 20])
    whole = result.to_dataframe().toPandas()
    assert list(whole.columns) == ["f_d0", "f_d1", "d0", "d1", "mean", "var"] and whole["f_d0"].value_counts().to_dict() == {4: 160, 8: 40, 20: 6}
    one = result[20].toPandas().sort_values(["d0", "d1"])
    np.testing.assert_allclose(whole[whole.f_d0 == 20].sort_values(["d0", "d1"])["var"], one["var"])
