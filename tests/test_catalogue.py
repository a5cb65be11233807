import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import Count, Cov, Grid, IncrementalTower, Lattice, Max, Mean, Median, Tower, Var, reduce_stats

STATS = [Count(), Mean(), Var(), Max()]


def table(df):
    keys = [c for c in df.columns if c.startswith("f_") or c in ("d0", "d1")]
    return {tuple(r[k] for k in keys): [r[c] for c in df.columns if c not in keys] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        np.testing.assert_allclose(np.array(a[k], float), np.array(b[k], float), rtol=1e-9, atol=1e-9)


def test_batches_give_what_all_cells_give(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(50, 40))
    g = Grid.from_numpy(spark, x)
    tower = IncrementalTower(f"file://{tmp_path}/t", g.dims, g.extent, [2, 4, 8], STATS)
    deal = (F.col("d0") * 7 + F.col("d1") * 3) % 5
    for k in range(5):
        tower.update(g.df.where(deal == k))
    same(table(tower.result(spark)), table(reduce_stats(g, [2, 4, 8], STATS).to_dataframe()))
    tower.vacuum(spark)
    assert [os.path.basename(p) for p in glob.glob(f"{tmp_path}/t/state/*")] == ["version=5"]  # every batch touched all parts
    same(table(tower.result(spark)), table(reduce_stats(g, [2, 4, 8], STATS).to_dataframe()))


def test_a_batch_rewrites_the_parts_it_touches_once(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(256, 32))
    g = Grid.from_numpy(spark, x)
    make = lambda: IncrementalTower(f"file://{tmp_path}/t", g.dims, g.extent, Tower(2, 2, 8), STATS)
    make()(g.df, 0)
    size = lambda v: sum(os.path.getsize(p) for p in glob.glob(f"{tmp_path}/t/state/version={v}/**/*.parquet", recursive=True))
    more = spark.createDataFrame([(9, 9, 100.0), (10, 9, 50.0)], "d0 long, d1 long, v double")
    make()(more, 1)
    make()(more, 1)  # again, as after a restart
    make()(more, 0)
    assert size(2) * 40 < size(1) and not os.path.exists(f"{tmp_path}/t/state/version=3")
    assert len(glob.glob(f"{tmp_path}/t/state/version=2/part=*")) == 1
    want = Grid(g.df.unionByName(more), g.dims, g.extent, g.values)
    same(table(make().result(spark)), table(reduce_stats(want, Tower(2, 2, 8), STATS).to_dataframe()))


def test_batches_go_on_after_their_lists_became_one(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(6).normal(size=(64, 8))
    g = Grid.from_numpy(spark, x)
    make = lambda: IncrementalTower(f"file://{tmp_path}/t", g.dims, g.extent, [4, 8], STATS)
    lists = lambda: sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/t/parts/*"))
    make()(g.df.where("d0 < 40"), 0)
    make()(g.df.where("d0 >= 40 and d1 < 3"), 1)
    make().vacuum(spark)
    assert lists() == ["upto2-batch1"]
    make()(g.df, 1)  # taken before
    monkeypatch.setattr("cellweave.catalogue.MAX_BROADCAST", 0)  # as with more parts than are broadcast
    make()(g.df.where("d0 >= 40 and d1 >= 3"), 5)
    assert lists() == ["upto2-batch1", "v3-batch5"] and make()._versions(spark) == [(2, 1), (3, 5)]
    got = table(make().result(spark))
    same(got, table(reduce_stats(g, [4, 8], STATS).to_dataframe()))
    make().vacuum(spark)
    assert lists() == ["upto3-batch5"] and [os.path.basename(p) for p in sorted(glob.glob(f"{tmp_path}/t/state/*"))] == ["version=1", "version=3"]
    assert table(make().result(spark)) == got
    make().vacuum(spark)
    assert lists() == ["upto3-batch5"]


def test_batches_without_cells(spark, tmp_path):
    g = Grid.from_numpy(spark, np.random.default_rng(7).normal(size=(16, 8)))
    tower = IncrementalTower(f"file://{tmp_path}/t", g.dims, g.extent, [2, 4], STATS)
    tower(g.df.where("false"), 0)
    tower.vacuum(spark)
    with pytest.raises(ValueError, match="no cells yet"):
        tower.result(spark)
    tower(g.df.where("d0 < 5"), 1)
    tower(g.df.where("false"), 2)
    tower(g.df.where("d0 >= 5"), 3)
    tower.vacuum(spark)
    assert tower._versions(spark) == [(4, 3)]
    same(table(tower.result(spark)), table(reduce_stats(g, [2, 4], STATS).to_dataframe()))


def test_an_update_that_failed_is_done_again(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(32, 16))
    g = Grid.from_numpy(spark, x)
    tower = IncrementalTower(f"file://{tmp_path}/t", g.dims, g.extent, [4, 8], STATS)
    tower(g.df.where("d1 < 7"), 0)
    before = table(tower.result(spark))
    broken = g.df.where("d1 >= 7").withColumn("v", F.when(F.col("d0") == 31, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        tower(broken, 1)
    os.makedirs(f"{tmp_path}/t/state/version=2/part=0")  # what a failed write may leave
    assert table(tower.result(spark)) == before
    tower(g.df.where("d1 >= 7"), 1)
    same(table(tower.result(spark)), table(reduce_stats(g, [4, 8], STATS).to_dataframe()))
    with pytest.raises(ValueError):
        IncrementalTower(f"file://{tmp_path}/u", g.dims, g.extent, 4, [Median()])
    with pytest.raises(ValueError):
        IncrementalTower(f"file://{tmp_path}/u", g.dims, g.extent, 4).result(spark)


def test_as_foreach_batch(spark, tmp_path):
    cells = spark.range(600).select(F.col("id").alias("d0"), (F.col("id") % 13).cast("double").alias("v"))
    for k in range(3):
        cells.where(F.col("d0") % 3 == k).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    tower = IncrementalTower(f"file://{tmp_path}/t", ["d0"], (600,), [10, 100], [Count(), Mean(), Var()], boxes=2)
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    stream.writeStream.foreachBatch(tower).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = tower.result(spark).where("f_d0 = 100").collect()
    assert len(got) == 6 and all(r["count"] == 100 for r in got) and tower._versions(spark)[-1] == (3, 2)


def test_a_second_request_reads_no_cells(spark, tmp_path):
    x, y = np.random.default_rng(4).normal(size=(2, 48, 36))
    g = Grid.from_numpy(spark, x, y)
    lattice = Lattice(spark, f"file://{tmp_path}/l")
    first = lattice.reduce_stats(g, [(2, 3), (4, 3)], [Cov()])
    same(table(first.to_dataframe()), table(reduce_stats(g, [(2, 3), (4, 3)], [Cov()]).to_dataframe()))
    gone = Grid(g.df.withColumn("x", F.raise_error(F.lit("cells were read")).cast("double")), g.dims, g.extent, g.values, True)
    again = Lattice(spark, f"file://{tmp_path}/l")  # another session has nothing but the folder
    second = again.reduce_stats(gone, [(4, 3), (8, 9), (12, 12)], [Cov(), Cov(False)])
    same(table(second.to_dataframe()), table(reduce_stats(g, [(4, 3), (8, 9), (12, 12)], [Cov(), Cov(False)]).to_dataframe()))
    with pytest.raises(Exception, match="cells were read"):
        again.reduce_stats(gone, [(3, 3)], [Cov()])  # no stored scale divides it
    assert {e[0] for e in again.stored()} >= {(2, 3), (4, 3), (8, 9), (12, 12)}


def test_what_is_stored_must_hold_the_components(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(24, 24))
    x[3, 4] = np.nan
    g = Grid.from_numpy(spark, x)
    lattice = Lattice(spark, f"file://{tmp_path}/l")
    lattice.reduce_stats(g, 2, [Mean()], skipna=True)
    same(table(lattice.reduce_stats(g, [4], [Mean(), Var()], skipna=True).to_dataframe()), table(reduce_stats(g, [4], [Mean(), Var()], skipna=True).to_dataframe()))
    assert sorted((e[0], e[2]) for e in lattice.stored()) == [((2, 2), True), ((4, 4), True)]
    with pytest.raises(ValueError):
        lattice.reduce_stats(g, 2, [Median()])
