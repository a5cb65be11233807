"""Exact medians by selection on histograms, in memory that doesn't grow with the group.

A round counts the values of every group by an order-preserving digit, combined before the shuffle, and finds the
digit that holds the middle; the next round looks only at the values in it.  Digits part the range evenly in the first round, which is
mostly enough to leave a few values; after it, those of a wide range are sign and power of two, and those
within one power of two part it evenly.  A digit's own least and greatest values bound
the next round, so each round parts what is left, and at most seven are needed for doubles.  A group
takes at most as many rows as there are digits, however many values it has; groups of any number, of all blocks
and scales, go through the rounds together.

NaN, if it isn't left out, is greater than all other values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lattice import Factor
from ..sources.grid import Grid
from ..storage import settled
from .towers import SCALE, _places

#: Parts of a range in a round.
PARTS = 4096
#: Groups up to which their brackets are broadcast (about 100 bytes each); beyond they are joined.
MAX_BROADCAST = 50_000
#: Cells of a block from which its median is selected; smaller ones fit a task's buffer.
SELECT_FROM = 65_536


def _power(v: Column) -> Column:
    """Sign and power of two as a number that grows with the value; 5000 for NaN."""
    size = F.abs(v)
    power = F.when(size == float("inf"), F.lit(2200)).otherwise(F.floor(F.log2(size)).cast("int") + 1100)
    return F.when(F.isnan(v), F.lit(5000)).when(v > 0, power).when(v < 0, -power).otherwise(F.lit(0))


def medians(rows: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """``by`` and the exact median of ``value`` of every group; null values are left out, and groups without
    any other have none."""
    keys = [f"__key{k}" for k in range(len(by) + 1)]
    cells = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=False)], F.lit(0).alias(keys[-1]), F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    groups = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    places = F.array(F.struct(F.lit(0).alias("side"), F.expr("(__n - 1) div 2").alias("rank")), F.struct(F.lit(1).alias("side"), F.expr("__n div 2").alias("rank")))
    wanted = settled(groups.withColumn("__at", F.explode(places)).select(*keys, "__low", "__high", F.col("__at.side").alias("__side"), F.col("__at.rank").alias("__rank")))
    done = []
    while True:
        done.append(wanted.where(F.col("__low") == F.col("__high")))
        wanted = wanted.where(F.col("__low") != F.col("__high"))
        n = wanted.count()
        if not n:
            break
        wanted = settled(_narrowed(cells, wanted, keys, n <= MAX_BROADCAST, len(done) == 1))
    both = reduce(DataFrame.unionByName, done)
    ends = [F.max(F.when(F.col("__side") == k, F.col("__low"))) for k in (0, 1)]
    middle = F.when(ends[0] == ends[1], ends[0]).otherwise(ends[0] + (ends[1] - ends[0]) * 0.5)
    return both.groupBy(*keys).agg(middle.alias(name)).select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], name)


def _narrowed(cells: DataFrame, wanted: DataFrame, keys: Sequence[str], few: bool, first: bool = False) -> DataFrame:
    """One round: of every wanted place the digit that holds it, as the next bracket."""
    bracket = [*keys, "__low", "__high"]

    def known(df: DataFrame) -> DataFrame:
        named = df.withColumnsRenamed({c: f"{c}_of" for c in bracket})
        return F.broadcast(named) if few else named

    def same(columns: Sequence[str]) -> Column:
        return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in columns])

    v, low, high = F.col("__v"), F.col("__low"), F.col("__high")
    inside = cells.join(known(wanted.select(*bracket).distinct()), same(keys) & (v >= F.col("__low_of")) & (v <= F.col("__high_of")))
    inside = inside.select(*keys, F.col("__low_of").alias("__low"), F.col("__high_of").alias("__high"), "__v")
    near = _power(low) == _power(high)
    if first:
        near = near | (F.abs(high - low) < float("inf"))
    width = F.when(near, high - low)
    part = F.least(F.floor((v - low) / F.when(width > 0, width) * PARTS).cast("int"), F.lit(PARTS - 1))
    digits = inside.withColumn("__digit", F.when(near, part).otherwise(_power(v)))
    counted = digits.groupBy(*bracket, "__digit").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
    # a bracket has a row for each digit, at most some thousands
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*bracket).orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("__before", before)
    found = counted.join(known(wanted), same(bracket) & (F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__n")))
    return found.select(*keys, F.col("__from").alias("__low"), F.col("__to").alias("__high"), "__side", (F.col("__rank") - F.col("__before")).alias("__rank"))


def median_scales(grid: Grid, factors: Sequence[Factor], skipna: bool = False) -> DataFrame:
    """Medians of the whole blocks of several scales in the same rounds: f_<dim>, dims, median."""
    value = F.col(grid.values[0]).cast("double")
    cells = grid.df.select(*grid.dims, (F.nanvl(value, F.lit(None)) if skipna else value).alias("__value"))
    dealt = cells.withColumn("__to", F.explode(_places(grid.dims, grid.extent, list(enumerate(factors))))).select("__to.*", "__value")
    out = medians(dealt, [SCALE, *grid.dims], "__value")
    of = [F.element_at(F.array(*[F.lit(f[k]).cast("long") for f in factors]), F.col(SCALE) + 1).alias(f"f_{d}") for k, d in enumerate(grid.dims)]
    return out.select(*of, *grid.dims, "median")
