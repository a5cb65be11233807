"""Layout along a space-filling curve, so that what is near in space is near on disk and in partitions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .grid import Grid

#: Tiles of a box up to which they are listed; beyond, the range of their codes is read.
MAX_LISTED = 4096


def morton(coordinates: Sequence[int]) -> int:
    """The code of a place: the binary digits of its coordinates, dealt in turn."""
    n = len(coordinates)
    return sum((x >> b & 1) << (b * n + k) for k, x in enumerate(coordinates) for b in range(63 // n))


def morton_column(coordinates: Sequence[Column], largest: Sequence[int]) -> Column:
    """The same of columns; ``largest`` bounds them."""
    n = len(coordinates)
    if max(largest).bit_length() * n > 63:
        raise ValueError("too many tiles for one code")
    digits = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)), b * n + k) for k, (c, m) in enumerate(zip(coordinates, largest, strict=True)) for b in range(m.bit_length())]
    return reduce(Column.bitwiseOR, digits) if digits else F.lit(0).cast("long")


def _tiles(grid: Grid, tile: Sequence[int]) -> Column:
    at = [F.expr(f"`{d}` div {t}") for d, t in zip(grid.dims, tile, strict=True)]
    return morton_column(at, [max(x - 1, 0) // t for x, t in zip(grid.extent, tile, strict=True)])


def scatter_along_curve(grid: Grid, tile: int | Sequence[int], n_partitions: int | None = None) -> Grid:
    """Contiguous stretches of the curve through tiles, one for each partition: a block of any scale
    lies in few partitions, along every dimension."""
    tile = (tile,) * len(grid.dims) if isinstance(tile, int) else tuple(tile)
    n = n_partitions or grid.df.sparkSession.sparkContext.defaultParallelism
    dealt = grid.df.withColumn("__code", _tiles(grid, tile)).repartitionByRange(n, "__code").sortWithinPartitions("__code", *grid.dims)
    return replace(grid, df=dealt.drop("__code"))


def write_tiled(grid: Grid, path: str, tile: int | Sequence[int]) -> None:
    """Stores a grid as Parquet, a folder for each tile, written along the curve."""
    tile = (tile,) * len(grid.dims) if isinstance(tile, int) else tuple(tile)
    spark = grid.df.sparkSession
    cells = grid.df.select(*grid.dims, *grid.values).withColumn("tile", _tiles(grid, tile))
    about = {"dims": grid.dims, "extent": grid.extent, "values": grid.values, "dense": grid.dense, "tile": tile, "schema": cells.schema.jsonValue()}
    cells.repartitionByRange("tile").sortWithinPartitions("tile", *grid.dims).write.mode("overwrite").partitionBy("tile").parquet(f"{path}/cells")
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def read_tiled(spark: SparkSession, path: str, low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> Grid:
    """The grid, or the box low <= place < high of it (at its own coordinates): only folders of tiles that meet the box are read."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    dims, extent, tile = tuple(about["dims"]), tuple(about["extent"]), about["tile"]
    cells = spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{path}/cells")
    if low is not None or high is not None:
        low, high = tuple(low or (0,) * len(dims)), tuple(high or extent)
        if any(a < 0 or b > x or a > b for a, b, x in zip(low, high, extent, strict=True)):
            raise ValueError(f"the box {low} to {high} isn't inside {extent}")
        cells = _in_box(cells, dims, low, high, tile)
    return Grid(cells.drop("tile"), dims, extent, tuple(about["values"]), about["dense"] and low is None)


def _in_box(cells: DataFrame, dims: Sequence[str], low: Sequence[int], high: Sequence[int], tile: Sequence[int]) -> DataFrame:
    ranges = [range(a // t, -(-b // t)) for a, b, t in zip(low, high, tile, strict=True)]
    inside = reduce(Column.__and__, [(F.col(d) >= a) & (F.col(d) < b) for d, a, b in zip(dims, low, high, strict=True)])
    if not prod(map(len, ranges)):
        return cells.where(F.lit(False))
    if prod(map(len, ranges)) <= MAX_LISTED:
        return cells.where(F.col("tile").isin([morton(at) for at in product(*ranges)]) & inside)
    # codes of a box lie between those of its corners
    return cells.where(F.col("tile").between(morton([r[0] for r in ranges]), morton([r[-1] for r in ranges])) & inside)
