"""The grid abstraction and its sources, sinks and partition movement."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A field over an N-dimensional box.

    ``df`` has a row for each cell: BIGINT columns ``dims`` (0-based) and the value columns.
    ``extent`` is the box; cells may be missing or repeated unless ``dense``.  ``coords``
    holds, for a labelled dimension, a DataFrame (idx, coord) of its coordinate values.
    """

    df: DataFrame
    dims: tuple[str, ...]
    extent: tuple[int, ...]
    values: tuple[str, ...] = ("v",)
    dense: bool = False
    name: str = "field"
    coords: dict[str, DataFrame] = field(default_factory=dict)
    attrs: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.dims) != len(self.extent):
            raise ValueError(f"{len(self.dims)} dimensions, but an extent of {len(self.extent)}")
        if any(x < 0 for x in self.extent):
            raise ValueError(f"negative extent {self.extent}")

    @property
    def arity(self) -> int:
        return len(self.values)

    @classmethod
    def from_table(cls, df: DataFrame, dims: Sequence[str], values: Sequence[str], extent: Sequence[int] | None = None, **kwargs: object) -> Grid:
        """A grid from columns; without an extent, one pass finds the largest index of each dimension."""
        cells = df.select(*[F.col(d).cast("long").alias(d) for d in dims], *values)
        if extent is None:
            top = cells.agg(*[F.max(d).alias(d) for d in dims]).first()
            extent = [0 if top[d] is None else top[d] + 1 for d in dims]
        return cls(cells, tuple(dims), tuple(int(x) for x in extent), tuple(values), **kwargs)

    @classmethod
    def from_array_column(cls, df: DataFrame, row: str, array: str, dims: tuple[str, str] = ("i", "j"), extent: Sequence[int] | None = None, inner: Sequence[int] | None = None, **kwargs: object) -> Grid:
        """A grid from a row index and an array column; ``inner`` splits the array's positions
        into further dimensions, row by row."""
        if extent is None:
            top = df.agg((F.max(row) + 1).alias("rows"), F.max(F.size(array)).alias("width")).first()
            extent = (top["rows"] or 0, top["width"] or 0)
        cells = df.select(F.col(row).cast("long").alias(dims[0]), F.posexplode(array).alias("__at", "__v"))
        if inner is None:
            cells = cells.select(dims[0], F.col("__at").cast("long").alias(dims[1]), F.col("__v").cast("double").alias("v"))
            return cls(cells, dims, tuple(extent), ("v",), **{"dense": True, **kwargs})
        names = tuple(f"{dims[1]}{k}" for k in range(len(inner)))
        keys, step = [], 1
        for size, name in reversed(list(zip(inner, names, strict=True))):
            keys.insert(0, F.expr(f"__at div {step} % {size}").cast("long").alias(name))
            step *= size
        return cls(cells.select(dims[0], *keys, F.col("__v").cast("double").alias("v")), (dims[0], *names), (extent[0], *inner), ("v",), **{"dense": True, **kwargs})

    @classmethod
    def from_numpy(cls, spark: SparkSession, *arrays: object, dims: Sequence[str] | None = None, values: Sequence[str] | None = None, **kwargs: object) -> Grid:
        """A grid from arrays of one shape that fit in the driver."""
        import numpy as np

        arrays = [np.asarray(a) for a in arrays]
        shape = arrays[0].shape
        if any(a.shape != shape for a in arrays):
            raise ValueError(f"shapes differ: {[a.shape for a in arrays]}")
        dims = tuple(dims or (f"d{k}" for k in range(len(shape))))
        values = tuple(values or (("v",) if len(arrays) == 1 else ("x", "y")))
        index = np.indices(shape).reshape(len(shape), -1)
        frame = pd.DataFrame({d: index[k] for k, d in enumerate(dims)} | {v: a.ravel() for v, a in zip(values, arrays, strict=True)})
        kinds = {"i": "long", "u": "long", "b": "boolean"}
        schema = ", ".join([f"`{d}` long" for d in dims] + [f"`{v}` {kinds[a.dtype.kind] if a.dtype.kind != 'f' else 'float' if a.dtype.itemsize <= 4 else 'double'}" for v, a in zip(values, arrays, strict=True)])
        return cls(spark.createDataFrame(frame, schema), dims, tuple(int(x) for x in shape), values, **{"dense": True, **kwargs})

    def pair(self, other: Grid) -> Grid:
        """One grid of two fields over the same box."""
        if self.extent != other.extent or self.dims != other.dims:
            raise ValueError(f"the fields differ in shape: {self.extent} and {other.extent}")
        x = self.df.withColumnRenamed(self.values[0], "x")
        y = other.df.withColumnRenamed(other.values[0], "y")
        return replace(self, df=x.join(y, list(self.dims)).select(*self.dims, "x", "y"), values=("x", "y"), dense=self.dense and other.dense)

    def to_dataframe(self) -> DataFrame:
        return self.df


def scatter(grid: Grid, n_partitions: int | None = None) -> Grid:
    """Contiguous slabs along the first dimension, one for each partition."""
    n = n_partitions or grid.df.sparkSession.sparkContext.defaultParallelism
    return replace(grid, df=grid.df.repartitionByRange(n, grid.dims[0]))


def rechunk(grid: Grid, block: Sequence[int], n_partitions: int | None = None) -> Grid:
    """Cells of one block in one partition, so that block aggregations combine them before a shuffle."""
    keys = [F.expr(f"`{d}` div {int(b)}") for d, b in zip(grid.dims, block, strict=True)]
    return replace(grid, df=grid.df.repartition(n_partitions, *keys) if n_partitions else grid.df.repartition(*keys))


def gather(result: DataFrame | Grid) -> pd.DataFrame:
    """A result in the driver's memory."""
    return (result.df if isinstance(result, Grid) else result).toPandas()
