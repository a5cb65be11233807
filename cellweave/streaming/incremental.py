"""State is mergeable, so a result is kept up to date by merging the state of what is new."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import Statistic, minimal_components
from ..operators.blocks import PREFIX, aggregates, base_reduce, coarsen, materialize
from ..plans.lattice import Factor
from ..sources.grid import Grid


class IncrementalState:
    """The state of blocks of one factor over all frames seen, stored as Parquet.

    Each update reads the current version, merges the new frame's state and writes the next one
    beside it; then only these two stay, so a failed update leaves the last whole one in place.  The
    version and the last batch are in the folder's name, so a restart goes on from them.  As a
    ``foreachBatch`` function a repeated batch id is ignored."""

    def __init__(self, path: str, dims: Sequence[str], extent: Factor, factor: Factor, stats: Sequence[Statistic], values: Sequence[str] = ("v",)):
        self.path, self.dims, self.extent, self.factor = path.rstrip("/"), tuple(dims), extent, factor
        self.stats, self.values = list(stats), tuple(values)

    def _versions(self, spark) -> list[tuple[int, int]]:  # noqa: ANN001
        """(version, last batch) of the whole versions, oldest first."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [re.fullmatch(r"v(\d+)-batch(-?\d+)", f.getPath().getName()) for f in files.listStatus(folder)]
        whole = [m for m in found if m and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{m[0]}/_SUCCESS"))]
        return sorted((int(m[1]), int(m[2])) for m in whole)

    def _at(self, version: tuple[int, int]) -> str:
        return f"{self.path}/v{version[0]}-batch{version[1]}"

    def _current(self, spark) -> DataFrame | None:  # noqa: ANN001
        versions = self._versions(spark)
        return spark.read.parquet(self._at(versions[-1])) if versions else None

    def update(self, cells: DataFrame, batch: int | None = None) -> None:
        spark = cells.sparkSession
        versions = self._versions(spark)
        last = versions[-1] if versions else (0, -1)
        new = base_reduce(Grid(cells, self.dims, self.extent, self.values), self.factor, self.stats)
        if versions:
            new = coarsen(spark.read.parquet(self._at(last)).unionByName(new), self.dims, self.extent, (1,) * len(self.dims), self.stats)
        new.write.mode("overwrite").parquet(self._at((last[0] + 1, last[1] if batch is None else batch)))
        for version in versions[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(self._at(version))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        versions = self._versions(batch.sparkSession)
        if not versions or batch_id > versions[-1][1]:
            self.update(batch, batch_id)

    def result(self, spark) -> DataFrame:  # noqa: ANN001
        state = self._current(spark)
        if state is None:
            raise ValueError("no frame yet")
        return materialize(state, self.dims, self.stats)


def windowed_state(events: DataFrame, time: str, value: str, size: str, stats: Sequence[Statistic], watermark: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """State of time windows, for a batch or, with a watermark, a stream in append mode."""
    if watermark:
        events = events.withWatermark(time, watermark)
    components = minimal_components(stats)
    grouped = events.groupBy(F.window(time, size).alias("window"), *by).agg(*aggregates(components.values(), [F.col(value)]))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[PREFIX + c for c in components])
