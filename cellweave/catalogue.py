"""State that outlives a session: towers kept up to date batch by batch, and a lattice of stored scales."""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import ceil, lcm, prod

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import MultiResResult, Scale, Tower, plan_for
from .functions.statistics import Mean, Statistic, Var, minimal_components
from .operators.blocks import base_reduce, check_arity, coarsen, materialize, value_columns
from .operators.merging import PREFIX, merged
from .operators.towers import SCALE, all_scales
from .plans.lattice import Factor, divides, factor_shape, factor_window
from .sources.grid import Grid


#: Parts up to which their list (16 bytes each) is broadcast; beyond they are joined.
MAX_BROADCAST = 1_000_000


class _Folder:
    """The few operations on the shared file system that stored state needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):  # noqa: ANN201
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(f.getPath().getName() for f in self._files.listStatus(self.at(name))) if self._files.exists(self.at(name)) else []

    def whole(self, name: str) -> bool:
        return self._files.exists(self.at(f"{name}/_SUCCESS"))

    def delete(self, name: str) -> None:
        self._files.delete(self.at(name), True)


class IncrementalTower:
    """The state of all scales of a tower over all batches seen, as Parquet.

    State is kept in parts: boxes that hold whole blocks of all scales, ``boxes`` of them in each dimension.  A batch's
    cells are reduced to all scales in one pass; the old state of the parts that they touch is read, merged
    with theirs, and written as those parts' next version.  Parts that are not touched are neither read nor
    written.  A version counts when the list of its parts is written, after its state, so an update that fails leaves the last whole
    one in place and is done again over what it left.  As a ``foreachBatch`` function a batch id that has been
    taken is ignored, also after a restart."""

    def __init__(self, path: str, dims: Sequence[str], extent: Factor, scales: Tower | Scale | Sequence[Scale], stats: Sequence[Statistic] = (Mean(), Var()), values: Sequence[str] = ("v",), boxes: int | Sequence[int] = 1, skipna: bool = False):
        self.path, self.dims, self.extent = path.rstrip("/"), tuple(dims), tuple(extent)
        self.plan, self.stats, self.values, self.skipna = plan_for(self.extent, scales), list(stats), tuple(values), skipna
        bad = [s.name for s in stats if not s.mergeable]
        if bad:
            raise ValueError(f"not mergeable: {', '.join(bad)}")
        per_dim = (boxes,) * len(self.dims) if isinstance(boxes, int) else tuple(boxes)
        self.part = tuple(b * lcm(*[s.factor[d] for s in self.plan.steps]) for d, b in enumerate(per_dim))

    def _part_of(self) -> Column:
        """The part of a block, from its scale and place: numbered row by row."""
        out = F.lit(0).cast("long")
        for k, (d, x, p) in enumerate(zip(self.dims, self.extent, self.part, strict=True)):
            blocks = F.element_at(F.array(*[F.lit(p // s.factor[k]) for s in self.plan.steps]), F.col(SCALE) + 1)
            out = out * ceil(x / p) + F.floor(F.col(d) / blocks).cast("long")
        return out.alias("part")

    def _lists(self, spark: SparkSession) -> list[tuple[int, int, str]]:
        """(version, batch, name) of the lists that count, oldest first: the last summary and what came after it."""
        folder = _Folder(spark, self.path)
        found = [re.fullmatch(r"(v|upto)(\d+)-batch(-?\d+)", n) for n in folder.names("parts")]
        lists = sorted((int(m[2]), m[1] == "upto", int(m[3]), m[0]) for m in found if m and folder.whole(f"parts/{m[0]}"))
        summary = max((k for k, x in enumerate(lists) if x[1]), default=0)
        return [(version, batch, name) for version, _, batch, name in lists[summary:]]

    def _versions(self, spark: SparkSession) -> list[tuple[int, int]]:
        return [(version, batch) for version, batch, _ in self._lists(spark)]

    def _now(self, spark: SparkSession, lists: Sequence[tuple[int, int, str]]) -> DataFrame:
        """part, version: where each part's state is."""
        read = spark.read.schema("part long, version long").parquet(*[f"{self.path}/parts/{name}" for _, _, name in lists])
        return read.groupBy("part").agg(F.max("version").alias("version"))

    def _listed(self, parts: DataFrame) -> DataFrame:
        """Parts for a join: broadcast, so that other folders aren't read, where the extent has few enough of them."""
        return F.broadcast(parts) if prod(ceil(x / p) for x, p in zip(self.extent, self.part, strict=True)) <= MAX_BROADCAST else parts

    def _state(self, spark: SparkSession, parts: DataFrame | None = None) -> DataFrame | None:
        """The state of all parts, or of those listed: only their folders are read.  None if there is none."""
        lists = self._lists(spark)
        if not lists:
            return None
        now = self._now(spark, lists)
        if parts is not None:
            now = now.join(self._listed(parts), "part", "left_semi")
        try:
            kept = spark.read.parquet(f"{self.path}/state")
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return None  # no batch had a cell
        return kept.join(self._listed(now), ["part", "version"], "left_semi").drop("version")

    def update(self, cells: DataFrame, batch: int = -1) -> None:
        spark = cells.sparkSession
        components = minimal_components(self.stats)
        grid = Grid(cells, self.dims, self.extent, self.values)
        names = [PREFIX + c for c in components]
        new = all_scales(grid, self.plan, self.stats, value_columns(grid, self.skipna), self.skipna).select(self._part_of(), SCALE, *self.dims, *names)
        versions = self._versions(spark)
        version = versions[-1][0] + 1 if versions else 1
        name = f"v{version}-batch{batch if batch >= 0 else (versions[-1][1] if versions else -1)}"
        folder = _Folder(spark, self.path)
        folder.delete(f"new/{name}")
        new.write.parquet(f"{self.path}/new/{name}")
        new = spark.read.schema(new.schema).parquet(f"{self.path}/new/{name}")
        touched = new.select("part").distinct()
        old = self._state(spark, touched)
        if old is not None:
            new = merged(old.select("part", SCALE, *self.dims, *names).unionByName(new), ["part", SCALE, *self.dims], components)
        folder.delete(f"state/version={version}")
        new.repartition("part").write.partitionBy("part").parquet(f"{self.path}/state/version={version}")
        folder.delete(f"parts/{name}")
        touched.select("part", F.lit(version).cast("long").alias("version")).coalesce(1).write.parquet(f"{self.path}/parts/{name}")
        folder.delete(f"new/{name}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        versions = self._versions(batch.sparkSession)
        if not versions or batch_id > versions[-1][1]:
            self.update(batch, batch_id)

    def vacuum(self, spark: SparkSession) -> None:
        """Writes the lists of all versions so far as one, and deletes them and the versions of which no part is current."""
        lists = self._lists(spark)
        if not lists:
            return
        folder = _Folder(spark, self.path)
        last, batch, summary = lists[-1]
        if len(lists) > 1:
            summary = f"upto{last}-batch{batch}"
            folder.delete(f"parts/{summary}")
            self._now(spark, lists).coalesce(1).write.parquet(f"{self.path}/parts/{summary}")
        used = {r.version for r in spark.read.schema("version long").parquet(f"{self.path}/parts/{summary}").distinct().collect()}
        for name in folder.names("parts"):
            m = re.fullmatch(r"(?:v|upto)(\d+)-batch-?\d+", name)
            if m and int(m[1]) <= last and name != summary:
                folder.delete(f"parts/{name}")
        for name in folder.names("state"):
            m = re.fullmatch(r"version=(\d+)", name)
            if m and int(m[1]) <= last and int(m[1]) not in used:
                folder.delete(f"state/{name}")

    def result(self, spark: SparkSession) -> DataFrame:
        """Values of all scales: f_<dim>, dims, statistics."""
        state = self._state(spark)
        if state is None:
            raise ValueError("no cells yet")
        values = materialize(state, [SCALE, *self.dims], self.stats)
        of = [F.element_at(F.array(*[F.lit(s.factor[k]).cast("long") for s in self.plan.steps]), F.col(SCALE) + 1).alias(f"f_{d}") for k, d in enumerate(self.dims)]
        return values.select(*of, *[c for c in values.columns if c != SCALE])


class Lattice:
    """Stored states of a field's scales, by factor and components, for this session and later ones.

    A request is answered from the stored scale with the fewest blocks that divides it and holds its components; what
    it takes is stored too.  Cells are read only where no stored scale serves.  The folder stands for one field: a
    field that changes needs another.  Users' statistics are known by their names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._folder = spark, _Folder(spark, path)

    @staticmethod
    def _name(factor: Factor, components: Sequence[str], skipna: bool, even: bool) -> str:
        return f"f{'x'.join(map(str, factor))}-{'skip' if skipna else 'all'}-{'even' if even else 'any'}-{'.'.join(sorted(components))}"

    def stored(self) -> list[tuple[Factor, frozenset[str], bool, bool]]:
        """(factor, components, whether NaN was left out, whether all blocks hold equally many cells) of what is here."""
        out = []
        for name in self._folder.names():
            m = re.fullmatch(r"f([\dx]+)-(skip|all)-(even|any)-(.+)", name)
            if m and self._folder.whole(name):
                out.append((tuple(map(int, m[1].split("x"))), frozenset(m[4].split(".")), m[2] == "skip", m[3] == "even"))
        return out

    def _best(self, extent: Factor, factor: Factor, components: set[str], skipna: bool) -> tuple[Factor, frozenset[str], bool, bool] | None:
        fit = [e for e in self.stored() if len(e[0]) == len(factor) and divides(e[0], factor) and components <= e[1] and e[2] == skipna]
        return min(fit, key=lambda e: (prod(factor_shape(extent, e[0])), len(e[1]), sorted(e[1])), default=None)

    def state(self, grid: Grid, factor: Factor, stats: Sequence[Statistic], skipna: bool = False) -> DataFrame:
        """State of one scale, stored if it wasn't."""
        components = minimal_components(stats)
        even = grid.dense and not skipna
        found = self._best(grid.extent, factor, set(components), skipna)
        if found is not None and found[0] == factor:
            name = self._name(*found)
        else:
            name = self._name(factor, list(components), skipna, even)
            if found is None:
                made = base_reduce(grid, factor, stats, skipna)
            else:
                finer = self.spark.read.parquet(f"{self._folder.path}/{self._name(*found)}")
                made = coarsen(finer, grid.dims, factor_shape(grid.extent, found[0]), factor_window(found[0], factor), stats, found[3])
            self._folder.delete(name)
            made.write.parquet(f"{self._folder.path}/{name}")
        return self.spark.read.parquet(f"{self._folder.path}/{name}").select(*grid.dims, *[PREFIX + c for c in components])

    def reduce_stats(self, grid: Grid, scales: Tower | Scale | Sequence[Scale], stats: Sequence[Statistic] = (Mean(), Var()), skipna: bool = False) -> MultiResResult:
        """As ``reduce_stats``, from stored scales where they serve."""
        check_arity(grid, stats)
        bad = [s.name for s in stats if not s.mergeable]
        if bad:
            raise ValueError(f"not mergeable: {', '.join(bad)}")
        plan, kind = plan_for(grid.extent, scales), grid.df.schema[grid.values[0]].dataType
        components = set(minimal_components(stats))
        for step in plan.steps:  # sources first; scales that only serve others are made where nothing else does
            if step.wanted or self._best(grid.extent, step.factor, components, skipna) is None:
                self.state(grid, step.factor, stats, skipna)
        frames = {f: materialize(self.state(grid, f, stats, skipna), grid.dims, stats, kind) for f in plan.targets}
        return MultiResResult(grid.dims, frames, {f: factor_shape(grid.extent, f) for f in plan.targets}, plan)
