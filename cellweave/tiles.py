"""Dense two-dimensional fields stored as slabs of rows, reduced at all scales without a shuffle.

A slab holds ``height`` whole rows as one array, and the height is a multiple of every factor
of the first dimension, so that no block straddles slabs: each task computes all scales of its
slabs along the plan, merging coarse blocks from fine ones, and emits values only.  The kernel
works on Arrow batches with NumPy; the long form (``Grid``) serves every other case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import MultiResResult, Scale, Tower, plan_for
from .functions.statistics import Mean, Statistic, Var
from .plans.lattice import Factor, factor_shape
from .plans.planner import ReductionPlan

#: Bytes of a slab, at most.
MAX_SLAB_BYTES = 64 << 20
#: Statistics that the kernel has: the name decides the formula.
_SUPPORTED = ("count", "sum", "mean", "var", "var_pop", "std", "std_pop", "min", "max")


@dataclass(frozen=True)
class Tiles:
    """``df`` has slab (BIGINT) and data: rows of ``extent[1]`` values, as ARRAY<DOUBLE> or as BINARY (float64 in the
    machine's order), which Spark hands over without a look at each value."""

    df: DataFrame
    extent: Factor
    height: int

    @classmethod
    def from_rows(cls, df: DataFrame, row: str, array: str, extent: Factor, height: int = 64) -> Tiles:
        """Slabs from one row each: rows of a slab meet in one shuffle; a slab is height rows at most."""
        rows = df.select(F.col(row).cast("long").alias("r"), F.col(array).cast("array<double>").alias("a"))
        slabs = rows.groupBy(F.expr(f"r div {height}").alias("slab")).agg(F.sort_array(F.collect_list(F.struct("r", "a"))).alias("rows"))
        return cls(slabs.select("slab", F.flatten(F.transform("rows", lambda x: x["a"])).alias("data")), tuple(extent), height)

    @classmethod
    def from_grid_rows(cls, spark: SparkSession, rows: int, width: int, height: int = 64, seed: int = 7) -> Tiles:
        """A field of pseudo-random normal values, made slab by slab."""

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                for slab in batch.column(0).to_pylist():
                    n = min(height, rows - slab * height) * width
                    values = np.random.default_rng([seed, slab]).standard_normal(n)
                    yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int64()), pa.array([memoryview(values).cast("B")], pa.binary())], names=["slab", "data"])

        slabs = spark.range(-(-rows // height)).mapInArrow(make, "slab long, data binary")
        return cls(slabs, (rows, width), height)

    def __post_init__(self) -> None:
        if self.height * self.extent[1] * 8 > MAX_SLAB_BYTES:
            raise ValueError(f"a slab of {self.height} rows of {self.extent[1]} takes over {MAX_SLAB_BYTES} bytes; chunks cut both dimensions")

    def plan(self, scales: Tower | Scale | Sequence[Scale]) -> ReductionPlan:
        plan = plan_for(self.extent, scales)
        tallest = lcm(*[s.factor[0] for s in plan.steps])
        if self.height % tallest:
            raise ValueError(f"slabs of {self.height} rows don't hold whole blocks of {tallest}")
        return plan

    def reduce_stats(self, scales: Tower | Scale | Sequence[Scale], stats: Sequence[Statistic] = (Mean(), Var())) -> TileResult:
        bad = [s.name for s in stats if s.name not in _SUPPORTED]
        if bad:
            raise ValueError(f"slabs don't support {', '.join(bad)}")
        plan = self.plan(scales)
        names = [s.name for s in stats]
        (n_rows, width), height = self.extent, self.height
        kinds = ["long" if n == "count" else "double" for n in names]
        schema = ", ".join(["f_d0 long", "f_d1 long", "d0 long", "d1 long", *[f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                slabs, lists = batch.column("slab").to_pylist(), batch.column("data")
                for k, slab in enumerate(slabs):
                    x = (np.frombuffer(lists[k].as_buffer(), np.float64) if pa.types.is_binary(lists.type) else np.asarray(lists[k].values)).reshape(-1, width)
                    if len(x) != min(height, n_rows - slab * height):
                        raise ValueError(f"slab {slab} isn't dense")
                    done: list[dict] = []
                    for step in plan.steps:
                        state = _base(np, x, step.factor, names) if step.source is None else _merged(np, done[step.source], step.window)
                        done.append(state)
                        if not step.wanted or not state["mean"].size:
                            continue
                        a, b = state["mean"].shape
                        size = a * b
                        first = slab * height // step.factor[0]
                        columns = [np.full(size, step.factor[0]), np.full(size, step.factor[1]), np.repeat(np.arange(first, first + a), b), np.tile(np.arange(b), a)]
                        columns += [_value(np, state, n).ravel() for n in names]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["f_d0", "f_d1", "d0", "d1", *names])

        return TileResult(self.df.mapInArrow(run, schema), plan, names)


def _summed(np, x, a: int, b: int):  # noqa: ANN001, ANN202
    """Sums of blocks of a x b: whole rows are added, then every b-th column."""
    h, w = x.shape[0] // a, x.shape[1] // b
    rows = x[: h * a].reshape(h, a, x.shape[1]).sum(1) if a > 1 else x
    if b > 16:
        return rows[:, : w * b].reshape(h, w, b).sum(2)
    out = rows[:, 0 : w * b : b].copy() if b > 1 else rows[:, :w]
    for k in range(1, b):
        out += rows[:, k : w * b : b]
    return out


def _less(np, x, mean, a: int, b: int):  # noqa: ANN001, ANN202
    """Squares of what the values of blocks differ from the blocks' means."""
    h, w = mean.shape
    d = x[: h * a, : w * b].reshape(h, a, w * b) - np.repeat(mean, b, axis=1)[:, None, :]
    d *= d
    return d.reshape(h * a, w * b)


def _base(np, x, factor: Factor, names: Sequence[str]) -> dict:  # noqa: ANN001
    a, b = factor
    h, w = x.shape[0] // a, x.shape[1] // b
    state = {"n": a * b, "mean": _summed(np, x, a, b) / (a * b)}
    if any(n.startswith(("var", "std")) for n in names):
        state["m2"] = _summed(np, _less(np, x, state["mean"], a, b), a, b)
    blocks = x[: h * a, : w * b].reshape(h, a, w, b)
    for n, f in (("min", blocks.min), ("max", blocks.max)):
        if n in names and blocks.size:
            state[n] = f((1, 3))
    return state


def _merged(np, fine: dict, window: Factor) -> dict:  # noqa: ANN001
    a, b = window
    h, w = fine["mean"].shape[0] // a, fine["mean"].shape[1] // b

    def blocks(name: str):  # noqa: ANN202
        return fine[name][: h * a, : w * b].reshape(h, a, w, b)

    mean = _summed(np, fine["mean"], a, b) / (a * b)
    state = {"n": fine["n"] * a * b, "mean": mean}
    if "m2" in fine:
        state["m2"] = _summed(np, fine["m2"], a, b) + fine["n"] * _summed(np, _less(np, fine["mean"], mean, a, b), a, b)
    if "min" in fine and mean.size:
        state["min"] = blocks("min").min((1, 3))
    if "max" in fine and mean.size:
        state["max"] = blocks("max").max((1, 3))
    return state


def _value(np, state: dict, name: str):  # noqa: ANN001, ANN202
    n = state["n"]
    if name == "count":
        return np.full(state["mean"].shape, n, np.int64)
    if name == "sum":
        return state["mean"] * n
    if name in state:
        return state[name]
    divisor = n if name.endswith("_pop") else n - 1
    var = state["m2"] / divisor if divisor else np.full(state["mean"].shape, np.nan)
    return np.sqrt(var) if name.startswith("std") else var


class TileResult(MultiResResult):
    """All scales come from one pass; each scale is a filter of it."""

    def __init__(self, df: DataFrame, plan: ReductionPlan, names: Sequence[str]):
        self._all = df
        of = {f: df.where((F.col("f_d0") == f[0]) & (F.col("f_d1") == f[1])).select("d0", "d1", *names) for f in plan.targets}
        super().__init__(("d0", "d1"), of, {f: factor_shape(plan.extent, f) for f in plan.targets}, plan)

    def to_dataframe(self) -> DataFrame:
        return self._all
