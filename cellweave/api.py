"""The front door: ``reduce_stats`` over block scales, towers and sliding windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backends import resolve_backend
from .functions.statistics import Mean, Statistic, Var
from .operators.blocks import check_arity, materialize, run_plan, value_columns
from .operators.sliding import WindowConfig, window_state
from .operators.towers import SCALE, all_scales
from .plans.lattice import Factor, factor_shape
from .plans.planner import ReductionPlan, solver_plan, tower_plan
from .sources.grid import Grid


@dataclass(frozen=True)
class Tower:
    """All scales from ``base`` by ``steps`` up to ``largest``; a number holds for every dimension.

    ``steps``: a number, a list of numbers for every dimension, or a list for each dimension."""

    base: int | Sequence[int] = 1
    steps: int | Sequence[int] | Sequence[Sequence[int]] = 2
    largest: int | Sequence[int] = 64

    def plan(self, extent: Factor) -> ReductionPlan:
        n = len(extent)
        steps = [self.steps] if isinstance(self.steps, int) else list(self.steps)
        per_dim = [list(s) for s in steps] if steps and not isinstance(steps[0], int) else [steps] * n
        if len(per_dim) != n:
            raise ValueError(f"steps for {len(per_dim)} of {n} dimensions")
        return tower_plan(extent, _per_dim(self.base, n), per_dim, _per_dim(self.largest, n))


@dataclass(frozen=True)
class Sliding:
    """Overlapping windows; the stride is the window unless given, the origin 0-based."""

    window: int | Sequence[int]
    stride: int | Sequence[int] | None = None
    origin: int | Sequence[int] = 0

    def resolved(self, extent: Factor) -> tuple[Factor, Factor, Factor]:
        n = len(extent)
        window = _per_dim(self.window, n)
        stride = window if self.stride is None else _per_dim(self.stride, n)
        origin = _per_dim(self.origin, n)
        for x, w, s, o in zip(extent, window, stride, origin, strict=True):
            if w < 1 or s < 1 or o < 0:
                raise ValueError("windows and strides must be 1 or more, origins 0 or more")
            if w + o > x:
                raise ValueError(f"a window of {w} from {o} doesn't fit into {x}")
        return window, stride, origin


Scale = int | Sequence[int]


def _per_dim(x: Scale, n: int) -> Factor:
    out = (int(x),) * n if isinstance(x, int) else tuple(int(v) for v in x)
    if len(out) != n:
        raise ValueError(f"{out} for {n} dimensions")
    return out


class MultiResResult:
    """A DataFrame of values for each scale, finest first.

    Block scales are keyed by factor, windows by (window, stride, origin).  ``together`` holds all
    scales in one frame, where one pass gives them (``to_dataframe``)."""

    def __init__(self, dims: Sequence[str], frames: dict[tuple, DataFrame], shapes: dict[tuple, Factor], plan: ReductionPlan | None = None, kept: Sequence[DataFrame] = (), together: DataFrame | None = None):
        self.dims, self._frames, self.shapes, self.plan, self._kept, self._together = tuple(dims), frames, shapes, plan, list(kept), together

    def unpersist(self) -> None:
        """Gives up the state that ``use_cache`` keeps between scales."""
        while self._kept:
            self._kept.pop().unpersist()

    @property
    def factors(self) -> list[tuple]:
        return list(self._frames)

    def __getitem__(self, scale: Scale | tuple) -> DataFrame:
        if isinstance(scale, int):
            scale = (scale,) * len(self.dims)
        return self._frames[tuple(scale)]

    def __call__(self, scale: Scale | tuple, stat: Statistic | str) -> DataFrame:
        name = stat if isinstance(stat, str) else stat.name
        return self[scale].select(*self.dims, name)

    def __contains__(self, scale: object) -> bool:
        return scale in self._frames

    def __iter__(self) -> Iterator[tuple]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def keys(self) -> list[tuple]:
        return self.factors

    def items(self) -> list[tuple[tuple, DataFrame]]:
        return list(self._frames.items())

    def to_dataframe(self) -> DataFrame:
        """All scales in one frame, with the factor of each dimension as f_<dim>."""
        if self._together is not None:
            return self._together
        out = None
        for key, df in self._frames.items():
            factor = key[0] if isinstance(key[0], tuple) else key
            own = df.select(*[F.lit(f).cast("long").alias(f"f_{d}") for d, f in zip(self.dims, factor, strict=True)], *df.columns)
            out = own if out is None else out.unionByName(own)
        return out

    def __repr__(self) -> str:
        lines = [f"MultiResResult over {', '.join(self.dims)}: {len(self)} scales"]
        return "\n".join(lines + [f"  {k}: {self.shapes[k]}" for k in self._frames])


def plan_for(extent: Factor, scales: Tower | Scale | Sequence[Scale]) -> ReductionPlan:
    """The plan of a tower, one scale, or several (numbers or tuples in a list)."""
    if isinstance(scales, Tower):
        return scales.plan(extent)
    if isinstance(scales, (int, tuple)):
        return solver_plan(extent, [_per_dim(scales, len(extent))])
    return solver_plan(extent, [_per_dim(s, len(extent)) for s in scales])


def reduce_stats(grid: Grid, scales: Tower | Sliding | Scale | Sequence[Scale] | Sequence[Sliding], stats: Sequence[Statistic] = (Mean(), Var()), *, skipna: bool = False, strategy: str = "tower", executor: str = "auto", plan: ReductionPlan | None = None, backend: object = None, use_cache: bool = False) -> MultiResResult:
    """Statistics of a field, or of a pair of fields, over blocks or windows at one or more scales.

    Scales used one by one follow the plan's steps; ``to_dataframe`` gives all of them from one pass over the cells.
    A plan may be reused for any grid of its extent.  ``backend`` is accepted and checked: where
    the work runs is the session's affair.  ``use_cache`` keeps the state of scales that others are
    merged from until the result's ``unpersist``, so that scales used one by one share it."""
    resolve_backend(backend)
    check_arity(grid, stats)
    kind = grid.df.schema[grid.values[0]].dataType
    slidings = [scales] if isinstance(scales, Sliding) else scales if isinstance(scales, (list, tuple)) and scales and all(isinstance(s, Sliding) for s in scales) else None
    if slidings is not None:
        frames, shapes = {}, {}
        for spec in slidings:
            key = spec.resolved(grid.extent)
            state, shape = window_state(grid, WindowConfig(key[0], key[1]), stats, key[2], skipna, executor=executor)
            frames[key], shapes[key] = materialize(state, grid.dims, stats, kind), shape
        return MultiResResult(grid.dims, frames, shapes)
    if plan is None:
        plan = plan_for(grid.extent, scales)
    elif plan.extent != grid.extent:
        raise ValueError(f"the plan is for {plan.extent}, the grid has {grid.extent}")
    kept: list[DataFrame] = []
    states = run_plan(grid, plan, stats, skipna, strategy, kept if use_cache else None)
    frames = {f: materialize(states[f], grid.dims, stats, kind) for f in plan.targets}
    together = None
    if strategy == "tower" and not use_cache and len(plan.targets) > 1 and all(s.mergeable and not any(c.both for c in s.components()) for s in stats):
        scales_of = [F.element_at(F.array(*[F.lit(s.factor[k]).cast("long") for s in plan.steps]), F.col(SCALE) + 1).alias(f"f_{d}") for k, d in enumerate(grid.dims)]
        rows = all_scales(grid, plan, stats, value_columns(grid, skipna), skipna)
        values = materialize(rows, [SCALE, *grid.dims], stats, kind)
        together = values.select(*scales_of, *[c for c in values.columns if c != SCALE])
    return MultiResResult(grid.dims, frames, {f: factor_shape(grid.extent, f) for f in plan.targets}, plan, kept, together)
