"""All scales of a plan from one scan, and on dense grids from one shuffle.

Cells are dealt once by a box that holds whole blocks of all scales (the least common multiple of their sizes in
each dimension), narrow as they are: dimensions and values.  States of the plan's base scales are
aggregated inside that partitioning; each is then dealt to all the scales that the plan derives from it
and merged, again where it lies.  Scales are told apart by a column, so that one frame holds
them all and no part of the work is planned twice.

A box that is too large would leave few tasks.  Then the coarsest scales are left out of it and are merged from the states
in a second shuffle, combined before it.  Sparse grids may be skewed, so their cells
aren't dealt by box: base states are combined before the first shuffle, and scales before the second.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, lcm, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import Statistic, minimal_components
from ..plans.lattice import Factor
from ..plans.planner import ReductionPlan
from ..sources.grid import Grid
from .merging import PREFIX, merged

SCALE = "__scale"


def roots(plan: ReductionPlan) -> list[int]:
    """For each step the base step that it derives from."""
    out: list[int] = []
    for k, step in enumerate(plan.steps):
        out.append(k if step.source is None else out[step.source])
    return out


def box(plan: ReductionPlan, least_boxes: int) -> tuple[Factor, list[int]]:
    """The box to deal cells by, and the steps whose blocks it holds whole.

    Steps are left out, the one of the most cells first, while there are fewer boxes than ``least_boxes``; base steps stay."""
    inner = list(range(len(plan.steps)))
    while True:
        size = tuple(lcm(*[plan.steps[k].factor[d] for k in inner]) for d in range(len(plan.extent)))
        spare = [k for k in inner if plan.steps[k].source is not None]
        if prod(ceil(x / b) for x, b in zip(plan.extent, size, strict=True)) >= least_boxes or not spare:
            return size, inner
        inner.remove(max(spare, key=lambda k: (prod(plan.steps[k].factor), k)))


def all_scales(grid: Grid, plan: ReductionPlan, stats: Sequence[Statistic], values: Sequence[Column], skipna: bool = False, least_boxes: int | None = None) -> DataFrame:
    """State of all wanted scales: the step's place in the plan (``SCALE``), the block, the state."""
    components = minimal_components(stats)
    names = [PREFIX + c for c in components]
    equal = grid.dense and not skipna
    spark = grid.df.sparkSession
    least = least_boxes if least_boxes is not None else 2 * spark.sparkContext.defaultParallelism
    size, inner = box(plan, least) if grid.dense else ((1,) * len(plan.extent), [])
    of, wanted = roots(plan), [k for k, s in enumerate(plan.steps) if s.wanted]
    bases = sorted(set(of))
    boxes = [f"__box{k}" for k in range(len(grid.dims))] if grid.dense else []

    cells = grid.df.select(*grid.dims, *[v.alias(f"__value{k}") for k, v in enumerate(values)])
    if boxes:
        cells = cells.withColumns({b: F.expr(f"`{d}` div {n}") for b, d, n in zip(boxes, grid.dims, size, strict=True)}).repartition(*boxes)
    rest = [*boxes, *[f"__value{k}" for k in range(len(values))]]
    at = _dealt(cells, grid.dims, plan.extent, [(k, plan.steps[k].factor) for k in bases], rest)
    lifted = [F.col(f"__value{k}") for k in range(len(values))]
    state = at.groupBy(SCALE, *boxes, *grid.dims).agg(*[c.lift(lifted).alias(PREFIX + name) for name, c in components.items()])

    def spread(rows: DataFrame, source: dict[int, int], keys: Sequence[str]) -> DataFrame:
        """Rows of the sources dealt to their scales ({scale: source}) and merged by ``keys``."""
        parts = []
        for base in sorted(set(source.values())):
            extent = tuple(x // f for x, f in zip(plan.extent, plan.steps[base].factor, strict=True))
            windows = [(k, tuple(c // f for c, f in zip(plan.steps[k].factor, plan.steps[base].factor, strict=True))) for k, b in source.items() if b == base]
            parts.append(F.when(F.col(SCALE) == base, _places(grid.dims, extent, windows)))
        dealt = rows.withColumn("__to", F.explode(F.coalesce(*parts))).select(*[k for k in keys if k not in (SCALE, *grid.dims)], "__to.*", *names)
        return merged(dealt, list(keys), components, equal)

    own = {k: of[k] for k in wanted if k in inner or not grid.dense}
    if list(own) == [b for b in bases if b in own] and not [k for k in wanted if k not in own]:
        return state.select(SCALE, *grid.dims, *names)  # the base scales are all that is wanted
    later = {k: of[k] for k in wanted if k not in own}
    # what later scales are merged from: the coarsest scale at hand that divides them
    at_hand = {*own, *bases}
    for k in later:
        above = [p for p in at_hand if all(a % b == 0 for a, b in zip(plan.steps[k].factor, plan.steps[p].factor, strict=True))]
        later[k] = max(above, key=lambda p: (prod(plan.steps[p].factor), -p))
    near = {**own, **{p: of[p] for p in later.values()}}
    rows = spread(state, near, [SCALE, *boxes, *grid.dims]).select(SCALE, *grid.dims, *names)
    if not later:
        return rows
    kept = {k: k for k in own}
    return _merged_later(rows, grid.dims, plan, {**kept, **later}, components, equal)


def _merged_later(rows: DataFrame, dims: Sequence[str], plan: ReductionPlan, source: dict[int, int], components: dict, equal: bool) -> DataFrame:
    names = [PREFIX + c for c in components]
    parts = []
    for base in sorted(set(source.values())):
        extent = tuple(x // f for x, f in zip(plan.extent, plan.steps[base].factor, strict=True))
        windows = [(k, tuple(c // f for c, f in zip(plan.steps[k].factor, plan.steps[base].factor, strict=True))) for k, b in source.items() if b == base]
        parts.append(F.when(F.col(SCALE) == base, _places(dims, extent, windows)))
    dealt = rows.withColumn("__to", F.explode(F.coalesce(*parts))).select("__to.*", *names)
    return merged(dealt, [SCALE, *dims], components, equal)


def _places(dims: Sequence[str], extent: Factor, windows: Sequence[tuple[int, Factor]]) -> Column:
    """The (scale, block) that a row belongs to, for each scale: what is past the last whole block is in none."""
    out = []
    for scale, window in windows:
        place = F.struct(F.lit(scale).alias(SCALE), *[F.expr(f"`{d}` div {w}").alias(d) if w > 1 else F.col(d) for d, w in zip(dims, window, strict=True)])
        past = [F.col(d) < x // w * w for d, x, w in zip(dims, extent, window, strict=True) if x % w]
        out.append(F.when(reduce(Column.__and__, past), place) if past else place)
    return F.array_compact(F.array(*out))


def _dealt(cells: DataFrame, dims: Sequence[str], extent: Factor, factors: Sequence[tuple[int, Factor]], rest: Sequence[str]) -> DataFrame:
    """Cells with the scale and block of each base scale: one row for each."""
    if len(factors) > 1:
        return cells.withColumn("__to", F.explode(_places(dims, extent, factors))).select("__to.*", *rest)
    scale, factor = factors[0]
    past = [F.col(d) < x // f * f for d, x, f in zip(dims, extent, factor, strict=True) if x % f]
    rows = cells.where(reduce(Column.__and__, past)) if past else cells
    return rows.select(F.lit(scale).alias(SCALE), *[F.expr(f"`{d}` div {f}").alias(d) if f > 1 else F.col(d) for d, f in zip(dims, factor, strict=True)], *rest)
