"""Block reductions and merges of state between scales."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import prod

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.statistics import SPREADS, Component, Count, Median, Min, Statistic, minimal_components, nan
from ..plans.lattice import Factor, factor_shape
from ..plans.planner import ReductionPlan
from ..sources.grid import Grid
from .merging import PREFIX, folded, merged, state_column
from .selection import SELECT_FROM, medians


def check_arity(grid: Grid, stats: Sequence[Statistic]) -> None:
    for s in stats:
        if s.arity != grid.arity:
            raise ValueError(f"{s.name} takes {s.arity} field(s); the grid has {grid.arity}")


def value_columns(grid: Grid, skipna: bool) -> list[Column]:
    """The value columns; with skipna, NaN counts as missing."""
    kinds = {f.name: f.dataType for f in grid.df.select(*grid.values).schema}
    return [F.nanvl(F.col(v), F.lit(None)) if skipna and isinstance(kinds[v], T.FractionalType) and not isinstance(kinds[v], T.DecimalType) else F.col(v) for v in grid.values]


def aggregates(components: Sequence[Component], values: Sequence[Column]) -> list[Column]:
    return [c.lift(values).alias(PREFIX + c.name) for c in components]


def truncated(df: DataFrame, dims: Sequence[str], extent: Factor, factor: Factor) -> DataFrame:
    """Only whole blocks: cells past the last whole block go."""
    past = [F.col(d) < x // f * f for d, x, f in zip(dims, extent, factor, strict=True) if x % f]
    return df.where(reduce(Column.__and__, past)) if past else df


def block_keys(dims: Sequence[str], factor: Factor) -> list[Column]:
    return [F.expr(f"`{d}` div {f}").alias(d) if f > 1 else F.col(d) for d, f in zip(dims, factor, strict=True)]


def base_reduce(grid: Grid, factor: Factor, stats: Sequence[Statistic], skipna: bool = False) -> DataFrame:
    """State of every block straight from the cells: one partial and one final aggregation."""
    cells = truncated(grid.df, grid.dims, grid.extent, factor)
    if any(isinstance(s, Median) for s in stats) and prod(factor) >= SELECT_FROM:
        return _with_selected(grid, cells, factor, stats, skipna)
    return cells.groupBy(*block_keys(grid.dims, factor)).agg(*aggregates(minimal_components(stats).values(), value_columns(grid, skipna)))


def _with_selected(grid: Grid, cells: DataFrame, factor: Factor, stats: Sequence[Statistic], skipna: bool) -> DataFrame:
    """The same for large blocks: medians are selected in rounds, which keep no block's cells together."""
    keyed = cells.select(*block_keys(grid.dims, factor), *[v.alias(n) for v, n in zip(value_columns(grid, skipna), grid.values, strict=True)])
    others = [s for s in stats if not isinstance(s, Median)]
    components = list(minimal_components(others).values()) if others else [minimal_components([Count()])["n"]]
    state = keyed.groupBy(*grid.dims).agg(*aggregates(components, [F.col(v) for v in grid.values]))
    both = state.join(medians(keyed, grid.dims, grid.values[0], PREFIX + "median"), list(grid.dims), "left")
    return both.select(*grid.dims, *[PREFIX + c for c in minimal_components(stats)])


def coarsen(state: DataFrame, dims: Sequence[str], extent: Factor | None, window: Factor, stats: Sequence[Statistic], equal: bool = False) -> DataFrame:
    """State of coarser blocks merged from state rows.  extent is that of the finer blocks, or None if
    all rows count; equal: all of them hold equally many cells."""
    components = minimal_components(stats)
    bad = [s.name for s in stats if not s.mergeable]
    if bad:
        raise ValueError(f"not mergeable: {', '.join(bad)}")
    rows = state if extent is None else truncated(state, dims, extent, window)
    by_two = {n: c for n, c in components.items() if c.both is not None}
    if any(w > 1 for w in window) and by_two:
        out = folded(rows, dims, window, by_two)
        others = {n: c for n, c in components.items() if n not in by_two}
        return out if not others else out.join(coarsen_rows(rows, dims, window, others, equal), list(dims)).select(*dims, *[PREFIX + c for c in components])
    return coarsen_rows(rows, dims, window, components, equal)


def coarsen_rows(rows: DataFrame, dims: Sequence[str], window: Factor, components: dict[str, Component], equal: bool) -> DataFrame:
    return merged(rows.select(*block_keys(dims, window), *[PREFIX + c for c in components]), dims, components, equal)


def materialize(state: DataFrame, dims: Sequence[str], stats: Sequence[Statistic], value_type: T.DataType | None = None) -> DataFrame:
    """Values of state rows, a column for each result of each statistic."""
    out: dict[str, Column] = {}
    for s in stats:
        for name, c in s.result(state_column).items():
            if name in out:
                raise ValueError(f"two statistics give a column {name}")
            if isinstance(value_type, T.FloatType) and (s.narrows or isinstance(s, Min)):
                c = c.cast("float")
            elif isinstance(s, Min) and value_type is not None and not isinstance(value_type, T.DoubleType):
                c = state_column(name)  # no NaN in this type
            out[name] = c
    return state.select(*dims, *[c.alias(n) for n, c in out.items()])


def run_plan(grid: Grid, plan: ReductionPlan, stats: Sequence[Statistic], skipna: bool = False, strategy: str = "tower", kept: list[DataFrame] | None = None) -> dict[Factor, DataFrame]:
    """State by wanted factor.

    ``tower`` merges along the plan; ``direct`` reads the cells for each scale;
    ``grouping_sets`` reads them once for all scales.  Statistics that cannot be merged take
    the cells in any case.  With a list ``kept``, steps of a tower that others are merged from are
    persisted and added to it, for callers that use the scales one by one."""
    if strategy not in ("tower", "direct", "grouping_sets"):
        raise ValueError(f"unknown strategy {strategy!r}")
    merge = [s for s in stats if s.mergeable]
    holistic = [s for s in stats if not s.mergeable]
    states: dict[Factor, DataFrame] = {}
    if strategy == "grouping_sets":
        states = grouping_sets(grid, plan.targets, stats, skipna)
    elif strategy == "direct":
        states = {f: base_reduce(grid, f, stats, skipna) for f in plan.targets}
    else:
        extents: list[Factor] = []
        by_step: list[DataFrame] = []
        sources = {s.source for s in plan.steps} if kept is not None and merge else set()
        for k, step in enumerate(plan.steps):
            if not merge:
                by_step.append(grid.df)
            elif step.source is None:
                by_step.append(base_reduce(grid, step.factor, merge, skipna))
            else:
                by_step.append(coarsen(by_step[step.source], grid.dims, extents[step.source], step.window, merge, grid.dense and not skipna))
            if k in sources:
                by_step[-1] = by_step[-1].persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(by_step[-1])
            extents.append(factor_shape(grid.extent, step.factor))
            if step.wanted:
                own = by_step[-1]
                if holistic:
                    apart = base_reduce(grid, step.factor, holistic, skipna)
                    own = own.join(apart, list(grid.dims)) if merge else apart
                states[step.factor] = own
    return states


def grouping_sets(grid: Grid, factors: Sequence[Factor], stats: Sequence[Statistic], skipna: bool = False) -> dict[Factor, DataFrame]:
    """State of all scales from one scan: each cell is expanded into one row for each scale.

    The scale is part of the key, so one aggregation serves all; every scale is a filter of it."""
    scales = []
    for k, f in enumerate(factors):
        whole = [F.col(d) < x // b * b for d, x, b in zip(grid.dims, grid.extent, f, strict=True)]
        key = F.struct(F.lit(k).alias("scale"), *[F.expr(f"`{d}` div {b}").alias(d) for d, b in zip(grid.dims, f, strict=True)])
        scales.append(F.when(reduce(Column.__and__, whole), key))
    cells = grid.df.select(*grid.values, F.explode(F.array_compact(F.array(*scales))).alias("at"))
    inner = Grid(cells, grid.dims, grid.extent, grid.values)
    state = cells.groupBy("at").agg(*aggregates(minimal_components(stats).values(), value_columns(inner, skipna)))
    names = [PREFIX + c for c in minimal_components(stats)]
    return {f: state.where(F.col("at.scale") == k).select(*[F.col(f"at.{d}").alias(d) for d in grid.dims], *names) for k, f in enumerate(factors)}


def group_reduce(df: DataFrame, by: Sequence[str], reductions: dict[str, tuple[str, Statistic]]) -> DataFrame:
    """Grouping by arbitrary labels: of {name: (column, statistic)}, one column for each."""
    states, results = [], []
    for name, (column, stat) in reductions.items():
        own: Callable[[str], Column] = lambda c, name=name: F.col(f"{PREFIX}{name}__{c}")
        states += [c.lift([F.col(column)]).alias(f"{PREFIX}{name}__{c.name}") for c in stat.components()]
        values = list(stat.result(own).items())
        results += [c.alias(name if len(values) == 1 else f"{name}_{k}") for k, c in values]
    return df.groupBy(*by).agg(*states).select(*by, *results)


def inverse_merge(whole: DataFrame, part: DataFrame, dims: Sequence[str], stats: Sequence[Statistic]) -> DataFrame:
    """State of what is in ``whole`` and not in ``part``, for statistics that form a group."""
    bad = [s.name for s in stats if not s.invertible]
    if bad:
        raise ValueError(f"no inverse: {', '.join(bad)}")
    names = list(minimal_components(stats))
    a = whole.select(*dims, *[F.col(PREFIX + c).alias(f"a_{c}") for c in names])
    b = part.select(*dims, *[F.col(PREFIX + c).alias(f"b_{c}") for c in names])
    both = a.join(b, list(dims), "left")
    return both.select(*dims, *[e.alias(PREFIX + c) for c, e in _inverse(names, lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")).items()])


def _inverse(names: Sequence[str], whole: Callable[[str], Column], part: Callable[[str], Column]) -> dict[str, Column]:
    """Components of what is in one state and not in another."""
    x = lambda c: F.coalesce(whole(c), F.lit(0.0 if c != "n" else 0))
    y = lambda c: F.coalesce(part(c), F.lit(0.0 if c != "n" else 0))
    out = {}
    if "n" in names:
        n = (x("n") - y("n")).cast("double")
        some = n > 0
        mean = {m: F.when(some, (x("n") * x(m) - y("n") * y(m)) / F.when(some, n)).otherwise(0.0) for m in ("mean", "mean_y") if m in names}
        whole_n = F.when(x("n") > 0, x("n").cast("double"))
    for c in names:
        if c in ("mean", "mean_y"):
            out[c] = mean[c]
        elif c in SPREADS:
            p, q = SPREADS[c]
            out[c] = F.when(some, x(c) - y(c) - (mean[p] - y(p)) * (mean[q] - y(q)) * n * y("n") / whole_n).otherwise(0.0)
        else:
            out[c] = x(c) - y(c)
    return out


def _alike(a: DataFrame, b: DataFrame, dims: Sequence[str], tolerance: float) -> bool:
    names = [c for c in a.columns if c not in dims]
    both = a.withColumn("in_a", F.lit(True)).join(b.select(*dims, F.lit(True).alias("in_b"), *[F.col(c).alias(f"m_{c}") for c in names]), list(dims), "full")
    unlike = [~(F.col(c).eqNullSafe(F.col(f"m_{c}")) | (F.abs(F.col(c) - F.col(f"m_{c}")) <= tolerance * (1 + F.abs(F.col(c))))) for c in names]
    unlike.append(F.col("in_a").isNull() | F.col("in_b").isNull())
    return both.where(reduce(Column.__or__, [F.coalesce(u, F.lit(True)) for u in unlike])).isEmpty()


def check_merge(grid: Grid, fine: Factor, window: Factor, stats: Sequence[Statistic], tolerance: float = 1e-8) -> bool:
    """Whether merging blocks of ``fine`` gives what the cells give."""
    coarse = tuple(f * w for f, w in zip(fine, window, strict=True))
    direct = materialize(base_reduce(grid, coarse, stats), grid.dims, stats)
    merged = materialize(coarsen(base_reduce(grid, fine, stats), grid.dims, factor_shape(grid.extent, fine), window, stats), grid.dims, stats)
    return _alike(direct, merged, grid.dims, tolerance)


def check_laws(grid: Grid, factor: Factor, stats: Sequence[Statistic], tolerance: float = 1e-8) -> dict[str, bool]:
    """Whether the state of blocks obeys the laws of a commutative monoid, and of a group where all
    statistics have an inverse, on the grid's cells dealt into three parts by a hash.

    All states come from one pass over the cells, and all merges from two aggregations."""
    components = minimal_components(stats)
    deal = F.pmod(F.xxhash64(*grid.dims, *grid.values), F.lit(3))
    of = {"A": deal == 0, "B": deal == 1, "C": deal == 2, "none": F.lit(False), "all": F.lit(True)}
    cells = truncated(grid.df, grid.dims, grid.extent, factor)
    keyed = cells.select(*block_keys(grid.dims, factor), *[F.when(cond, F.col(v)).alias(f"__of {part} {v}") for part, cond in of.items() for v in grid.values])
    lifted = [F.struct(*[c.lift([F.col(f"`__of {part} {v}`") for v in grid.values]).alias(PREFIX + n) for n, c in components.items()]).alias(f"__of {part}") for part in of]
    parts = keyed.groupBy(*grid.dims).agg(*lifted)

    def combined(rows: DataFrame, sums: dict[str, list[str]]) -> DataFrame:
        """The states of each sum, merged."""
        terms = F.array(*[F.struct(F.lit(name).alias("__sum"), F.col(f"`__of {term}`").alias("state")) for name, of in sums.items() for term in of])
        dealt = rows.withColumn("__term", F.explode(terms)).select(*grid.dims, "__term.__sum", "__term.state.*")
        return merged(dealt, [*grid.dims, "__sum"], components).groupBy(*grid.dims).agg(*[F.first(F.when(F.col("__sum") == name, F.struct(*[PREFIX + c for c in components])), ignorenulls=True).alias(f"__of {name}") for name in sums])

    first = combined(parts, {"A": ["A"], "B": ["B"], "C": ["C"], "all": ["all"], "AB": ["A", "B"], "BA": ["B", "A"], "BC": ["B", "C"], "A0": ["A", "none"], "0A": ["none", "A"]})
    both = combined(first, {**{k: [k] for k in ("A", "B", "AB", "BA", "A0", "0A", "all")}, "(AB)C": ["AB", "C"], "A(BC)": ["A", "BC"]})

    def alike(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        pairs = [(u, s.result(y)[name]) for s in stats for name, u in s.result(x).items()]
        return reduce(Column.__and__, [u.eqNullSafe(v) | F.coalesce(F.abs(u - v) <= tolerance * (1 + F.abs(u)), F.lit(False)) for u, v in pairs])

    at = lambda name: lambda c: F.col(f"`__of {name}`")[PREFIX + c]
    laws = {
        "identity": alike(at("A0"), at("A")) & alike(at("0A"), at("A")),
        "commutativity": alike(at("AB"), at("BA")),
        "associativity": alike(at("(AB)C"), at("A(BC)")),
        "homomorphism": alike(at("(AB)C"), at("all")),
    }
    if all(s.invertible for s in stats):
        left = _inverse(list(components), at("AB"), at("B"))
        laws["inverse"] = alike(lambda c: left[c], at("A")) | (at("A")("n") == 0 if "n" in components else F.lit(False))
    held = both.agg(*[F.min(law).alias(name) for name, law in laws.items()]).first()
    return {name: held[name] is not False for name in laws}


__all__ = ["base_reduce", "check_laws", "check_merge", "coarsen", "group_reduce", "grouping_sets", "inverse_merge", "materialize", "nan", "run_plan"]
