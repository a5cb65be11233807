"""Overlapping windows: two queues in linear time, sliding frames, and expansion into windows for any grid and statistic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import Component, Statistic, minimal_components
from ..plans.lattice import Factor
from ..sources.grid import Grid
from .blocks import PREFIX, aggregates, state_column, value_columns
from .queues import queueable, queued_windows

PADDINGS = ("valid", "same", "full")


@dataclass(frozen=True)
class WindowConfig:
    """Window sizes, strides (the sizes, unless given) and padding."""

    sizes: tuple[int, ...]
    strides: tuple[int, ...] | None = None
    padding: str = "valid"

    def __post_init__(self) -> None:
        object.__setattr__(self, "sizes", tuple(int(x) for x in self.sizes))
        object.__setattr__(self, "strides", self.sizes if self.strides is None else tuple(int(x) for x in self.strides))
        if len(self.sizes) != len(self.strides):
            raise ValueError("sizes and strides differ in length")
        if any(x < 1 for x in (*self.sizes, *self.strides)):
            raise ValueError("sizes and strides must be 1 or more")
        if self.padding not in PADDINGS:
            raise ValueError(f"padding must be one of {', '.join(PADDINGS)}")


def window_geometry(n: int, w: int, s: int, padding: str = "valid", same_align: str = "shifted") -> tuple[int, int]:
    """(number of windows, start of the first) along one dimension; windows are clipped to [0, n)."""
    if padding == "valid":
        return max(0, (n - w) // s + 1), 0
    if padding == "same":
        half = (w - 1) // 2
        return (max(0, (n - 1) // s + 1) if n else 0), half if same_align == "shifted" else -half
    return (max(0, (n + w - 2) // s + 1) if n else 0), -(w - 1)


def validate_window_config(extent: Sequence[int], config: WindowConfig, strict: bool = False) -> bool:
    """True unless strict finds windows that don't cover the extent exactly, which raises."""
    if len(config.sizes) != len(extent):
        raise ValueError(f"{len(config.sizes)} window sizes for {len(extent)} dimensions")
    if strict:
        for k, (n, w, s) in enumerate(zip(extent, config.sizes, config.strides, strict=True)):
            if w > n:
                raise ValueError(f"dimension {k}: a window of {w} is larger than {n}")
            if (n - w) % s:
                raise ValueError(f"dimension {k}: windows of {w} at a stride of {s} leave a remainder of {n}")
    return True


def _window_ids(d: str, n: int, w: int, s: int, first: int) -> Column:
    """The windows k, 0 <= k < n, with first + k s <= d < first + k s + w."""
    x = F.col(d) - first
    low = F.greatest(F.expr(f"floor((`{d}` - {first} - {w - 1} + {s - 1}) / {s})"), F.lit(0))
    high = F.least(F.expr(f"floor((`{d}` - {first}) / {s})"), F.lit(n - 1))
    ids = F.when((x >= 0) & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return ids


def expanded_windows(grid: Grid, counts: Sequence[int], sizes: Sequence[int], strides: Sequence[int], firsts: Sequence[int], stats: Sequence[Statistic], skipna: bool = False) -> DataFrame:
    """State of every window that holds a cell: each cell goes to all its windows.

    Right for any grid, statistic and padding; rows grow by the product of size / stride."""
    df = grid.df
    for d, n, w, s, first in zip(grid.dims, counts, sizes, strides, firsts, strict=True):
        if w == 1 and s == 1 and first == 0:
            df = df.where(F.col(d) < n)
        elif w == s and first == 0:
            df = df.where(F.col(d) < n * s).withColumn(d, F.expr(f"`{d}` div {s}"))
        else:
            df = df.withColumn(d, F.explode(_window_ids(d, n, w, s, first)))
    return df.groupBy(*grid.dims).agg(*aggregates(minimal_components(stats).values(), value_columns(grid, skipna)))


#: Cells of a line that are windowed together; the first w - 1 of the next ones come along.
_BUCKET = 100_000


def framed_windows(grid: Grid, counts: Sequence[int], sizes: Sequence[int], strides: Sequence[int], firsts: Sequence[int], stats: Sequence[Statistic], skipna: bool = False) -> DataFrame:
    """The same for dense grids, one axis at a time by window frames.

    A window is worked out at its first cell; where windows start before cell 0, every line gets
    empty cells there.  After the first axis state rows are merged.  Along one line they hold
    equally many cells, clipped or not, unless skipna leaves some out (see ``framable``).
    A line is cut into buckets with a halo of the next w - 1 cells, so that no line, however
    long, is one task."""
    components = list(minimal_components(stats).values())
    state = [PREFIX + c.name for c in components]
    df = grid.df.select(*grid.dims, *[e.alias(PREFIX + c.name) for c, e in ((c, _single(c, value_columns(grid, skipna))) for c in components)])
    lifted = False
    for axis, (d, n, w, s, first) in enumerate(zip(grid.dims, counts, sizes, strides, firsts, strict=True)):
        others = [o for o in grid.dims if o != d]
        if first < 0:
            before = F.when(F.col(d) == 0, F.sequence(F.lit(first).cast("long"), F.lit(0).cast("long"))).otherwise(F.array(d))
            df = df.withColumn("__at", F.explode(before))
            df = df.select(*[F.col("__at").alias(d) if o == d else o for o in grid.dims], *[F.when(F.col("__at") >= 0, F.col(c)).alias(c) for c in state])
        if w > 1:
            size = max(_BUCKET, 2 * w)
            halo = F.expr(f"`{d}` % {size}") < w - 1
            buckets = F.when(halo & (F.col(d) >= size), F.array(F.expr(f"`{d}` div {size}"), F.expr(f"`{d}` div {size} - 1"))).otherwise(F.array(F.expr(f"`{d}` div {size}")))
            if grid.extent[axis] > size:
                df = df.withColumn("__bucket", F.explode(buckets))
            else:
                df = df.withColumn("__bucket", F.lit(0))
            frame = Window.partitionBy(*others, "__bucket").orderBy(d).rangeBetween(0, w - 1)
            merged = [_framed(c, frame, lifted, skipna).alias(PREFIX + c.name) for c in components]
            own = (F.col("__bucket") == F.expr(f"`{d}` div {size}")) if grid.extent[axis] > size else F.lit(True)
            df = df.select(*grid.dims, "__bucket", *merged).where(own).drop("__bucket")
            lifted = True
        df = df.where((F.col(d) >= first) & ((F.col(d) - first) % s == 0) & (F.col(d) < first + n * s)).withColumn(d, F.expr(f"(`{d}` - {first}) div {s}"))
    return df


#: Windows of a cell up to which expansion is cheaper: it is combined before its one shuffle,
#: where the others shuffle the cells once for each axis.
FEW_WINDOWS = 32


def windows_of_cell(sizes: Sequence[int], strides: Sequence[int]) -> int:
    """How many windows a cell is in, at most."""
    return prod(-(-w // s) for w, s in zip(sizes, strides, strict=True))


def _single(c: Component, v: Sequence[Column]) -> Column:
    """A component's state of one cell."""
    known = reduce(Column.__and__, [x.isNotNull() for x in v])
    x = v[0].cast("double")
    if c.name == "n":
        return known.cast("long")
    if c.name in ("s", "min", "max"):
        return v[0]
    if c.name == "mean":
        return F.when(known, x)
    if c.name == "mean_y":
        return F.when(known, v[1].cast("double"))
    if c.name in ("m2", "m2_y", "c"):
        return F.when(known, F.lit(0.0))
    if c.name == "has_nan":
        return F.isnan(x)
    if c.name.startswith("p") and c.name[1:].isdigit():
        return reduce(Column.__mul__, [x] * int(c.name[1:]))
    raise ValueError(f"{c.name} has no frames; use the expanded form")


_SPREADS = ("m2", "m2_y", "c")


def _framed(c: Component, frame, lifted: bool, weighted: bool = False) -> Column:  # noqa: ANN001
    s = state_column
    over = lambda e: e.over(frame)
    if c.name in ("mean", "mean_y"):
        if lifted and weighted:
            total = over(F.sum(s("n")))
            return over(F.sum(s(c.name) * s("n"))) / F.when(total > 0, total)
        return over(F.avg(s(c.name)))  # equal counts
    if c.name in _SPREADS:
        p, q = {"m2": ("mean", "mean"), "m2_y": ("mean_y", "mean_y"), "c": ("mean", "mean_y")}[c.name]
        between = over(F.regr_sxx(s(p), s(p))) if p == q else over(F.regr_sxy(s(q), s(p)))
        return over(F.sum(s(c.name))) + over(F.max(s("n"))) * between if lifted else between
    if c.name in ("min", "has_nan", "max"):
        return over(F.max(s(c.name)) if c.name != "min" else F.min(s(c.name)))
    return over(F.sum(s(c.name)))


def framable(grid: Grid, stats: Sequence[Statistic], sizes: Sequence[int] = (), skipna: bool = False) -> bool:
    """Whether frames give the windows: for dense grids and the library's own state.  Spreads of
    unequal counts have no frames, so with skipna they take windows along one axis only."""
    own = grid.dense and all(s.mergeable and all("__" not in c.name for c in s.components()) for s in stats)
    return own and (not skipna or sum(w > 1 for w in sizes) <= 1 or not any(c in _SPREADS for c in minimal_components(stats)))


def window_state(grid: Grid, config: WindowConfig, stats: Sequence[Statistic], origin: Sequence[int] | None = None, skipna: bool = False, same_align: str = "shifted", executor: str = "auto") -> tuple[DataFrame, Factor]:
    """State of the windows that hold a cell, and the number of windows in each dimension."""
    origin = tuple(origin or (0,) * len(grid.dims))
    counts, firsts = [], []
    for n, w, s, o in zip(grid.extent, config.sizes, config.strides, origin, strict=True):
        if config.padding == "valid":
            counts.append(max(0, (n - w - o) // s + 1) if n - w - o >= 0 else 0)
            firsts.append(o)
        else:
            count, first = window_geometry(n, w, s, config.padding, same_align)
            counts.append(count)
            firsts.append(first)
    return placed_windows(grid, counts, config.sizes, config.strides, firsts, stats, skipna, executor), tuple(counts)


def placed_windows(grid: Grid, counts: Sequence[int], sizes: Sequence[int], strides: Sequence[int], firsts: Sequence[int], stats: Sequence[Statistic], skipna: bool = False, executor: str = "auto") -> DataFrame:
    """State of the windows that hold a cell, of so many windows from the first ones' starts.

    ``auto`` takes expansion for windows of few cells' overlap, and two queues for others where they
    give the result; ``frames`` slides a frame for each window."""
    if executor not in ("auto", "queues", "frames", "expand"):
        raise ValueError(f"unknown executor {executor!r}")
    if executor == "queues" and not queueable(grid, stats, sizes):
        raise ValueError("queues take mergeable statistics, of dense grids or along one axis")
    if executor == "queues" or executor == "auto" and windows_of_cell(sizes, strides) > FEW_WINDOWS and queueable(grid, stats, sizes):
        return queued_windows(grid, counts, sizes, strides, firsts, stats, value_columns(grid, skipna), skipna)
    if executor == "frames":
        return framed_windows(grid, counts, sizes, strides, firsts, stats, skipna)
    return expanded_windows(grid, counts, sizes, strides, firsts, stats, skipna)


def rolling_windows(grid_extent: Sequence[int], config: WindowConfig, spark, dims: Sequence[str] | None = None, strict: bool = False, same_align: str = "shifted") -> DataFrame:  # noqa: ANN001
    """Every window: its index, clipped start and stop, and center, for each dimension."""
    validate_window_config(grid_extent, config, strict)
    dims = list(dims or [f"d{k}" for k in range(len(grid_extent))])
    axes = [(d, n, w, s, *window_geometry(n, w, s, config.padding, same_align)) for d, n, w, s in zip(dims, grid_extent, config.sizes, config.strides, strict=True)]
    keys, step = [], 1
    for d, *_, count, _first in reversed(axes):
        keys.insert(0, F.expr(f"id div {step} % {max(count, 1)}").alias(d))
        step *= count
    df = spark.range(step).select(*keys)
    columns = []
    for d, n, w, s, _count, first in axes:
        start = F.col(d) * s + first
        columns += [
            F.col(d),
            F.least(F.greatest(start, F.lit(0)), F.lit(n)).cast("long").alias(f"{d}_start"),
            F.least(F.greatest(start + w, F.lit(0)), F.lit(n)).cast("long").alias(f"{d}_stop"),
            (start + w // 2).cast("long").alias(f"{d}_center"),
        ]
    return df.select(*columns)


def blockwise_windows(grid_extent: Sequence[int], block: Sequence[int], spark, strict: bool = True) -> DataFrame:  # noqa: ANN001
    """Windows that don't overlap."""
    return rolling_windows(grid_extent, WindowConfig(tuple(block)), spark, strict=strict)
