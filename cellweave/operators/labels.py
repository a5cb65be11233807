"""Labelled dimensions: coordinates, metadata, rolling and block statistics by name, resampling."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import Count, Statistic, named, nan
from ..sources.grid import Grid
from .blocks import materialize
from .sliding import WindowConfig, placed_windows, window_geometry


def result_attrs(attrs: dict[str, object], stat: str, config: WindowConfig | None = None) -> dict[str, object]:
    """Attributes of a result: the unit follows the statistic, and the windows are noted."""
    out = dict(attrs)
    if "units" in out:
        if stat.startswith("var"):
            out["units"] = f"({out['units']})^2"
        elif stat == "count":
            out["units"] = "1"
    if config is not None:
        out["window_config"] = {"sizes": list(config.sizes), "strides": list(config.strides), "padding": config.padding}
    return out


def preserve_metadata(grid: Grid, values: DataFrame, stat: str, coords: dict[str, DataFrame] | None = None, config: WindowConfig | None = None, suffix: str = "", extent: Sequence[int] | None = None) -> Grid:
    """``values`` (dims and ``value``) as a grid named <name>_<stat> that keeps attributes, also
    in the column's metadata."""
    name = f"{grid.name}_{stat}{suffix}"
    attrs = result_attrs(grid.attrs, stat, config)
    plain = {k: v for k, v in attrs.items() if isinstance(v, (str, int, float, bool, dict, list))}
    df = values.select(*grid.dims, F.col("value").alias(name, metadata=plain))
    return replace(grid, df=df, values=(name,), name=name, attrs=attrs, coords=coords if coords is not None else grid.coords, extent=tuple(extent or grid.extent))


def center_coordinates(coords: DataFrame, n: int, window: int, stride: int, padding: str = "valid") -> DataFrame:
    """(idx, coord) of the windows of one dimension, from (idx, coord) of its n cells."""
    spark = coords.sparkSession
    count, _ = window_geometry(n, window, stride, padding)
    at = {"valid": F.col("k") * stride + window // 2, "same": F.col("k") * stride, "full": F.col("k") * stride - window // 2}[padding]
    centers = spark.range(count).select(F.col("id").alias("k")).select("k", F.greatest(F.lit(0), F.least(at, F.lit(n - 1))).alias("idx"))
    return centers.join(coords, "idx").select(F.col("k").alias("idx"), "coord")


def block_coordinates(coords: DataFrame, n: int, block: int, how: str = "mean") -> DataFrame:
    """(idx, coord) of whole blocks: the mean of their coordinates, or the one at their center."""
    if how == "center":
        return center_coordinates(coords, n, block, block)
    if how != "mean":
        raise ValueError(f"unknown block coordinate {how!r}")
    whole = coords.where(F.col("idx") < n // block * block)
    return whole.groupBy(F.expr(f"idx div {block}").alias("idx")).agg(F.avg("coord").alias("coord"))


def _sizes(grid: Grid, by_name: dict[str, int]) -> tuple[int, ...]:
    unknown = set(by_name) - set(grid.dims)
    if unknown:
        raise ValueError(f"unknown dimensions: {', '.join(sorted(unknown))}")
    return tuple(by_name.get(d, 1) for d in grid.dims)


def rolling(grid: Grid, window: dict[str, int], stat: str | Statistic, min_periods: int | None = None, center: bool = True) -> Grid:
    """A statistic around every cell, of the grid's own shape; NaN with fewer than min_periods
    cells (a full window, unless given)."""
    s = named(stat) if isinstance(stat, str) else stat
    sizes = _sizes(grid, window)
    full = reduce(int.__mul__, sizes, 1)
    need = full if min_periods is None else min_periods
    # window k stands for cell k: it starts w // 2 before the cell, or w - 1 before it
    before = [w // 2 if center else w - 1 for w in sizes]
    ones = (1,) * len(sizes)
    stats = [s] if s.name == "count" else [s, Count()]
    got = materialize(placed_windows(grid, grid.extent, sizes, ones, [-b for b in before], stats, skipna=True), grid.dims, stats)
    if not grid.dense:  # only windows of cells that exist
        got = grid.df.select(*grid.dims).join(got, list(grid.dims), "left")
    value = F.when(F.col("count") >= need, F.col(s.name)).otherwise(nan() if s.name != "count" else F.lit(None))
    values = got.select(*grid.dims, F.coalesce(value.cast("double"), nan()).alias("value"))
    return preserve_metadata(grid, values, stat if isinstance(stat, str) else s.name, config=WindowConfig(sizes, (1,) * len(sizes)))


def blockwise(grid: Grid, block: dict[str, int], stat: str | Statistic, strict: bool = True, coord: str = "mean") -> Grid:
    """A statistic of blocks along named dimensions; the others stay as they are."""
    from .windows import blockwise_stats

    s = named(stat) if isinstance(stat, str) else stat
    sizes = _sizes(grid, block)
    values = blockwise_stats(grid, sizes, s, strict)
    coords = {d: block_coordinates(grid.coords[d], n, w, coord) if w > 1 else grid.coords[d] for d, n, w in zip(grid.dims, grid.extent, sizes, strict=True) if d in grid.coords}
    return preserve_metadata(grid, values, stat if isinstance(stat, str) else s.name, coords, WindowConfig(sizes), "_blockwise", tuple(n // w for n, w in zip(grid.extent, sizes, strict=True)))


def tree_reduce_labelled(grids: Sequence[Grid], combine: Callable[[Column, Column], Column] | None = None, tolerance: float = 1e-8) -> Grid:
    """Combines grids cell by cell (adds them, unless ``combine`` is given) after checking that
    their coordinates agree; notes how many there were."""
    if not grids:
        raise ValueError("nothing to reduce")
    first = grids[0]
    for g in grids[1:]:
        if g.dims != first.dims or g.extent != first.extent:
            raise ValueError("the grids differ in shape")
        for d in first.coords:
            if d not in g.coords:
                raise ValueError(f"coordinates of {d} are missing")
            both = first.coords[d].join(g.coords[d].withColumnRenamed("coord", "other"), "idx", "full")
            if not both.where(~F.coalesce(F.abs(F.col("coord") - F.col("other")) <= tolerance + 1e-5 * F.abs(F.col("other")), F.lit(False))).isEmpty():
                raise ValueError(f"coordinates of {d} differ")
    own = [g.df.select(*g.dims, F.col(g.values[0]).alias("value")) for g in grids]
    if combine is None:
        values = reduce(DataFrame.unionByName, own).groupBy(*first.dims).agg(F.sum("value").alias("value"))
    else:
        values = own[0]
        for other in own[1:]:
            values = values.join(other.withColumnRenamed("value", "__b"), list(first.dims)).select(*first.dims, combine(F.col("value"), F.col("__b")).alias("value"))
    out = preserve_metadata(first, values, "tree")
    return replace(out, attrs={**out.attrs, "tree_reduced_from": len(grids)})


_UNITS = {"s": 1, "min": 60, "t": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds_of(freq: str) -> int:
    """Seconds of a frequency such as 6h, 15min or D."""
    m = re.fullmatch(r"\s*(\d*)\s*(s|min|t|h|d|w)\s*", freq.lower())
    if not m or m[1] == "0":
        raise ValueError(f"unknown frequency {freq!r}")
    return int(m[1] or 1) * _UNITS[m[2]]


#: Months of calendar frequencies, and whether bins are named after their first or last day.
_CALENDAR = {"ms": (1, "start"), "qs": (3, "start"), "ys": (12, "start"), "m": (1, "end"), "me": (1, "end"), "q": (3, "end"), "qe": (3, "end"), "y": (12, "end"), "ye": (12, "end")}


def calendar_of(freq: str) -> tuple[int, str] | None:
    """(months, start or end) of a calendar frequency such as 1M, 2QE or QS; None of any other."""
    m = re.fullmatch(r"\s*(\d*)\s*(ms|qs|ys|me|qe|ye|m|q|y)\s*", freq.lower())
    if not m or m[1] == "0":
        return None
    months, label = _CALENDAR[m[2]]
    return months * int(m[1] or 1), label


def _binned(df: DataFrame, time: str, freq: str) -> tuple[DataFrame, Callable[[Column], Column], int]:
    """The rows with their bin's number, from a bin's number its time, and the step between bins."""
    known = df.where(F.col(time).isNotNull())
    calendar = calendar_of(freq)
    if calendar is None and re.fullmatch(r"\s*1?\s*w\s*", freq.lower()):
        # weeks end on Sunday, whose day names them; day 3 after the epoch is a Sunday
        day = F.unix_date(F.col(time).cast("date"))
        return known.withColumn("__bin", (F.floor((day + 3) / 7)).cast("long")), lambda k: F.date_from_unix_date((k * 7 + 3).cast("int")).cast("timestamp"), 1
    if calendar is None:
        size = seconds_of(freq)
        second = F.unix_timestamp(F.date_trunc("second", F.col(time)))
        return known.withColumn("__bin", (F.floor(second / size) * size).cast("long")), F.timestamp_seconds, size
    months, label = calendar
    month = (F.year(time) * 12 + F.month(time) - 1).cast("long")
    first = lambda k: F.make_date((F.floor(k / 12)).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1))
    unit = 12 if re.search(r"y[es]?\s*$", freq.lower()) else 3 if re.search(r"q[es]?\s*$", freq.lower()) else 1
    if label == "end" and months == unit:
        return known.withColumn("__bin", (F.floor(month / months) * months).cast("long")), lambda k: F.last_day(F.add_months(first(k), months - 1)).cast("timestamp"), months
    if months % 3 == 0 and months in (3, 12) or months == 1:
        return known.withColumn("__bin", (F.floor(month / months) * months).cast("long")), lambda k: first(k).cast("timestamp"), months
    # several periods are counted from the first row's: it begins the first bin, or ends it where bins are named after their end
    origin = known.agg(F.min(F.floor(month / unit) * unit).cast("long").alias("__origin"))
    away = F.floor(month / unit) * unit - F.col("__origin")
    number = F.ceil(away / months) if label == "end" else F.floor(away / months)
    named = (lambda k: F.last_day(F.add_months(first(k), unit - 1)).cast("timestamp")) if label == "end" else (lambda k: first(k).cast("timestamp"))
    return known.crossJoin(F.broadcast(origin)).withColumn("__bin", (number * months + F.col("__origin")).cast("long")).drop("__origin"), named, months


def resample(df: DataFrame, time: str, value: str, freq: str, stat: str | Statistic, empty: bool = True) -> DataFrame:
    """(bin, value) of time bins.  Those of seconds to days are closed and named at their start and
    counted from midnight of the first day if they divide a day, else from the epoch.  Weeks run from
    Monday to Sunday and are named after the Sunday.  M, Q and Y (with or without E) are named after
    their last day, MS, QS and YS after the first; several of them (2ME, 2QS) are counted from the first row's.  Empty bins between the first and the last have NaN
    (count 0, sum 0)."""
    s = named(stat) if isinstance(stat, str) else stat
    placed, named_at, step = _binned(df, time, freq)
    rows = placed.select("__bin", F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("__v"))
    binned = materialize(rows.groupBy("__bin").agg(*[c.lift([F.col("__v")]).alias("__" + c.name) for c in s.components()]), ["__bin"], [s])
    none = F.lit(0) if s.name in ("count", "sum") else nan()
    if empty:
        ends = rows.agg(F.min("__bin").alias("a"), F.max("__bin").alias("b")).where("a IS NOT NULL")
        every = ends.select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("__bin"))
        binned = every.join(binned, "__bin", "left")
    return binned.select(named_at(F.col("__bin")).alias("bin"), F.coalesce(F.col(s.name), none).alias("value"))


def window_coordinates(grid: Grid, values: DataFrame, config: WindowConfig) -> DataFrame:
    """``values`` with <dim>_window_start, _center and _end: the coordinates of a window's first,
    middle and last cell, clamped to the grid."""
    out = values
    for d, n, w, s in zip(grid.dims, grid.extent, config.sizes, config.strides, strict=True):
        _, first = window_geometry(n, w, s, config.padding)
        coords = grid.coords.get(d)
        for name, shift in (("start", 0), ("center", w // 2), ("end", w - 1)):
            at = F.greatest(F.lit(0), F.least(F.col(d) * s + (first + shift), F.lit(n - 1)))
            column = f"{d}_window_{name}"
            if coords is None:
                out = out.withColumn(column, at.cast("double"))
            else:
                out = out.withColumn("__at", at).join(coords.select(F.col("idx").alias("__at"), F.col("coord").alias(column)), "__at").drop("__at")
    return out
