"""Window functions by statistic name, and merges of results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import Median, Statistic, named, nan
from ..plans.lattice import factor_sequence
from ..sources.grid import Grid
from .blocks import coarsen, materialize
from .selection import medians
from .sliding import WindowConfig, rolling_windows, validate_window_config, window_state


def _of(stat: str | Statistic) -> Statistic:
    return named(stat) if isinstance(stat, str) else stat


def window_stat(df: DataFrame, value: str, stat: str, by: Sequence[str] = ()) -> DataFrame:
    """One statistic of all rows, or of each group, skipping NaN.

    Groups may be of any size: medians are selected in rounds (``selection``), and groups of NaN alone have NaN."""
    from .blocks import aggregates

    s = _of(stat)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    if isinstance(s, Median):
        found = medians(df.select(*by, v.alias("__value")), by, "__value", s.name)
        every = df.select(*by, F.lit(0).alias("__one")).groupBy(*by).agg(F.count("__one").alias("__rows"))
        if not by:
            return every.withColumn("__one", F.lit(0)).join(found.withColumn("__one", F.lit(0)), "__one", "left").select(F.coalesce(s.name, nan()).alias(s.name))
        both = every.join(found, reduce(Column.__and__, [every[c].eqNullSafe(found[c]) for c in by]), "left")
        return both.select(*[every[c] for c in by], F.coalesce(found[s.name], nan()).alias(s.name))
    return materialize(df.groupBy(*by).agg(*aggregates(s.components(), [v])), by, [s])


def rolling_stats(grid: Grid, config: WindowConfig, stat: str | Statistic, strict: bool = False, skipna: bool = False, same_align: str = "shifted", boundary: str = "clip") -> DataFrame:
    """A statistic of every window, named ``value``, with the window's index in each dimension.

    Windows without a cell after clipping have NaN, count 0 and sum 0.  boundary="periodic"
    wraps the low end's cells round to windows over the high end."""
    validate_window_config(grid.extent, config, strict)
    s = _of(stat)
    source = grid
    if boundary == "periodic":
        df, extent = grid.df, []
        for d, n, w in zip(grid.dims, grid.extent, config.sizes, strict=True):
            df = df.unionByName(df.where(F.col(d) < w - 1).withColumn(d, F.col(d) + n))
            extent.append(n + w - 1)
        source = replace(grid, df=df, extent=tuple(extent))
    elif boundary != "clip":
        raise ValueError(f"unknown boundary {boundary!r}")
    state, counts = window_state(source, config, [s], None, skipna, same_align)
    values = materialize(state, grid.dims, [s])
    out = values.select(*grid.dims, F.col(s.name).alias("value"))
    if config.padding == "valid" and grid.dense and not skipna or not prod(counts):
        return out
    every = rolling_windows(source.extent, config, grid.df.sparkSession, grid.dims, same_align=same_align).select(*grid.dims)
    return every.join(out, list(grid.dims), "left").select(*grid.dims, F.coalesce("value", F.lit(0) if s.name in ("count", "sum") else nan()).alias("value"))


def blockwise_stats(grid: Grid, block: Sequence[int], stat: str | Statistic, strict: bool = True, skipna: bool = False) -> DataFrame:
    """A statistic of every whole block, named ``value``; var and std by name divide by n."""
    return rolling_stats(grid, WindowConfig(tuple(block)), stat, strict, skipna)


def tiled_stats(grid: Grid, block: Sequence[int], stat: str | Statistic, strict: bool = True) -> DataFrame:
    """Partials of tiles: value and the number of cells; unless ``strict``, cells past the last whole tile are left out."""
    s, n = _of(stat), named("count")
    config = WindowConfig(tuple(block))
    validate_window_config(grid.extent, config, strict)
    state, _ = window_state(grid, config, [s, n] if s.name != "count" else [s])
    out = materialize(state, grid.dims, [s, n] if s.name != "count" else [s])
    return out.select(*grid.dims, F.col(s.name).alias("value"), F.col("count").alias("n"))


def merge_stats(results: Sequence[DataFrame], dims: Sequence[str], method: str = "mean") -> DataFrame:
    """Merges results over the same blocks: the plain mean or sum of ``value``, or ``welford``,
    which merges state (__n, __mean, __m2) weighted by counts."""
    if not results:
        raise ValueError("nothing to merge")
    if method not in ("mean", "sum", "welford"):
        raise ValueError(f"unknown method {method!r}")
    if len(results) == 1:
        return results[0]
    both = reduce(DataFrame.unionByName, results)
    if method == "welford":
        from ..functions.statistics import Var

        return coarsen(both, dims, None, (1,) * len(dims), [Var()])
    return both.groupBy(*dims).agg((F.avg if method == "mean" else F.sum)("value").alias("value"))


def tree_reduce(items: Sequence, combine: Callable, arity: int = 2):  # noqa: ANN001, ANN201
    """Combines items in groups of ``arity`` until one is left; None of none."""
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    items = list(items)
    while len(items) > 1:
        items = [reduce(combine, items[k : k + arity]) for k in range(0, len(items), arity)]
    return items[0] if items else None


def tree_reduce_variance(blocks: Sequence[DataFrame], value: str, by: Sequence[str] = ()) -> DataFrame:
    """The corrected variance over the rows of all blocks."""
    from ..functions.statistics import Var

    rows = reduce(DataFrame.unionByName, blocks)
    from .blocks import aggregates

    v = Var()
    return materialize(rows.groupBy(*by).agg(*aggregates(v.components(), [F.col(value)])), by, [v])


def multiresolution_stats(grid: Grid, factors: Sequence[int], stats: Sequence[str] = ("mean",), use_cache: bool = False) -> dict[int, dict[str, DataFrame]]:
    """{factor: {statistic: frame}} for isotropic factors; var and std by name are corrected here.

    ``use_cache`` persists the scales that others are merged from."""
    from ..api import reduce_stats
    from ..functions.statistics import Mean, Std, Var

    known = {"mean": Mean(), "variance": Var(), "var": Var(), "std": Std()}
    bad = [s for s in stats if s not in known]
    if bad:
        raise ValueError(f"unknown statistics: {', '.join(bad)}")
    wanted = factor_sequence(min(factors), factors)
    result = reduce_stats(grid, wanted, list({known[s].name: known[s] for s in stats}.values()), use_cache=use_cache)
    return {f: {s: result(f, known[s]) for s in stats} for f in wanted}


def moment_variance(mean: Column, mean_square: Column) -> Column:
    return mean_square - mean * mean


def moment_covariance(mean_x: Column, mean_y: Column, mean_xy: Column) -> Column:
    return mean_xy - mean_x * mean_y


def product_mean(grid: Grid, block: Sequence[int]) -> DataFrame:
    """<xy> of each block, in one pass without a column for the products."""
    if grid.arity != 2:
        raise ValueError("a product takes two fields")
    product = Grid(grid.df.select(*grid.dims, (F.col(grid.values[0]).cast("double") * F.col(grid.values[1])).alias("v")), grid.dims, grid.extent, ("v",), grid.dense)
    return blockwise_stats(product, block, "mean", strict=False)


def product_moments(grid: Grid, block: Sequence[int], corrected: bool = True, compat_mean_xy: bool = False) -> DataFrame:
    """Means, variances, covariance and <xy> of each block from one aggregation."""
    from ..functions.statistics import Product
    from .blocks import base_reduce

    stat = Product(corrected, compat_mean_xy)
    return materialize(base_reduce(grid, tuple(block), [stat]), grid.dims, [stat])


