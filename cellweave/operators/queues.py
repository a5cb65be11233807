"""Overlapping windows in time that doesn't depend on their size.

Along one axis a line is cut into blocks as long as the window.  A window that starts inside a block is what
is left of that block and the beginning of the next one.  So every cell gets the state of its block up to it and
from it on, by frames that only grow, which Spark updates row by row; a window merges two of these.

Lines are cut into buckets of many blocks, and the first block of the next bucket comes along, so that no
line, however long, is one task.  Cells are shuffled once for each axis, by line and bucket; the frames and the
merge of the two states use the same partitioning.  After the first axis the rows are windows, merged along
the next one.  Windows hang over the ends, or miss cells, wherever the grid does: a cell stands for all window starts since the
cell before it.

Counts may differ (NaN left out, windows over an end, sparse lines): spreads then go by the binary digits of the counts, as in ``merging``.
Users' statistics, of which only the merge is known, are doubled instead: windows of 1, 2, 4, ... cells, of which those in the
binary expansion of the size are put together in order, so that a merge need not commute along a line; their rounds are made in
partitions of a bounded number of buckets, however many cells there are.  Their merges have to pass over missing states.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import ANY, PAIR, SPREADS, Component, Statistic, minimal_components
from ..sources.grid import Grid
from .merging import PREFIX, state_column

#: Cells of a bucket, at least; it has eight blocks at least, so what comes along is an eighth at most.
BUCKET_CELLS = 8_192
#: Cells of a partition of users' states, whose rounds hold them in memory: 16 buckets.
PARTITION_CELLS = 131_072


def bucket_length(window: int) -> int:
    """Cells of a bucket: a multiple of the window."""
    return window * max(8, -(-BUCKET_CELLS // window))


def queueable(grid: Grid, stats: Sequence[Statistic], sizes: Sequence[int]) -> bool:
    """Whether queues give the windows: for mergeable statistics, on dense grids or along one axis."""
    return all(s.mergeable for s in stats) and (grid.dense or sum(w > 1 for w in sizes) <= 1)


def queued_windows(grid: Grid, counts: Sequence[int], sizes: Sequence[int], strides: Sequence[int], firsts: Sequence[int], stats: Sequence[Statistic], values: Sequence[Column], skipna: bool = False) -> DataFrame:
    """State of every window that holds a cell."""
    components = minimal_components(stats)
    users = {n: c for n, c in components.items() if "__" in n}
    library = {n: c for n, c in components.items() if "__" not in n}
    cells = grid.df.select(*grid.dims, *[v.alias(f"__value{k}") for k, v in enumerate(values)])
    lifted = [F.col(f"__value{k}") for k in range(len(values))]
    even = grid.dense and not skipna
    out = None
    for own in (library, users):
        if not own:
            continue
        rows, most = cells, 0  # most: cells of a row, 0 while rows are cells
        total = 0 if own is library else prod(grid.extent) if grid.dense else cells.count()
        for d, n, w, s, first in zip(grid.dims, counts, sizes, strides, firsts, strict=True):
            if w == 1:
                rows = _started(rows, d, n, s, first)
            elif own is library:
                rows = _queued(rows, grid.dims, d, n, w, s, first, own, None if most else lifted, 0 if even else most.bit_length())
            else:
                rows = _doubled(rows, grid.dims, d, n, w, s, first, own, None if most else lifted, total)
            most = max(most, 1) * w if w > 1 else most
        if not most:
            rows = rows.groupBy(*grid.dims).agg(*[c.lift(lifted).alias(PREFIX + name) for name, c in own.items()])
        out = rows if out is None else out.join(rows, list(grid.dims))
    return out.select(*grid.dims, *[PREFIX + c for c in components])


def _started(rows: DataFrame, d: str, n: int, s: int, first: int) -> DataFrame:
    """Along an axis of windows of one cell: the cells at which one starts."""
    at = F.col(d) - first
    return rows.where((at >= 0) & (at % s == 0) & (at < n * s)).withColumn(d, F.expr(f"(`{d}` - {first}) div {s}"))


def _bucketed(rows: DataFrame, dims: Sequence[str], d: str, n: int, w: int, s: int, first: int, total: int = 0) -> tuple[DataFrame, list[str]]:
    """Cells that windows hold, at their distance from the first window's start, beside the next bucket's first block.

    ``total``: the number of all cells, by which partitions are bounded; 0 where their size is Spark's affair."""
    size = bucket_length(w)
    at = F.col(d) - first
    rows = rows.where((at >= 0) & (at < (n - 1) * s + w)).withColumn("__e", at)
    bucket = F.expr(f"__e div {size}")
    along = (F.col("__e") % size < w) & (bucket > 0)
    rows = rows.withColumn("__bucket", F.explode(F.when(along, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))))
    others = [o for o in dims if o != d]
    parts = -(-total // PARTITION_CELLS)
    if parts > 1:  # a number given is not made smaller by adaptive execution
        return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *others, "__bucket"), others
    return rows.repartition(*others, "__bucket"), others


def _queued(rows: DataFrame, dims: Sequence[str], d: str, n: int, w: int, s: int, first: int, components: dict[str, Component], values: Sequence[Column] | None, digits: int) -> DataFrame:
    """One axis.  values: of cells, or None if rows hold state; digits: of the rows' counts, 0 if all are equal."""
    rows, others = _bucketed(rows, dims, d, n, w, s, first)
    rows = rows.withColumn("__block", F.expr(f"__e div {w}"))
    line = Window.partitionBy(*others, "__bucket", "__block")
    grow = (Window.unboundedPreceding, Window.currentRow)
    ahead, back = line.orderBy("__e"), line.orderBy(F.desc("__e"))

    framed: dict[str, Column] = {}  # what frames give, each once
    finished: list[dict[str, Column]] = []
    for side, frame in (("p", ahead.rangeBetween(*grow)), ("s", back.rangeBetween(*grow))):
        if values is not None or not digits:
            framed |= {f"__{side}_{name}": (c.lift(values).over(frame) if values is not None else _even(name, c, frame)) for name, c in components.items()}
        else:
            parts, means, spreads = _weighted(components, side, frame, digits)
            framed |= parts
            finished += [means, spreads]
    rows = rows.select(*others, "__bucket", "__block", "__e", F.lag("__e").over(ahead).alias("__before"), F.lead("__e").over(ahead).alias("__after"), *[e.alias(k) for k, e in framed.items()])
    for columns in finished:
        rows = rows.withColumns(columns)
    # windows that start at this cell, or at places without one before it in the block
    block = F.col("__block") * w
    since = F.coalesce(F.col("__before") + 1, block)
    until = F.coalesce(F.col("__after") - 1, block + w - 1) - (w - 1)  # the last start of a window that ends before the next cell
    size = bucket_length(w)
    own = F.expr(f"__e div {size}") == F.col("__bucket")
    starts = _multiples(F.greatest(since, F.lit(0)), F.least(F.col("__e"), F.lit((n - 1) * s)), s)
    # ends inside this block: the window starts in the block before it, in the same bucket
    ends = _multiples(F.greatest(F.col("__e") - (w - 1), block - (w - 1), F.col("__bucket") * size, F.lit(0)), F.least(until, block - 1, F.lit((n - 1) * s)), s)
    part = lambda side, k: F.transform(k, lambda x: F.struct(x.alias("k"), *[F.col(f"__{side}_{c}").alias(c) for c in components]))
    none = F.array().cast("array<bigint>")
    met = F.concat(part("s", F.when(own & (F.col("__e") != F.coalesce("__before", F.lit(-1))), starts).otherwise(none)), part("p", F.when(F.col("__e") != F.coalesce("__after", F.lit(-1)), ends).otherwise(none)))
    halves = rows.select(*others, "__bucket", F.explode(met).alias("__half")).select(*others, "__bucket", F.col("__half.k").alias(d), *[F.col(f"__half.{c}").alias(PREFIX + c) for c in components])
    merged = halves.groupBy(*others, "__bucket", d).agg(*[c.merge(state_column, PAIR).alias(PREFIX + name) for name, c in components.items()])
    return merged.select(*dims, *[PREFIX + c for c in components])


def _multiples(low: Column, high: Column, s: int) -> Column:
    """The k with low <= k s <= high; 0 <= low."""
    a, b = F.ceil(low / s).cast("long"), F.floor(high / s).cast("long")
    return F.when(a <= b, F.sequence(a, F.greatest(a, b), F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _even(name: str, c: Component, frame) -> Column:  # noqa: ANN001
    """Merged state over a frame of rows that hold equally many cells."""
    s = state_column
    if name in ("mean", "mean_y"):
        return F.avg(s(name)).over(frame)
    if name in SPREADS:
        a, b = SPREADS[name]
        between = F.regr_sxx(s(a), s(a)) if a == b else F.regr_sxy(s(b), s(a))
        return F.sum(s(name)).over(frame) + F.max(s("n")).over(frame) * F.coalesce(between.over(frame), F.lit(0.0))
    return c.merge(s, ANY).over(frame)


def _weighted(components: dict[str, Component], side: str, frame, digits: int) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:  # noqa: ANN001
    """The same for counts of so many binary digits, whose rows weigh the same: what frames give, and
    from it the means and the spreads."""
    s, at = state_column, lambda name: f"__{side}_{name}"
    means = [m for m in ("mean", "mean_y") if m in components]
    own = [c for c in SPREADS if c in components]
    parts = {at(name): _even(name, c, frame) for name, c in components.items() if name not in means and name not in own}
    parts |= {at(f"{c}_sum"): F.sum(s(c)).over(frame) for c in own}
    for b in range(digits if means else 0):
        has = F.getbit(s("n").cast("long"), F.lit(b)) == 1
        parts[at(f"cells_{b}")] = F.count(F.when(has, F.lit(1))).over(frame) * float(1 << b)
        parts |= {at(f"{m}_{b}"): F.coalesce(F.avg(F.when(has, s(m))).over(frame), F.lit(0.0)) for m in means}
        for c in own:
            u, v = (F.when(has, s(m)) for m in SPREADS[c])
            between = F.regr_sxx(u, u) if len(set(SPREADS[c])) == 1 else F.regr_sxy(v, u)
            parts[at(f"{c}_{b}")] = F.coalesce(between.over(frame), F.lit(0.0)) * float(1 << b)

    def added(terms: Sequence[Column]) -> Column:
        return reduce(Column.__add__, terms)

    total = added([F.col(at(f"cells_{b}")) for b in range(digits)]) if means else None
    mean = {at(m): added([F.col(at(f"cells_{b}")) * F.col(at(f"{m}_{b}")) for b in range(digits)]) / F.when(total > 0, total) for m in means}

    def off(m: str, b: int) -> Column:
        return F.col(at(f"{m}_{b}")) - F.col(at(m))

    spread = {at(c): F.col(at(f"{c}_sum")) + added([F.col(at(f"{c}_{b}")) + F.coalesce(F.col(at(f"cells_{b}")) * off(SPREADS[c][0], b) * off(SPREADS[c][1], b), F.lit(0.0)) for b in range(digits)]) for c in own}
    return parts, mean, spread


def _doubled(rows: DataFrame, dims: Sequence[str], d: str, n: int, w: int, s: int, first: int, components: dict[str, Component], values: Sequence[Column] | None, total: int) -> DataFrame:
    """One axis, for users' states.  A round doubles the windows that begin at each place, and puts
    the doubled one behind what is together so far where the size has that binary digit."""
    rows, others = _bucketed(rows, dims, d, n, w, s, first, total)
    keys, size = [*others, "__bucket", "__e"], bucket_length(w)
    lifted = {f"__t_{c}": x.lift(values) if values is not None else F.first(PREFIX + c) for c, x in components.items()}
    rows = rows.groupBy(*keys).agg(*[e.alias(c) for c, e in lifted.items()], F.lit(True).alias("__t"))
    rows = rows.select("*", *[F.lit(None).cast(rows.schema[f"__t_{c}"].dataType).alias(f"__a_{c}") for c in components], F.lit(None).cast("boolean").alias("__a"))

    def row(at: Column, side: int, together: str | None, doubled: str | None) -> Column:
        own = {"t": doubled, "a": together}
        states = [(F.col(f"__{own[x]}_{c}") if own[x] else F.lit(None).cast(rows.schema[f"__t_{c}"].dataType)).alias(f"__{x}_{c}") for x in "ta" for c in components]
        return F.struct(at.alias("__e"), F.lit(side).alias("__side"), *states, *[(F.col(f"__{own[x]}") if own[x] else F.lit(None).cast("boolean")).alias(f"__{x}") for x in "ta"])

    def joined(x: str, c: str, component: Component) -> list[Column]:
        name = f"__{x}_{c}"
        if component.both is None:
            return [component.merge(lambda _, name=name: F.col(name), PAIR).alias(name)]
        return [F.first(F.when(F.col("__side") == k, F.col(name)), ignorenulls=True).alias(f"{name}__{k}") for k in (0, 1)]

    together, power = 0, 1
    while power <= w:
        parts = [row(F.col("__e"), 0, "a", "t")]
        if w & power:
            parts.append(row(F.col("__e") - together, 1, "t", None))
            together += power
        if power * 2 <= w:
            parts.append(row(F.col("__e") - power, 1, None, "t"))
        dealt = rows.select(*others, "__bucket", F.explode(F.array(*parts)).alias("__x")).select(*others, "__bucket", "__x.*").where(F.col("__e") >= F.greatest(F.col("__bucket") * size, F.lit(0)))
        rows = dealt.groupBy(*keys).agg(*[e for x in "ta" for c, k in components.items() for e in joined(x, c, k)], *[F.max(f"__{x}").alias(f"__{x}") for x in "ta"])
        pairs = {f"__{x}_{c}": (F.col(f"__{x}_{c}__0"), F.col(f"__{x}_{c}__1"), k) for x in "ta" for c, k in components.items() if k.both is not None}
        rows = rows.select(*keys, "__t", "__a", *[f"__{x}_{c}" for x in "ta" for c, k in components.items() if k.both is None], *[F.when(u.isNull(), v).when(v.isNull(), u).otherwise(k.both(u, v)).alias(name) for name, (u, v, k) in pairs.items()])
        power *= 2
    own = (F.expr(f"__e div {size}") == F.col("__bucket")) & (F.col("__e") % s == 0) & (F.col("__e") <= (n - 1) * s) & F.coalesce(F.col("__a"), F.lit(False))
    return rows.where(own).withColumn(d, F.expr(f"__e div {s}")).select(*dims, *[F.col(f"__a_{c}").alias(PREFIX + c) for c in components])
