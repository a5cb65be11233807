"""Merges of state rows that meet in one block.

Counts, sums, extremes and users' aggregates merge as one partial and one final aggregation.  Spreads of
unequal counts have no built-in aggregate; they are merged exactly and in fixed memory by the binary digits of
the counts: a row of n cells counts as one row for each digit 1 of n, weighted by the digit's power of two.  Rows
of one digit weigh the same, so their spread is the built-in one, combined before the shuffle.  A
block has 63 digits at most, and the sum of products of deviations of all of them is

    sum of the rows' own + sum over digits of 2**digit * (spread in the digit + rows * (mean of the digit - mean)**2)

in which nothing is subtracted but means, so there is no cancellation, whatever the offset.

States that merge only two at a time are folded by position, in rounds that halve the widest dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import ANY, EQUAL, SPREADS, Component
from ..plans.lattice import Factor

PREFIX = "__"
_DIGIT = "__digit"


def state_column(name: str) -> Column:
    return F.col(PREFIX + name)


def merged(rows: DataFrame, keys: Sequence[str], components: dict[str, Component], equal: bool = False) -> DataFrame:
    """One state row for each key, of state rows keyed by ``keys``.  equal: all hold equally many cells.

    A frame partitioned by some of the keys is merged without a shuffle."""
    how = EQUAL if equal else ANY
    if equal or not any(c in SPREADS for c in components):
        return rows.groupBy(*keys).agg(*[c.merge(state_column, how).alias(PREFIX + name) for name, c in components.items()])
    means = [m for m in ("mean", "mean_y") if m in components]
    spreads = [s for s in SPREADS if s in components]
    whole = [n for n in components if n not in means and n not in spreads]
    n = F.coalesce(state_column("n"), F.lit(0)).cast("long")
    digits = F.filter(F.sequence(F.lit(0), F.when(n > 0, F.floor(F.log2(n.cast("double"))).cast("int") + 1).otherwise(0)), lambda b: F.getbit(n, b) == 1)
    # digit -1 carries what needs no weight, the others the means
    dealt = rows.withColumn(_DIGIT, F.explode(F.concat(F.array(F.lit(-1)), digits)))
    weighted = F.col(_DIGIT) >= 0
    dealt = dealt.select(*keys, _DIGIT, *[F.when(weighted, state_column(m)).alias(PREFIX + m) for m in means], *[F.when(~weighted, state_column(c)).alias(PREFIX + c) for c in (*whole, *spreads)])
    between = {s: F.regr_sxx(state_column(a), state_column(a)) if a == b else F.regr_sxy(state_column(b), state_column(a)) for s, (a, b) in SPREADS.items() if s in spreads}
    by_digit = dealt.groupBy(*keys, _DIGIT).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.avg(state_column(m)).alias(PREFIX + m) for m in means],
        *[e.alias(f"__between_{s}") for s, e in between.items()],
        *[F.sum(state_column(s)).alias(PREFIX + s) for s in spreads],
        *[components[c].merge(state_column, how).alias(PREFIX + c) for c in whole],
    )
    only = lambda c: F.first(F.when(F.col(_DIGIT) < 0, F.col(c)), ignorenulls=True).alias(c)
    weight = F.pow(F.lit(2.0), F.col(_DIGIT))
    parts = F.struct((weight * F.col("__rows")).alias("cells"), weight.alias("weight"), *[state_column(m).alias(m) for m in means], *[F.coalesce(F.col(f"__between_{s}"), F.lit(0.0)).alias(s) for s in spreads])
    collected = by_digit.groupBy(*keys).agg(*[only(PREFIX + c) for c in (*whole, *spreads)], F.collect_list(F.when(F.col(_DIGIT) >= 0, parts)).alias("__parts"))
    total = F.aggregate("__parts", F.lit(0.0), lambda x, p: x + p["cells"])
    out = collected.withColumn("__cells", F.when(total > 0, total))
    some = F.size("__parts") > 0

    def summed(term: Callable[[Column], Column]) -> Column:
        return F.when(some, F.aggregate("__parts", F.lit(0.0), lambda x, p: x + term(p)))

    def mean(m: str) -> Column:
        base = F.get("__parts", F.lit(0))[m]  # about the first digit's, so that large offsets don't round
        return base + summed(lambda p: p["cells"] * (p[m] - base)) / F.col("__cells")

    def spread(s: str) -> Column:
        a, b = SPREADS[s]
        return state_column(s) + F.coalesce(summed(lambda p: p["weight"] * p[s] + p["cells"] * (p[a] - state_column(a)) * (p[b] - state_column(b))), F.lit(0.0))

    out = out.withColumns({PREFIX + m: mean(m) for m in means})
    out = out.withColumns({PREFIX + s: spread(s) for s in spreads})
    return out.select(*keys, *[PREFIX + c for c in components])


def folded(rows: DataFrame, dims: Sequence[str], window: Factor, components: dict[str, Component]) -> DataFrame:
    """States that merge two at a time, by position: rounds of neighbours along the widest dimension.

    All cells of a coarse block are brought together once; the rounds, as many as the window has
    binary digits, need no further shuffle, and each merges two states in a row."""
    at = [f"__at{k}" for k in range(len(dims))]
    names = list(components)
    local = rows.select(*[F.expr(f"`{d}` div {w}").alias(d) for d, w in zip(dims, window, strict=True)], *[F.expr(f"`{d}` % {w}").alias(p) for d, w, p in zip(dims, window, at, strict=True)], *[PREFIX + c for c in names])
    local = local.repartition(*dims).groupBy(*dims, *at).agg(*[components[c].merge(state_column, ANY).alias(PREFIX + c) for c in names])
    sizes = list(window)
    while max(sizes) > 1:
        axis = sizes.index(max(sizes))
        p = at[axis]
        side = F.expr(f"`{p}` % 2")
        halves = [F.first(F.when(side == k, state_column(c)), ignorenulls=True).alias(f"__{'ab'[k]}_{c}") for c in names for k in (0, 1)]
        halved = local.groupBy(*dims, *[F.expr(f"`{q}` div 2").alias(q) if q == p else F.col(q) for q in at]).agg(*halves)
        a, b = (lambda c, k=k: F.col(f"__{k}_{c}") for k in "ab")
        local = halved.select(*dims, *at, *[F.when(a(c).isNull(), b(c)).when(b(c).isNull(), a(c)).otherwise(components[c].both(a(c), b(c))).alias(PREFIX + c) for c in names])
        sizes[axis] = -(-sizes[axis] // 2)
    return local.select(*dims, *[PREFIX + c for c in names])
