"""Statistics over mergeable state.

A statistic names the state components it needs.  Each component knows how to aggregate cells
(``lift``), how to aggregate state rows of finer blocks (``merge``), and statistics turn
components into values (``result``).  Statistics share components, so asking for mean,
variance and standard deviation keeps one count, one mean and one sum of squared deviations.

Rules of type: sums and moments accumulate in DOUBLE; count is BIGINT; min and max keep the
input's type; other results are FLOAT for FLOAT input and DOUBLE otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")

#: What is known of the state rows that are merged: all hold equally many cells, there are two at most, or nothing.
EQUAL, PAIR, ANY = "equal", "pair", "any"


def nan() -> Column:
    return F.lit(NAN)


@dataclass(frozen=True)
class Component:
    """A column of state.  ``lift(values)`` and ``merge(state)`` are aggregate expressions;
    state maps component names to columns of finer rows.  ``both`` merges two states in order, where
    only that is known."""

    name: str
    lift: Callable[[Sequence[Column]], Column]
    merge: Callable[[Callable[[str], Column], str], Column]
    needs: tuple[str, ...] = ()
    both: Callable[[Column, Column], Column] | None = None


#: Components that are sums of products of deviations, with the means they are about.
SPREADS = {"m2": ("mean", "mean"), "m2_y": ("mean_y", "mean_y"), "c": ("mean", "mean_y")}


def _known(values: Sequence[Column]) -> Column:
    ok = values[0].isNotNull()
    for v in values[1:]:
        ok = ok & v.isNotNull()
    return ok


def _only(values: Sequence[Column], k: int) -> Column:
    """Value k where all values are known."""
    v = values[k].cast("double")
    return v if len(values) == 1 else F.when(_known(values), v)


def _merged_spread(state: Callable[[str], Column], how: str, n: str, a: str, b: str, m: str) -> Column:
    """Sum of products of deviations of merged rows: that of the parts and that between their means.

    ``EQUAL`` counts: n times that of the means.  ``PAIR``: of at most two rows, whose means differ by
    twice what the two deviate from their middle.  Any other rows are merged by the binary digits of
    their counts (``operators.merging``), as equal counts digit by digit."""
    between = F.coalesce(F.regr_sxx(state(a), state(a)) if a == b else F.regr_sxy(state(b), state(a)), F.lit(0.0))
    if how == EQUAL:
        return F.sum(state(m)) + F.coalesce(F.first(state(n), True).cast("double"), F.lit(0.0)) * between
    if how != PAIR:
        raise ValueError(f"{m} of unequal counts isn't merged by one aggregate")
    total = F.sum(state(n)).cast("double")
    return F.sum(state(m)) + F.coalesce(2.0 * between * F.min(state(n)).cast("double") * F.max(state(n)) / F.when(total > 0, total), F.lit(0.0))


def _merged_mean(state: Callable[[str], Column], n: str, mean: str) -> Column:
    total = F.sum(state(n))
    return F.sum(state(mean) * state(n)) / F.when(total > 0, total)


def _nan_aware(pick: Callable[[Column], Column], v: Column, floating: bool) -> Column:
    return F.when(F.max(F.isnan(v)), nan().cast("double")).otherwise(pick(v)) if floating else pick(v)


_COUNT = Component("n", lambda v: F.count(F.when(_known(v), F.lit(1))), lambda s, _: F.sum(s("n")))
_SUM = Component("s", lambda v: F.sum(v[0]), lambda s, _: F.sum(s("s")))
_MEAN = Component("mean", lambda v: F.avg(_only(v, 0)), lambda s, _: _merged_mean(s, "n", "mean"), ("n",))
_M2 = Component("m2", lambda v: F.regr_sxx(_only(v, 0), _only(v, 0)), lambda s, e: _merged_spread(s, e, "n", "mean", "mean", "m2"), ("n", "mean"))
_MEAN_Y = Component("mean_y", lambda v: F.avg(_only(v, 1)), lambda s, _: _merged_mean(s, "n", "mean_y"), ("n",))
_M2_Y = Component("m2_y", lambda v: F.regr_sxx(_only(v, 1), _only(v, 1)), lambda s, e: _merged_spread(s, e, "n", "mean_y", "mean_y", "m2_y"), ("n", "mean_y"))
_C = Component("c", lambda v: F.regr_sxy(v[1].cast("double"), v[0].cast("double")), lambda s, e: _merged_spread(s, e, "n", "mean", "mean_y", "c"), ("n", "mean", "mean_y"))
_MIN = Component("min", lambda v: F.min(v[0]), lambda s, _: F.min(s("min")))
_MAX = Component("max", lambda v: F.max(v[0]), lambda s, _: F.max(s("max")))
_HAS_NAN = Component("has_nan", lambda v: F.max(F.isnan(v[0].cast("double"))), lambda s, _: F.max(s("has_nan")))


def _power(k: int) -> Component:
    def lift(v: Sequence[Column]) -> Column:
        x = v[0].cast("double")
        term = x
        for _ in range(k - 1):
            term = term * x
        return F.sum(term)

    return Component(f"p{k}", lift, lambda s, _: F.sum(s(f"p{k}")))


COMPONENTS = {c.name: c for c in (_COUNT, _SUM, _MEAN, _M2, _MEAN_Y, _M2_Y, _C, _MIN, _MAX, _HAS_NAN)}


class Statistic:
    """What is asked for: a name, the number of fields it takes, its components and its value."""

    name: str = ""
    arity: int = 1
    mergeable: bool = True
    narrows: bool = True  # FLOAT input gives a FLOAT result
    invertible: bool = False

    def components(self) -> tuple[Component, ...]:
        raise NotImplementedError

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        raise NotImplementedError

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.name})"


def _closed(components: Sequence[Component]) -> tuple[Component, ...]:
    found: dict[str, Component] = {}

    def add(c: Component) -> None:
        for need in c.needs:
            add(COMPONENTS[need])
        found.setdefault(c.name, c)

    for c in components:
        add(c)
    return tuple(found.values())


@dataclass(frozen=True, repr=False)
class Count(Statistic):
    name: str = "count"
    narrows = False
    invertible = True

    def components(self) -> tuple[Component, ...]:
        return (_COUNT,)

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: state("n").cast("long")}


@dataclass(frozen=True, repr=False)
class Sum(Statistic):
    name: str = "sum"
    invertible = True

    def components(self) -> tuple[Component, ...]:
        return (_SUM,)

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: F.coalesce(state("s"), F.lit(0))}


@dataclass(frozen=True, repr=False)
class Mean(Statistic):
    name: str = "mean"
    invertible = True

    def components(self) -> tuple[Component, ...]:
        return _closed([_MEAN])

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: F.coalesce(state("mean"), nan())}


def spread(m2: Column, n: Column, corrected: bool) -> Column:
    """Variance or covariance from the sum of products; NaN where the divisor would be 0."""
    d = n.cast("double") - (1.0 if corrected else 0.0)
    return F.when(d > 0, m2 / F.when(d > 0, d)).otherwise(nan())


@dataclass(frozen=True, repr=False)
class Var(Statistic):
    corrected: bool = True
    invertible = True

    @property
    def name(self) -> str:  # type: ignore[override]
        return "var" if self.corrected else "var_pop"

    def components(self) -> tuple[Component, ...]:
        return _closed([_M2])

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: spread(state("m2"), state("n"), self.corrected)}


@dataclass(frozen=True, repr=False)
class Std(Var):
    @property
    def name(self) -> str:  # type: ignore[override]
        return "std" if self.corrected else "std_pop"

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: F.sqrt(spread(state("m2"), state("n"), self.corrected))}


@dataclass(frozen=True, repr=False)
class Cov(Statistic):
    corrected: bool = True
    arity = 2
    invertible = True

    @property
    def name(self) -> str:  # type: ignore[override]
        return "cov" if self.corrected else "cov_pop"

    def components(self) -> tuple[Component, ...]:
        return _closed([_C])

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: spread(state("c"), state("n"), self.corrected)}


@dataclass(frozen=True, repr=False)
class Product(Statistic):
    """All joint moments of two fields in one pass."""

    corrected: bool = True
    biased_mean_xy: bool = False
    name: str = "product"
    arity = 2

    def components(self) -> tuple[Component, ...]:
        return _closed([_C, _M2, _M2_Y])

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        cov = spread(state("c"), state("n"), self.corrected)
        shift = cov if self.biased_mean_xy else spread(state("c"), state("n"), False)
        return {
            "mean_x": F.coalesce(state("mean"), nan()),
            "mean_y": F.coalesce(state("mean_y"), nan()),
            "mean_xy": state("mean") * state("mean_y") + shift,
            "var_x": spread(state("m2"), state("n"), self.corrected),
            "var_y": spread(state("m2_y"), state("n"), self.corrected),
            "cov_xy": cov,
        }


@dataclass(frozen=True, repr=False)
class Min(Statistic):
    name: str = "min"
    narrows = False

    def components(self) -> tuple[Component, ...]:
        return (_MIN, _HAS_NAN)

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: F.when(state("has_nan"), nan()).otherwise(state(self.name))}


@dataclass(frozen=True, repr=False)
class Max(Min):
    name: str = "max"

    def components(self) -> tuple[Component, ...]:
        return (_MAX, _HAS_NAN)


@dataclass(frozen=True, repr=False)
class Moments(Statistic):
    """Raw moments E[x^k], k = 1 to order."""

    order: int = 4
    invertible = True

    @property
    def name(self) -> str:  # type: ignore[override]
        return f"moments{self.order}"

    def components(self) -> tuple[Component, ...]:
        return (_COUNT, *(_power(k) for k in range(1, self.order + 1)))

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        n = F.when(state("n") > 0, state("n"))
        return {f"m{k}": F.coalesce(state(f"p{k}") / n, nan()) for k in range(1, self.order + 1)}


@dataclass(frozen=True, repr=False)
class Median(Statistic):
    """Holistic: taken from the cells at every scale."""

    name: str = "median"
    mergeable = False

    def components(self) -> tuple[Component, ...]:
        # percentile, not median: the latter has no sliding frame
        def refuse(state: Callable[[str], Column], how: str) -> Column:
            raise ValueError("a median can't be merged")

        return (Component("median", lambda v: F.percentile(v[0].cast("double"), F.lit(0.5)), refuse),)

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: F.coalesce(state("median"), nan())}


class CustomStatistic(Statistic):
    """A user's statistic from column expressions.

    ``state`` maps component names to aggregates of the values, ``merge`` to aggregates of
    state columns, ``finalize`` turns state columns into the value.  Names are made its own by
    a prefix, so that they cannot collide with other statistics."""

    def __init__(self, name: str, state: dict[str, Callable[..., Column]], merge: dict[str, Callable[[Callable[[str], Column]], Column]], finalize: Callable[[Callable[[str], Column]], Column], arity: int = 1):
        if state.keys() != merge.keys():
            raise ValueError("state and merge must name the same components")
        self.name, self.arity, self._state, self._merge, self._finalize = name, arity, state, merge, finalize

    def _own(self, state: Callable[[str], Column]) -> Callable[[str], Column]:
        return lambda c: state(f"{self.name}__{c}")

    def components(self) -> tuple[Component, ...]:
        return tuple(Component(f"{self.name}__{c}", (lambda v, f=f: f(*v)), (lambda s, _, m=self._merge[c]: m(self._own(s)))) for c, f in self._state.items())

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: self._finalize(self._own(state))}


class PairwiseStatistic(Statistic):
    """A user's statistic whose state merges two at a time.

    ``state`` maps parts of the state to aggregates of the values and ``empty`` to those of no
    value; ``merge`` takes the parts of two states, as functions of a name, and gives those of both
    together, the first before the second.  Blocks are folded by position: neighbours along the widest dimension
    merge, round by round, so the merge need not commute along a line, and no row holds more than two states."""

    def __init__(self, name: str, state: dict[str, Callable[..., Column]], empty: dict[str, Column], merge: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]], finalize: Callable[[Callable[[str], Column]], Column], arity: int = 1):
        if state.keys() != empty.keys():
            raise ValueError("state and empty must name the same parts")
        self.name, self.arity, self._state, self._empty, self._merge, self._finalize = name, arity, state, empty, merge, finalize

    def components(self) -> tuple[Component, ...]:
        own = f"{self.name}__state"

        def lift(v: Sequence[Column]) -> Column:
            return F.struct(*[f(*v).alias(c) for c, f in self._state.items()])

        def both(a: Column, b: Column) -> Column:
            parts = self._merge(lambda c: a[c], lambda c: b[c])
            return F.struct(*[parts[c].alias(c) for c in self._state])

        def merge(state: Callable[[str], Column], how: str) -> Column:
            """Of states of one and the same block: as many as results are merged."""
            states = F.collect_list(state(own))
            return F.when(F.size(states) > 0, F.aggregate(F.slice(states, 2, F.size(states)), F.get(states, F.lit(0)), both)).otherwise(F.struct(*[self._empty[c].alias(c) for c in self._state]))

        return (Component(own, lift, merge, both=both),)

    def result(self, state: Callable[[str], Column]) -> dict[str, Column]:
        return {self.name: self._finalize(lambda c: state(f"{self.name}__state")[c])}


def log_sum_exp() -> PairwiseStatistic:
    """An example of a merge that isn't an aggregate of parts: ln of the sum of exp, about the largest value."""

    def merge(a: Callable[[str], Column], b: Callable[[str], Column]) -> dict[str, Column]:
        top = F.greatest(a("top"), b("top"))
        return {"top": top, "s": a("s") * F.exp(a("top") - top) + b("s") * F.exp(b("top") - top)}

    return PairwiseStatistic(
        "log_sum_exp",
        {"top": lambda v: F.max(v.cast("double")), "s": lambda v: F.sum(F.exp(v.cast("double"))) * F.exp(-F.max(v.cast("double")))},
        {"top": F.lit(float("-inf")), "s": F.lit(0.0)},
        merge,
        lambda s: s("top") + F.ln(s("s")),
    )


def total_variation() -> PairwiseStatistic:
    """An example of a merge that depends on the order: the sum of the steps from cell to cell along a line."""

    def merge(a: Callable[[str], Column], b: Callable[[str], Column]) -> dict[str, Column]:
        return {"first": a("first"), "last": b("last"), "steps": a("steps") + b("steps") + F.abs(b("first") - a("last"))}

    only = lambda v: F.max(v.cast("double"))
    none = F.lit(None).cast("double")
    return PairwiseStatistic("variation", {"first": only, "last": only, "steps": lambda v: F.max(v.cast("double") * 0.0)}, {"first": none, "last": none, "steps": none}, merge, lambda s: s("steps"))


def geometric_mean() -> CustomStatistic:
    """An example of a custom statistic: exp of the mean logarithm."""
    return CustomStatistic(
        "geomean",
        {"n": lambda v: F.count(v), "ls": lambda v: F.sum(F.ln(v.cast("double")))},
        {"n": lambda s: F.sum(s("n")), "ls": lambda s: F.sum(s("ls"))},
        lambda s: F.exp(s("ls") / F.when(s("n") > 0, s("n"))),
    )


def minimal_components(stats: Sequence[Statistic]) -> dict[str, Component]:
    """The components that all statistics together need, each once."""
    found: dict[str, Component] = {}
    for stat in stats:
        for c in stat.components():
            found.setdefault(c.name, c)
    return found


def subsumes(a: Statistic, b: Statistic) -> bool:
    """Whether b needs no state beyond a's."""
    return {c.name for c in b.components()} <= {c.name for c in a.components()}


_BY_NAME: dict[str, Callable[[], Statistic]] = {"count": Count, "sum": Sum, "mean": Mean, "min": Min, "max": Max, "median": Median, "var": lambda: Var(False), "std": lambda: Std(False), "variance": lambda: Var(True)}


def named(stat: str) -> Statistic:
    """The statistic of a name as window functions take it; var and std divide by n."""
    if stat not in _BY_NAME:
        raise ValueError(f"unknown statistic {stat!r}; known: {', '.join(sorted(_BY_NAME))}")
    return _BY_NAME[stat]()
