"""Plans: which scale is merged from which, with the least work.

The work of a step is the number of rows it reads: all cells for a step from the input, the
blocks of its parent otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from .lattice import Factor, divides, factor_shape, factor_window, gcd_closure, reachable_factors


@dataclass(frozen=True)
class ReductionStep:
    """A scale, the step it is merged from (None: the input), and its window in units of that."""

    factor: Factor
    source: int | None
    window: Factor
    work: int
    wanted: bool = True


@dataclass(frozen=True)
class ReductionPlan:
    """Steps in an order in which sources come first."""

    extent: Factor
    steps: tuple[ReductionStep, ...]

    @property
    def targets(self) -> list[Factor]:
        return [s.factor for s in self.steps if s.wanted]

    @property
    def total_work(self) -> int:
        return sum(s.work for s in self.steps)

    @property
    def naive_work(self) -> int:
        """What one pass over the input for each wanted scale would read."""
        return prod(self.extent) * len(self.targets)

    @property
    def n_base_passes(self) -> int:
        return sum(s.source is None for s in self.steps)

    def describe(self) -> str:
        lines = [f"plan over {self.extent}: {len(self.steps)} steps, work {self.total_work} of {self.naive_work}"]
        for k, s in enumerate(self.steps):
            origin = "input" if s.source is None else f"step {s.source} {self.steps[s.source].factor}"
            lines.append(f"  {k}: {s.factor} from {origin} by {s.window}, reads {s.work}" + ("" if s.wanted else ", only for others"))
        return "\n".join(lines)

    __str__ = describe


def _checked(extent: Factor, factor: Factor) -> None:
    if len(factor) != len(extent):
        raise ValueError(f"factor {factor} for {len(extent)} dimensions")
    if any(f < 1 or f > x for f, x in zip(factor, extent, strict=True)):
        raise ValueError(f"factor {factor} isn't between 1 and the extent {extent}")


def _parent(extent: Factor, factor: Factor, among: Sequence[Factor]) -> Factor | None:
    """The factor whose blocks are fewest, of those that divide ``factor``; the input if none has fewer rows."""
    below = [p for p in among if p != factor and divides(p, factor)]
    best = min(below, key=lambda p: (prod(factor_shape(extent, p)), p), default=None)
    return best


def plan_work(extent: Sequence[int], factors: Sequence[Factor]) -> int:
    """Rows read when every factor is merged from its best parent among the others."""
    extent = tuple(extent)
    return sum(prod(extent if (p := _parent(extent, f, factors)) is None else factor_shape(extent, p)) for f in factors)


def naive_work(extent: Sequence[int], factors: Sequence[Factor]) -> int:
    return prod(extent) * len(factors)


def _assembled(extent: Factor, factors: Sequence[Factor], wanted: set[Factor]) -> ReductionPlan:
    order = sorted(set(factors), key=lambda f: (prod(f), f))
    place = {f: k for k, f in enumerate(order)}
    steps = []
    for f in order:
        p = _parent(extent, f, order)
        reads = prod(extent if p is None else factor_shape(extent, p))
        steps.append(ReductionStep(f, None if p is None else place[p], f if p is None else factor_window(p, f), reads, f in wanted))
    return ReductionPlan(extent, tuple(steps))


def tower_plan(extent: Sequence[int], base: Sequence[int], steps: Sequence[Sequence[int]], largest: Sequence[int]) -> ReductionPlan:
    """All factors that the tower reaches, each merged from its best parent."""
    extent = tuple(extent)
    factors = reachable_factors(base, steps, [min(m, x) for m, x in zip(largest, extent, strict=True)])
    for f in factors:
        _checked(extent, f)
    return _assembled(extent, factors, set(factors))


def solver_plan(extent: Sequence[int], targets: Sequence[Sequence[int]], allow_steiner: bool = True, steiner_cap: int = 4096) -> ReductionPlan:
    """The targets, with further scales where merging through them reads fewer rows.

    Candidates are the common divisors of targets; the one that saves most joins first, until
    none saves anything."""
    extent = tuple(extent)
    wanted = list(dict.fromkeys(tuple(int(x) for x in t) for t in targets))
    if not wanted:
        raise ValueError("no scales")
    for f in wanted:
        _checked(extent, f)
    chosen = list(wanted)
    if allow_steiner:
        spare = [c for c in gcd_closure(wanted, steiner_cap) if c not in chosen]
        now = plan_work(extent, chosen)
        while spare:
            work, best = min((plan_work(extent, [*chosen, c]), c) for c in spare)
            if work >= now:
                break
            now = work
            chosen.append(best)
            spare.remove(best)
        # one that no longer serves goes
        for c in [c for c in chosen if c not in wanted]:
            left = [f for f in chosen if f != c]
            if plan_work(extent, left) <= now:
                chosen, now = left, plan_work(extent, left)
    return _assembled(extent, chosen, set(wanted))
