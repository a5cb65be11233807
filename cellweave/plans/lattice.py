"""Block sizes (factors) ordered by divisibility in every dimension."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product
from math import gcd

Factor = tuple[int, ...]


def factor_shape(extent: Sequence[int], factor: Sequence[int]) -> Factor:
    """Whole blocks in each dimension; what remains at the high end is dropped."""
    return tuple(x // f for x, f in zip(extent, factor, strict=True))


def divides(a: Sequence[int], b: Sequence[int]) -> bool:
    """Whether blocks of b consist of whole blocks of a."""
    return all(y % x == 0 for x, y in zip(a, b, strict=True))


def factor_window(fine: Sequence[int], coarse: Sequence[int]) -> Factor:
    """How many fine blocks make one coarse block, in each dimension."""
    if not divides(fine, coarse):
        raise ValueError(f"{tuple(fine)} doesn't divide {tuple(coarse)}")
    return tuple(c // f for f, c in zip(fine, coarse, strict=True))


def reachable_factors(base: Sequence[int], steps: Sequence[Sequence[int]], largest: Sequence[int]) -> list[Factor]:
    """Every factor got from base by multiplying single dimensions by their steps, up to largest.

    The dimensions are independent, so it is the product of what each one reaches."""
    axes: list[list[int]] = []
    for b, of, most in zip(base, steps, largest, strict=True):
        found, new = {b}, {b}
        while new:
            new = {f * s for f in new for s in of if s > 1 and f * s <= most} - found
            found |= new
        axes.append(sorted(found))
    return sorted(product(*axes))


def gcd_closure(targets: Iterable[Sequence[int]], cap: int = 4096) -> list[Factor]:
    """The targets with all their greatest common divisors, without the factor of ones.

    Closing stops at ``cap`` members."""
    found = {tuple(t) for t in targets}
    new = set(found)
    while new and len(found) < cap:
        made = {tuple(map(gcd, a, b)) for a in new for b in found}
        new = set(sorted(made - found)[: cap - len(found)])
        found |= new
    return sorted(f for f in found if any(x != 1 for x in f))


def factor_sequence(start: int, targets: Iterable[int]) -> list[int]:
    """start and the larger targets, ascending and without repeats."""
    return [start, *sorted({t for t in targets if t > start})]
