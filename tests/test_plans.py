from itertools import combinations
from math import prod

import pytest

from cellweave.plans import factor_sequence, factor_shape, factor_window, gcd_closure, naive_work, plan_work, reachable_factors, solver_plan, tower_plan


def test_reachable_factors():
    found = reachable_factors((1, 1), [[2], [2]], (8, 8))
    assert len(found) == 16 and (1, 1) in found and (8, 4) in found
    assert reachable_factors((2,), [[1, 0, 3]], (20,)) == [(2,), (6,), (18,)]


def test_tower_parents_are_the_cheapest():
    plan = tower_plan((96, 96), (2, 2), [[2, 3]] * 2, (48, 48))
    factors = [s.factor for s in plan.steps]
    for s in plan.steps:
        below = [f for f in factors if f != s.factor and all(a % b == 0 for a, b in zip(s.factor, f, strict=True))]
        best = min([prod(factor_shape((96, 96), f)) for f in below], default=96 * 96)
        assert s.work == best
        assert s.source is None or factors.index(plan.steps[s.source].factor) < factors.index(s.factor)
    assert plan.n_base_passes == 1


def test_published_work_ratio():
    plan = solver_plan((4096, 4096), [(f, f) for f in (2, 4, 8, 16, 32, 64)])
    assert plan.total_work / plan.naive_work == pytest.approx(0.222, abs=5e-4)


def test_work_bounds():
    assert tower_plan((4096,), (2,), [[2]], (1024,)).total_work < 2 * 4096
    plan = tower_plan((256, 256), (1, 1), [[2], [2]], (64, 64))
    assert plan.n_base_passes == 1 and plan.total_work < plan.naive_work / 3


def test_steiner_equals_exhaustive_search():
    extent = (360, 360)
    assert (2, 2) in [s.factor for s in solver_plan(extent, [(4, 4), (6, 6)]).steps]
    targets = [(4, 4), (6, 6), (9, 9)]
    plan = solver_plan(extent, targets)
    spare = [c for c in gcd_closure(targets) if c not in targets]
    best = min(plan_work(extent, [*targets, *extra]) for k in range(len(spare) + 1) for extra in combinations(spare, k))
    assert plan.total_work == best < plan_work(extent, targets) <= naive_work(extent, targets)
    assert solver_plan(extent, targets, allow_steiner=False).total_work == plan_work(extent, targets)
    assert "only for others" in plan.describe()


def test_errors_and_helpers():
    for bad in ([(0, 2)], [(2, 400)], [(2,)], []):
        with pytest.raises(ValueError):
            solver_plan((360, 360), bad)
    with pytest.raises(ValueError):
        factor_window((4,), (6,))
    assert factor_sequence(2, [8, 4, 2, 8, 1]) == [2, 4, 8]
    assert len(solver_plan((64,), [(4,), (4,)]).targets) == 1
    assert (1, 1) not in gcd_closure([(2, 3), (3, 2)])
