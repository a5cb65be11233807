"""Planning: the lattice of block sizes and the graph of merges between scales."""

from .lattice import divides, factor_sequence, factor_shape, factor_window, gcd_closure, reachable_factors
from .planner import ReductionPlan, ReductionStep, naive_work, plan_work, solver_plan, tower_plan

__all__ = ["ReductionPlan", "ReductionStep", "divides", "factor_sequence", "factor_shape", "factor_window", "gcd_closure", "naive_work", "plan_work", "reachable_factors", "solver_plan", "tower_plan"]
