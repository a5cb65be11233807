"""Statistics over N-dimensional gridded data at many resolutions at once, on Spark."""

from __future__ import annotations

from importlib import import_module

#: Public names by module; a module is imported when one of its names is first used, so that
#: Python workers that need one subpackage don't load the others.
_EXPORTS = {
    ".api": "MultiResResult Sliding Tower plan_for reduce_stats",
    ".catalogue": "IncrementalTower Lattice",
    ".backends": "Backend LazyPlan map_reduce resolve_backend",
    ".chunks": "Chunks",
    ".functions": "Count Cov CustomStatistic Max Mean Median Min Moments PairwiseStatistic Product Statistic Std Sum Var subsumes",
    ".operators.blocks": "base_reduce check_laws check_merge coarsen group_reduce inverse_merge materialize run_plan",
    ".operators.labels": "blockwise center_coordinates preserve_metadata resample rolling tree_reduce_labelled window_coordinates",
    ".operators.selection": "median_scales medians",
    ".operators.sliding": "WindowConfig blockwise_windows rolling_windows validate_window_config",
    ".operators.windows": "blockwise_stats merge_stats multiresolution_stats product_mean product_moments rolling_stats tiled_stats tree_reduce tree_reduce_variance window_stat",
    ".plans": "ReductionPlan ReductionStep factor_sequence reachable_factors solver_plan tower_plan",
    ".sources": "Grid gather rechunk scatter",
    ".sources.layout": "read_tiled scatter_along_curve write_tiled",
    ".tiles": "Tiles",
    ".streaming": "IncrementalState windowed_state",
}
_MODULE_OF = {name: module for module, names in _EXPORTS.items() for name in names.split()}

__all__ = sorted(_MODULE_OF)


def __getattr__(name: str):  # noqa: ANN202
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = getattr(import_module(_MODULE_OF[name], __name__), name)
    globals()[name] = value
    return value


def __dir__() -> list[str]:
    return [*globals(), *__all__]
