"""Statistics as mergeable column expressions."""

from .statistics import Count, Cov, CustomStatistic, Max, Mean, Median, Min, Moments, PairwiseStatistic, Product, Statistic, Std, Sum, Var, minimal_components, named, subsumes

__all__ = ["Count", "Cov", "CustomStatistic", "Max", "Mean", "Median", "Min", "Moments", "PairwiseStatistic", "Product", "Statistic", "Std", "Sum", "Var", "minimal_components", "named", "subsumes"]
