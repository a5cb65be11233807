"""Grids: long-format DataFrames with integer dimension columns and value columns."""

from .grid import Grid, gather, rechunk, scatter

__all__ = ["Grid", "gather", "rechunk", "scatter"]
