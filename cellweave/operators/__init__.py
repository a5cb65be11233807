"""Operators on grids: block reductions, merges, windows, labels and joint moments."""
