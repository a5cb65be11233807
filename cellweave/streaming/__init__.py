"""Incremental maintenance of mergeable state, for frames in turn and for streams."""

from .incremental import IncrementalState, windowed_state

__all__ = ["IncrementalState", "windowed_state"]
