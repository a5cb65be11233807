"""Names of execution backends.  Spark decides where work runs; every name gives equal results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Names that callers of other engines pass.
NAMES = ("auto", "serial", "threaded", "distributed", "mpi", "gpu", "cpu", "dask", "dask-distributed", "jax", "spark")


@dataclass(frozen=True)
class Backend:
    """A checked name; ``local`` where one process was meant."""

    name: str = "auto"

    def __post_init__(self) -> None:
        if self.name not in NAMES:
            raise ValueError(f"unknown backend {self.name!r}; known: {', '.join(NAMES)}")

    @property
    def is_distributed(self) -> bool:
        return self.name in ("distributed", "mpi", "dask-distributed")

    @property
    def local(self) -> Backend:
        return Backend("threaded") if self.is_distributed else self


def resolve_backend(backend: object = None) -> Backend:
    if backend is None:
        return Backend()
    return backend if isinstance(backend, Backend) else Backend(str(backend).lower())


def session(backend: object = None, threads: int | None = None) -> SparkSession:
    """The running session, or a local one of the size that the backend's name asks for."""
    name = resolve_backend(backend).name
    cores = "1" if name == "serial" else str(threads or "*")
    return SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{cores}]").getOrCreate()


def map_reduce(df: DataFrame, map_fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, reduce_fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """map_fn over batches of each partition, then reduce_fn, a DataFrame aggregation, over all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield map_fn(batch)

    return reduce_fn(df.mapInPandas(run, schema))


class LazyPlan:
    """Named steps over named frames: ``window`` (grid to state), ``stats`` and ``merge``.

    Each step's frame is lazy, so the plan is a thin builder over Spark's own lineage."""

    OPERATIONS = ("window", "stats", "merge")

    def __init__(self) -> None:
        self._steps: dict[str, tuple[str, Callable[..., DataFrame], tuple[str, ...]]] = {}

    def add(self, name: str, operation: str, fn: Callable[..., DataFrame], *inputs: str) -> LazyPlan:
        if operation not in self.OPERATIONS:
            raise ValueError(f"unknown operation {operation!r}; known: {', '.join(self.OPERATIONS)}")
        self._steps[name] = (operation, fn, inputs)
        return self

    def execute(self, output: str, **inputs: DataFrame) -> DataFrame:
        frames = dict(inputs)

        def made(name: str) -> DataFrame:
            if name not in frames:
                if name not in self._steps:
                    raise ValueError(f"no step or input named {name!r}")
                _, fn, needs = self._steps[name]
                frames[name] = fn(*[made(n) for n in needs])
            return frames[name]

        return made(output)
