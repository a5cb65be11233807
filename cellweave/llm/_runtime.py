"""Session helpers shared by the operators: worker import path, shared scratch tables."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass takes at a time; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where only the driver's sys.path has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    # workers are reused: large arrays go back to the system as soon as they are freed
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 18))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(1 << 20))
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, a local one of a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/cellweave/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A folder of this application's own in the shared one, deleted by ``cleanup``."""
    return f"{_scratch(spark)}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES.append(path)
    _PATHS[out] = path
    return out


#: Tables in the shared folder that are not deleted yet, and those of frames that are still held.
_TABLES: list[str] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Deletes what ``written`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = _PATHS.pop(df)
        _TABLES.remove(path)
        _delete(df.sparkSession, path)


def tables() -> list[str]:
    return list(_TABLES)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of results that have been used."""
    for path in paths:
        if path in _TABLES:
            _TABLES.remove(path)
            _delete(spark, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder, once its results are used."""
    _delete(spark, _scratch(spark))
    _TABLES.clear()


def names_apart(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return all columns: columns of the input whose names start with two underscores,
    as those of intermediate results do, have other names meanwhile."""

    @functools.wraps(run)
    def apart(documents: DataFrame, *args, **kwargs) -> DataFrame:  # noqa: ANN002, ANN003
        columns = documents.columns
        away, k = {}, 0
        for c in columns:
            if c.startswith("__"):
                while f"kept{k}" in {x.lower() for x in columns}:
                    k += 1
                away[f"kept{k}"] = c
                k += 1
        if not away:
            return run(documents, *args, **kwargs)
        back = {c: name for name, c in away.items()}
        return run(documents.toDF(*(back.get(c, c) for c in columns)), *args, **kwargs).withColumnsRenamed(away)

    return apart


def text_buffers(column: pa.Array) -> tuple:
    """Byte buffer and int64 offsets of a string column; nulls have empty spans."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(bufs[1], kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    import numpy as np

    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def list_column(values, counts, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the number of values of each row."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))

