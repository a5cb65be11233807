"""Times the headline queries: one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
Each query runs once to warm up and BENCH_RUNS times (default 3) timed; the smallest time counts.  Results go to
Spark's noop sink, so that everything is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def synthetic(spark: SparkSession, side: int = 4096):  # noqa: ANN201
    """The published case's shape: side x side cells of pseudo-random doubles, kept in memory as rows."""
    from cellweave.sources.grid import Grid

    cells = spark.range(side * side, numPartitions=int(CPUS) * 2).select(F.expr(f"id div {side}").alias("i"), (F.col("id") % side).alias("j"), F.randn(7).alias("v"))
    return Grid(cells, ("i", "j"), (side, side), ("v",), True)


def windows_line(spark: SparkSession):  # noqa: ANN201
    from cellweave.sources.grid import Grid

    n = 200_000
    return Grid(spark.range(n, numPartitions=int(CPUS)).select(F.col("id").alias("i"), F.randn(3).alias("v")), ("i",), (n,), ("v",), True)


def windows_frame(line, window: int):  # noqa: ANN001, ANN201
    from cellweave.api import Sliding, reduce_stats

    result = reduce_stats(line, Sliding(window, 1))
    return result[result.factors[0]]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from cellweave.api import reduce_stats
    from cellweave.queries import QUERIES
    from cellweave.tiles import Tiles

    scales = [2, 4, 8, 16, 32, 64]
    runs = {name: (lambda f=f: f(spark, SF_DIR)) for name, f in QUERIES.items()}
    grid = synthetic(spark)  # the published case in long form: a row for each cell
    runs["tower_4096_long"] = lambda: reduce_stats(grid, scales).to_dataframe()
    if os.environ.get("BENCH_ALL"):  # other strategies, for comparison; minutes a run
        for strategy in ("direct", "grouping_sets"):
            runs[f"tower_4096_{strategy}"] = lambda s=strategy: reduce_stats(grid, scales, strategy=s).to_dataframe()
    line = windows_line(spark)
    for w in (100, 1_600):  # the same time whatever the window
        runs[f"windows_{w}_of_200000"] = lambda w=w: windows_frame(line, w)
    tiles = Tiles.from_grid_rows(spark, 4096, 4096)
    runs["tower_4096_tiles"] = lambda: tiles.reduce_stats(scales).to_dataframe()
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    times = {}
    for name, f in runs.items():
        if only and name not in only:
            continue
        best = None
        for k in range(RUNS + 1):
            t = time.perf_counter()
            f().write.format("noop").mode("overwrite").save()
            t = time.perf_counter() - t
            if k:
                best = t if best is None else min(best, t)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": CPUS}))


if __name__ == "__main__":
    main()
