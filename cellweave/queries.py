"""Queries over the driver's tables for each group of operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Sliding, Tower, plan_for, reduce_stats
from .backends import LazyPlan, map_reduce, resolve_backend
from .catalogue import IncrementalTower, Lattice
from .chunks import Chunks
from .functions.statistics import Count, Cov, Max, Mean, Median, Min, Moments, Std, Sum, Var, geometric_mean, log_sum_exp, total_variation
from .operators.blocks import base_reduce, check_laws, coarsen, group_reduce, inverse_merge, materialize
from .operators.labels import blockwise, center_coordinates, resample, rolling, tree_reduce_labelled, window_coordinates
from .operators.selection import median_scales
from .operators.sliding import WindowConfig, blockwise_windows, rolling_windows, validate_window_config
from .operators.windows import blockwise_stats, merge_stats, moment_covariance, moment_variance, multiresolution_stats, product_mean, product_moments, rolling_stats, tiled_stats, tree_reduce, tree_reduce_variance, window_stat
from .sources.grid import Grid, gather, rechunk, scatter
from .sources.layout import read_tiled, write_tiled
from .storage import shared_folder
from .streaming import windowed_state
from .tiles import Tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> Grid:
    return Grid.from_array_column(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def embeddings_3d(spark: SparkSession, sf_dir: str) -> Grid:
    return Grid.from_array_column(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", inner=(8, 8))


def mirrored_pair(spark: SparkSession, sf_dir: str) -> Grid:
    """x(i, j) and y(i, j) = x(i, 63 - j) of the embeddings."""
    g = embeddings(spark, sf_dir)
    e = _read(spark, sf_dir, "embeddings")
    both = e.select(F.col("vec_id").cast("long").alias("i"), F.posexplode(F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))).alias("j", "p"))
    cells = both.select("i", F.col("j").cast("long").alias("j"), F.col("p.a").cast("double").alias("x"), F.col("p.b").cast("double").alias("y"))
    return Grid(cells, ("i", "j"), g.extent, ("x", "y"), True)


def events(spark: SparkSession, sf_dir: str) -> Grid:
    return Grid.from_table(_read(spark, sf_dir, "events"), ["event_id"], ["value"], dense=True)


def events_with_gaps(spark: SparkSession, sf_dir: str) -> Grid:
    """The events, every seventh NaN and those from 100 to 109 too."""
    g = events(spark, sf_dir)
    gap = (F.col("event_id") % 7 == 3) | F.col("event_id").between(100, 109)
    return Grid(g.df.select("event_id", F.when(gap, F.lit(float("nan"))).otherwise(F.col("value")).alias("v")), g.dims, g.extent, ("v",), True)


def orders(spark: SparkSession, sf_dir: str) -> Grid:
    return Grid.from_table(_read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice"], dense=True)


def parts(spark: SparkSession, sf_dir: str) -> Grid:
    return Grid.from_table(_read(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"], dense=True)


def lineitems(spark: SparkSession, sf_dir: str, *values: str) -> Grid:
    return Grid.from_table(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], list(values))


def rounded(df: DataFrame, digits: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """Doubles rounded, and -0 as 0, so that the order of additions doesn't show."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float") and f.name not in keep:
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif f.dataType.typeName() in ("integer", "short"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


_E = "e AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_E3 = f"{_E}, g AS (SELECT i, j // 8 AS j0, j % 8 AS j1, v FROM e)"
_P = "p AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS y FROM embeddings)"
_GAPS = "g AS (SELECT event_id, CASE WHEN event_id % 7 = 3 OR event_id BETWEEN 100 AND 109 THEN 'nan'::DOUBLE ELSE value END AS v FROM events)"


def _r(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


def _sample(kind: str, of: str = "v") -> str:
    return f"CASE WHEN count({of.split(',')[0]}) > 1 THEN {kind}({of}) ELSE 'nan'::DOUBLE END"


def _blocks(fi: int, fj: int, columns: str, source: str = "e") -> str:
    return f"SELECT CAST(i // {fi} AS BIGINT) AS i, CAST(j // {fj} AS BIGINT) AS j, {columns} FROM {source}, x WHERE i < x.n // {fi} * {fi} AND j < 64 // {fj} * {fj} GROUP BY ALL"


_X = "x AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"
_MV = f"{_r('avg(v)')} AS mean, {_r(_sample('var_samp'))} AS var"


@_query(f"WITH {_E}, {_X} {_blocks(4, 4, _MV)}")
def block_mean_var_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(embeddings(spark, sf_dir), (4, 4))[4, 4])


@_query(
    f"WITH {_E}, {_X} "
    + _blocks(
        10,
        8,
        f"count(*) AS count, {_r('sum(v)')} AS sum, {_r('avg(v)')} AS mean, {_r(_sample('var_samp'))} AS var, {_r('var_pop(v)')} AS var_pop, {_r(_sample('stddev_samp'))} AS std, {_r('stddev_pop(v)')} AS std_pop, {_r('min(v)')} AS min, {_r('max(v)')} AS max",
    )
)
def block_all_stats_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = [Count(), Sum(), Mean(), Var(), Var(False), Std(), Std(False), Min(), Max()]
    return rounded(reduce_stats(embeddings(spark, sf_dir), (10, 8), stats)[10, 8])


@_query(f"WITH {_E3}, {_X} SELECT CAST(i // 4 AS BIGINT) AS i, CAST(j0 // 4 AS BIGINT) AS j0, CAST(j1 AS BIGINT) AS j1, {_MV} FROM g, x WHERE i < n // 4 * 4 GROUP BY ALL")
def block_partial_dim_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(embeddings_3d(spark, sf_dir), [(4, 4, 1)])[4, 4, 1])


@_query(f"WITH x AS (SELECT max(o_orderkey) + 1 AS n FROM orders) SELECT CAST(o_orderkey // 7 AS BIGINT) AS o_orderkey, count(*) AS count, {_r('sum(o_totalprice)', 2)} AS sum, {_r('min(o_totalprice)', 2)} AS min, {_r('max(o_totalprice)', 2)} AS max FROM orders, x WHERE o_orderkey < n // 7 * 7 GROUP BY ALL")
def block_truncated_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(orders(spark, sf_dir), 7, [Count(), Sum(), Min(), Max()])[7], 2)


def _scales(factors: Sequence[tuple[int, int]], columns: str) -> str:
    parts = [f"SELECT CAST({a} AS BIGINT) AS f_i, CAST({b} AS BIGINT) AS f_j, * FROM ({_blocks(a, b, columns)})" for a, b in factors]
    return f"WITH {_E}, {_X} " + " UNION ALL ".join(parts)


@_query(_scales([(2, 2), (4, 4), (8, 8), (16, 16), (32, 32), (64, 64)], _MV))
def tower_mean_var_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(embeddings(spark, sf_dir), [2, 4, 8, 16, 32, 64]).to_dataframe())


@_query(_scales([(4, 4), (6, 6), (9, 9)], _MV))
def tower_steiner_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(embeddings(spark, sf_dir), [4, 6, 9]).to_dataframe())


@_query(_scales([(a, b) for a in (5, 10, 20) for b in (2, 6)], _MV))
def tower_anisotropic_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(embeddings(spark, sf_dir), Tower((5, 2), [[2], [3]], (20, 6))).to_dataframe())


@_query(_scales([(2, 2), (4, 4), (10, 8)], _MV))
def grouping_sets_multiscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(embeddings(spark, sf_dir), [(2, 2), (4, 4), (10, 8)], strategy="grouping_sets").to_dataframe())


@_query(_scales([(2, 2), (4, 4), (8, 8)], _MV))
def direct_multiscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(embeddings(spark, sf_dir), [2, 4, 8], strategy="direct").to_dataframe())


@_query(f"WITH {_P}, {_X} " + " UNION ALL ".join(f"SELECT CAST({f} AS BIGINT) AS f_i, CAST({f} AS BIGINT) AS f_j, * FROM ({_blocks(f, f, _r('covar_samp(x, y)') + ' AS cov, ' + _r('covar_pop(x, y)') + ' AS cov_pop', 'p')})" for f in (5, 10)))
def block_cov_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(mirrored_pair(spark, sf_dir), [5, 10], [Cov(), Cov(False)]).to_dataframe())


@_query(f"WITH x AS (SELECT max(event_id) + 1 AS n FROM events) SELECT CAST(event_id // 50 AS BIGINT) AS event_id, {_r('avg(value)', 7)} AS m1, {_r('avg(value * value)', 7)} AS m2, {_r('avg(value * value * value)', 2)} AS m3, {_r('avg(value * value * value * value)', 0)} AS m4 FROM events, x WHERE event_id < n // 50 * 50 GROUP BY ALL")
def block_moments_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reduce_stats(events(spark, sf_dir), 50, [Moments(4)])[50]
    return df.select("event_id", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("m1", 7), ("m2", 7), ("m3", 2), ("m4", 0))])


@_query(f"WITH {_P}, g AS (SELECT i, j // 8 AS j0, j % 8 AS j1, x, y FROM p), {_X} SELECT CAST(i // 5 AS BIGINT) AS i, CAST(j0 // 2 AS BIGINT) AS j0, CAST(j1 // 4 AS BIGINT) AS j1, {_r('avg(x * y)')} AS value FROM g, x WHERE i < n // 5 * 5 GROUP BY ALL")
def product_mean_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(product_mean(_pair_3d(spark, sf_dir), (5, 2, 4)))


def _pair_3d(spark: SparkSession, sf_dir: str) -> Grid:
    g = mirrored_pair(spark, sf_dir)
    return Grid(g.df.select("i", F.expr("j div 8").alias("j0"), (F.col("j") % 8).alias("j1"), "x", "y"), ("i", "j0", "j1"), (g.extent[0], 8, 8), ("x", "y"), True)


@_query(
    f"WITH {_P}, g AS (SELECT i, j // 8 AS j0, j % 8 AS j1, x, y FROM p), {_X} SELECT CAST(i // 5 AS BIGINT) AS i, CAST(j0 // 2 AS BIGINT) AS j0, CAST(j1 // 4 AS BIGINT) AS j1, {_r('avg(x)')} AS mean_x, {_r('avg(y)')} AS mean_y, {_r('avg(x * y)')} AS mean_xy, {_r('var_samp(x)')} AS var_x, {_r('var_samp(y)')} AS var_y, {_r('covar_samp(x, y)')} AS cov_xy FROM g, x WHERE i < n // 5 * 5 GROUP BY ALL"
)
def product_moments_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(product_moments(_pair_3d(spark, sf_dir), (5, 2, 4)))


@_query(f"WITH {_E}, {_X} {_blocks(10, 8, _r('median(v)') + ' AS value')}")
def block_median_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blockwise_stats(embeddings(spark, sf_dir), (10, 8), "median", strict=False))


def _slid(wi: int, wj: int, si: int, sj: int, oi: int, oj: int, columns: str, source: str = "e") -> str:
    return f"""SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, {columns} FROM {source}
JOIN (SELECT unnest(range(0, (n - {wi} - {oi}) // {si} + 1)) AS a FROM x) ON i >= a * {si} + {oi} AND i < a * {si} + {oi} + {wi}
JOIN (SELECT unnest(range(0, (64 - {wj} - {oj}) // {sj} + 1)) AS b) ON j >= b * {sj} + {oj} AND j < b * {sj} + {oj} + {wj} GROUP BY a, b"""


@_query(f"WITH {_E}, {_X} {_slid(8, 6, 2, 3, 0, 0, _MV)}")
def sliding_mean_var_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = reduce_stats(embeddings(spark, sf_dir), Sliding((8, 6), (2, 3)))
    return rounded(result[result.factors[0]])


@_query(f"WITH {_E}, {_X} {_slid(5, 5, 3, 2, 2, 1, _MV)}")
def sliding_origin_stride_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = reduce_stats(embeddings(spark, sf_dir), Sliding((5, 5), (3, 2), (2, 1)), executor="expand")
    return rounded(result[result.factors[0]])


def _line(w: int, s: int, columns: str) -> str:
    return f"WITH x AS (SELECT max(event_id) + 1 AS n FROM events) SELECT CAST(k AS BIGINT) AS event_id, {columns} FROM events JOIN (SELECT unnest(range(0, (n - {w}) // {s} + 1)) AS k FROM x) ON event_id >= k * {s} AND event_id < k * {s} + {w} GROUP BY k"


@_query(_line(50, 5, f"{_r('avg(value)', 7)} AS mean, {_r('min(value)', 7)} AS min, {_r('max(value)', 7)} AS max, count(*) AS count"))
def sliding_minmax_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = reduce_stats(events(spark, sf_dir), Sliding(50, 5), [Mean(), Min(), Max(), Count()])
    return rounded(result[result.factors[0]], 7)


@_query(f"WITH {_P}, {_X} {_slid(6, 6, 2, 2, 0, 0, _r('covar_samp(x, y)') + ' AS cov', 'p')}")
def sliding_cov_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = reduce_stats(mirrored_pair(spark, sf_dir), Sliding(6, 2), [Cov()])
    return rounded(result[result.factors[0]])


@_query(_line(21, 7, f"{_r('median(value)', 4)} AS value"))
def sliding_median_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling_stats(events(spark, sf_dir), WindowConfig((21,), (7,)), "median"), 4)


@_query(f"WITH {_E}, {_X} {_blocks(8, 6, _MV)}")
def sliding_block_equiv_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = reduce_stats(embeddings(spark, sf_dir), Sliding((8, 6)))
    return rounded(result[result.factors[0]])


def _padded(w: int, s: int, count: str, first: int, stat: str, empty: str) -> str:
    return f"WITH x AS (SELECT max(event_id) + 1 AS n FROM events), k AS (SELECT unnest(range(0, {count})) AS k FROM x) SELECT CAST(k AS BIGINT) AS event_id, coalesce({stat}, {empty}) AS value FROM k LEFT JOIN events ON event_id >= k * {s} + {first} AND event_id < k * {s} + {first} + {w} GROUP BY k"


@_query(_padded(9, 4, "(n - 1) // 4 + 1", 4, _r("avg(value)", 7), "'nan'::DOUBLE"))
def rolling_same_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling_stats(events(spark, sf_dir), WindowConfig((9,), (4,), "same"), "mean"), 7)


@_query(_padded(9, 4, "(n - 1) // 4 + 1", -4, _r("avg(value)", 7), "'nan'::DOUBLE"))
def rolling_same_centered_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling_stats(events(spark, sf_dir), WindowConfig((9,), (4,), "same"), "mean", same_align="centered"), 7)


@_query(_padded(9, 4, "(n + 9 - 2) // 4 + 1", -8, _r("sum(value)", 4), "0.0"))
def rolling_full_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling_stats(events(spark, sf_dir), WindowConfig((9,), (4,), "full"), "sum"), 4)


@_query(f"WITH {_E} SELECT CAST(a.i AS BIGINT) AS i, CAST(a.j AS BIGINT) AS j, CASE WHEN count(*) >= 6 THEN {_r('avg(b.v)')} ELSE 'nan'::DOUBLE END AS value FROM e a JOIN e b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 2 AND a.j + 1 GROUP BY a.i, a.j")
def rolling_centered_min_periods_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling(embeddings(spark, sf_dir), {"i": 3, "j": 4}, "mean", min_periods=6)
    return rounded(out.df.select("i", "j", F.col(out.values[0]).alias("value")))


@_query(f"WITH {_GAPS}, x AS (SELECT max(event_id) + 1 AS n FROM events) SELECT CAST(event_id // 10 AS BIGINT) AS event_id, count(*) FILTER (NOT isnan(v)) AS count, {_r('coalesce(sum(v) FILTER (NOT isnan(v)), 0)', 7)} AS sum, coalesce({_r('avg(v) FILTER (NOT isnan(v))', 7)}, 'nan'::DOUBLE) AS mean, coalesce({_r('max(v) FILTER (NOT isnan(v))', 7)}, 'nan'::DOUBLE) AS max FROM g, x WHERE event_id < n // 10 * 10 GROUP BY ALL")
def nan_skip_block_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reduce_stats(events_with_gaps(spark, sf_dir), 10, [Count(), Sum(), Mean(), Max()], skipna=True)[10]
    return rounded(df.withColumn("max", F.coalesce("max", F.lit(float("nan")))), 7)


@_query(f"WITH {_GAPS}, x AS (SELECT max(event_id) + 1 AS n FROM events) SELECT CAST(event_id // 5 AS BIGINT) AS event_id, count(*) AS count, CASE WHEN bool_or(isnan(v)) THEN 'nan'::DOUBLE ELSE {_r('avg(v)', 7)} END AS mean, CASE WHEN bool_or(isnan(v)) THEN 'nan'::DOUBLE ELSE {_r('min(v)', 7)} END AS min, CASE WHEN bool_or(isnan(v)) THEN 'nan'::DOUBLE ELSE {_r('max(v)', 7)} END AS max FROM g, x WHERE event_id < n // 5 * 5 GROUP BY ALL")
def nan_propagate_block_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(events_with_gaps(spark, sf_dir), 5, [Count(), Mean(), Min(), Max()])[5], 7)


@_query(f"WITH {_E}, {_X} {_blocks(10, 8, _r('var_pop(v)') + ' AS value, count(*) AS n')}")
def tiled_partials_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tiled_stats(embeddings(spark, sf_dir), (10, 8), "var", strict=False))


def _parities(spark: SparkSession, sf_dir: str) -> list[Grid]:
    g = embeddings(spark, sf_dir)
    return [Grid(g.df.where(F.col("i") % 2 == k).withColumn("i", F.expr("i div 2")), g.dims, (g.extent[0] // 2, 64), g.values) for k in (0, 1)]


def _halves(spark: SparkSession, sf_dir: str, stat: str) -> list[DataFrame]:
    return [blockwise_stats(h, (5, 8), stat, strict=False) for h in _parities(spark, sf_dir)]


def _halves_sql(inner: str, outer: str) -> str:
    return f"WITH {_E}, {_X}, h AS (SELECT i % 2 AS side, (i // 2) // 5 AS i, j // 8 AS j, {inner}(v) AS v FROM e, x WHERE i // 2 < (n // 2) // 5 * 5 GROUP BY ALL) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_r(outer + '(v)')} AS value FROM h GROUP BY i, j"


@_query(_halves_sql("avg", "avg"))
def merge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(merge_stats(_halves(spark, sf_dir, "mean"), ["i", "j"], "mean"))


@_query(_halves_sql("sum", "sum"))
def merge_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(merge_stats(_halves(spark, sf_dir, "sum"), ["i", "j"], "sum"))


@_query(_halves_sql("sum", "sum"))
def tree_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    add = lambda a, b: merge_stats([a, b], ["i", "j"], "sum")
    return rounded(tree_reduce(_halves(spark, sf_dir, "sum"), add, 4))


@_query(f"SELECT o_orderpriority, {_r(_sample('var_samp', 'o_totalprice'), 1)} AS var FROM orders GROUP BY 1")
def tree_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    blocks = [o.where(F.col("o_orderkey") % 3 == k) for k in range(3)]
    return rounded(tree_reduce_variance(blocks, "o_totalprice", ["o_orderpriority"]), 1)


_L = "x AS (SELECT max(l_orderkey) + 1 AS a, max(l_linenumber) + 1 AS b FROM lineitem)"


@_query(f"WITH {_L} SELECT CAST(l_orderkey // 20 AS BIGINT) AS l_orderkey, CAST(l_linenumber // 2 AS BIGINT) AS l_linenumber, count(*) AS count, {_r('avg(l_quantity)')} AS mean, {_r(_sample('var_samp', 'l_quantity'))} AS var FROM lineitem, x WHERE l_orderkey < a // 5 // 4 * 20 AND l_linenumber < b // 2 * 2 GROUP BY ALL")
def chan_merge_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lineitems(spark, sf_dir, "l_quantity")
    stats = [Count(), Mean(), Var()]
    fine = base_reduce(g, (5, 2), stats)
    coarse = coarsen(fine, g.dims, (g.extent[0] // 5, g.extent[1] // 2), (4, 1), stats)
    return rounded(materialize(coarse, g.dims, stats))


@_query(f"WITH {_L} SELECT CAST(l_orderkey // 100 AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_r('covar_samp(l_quantity, l_extendedprice)', 3)} AS cov FROM lineitem, x WHERE l_orderkey < a // 100 * 100 GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT CAST(l_orderkey // 100 AS BIGINT), CAST(l_linenumber AS BIGINT), 'nan'::DOUBLE FROM lineitem, x WHERE l_orderkey < a // 100 * 100 GROUP BY ALL HAVING count(*) = 1")
def pebay_merge_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lineitems(spark, sf_dir, "l_quantity", "l_extendedprice")
    fine = base_reduce(g, (10, 1), [Cov()])
    return rounded(materialize(coarsen(fine, g.dims, (g.extent[0] // 10, g.extent[1]), (10, 1), [Cov()]), g.dims, [Cov()]), 3)


@_query(f"WITH x AS (SELECT max(o_orderkey) + 1 AS n FROM orders) SELECT CAST(o_orderkey // 50 AS BIGINT) AS o_orderkey, count(*) AS count, {_r('avg(o_totalprice)', 4)} AS mean, {_r('var_samp(o_totalprice)', 0)} AS var FROM orders, x WHERE o_orderkey % 3 <> 0 AND o_orderkey < n // 50 * 50 GROUP BY ALL")
def inverse_merge_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = orders(spark, sf_dir)
    stats = [Count(), Mean(), Var()]
    part = Grid(g.df.where(F.col("o_orderkey") % 3 == 0), g.dims, g.extent, g.values)
    out = materialize(inverse_merge(base_reduce(g, (50,), stats), base_reduce(part, (50,), stats), g.dims, stats), g.dims, stats)
    return out.select("o_orderkey", "count", (F.round("mean", 4) + 0.0).alias("mean"), (F.round("var", 0) + 0.0).alias("var"))


@_query(f"WITH x AS (SELECT max(o_orderkey) + 1 AS n FROM orders) SELECT CAST({{0}} AS BIGINT) AS f_o_orderkey, CAST(o_orderkey // {{0}} AS BIGINT) AS o_orderkey, {_r('exp(avg(ln(o_totalprice)))', 3)} AS geomean FROM orders, x WHERE o_orderkey < n // {{0}} * {{0}} GROUP BY ALL".format(4) + f" UNION ALL SELECT CAST(16 AS BIGINT), CAST(o_orderkey // 16 AS BIGINT), {_r('exp(avg(ln(o_totalprice)))', 3)} FROM orders, x WHERE o_orderkey < n // 16 * 16 GROUP BY ALL")
def custom_geomean_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(orders(spark, sf_dir), [4, 16], [geometric_mean()]).to_dataframe(), 3)


@_query(f"SELECT l_returnflag, l_linestatus, {_r('avg(l_quantity)', 4)} AS qty, count(l_orderkey) AS n, {_r('stddev_pop(l_extendedprice)', 2)} AS spread FROM lineitem GROUP BY 1, 2")
def groupby_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = group_reduce(_read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"qty": ("l_quantity", Mean()), "n": ("l_orderkey", Count()), "spread": ("l_extendedprice", Std(False))})
    return df.select("l_returnflag", "l_linestatus", (F.round("qty", 4) + 0.0).alias("qty"), "n", (F.round("spread", 2) + 0.0).alias("spread"))


@_query(f"SELECT l_returnflag, {_r('median(l_extendedprice)', 4)} AS median FROM lineitem GROUP BY 1")
def window_stat_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window_stat(_read(spark, sf_dir, "lineitem"), "l_extendedprice", "median", ["l_returnflag"]), 4)


def _binned(size: int, stat: str, empty: str) -> str:
    return f"WITH b AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // {size} * {size} AS s, value FROM events WHERE ts IS NOT NULL), k AS (SELECT unnest(range(min(s), max(s) + 1, {size})) AS s FROM b), g AS (SELECT s, {stat} AS value FROM b GROUP BY s) SELECT k.s AS bin, coalesce(value, {empty}) AS value FROM k LEFT JOIN g ON k.s = g.s"


@_query(_binned(21600, _r("avg(value)", 7), "'nan'::DOUBLE"))
def resample_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = resample(_read(spark, sf_dir, "events"), "ts", "value", "6h", "mean")
    return rounded(df.select(F.unix_timestamp("bin").alias("bin"), "value"), 7)


@_query("WITH b AS (SELECT date_trunc('month', ts) AS m, avg(value) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1) SELECT CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS TIMESTAMP) AS bin, "+_r("value")+" AS value FROM b")
def resample_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample(_read(spark, sf_dir, "events"), "ts", "value", "1M", "mean"))


@_query(_binned(60, "count(value)", "0"))
def resample_empty_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = resample(_read(spark, sf_dir, "events"), "ts", "value", "1min", "count")
    return df.select(F.unix_timestamp("bin").alias("bin"), F.col("value").cast("long").alias("value"))


def _coords(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 0.5 + 10).alias("coord"))


def _labelled(spark: SparkSession, sf_dir: str) -> Grid:
    g = embeddings(spark, sf_dir)
    return Grid(g.df, g.dims, g.extent, g.values, True, "u", {"i": _coords(spark, g.extent[0]), "j": _coords(spark, 64)}, {"units": "m/s"})


@_query(f"WITH {_X} SELECT CAST(k AS BIGINT) AS idx, (k * 5 + 4) * 0.5 + 10.0 AS coord FROM (SELECT unnest(range(0, (n - 9) // 5 + 1)) AS k FROM x)")
def center_coords_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = embeddings(spark, sf_dir).extent[0]
    return center_coordinates(_coords(spark, n), n, 9, 5).select("idx", F.col("coord").cast("double").alias("coord"))


@_query(f"WITH {_X} SELECT CAST(k AS BIGINT) AS idx, (k * 10 + 4.5) * 0.5 + 10 AS coord FROM (SELECT unnest(range(0, n // 10)) AS k FROM x)")
def block_coords_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blockwise(_labelled(spark, sf_dir), {"i": 10, "j": 8}, "mean", strict=False)
    return out.coords["i"].select("idx", "coord")


@_query(f"WITH {_E}, {_X} {_blocks(10, 8, _r('var_pop(v)') + ' AS u_var_blockwise')}")
def block_labelled_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blockwise(_labelled(spark, sf_dir), {"i": 10, "j": 8}, "var", strict=False).df)


@_query(f"WITH {_E}, {_X} SELECT *, CAST(i * 10 AS DOUBLE) * 0.5 + 10 AS i_window_start, CAST(i * 10 + 5 AS DOUBLE) * 0.5 + 10 AS i_window_center, CAST(i * 10 + 9 AS DOUBLE) * 0.5 + 10 AS i_window_end, CAST(j * 8 AS DOUBLE) * 0.5 + 10 AS j_window_start, CAST(j * 8 + 4 AS DOUBLE) * 0.5 + 10 AS j_window_center, CAST(j * 8 + 7 AS DOUBLE) * 0.5 + 10 AS j_window_end FROM ({_blocks(10, 8, _r('avg(v)') + ' AS value')})")
def window_coords_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, config = _labelled(spark, sf_dir), WindowConfig((10, 8))
    return rounded(window_coordinates(g, blockwise_stats(g, (10, 8), "mean", strict=False), config))


@_query(f"WITH {_X} SELECT CAST(a AS BIGINT) AS i, CAST(a * 3 AS BIGINT) AS i_start, CAST(a * 3 + 5 AS BIGINT) AS i_stop, CAST(a * 3 + 2 AS BIGINT) AS i_center, CAST(b AS BIGINT) AS j, CAST(b * 4 AS BIGINT) AS j_start, CAST(b * 4 + 8 AS BIGINT) AS j_stop, CAST(b * 4 + 4 AS BIGINT) AS j_center FROM (SELECT unnest(range(0, (n - 5) // 3 + 1)) AS a FROM x), (SELECT unnest(range(0, 15)) AS b)")
def window_enumeration_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = embeddings(spark, sf_dir)
    return rolling_windows(g.extent, WindowConfig((5, 8), (3, 4)), spark, g.dims)


@_query(f"WITH {_E}, {_X} SELECT CAST(4 AS BIGINT) AS factor, * FROM ({_blocks(4, 4, _MV + ', ' + _r(_sample('stddev_samp')) + ' AS std')}) UNION ALL SELECT CAST(8 AS BIGINT), * FROM ({_blocks(8, 8, _MV + ', ' + _r(_sample('stddev_samp')) + ' AS std')})")
def multiresolution_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = multiresolution_stats(embeddings(spark, sf_dir), [4, 8], ("mean", "var", "std"))
    frames = [of["mean"].join(of["var"], ["i", "j"]).join(of["std"], ["i", "j"]).withColumn("factor", F.lit(f).cast("long")) for f, of in got.items()]
    return rounded(frames[0].unionByName(frames[1]))


@_query(f"SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS start, count(value) AS count, {_r('avg(value)', 7)} AS mean, {_r(_sample('var_samp', 'value'), 6)} AS var FROM events GROUP BY 1")
def stream_window_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = [Count(), Mean(), Var()]
    state = windowed_state(_read(spark, sf_dir, "events"), "ts", "value", "1 hour", stats)
    df = materialize(state.withColumn("start", F.unix_timestamp("start")), ["start"], stats)
    return df.select("start", "count", (F.round("mean", 7) + 0.0).alias("mean"), (F.round("var", 6) + 0.0).alias("var"))


@_query(f"WITH x AS (SELECT max(p_partkey) + 1 AS n FROM part) SELECT CAST(p_partkey // 25 AS BIGINT) AS p_partkey, {_r('covar_samp(p_size, p_retailprice)', 4)} AS cov FROM part, x WHERE p_partkey < n // 25 * 25 GROUP BY ALL")
def block_cov_integer_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(parts(spark, sf_dir), 25, [Cov()])[25], 4)


@_query(_scales([(2, 2), (4, 4), (8, 8), (16, 16), (32, 32)], f"count(*) AS count, {_r('avg(v)')} AS mean, {_r(_sample('var_samp'))} AS var, {_r('min(v)')} AS min"))
def tiles_multiscale_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = embeddings(spark, sf_dir)
    tiles = Tiles.from_rows(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", g.extent)
    df = tiles.reduce_stats([2, 4, 8, 16, 32], [Count(), Mean(), Var(), Min()]).to_dataframe()
    return rounded(df.withColumnsRenamed({"f_d0": "f_i", "f_d1": "f_j", "d0": "i", "d1": "j"}))


def _values(columns: str, rows: Sequence[tuple]) -> str:
    def text(v: object) -> str:
        return f"CAST({v} AS BIGINT)" if isinstance(v, int) and not isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v).lower()

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


@_query(f"WITH {_X}, s AS (SELECT n * 64 AS base, n // 3 * 21 AS third FROM x) SELECT CAST(k AS BIGINT) AS step, f AS factor, CAST(o AS BIGINT) AS source, w AS window, CAST(CASE WHEN o < 0 THEN base ELSE third END AS BIGINT) AS work, k > 0 AS wanted FROM s, (VALUES (0, '(3, 3)', -1, '(3, 3)'), (1, '(4, 4)', -1, '(4, 4)'), (2, '(6, 6)', 0, '(2, 2)'), (3, '(9, 9)', 0, '(3, 3)')) t(k, f, o, w)")
def plan_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the plan for scales 4, 6 and 9 of the embeddings grid."""
    plan = plan_for(embeddings(spark, sf_dir).extent, [4, 6, 9])
    return spark.createDataFrame([(k, str(s.factor), -1 if s.source is None else s.source, str(s.window), s.work, s.wanted) for k, s in enumerate(plan.steps)], "step long, factor string, source long, window string, work long, wanted boolean")


@_query("SELECT CAST(4096 * 4096 + 2048 * 2048 + 1024 * 1024 + 512 * 512 + 256 * 256 + 128 * 128 AS BIGINT) AS work, CAST(6 * 4096 * 4096 AS BIGINT) AS naive, CAST(1 AS BIGINT) AS base_passes")
def plan_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read by the plan for 2 to 64 of 4096 x 4096 cells, and by a pass for each scale."""
    plan = plan_for((4096, 4096), [2, 4, 8, 16, 32, 64])
    return spark.createDataFrame([(plan.total_work, plan.naive_work, plan.n_base_passes)], "work long, naive long, base_passes long")


_CASES = {
    "arity": True,
    "backend": True,
    "dimensions of windows": True,
    "exact windows": False,
    "extents of a pair": True,
    "merge of medians": True,
    "padding": True,
    "remainder of windows": True,
    "scale over the extent": True,
    "scale zero": True,
    "stride zero": True,
    "window over the extent": True,
}


@_query(_values("what, raised", list(_CASES.items())))
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused before any row is read."""
    g = embeddings(spark, sf_dir)
    attempts: dict[str, Callable[[], object]] = {
        "arity": lambda: reduce_stats(g, 4, [Cov()]),
        "backend": lambda: resolve_backend("abacus"),
        "dimensions of windows": lambda: validate_window_config((10, 10), WindowConfig((3,))),
        "exact windows": lambda: validate_window_config((12,), WindowConfig((3,)), True),
        "extents of a pair": lambda: g.pair(replace(g, extent=(1, 64))),
        "merge of medians": lambda: coarsen(g.df, g.dims, g.extent, (2, 2), [Median()]),
        "padding": lambda: WindowConfig((3,), None, "wrap"),
        "remainder of windows": lambda: validate_window_config((10,), WindowConfig((3,)), True),
        "scale over the extent": lambda: plan_for((8, 8), [16]),
        "scale zero": lambda: plan_for((8, 8), (0, 1)),
        "stride zero": lambda: WindowConfig((3,), (0,)),
        "window over the extent": lambda: validate_window_config((2,), WindowConfig((3,), (1,)), True),
    }
    seen = []
    for what, attempt in attempts.items():
        try:
            attempt()
            seen.append((what, False))
        except ValueError:
            seen.append((what, True))
    return spark.createDataFrame(seen, "what string, raised boolean")


@_query(f"WITH {_P}, {_X} {_blocks(5, 8, _r('covar_samp(x, y)') + ' AS cov', 'p')}")
def pair_of_fields_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = embeddings(spark, sf_dir)
    mirrored = replace(g, df=g.df.select("i", (F.lit(63) - F.col("j")).alias("j"), "v"))
    return rounded(reduce_stats(g.pair(mirrored), (5, 8), [Cov()])[5, 8])


@_query(f"WITH {_E}, {_X} {_blocks(10, 8, _MV)}")
def scattered_rechunked_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slabs dealt anew by block, then the blocks' statistics."""
    return rounded(reduce_stats(rechunk(scatter(embeddings(spark, sf_dir), 4), (10, 8)), (10, 8))[10, 8])


@_query(f"WITH {_E}, {_X} {_blocks(50, 64, _MV)}")
def gathered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink for small results: the blocks as pandas, and back."""
    values = rounded(reduce_stats(embeddings(spark, sf_dir), (50, 64))[50, 64])
    return spark.createDataFrame(gather(values), values.schema)


@_query(f"WITH {_E} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(1 AS BIGINT) AS count, {_r('v')} AS mean, 0.0::DOUBLE AS var_pop FROM e")
def one_by_one_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_stats(embeddings(spark, sf_dir), (1, 1), [Count(), Mean(), Var(False)])[1, 1])


@_query(f"WITH {_P}, {_X} {_blocks(5, 8, _r('var_pop(x)') + ' AS var_x, ' + _r('covar_pop(x, y)') + ' AS cov_xy', 'p')}")
def moment_identities_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<xx> - <x><x> and <xy> - <x><y> of blocks."""
    g = mirrored_pair(spark, sf_dir)
    cells = g.df.where(F.col("i") < g.extent[0] // 5 * 5).select(F.expr("i div 5").alias("i"), F.expr("j div 8").alias("j"), "x", "y", (F.col("x") * F.col("x")).alias("xx"), (F.col("x") * F.col("y")).alias("xy"))
    m = group_reduce(cells, ["i", "j"], {c: (c, Mean()) for c in ("x", "y", "xx", "xy")})
    return rounded(m.select("i", "j", moment_variance(F.col("x"), F.col("xx")).alias("var_x"), moment_covariance(F.col("x"), F.col("y"), F.col("xy")).alias("cov_xy")))


@_query(f"WITH {_E}, {_X}, h AS (SELECT i // 2 AS i, j, v FROM e, x WHERE i // 2 < (n // 2) // 5 * 5) SELECT CAST(i // 5 AS BIGINT) AS i, CAST(j // 8 AS BIGINT) AS j, count(*) AS count, {_MV} FROM h GROUP BY ALL")
def merge_welford(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = [base_reduce(h, (5, 8), [Var()]) for h in _parities(spark, sf_dir)]
    return rounded(materialize(merge_stats(states, ["i", "j"], "welford"), ["i", "j"], [Count(), Mean(), Var()]))


@_query(f"WITH {_E} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_r('v + v * v')} AS value FROM e")
def tree_reduce_labelled_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _labelled(spark, sf_dir)
    squares = replace(g, df=g.df.withColumn("v", F.col("v") * F.col("v")))
    out = tree_reduce_labelled([g, squares])
    return rounded(out.df.select("i", "j", F.col(out.values[0]).alias("value")))


@_query(_values("law, holds", [(x, True) for x in ("associativity", "commutativity", "homomorphism", "identity", "inverse")]))
def monoid_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = check_laws(embeddings(spark, sf_dir), (25, 16), [Count(), Sum(), Mean(), Var()])
    return spark.createDataFrame(list(laws.items()), "law string, holds boolean")


@_query(f"WITH {_X} SELECT CAST(a AS BIGINT) AS d0, CAST(a * 10 AS BIGINT) AS d0_start, CAST(a * 10 + 10 AS BIGINT) AS d0_stop, CAST(a * 10 + 5 AS BIGINT) AS d0_center, CAST(b AS BIGINT) AS d1, CAST(b * 8 AS BIGINT) AS d1_start, CAST(b * 8 + 8 AS BIGINT) AS d1_stop, CAST(b * 8 + 4 AS BIGINT) AS d1_center FROM (SELECT unnest(range(0, n // 10)) AS a FROM x), (SELECT unnest(range(0, 8)) AS b)")
def blockwise_enumeration_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockwise_windows(embeddings(spark, sf_dir).extent, (10, 8), spark, strict=False)


@_query(f"WITH x AS (SELECT max(event_id) + 1 AS n FROM events), k AS (SELECT k, (k + unnest(range(0, 9))) % n AS cell FROM (SELECT unnest(range(0, n)) AS k, n FROM x)) SELECT CAST(k AS BIGINT) AS event_id, {_r('avg(value)', 7)} AS value FROM k JOIN events ON cell = event_id GROUP BY k")
def rolling_periodic_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling_stats(events(spark, sf_dir), WindowConfig((9,), (1,)), "mean", boundary="periodic"), 7)


@_query(f"WITH {_E} SELECT CAST(a.i AS BIGINT) AS i, CAST(a.j AS BIGINT) AS j, {_r('var_pop(b.v)')} AS value FROM e a JOIN e b ON b.i BETWEEN a.i * 7 - 4 AND a.i * 7 AND b.j BETWEEN a.j * 5 - 5 AND a.j * 5 GROUP BY a.i, a.j")
def rolling_full_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances of windows that hang over both ends of both dimensions."""
    return rounded(rolling_stats(embeddings(spark, sf_dir), WindowConfig((5, 6), (7, 5), "full"), "var"))


@_query(f"WITH {_GAPS} SELECT CAST(a.event_id AS BIGINT) AS event_id, CASE WHEN count(b.v) FILTER (NOT isnan(b.v)) >= 4 THEN {_r('var_pop(b.v) FILTER (NOT isnan(b.v))', 6)} ELSE 'nan'::DOUBLE END AS value FROM (SELECT event_id, unnest(range(event_id - 6, event_id + 1)) AS cell FROM g) a JOIN g b ON b.event_id = a.cell GROUP BY 1")
def rolling_trailing_gaps_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling(events_with_gaps(spark, sf_dir), {"event_id": 7}, "var", min_periods=4, center=False)
    return rounded(out.df.select("event_id", F.col(out.values[0]).alias("value")))


@_query(f"WITH {_X} SELECT CAST(k AS BIGINT) AS idx, (k * 10 + 5) * 0.5::DOUBLE + 10 AS coord FROM (SELECT unnest(range(0, n // 10)) AS k FROM x)")
def block_center_coords_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blockwise(_labelled(spark, sf_dir), {"i": 10, "j": 8}, "mean", strict=False, coord="center")
    return out.coords["i"].select("idx", F.col("coord").cast("double").alias("coord"))


@_query(_values("stat, name, units", [("count", "u_count_blockwise", "1"), ("mean", "u_mean_blockwise", "m/s"), ("var", "u_var_blockwise", "(m/s)^2")]))
def result_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and units of results, as the column's metadata holds them."""
    g, rows = _labelled(spark, sf_dir), []
    for stat in ("count", "mean", "var"):
        out = blockwise(g, {"i": 10, "j": 8}, stat, strict=False)
        rows.append((stat, out.name, out.df.schema[out.name].metadata["units"]))
    return spark.createDataFrame(rows, "stat string, name string, units string")


@_query(f"WITH {_E}, {_X} " + " UNION ALL ".join(f"SELECT CAST({f} AS BIGINT) AS f_i, CAST({f} AS BIGINT) AS f_j, * FROM ({_blocks(f, f, _r('ln(sum(exp(v)))') + ' AS log_sum_exp')})" for f in (4, 8)))
def pairwise_merge_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's merge of two states, along the plan."""
    return rounded(reduce_stats(embeddings(spark, sf_dir), [4, 8], [log_sum_exp()]).to_dataframe())


@_query(f"SELECT CAST(event_id // 1000 AS BIGINT) AS k, count(*) AS n, {_r('avg(value)', 7)} AS mean FROM events GROUP BY 1")
def map_reduce_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    def partial(df):  # noqa: ANN001, ANN202
        own = df.groupby(df["event_id"] // 1000)["value"].agg(["count", "sum"]).reset_index()
        return own.set_axis(["k", "n", "s"], axis=1)

    def total(df: DataFrame) -> DataFrame:
        return df.groupBy("k").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))

    return rounded(map_reduce(_read(spark, sf_dir, "events").select("event_id", "value"), partial, "k long, n long, s double", total), 7)


@_query(f"WITH {_E}, {_X} {_blocks(20, 16, _MV)}")
def lazy_plan_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named plan: blocks, a merge of them, their statistics."""
    g, stats = embeddings(spark, sf_dir), [Mean(), Var()]
    plan = LazyPlan()
    plan.add("values", "stats", lambda state: materialize(state, g.dims, stats), "coarse")
    plan.add("coarse", "merge", lambda state: coarsen(state, g.dims, (g.extent[0] // 10, 8), (2, 2), stats, True), "blocks")
    plan.add("blocks", "window", lambda cells: base_reduce(replace(g, df=cells), (10, 8), stats), "cells")
    return rounded(plan.execute("values", cells=g.df))


_BACKENDS = ("serial", "threaded", "distributed", "mpi", "gpu", "jax", "dask")


@_query(f"WITH {_E}, {_X} SELECT * FROM ({_blocks(50, 32, _MV)}), (VALUES {', '.join(f'({chr(39)}{b}{chr(39)})' for b in _BACKENDS)}) b(backend)")
def backends_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks by every backend's name."""
    g = embeddings(spark, sf_dir)
    frames = [reduce_stats(g, (50, 32), backend=b)[50, 32].withColumn("backend", F.lit(resolve_backend(b).name)) for b in _BACKENDS]
    return rounded(reduce(DataFrame.unionByName, frames))


@_query(f"WITH {_P}, {_X} SELECT CAST(i // 15 AS BIGINT) AS i, CAST(j // 8 AS BIGINT) AS j, {_r('covar_samp(x, y)')} AS cov FROM p, x WHERE i % 3 <> 0 AND i < n // 15 * 15 GROUP BY ALL")
def inverse_merge_cov_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mirrored_pair(spark, sf_dir)
    part = replace(g, df=g.df.where(F.col("i") % 3 == 0), dense=False)
    states = [base_reduce(x, (15, 8), [Cov()]) for x in (g, part)]
    return rounded(materialize(inverse_merge(*states, g.dims, [Cov()]), g.dims, [Cov()]))


@_query(f"WITH x AS (SELECT max(event_id) + 1 AS n FROM events) SELECT CAST(event_id // 60 AS BIGINT) AS event_id, {_r('avg(value)')} AS m1, {_r('avg(value * value)', 4)} AS m2 FROM events, x WHERE event_id % 3 <> 0 AND event_id < n // 60 * 60 GROUP BY ALL")
def inverse_merge_moments_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir)
    part = replace(g, df=g.df.where(F.col("event_id") % 3 == 0), dense=False)
    states = [base_reduce(x, (60,), [Moments(2)]) for x in (g, part)]
    df = materialize(inverse_merge(*states, g.dims, [Moments(2)]), g.dims, [Moments(2)])
    return df.select("event_id", (F.round("m1", 6) + 0.0).alias("m1"), (F.round("m2", 4) + 0.0).alias("m2"))


_WIDE = "WINDOW f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 899 FOLLOWING)"


@_query(
    f"WITH x AS (SELECT max(event_id) + 1 AS n FROM events), w AS (SELECT event_id AS k, {_r('avg(value) OVER f', 7)} AS mean, {_r('var_samp(value) OVER f', 6)} AS var, {_r('min(value) OVER f', 7)} AS min, {_r('max(value) OVER f', 7)} AS max, count(*) OVER f AS count FROM events {_WIDE}) SELECT CAST(k // 3 AS BIGINT) AS event_id, mean, var, min, max, count FROM w, x WHERE k % 3 = 0 AND k <= n - 900"
)
def queued_wide_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 900 cells, each merged from what is left of one block and the beginning of the next."""
    result = reduce_stats(events(spark, sf_dir), Sliding(900, 3), [Mean(), Var(), Min(), Max(), Count()])
    df = result[result.factors[0]]
    return df.select("event_id", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("mean", 7), ("var", 6), ("min", 7), ("max", 7))], "count")


_HOLES = f"{_E}, h AS (SELECT i, j, CASE WHEN (i * 64 + j) % 5 < 2 OR (i % 50 < 20 AND j BETWEEN 8 AND 30) THEN NULL ELSE v END AS v FROM e)"


def embeddings_with_holes(spark: SparkSession, sf_dir: str) -> Grid:
    """The embeddings, two cells of five NaN, and a box of every fifty rows."""
    g = embeddings(spark, sf_dir)
    hole = ((F.col("i") * 64 + F.col("j")) % 5 < 2) | ((F.col("i") % 50 < 20) & F.col("j").between(8, 30))
    return replace(g, df=g.df.select("i", "j", F.when(hole, F.lit(float("nan"))).otherwise(F.col("v")).alias("v")))


@_query(f"WITH {_HOLES} SELECT CAST(a.i AS BIGINT) AS i, CAST(a.j AS BIGINT) AS j, CASE WHEN count(b.v) >= 40 THEN {_r('stddev_pop(b.v)')} ELSE 'nan'::DOUBLE END AS value FROM e a JOIN h b ON b.i BETWEEN a.i - 20 AND a.i + 20 AND b.j BETWEEN a.j - 7 AND a.j + 7 GROUP BY a.i, a.j")
def queued_gaps_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations over both axes that leave NaN out, so that counts differ, without expansion of cells."""
    out = rolling(embeddings_with_holes(spark, sf_dir), {"i": 41, "j": 15}, "std", min_periods=40)
    return rounded(out.df.select("i", "j", F.col(out.values[0]).alias("value")))


@_query(
    "WITH s AS (SELECT event_id, value, abs(value - lag(value) OVER (ORDER BY event_id)) AS step FROM events), x AS (SELECT max(event_id) + 1 AS n FROM events), w AS (SELECT event_id AS k, sum(step) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 199 FOLLOWING) AS steps, sum(exp(value / 100)) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) AS e FROM s) "
    f"SELECT CAST(k // 2 AS BIGINT) AS event_id, {_r('steps', 5)} AS variation, {_r('ln(e)', 6)} AS log_sum_exp FROM w, x WHERE k % 2 = 0 AND k <= n - 200"
)
def queued_users_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' states in windows: only their merge is known, and one of them depends on the order."""
    g = events(spark, sf_dir)
    args = Sliding(200, 2)
    steps = reduce_stats(g, args, [total_variation()])
    scaled = reduce_stats(replace(g, df=g.df.select("event_id", (F.col("value") / 100).alias("value"))), args, [log_sum_exp()])
    df = steps[steps.factors[0]].join(scaled[scaled.factors[0]], "event_id")
    return df.select("event_id", (F.round("variation", 5) + 0.0).alias("variation"), (F.round("log_sum_exp", 6) + 0.0).alias("log_sum_exp"))


@_query(f"WITH x AS (SELECT max(event_id) + 1 AS n FROM events), s AS (SELECT event_id // 37 AS k, CASE WHEN event_id % 37 > 0 THEN abs(value - lag(value) OVER (ORDER BY event_id)) ELSE 0 END AS step FROM events) SELECT CAST(k AS BIGINT) AS event_id, {_r('sum(step)', 5)} AS variation FROM s, x WHERE k < n // 37 GROUP BY k")
def fold_in_order_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-sensitive merge of the cells of a block, folded by position in balanced rounds."""
    g, stats = events(spark, sf_dir), [total_variation()]
    return rounded(materialize(coarsen(base_reduce(g, (1,), stats), g.dims, g.extent, (37,), stats), g.dims, stats), 5)


@_query(f"WITH {_L} SELECT CAST(l_orderkey // 100 AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS count, {_r('avg(l_quantity) + 1000000', 4)} AS mean, {_r(_sample('stddev_samp', 'l_quantity'), 6)} AS std FROM lineitem, x WHERE l_orderkey < a // 100 * 100 GROUP BY ALL")
def offset_merge_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unequal counts merged by their binary digits; a million on top of each value takes no digit of the deviation."""
    g = lineitems(spark, sf_dir, "l_quantity")
    g = replace(g, df=g.df.withColumn("l_quantity", F.col("l_quantity").cast("double") + 1_000_000))
    stats = [Count(), Mean(), Std()]
    df = materialize(coarsen(base_reduce(g, (4, 1), stats), g.dims, (g.extent[0] // 4, g.extent[1]), (25, 1), stats), g.dims, stats)
    return df.select("l_orderkey", "l_linenumber", "count", (F.round("mean", 4) + 0.0).alias("mean"), (F.round("std", 6) + 0.0).alias("std"))


def _line_scales(factors: Sequence[int], table: str, key: str, columns: str, extent: str) -> str:
    parts = [f"SELECT CAST({f} AS BIGINT) AS f_{key}, CAST({key} // {f} AS BIGINT) AS {key}, {columns} FROM {table}, x WHERE {key} < n // {f} * {f} GROUP BY ALL" for f in factors]
    return f"WITH {extent} " + " UNION ALL ".join(parts)


_HOLED = "count(v) AS count, coalesce(" + _r("avg(v)") + ", 'nan'::DOUBLE) AS mean, CASE WHEN count(v) > 1 THEN " + _r("var_samp(v)") + " ELSE 'nan'::DOUBLE END AS var"


@_query(f"WITH {_HOLES}, {_X} " + " UNION ALL ".join(f"SELECT CAST({f} AS BIGINT) AS f_i, CAST({f} AS BIGINT) AS f_j, * FROM ({_blocks(f, f, _HOLED, 'h')})" for f in (3, 6, 12)))
def tower_gaps_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scales of a field with gaps from one pass: blocks of unequal counts are merged."""
    return rounded(reduce_stats(embeddings_with_holes(spark, sf_dir), [3, 6, 12], [Count(), Mean(), Var()], skipna=True).to_dataframe())


@_query(_line_scales([4, 8, 40], "lineitem", "l_orderkey", f"count(*) AS count, {_r('sum(l_quantity)', 2)} AS sum, {_r(_sample('stddev_samp', 'l_quantity'), 6)} AS std, {_r('max(l_quantity)', 2)} AS max", "x AS (SELECT max(l_orderkey) + 1 AS n FROM lineitem)"))
def tower_sparse_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scales of a sparse line, whose cells repeat, from one pass."""
    g = Grid.from_table(_read(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")), ["l_orderkey"], ["l_quantity"])
    df = reduce_stats(g, [4, 8, 40], [Count(), Sum(), Std(), Max()]).to_dataframe()
    return df.select("f_l_orderkey", "l_orderkey", "count", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("sum", 2), ("std", 6), ("max", 2))])


@_query(f"WITH {_E}, {_X} " + " UNION ALL ".join(f"SELECT CAST({f} AS BIGINT) AS f_i, CAST(64 AS BIGINT) AS f_j, * FROM ({_blocks(f, 64, _r('median(v)') + ' AS median')})" for f in (50, 100, 500)))
def median_scales_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of thousands of cells at three scales, selected in the same rounds of histograms."""
    return rounded(median_scales(embeddings(spark, sf_dir), [(50, 64), (100, 64), (500, 64)]))


@_query(f"SELECT l_linestatus, {_r('median(l_extendedprice * (1 - l_discount) - 20000)', 6)} AS median FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, {_r('median(l_extendedprice * (1 - l_discount) - 20000)', 6)} FROM lineitem")
def median_of_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection among values of both signs, by group and over the whole table."""
    price = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double")) - 20000
    rows = _read(spark, sf_dir, "lineitem").select("l_linestatus", price.alias("price"))
    whole = window_stat(rows, "price", "median").select(F.lit(None).cast("string").alias("l_linestatus"), "median")
    return rounded(window_stat(rows, "price", "median", ["l_linestatus"]).unionByName(whole), 6)


def _kept(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/cellweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@_query(_line_scales([10, 50, 250], "events", "event_id", f"count(*) AS count, {_r('avg(value)', 7)} AS mean, {_r(_sample('var_samp', 'value'), 6)} AS var, {_r('max(value)', 7)} AS max", "x AS (SELECT max(event_id) + 1 AS n FROM events)"))
def incremental_tower_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in four batches, each merged into the parts of the tower that it touches."""
    g = events(spark, sf_dir)
    tower = IncrementalTower(_kept(spark, "tower"), g.dims, g.extent, [10, 50, 250], [Count(), Mean(), Var(), Max()], g.values, boxes=20)
    for k in range(4):
        tower(g.df.where(F.expr("event_id div 300") % 4 == k), k)
    df = tower.result(spark)
    return df.select("f_event_id", "event_id", "count", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("mean", 7), ("var", 6), ("max", 7))])


@_query(_scales([(2, 4), (4, 4), (8, 16)], _MV))
def stored_lattice_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales merged from the stored state of an earlier request instead of the cells."""
    g = embeddings(spark, sf_dir)
    lattice = Lattice(spark, _kept(spark, "lattice"))
    first = lattice.reduce_stats(g, [(2, 4)], [Mean(), Var(), Count()]).to_dataframe().drop("count")
    return rounded(first.unionByName(lattice.reduce_stats(g, [(4, 4), (8, 16)]).to_dataframe()))


def _blocks_3d(a: int, b: int, c: int, columns: str) -> str:
    keys = ", ".join(f"CAST({d} // {f} AS BIGINT) AS {d}" for d, f in (("i", a), ("j0", b), ("j1", c)))
    factors = ", ".join(f"CAST({f} AS BIGINT) AS f_{d}" for d, f in (("i", a), ("j0", b), ("j1", c)))
    return f"SELECT {factors}, {keys}, {columns} FROM g, x WHERE i < n // {a} * {a} AND j0 < 8 // {b} * {b} AND j1 < 8 // {c} * {c} GROUP BY ALL"


@_query(f"WITH {_E3}, {_X} " + " UNION ALL ".join(_blocks_3d(a, b, c, f"count(*) AS count, {_MV}, {_r('max(v)')} AS max") for a, b, c in ((4, 4, 1), (8, 4, 2), (10, 3, 4))))
def chunked_scales_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a field of three dimensions: two scales that they hold, and one whose blocks cross them."""
    chunks = Chunks.from_grid(embeddings_3d(spark, sf_dir), (64, 4, 4))
    return rounded(chunks.reduce_stats([(4, 4, 1), (8, 4, 2), (10, 3, 4)], [Count(), Mean(), Var(), Max()]).to_dataframe())


@_query(f"WITH {_P}, {_X} " + " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS f_i, CAST({b} AS BIGINT) AS f_j, * FROM ({_blocks(a, b, _r('covar_samp(x, y)') + ' AS cov', 'p')})" for a, b in ((5, 4), (12, 10))))
def chunked_cov_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields in chunks; pieces of blocks that cross them are merged by their counts."""
    return rounded(Chunks.from_grid(mirrored_pair(spark, sf_dir), (40, 16)).reduce_stats([(5, 4), (12, 10)], [Cov()]).to_dataframe())


@_query(f"WITH {_E}, {_X} {_slid(21, 9, 2, 1, 3, 0, _MV + ', ' + _r('min(v)') + ' AS min')}")
def chunk_borders_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows over chunks, to which only the borders of the next chunks come."""
    return rounded(Chunks.from_grid(embeddings(spark, sf_dir), (50, 16)).sliding(Sliding((21, 9), (2, 1), (3, 0)), [Mean(), Var(), Min()]))


@_query(f"WITH {_E}, {_X}, k AS (SELECT i AS a, j AS b FROM e WHERE i % 25 = 0) SELECT CAST(a // 25 AS BIGINT) AS i, CAST(b AS BIGINT) AS j, {_r('avg(v)')} AS mean FROM k, x JOIN e ON (e.i - a + n) % n < 10 AND (e.j - b + 64) % 64 < 5 GROUP BY a, b")
def chunk_borders_periodic_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that wrap round both ends of both dimensions."""
    return rounded(Chunks.from_grid(embeddings(spark, sf_dir), (50, 16)).sliding(Sliding((10, 5), (25, 1)), [Mean()], periodic=True, strict=False))


@_query(f"WITH {_E} SELECT CAST(i // 8 AS BIGINT) AS i, CAST(j // 8 AS BIGINT) AS j, {_MV} FROM e WHERE i >= 96 AND i < 304 AND j >= 16 AND j < 48 GROUP BY ALL")
def tiled_box_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a field stored in tiles along a space-filling curve: other tiles' folders aren't read."""
    path = _kept(spark, "tiled")
    write_tiled(embeddings(spark, sf_dir), path, (32, 16))
    return rounded(reduce_stats(read_tiled(spark, path, (96, 16), (304, 48)), 8)[8, 8])


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return tower_mean_var_2d(spark, sf_dir)


__all__ = ["Median", "ORACLES", "QUERIES", "entry"]
