"""Queries over tables whose numbers of rows no block or chunk divides equal their SQL."""

import numpy as np
import pytest

from cellweave.queries import ORACLES, QUERIES

NAMES = ["block_median_2d", "chunk_borders_periodic_2d", "tiled_partials_2d"]


@pytest.mark.parametrize("n", [57, 73])
@pytest.mark.parametrize("name", NAMES)
def test_uneven_rows_equal_sql(spark, tmp_path, name, n):
    import duckdb

    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    spark.createDataFrame(zip(range(n), x.tolist(), strict=True), "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).df().sort_values(["i", "j"], ignore_index=True)
    got = QUERIES[name](spark, f"file://{tmp_path}").toPandas().sort_values(["i", "j"], ignore_index=True)
    assert len(got) == len(want) > 0 and set(got.columns) == set(want.columns)
    np.testing.assert_allclose(got[want.columns].to_numpy(float), want.to_numpy(float), rtol=0, atol=1.1e-6)
