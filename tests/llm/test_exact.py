import hashlib
from collections import defaultdict

import pytest
from helpers import SCHEMA, corpus
from pyspark.sql import functions as F

from cellweave.llm import exact


def want(rows):
    """Row count, kept rows and answers by brute force; rows are (doc_id, text)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(df, rows):
    got = df.collect()
    expected, groups = want(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.fixture
def table(spark, tmp_path):
    rows = corpus(11)
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(7)).withColumn("file", F.lit("x")).withColumn("_metadata", F.lit(1)).repartition(5, "doc_id").write.parquet(path)
    return path, [(r[0], r[1]) for r in rows]


def test_equals_brute_force_with_repeats_nulls_and_clashing_names(spark, table):
    check(exact.deduplicate(spark, table[0]), table[1])


def test_small_batches_and_later_files(spark, table, tmp_path):
    path, rows = table
    own = exact.Deduplicator(spark, path, f"file://{tmp_path}/state", files_per_batch=1)
    own.absorb()
    check(own.assigned(), rows)
    more = [(10_000, rows[0][1]), (10_001, "new"), (None, ""), (10_002, None)]
    kind = spark.read.parquet(path).schema
    spark.createDataFrame(more, "doc_id long, text string").select(*[F.col(f.name) if f.name in ("doc_id", "text") else F.lit(None).cast(f.dataType).alias(f.name) for f in kind]).write.mode("append").parquet(path)
    exact.Deduplicator(spark, path, f"file://{tmp_path}/state", files_per_batch=1).absorb()  # another run, from the checkpoint
    check(own.assigned(), rows + more)
    before = own.groups().collect()
    own.absorb()  # nothing new
    assert sorted(map(str, own.groups().collect())) == sorted(map(str, before))


def test_state_is_kept_for_every_digest(spark, table, tmp_path):
    path, rows = table
    own = exact.Deduplicator(spark, path, f"file://{tmp_path}/state")
    own.absorb()
    state = spark.read.format("statestore").load(f"file://{tmp_path}/state/checkpoint")
    assert state.count() == len({t or "" for _, t in rows})


def test_a_digest_that_collides_is_told_by_full_bytes(spark, table, tmp_path):
    path, rows = table
    weak = exact.Deduplicator(spark, path, f"file://{tmp_path}/state", digest=lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(40)).cast("string").cast("binary"))
    weak.absorb()
    assert weak.refuted(weak.groups()).count() > 10
    check(weak.assigned(), rows)


def test_bitmap_has_no_false_negatives_and_few_false_positives(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("k"), "id")
    got = exact._may_hold(rows, "k", rows.where("id % 10 = 0"), "k").select("id").collect()
    ids = {r.id for r in got}
    assert {i for i in range(0, 20_000, 10)} <= ids and len(ids) < 2_050


def test_empty_and_single_file_tables(spark, tmp_path):
    path = f"file://{tmp_path}/none.parquet"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert exact.deduplicate(spark, path).count() == 0
    import pyarrow as pa
    import pyarrow.parquet as pq

    one = f"{tmp_path}/one.parquet"
    pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": ["a", None, "a"]}), one)
    check(exact.deduplicate(spark, f"file://{one}"), [(1, "a"), (2, None), (3, "a")])


def test_settings_are_left_as_they_were(spark, table):
    before = {k: spark.conf.get(k, None) for k in exact._STORE}
    exact.deduplicate(spark, table[0]).count()
    assert {k: spark.conf.get(k, None) for k in exact._STORE} == before
