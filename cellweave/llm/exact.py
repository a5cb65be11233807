"""Exact deduplication as a stream with keyed state that never expires.

Documents arrive as files of a Parquet folder (or one file).  A Structured Streaming query keeps,
in RocksDB on the executors' disks and in the shared folder, one state row for each digest (SHA-256 of
the text's bytes): how many rows had it, and the stable identifier and content locator (file and row in
it) of the row that stays, the one with the largest doc_id.  There is no watermark, so a text seen
in the first batch is known in the last.  Copies are combined by each task before they reach the state,
so a text that a third of all rows hold costs a state row for each task.  Every run takes what is new
since the last one, in batches of ``files_per_batch`` files, and goes on from its checkpoint after a failure; a
batch that is repeated overwrites what it wrote.

A digest met again is a hit, and hits are checked on full bytes: the content is read at its locator, texts of
the hits are combined by digest and whole text (equal ones inside each task), and each is compared
with the content.  Where one differs the digest is not trusted: its rows are grouped by their texts.
Which rows can be hits is told before the shuffle by a bitmap of fixed size (``FILTER_BITS``) that is
broadcast; its false positives cost a comparison, and it has no false negatives.

Edge cases: a null text counts as empty, and empty texts are copies of each other; a null doc_id is smaller than
all others; of rows with equal text and equal largest doc_id, the one with the largest locator stays,
so exactly one row of a group does; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _runtime as R

#: Bits of the broadcast bitmap: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
_PAGE = 1 << 15  # bits of one row of it

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a store for each partition, and each would reserve megabytes
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass(frozen=True)
class Deduplicator:
    """A folder of documents, the folder of its state, and the digest that keys it."""

    spark: SparkSession
    path: str
    state: str
    files_per_batch: int | None = None
    digest: Callable[[Column], Column] = sha256

    def _shaped(self, df: DataFrame) -> DataFrame:
        """Digest, id and locator of every row, and its text."""
        at = df.metadataColumn("_metadata")
        text = F.coalesce(F.col("text"), F.lit(""))
        return df.select(self.digest(text).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), at["file_path"].alias("file"), at["row_index"].alias("row"), text.alias("text"))

    def rows(self) -> DataFrame:
        return self._shaped(self.spark.read.parquet(self.path))

    def absorb(self) -> None:
        """Takes all files that the state has not seen, a batch at a time."""
        source = self.spark.readStream.schema(self.spark.read.parquet(self.path).schema)
        if self.files_per_batch:
            source = source.option("maxFilesPerTrigger", self.files_per_batch)
        arriving = self._shaped(source.parquet(_folder_or_glob(self.spark, self.path)))
        state = arriving.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))

        def hits(batch: DataFrame, k: int) -> None:
            met = batch.where(F.col("n") > 1).select("digest", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))
            met.write.mode("overwrite").parquet(f"{self.state}/hits/batch={k}")

        with _settings(self.spark, _STORE):
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.state}/checkpoint").foreachBatch(hits).trigger(availableNow=True).start()
        query.awaitTermination()

    def groups(self) -> DataFrame:
        """digest, n, keep_id, keep_file, keep_row of every digest that came more than once, as the state has it now."""
        last = F.max(F.struct("n", "keep_id", "keep_file", "keep_row")).alias("now")
        kind = "digest binary, n long, keep_id long, keep_file string, keep_row long"
        try:
            found = self.spark.read.schema(kind).parquet(f"{self.state}/hits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], kind)  # no batch so far
        return found.groupBy("digest").agg(last).select("digest", "now.*")

    def refuted(self, groups: DataFrame) -> DataFrame:
        """Digests among ``groups`` whose rows are not all the bytes at the group's locator."""
        rows = self.rows()
        copies = _may_hold(rows, "digest", groups, "digest").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("copies"))
        at = ["keep_file", "keep_row"]
        content = _may_hold(rows.withColumnsRenamed({"file": "keep_file", "row": "keep_row"}), at, groups, at).join(groups, ["digest", *at]).select("digest", F.col("text").alias("content"))
        missed = F.col("content").isNull() | (F.col("text") != F.col("content"))
        return groups.select("digest").join(copies, "digest").join(content, "digest", "left").where(missed).select("digest").distinct()

    def assigned(self) -> DataFrame:
        """A row for every document: doc_id, keep_id, group_size, kept, text_sha256."""
        groups = R.written(self.groups(), "groups")
        refuted = R.written(self.refuted(groups), "refuted")
        rows = self.rows().withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        if refuted.isEmpty():
            return _resolved(rows.drop("text"), groups, ["digest"])
        trusted = _resolved(rows.join(refuted, "digest", "left_anti").drop("text"), groups, ["digest"])
        apart = rows.join(refuted, "digest", "left_semi")
        by_text = apart.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
        by_text = by_text.where(F.col("n") > 1).select("text", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))
        return trusted.unionByName(_resolved(apart, by_text, ["text"]))


def _resolved(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The groups' answers joined to their rows: a hot group's rows can be dealt to many tasks."""
    both = rows.join(groups, by, "left")
    alone = F.col("n").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")))).alias("kept"),
        "text_sha256",
    )


def _may_hold(rows: DataFrame, key: str | list[str], known: DataFrame, known_key: str | list[str]) -> DataFrame:
    """Rows whose key may be among the known ones, told by a broadcast bitmap of at most FILTER_BITS."""

    def place(names: str | list[str]) -> Column:
        return F.pmod(F.xxhash64(*([names] if isinstance(names, str) else names)), F.lit(FILTER_BITS))

    pages = known.select(place(known_key).alias("p")).groupBy(F.expr(f"p div {_PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("p") % _PAGE).alias("bits"))
    placed = rows.withColumn("p", place(key)).withColumn("page", F.expr(f"p div {_PAGE}")).join(F.broadcast(pages), "page")
    bit = F.col("p") % _PAGE
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return placed.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def _folder_or_glob(spark: SparkSession, path: str) -> str:
    """Streams read folders; a single file is one as a pattern that only its own name matches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return f"{path[:-1]}[{path[-1]}]"
    return path


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings that a stream takes over when it starts."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def deduplicate(spark: SparkSession, path: str, state: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Streams a Parquet table through the state kept in ``state`` (a new one in the shared folder unless named) and assigns every row."""
    R.prepare(spark)
    own = Deduplicator(spark, path, state or R.folder(spark, f"exact-{uuid.uuid4().hex}"), files_per_batch)
    own.absorb()
    return own.assigned()
