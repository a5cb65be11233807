"""The corpus pipeline: documents through five operators of cellweave.llm, a table between stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes every stage's
result to the shared folder and reads it back as the next one's docs, so a lost executor
repeats one stage at most.  Rows are judged one by one: a null text is clean, is no copy of
anything and passes through to the last stage, where it counts as empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import _runtime as R
from cellweave.llm import decontaminate, jaccard, pieces, substrings, toxicity
from cellweave.llm.queries import tokenizer_path


#: Tables that the last stage wrote on its way; the next one starts when its result is written.
_ON_THE_WAY: list[str] = []


def _release(spark: SparkSession) -> None:
    R.release(spark, _ON_THE_WAY)
    _ON_THE_WAY.clear()


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, deleting what the one before it left in the shared folder."""

    @functools.wraps(run)
    def started(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release(spark)
        before = set(R.tables())
        out = run(spark, docs, sf_dir)
        _ON_THE_WAY.extend(path for path in R.tables() if path not in before)
        return out

    return started


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the rows that are here and keeps what scores under 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels), 0.7)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group joined by a Jaccard similarity of 0.75 or more: the least id's."""
    return jaccard.representatives(docs)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also start in a document with a smaller id; a text of nothing else goes."""
    return substrings.without_repeats(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids with an end id, their number, whether they decode to the text, and the source byte where each piece starts and the last one stops."""
    rows = pieces.encode(docs.select("doc_id", "lang", "source", "text", F.coalesce(F.col("text"), F.lit("")).alias("was")), tokenizer_path(), keep=("doc_id", "lang", "source", "was"))
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("was")).alias("round_trip"), "offsets")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", drop_contaminated),
    ("pieces", encode),
]

#: A fitted model and a tokenizer are among the stages, so no SQL gives these rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, R.written(stage(spark, docs, sf_dir), name)
        if k:
            R.drop(last)
    _release(spark)
    return docs
