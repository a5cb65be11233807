"""Cutting lineage between rounds of an iterative job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset, one of a local master's own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read back, so that a lost executor doesn't repeat what it took."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cellweave/{spark.sparkContext.applicationId}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
