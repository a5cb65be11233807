"""The thin queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, jaccard, language, negatives, neighbours, pieces, preference, ranked, sharding, substrings, toxicity, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(n: int) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    profiles = language.learn(documents.where(_fold(5) != 0))
    rows = language.identify(documents.select("doc_id", "text"), profiles)
    return rows.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op2_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.learn(documents, _table(spark, sf_dir, "labels").where(_fold(3) != 1))
    rows = toxicity.score(documents, machine)
    return rows.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents"), n_shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]).cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(_table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "offsets")


def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), query_every=20, k=20)


def op8_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference.neighbours_paired(_table(spark, sf_dir, "conversations"))
    listed = {c: F.array_join(F.transform(c, lambda s: F.concat(s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))), ",") for c in ("chosen_spans", "rejected_spans")}
    return rows.select("pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", "chosen", listed["chosen_spans"].alias("chosen_spans"), "rejected", listed["rejected_spans"].alias("rejected_spans"))


def op10_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wrapper.extract(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_stateful_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op12_interval_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_profiles, op2_factorization, op3_virtual_slots, op4_decontaminate, op5_pieces, op6_debruijn, op7_additive, op8_metric_join, op9_preference, op10_wrapper, op11_stateful_stream, op12_interval_bounds, op13_multi_index)}
