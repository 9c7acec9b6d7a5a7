"""Queries over the training-data tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm import ann, bpe, decontaminate, licenses, line_dedup, near_dup, quality, shard, token_file, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law ``bytes``; see ``shard.shard_documents``."""
    placed = shard.shard_documents(table(spark, sf_dir, "documents"), shard.Sharding(shards=40, overhead=16))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read from the written files; see ``token_file``."""
    return token_file.token_index(table(spark, sf_dir, "documents"), token_file.TokenFiles(tokenizer_path(), end_id=2))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on two-word shingles; see ``near_dup.near_duplicates``."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.NearDup(shingle=2))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded digests of each document; see ``bpe.encode_decode``."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.Bpe(tokenizer_path()))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of each document; see ``licenses.scan``."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (positions of the lines that go, from 0) of every document."""
    docs = table(spark, sf_dir, "documents")
    drops = line_dedup.line_drops(docs)
    counts = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return counts.join(drops, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, edits, start of every benchmark item that a document holds; see ``decontaminate``."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of each row whose vec_id is divisible by 100; see ``ann.search``."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; see ``toxicity.score_documents``."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, keys and the sample of all documents; see ``quality.resample``."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_kk_sharding": op1_kk_sharding,
    "op2_token_files": op2_token_files,
    "op3_near_dup": op3_near_dup,
    "op4_bpe": op4_bpe,
    "op5_licenses": op5_licenses,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_ivf_pq": op8_ivf_pq,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {}
