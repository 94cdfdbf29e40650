"""The registered queries of the corpus operators: each applies one to its whole table and returns the contract's columns.

``ORACLE`` holds the SQL of those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import ORACLE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_ids import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), exact_words=50)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    some = F.size("places") > 0
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.when(some, F.array_min("places")).cast("long").alias("first_word"), F.when(some, F.array_max("places")).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import listed, scan

    found = scan(table(spark, sf_dir, "documents"))
    of = F.transform("base", lambda s: s["kind"])
    kinds = [(F.size(of) - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *kinds, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dups import similar

    return similar(table(spark, sf_dir, "embeddings"), 0.93)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    label, x = F.col("label"), F.col("embedding").cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.transform(x, lambda v: F.floor(256 * v)).alias("v")
    )
    return mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3)


ALL = (
    op1_token_ids, op2_passages, op3_near_dup, op4_warc, op5_licenses, op6_toxicity, op7_mixing, op8_decontaminate, op9_neighbours,
    op10_secrets, op11_embedding_dups, op12_ranked_search, op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in ALL}

__all__ = ["ORACLE", "QUERIES"]
