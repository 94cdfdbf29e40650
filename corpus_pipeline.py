"""A training corpus from ``documents`` in five stages; each works on all that its predecessor kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. ``run`` writes what a stage returns as Parquet in the shared
folder and reads it as the next stage's docs. All but the last return the columns of ``documents``.

Defined cases, of all stages: extra columns are dropped, whatever their names; an empty table gives an empty one; texts are
taken whole. Null and empty texts are scored as texts without words (toxicity), are nobody's copy (near_dedup), hold no
benchmark item (decontamination), have size 0 (mixing) and become the end id alone (token_ids).

* toxicity: rows that repeat an id are judged each by its own text, those with a null id as well.
* near_dedup: of ties the smallest id stays; rows that repeat an id stay or go together; rows with a null id stay.
* decontamination: each row is judged by its own text, also where ids repeat or are null.
* mixing: rows that repeat id and text are taken together; ties end by id and text; a null source is a source of its own.
* token_ids: rows are in ascending order of id, null first, repeats each with their own ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialise
from tidewater.llm.decontaminate import contamination
from tidewater.llm.mixing import mix
from tidewater.llm.near_dup import near_duplicates
from tidewater.llm.token_ids import token_output
from tidewater.llm.toxicity import fit

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return fit(docs, labels).score(docs.select(COLUMNS)).where(F.col("score") < REJECT).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    gone = near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark).where("contaminated")
    hit = found.select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h"))
    return rows.join(hit, same, "left_anti").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes of it, none, one or two."""
    mixed = mix(docs, keep=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back."""
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: The classifier and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
