"""Helpers that the corpus operators share: shared scratch space, words, component labels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java character class of what separates words: the ASCII characters that are neither letters nor digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Largest number of ids (8 bytes each) that an operator broadcasts; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder, at most ``per_file`` rows a file if given, and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else unchanged; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def letter_words(text: Column) -> Column:
    """Lower-cased words made of ASCII letters, digits and anything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def space_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def keep_ids(df: DataFrame, key: str, ids: DataFrame, count: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one-column frame ``ids``; broadcast only below BROADCAST_IDS."""
    count = ids.count() if count is None else count
    ids = ids.toDF(key)
    return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, key, "left_semi")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` as ``(id, component)``, component the smallest id.

    Alternates large-star and small-star steps until the edges are stars around their smallest node. A step is an
    aggregation of each node's smallest neighbour and a join with it. The smallest neighbours are written first, so the
    join reads two plain exchanges and Spark splits the edges of a node with very many links over several tasks.
    Nodes without links don't appear.
    """
    upper, lower = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = materialise(links.where("a != b").select(upper, lower).distinct(), "edges")
    while not _stars(edges):
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = edges.union(turned).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = turned.join(materialise(low, "low"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        both = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(both).alias("e"))
        edges = materialise(small.select("e.*").where("u != v").distinct(), "edges")
    return edges.select("u", "v").union(edges.select("v", "v").distinct()).toDF("id", "component")


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges(u, v)``, u above v, is the upper end of one edge or the lower end of any number."""
    upper = F.struct(F.col("u").alias("id"), F.lit(1).alias("upper"), F.lit(0).alias("lower"))
    lower = F.struct(F.col("v").alias("id"), F.lit(0).alias("upper"), F.lit(1).alias("lower"))
    nodes = edges.select(F.explode(F.array(upper, lower)).alias("end")).groupBy("end.id")
    return (nodes.agg((F.sum("end.upper") + F.max("end.lower")).alias("n")).agg(F.max("n")).first()[0] or 1) == 1
