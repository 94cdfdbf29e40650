"""Approximate nearest neighbours by a permutation index.

A vector is represented by the ordered list of its ``length`` nearest pivots; the pivots are the same everywhere. Rows are
dealt once into shards of at most about ``block`` rows (``least`` or more, unless there are fewer in all), and a shard keeps a pivot inverted file: per pivot, the place at
which each of its vectors lists it (``length`` if it doesn't). A query is sent to every shard, reads the postings of
its own ``ask`` nearest pivots, ranks the shard by the footrule distance over them, and the best ``share`` of the shard is
reranked by the inner product in double precision. A shard returns k rows a query; the best k of all are the answer.

A shard is read in one stream, its rows first and then the queries batch by batch, so a task holds one shard and one batch,
and no row is copied. Rows are dealt by a number of their own, so neither repeated ids nor equal vectors gather in a shard.
The pivots are the ``pivots`` vectors with the smallest hashes, a bounded sample; every row is indexed. Orders are by angle, and the
largest inner product is the smallest angle once every vector x has one more component, sqrt(M^2 - |x|^2) with M the largest length
of all, and a query 0 there; so long vectors, which are near many queries, lie near them in the index as well.

Defined cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor
do rows with a null id; a query is compared with vectors of its own length only, through the index for the most frequent length of
the pivots and with all of its shard for others; fewer candidates than k give
them all; equal scores go to the smaller id; rows that repeat an id are candidates each but are never neighbours of their
own id, and a repeated query id asks once, with its smallest vector; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

RESULT = "query_id long, vec_id long, score double"
STEP = 4096  # rows whose nearest pivots are looked for at once


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v and a number of its own for every row that takes part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    return rows.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id())


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each vector by cosine, nearest first, ties to the smaller pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :length]


def longer(vectors: np.ndarray, most: float | None) -> np.ndarray:
    """Vectors with the component that turns inner products into angles; 0 for queries (None) and for what is as long as ``most``."""
    square = np.square(vectors).sum(1)
    more = np.zeros(len(vectors)) if most is None else np.sqrt(np.maximum(0, most * most - square))
    return np.column_stack([vectors, more])


class PivotFile:
    """The inverted file of one shard. ``places[p]`` is the posting list of pivot p, one place for each vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, length: int, most: float = 0.0):
        self.ids, self.vectors, self.pivots = ids, vectors, pivots
        length = min(length, len(pivots))
        self.places = np.full((len(pivots), len(ids)), length, np.int16)
        for at in range(0, len(ids), STEP):
            nearest_ = orders(longer(vectors[at : at + STEP], most), pivots, length)
            self.places[nearest_, at + np.arange(len(nearest_))[:, None]] = np.arange(length, dtype=np.int16)

    def search(self, query_id: int, query: np.ndarray, pivots: np.ndarray, k: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best k for a query whose nearest pivots are ``pivots``."""
        footrule = np.zeros(len(self.ids), np.int16)
        for j, p in enumerate(pivots):
            footrule += np.abs(self.places[p] - np.int16(j))
        near = np.argsort(footrule, kind="stable")[:keep]
        near = near[self.ids[near] != query_id]
        score = self.vectors[near] @ query
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near[best]], score[best]


def _tables(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of a batch by the length of the vector."""
    ids, v = batch.column("vec_id").to_numpy(), batch.column("v")
    values, lengths = v.flatten().to_numpy(), v.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return {int(lengths[0]): (ids, values.reshape(-1, lengths[0]))}
    starts = np.cumsum(lengths) - lengths
    return {int(n): (ids[at], values[starts[at][:, None] + np.arange(n)]) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}


def nearest(
    vectors: DataFrame, is_query: str, k: int = 20, pivots: int = 256, length: int = 128, ask: int = 64, share: float = 0.25,
    block: int = 65_536, least: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` (SQL over vec_id, v) holds."""
    rows = materialise(usable(vectors, id_col, vec_col), "vectors")
    sample = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(pivots).collect()]  # bounded by `pivots`
    if not sample:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    widths = [len(v) for v in sample]
    width = max(widths, key=lambda n: (widths.count(n), n))
    most = rows.where(F.size("v") == width).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    most = most if np.isfinite(most) else 0.0  # too long for squares: ordered by their own angles
    heads = longer(np.array([v for v in sample if len(v) == width]), most)
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    # a query is copied to every shard, so there are no more of them than rows or cores call for
    total, tasks = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-total // block), min(-(-total // least), tasks), 1)
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    own = rows.select(shard, F.lit(0).alias("kind"), "vec_id", "v")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    dealt = own.union(asked.select(every, F.lit(1).alias("kind"), "vec_id", "v"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("kind", "vec_id", "v").drop("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = {}, None
        for batch in batches:
            first = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            for w, part in (_tables(batch.slice(0, first)) if first else {}).items():
                held.setdefault(w, []).append(part)
            if first == batch.num_rows or not held:
                continue
            if index is None:
                joined = {w: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for w, parts in held.items()}
                index = {w: PivotFile(*x, heads, length, most) if w == width else PivotFile(*x, np.zeros((1, w + 1)), 1) for w, x in joined.items()}
            for w, (ids, asking) in _tables(batch.slice(first)).items():
                if w not in index:
                    continue
                n = len(index[w].ids)
                keep = min(n, max(k + 1, int(np.ceil(share * n)))) if w == width else n
                ways = orders(longer(asking, None), heads, ask) if w == width else [[]] * len(ids)
                found = [index[w].search(q, x, p, k, keep) for q, x, p in zip(ids, asking, ways, strict=True)]
                columns = [np.repeat(ids, [len(f[0]) for f in found]), *(np.concatenate(x) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = dealt.mapInArrow(search, RESULT).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(vectors: DataFrame, is_query: str, k: int = 20, **options) -> DataFrame:
    """The true neighbours, by the same shards with nothing pruned: what recall is measured against."""
    return nearest(vectors, is_query, k, pivots=1, length=1, ask=1, share=1.0, **options)
