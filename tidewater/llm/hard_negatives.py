"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by angle. For a cluster, every candidate x has an upper bound on its inner product with any member of unit
length: |x| cos(max(0, angle(x, centroid) - widest angle of a member)). The candidates are sorted by that bound once for
the cluster, and every member walks the list in steps of ``step`` candidates, with exact scores, until it is certified to be done:
what it keeps can't be replaced, as its own length times the next bound lies below its worst, or below all that it may keep.
The members of a cluster walk together, so a step is one product of matrices over those that still walk.

Candidates are dealt by a number of their own into shards of about ``block`` rows; every anchor visits every shard, as a stream
ordered by cluster, and the best of all shards are kept by one window per anchor. There are two walks: the first for the positives,
the second, which needs their scores over all shards, for the negatives within each positive's range of scores.

Vectors are whole numbers and scores are exact: products run in double precision while lengths bound every sum below 2 ** 53, and in
whole numbers of any size otherwise. Centroids are fitted on at most ``sample`` anchors; they steer the order of a list and
never what is found.

Defined cases: rows with a null id, label or vector, or a vector with a null component, take no part; vectors of different
lengths are never compared; a repeated anchor id asks once, with its smallest (label, vector), and no row of the same id is its
positive or negative; rows that repeat an id are candidates each; equal scores go to the smaller id; fewer than asked give all;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
EXACT = float(1 << 53)


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zeros stay) and lengths."""
    size = np.sqrt(np.square(v.astype(float)).sum(1))
    return v / np.where(size > 0, size, 1)[:, None], size


def centroids(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; always the same for the same rows."""
    u = units(v)[0]
    heads = u[np.linspace(0, len(u) - 1, min(k, len(u))).astype(int)]
    for _ in range(rounds):
        own = (u @ heads.T).argmax(1)
        sums = np.zeros_like(heads)
        np.add.at(sums, own, u)
        heads = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, units(sums)[0], heads)
    return heads


class Shard:
    """The candidates of one length in one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.u, self.size = units(v)
        self.f = v.astype(float)

    def listed(self, centre: np.ndarray | None, widest: float) -> tuple[np.ndarray, np.ndarray]:
        """The candidates by descending bound and their bounds."""
        bound = self.size
        if centre is not None:
            angle = np.arccos(np.clip(self.u @ centre, -1, 1))
            bound = self.size * np.cos(np.maximum(0, angle - widest - 1e-7))
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def scores(self, q: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.size[at].max(initial=0) * size.max(initial=0) < EXACT:
            return q.astype(float) @ self.f[at].T
        return q.astype(object) @ self.v[at].astype(object).T

    def walk(self, members: tuple, centre: np.ndarray | None, k: int, same: bool, asks: tuple, step: int) -> tuple[np.ndarray, ...]:
        """The best k for every ask: ask, id, score. ``members`` are ids, labels, v; ``asks`` the member, low and high of each."""
        (ids, labels, q), (of, low, high) = members, asks
        u, size = units(q)
        widest = float(np.arccos(np.clip(u @ centre, -1, 1)).max()) if centre is not None else np.pi
        order, bound = self.listed(centre, widest)
        slack = 1e-9 * float(size.max(initial=0)) * float(self.size.max(initial=0)) + 1e-6
        kept = (np.zeros(0, np.int64),) * 3
        walking = np.ones(len(of), bool)
        for at in range(0, len(order), step):
            most = np.where(bound[at] > 0, size[of] * bound[at], 0) + slack  # a bound below zero says no more than zero
            worst = np.full(len(of), -np.inf)
            full = np.bincount(kept[0], minlength=len(of)) >= k
            if len(kept[0]):
                last = np.flatnonzero(np.append(kept[0][1:] != kept[0][:-1], True))
                worst[kept[0][last]] = kept[2][last].astype(float)
            walking &= ~(full & (worst > most)) & (most >= low)
            if not walking.any():
                break
            part = order[at : at + step]
            active = np.unique(of[walking])
            score = self.scores(q[active], size[active], part)
            ask = np.flatnonzero(walking)
            row = np.searchsorted(active, of[ask])
            fits = (self.labels[part] == labels[of[ask]][:, None]) == same
            fits &= self.ids[part] != ids[of[ask]][:, None]
            mine = score[row]
            least = np.where(full, worst - np.abs(worst) * 1e-15, -np.inf)  # what is as good as the worst may have a smaller id
            fits &= ((mine >= low[ask][:, None]) & (mine <= high[ask][:, None]) & (mine >= least[ask][:, None])).astype(bool)
            i, j = np.nonzero(fits)
            ask_id, vec_id, value = np.append(kept[0], ask[i]), np.append(kept[1], self.ids[part[j]]), np.append(kept[2], mine[i, j].astype(np.int64))
            best = np.lexsort((vec_id, -value, ask_id))
            ask_id, vec_id, value = ask_id[best], vec_id[best], value[best]
            rank = np.arange(len(ask_id)) - np.searchsorted(ask_id, ask_id)
            kept = tuple(x[rank < k] for x in (ask_id, vec_id, value))
        return kept


def _deal(rows: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Both in one frame, a shard a partition: its candidates, then the anchors in the order of their clusters."""
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    own = rows.select(shard, F.lit(0).alias("kind"), F.lit(0).alias("cluster"), "vec_id", "label", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    more = [c for c in anchors.columns if c in ("places", "scores", "others")]
    asked = anchors.select(every, F.lit(1).alias("kind"), "cluster", "vec_id", "label", "v", *more)
    both = own.unionByName(asked, allowMissingColumns=True)
    return both.repartitionById(shards, "shard").sortWithinPartitions("kind", "cluster", "vec_id").drop("shard")


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray]:
    v = batch.column("v")
    values, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))[:-1]
    return np.split(values, ends)


def _by_width(parts: list[pa.RecordBatch]) -> dict[int, tuple]:
    """ids, labels, vectors and places among the rows of ``parts``, by the length of the vector."""
    table = pa.Table.from_batches(parts)
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    v = [x for b in parts for x in _vectors(b)]
    widths = np.array([len(x) for x in v])
    places = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    return {w: (ids[at], labels[at], np.array([v[k] for k in at]).reshape(len(at), w), at) for w, at in places.items()}


def _groups(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """kind or cluster (candidates are -1) and its batches, at most about ``most`` anchors at once."""
    key, held, n = None, [], 0
    for batch in batches:
        keys = np.where(batch.column("kind").to_numpy() == 0, -1, batch.column("cluster").to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and (keys[a] != key or key >= 0 and n >= most):
                yield key, held
                held, n = [], 0
            key = int(keys[a])
            held.append(batch.slice(a, b - a))
            n += b - a
    if held:
        yield key, held


def _search(heads: np.ndarray, k: int, same: bool, step: int, names: list[str]):
    """Per shard: the positives (``same``) or the negatives of each of its anchors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = {}
        for key, parts in _groups(batches):
            if key < 0:
                shard = {w: Shard(*x[:3]) for w, x in _by_width(parts).items()}
                continue
            table = pa.Table.from_batches(parts)
            for w, (ids, labels, q, at) in _by_width(parts).items():
                if w not in shard:
                    continue
                if same:
                    of, low, high = np.arange(len(ids)), np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
                else:
                    own = [table.column(c).take(pa.array(at)).to_pylist() for c in ("places", "scores", "others")]
                    of = np.repeat(np.arange(len(ids)), [len(p) for p in own[0]])
                    place, score, other = (np.array([x for p in c for x in p], np.int64) for c in own)
                    # 50 p <= 100 n <= 95 p in whole numbers of any size
                    low, high = (np.array(x, np.int64) for x in ([-(-LOW * s // 100) for s in score.tolist()], [HIGH * s // 100 for s in score.tolist()]))
                centre = heads[key] if w == heads.shape[1] and w else None
                ask, found, value = shard[w].walk((ids, labels, q), centre, k, same, (of, low, high), step)
                columns = [ids[of[ask]], found, value]
                if not same:
                    columns = [columns[0], place[ask].astype(np.int32), other[ask], score[ask], *columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return search


LOW, HIGH = 50, 95  # a negative's score as percentages of the positive's, both included


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, block: int = 16_384, least: int = 4096, clusters: int = 256,
    members: int = 32, sample: int = 4096, step: int = 512,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``vectors(vec_id, label, v array<long>)``."""
    spark = vectors.sparkSession
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<long>"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "vectors")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    anchors = materialise(anchors, "anchors")
    total, asking, tasks = rows.count(), anchors.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-total // block), min(-(-total // least), tasks), 1)

    some = [r.v for r in anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]  # bounded by `sample`
    width = max({len(v) for v in some}, key=lambda n: (sum(len(v) == n for v in some), n), default=0)
    fit = [v for v in some if len(v) == width]
    heads = centroids(np.array(fit, float), max(1, min(clusters, asking // members))) if width else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, own = _vectors(batch), np.zeros(batch.num_rows, np.int32)
            at = [k for k, x in enumerate(v) if len(x) == width and width]
            if at:
                own[at] = (units(np.array([v[k] for k in at], float))[0] @ heads.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "cluster"])

    anchors = anchors.mapInArrow(assign, "vec_id long, label long, v array<long>, cluster int")
    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    found = _deal(rows, anchors, shards).mapInArrow(_search(heads, positives, True, step, names(POSITIVES)), POSITIVES)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    own = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score", "positive_id"))).alias("p"))  # at most `positives`
    lists = {"places": "p.place", "scores": "p.positive_score", "others": "p.positive_id"}
    own = own.select(F.col("anchor_id").alias("vec_id"), *[F.col(c).alias(n) for n, c in lists.items()])
    asked = materialise(anchors.join(own, "vec_id"), "positives")
    found = _deal(rows, asked, shards).mapInArrow(_search(heads, negatives, False, step, names(NEGATIVES)), NEGATIVES)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
