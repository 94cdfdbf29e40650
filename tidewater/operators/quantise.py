"""Vector quantisation against a codebook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import signal as S
from tidewater.storage import stored

from .windows import numbered

MAX_CODEBOOK_ROWS = 1 << 17  # above this a codebook is not sent to the executors


def project(codebook: DataFrame, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """code, vec: each code vector times ``weights`` plus ``bias``."""
    vec = F.col("vec").cast("array<double>")
    column = lambda j: F.array(*[F.lit(float(row[j])) for row in weights])
    return codebook.select("code", F.array(*[S.dot(vec, column(j)) + float(b) for j, b in enumerate(bias)]).alias("vec"))


def nearest_code_cross(latents: DataFrame, codebook: DataFrame) -> DataFrame:
    """What `nearest_code` gives, by every pair of a latent and a code: to check it on small tables."""
    c = codebook.select("code", F.col("vec").cast("array<double>").alias("c"))
    both = latents.select("vec_id", F.col("vec").cast("array<double>").alias("v")).crossJoin(c)
    distance = S.squared_distance(F.col("v"), F.col("c"))
    best = both.groupBy("vec_id").agg(F.min(F.struct(distance.alias("d"), "code")).alias("m"))
    return best.select("vec_id", F.col("m.code").alias("code"), F.col("m.d").alias("distance"))


def _best(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of ``c`` for each row of ``v`` and their squared distance, ties to the first.

    The product form cancels where two codes are about as near, so all codes that it can't tell apart are measured exactly.
    """
    size = np.square(c).sum(1)
    rough = size - 2 * v @ c.T
    slack = 1e-9 * (np.square(v).sum(1) + size.max())
    row, code = np.nonzero(rough <= (rough.min(1) + slack)[:, None])
    exact = np.square(v[row] - c[code]).sum(1)
    order = np.lexsort((code, exact, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return code[first], exact[first]


def _nearest(v: np.ndarray, codes: np.ndarray, book: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each row of ``v`` and its squared distance, the codebook taken in blocks, in ascending order of codes."""
    best, at = np.full(len(v), np.inf), np.zeros(len(v), codes.dtype)
    for k in range(0, len(book), block):
        i, d = _best(v, book[k : k + block])
        less = d < best
        best[less], at[less] = d[less], codes[k : k + block][i[less]]
    return at, best


def nearest_code(latents: DataFrame, codebook: DataFrame, block: int = 2048, most: int = MAX_CODEBOOK_ROWS) -> DataFrame:
    """vec_id, code, distance: exact by squared distance, ties to the smaller code; of no codes there are no rows.

    Blocks of codes are held against Arrow batches of latents with a running best: no shuffle and no pairs. Up to ``most`` rows a
    codebook is sent to the executors; a larger one is searched in shards (`nearest_code_sharded`).
    """
    rows = codebook.orderBy("code").limit(most + 1).collect()
    if len(rows) > most:
        return nearest_code_sharded(latents, codebook, block, most)
    codes, book = np.array([r.code for r in rows], np.int64), np.array([r.vec for r in rows], float)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f) and len(book):
                at, best = _nearest(np.stack(f.vec).astype(float), codes, book, block)
                yield pd.DataFrame({"vec_id": f.vec_id, "code": at, "distance": best})

    return latents.select("vec_id", "vec").mapInPandas(search, "vec_id long, code int, distance double")


VISIT = "shard int, salt int, kind int, id long, vec array<double>, norm double"
SEEN = "vec_id long, code int, distance double, norm double, vec array<double>"


def _visit(codes: DataFrame, latents: DataFrame, block: int, tasks: int) -> DataFrame:
    """SEEN: the nearest code of a shard for each row of ``latents(shard, salt, id, vec, norm)``; a copy of its codes goes to each salt.

    A task holds the codes of one shard at a time and reads its latents behind them as a stream.
    """
    both = codes.withColumn("kind", F.lit(0)).unionByName(latents.withColumn("kind", F.lit(1)))
    both = both.select(*[x.split()[0] for x in VISIT.split(", ")]).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, book = None, [], None
        for batch in batches:
            shard, salt, kind = (batch.column(c).to_numpy() for c in ("shard", "salt", "kind"))
            new = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            for at, to in zip([0, *new], [*new, batch.num_rows], strict=True):
                if at == to:
                    continue
                part = batch.slice(at, to - at)
                key, ids = (shard[at], salt[at]), part.column("id").to_numpy()
                if key != where:
                    where, held, book = key, [], None
                v = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                if kind[at] == 0:
                    held.append((ids, v))
                    continue
                if book is None:
                    book = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                code, distance = _nearest(v, *book, block)
                columns = [part.column("id"), pa.array(code.astype(np.int32)), pa.array(distance), part.column("norm"), part.column("vec")]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SEEN.split(", ")])

    return both.mapInArrow(search, SEEN)


def nearest_code_sharded(latents: DataFrame, codebook: DataFrame, block: int = 2048, most: int = MAX_CODEBOOK_ROWS, per_task: int = 1 << 20) -> DataFrame:
    """What `nearest_code` gives, for a codebook of any size.

    Codes are numbered by their length |c| and cut into shards of ``most``. A latent first visits the shard whose lengths hold its
    own, which bounds its distance; then, as no code is nearer than | |v| - |c| |, only the shards whose lengths come within that
    distance, each on its own. The least of all is the answer. Latents of a shard are dealt over tasks of about ``per_task`` rows.
    """
    spark = latents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = lambda: F.sqrt(S.dot(F.col("vec"), F.col("vec"))).alias("norm")
    book = codebook.select(F.col("code").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).select("*", norm())
    book = numbered(book, "norm").select(F.floor(F.col("number") / most).cast("int").alias("shard"), "id", "vec", "norm")
    book = stored(book, "codes")
    # one row a shard: its number, and the lengths that it holds
    ends = book.groupBy("shard").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).orderBy("shard")
    ranges = np.array([(r.shard, r.low, r.high) for r in ends.collect()], float)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(ranges[:, 1], batch.column("norm").to_numpy(), "right") - 1
            shards = ranges[np.maximum(at, 0), 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards)], names=[*batch.schema.names, "shard"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other shard that may hold a nearer code, or one as near."""
        for batch in batches:
            size, d = batch.column("norm").to_numpy(), np.sqrt(batch.column("distance").to_numpy())
            own = ranges[np.maximum(np.searchsorted(ranges[:, 1], size, "right") - 1, 0), 0]
            gap = np.maximum(0, np.maximum(ranges[:, 1] - size[:, None], size[:, None] - ranges[:, 2]))
            row, at = np.nonzero((gap <= d[:, None] * (1 + 1e-9) + 1e-9 * (size[:, None] + ranges[:, 2])) & (ranges[:, 0] != own[:, None]))
            part = batch.take(pa.array(row))
            columns = [part.column("vec_id"), part.column("vec"), part.column("norm"), pa.array(ranges[at, 0].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "norm", "shard"])

    def seen(asked: DataFrame) -> DataFrame:
        salts = asked.groupBy("shard").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts"))
        salts = stored(salts, "salts")
        dealt = asked.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        copies = book.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        return stored(_visit(copies, dealt, block, tasks), "seen")

    rows = latents.select(F.col("vec_id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).select("*", norm())
    kind = "id long, vec array<double>, norm double, shard int"
    first = seen(stored(rows.mapInArrow(home, kind), "asked"))
    more = seen(stored(first.mapInArrow(others, kind), "asked"))
    best = first.union(more).groupBy("vec_id").agg(F.min(F.struct("distance", "code")).alias("m"))
    return best.select("vec_id", "m.code", "m.distance")


def quantise(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    return assigned.join(F.broadcast(codebook) if codebook.count() <= MAX_CODEBOOK_ROWS else codebook, "code")


def token_counts(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    return codebook.select("code").join(assigned.groupBy("code").count(), "code", "left").select("code", F.coalesce("count", F.lit(0)).alias("n"))


def codebook_stats(counts: DataFrame) -> DataFrame:
    """total (at least 1), perplexity and share of codes in use."""
    total = F.greatest(F.sum("n"), F.lit(1))
    sums = counts.agg(total.alias("total"), F.avg((F.col("n") > 0).cast("double")).alias("usage"))
    p = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(sums)).groupBy("total", "usage").agg(F.exp(-F.sum(p * F.log(p + 1e-10))).alias("perplexity"))


def score_chunks(chunks: DataFrame, scorer: Callable[[np.ndarray], np.ndarray] | None = None, size: int = 32, factory: Callable | None = None) -> DataFrame:
    """``scorer`` (an ndarray to ndarray function) over batches of exactly ``size`` of ``chunks(read_id, chunk_index, chunk)``.

    ``factory`` makes the scorer instead, once a task, when the task's first chunk is there: it may load a model. A batch takes
    chunks of one length over the borders of Arrow batches; only what is left at a task's end is padded with zeros, once per length.
    Null chunks are not scored.
    """
    if (scorer is None) == (factory is None):
        raise ValueError("give a scorer or a factory of one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, waiting, names = scorer, {}, ["read_id", "chunk_index", "score"]

        def scored(rows: list[tuple[pa.RecordBatch, np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
            """The first ``n`` of the waiting chunks in one call; what is behind them stays."""
            keys, x = pa.Table.from_batches([k for k, _ in rows]), np.concatenate([v for _, v in rows])
            batch = x[:n] if n == size else np.concatenate([x[:n], np.zeros((size - n, x.shape[1]))])
            y = np.asarray(model(batch), float)[:n].reshape(n, -1)
            out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            keys = keys.combine_chunks().to_batches()[0]
            rows[:] = [(keys.slice(n), x[n:])] if len(x) > n else []
            yield pa.RecordBatch.from_arrays([*keys.slice(0, n).columns, out], names=names)

        for batch in batches:
            lengths = batch.column("chunk").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths >= 0]):
                model = model or factory()
                own = batch.take(pa.array(np.flatnonzero(lengths == n)))
                x = own.column("chunk").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, n)
                rows = waiting.setdefault(int(n), [])
                rows.append((own.drop_columns(["chunk"]), x))
                while sum(len(v) for _, v in rows) >= size:
                    yield from scored(rows, size)
        for rows in waiting.values():
            if rows:
                yield from scored(rows, sum(len(v) for _, v in rows))

    rows = chunks.select("read_id", F.col("chunk_index").cast("int"), F.col("chunk").cast("array<double>"))
    kind = rows.schema["read_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"read_id {kind}, chunk_index int, score array<double>")
