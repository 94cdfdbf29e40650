"""Reads to chunks, and chunks back to reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import signal as S
from tidewater.storage import stored

from .quantiles import quantiles


def calibration_valid(reads: DataFrame) -> DataFrame:
    """Reads with a finite scale above 1e-8 in size; an offset that is not finite becomes 0."""
    ok = S.finite(F.col("scale")) & (F.abs("scale") > 1e-8)
    return reads.where(ok).withColumn("offset_adc", F.when(S.finite(F.col("offset_adc")), F.col("offset_adc")).otherwise(F.lit(0.0)))


def calibration_rejects(reads: DataFrame) -> DataFrame:
    scale = F.col("scale")
    reason = F.when(scale.isNull(), "missing").when(~S.finite(scale), "not finite").when(F.abs(scale) <= 1e-8, "zero")
    return reads.withColumn("reason", reason).where("reason is not null")


def chunks(
    reads: DataFrame, value: Column, size: int, hop: int, tail: str = "shift_last", carry: tuple[str, ...] = ("offset_adc", "scale")
) -> DataFrame:
    """One row per window of the array ``value``: read_id, chunk_index, n_chunks, start, chunk."""
    starts = S.window_starts(F.size(value), size, hop, tail)
    rows = reads.withColumn("value", value).withColumn("starts", starts).where(F.size("starts") > 0)
    rows = rows.select("read_id", *carry, "value", F.size("starts").alias("n_chunks"), F.posexplode("starts").alias("chunk_index", "start"))
    return rows.withColumn("chunk", F.slice("value", F.col("start") + 1, F.lit(size))).drop("value")


def normalised(rows: DataFrame) -> DataFrame:
    """Chunks with center, half_range and norm, each by its own statistics."""
    rows = rows.withColumn("stats", S.norm_stats(F.col("chunk")))
    return rows.withColumn("norm", S.normalise_pm1(F.col("chunk"), F.col("stats"))).select("*", "stats.center", "stats.half_range").drop("stats")


def samples(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(value).alias("pos", "value"))


#: Samples of a segment: what one row of a reassembled signal holds at most.
SEGMENT = 1 << 16


def _stitch(size: int, hop: int, segment: int, weighted: bool):
    """An Arrow UDF from the pieces of chunks in a segment, in the order of the chunks, to its samples; all rows of a batch at once."""
    overlap = max(size - hop, 0)

    @F.arrow_udf("array<double>")
    def stitch(number: pa.Array, parts: pa.Array) -> pa.Array:
        flat, many = parts.flatten(), parts.value_lengths().to_numpy(zero_copy_only=False)
        index, count, start, low = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("chunk_index", "n_chunks", "start", "low"))
        piece = flat.field("piece")
        length, values = piece.value_lengths().to_numpy(zero_copy_only=False), piece.flatten().to_numpy(zero_copy_only=False)
        row, first = np.repeat(np.arange(len(many)), many), number.to_numpy(zero_copy_only=False).astype(np.int64) * segment
        last = np.cumsum(many) - 1  # of its pieces; only a segment with the read's last chunk ends before its end
        ends = np.where(index[last] == count[last] - 1, low[last] + length[last] - first, segment)
        base = np.concatenate([[0], np.cumsum(ends)])
        inner = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(base[row] + low - first[row], length) + inner
        if weighted:
            k, weight = np.repeat(low - start, length) + inner, np.ones(len(values))
            if overlap:
                fade_in = np.repeat(index > 0, length) & (k < overlap)
                weight[fade_in] = k[fade_in] / overlap
                fade_out = np.repeat(index < count - 1, length) & (k >= size - overlap)  # overwrites a fade-in that it meets
                weight[fade_out] = 1 - (k[fade_out] - (size - overlap)) / overlap
            total = np.bincount(at, weight, base[-1])
            out = np.bincount(at, weight * values, base[-1]) / np.where(total == 0, 1, total)
        else:
            out = np.zeros(base[-1])
            out[at] = values  # of a sample in several chunks the last stays
        return pa.ListArray.from_arrays(pa.array(base, pa.int32()), pa.array(out))

    return stitch


def reassembled(
    rows: DataFrame, size: int, hop: int, weighted: bool = True, sums: dict[str, Column] | None = None, segment: int = SEGMENT
) -> DataFrame:
    """read_id, segment, first, value (samples from ``first`` on) and ``sums``, of ``rows(read_id, chunk_index, n_chunks, start, chunk)``.

    Chunks are dealt by read and segment, and what lies over a border goes to both sides, cut there, so a read of any length
    is many rows of at most ``segment`` samples and a task holds a few of them. ``sums`` are sums over chunks, each counted
    in the segment in which it starts.
    """
    if segment < max(size, hop):
        raise ValueError("a segment must not be shorter than a window or a hop")
    number = lambda at: F.floor(at / segment).cast("long")
    start, stop = F.col("start"), F.col("start") + size
    rows = rows.withColumns(sums or {}).withColumn("segment", F.explode(F.sequence(number(start), number(stop - 1))))
    low, high = F.greatest(start, F.col("segment") * segment), F.least(stop, (F.col("segment") + 1) * segment)
    piece = F.slice("chunk", (low - start + 1).cast("int"), (high - low).cast("int"))
    part = F.struct("chunk_index", "n_chunks", start.cast("long").alias("start"), low.cast("long").alias("low"), piece.alias("piece"))
    own = [F.coalesce(F.sum(F.when(F.col("segment") == number(start), F.col(c))), F.lit(0)).alias(c) for c in sums or {}]
    per = rows.groupBy("read_id", "segment").agg(F.array_sort(F.collect_list(part)).alias("parts"), *own)
    value = _stitch(size, hop, segment, weighted)(F.col("segment"), F.col("parts")).alias("value")
    return per.select("read_id", "segment", (F.col("segment") * segment).alias("first"), value, *(sums or {}))


def overlap_add(rows: DataFrame, size: int, hop: int, segment: int = SEGMENT) -> DataFrame:
    """read_id, segment, first, value: the weighted mean of all chunks at each sample; weight 0 divides by 1."""
    return reassembled(rows, size, hop, segment=segment)


def direct_stitch(rows: DataFrame, size: int, hop: int, segment: int = SEGMENT) -> DataFrame:
    """The same without weights: a later chunk overwrites an earlier one."""
    return reassembled(rows, size, hop, False, segment=segment)


def segment_samples(rows: DataFrame) -> DataFrame:
    """read_id, pos, value of reassembled segments."""
    return rows.select("read_id", "first", F.posexplode("value").alias("i", "value")).select("read_id", (F.col("first") + F.col("i")).alias("pos"), "value")


def cycle_fill(rows: DataFrame, order: list[str], target: int) -> DataFrame:
    """The first ``target`` rows in order; if there are fewer, they repeat round robin up to exactly ``target``."""
    some = rows.orderBy(*order).limit(target)
    numbered = some.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1)  # bounded by target
    n = numbered.agg(F.count("*").alias("n"))
    slots = rows.sparkSession.range(target).withColumnRenamed("id", "slot").crossJoin(F.broadcast(n)).where("n > 0")
    return slots.withColumn("i", (F.col("slot") % F.col("n")).cast("int")).join(numbered, "i").drop("i", "n")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with a global 0-based number in the order of ``key``: range partitions are numbered on their own and shifted.

    The number of partitions is given, so that both uses of the exchange see the same ones.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, key).withColumn("part", F.spark_partition_id())
    inner = parts.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1)
    counts = parts.groupBy("part").count()
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = counts.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    return inner.join(F.broadcast(before), "part").withColumn("number", F.col("i") + F.col("base")).drop("part", "i", "base")


def batches(rows: DataFrame, key: str, size: int, drop_last: bool = True) -> DataFrame:
    """Groups of ``size`` rows in the order of ``key``: batch, items."""
    out = numbered(rows, key).groupBy(F.floor(F.col("number") / size).alias("batch"))
    out = out.agg(F.array_sort(F.collect_list(F.col(key))).alias("items"))
    return out.where(F.size("items") == size) if drop_last else out


def norm_sums(original: Column, rebuilt: Column) -> dict[str, Column]:
    """What `read_errors` needs of each chunk; its sums are over all samples of all chunks, those that overlap counted twice."""
    return {
        "norm_abs": S.l1(original, rebuilt), "norm_sq": S.l2(original, rebuilt), "norm_n": F.size(original).cast("long"),
        "chunk_count": F.lit(1).cast("long"),
    }


def read_segments(reads: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...], segment: int = SEGMENT) -> DataFrame:
    """read_id, segment, ``keep`` and the array ``columns`` of reads cut into segments."""
    last = F.floor((F.size(columns[0]) - 1) / segment).cast("long")
    cut = lambda c, s: F.slice(c, (s * segment + 1).cast("int"), F.lit(segment)).alias(c)
    cuts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda s: F.struct(s.alias("segment"), *[cut(c, s) for c in columns]))
    return reads.where(F.size(columns[0]) > 0).select("read_id", *keep, F.explode(cuts).alias("s")).select("read_id", *keep, "s.*")


def read_errors(rebuilt: DataFrame, reads: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Six errors of each read and its lengths, from `reassembled` segments with `norm_sums` and ``reads(read_id, pa, adc, offset_adc, scale)``.

    Segments are compared on their own and their sums added up. ``value`` is the rebuilt signal in picoamperes; where it is
    shorter than the read, the read is trimmed to it.
    """
    rows = rebuilt.join(read_segments(reads, ("pa", "adc"), ("offset_adc", "scale"), segment), ["read_id", "segment"])
    n = F.size("value")
    rows = rows.withColumn("pa", F.slice("pa", F.lit(1), n)).withColumn("adc", F.slice("adc", F.lit(1), n))
    back = S.to_adc(F.col("value"), F.col("offset_adc"), F.col("scale"))
    rows = rows.withColumn("adc_hat", F.transform(back, lambda v: S.adc_round_clip(v).cast("double")))
    of = {"pa": ("pa", "value"), "adc": ("adc", "adc_hat")}
    parts = [f(F.col(a), F.col(b)).alias(f"{c}_{s}") for c, (a, b) in of.items() for s, f in (("abs", S.l1), ("sq", S.l2))]
    sums = ("norm_abs", "norm_sq", "norm_n", "chunk_count")
    rows = rows.select("read_id", n.cast("long").alias("n"), *sums, *parts)
    rows = rows.groupBy("read_id").agg(*[F.sum(c).alias(c) for c in rows.columns[1:]])
    mean = lambda c, n: (F.col(f"{c}_abs") / F.greatest(F.col(n), F.lit(1))).alias(f"{c}_mae")
    root = lambda c, n: F.sqrt(F.col(f"{c}_sq") / F.greatest(F.col(n), F.lit(1))).alias(f"{c}_rmse")
    errors = [f(c, n) for c, n in (("norm", "norm_n"), ("pa", "n"), ("adc", "n")) for f in (mean, root)]
    return rows.select("read_id", F.col("n").alias("trimmed_length"), "chunk_count", *errors)


ERRORS = ("trimmed_length", "chunk_count", "norm_mae", "norm_rmse", "pa_mae", "pa_rmse", "adc_mae", "adc_rmse")


def recon_summary(errors: DataFrame) -> DataFrame:
    """Number of reads and chunks, and a summary of each of ERRORS."""
    sums = [F.count("*").alias("processed_reads"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunk_count")]
    return summarise(errors, *ERRORS, sums=sums)


def feature_standardise(rows: DataFrame, eps: float = 1e-5) -> DataFrame:
    """seq, t, i, value: ``rows(seq, t, vec)`` with zero mean and unit deviation per channel over the time of each sequence."""
    long = rows.select("seq", "t", F.posexplode("vec").alias("i", "x"))
    own = Window.partitionBy("seq", "i")
    value = (F.col("x") - F.avg("x").over(own)) / F.sqrt(F.var_pop("x").over(own) + eps * eps)
    return long.select("seq", "t", "i", value.alias("value"))


STATS = {"mean": F.avg, "min": F.min, "max": F.max}


def summarise(rows: DataFrame, *columns: str, by: tuple[str, ...] = (), sums: list[Column] | None = None) -> DataFrame:
    """by, ``sums`` and the mean, exact median, minimum and maximum of each column per group; 0.0 where there is no value.

    Without ``by`` one row, also of no rows. The rows are written once, as the median reads them several times.
    """
    rows = stored(rows, "summed")
    plain = [F.coalesce(f(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_{n}") for c in columns for n, f in STATS.items()]
    found = rows.groupBy(*by).agg(*(sums or []), *plain) if by else rows.agg(*(sums or []), *plain)
    middle = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}_median") for c in columns]
    medians = quantiles(rows, columns, (0.5,), *by)
    medians = medians.groupBy(*by).agg(*middle) if by else medians.agg(*middle)
    both = found.join(medians, list(by), "left") if by else found.crossJoin(medians)  # one row each
    own = [x for x in found.columns if not any(x == f"{c}_{n}" for c in columns for n in STATS)]
    order = [f"{c}_{n}" for c in columns for n in ("mean", "median", "min", "max")]
    return both.select(*own, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in order])
