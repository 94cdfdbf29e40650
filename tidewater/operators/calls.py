"""Sequence calls: pair metrics and their summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .nested import metrics, nest
from .windows import summarise


@F.arrow_udf(DoubleType())
def mean_qscore(qual: pa.Array) -> pa.Array:
    """Mean Phred value; 0 for an empty string. Sums over the bytes of a whole batch; no string is made per character."""
    texts = pc.fill_null(qual, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    total = np.diff(np.concatenate([[0], np.cumsum(data, dtype=np.int64)])[ends - ends[0]])
    n = np.diff(ends)
    if (data > 127).any():  # characters of several bytes
        own = [[ord(c) for c in x or ""] for x in qual.to_pylist()]
        total, n = np.array([sum(x) for x in own]), np.array([len(x) for x in own])
    return pa.array((total - 33 * n) / np.maximum(n, 1), mask=qual.is_null().to_numpy(zero_copy_only=False))


def phred_encode(quals: Column, seq: Column) -> Column:
    """Integers as characters; all ``I`` if their number differs from the sequence's length."""
    own = F.array_join(F.transform(quals, lambda q: F.char(q + 33)), "")
    return F.when(F.size(quals) == F.length(seq), own).otherwise(F.repeat(F.lit("I"), F.length(seq)))


def forward_sequence(seq: Column, is_reverse: Column) -> Column:
    return F.when(is_reverse, F.reverse(F.translate(seq, "ACGT", "TGCA"))).otherwise(seq)


#: Rows from which a table of distances is first cut to a band, and the bands' widths as shares of the rows.
BANDED, BANDS = 8192, (64, 16, 4)


def distance(a: str, b: str) -> int:
    """Edit distance of two strings, all rows of a column at once as the bits of whole numbers.

    A column of the table of distances differs from one row to the next by -1, 0 or 1; ``up`` and ``down`` hold where. The whole
    table takes len(a) * len(b) / 64 steps of the processor. Long strings are tried in bands about the diagonal first: a distance
    of at most k never leaves a band of k + 1 rows, so a result within k is the distance, and one beyond it asks for a wider band.
    """
    if len(a) > len(b):
        a, b = b, a
    start, end = 0, len(a)
    while start < end and a[start] == b[start]:
        start += 1
    while end > start and a[end - 1] == b[end - 1 + len(b) - len(a)]:
        end -= 1
    a, b = a[start:end], b[start : end + len(b) - len(a)]
    if not a:
        return len(b)
    where = {c: int("".join("1" if x == c else "0" for x in reversed(a)), 2) for c in set(a)}
    if len(a) >= BANDED:
        for share in BANDS:
            most = len(b) - len(a) + len(a) // share
            out = _banded(where, len(a), b, most)
            if out <= most:
                return out
    return _banded(where, len(a), b, len(b))


def _banded(where: dict[str, int], n: int, b: str, most: int) -> int:
    """Distance of ``b`` and the ``n`` characters whose places ``where`` holds if it is at most ``most``, else more than that.

    The band moves down by whole steps of columns. What lies beyond its ends counts as one more for each row or column, which
    is never less than it is.
    """
    more = len(b) - n
    above, below, step = (most + more) // 2, (most - more) // 2, max(64, most // 2)
    low = high = up = down = out = 0
    for at in range(0, len(b), step):
        part = b[at : at + step]
        first, after = max(at - above, 0), min(n, at + len(part) + below)
        up |= ((1 << (after - high)) - 1) << (high - low)
        out += after - high
        up, down = up >> (first - low), down >> (first - low)
        low, high = first, after
        full, last = (1 << (high - low)) - 1, 1 << (high - low - 1)
        own = {c: (where[c] >> low) & full for c in set(part) & where.keys()}
        for c in part:
            same = own.get(c, 0)
            flat = (((same & up) + up) ^ up) | same | down
            right = down | (full & ~(flat | up))
            left = up & flat
            out += bool(right & last) - bool(left & last)
            right = (right << 1) | 1
            up = ((left << 1) | ~(same | down | right)) & full
            down = right & (same | down) & full
    return out


#: Words of 64 bits that an operation on many pairs takes, places of a table of letters, and letters, at most.
WORDS, PLACES, LETTERS = 8192, 1 << 22, 64
MANY = 48  # pairs from which it is faster than one pair after the other


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """`distance` of many pairs at once: pairs of like lengths side by side, each in a band about its diagonal.

    A band of ``w`` words has three quarters above the diagonal of the longer string's start. A path of cost d leaves it by
    (d + n) / 2 above and (d - n) / 2 below at most, n being the difference of lengths, so a result within that is the distance;
    the other pairs are tried again in bands twice as wide. Sequences of BANDED characters and more go one by one.
    """
    a, b = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)], strict=True) if a else ((), ())
    n, m = (np.array([len(x) for x in z], np.int64) for z in (a, b))
    out, more = m.copy(), m - n  # right where one is empty
    for i in np.flatnonzero(m >= BANDED):
        out[i] = distance(a[i], b[i])
    todo = np.flatnonzero((n > 0) & (m < BANDED))
    sizes = np.array([k << i for i in range(24) for k in (2, 3)]) // 2  # 1, 1, 2, 3, 4, 6, ...: few, so that many pairs share one
    words = sizes[np.searchsorted(sizes, (5 * more // 4 + 24) // 48 + 1)]
    while len(todo):
        todo, again = todo[np.lexsort((-m[todo], words[todo]))], []
        while len(todo):
            w, most = int(words[todo[0]]), int(m[todo[0]])
            size = max(1, min(WORDS // w, PLACES // most, int((words[todo] == w).sum())))
            some, todo = todo[:size], todo[size:]
            if size < MANY:
                out[some] = [distance(a[i], b[i]) for i in some]
                continue
            got = _side_by_side([a[i] for i in some], [b[i] for i in some], w)
            right = (got + more[some] <= 96 * w) & (got - more[some] < 32 * w)
            out[some[right]] = got[right]
            again.append(some[~right])
        todo = np.concatenate([np.zeros(0, np.int64), *again])
        words[todo] *= 2
    return out


def _codes(texts: list[str]) -> list[np.ndarray]:
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.split(flat, np.cumsum([len(x) for x in texts])[:-1])


def _side_by_side(a: list[str], b: list[str], w: int) -> np.ndarray:
    """Distances of pairs, the longer ``b`` first falling in length, in bands of ``w`` words; too large where a band is too narrow.

    Bit p of a band stands for row column - above + p, so that the band goes down a row with each column and the diagonal that ends
    in the last cell keeps its bit; its steps that cost nothing are counted.
    """
    above, size, most = 48 * w, len(a), len(b[0])
    x, y = _codes(a), _codes(b)
    known = np.unique(np.concatenate([np.flatnonzero(np.bincount(np.concatenate(z))) for z in (x, y)]))
    if len(known) > LETTERS:
        return np.array([distance(p, q) for p, q in zip(a, b, strict=True)], np.int64)
    high = max(most, max(map(len, x)) + above) // 64 + w + 2
    place, letters = np.zeros(int(known[-1]) + 1, np.int64), len(known)
    place[known] = np.arange(letters)
    at = np.zeros((size, high * 64), np.uint8)
    column = np.zeros((most, size), np.int64)
    for i, (p, q) in enumerate(zip(x, y, strict=True)):
        at[i, above : above + len(p)] = place[p] + 1
        column[: len(q), i] = place[q]
    rows = np.stack([np.packbits(at == k + 1, axis=1, bitorder="little").view(np.uint64).T for k in range(letters)]).ravel()
    column *= high * size
    column += np.arange(size)
    begin = ((1 << 64 * w) - (1 << above)).to_bytes(8 * w, "little")
    up = np.repeat(np.frombuffer(begin, np.uint64)[:, None], size, axis=1)
    down = np.zeros_like(up)
    lengths = np.array([len(q) for q in b])
    word, bit = np.divmod(above - lengths + np.array([len(p) for p in a]), 64)
    shift, free = bit.astype(np.uint64), np.zeros(size, np.uint64)
    living = np.searchsorted(-lengths, -np.arange(most), "left")  # pairs that have a column; columns are counted from 0
    step, one, top, wide = np.arange(w + 1)[:, None] * size, np.uint64(1), np.uint64(63), 0
    shifts = np.arange(65, dtype=np.uint64)
    for j in range(most):
        n = living[j]
        if not wide or n < 0.8 * wide:  # those that are done go
            wide, up, down = n, up[:, :n].copy(), down[:, :n].copy()
            own = word[:n] * n + np.arange(n)
        found = rows.take(column[j, :wide] + (step + j // 64 * size))
        same = found[:-1]
        if r := j % 64:
            same = (same >> shifts[r]) | (found[1:] << shifts[64 - r])
        flat = same & up
        total = flat + up
        if w > 1:
            over = (total < flat)[:-1]
            while over.any():
                total[1:] += over
                over = np.concatenate([np.zeros((1, wide), bool), (over & (total[1:] == 0))[:-1]])
        flat = (total ^ up) | same | down
        right, left = down | ~(flat | up), flat & up
        free[:n] += (flat.ravel().take(own[:n]) >> shift[:n]) & one
        low = flat >> one
        low[:-1] |= flat[1:] << top
        up, down = left | ~(low | right), low & right
    return lengths - free.astype(np.int64)


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Int64")
    out[known] = distances(a[known].tolist(), b[known].tolist())
    return out


def identity(distance: Column, a: Column, b: Column) -> Column:
    """1 if both are empty, 0 if one is, else 1 - distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - distance / longer)


def empirical_qscore(errors: Column, denom: Column, cap: float = 60.0) -> Column:
    rate = F.greatest(errors / denom, F.lit(1e-12))
    return F.when(errors <= 0, cap).otherwise(F.least(F.lit(cap), -10 * F.log10(rate)))


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Calls on both sides by id, with lengths, identity, distance and qualities.

    Both sides are dealt by id over all shuffle partitions, however few bytes they are: distances cost far more than bytes.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.select("read_id", F.col("seq").alias("a"), mean_qscore(F.col("qual")).alias("left_q")).repartition(tasks, "read_id")
    b = right.select("read_id", F.col("seq").alias("b"), mean_qscore(F.col("qual")).alias("right_q")).repartition(tasks, "read_id")
    both = a.join(b, "read_id").withColumn("edit_distance", edit_distance(F.col("a"), F.col("b")))
    n, m = F.length("a").cast("long"), F.length("b").cast("long")
    weight = F.greatest(n, m)
    return both.select(
        "read_id", n.alias("left_length"), m.alias("right_length"),
        identity(F.col("edit_distance"), F.col("a"), F.col("b")).alias("identity"), "edit_distance", weight.alias("weight"),
        "left_q", "right_q", (F.col("right_q") - F.col("left_q")).alias("q_delta"),
        F.when(weight > 0, empirical_qscore(F.col("edit_distance"), weight)).otherwise(60.0).alias("empirical_q"),
        (m - n).alias("length_delta"), (F.col("a") == F.col("b")).alias("exact_match"),
    )


def weighted_identity() -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col("identity") * F.col("weight")), F.sum("weight")), F.lit(0.0))


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def _rates() -> list[Column]:
    return [_mean(F.col("exact_match").cast("double")).alias("exact_rate"), weighted_identity().alias("weighted_identity")]


def call_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: counts of both sides, rates, quality deltas, and summaries of identity, length and quality delta."""
    sums = [F.count("*").alias("shared"), *_rates(), _mean(F.col("q_delta")).alias("q_delta_avg"), _mean(F.abs("q_delta")).alias("q_delta_abs")]
    rows = summarise(pairs(left, right), "identity", "length_delta", "q_delta", sums=sums)
    n = left.agg(F.count_distinct("read_id").alias("left_count"))
    m = right.agg(F.count_distinct("read_id").alias("right_count"))
    both = rows.crossJoin(n).crossJoin(m)  # one row each
    only = lambda c: (F.col(c) - F.col("shared")).alias(c.replace("count", "only"))
    return both.select("shared", "left_count", "right_count", only("left_count"), only("right_count"), *rows.columns[1:])


#: What a comparison with the truth (left) summarises, and the names of the means.
TRUTH = {"identity": None, "empirical_q": "mean_empirical_q", "right_q": "mean_predicted_q", "left_q": "mean_truth_q", "length_delta": None}


def truth_means(rows: DataFrame) -> DataFrame:
    """One row: what `summary_delta` reads of a `truth_summary`; plain sums in one pass, without the medians."""
    means = [_mean(F.col(c)).alias(n) for c, n in TRUTH.items() if n in DELTAS]
    return rows.agg(F.count("*").alias("shared"), *_rates(), *means)


def truth_summary(rows: DataFrame, counts: DataFrame, *by: str) -> DataFrame:
    """Summary of pair rows against the truth per ``by``; ``counts(*by, truth_count, predicted_count)`` are of each side.

    Without ``predicted_count`` the rows matched count as predicted. A group without rows has zeros.
    """
    means = [_mean(F.col(c)).alias(n) for c, n in TRUTH.items() if n]
    found = summarise(rows, *TRUTH, by=by, sums=[F.count("*").alias("shared"), *_rates(), *means])
    both = counts.join(found, list(by), "left") if by else counts.crossJoin(found)
    shared = F.coalesce("shared", F.lit(0))
    predicted = F.col("predicted_count") if "predicted_count" in counts.columns else shared
    only = lambda n: F.greatest(n - shared, F.lit(0))
    return both.select(
        *by, shared.alias("shared"), "truth_count", predicted.alias("predicted_count"),
        only(F.col("truth_count")).alias("truth_only"), only(predicted).alias("predicted_only"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in found.columns if c not in (*by, "shared")],
    )


DELTAS = ("shared", "weighted_identity", "mean_empirical_q", "mean_predicted_q", "exact_rate")


def summary_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """metric, delta: the new truth summary minus the old one, a missing value being 0."""

    def long(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[F.col(c).cast("double").alias(c) for c in DELTAS]).unpivot([], list(DELTAS), "metric", name)

    both = long(new, "n").join(long(old, "o"), "metric", "full")
    return both.select("metric", (F.coalesce("n", F.lit(0.0)) - F.coalesce("o", F.lit(0.0))).alias("delta"))


#: The names of a call summary's numbers in its document (fixed values).
DOCUMENT = {
    "shared": "shared_read_count", "left_count": "original_read_count", "right_count": "reconstructed_read_count",
    "left_only": "original_only_read_count", "right_only": "reconstructed_only_read_count", "exact_rate": "exact_match_rate",
    "weighted_identity": "length_weighted_identity", "q_delta_avg": "mean_qscore_delta", "q_delta_abs": "mean_qscore_delta_abs",
    **{f"{c}_{n}": f"{d}.{n}" for c, d in (("identity", "identity_summary"), ("length_delta", "length_delta_summary"), ("q_delta", "qscore_delta_summary"))
       for n in ("mean", "median", "min", "max")},
}


def call_document(summary: DataFrame) -> DataFrame:
    """A `call_summary` as its nested document: nine counts and rates, and a struct for each of three summaries."""
    return nest(summary.select(*[F.col(c).alias(d) for c, d in DOCUMENT.items()]))


def flatten(document: DataFrame, prefix: str = "valid/") -> DataFrame:
    """metric, value of the numbers of a nested call document, such as ``valid/identity_summary.mean``; nulls are left out."""
    return metrics(document, prefix, tuple(DOCUMENT.values()))


def comparison(runs: DataFrame) -> DataFrame:
    """One row a run of ``runs(position, name, generated, original)``, structs of truth summaries; what is missing counts as 0.

    position, name, shared, identity, empirical_q and fastq_q of the generated calls, and how much they differ from the original
    ones in identity and empirical_q, as text with as many places as a report shows.
    """
    of = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0))
    delta = lambda c: of("generated", c) - of("original", c)
    shown = lambda form, c, n: F.format_string(form, c).alias(n)
    return runs.select(
        "position", "name", F.coalesce("generated.shared", F.lit(0)).alias("shared"),
        shown("%.6f", of("generated", "weighted_identity"), "identity"), shown("%.4f", of("generated", "mean_empirical_q"), "empirical_q"),
        shown("%.4f", of("generated", "mean_predicted_q"), "fastq_q"), shown("%+.6f", delta("weighted_identity"), "delta_identity"),
        shown("%+.4f", delta("mean_empirical_q"), "delta_empirical_q"),
    )


def only(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("read_id").join(right.select("read_id"), "read_id", "left_anti")
