"""Expressions over signals held as arrays; everything stays built-in and works in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once; what a lambda over an array captures is computed for each element.

    Spark merges neighbouring projections, so the result of a Python function must not be used in ``then``, nor inside any
    other lambda over an array, unless it was written or shuffled in between: a lambda cannot hold a Python function.
    """
    return F.transform(F.array(value), then)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def usable_scale(scale: Column) -> Column:
    """Calibration scales of 0 or not finite count as 1."""
    return F.when(finite(scale) & (scale != 0), scale).otherwise(F.lit(1.0))


def to_picoamps(adc: Column, offset: Column, scale: Column) -> Column:
    return F.transform(adc, lambda x: (x + offset) * usable_scale(scale))


def to_adc(pa: Column, offset: Column, scale: Column) -> Column:
    return F.transform(pa, lambda x: x / usable_scale(scale) - offset)


def adc_round_clip(x: Column) -> Column:
    """Half-even rounding, clipped to 16 bits before the cast, which would raise otherwise."""
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(x))).cast("smallint")


def norm_stats(x: Column) -> Column:
    """struct(center, half_range). NaN anywhere gives zeros; +inf gives half 0 and the minimum; -inf is a minimum of 0."""
    bad = F.exists(x, lambda v: F.isnan(v)) | (F.size(x) == 0)
    low, high = F.array_min(x), F.array_max(x)
    low = F.when(low == float("-inf"), F.lit(0.0)).otherwise(low)
    up = high == float("inf")
    center = F.when(bad, 0.0).when(up, low).otherwise((low + high) / 2)
    half = F.when(bad | up, 0.0).otherwise((high - low) / 2)
    return F.struct(center.alias("center"), half.alias("half_range"))


def normalise_pm1(x: Column, stats: Column) -> Column:
    def scaled(s: Column) -> Column:
        clipped = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (v - s["center"]) / s["half_range"]))
        return F.when(s["half_range"] < EPS, F.transform(x, lambda v: F.lit(0.0))).otherwise(F.transform(x, clipped))

    return once(stats, scaled)


def denormalise(x: Column, center: Column, half: Column) -> Column:
    def grown(s: Column) -> Column:
        flat = ~finite(s["half"]) | (s["half"] < EPS)
        return F.transform(x, lambda v: F.when(flat, s["center"]).otherwise(v * s["half"] + s["center"]))

    return once(F.struct(center.alias("center"), half.alias("half")), grown)


def standardise(x: Column, mean: float, std: float) -> Column:
    std = std if std and std == std and abs(std) != float("inf") else 1.0
    return F.transform(x, lambda v: (v - mean) / std)


def finite_difference(x: Column, order: int = 1) -> Column:
    def step(x: Column) -> Column:
        n = F.size(x)
        last = F.greatest(n - 1, F.lit(0))
        return F.when(n <= 1, F.array(F.lit(0.0))).otherwise(F.zip_with(F.slice(x, F.lit(2), last), F.slice(x, F.lit(1), last), lambda a, b: a - b))

    for _ in range(order):
        x = once(x, step)
    return x


def l1(y: Column, z: Column) -> Column:
    """Sum of absolute differences of two arrays."""
    return total(F.zip_with(y, z, lambda a, b: F.abs(a - b)))


def l2(y: Column, z: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return total(F.zip_with(y, z, lambda a, b: (a - b) * (a - b)))


def frame_signal(x: Column, length: int, hop: int) -> Column:
    """Frames of ``length`` every ``hop``; a short signal is padded with zeros, a tail is dropped."""
    padded = F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(x), F.lit(0))))
    starts = lambda p: F.sequence(F.lit(0), F.size(p) - length, F.lit(hop))
    return once(padded, lambda p: F.transform(starts(p), lambda s: F.slice(p, s + 1, F.lit(length))))


def _divided(x: Column, size: Callable[[Column], Column]) -> Column:
    return once(x, lambda y: once(size(y), lambda s: F.transform(y, lambda v: v / s)))


def rms_norm(x: Column, eps: float = 1e-5) -> Column:
    return _divided(x, lambda y: F.sqrt(total(F.transform(y, lambda v: v * v)) / F.size(y) + eps * eps))


def l2_norm(x: Column, eps: float = 1e-5) -> Column:
    return _divided(x, lambda y: F.sqrt(total(F.transform(y, lambda v: v * v)) + eps * eps))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def softmax(x: Column) -> Column:
    raised = once(x, lambda y: once(F.array_max(y), lambda top: F.transform(y, lambda v: F.exp(v - top))))
    return _divided(raised, total)


def cosine_loss(x: Column, y: Column) -> Column:
    """1 - cosine of two token vectors, each scaled to unit root mean square and then to unit length."""
    cos = dot(l2_norm(rms_norm(x)), l2_norm(rms_norm(y)))
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))


def kl_loss(p: Column, q: Column, least: float = 1e-6) -> Column:
    """Divergence of two rows of probabilities, summed to 1 again (a row of zeros is divided by ``least``) and clipped."""

    def clean(v: Column) -> Column:
        rows = _divided(v, lambda y: F.greatest(total(y), F.lit(least)))
        return F.transform(rows, lambda x: F.greatest(F.lit(least), F.least(F.lit(1.0), x)))

    return total(F.zip_with(clean(p), clean(q), lambda a, b: a * (F.log(a) - F.log(b))))


def squared_distance(x: Column, y: Column) -> Column:
    return l2(x, y)


def window_starts(n: Column, size: int, hop: int, tail: str = "shift_last") -> Column:
    """0-based starts of windows. Short signals have none; the guard is needed as filters may run later."""
    safe = F.greatest(n - size, F.lit(0))
    starts = F.sequence(F.lit(0), safe, F.lit(hop))
    if tail == "shift_last":
        starts = F.array_distinct(F.concat(starts, F.array(safe)))
    return F.when(n >= size, starts).otherwise(F.array().cast("array<int>"))


def valid_ranges(starts: Column, size: int, hop: int) -> Column:
    """struct(start, stop, valid_from, valid_to) of shift-last windows: what the previous window covers is not valid."""

    def ranges(at: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            last = (i == F.size(at) - 1) & (i > 0)
            valid_from = F.when(last, F.greatest(F.lit(0), F.get(at, i - 1) + hop - s)).otherwise(F.lit(0))
            return F.struct(s.alias("start"), (s + size).alias("stop"), valid_from.alias("valid_from"), F.lit(size).alias("valid_to"))

        return F.transform(at, one)

    return once(starts, ranges)


def crossfade(index: Column, count: Column, size: int, hop: int) -> Column:
    """Linear fades over the overlap; a fade-out overwrites a fade-in where they meet."""
    overlap = max(size - hop, 0)
    plain = F.array_repeat(F.lit(1.0), F.lit(size))
    if not overlap:
        return plain

    def weight(k: Column) -> Column:
        out = 1 - (k - (size - overlap)) / F.lit(float(overlap))
        fade_in = F.when((index > 0) & (k < overlap), k / F.lit(float(overlap))).otherwise(F.lit(1.0))
        return F.when((index < count - 1) & (k >= size - overlap), out).otherwise(fade_in)

    return F.when(count <= 1, plain).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), weight))


def crossfade_shift_last(index: Column, count: Column, valid_from: Column, size: int, hop: int) -> Column:
    """The same inside the valid range and zero outside; where fades meet the smaller weight holds."""
    overlap = max(size - hop, 0)

    def weight(k: Column) -> Column:
        j = k - valid_from
        over = F.lit(float(max(overlap, 1)))
        fade_in = F.when((index > 0) & (j < overlap), j / over).otherwise(F.lit(1.0))
        out = (index < count - 1) & (k >= size - overlap)
        fade_out = F.when(out, 1 - (k - (size - overlap)) / over).otherwise(F.lit(1.0))
        return F.when(k < valid_from, F.lit(0.0)).otherwise(F.least(fade_in, fade_out))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), weight)


def trimmed_length(n: Column, size: int, hop: int, mode: str) -> Column:
    """Usable length: whole windows only (drop, null if short) or padded to a whole number of hops (pad, null if empty)."""
    if mode == "drop":
        return F.when(n >= size, F.floor((n - size) / hop) * hop + size).cast("int")
    padded = F.when(n <= size, F.lit(size)).otherwise(F.ceil((n - size) / hop) * hop + size)
    return F.when(n > 0, padded).cast("int")


def trim(x: Column, size: int, hop: int, mode: str) -> Column:
    want = trimmed_length(F.size(x), size, hop, mode)
    more = F.greatest(want - F.size(x), F.lit(0))
    source = F.concat(x, F.array_repeat(F.element_at(x, -1), more)) if mode == "pad" else x
    return F.when(want.isNotNull(), F.slice(source, F.lit(1), want))


def sample_rate(*rates: Column, fallback: float = 5000.0) -> Column:
    """The first positive finite rate."""
    return F.coalesce(*[F.when(finite(r) & (r > 0), r) for r in rates], F.lit(fallback))


def rate_gate(measured: Column, configured: float) -> Column:
    """Whether a read passes: an unknown or NaN rate does, an infinite one and one too far off don't."""
    off = F.abs(measured - configured) > max(1.0, 0.001 * configured)
    return measured.isNull() | F.isnan(measured) | ~off


def window_size(rate: Column, samples: Column, ms: Column, hop: Column) -> Column:
    """struct(size, hop) in samples: ``samples`` if positive, else ``ms`` at the rate rounded half-even, 1 at least; hop is size unless positive."""
    size = F.when(samples > 0, samples.cast("long")).otherwise(F.greatest(F.lit(1), F.rint(ms * rate / 1000).cast("long")))
    return once(size, lambda n: F.struct(n.alias("size"), F.when(hop > 0, hop.cast("long")).otherwise(n).alias("hop")))
