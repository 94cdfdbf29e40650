"""Edge cases of signals and calls, on hand-made rows."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import signal as S
from tidewater.functions.spectral import stft_logmag
from tidewater.operators import calls as C
from tidewater.operators import manifest as M
from tidewater.operators import quantise as Q
from tidewater.operators import windows as W
from tidewater.sources import io

INF, NAN = math.inf, math.nan


def one(spark, kind, value, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("x", "center", "half", "norm"),
    [
        ([3.0, 3.0], 3, 0, [0, 0]), ([1.0, NAN], 0, 0, [0, 0]), ([1.0, INF], 1, 0, [0, 0]), ([-INF, 4.0], 2, 2, [-1, 1]),
        ([], 0, 0, []), ([0.0, 1.0, 2.0], 1, 1, [-1, 0, 1]),
    ],
)
def test_normalise(spark, x, center, half, norm):
    row = one(spark, "array<double>", x, lambda c: F.struct(S.norm_stats(c).alias("s"), S.normalise_pm1(c, S.norm_stats(c)).alias("n")))
    assert (row.s.center, row.s.half_range, row.n) == (center, half, norm)


@pytest.mark.parametrize(
    ("n", "tail", "starts"),
    [
        (15, "drop", []), (16, "drop", [0]), (17, "drop", [0]), (0, "drop", []), (15, "shift_last", []), (16, "shift_last", [0]),
        (17, "shift_last", [0, 1]), (28, "shift_last", [0, 12]),
    ],
)
def test_window_starts(spark, n, tail, starts):
    assert one(spark, "int", n, lambda c: S.window_starts(c, 16, 12, tail)) == starts


def test_rounding_and_clipping(spark):
    got = [one(spark, "double", v, S.adc_round_clip) for v in (0.5, 1.5, 2.5, 1e9, -1e9)]
    assert got == [0, 2, 2, 32767, -32768]


def test_trim_pad(spark):
    assert one(spark, "array<double>", [1.0, 2.0], lambda c: S.trim(c, 4, 3, "pad")) == [1, 2, 2, 2]
    assert one(spark, "array<double>", [], lambda c: S.trim(c, 4, 3, "pad")) is None
    assert one(spark, "array<double>", [1.0, 2.0], lambda c: S.trim(c, 4, 3, "drop")) is None


def test_overlap_add_returns_the_input(spark):
    signal = [float(x * x % 17) for x in range(40)]
    reads = spark.createDataFrame([(1, signal)], "read_id long, x array<double>")
    rows = W.chunks(reads, F.col("x"), 16, 12, "drop", ())
    for op in (W.overlap_add(rows, 16, 12), W.direct_stitch(rows, 16, 12)):
        assert op.first().value == pytest.approx(signal)


def plain_stitch(chunks, size, hop, weighted):
    """chunks: (start, samples) in order."""
    n, overlap = chunks[-1][0] + size, max(size - hop, 0)
    value, weight = np.zeros(n), np.zeros(n)
    for i, (at, part) in enumerate(chunks):
        w = np.ones(size)
        for k in range(size):
            if i > 0 and k < overlap:
                w[k] = k / overlap
            if i < len(chunks) - 1 and k >= size - overlap:
                w[k] = 1 - (k - size + overlap) / overlap
        if weighted:
            value[at : at + size] += w * part
            weight[at : at + size] += w
        else:
            value[at : at + size] = part
    return value / np.where(weight == 0, 1, weight) if weighted else value


@pytest.mark.parametrize(("size", "hop", "segment"), [(16, 12, 16), (16, 5, 37), (8, 8, 24), (6, 9, 10), (16, 12, 1 << 16)])
def test_reads_over_many_segments(spark, size, hop, segment):
    rng = np.random.default_rng(size)
    lengths = {1: 1000, 2: size, 3: segment % 5000 + size, 4: 3 * hop + size}
    reads = spark.createDataFrame([(k, rng.normal(size=n).tolist()) for k, n in lengths.items()], "read_id long, x array<double>")
    for tail in ("drop", "shift_last"):
        rows = W.chunks(reads, F.col("x"), size, hop, tail, ()).withColumn("chunk", F.transform("chunk", lambda v: F.round(v, 1))).cache()
        parts = {}
        for r in rows.orderBy("read_id", "chunk_index").collect():
            parts.setdefault(r.read_id, []).append((r.start, np.array(r.chunk)))
        for weighted, op in ((True, W.overlap_add), (False, W.direct_stitch)):
            got = {}
            for r in op(rows, size, hop, segment).orderBy("read_id", "segment").collect():
                assert r.first == len(got.setdefault(r.read_id, [])) and 0 < len(r.value) <= segment
                got[r.read_id] += r.value
            assert got.keys() == parts.keys()
            for k, part in parts.items():
                assert got[k] == pytest.approx(plain_stitch(part, size, hop, weighted))


def test_errors_by_segment_are_those_of_the_read(spark):
    rng = np.random.default_rng(1)
    reads = spark.createDataFrame([(k, rng.integers(-50, 50, n).astype(float).tolist(), 1.5, 0.25) for k, n in ((1, 700), (2, 16), (3, 65))], "read_id long, adc array<double>, offset_adc double, scale double")
    reads = reads.withColumn("pa", S.to_picoamps(F.col("adc"), F.col("offset_adc"), F.col("scale")))
    rows = W.normalised(W.chunks(reads, F.col("pa"), 16, 12)).withColumn("hat", F.transform("norm", lambda v: F.rint(v * 4) / 4))
    rows = rows.withColumn("chunk", S.denormalise(F.col("hat"), F.col("center"), F.col("half_range")))
    one, many = (
        {r.read_id: list(r)[1:] for r in W.read_errors(W.reassembled(rows, 16, 12, sums=W.norm_sums(F.col("norm"), F.col("hat")), segment=s), reads, s).collect()}
        for s in (1 << 16, 32)
    )
    assert one.keys() == many.keys() == {1, 2, 3}
    for k in one:
        assert many[k] == pytest.approx(one[k])
    assert {k: v[0] for k, v in many.items()} == {1: 700, 2: 16, 3: 65}


def test_identity_and_quality(spark):
    rows = spark.createDataFrame([(1, "", ""), (2, "abc", ""), (3, "abc", "abd")], "read_id int, a string, b string")
    got = rows.select("read_id", C.identity(C.edit_distance(F.col("a"), F.col("b")), F.col("a"), F.col("b")).alias("i")).collect()
    assert [r.i for r in sorted(got)] == [1.0, 0.0, pytest.approx(2 / 3)]
    assert one(spark, "string", "", C.mean_qscore) == 0.0
    assert one(spark, "string", "I+", C.mean_qscore) == 25.0
    assert one(spark, "long", 0, lambda c: C.empirical_qscore(c, F.lit(10))) == 60.0


def test_nearest_code_ties_and_blocks(spark):
    book = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 5.0])], "code int, vec array<double>")
    rows = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.0, 4.0])], "vec_id long, vec array<double>")
    for found in (Q.nearest_code(rows, book), Q.nearest_code(rows, book, 1), Q.nearest_code_cross(rows, book)):
        assert {r.vec_id: r.code for r in found.collect()} == {7: 0, 8: 2}
    stats = Q.codebook_stats(Q.token_counts(Q.nearest_code(rows, book), book)).first()
    assert stats.usage == pytest.approx(2 / 3) and stats.perplexity == pytest.approx(2, abs=1e-6)


def test_sampling(spark):
    rows = spark.range(50).withColumnRenamed("id", "read_id")
    assert M.stable_sample(rows, 0, 1).count() == 0
    assert M.stable_sample(rows, 99, 1).count() == 50
    assert M.stable_sample(rows, 9, 1).collect() == M.stable_sample(rows.repartition(7), 9, 1).collect()
    with pytest.raises(ValueError, match="10 ids are missing, the first is 40"):
        M.require_all_ids(rows, rows.where("read_id < 40"))


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("junk\n@r1 more\nAC\nGT\n+\n@!!\nI\n@r2\nA\n+\nII\n")
    (tmp_path / "b.txt").write_bytes(gzip.compress(b"@r1\nTT\n+\n##\n"))
    got = {r.read_id: (r.seq, r.qual) for r in io.scan_fastq(spark, f"{tmp_path}/a.fastq", f"{tmp_path}/b.txt").collect()}
    assert got == {"r1": ("TT", "##"), "r2": ("A", "I")}
    assert list(io.parse_fastq("@r1 more\nAC\nGT\n+\n@!!\nI\n".splitlines())) == [("r1", "ACGT", "@!!I")]


def test_stft(spark):
    x = np.arange(16.0)
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(stft_logmag(16, 4, 16)("x").alias("y")).first().y
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 15)
    assert got == pytest.approx(np.log1p(np.abs(np.fft.rfft(x * w))).tolist())


def test_norms_of_long_arrays(spark):
    """A lambda that worked out its norm for each element would need 8 * 10 ** 9 steps here and more."""
    x = np.sin(np.arange(2000.0))
    rows = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    c = F.col("x")
    unit, soft, same = rows.select(S.l2_norm(S.rms_norm(c)), S.softmax(c), S.cosine_loss(c, c)).first()
    assert np.allclose(unit, x / np.linalg.norm(x))
    assert np.allclose(soft, np.exp(x) / np.exp(x).sum())
    assert abs(same) < 1e-9
