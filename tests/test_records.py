"""Edge cases of calls, manifests, logs and sources, on hand-made rows."""

import gzip
import math
import random
import uuid
import warnings
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidewater.functions import signal as S
from tidewater.functions.spectral import scale
from tidewater.operators import calls as C
from tidewater.operators import manifest as M
from tidewater.operators import nested
from tidewater.operators import quantise as Q
from tidewater.operators import runlog as L
from tidewater.operators import windows as W
from tidewater.operators.quantiles import quantiles
from tidewater.plans import records
from tidewater.sources import fastq, io
from tidewater.streaming import streams


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choices("ab é"[: rng.randint(1, 4)], k=rng.randint(0, 90))) for _ in range(2))
        if rng.random() < 0.5:
            at = rng.randint(0, len(a))
            b = a[:at] + rng.choice(["", "x", "ab"]) + a[at + rng.randint(0, 3) :]
        assert C.distance(a, b) == C.distance(b, a) == table_distance(a, b)


def test_distances_side_by_side():
    rng = random.Random(6)
    pairs = [("", ""), ("", "ab"), ("é" * 9000, "é" * 8999 + "x"), ("".join(map(chr, range(300, 700))), "".join(map(chr, range(310, 720))))]
    for _ in range(900):
        a = "".join(rng.choices("abcé"[: rng.randint(1, 4)], k=rng.randint(0, 300)))
        drop = rng.choice([0, 0.02, 0.3, 0.9])
        b = "".join(c for c in a if rng.random() >= drop) if rng.random() < 0.7 else "".join(rng.choices("abx", k=rng.randint(0, 200)))
        pairs.append(rng.choice([(a, b), (b, a)]))
    got = C.distances(*map(list, zip(*pairs, strict=True)))
    assert list(got) == [C.distance(a, b) for a, b in pairs] and len(C.distances([], [])) == 0


def test_distance_of_long_sequences():
    rng = random.Random(5)
    a = "".join(rng.choices("ACGT", k=20_000))
    b = a[:5000] + "T" + a[5000:12_000] + a[12_003:]
    assert C.distance(a, b) <= 4 and C.distance(a, "") == 20_000


def test_distance_in_bands(monkeypatch):
    """Bands of any width give the distance if it is within them, and a larger number if not."""
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 400))) for _ in range(2))
        if rng.random() < 0.7:
            b = list(a)
            for _ in range(rng.randint(1, 40)):
                at = rng.randint(0, len(b))
                b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab", "c" * rng.randint(0, 30)])
            b = "".join(b)
        a, b = sorted((a, b), key=len)
        if not a:
            continue
        want = table_distance(a, b)
        where = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}
        for most in {len(b) - len(a), want - 1, want, want + 1, 2 * want, len(b)}:
            if most >= len(b) - len(a):
                got = C._banded(where, len(a), b, most)
                assert got == want if want <= most else got > most, (a, b, most)
        with monkeypatch.context() as m:
            m.setattr(C, "BANDED", 1)
            assert C.distance(a, b) == want


def test_distance_of_sequences_with_errors():
    """Long sequences with one error in fifty take a band, and give what the whole table gives."""
    rng = random.Random(7)
    a = "".join(rng.choices("ACGT", k=12_000))
    b = "".join(rng.choice(["", "A", "CG", c + "T"]) if rng.random() < 0.02 else c for c in a)
    where = {c: sum(1 << i for i, x in enumerate(min(a, b, key=len)) if x == c) for c in "ACGT"}
    whole = C._banded(where, min(len(a), len(b)), max(a, b, key=len), max(len(a), len(b)))
    assert C.distance(a, b) == whole > 100


def test_call_summary_without_shared_ids(spark):
    left = spark.createDataFrame([(1, "ACGT", "IIII"), (2, "A", "I")], "read_id long, seq string, qual string")
    row = C.call_summary(left, left.withColumn("read_id", F.col("read_id") + 10)).first()
    assert (row.shared, row.left_count, row.right_count, row.left_only, row.right_only, row.exact_rate, row.identity_mean) == (0, 2, 2, 2, 2, 0.0, 0.0)
    none = left.where("false")
    assert C.call_summary(none, none).first().weighted_identity == 0.0


def test_group_report_has_every_group(spark):
    groups = spark.createDataFrame([("x",), ("none",)], "barcode string")
    rows = spark.createDataFrame([("x", 5, "AC", None), ("x", 9, "ACGT", None), ("x", None, None, "no raw read")], "barcode string, raw_length long, seq string, reason string")
    got = {r.barcode: tuple(r[1:]) for r in M.group_report(groups, rows, rows.where("raw_length = 9")).collect()}
    assert got == {"x": (3, 2, 1, 9, 9, 4, 4), "none": (0,) * 7}


def test_require_contained(spark):
    index = spark.createDataFrame([(1, "a", 10), (2, "a", 99)], "read_id long, source_file string, raw_length long")
    some = spark.createDataFrame([(1,), (2,), (3,)], "read_id long")
    assert {tuple(r) for r in M.not_contained(some, index, 5, 50).collect()} == {(2, "out of bounds"), (3, "unknown")}
    assert M.require_contained(some.where("read_id < 3"), index, 5).count() == 2
    with pytest.raises(ValueError, match="2 reads are unknown or out of bounds, the first is 2"):
        M.require_contained(some, index, 5, 50)


def test_nearest_code_of_codes_far_from_the_origin(spark):
    """The product form can't tell codes apart that differ in the last digits of large numbers."""
    base = np.full(4, 1e6)
    book = [(k, (base + 1e-3 * np.array([k % 3, k % 5, 0, k])).tolist()) for k in range(20)]
    rows = [(k, (np.array(v) + 2e-4).tolist()) for k, v in book]
    latents = spark.createDataFrame(rows, "vec_id int, vec array<double>")
    codes = spark.createDataFrame(book, "code int, vec array<double>")
    want = {r.vec_id: r.code for r in Q.nearest_code_cross(latents, codes).collect()}
    for block in (3, 2048):
        assert {r.vec_id: r.code for r in Q.nearest_code(latents, codes, block).collect()} == want


def test_running_best_over_blocks(spark):
    rng = random.Random(1)
    rows = [(s, rng.choice("ab"), rng.choice([None, *map(float, range(30))])) for s in range(0, 600, 3)]
    df = spark.createDataFrame(rows, "step long, run string, m double")
    for by in ((), ("run",)):
        state, want = {}, []
        for s, run, m in rows:
            if m is not None:
                key = run if by else None
                new = key not in state or m > state[key][0]
                if new:
                    state[key] = (m, s)
                want.append((*((run,) if by else ()), s, m, *state[key], new))
        for block in (7, 100_000):
            assert sorted(map(tuple, L.running_best(df, F.col("m"), *by, block=block).collect())) == sorted(want)


def test_logs(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(1, 11)], "step long, step_ms double")
    assert [r.step for r in L.trim_rank_range(rows, "step", 3).orderBy("step").collect()] == [4, 5, 6, 7]
    assert L.timing_summary(rows, 2, 5, 3).first()[:4] == (4, 4, 7, 5.5)
    with pytest.raises(ValueError, match="10 rows"):
        L.trim_rank_range(rows, "step", 5)
    names = spark.createDataFrame([("a", 1.0), ("keep_b", 2.0), ("c", 3.0)], "metric string, value double")
    assert {r.metric for r in L.metric_rename(names, {"a": "z"}, "valid", "keep_").collect()} == {"valid/z", "valid/keep_b"}
    assert {r.metric for r in L.metric_rename(names, {"a": "z"}).collect()} == {"z"}


def test_loss_weights(spark):
    rows = spark.createDataFrame(
        [(5, "time_l1", 1.0), (5, "diff1_l1", 9.0), (5, "small_stft_logmag_l1", 2.0), (5, "conv1", 4.0), (5, "conv2", 8.0), (5, "other", 100.0)],
        "step long, metric string, value double",
    )
    one = lambda *a, **k: tuple(L.loss_weighting(rows, *a, **k).first()[1:])
    assert one({}) == (1.0, 0.0, 0.0, 1.0)
    assert one({"stft_logmag_l1": 3.0}, ("conv1", "conv2")) == (7.0, 6.0, 6.0, 13.0)
    assert one({"small_stft_logmag_l1": 1.0, "time_l1": 0}, ("conv1",), {"conv1": 2.0}, scale=0.5, start=5, warm=4) == (2.0, 8.0, 1.0, 3.0)
    assert one({}, ("conv1",), start=6) == (1.0, 4.0, 0.0, 1.0)
    with pytest.raises(ValueError, match="differ"):
        L.loss_weighting(rows, {}, ("conv1",), {"conv2": 1.0})


def test_feature_maths(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [0.5, 0.5]), ([1.0, 3.0], [2.0, 6.0])], "x array<double>, y array<double>")
    zero, one = rows.select(S.kl_loss(F.col("x"), F.col("y")).alias("kl"), S.cosine_loss(F.col("x"), F.col("y")).alias("cos"), S.l2_norm(F.col("x"), 3.0).alias("l2")).collect()
    assert zero.kl == pytest.approx(2e-6 * (np.log(1e-6) - np.log(0.5))) and zero.cos == 1.0 and zero.l2 == [0.0, 0.0]
    assert one.kl == pytest.approx(0, abs=1e-12) and one.cos == pytest.approx(0, abs=1e-9)
    seq = spark.createDataFrame([(0, t, [float(t), 7.0]) for t in range(4)], "seq int, t int, vec array<double>")
    got = W.feature_standardise(seq).groupBy("i").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).orderBy("i").collect()
    assert [(round(r.m, 9), round(r.v, 6)) for r in got] == [(0.0, 1.0), (0.0, 0.0)]
    assert [scale(), scale(8), scale(8, 20), scale(8, 4, 3), scale(2, 2)] == [(256, 256, 64), (8, 8, 2), (8, 8, 2), (8, 4, 3), (2, 2, 1)]


def test_scan_reads(spark, tmp_path):
    rows = spark.createDataFrame([("r1",), ("r2",)], "read_id string")
    rows.where("read_id = 'r1'").write.parquet(f"{tmp_path}/a/deep")
    rows.where("read_id = 'r2'").write.parquet(f"{tmp_path}/b")
    ids = lambda *a, **k: sorted(r.read_id for r in io.scan_reads(spark, str(tmp_path), *a, schema=rows.schema, **k).collect())
    assert ids() == ["r1", "r2"] and ids(("b", "missing")) == ["r2"]
    assert ids(("b",), (f"{tmp_path}/a",)) == ["r1"]
    for bad in (("missing",), ("none", "missing")):
        with pytest.raises(FileNotFoundError):
            ids(bad)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        ids(("empty",))
    (tmp_path / "b" / "bad.parquet").write_text("damaged")
    with pytest.warns(UserWarning, match="damaged"):
        assert ids(skip_corrupt=True) == ["r1", "r2"]


def fastq_text(rng, n):
    """Records of one or several lines, quality lines that look like headers or ``+`` lines, odd lines between them, repeated ids."""
    text, want = "", {}
    for k in range(n):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 7, 40, 300])))
        qual = "".join(rng.choices("@+IJ!", k=len(seq)))
        width = rng.choice([1000, 13])
        lines = lambda x: "".join(x[i : i + width] + "\n" for i in range(0, len(x), width)) or "\n"
        text += f"@r{k % (n - 20)} x\n{lines(seq)}+{rng.choice(['', 'again'])}\n{lines(qual)}" + rng.choice(["", "", "\n"])
        want[f"r{k % (n - 20)}"] = (seq, qual)
    return text.encode(), want


def in_blocks(data, size):
    """The bytes as block gzip, blocks of ``size`` bytes, with the empty one at the end."""

    def block(part):
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(6) + b"\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little")
        return head + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")

    return b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b"")


def test_fastq_splits_find_their_records():
    """Every split of every size gives its own records, once each, for plain, block gzip and plain gzip files."""
    rng = random.Random(6)
    data, want = fastq_text(rng, 300)
    files = {"plain": data, "blocks": in_blocks(data, 700), "gzip": gzip.compress(data[:5000]) + gzip.compress(data[5000:])}
    for kind, raw in files.items():
        for size in (500, 1777, 10**9):
            starts = list(range(0, len(raw), size)) if kind != "gzip" else [0]
            rows = []
            for at, to in zip(starts, [*starts[1:], None], strict=True):
                file = pa.BufferReader(raw)
                assert fastq.kind_of(file) == kind
                rows += [r for b in fastq._batches(fastq.Split("f", kind, at, to), file, len(raw), 7, look=1500) for r in b.to_pylist()]
            assert len(rows) == 300 and [r["at"] for r in rows] == sorted({r["at"] for r in rows}), (kind, size)
            assert {r["read_id"]: (r["seq"], r["qual"]) for r in rows} == want


def test_a_file_that_deceives_is_refused():
    """Quality lines that spell whole records: the border rule can take one of them for a header."""
    inner = "@q\nAC\n+\nII\n"
    qual = "@" * 3 + "\n" + inner * 200
    record = f"@r\n{'A' * (3 + 200 * 6)}\n+\n{qual}"
    data = (record * 3).encode()
    whole = [r for b in fastq._batches(fastq.Split("f", "plain", 0, None), pa.BufferReader(data), len(data)) for r in b.to_pylist()]
    assert [r["read_id"] for r in whole][0] == "r"
    with pytest.raises(ValueError, match="split=0"):
        list(fastq._batches(fastq.Split("f", "plain", 0, len(record) // 2), pa.BufferReader(data), len(data), look=100))


def test_scan_fastq_over_several_tasks(spark, tmp_path):
    data, want = fastq_text(random.Random(7), 400)
    (tmp_path / "a.fastq").write_bytes(data)
    rows = io.scan_fastq(spark, str(tmp_path), split=3000)
    assert {r.read_id: (r.seq, r.qual) for r in rows.collect()} == want
    source = spark.read.format("fastq").option("split", 3000).load(str(tmp_path))
    assert source.rdd.getNumPartitions() == -(-len(data) // 3000) and source.count() == 400
    (tmp_path / "b.txt").write_bytes(gzip.compress(b"@r0\nA\n+\nI\n"))  # gzip whatever the suffix, later by name
    assert {r.read_id: (r.seq, r.qual) for r in io.scan_fastq(spark, f"{tmp_path}/a.fastq", f"{tmp_path}/b.txt").collect()} == want | {"r0": ("A", "I")}
    with pytest.raises(Exception, match="missing"):
        io.scan_fastq(spark, f"{tmp_path}/missing").count()


def test_append_history_keeps_what_is_there(spark, tmp_path):
    schema = "evaluation string, step long, status string, metric double, checkpoint_path string"
    one = spark.createDataFrame([("run/1", 5, "ok", 1.5), ("run/1", 6, "ok", None)], "evaluation string, step long, status string, metric double")
    failed = io.failures(spark.createDataFrame([("e7", 7, "ckpt/7")], "evaluation string, step long, checkpoint_path string"))
    read = lambda: sorted(map(repr, map(tuple, io.read_history(spark, f"{tmp_path}/h", schema).collect())))
    want = sorted(map(repr, [("run/1", 5, "ok", 1.5, None), ("run/1", 6, "ok", None, None), ("e7", 7, "failed", None, "ckpt/7")]))
    for documents in (one, failed, one, failed):  # repeats add nothing, nor do they take anything away
        io.append_history(documents, f"{tmp_path}/h")
    assert read() == want
    io.append_history(one.withColumn("status", F.lit("again")), f"{tmp_path}/h")  # an evaluation is replaced as a whole
    assert [x for x in read() if "again" in x] == [x.replace("'ok'", "'again'") for x in want if "'ok'" in x] and len(read()) == 3


def test_quantiles_against_sorting(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(9)
    cases = {
        "ties": [3.0] * 40 + [1.0] * 3 + [7.0] * 2, "one": [5.5], "two": [1.0, 2.0], "nan": [1.0, nan, 3.0, nan, 2.0], "infinite": [-inf, inf, 0.0, -1.0, inf],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-30, 30) for _ in range(60)], "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324],
        "many": [rng.gauss(0, 1) for _ in range(500)], "close": [1.0 + k * 2**-52 for k in range(30)],
    }
    rows = [(g, x, None if g == "one" else x) for g, xs in cases.items() for x in xs] + [("many", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    probabilities = (0.0, 0.25, 0.5, 0.9, 1.0)

    def want(xs, p):
        xs = sorted(xs, key=lambda v: (v != v, v))
        k = p * (len(xs) - 1)
        low, high = xs[math.floor(k)], xs[math.ceil(k)]
        return low if k == math.floor(k) or low == high else low + (high - low) * (k - math.floor(k))

    for options in ({"small": 3, "buckets": 512}, {}):
        got = {(r.g, r.column, r.p): r.value for r in quantiles(df, ("x", "y"), probabilities, "g", **options).collect()}
        assert ("one", "y", 0.5) not in got
        for g, xs in cases.items():
            for p in probabilities:
                assert repr(got[g, "x", p] + 0.0) == repr(want(xs, p) + 0.0), (g, p, options)
    assert quantiles(df.where("false"), ("x",), (0.5,)).count() == 0
    row = W.summarise(df.where("false"), "x").first()
    assert tuple(row) == (0.0,) * 4


def test_summaries_hold_no_column_in_a_task(spark):
    rows = spark.range(5000).select(F.col("id").alias("step"), (F.col("id") % 977).cast("double").alias("step_ms"))
    for df in (W.summarise(rows, "step_ms"), L.timing_summary(rows, 2, 5, 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan.lower() and "median(" not in plan.lower()
    assert W.summarise(rows, "step_ms").first().step_ms_median == sorted(k % 977 for k in range(5000))[2499] * 0.5 + sorted(k % 977 for k in range(5000))[2500] * 0.5


def drained(spark, root, op):
    """What has arrived below ``root`` so far, through ``op`` and the sink; state and sink stay for the next call."""
    out = op(spark.readStream.schema("run string, step long, metric string, value double").option("recursiveFileLookup", True).parquet(f"{root}/in"))
    writer = out.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    writer.foreachBatch(streams.batch_sink(f"{root}/out")).start().awaitTermination()
    return streams.read_sink(spark, f"{root}/out", out)


def arrive(spark, root, name, rows):
    spark.createDataFrame(rows, "run string, step long, metric string, value double").write.parquet(f"{root}/in/{name}")


def test_step_windows_close_once_over_restarts(spark, tmp_path):
    op = lambda s: streams.stream_step_windows(s, 10, 5)
    got = lambda: sorted(map(tuple, drained(spark, tmp_path, op).select("block", "metric", "value", "batch").collect()))
    rows = [("a", s, m, float(s * k)) for s in range(1, 48) for m, k in (("loss", 1), ("perplexity", 2)) if s != 20 or m == "loss"]
    random.Random(1).shuffle(rows)
    early, rest = [r for r in rows if r[1] <= 30], [r for r in rows if r[1] > 30]
    arrive(spark, tmp_path, "0", early)
    first = got()
    assert [r[:3] for r in first] == [(0, "loss", 5.5), (0, "perplexity", 20.0), (1, "loss", 15.5)]  # step 30 does not close its own block
    arrive(spark, tmp_path, "1", rest)
    second = got()
    assert second[:3] == first and [r[:3] for r in second[3:]] == [(2, "loss", 25.5), (2, "perplexity", 60.0), (3, "loss", 35.5), (3, "perplexity", 80.0)]
    arrive(spark, tmp_path, "2", [("a", 5, "loss", 1e6), ("a", 53, None, None)])  # late, and the run's last line: block 4 is not whole
    assert got() == second
    batch = L.step_window_mean(spark.createDataFrame(rows, "run string, step long, metric string, value double"), 10).collect()
    assert sorted((r.block, r.metric, r.value) for r in batch) == [r[:3] for r in second]


def test_running_best_in_order_of_steps(spark, tmp_path):
    for name, value in streams.STATE_STORE.items():
        spark.conf.set(name, value)
    op = lambda s: streams.stream_running_best(s.select("run", "step", F.col("value").alias("metric")), 20)
    rng, nan = random.Random(2), float("nan")
    rows = [(run, s, None, rng.choice([None, nan, *map(float, range(40))])) for run in "abc" for s in range(1, 120)]
    rows[0], rows[119] = ("a", 1, None, nan), ("b", 1, None, 5.0)  # a begins with NaN and keeps it
    rows.sort(key=lambda r: r[1] + rng.random() * 19)
    for k in range(3):
        arrive(spark, tmp_path, str(k), rows[k * 119 : (k + 1) * 119])
        drained(spark, tmp_path, op)
    arrive(spark, tmp_path, "3", [(r, None, None, None) for r in "abc"] + [("a", 2, None, 99.0)])
    out = drained(spark, tmp_path, op)
    flat = lambda df: sorted(repr(tuple(r)) for r in df.select("run", "step", "metric", "best", "best_step", "is_new_best").collect())
    evals = spark.createDataFrame(rows, "run string, step long, metric string, value double")
    want = flat(L.running_best(evals, F.col("value"), "run", block=37))
    late = out.where("late").collect()
    assert flat(out.where("not late")) == want and [(r.run, r.step, r.metric, r.is_new_best) for r in late] == [("a", 2, 99.0, False)]
    again = out.where("batch = 1").drop("batch")
    again = spark.createDataFrame(again.collect(), again.schema)
    assert again.count() > 0
    streams.batch_sink(f"{tmp_path}/out")(again, 1)  # a repeated batch
    assert flat(streams.read_sink(spark, f"{tmp_path}/out", out.drop("batch")).where("not late")) == want


def test_nan_in_running_best(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("x", 1, nan), ("x", 2, 5.0), ("y", 1, 3.0), ("y", 2, nan), ("y", 3, 4.0)], "run string, step long, m double")
    got = {(r.run, r.step): (repr(r.best), r.best_step, r.is_new_best) for r in L.running_best(rows, F.col("m"), "run", block=2).collect()}
    assert got == {("x", 1): ("nan", 1, True), ("x", 2): ("nan", 1, False), ("y", 1): ("3.0", 1, True), ("y", 2): ("3.0", 1, False), ("y", 3): ("4.0", 3, True)}


def test_log_lines_and_whole_blocks(spark):
    lines = spark.createDataFrame([("[step 7] a=nan, b/c=-inf, d=inf, e=1.5e-3",), ("[perf step  8] x_pct=2.0",), ("[step x] a=1",)], "value string")
    got = sorted((r.step, r.perf, r.metric, repr(r.value)) for r in L.parse_step_log(lines).collect())
    assert got == [(7, False, "a", "nan"), (7, False, "b/c", "-inf"), (7, False, "d", "inf"), (7, False, "e", "0.0015"), (8, True, "x_pct", "2.0")]
    times = spark.createDataFrame([(s, 1.0, 3.0, 1.0) for s in range(1, 26)], "step long, wait double, compute double, sync double")
    assert [(r.block, r.step_ms, r.host_sync_pct) for r in L.perf_window(times, 10).orderBy("block").collect()] == [(0, 4.0, 25.0), (1, 4.0, 25.0)]


def test_nested_documents(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, "x", None, 5)], "n int, `a.mean` double, `a.name` string, `a.b.low` double, `a.b.high` long")
    doc = nested.nest(rows)
    assert doc.columns == ["n", "a"] and doc.first().asDict(True) == {"n": 1, "a": {"mean": 2.0, "name": "x", "b": {"low": None, "high": 5}}}
    assert nested.flat(doc).columns == rows.columns and tuple(nested.flat(doc).first()) == tuple(rows.first())
    io.write_summary(rows, f"{tmp_path}/doc")
    back = spark.read.schema(doc.schema).json(f"{tmp_path}/doc")
    assert {tuple(r) for r in nested.metrics(back, "p/").collect()} == {("p/n", 1.0), ("p/a.mean", 2.0), ("p/a.b.high", 5.0)}
    with pytest.raises(ValueError, match="both"):
        nested.nest(spark.createDataFrame([(1, 2)], "a int, `a.b` int"))


def test_comparison_of_runs(spark):
    kind = "struct<shared:bigint,weighted_identity:double,mean_empirical_q:double,mean_predicted_q:double>"
    runs = spark.createDataFrame([(0, "x", (7, 0.5, 10.25, 3.0), (7, 0.75, 10.0, 9.0)), (1, "y", None, (7, 0.75, None, 9.0))], f"position int, name string, generated {kind}, original {kind}")
    assert sorted(map(tuple, C.comparison(runs).collect())) == [
        (0, "x", 7, "0.500000", "10.2500", "3.0000", "-0.250000", "+0.2500"),
        (1, "y", 0, "0.000000", "0.0000", "0.0000", "-0.750000", "+0.0000"),
    ]


def test_truth_of_the_last_barcode(spark):
    rows = spark.createDataFrame([(1, "b2", "chr1", 100, 200), (1, "b1", "chr1", 100, 200), (2, "b1", "chr1", 5000, 5100)], "read_id long, barcode string, ref string, rstart long, rend long")
    records = [(1, "b1", "chr1", 150, 160, 1, "ONE"), (1, "b2", "chr9", 150, 160, 3, "FAR"), (1, "b2", "chr9", 1, 2, 2, ""), (2, "b2", "chr1", 5000, 5001, 4, "OTHER")]
    found = spark.createDataFrame(records, "read_id long, barcode string, ref string, start_pos long, end_pos long, ordinal long, seq string")
    got = lambda a: sorted(map(tuple, M.truth_lookup(rows, a).collect()))
    assert got(found) == [(1, False, 3, "FAR")]  # the later barcode's, though only the earlier one's overlaps
    assert got(found.drop("barcode")) == [(1, True, 1, "ONE"), (2, True, 4, "OTHER")]


def test_codes_beyond_what_is_sent(spark):
    """A codebook in shards gives what it gives in one piece, and far lengths are passed over."""
    rng = np.random.default_rng(4)
    book = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(60, 3)) * rng.uniform(0.01, 50, (60, 1)))] + [(60, [0.0] * 3), (61, [1.0] * 3), (62, [1.0] * 3)]
    latents = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 3)) * rng.uniform(0.01, 60, (200, 1)))] + [(200, [0.0] * 3), (201, [1.0] * 3), (202, [999.0] * 3)]
    codes, rows = spark.createDataFrame(book, "code int, vec array<double>"), spark.createDataFrame(latents, "vec_id long, vec array<double>")
    want = sorted((r.vec_id, r.code, round(r.distance, 9)) for r in Q.nearest_code(rows, codes).collect())
    for found in (Q.nearest_code(rows, codes, most=8), Q.nearest_code_sharded(rows, codes, 3, 8, per_task=20), Q.nearest_code_sharded(rows, codes, 2048, 1000)):
        assert sorted((r.vec_id, r.code, round(r.distance, 9)) for r in found.collect()) == want
    assert Q.quantise(Q.nearest_code(rows, codes, most=8), codes).count() == 203
    assert Q.nearest_code(rows, codes.where("false")).count() == 0


def test_batches_fill_over_arrow_batches(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        """A scorer that says how often it was made and called, and with what."""
        note = lambda what: open(f"{folder}/{uuid.uuid4().hex}-{what}", "w").close()  # noqa: E731, SIM115
        note("made")
        return lambda x: (note(f"call-{x.shape[0]}"), x * 2)[1]

    rows = spark.createDataFrame([(k, k % 3, [float(k)] * (4 if k < 90 else 6)) for k in range(100)], "read_id long, chunk_index int, chunk array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.read_id: r.score for r in Q.score_chunks(rows, size=32, factory=factory).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: [2.0 * k] * (4 if k < 90 else 6) for k in range(100)}
    said = sorted(f.name.split("-", 1)[1] for f in tmp_path.iterdir())
    assert said == ["call-32"] * 4 + ["made"]  # 90 chunks are three batches, 10 one
    with pytest.raises(ValueError, match="factory"):
        Q.score_chunks(rows)


def test_quarantined_files_are_not_opened_again(spark, tmp_path):
    rows = spark.createDataFrame([("r1",)], "read_id string")
    rows.write.parquet(f"{tmp_path}/in")
    good = next((tmp_path / "in").glob("*.parquet"))
    (tmp_path / "in" / "short.parquet").write_bytes(good.read_bytes()[:-40])
    (tmp_path / "in" / "odd.parquet").write_bytes(good.read_bytes()[:-8] + b"\xff\xff\xff\x7fPAR1")
    ids = lambda: sorted(r.read_id for r in io.scan_reads(spark, f"{tmp_path}/in", schema=rows.schema, skip_corrupt=True, quarantine=f"{tmp_path}/bad").collect())
    with pytest.warns(UserWarning, match="2 damaged"):
        assert ids() == ["r1"]
    bad = {r.path.rsplit("/", 1)[1]: r.reason for r in io.quarantined(spark, f"{tmp_path}/bad").collect()}
    assert bad.keys() == {"short.parquet", "odd.parquet"}
    (tmp_path / "in" / "short.parquet").write_bytes(good.read_bytes())  # sound by now, but known as damaged
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert ids() == ["r1"]
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        io.scan_reads(spark, f"{tmp_path}/in", schema=rows.schema).collect()


def test_window_sizes_and_rates(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(None, 4000.0, 100, 5), (nan, inf, 0, 0), (inf, -1.0, None, None), (3999.0, 1.0, -4, -1)], "a double, b double, s int, h int")
    rate = S.sample_rate(F.col("a"), F.col("b"))
    got = [(r.rate, r.w.size, r.w.hop) for r in rows.select(rate.alias("rate"), S.window_size(rate, F.col("s"), F.lit(2.5), F.col("h")).alias("w")).collect()]
    assert got == [(4000.0, 100, 5), (5000.0, 12, 12), (5000.0, 12, 12), (3999.0, 10, 10)]
    assert [r[0] for r in rows.select(S.rate_gate(F.col("a"), 4000.0)).collect()] == [True, True, False, True]
    quals = spark.createDataFrame([("I+",), ("",), (None,), ("é!",)], "q string")
    assert [r[0] for r in quals.select(C.mean_qscore("q")).collect()] == [25.0, 0.0, None, (ord("é") - 33) / 2]


def test_streamed_evaluations_of_many_files(spark, tmp_path, monkeypatch):
    """Runs that begin with NaN, and more files in a part than a batch took, the latest steps first: both as in the SQL."""
    kind = ["view", "signup", "view", "purchase", "click", "error"]
    rows = [(s, kind[s] if s < 6 else kind[s * 7 % 6], float(s * 37 % 1009)) for s in range(6000)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, value double")
    for k in range(6):
        events.where(f"event_id div 1000 = {5 - k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    for t in ("orders", "lineitem", "conversations", "embeddings"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    monkeypatch.setattr(records, "TOGETHER", 1500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # a file is a task
    try:
        out = records.stream_running_best(spark, str(tmp_path)).select("run", "step", "metric", "best", "best_step", "is_new_best").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select run, step, metric, best, best_step, is_new_best from ({records.ORACLE['stream_running_best']})").fetchall()
    assert ("purchase", 3) in {r[:2] for r in want} and sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    evals = spark.createDataFrame([r[:3] for r in want], "run string, step long, metric double")
    again = L.running_best(evals, F.col("metric"), "run", block=700, nan_stays=False).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, want))


def test_step_log_rounds_as_its_sql(spark, tmp_path):
    """Values halfway between two of three places, beyond numbers, and none."""
    odd = [None, float("nan"), float("inf"), float("-inf"), 1e-9, -0.0004, 12345678.90125, 1e17]
    values = odd + [k / 10000 * 1.001 for k in range(5, 20000, 10)] + [k / 10000 for k in range(5, 40000, 10)]
    spark.createDataFrame([(k, k if k % 50 else None, v) for k, v in enumerate(values)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = records.parse_step_log(spark, str(tmp_path)).select("step", "metric", "value").collect()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select step, metric, value from ({records.ORACLE['parse_step_log']})").fetchall()
    plain = lambda rows: sorted((s, m, repr(v if v is None else v + 0.0)) for s, m, v in rows)
    assert plain(map(tuple, got)) == plain(want)


def test_step_log_keeps_every_row_and_sign(spark, tmp_path):
    """Zeros below zero, values too large to be multiplied, steps below zero and rows without one, as in the SQL."""
    values = [-0.0, 0.0, -0.0004, -0.0005, -1.2345, 5e306, -5e306, 1.7e305, 3.25]
    rows = [(k, -k, v) for k, v in enumerate(values, 1)] + [(-k, k, 0.5) for k in range(1, 90)] + [(None, 7, 1.5), (None, None, -0.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = records.parse_step_log(spark, str(tmp_path)).select("step", "metric", "value").collect()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select step, metric, value from ({records.ORACLE['parse_step_log']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
