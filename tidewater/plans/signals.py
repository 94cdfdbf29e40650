"""Queries of reads, chunks, spectra and codes, each with its equivalent in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import signal as S
from tidewater.functions import spectral as P
from tidewater.operators import quantise as Q
from tidewater.operators import windows as W
from tidewater.sources import io
from tidewater.storage import shared_folder

from .fixtures import VIEWS, fixture, oracle

SIZE, HOP = 16, 12
PART = 64  # samples of a segment: the reads of the small tables are many segments
QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = oracle(sql, DUCK)
        return f

    return add


def r6(name: str, by: int = 6):
    return (F.round(F.col(name), by) + 0.0).alias(name)


def _normal(chunk: str, stat: str) -> str:
    return f"""
select c.*, s.center, s.half_range,
       case when s.half_range < 1e-6 then 0 else greatest(-1, least(1, (c.pa - s.center) / s.half_range)) end as norm
from {chunk} c join {stat} s using (read_id, chunk_index)"""


def _cut(chunk: str) -> str:
    return f"""
select c.*, p.pos - c.start as k, p.pa, p.adc, p.offset_adc, p.scale
from {chunk} c join d_pa p on p.read_id = c.read_id and p.pos >= c.start and p.pos < c.start + {SIZE}"""


_STAT = "select read_id, chunk_index, (min(pa) + max(pa)) / 2 as center, (max(pa) - min(pa)) / 2 as half_range from {} group by 1, 2"
_NUMBER = """row_number() over (partition by read_id order by start) - 1 as chunk_index,
       count(*) over (partition by read_id) as n_chunks"""
#: Steps of the oracle: samples as rows instead of arrays.
DUCK = {
    "d_valid": "select * from reads_meta where scale is not null and not isnan(scale) and abs(scale) > 1e-8",
    "d_pa": """
select s.read_id, s.pos, s.adc, v.offset_adc, v.scale, v.raw_length, (s.adc + v.offset_adc) * v.scale as pa
from samples s join d_valid v using (read_id)""",
    "d_drop": f"""
select read_id, raw_length, unnest(range(0, raw_length - {SIZE} + 1, {HOP})) as start from d_valid where raw_length >= {SIZE}""",
    "d_shift": f"""
select read_id, start, {_NUMBER}
from (select read_id, start from d_drop union select read_id, raw_length - {SIZE} from d_valid where raw_length >= {SIZE})""",
    "d_dropn": f"select read_id, start, {_NUMBER} from d_drop",
    "d_chunk": _cut("d_shift"),
    "d_chunkd": _cut("d_dropn"),
    "d_stat": _STAT.format("d_chunk"),
    "d_norm": _normal("d_chunk", "d_stat"),
    "d_statd": _STAT.format("d_chunkd"),
    "d_normd": _normal("d_chunkd", "d_statd"),
    "d_coarse": """
select *, case when half_range < 1e-6 then center else round_even(norm * 8, 0) / 8 * half_range + center end as rebuilt,
       round_even(norm * 8, 0) / 8 as norm_hat
from d_normd""",
    "d_weight": f"""
select *, case when n_chunks <= 1 then 1.0
               when chunk_index < n_chunks - 1 and k >= {HOP} then 1 - (k - {HOP}) / {float(SIZE - HOP)}
               when chunk_index > 0 and k < {SIZE - HOP} then k / {float(SIZE - HOP)} else 1.0 end as w
from d_coarse""",
    "d_added": """
select read_id, start + k as pos, sum(rebuilt * w) / (case when sum(w) = 0 then 1 else sum(w) end) as value
from d_weight group by 1, 2""",
    "d_errors": """
select read_id, n as trimmed_length, chunk_count, norm_mae, norm_rmse, pa_mae, pa_rmse, adc_mae, adc_rmse
from (select a.read_id, count(*) as n, avg(abs(p.pa - a.value)) as pa_mae, sqrt(avg(power(p.pa - a.value, 2))) as pa_rmse,
             avg(abs(p.adc - h)) as adc_mae, sqrt(avg(power(p.adc - h, 2))) as adc_rmse
      from d_added a join d_pa p using (read_id, pos),
           lateral (select greatest(-32768, least(32767, round_even(a.value / p.scale - p.offset_adc, 0))) as h) group by 1)
join (select read_id, count(distinct chunk_index) as chunk_count, avg(abs(norm - norm_hat)) as norm_mae,
             sqrt(avg(power(norm - norm_hat, 2))) as norm_rmse from d_coarse group by 1) using (read_id)""",
    "d_cb": "select code, unnest(vec) as x, generate_subscripts(vec, 1) as i from codebook",
    "d_lat": "select vec_id, unnest(vec) as x, generate_subscripts(vec, 1) as i from latents",
    "d_dist": """
select vec_id, code, sum((l.x::double - c.x::double) * (l.x::double - c.x::double)) as d
from d_lat l join d_cb c using (i) group by 1, 2""",
    "d_code": "select vec_id, arg_min(code, (d, code)) as code, min(d) as distance from d_dist group by 1",
    "d_counts": "select c.code, count(k.vec_id) as n from codebook c left join d_code k on k.code = c.code group by 1",
    "d_pair": """
select vec_id, unnest(y)::double as a, unnest(y_hat)::double as b, generate_subscripts(y, 1) as i from feature_pairs""",
}


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """``reads_meta`` with the samples of each read as the array ``adc``: one pass over the events, shuffled once."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    sample = F.struct("ts", "event_id", F.floor(F.col("value") * 10).cast("double").alias("adc"))
    rows = events.groupBy("user_id").agg(F.array_sort(F.collect_list(sample)).alias("s"), F.count("*").alias("raw_length"))  # a group is one read
    rows.select("user_id", "raw_length", F.col("s.adc").alias("adc")).createOrReplaceTempView("read_groups")
    counted = "count(*) as raw_length\nfrom events group by user_id"
    if counted not in VIEWS["reads_meta"]:
        raise ValueError("reads_meta counts samples in another way")
    return spark.sql(VIEWS["reads_meta"].replace(counted, "raw_length, adc\nfrom read_groups"))


def picoamps(spark, sf):
    rows = W.calibration_valid(reads(spark, sf))
    return rows.withColumn("pa", S.to_picoamps(F.col("adc"), F.col("offset_adc"), F.col("scale")))


def chunked(spark, sf, tail="shift_last"):
    return W.normalised(W.chunks(picoamps(spark, sf), F.col("pa"), SIZE, HOP, tail))


def coarse(spark, sf):
    """Chunks scored by rounding to eighths: what stands in for a model."""
    rows = chunked(spark, sf, "drop").withColumn("norm_hat", F.transform("norm", lambda v: F.rint(v * 8) / 8))
    rebuilt = S.denormalise(F.col("norm_hat"), F.col("center"), F.col("half_range"))
    return rows.withColumn("original", F.col("chunk")).withColumn("chunk", rebuilt)


def errors(spark, sf):
    """The errors of each read: its chunks are shuffled once, by segment, and each segment meets that of the read."""
    rebuilt = W.reassembled(coarse(spark, sf), SIZE, HOP, sums=W.norm_sums(F.col("norm"), F.col("norm_hat")), segment=PART)
    return W.read_errors(rebuilt, picoamps(spark, sf), PART)


def long(name: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in name.split()]


FLAG = """
select read_id, chunk_index, start, round(center, 6) as center, round(half_range, 6) as half_range,
       round(sum(norm), 6) + 0.0 as norm_sum
from {} group by 1, 2, 3, center, half_range"""


def _flag(rows):
    norm_sum = (F.round(S.total(F.col("norm")), 6) + 0.0).alias("norm_sum")
    return rows.select("read_id", *long("chunk_index start"), r6("center"), r6("half_range"), norm_sum)


@query(FLAG.format("d_norm"))
def normalise_pm1(spark, sf):
    return _flag(chunked(spark, sf))


@query("""
select read_id, source_file, barcode, offset_adc, raw_length, sum_adc
from reads_meta join (select read_id, sum(adc)::bigint as sum_adc from samples group by 1) using (read_id)""")
def scan_reads(spark, sf):
    path = shared_folder(spark, "split")
    rows = reads(spark, sf)
    for where, part in (("a/deep", F.col("raw_length") % 2 == 0), ("b", F.col("raw_length") % 2 != 0)):
        rows.where(part).write.parquet(f"{path}/{where}")
    found = io.scan_reads(spark, path, ("a", "missing", "b"), schema=rows.schema)
    columns = ("read_id", "source_file", "barcode", "offset_adc", "raw_length")
    return found.select(*columns, S.total(F.col("adc")).cast("long").alias("sum_adc"))


@query("select read_id, raw_length from reads_meta where raw_length between 10 and 60")
def length_range(spark, sf):
    return reads(spark, sf).where(F.size("adc").between(10, 60)).select("read_id", "raw_length")


@query(f"select read_id, raw_length from reads_meta where raw_length >= {SIZE}")
def short_read_drop(spark, sf):
    return reads(spark, sf).where(F.size("adc") >= SIZE).select("read_id", "raw_length")


@query("""
select read_id, case when scale is null then 'missing' when isnan(scale) then 'not finite' when abs(scale) <= 1e-8 then 'zero'
                else 'valid' end as state
from reads_meta""")
def calibration_valid(spark, sf):
    rows = reads(spark, sf)
    bad = W.calibration_rejects(rows).select("read_id", F.col("reason").alias("state"))
    return bad.union(W.calibration_valid(rows).select("read_id", F.lit("valid")))


#: Rates as reads, their run and the configuration give them: missing, not finite, zero and negative ones among them.
_RATES = """
select read_id, case when read_id % 13 = 2 then 'NaN'::double when read_id % 13 = 3 then 0e0 else read_sample_rate end as read_rate,
       case when read_id % 5 = 0 then null when read_id % 5 = 1 then 'Infinity'::double when read_id % 5 = 2 then -1e0 when read_id % 5 = 3 then 5.004e3 else 4.5e3 end as run_rate
from reads_meta"""


def _rates(spark, sf):
    fixture(spark, sf, "reads_meta").createOrReplaceTempView("reads_meta")
    return spark.sql(_RATES)


def _positive(c: str) -> str:
    return f"case when {c} > 0 and not isnan({c}) and not isinf({c}) then {c} end"


@query(f"select read_id, coalesce({_positive('read_rate')}, {_positive('run_rate')}, 5e3) as rate from ({_RATES})")
def resolve_sample_rate(spark, sf):
    return _rates(spark, sf).select("read_id", S.sample_rate(F.col("read_rate"), F.col("run_rate")).alias("rate"))


@query(f"""
select read_id from (select read_id, coalesce(read_rate, run_rate) as measured from ({_RATES}))
where measured is null or isnan(measured) or not abs(measured - 5e3) > 5""")
def sample_rate_gate(spark, sf):
    return _rates(spark, sf).where(S.rate_gate(F.coalesce("read_rate", "run_rate"), 5000.0)).select("read_id")


_SIZES = ("case when read_id % 4 = 0 then 100 + read_id % 7 when read_id % 4 = 1 then 0 when read_id % 4 = 2 then -5 end as samples",
          "case when read_id % 3 = 0 then 40 when read_id % 3 = 1 then 0 end as hop", "25.1e0 + read_id % 3 as ms")


@query(f"""
select read_id, n as window_samples, case when hop > 0 then hop else n end::bigint as hop_samples
from (select *, case when samples > 0 then samples else greatest(1, cast(round_even(ms * rate / 1000, 0) as bigint)) end::bigint as n
      from (select read_id, {', '.join(_SIZES)}, coalesce({_positive('read_rate')}, {_positive('run_rate')}, 5e3) as rate from ({_RATES})))""")
def window_size(spark, sf):
    rate = S.sample_rate(F.col("read_rate"), F.col("run_rate"))
    rows = _rates(spark, sf).selectExpr("*", *_SIZES).withColumn("rate", rate)
    size = S.window_size(F.col("rate"), F.col("samples"), F.col("ms"), F.col("hop"))
    return rows.select("read_id", size.alias("w")).select("read_id", F.col("w.size").alias("window_samples"), F.col("w.hop").alias("hop_samples"))


@query(f"select read_id, unnest(range(0, raw_length - {SIZE} + 1, {SIZE})) as start from d_valid where raw_length >= {SIZE}")
def full_chunks(spark, sf):
    return W.chunks(picoamps(spark, sf), F.col("pa"), SIZE, SIZE, "drop").select("read_id", *long("start"))


@query(FLAG.format("d_normd"))
def sliding_drop(spark, sf):
    return _flag(chunked(spark, sf, "drop"))


@query("select read_id, chunk_index, start, n_chunks from d_shift")
def sliding_shift_last(spark, sf):
    return chunked(spark, sf).select("read_id", *long("chunk_index start n_chunks"))


_VALID = f"""case when chunk_index > 0 and chunk_index = n_chunks - 1
               then greatest(0, lag(start) over (partition by read_id order by start) + {HOP} - start) else 0 end"""


@query(f"select read_id, start, start + {SIZE} as stop, {_VALID} as valid_from from d_shift")
def shift_last_ranges(spark, sf):
    ranges = S.valid_ranges(S.window_starts(F.size("pa"), SIZE, HOP), SIZE, HOP)
    rows = picoamps(spark, sf).select("read_id", F.explode(ranges).alias("r"))
    return rows.select("read_id", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("start", "stop", "valid_from")])


@query(f"""
select p.read_id, n, round(sum(pa), 6) + 0.0 as total
from d_pa p join (select read_id, (raw_length - {SIZE}) // {HOP} * {HOP} + {SIZE} as n from d_valid where raw_length >= {SIZE}) t
     on t.read_id = p.read_id and p.pos < t.n group by 1, 2""")
def trim_drop(spark, sf):
    rows = picoamps(spark, sf).withColumn("t", S.trim(F.col("pa"), SIZE, HOP, "drop")).where("t is not null")
    return rows.select("read_id", F.size("t").cast("long").alias("n"), (F.round(S.total(F.col("t")), 6) + 0.0).alias("total"))


@query(f"""
select read_id, n, round(sum(pa) + (n - raw_length) * arg_max(pa, pos), 6) + 0.0 as total
from (select *, case when raw_length <= {SIZE} then {SIZE}
                     else cast(ceil((raw_length - {SIZE}) / {float(HOP)}) as bigint) * {HOP} + {SIZE} end as n from d_pa)
group by read_id, n, raw_length""")
def trim_pad(spark, sf):
    rows = picoamps(spark, sf).withColumn("t", S.trim(F.col("pa"), SIZE, HOP, "pad"))
    return rows.select("read_id", F.size("t").cast("long").alias("n"), (F.round(S.total(F.col("t")), 6) + 0.0).alias("total"))


@query("select read_id, chunk_index, k, w::double as w from d_weight")
def crossfade_weights(spark, sf):
    w = S.crossfade(F.col("chunk_index"), F.col("n_chunks"), SIZE, HOP)
    rows = coarse(spark, sf).withColumn("w", w).select("read_id", "chunk_index", F.posexplode("w").alias("k", "w"))
    return rows.select("read_id", *long("chunk_index k"), "w")


@query(f"""
select read_id, chunk_index, k, case when k < vf then 0.0
       else least(case when chunk_index > 0 and k - vf < 4 then (k - vf) / 4.0 else 1.0 end,
                  case when chunk_index < n_chunks - 1 and k >= {HOP} then 1 - (k - {HOP}) / 4.0 else 1.0 end) end::double as w
from (select *, {_VALID} as vf from d_shift), range(0, {SIZE}) t(k)""")
def crossfade_weights_shift_last(spark, sf):
    rows = picoamps(spark, sf).select("read_id", S.valid_ranges(S.window_starts(F.size("pa"), SIZE, HOP), SIZE, HOP).alias("r"))
    rows = rows.select("read_id", F.size("r").alias("n"), F.posexplode("r").alias("i", "z"))
    weights = S.crossfade_shift_last(F.col("i"), F.col("n"), F.col("z.valid_from"), SIZE, HOP)
    rows = rows.select("read_id", F.col("i").cast("long").alias("chunk_index"), F.posexplode(weights).alias("k", "w"))
    return rows.withColumn("k", F.col("k").cast("long"))


@query(f"""
select c.read_id, c.start,
       round(sum(case when h < 1e-6 then 0 else greatest(-1, least(1, (pa - m) / h)) end), 6) + 0.0 as norm_sum
from d_dropn c join d_pa p on p.read_id = c.read_id and p.pos >= c.start and p.pos < c.start + {SIZE}
     join (select read_id, (min(pa) + max(pa)) / 2 as m, (max(pa) - min(pa)) / 2 as h from d_pa group by 1) s
     on s.read_id = c.read_id group by 1, 2""")
def read_normalised_chunks(spark, sf):
    rows = picoamps(spark, sf).withColumn("st", S.norm_stats(F.col("pa")))
    rows = W.chunks(rows, S.normalise_pm1(F.col("pa"), F.col("st")), SIZE, HOP, "drop", ())
    return rows.select("read_id", *long("start"), (F.round(S.total(F.col("chunk")), 6) + 0.0).alias("norm_sum"))


@query("""
select slot, read_id, chunk_index
from (select read_id, chunk_index, row_number() over (order by read_id, chunk_index) - 1 as i, count(*) over () as n from d_shift),
     range(0, 2000) t(slot)
where slot % least(n, 2000) = i""")
def cycle_fill(spark, sf):
    rows = chunked(spark, sf).select("read_id", *long("chunk_index"))
    return W.cycle_fill(rows, ["read_id", "chunk_index"], 2000).select("slot", "read_id", "chunk_index")


@query("""
select b as batch, count(*) as n, min(read_id) as low, max(read_id) as high
from (select read_id, (row_number() over (order by read_id) - 1) // 32 as b from d_valid) group by 1 having count(*) = 32""")
def batch_assemble(spark, sf):
    rows = W.batches(W.calibration_valid(fixture(spark, sf, "reads_meta")).select("read_id"), "read_id", 32)
    ends = F.array_min("items").alias("low"), F.array_max("items").alias("high")
    return rows.select("batch", F.size("items").cast("long").alias("n"), *ends)


@query("select read_id, pos, round(pa, 6) as value from d_pa")
def to_picoamps(spark, sf):
    return W.samples(picoamps(spark, sf), "pa", "read_id").select("read_id", "pos", r6("value"))


@query("select read_id, pos, round(pa / scale - offset_adc, 6) + 0.0 as value from d_pa")
def to_adc(spark, sf):
    rows = picoamps(spark, sf).withColumn("back", S.to_adc(F.col("pa"), F.col("offset_adc"), F.col("scale")))
    return W.samples(rows, "back", "read_id").select("read_id", "pos", r6("value"))


@query("""
select read_id, pos, cast(greatest(-32768, least(32767, round_even(adc * 40.5, 0))) as smallint) as value from samples""")
def adc_round_clip(spark, sf):
    rows = reads(spark, sf).withColumn("x", F.transform("adc", lambda v: S.adc_round_clip(v * 40.5)))
    return W.samples(rows, "x", "read_id")


def _by_chunk(rows: DataFrame, value: str, by: int = 6) -> DataFrame:
    rows = W.samples(rows.withColumn("chunk_index", F.col("chunk_index").cast("long")), value, "read_id", "chunk_index")
    return rows.select("read_id", "chunk_index", *long("pos"), r6("value", by))


@query("select read_id, chunk_index, k as pos, round(norm, 6) + 0.0 as value from d_norm")
def normalise_adc(spark, sf):
    return _by_chunk(chunked(spark, sf), "norm")


@query("""
select read_id, chunk_index, k as pos,
       round(case when half_range < 1e-6 then center else norm * half_range + center end / scale - offset_adc, 5) + 0.0 as value
from d_norm""")
def denormalise(spark, sf):
    pa = S.denormalise(F.col("norm"), F.col("center"), F.col("half_range"))
    return _by_chunk(chunked(spark, sf).withColumn("x", S.to_adc(pa, F.col("offset_adc"), F.col("scale"))), "x", 5)


@query("select read_id, pos, round((pa - 90.5) / 17.25, 6) + 0.0 as value from d_pa")
def standardise_pa(spark, sf):
    rows = picoamps(spark, sf).withColumn("x", S.standardise(F.col("pa"), 90.5, 17.25))
    return W.samples(rows, "x", "read_id").select("read_id", "pos", r6("value"))


@query("""
select read_id, pos - 1 as pos, round(pa - before, 6) + 0.0 as value
from (select read_id, pos, pa, raw_length, lag(pa) over (partition by read_id order by pos) as before from d_pa)
where before is not null
union all select read_id, 0, 0.0 from d_valid where raw_length = 1""")
def finite_difference(spark, sf):
    rows = picoamps(spark, sf).withColumn("x", S.finite_difference(F.col("pa")))
    return W.samples(rows, "x", "read_id").select("read_id", "pos", r6("value"))


@query("select read_id, chunk_index, round(avg(abs(pa - rebuilt)), 6) as l1 from d_coarse group by 1, 2")
def l1_time(spark, sf):
    l1 = F.round(S.l1(F.col("original"), F.col("chunk")) / SIZE, 6).alias("l1")
    return coarse(spark, sf).select("read_id", *long("chunk_index"), l1)


# 1e-7 and four digits: samples are multiples of 0.05, so many means end in 5 at the fifth digit or above
@query("""
select read_id, chunk_index, round(avg(abs(d)) + 1e-7, 4) as l1_d1, round(avg(abs(d - e)) + 1e-7, 4) as l1_d2
from (select *, lag(d) over (partition by read_id, chunk_index order by k) as e
      from (select read_id, chunk_index, k,
                   pa - rebuilt - lag(pa - rebuilt) over (partition by read_id, chunk_index order by k) as d from d_coarse))
group by 1, 2""")
def l1_diff(spark, sf):
    def one(k: int):
        y, z = (S.finite_difference(F.col(c), k) for c in ("original", "chunk"))
        return F.round(S.l1(y, z) / (SIZE - k) + 1e-7, 4)

    return coarse(spark, sf).select("read_id", *long("chunk_index"), one(1).alias("l1_d1"), one(2).alias("l1_d2"))


@query(f"""
select read_id, f as frame, round(coalesce(sum(pa), 0), 6) + 0.0 as total
from (select read_id, unnest(range(0, greatest(raw_length, {SIZE}) - {SIZE} + 1, {HOP})) as s,
             unnest(range(0, (greatest(raw_length, {SIZE}) - {SIZE}) // {HOP} + 1)) as f from d_valid)
     left join d_pa p using (read_id)
where p.pos >= s and p.pos < s + {SIZE} group by 1, 2""")
def frame_signal(spark, sf):
    rows = picoamps(spark, sf).select("read_id", F.posexplode(S.frame_signal(F.col("pa"), SIZE, HOP)).alias("frame", "x"))
    return rows.select("read_id", *long("frame"), (F.round(S.total(F.col("x")), 6) + 0.0).alias("total"))


def _stft(value: str, n: int, win: int, hop: int) -> str:
    """The same by explicit sums: frames of ``win`` samples every ``hop`` of a chunk, and n // 2 + 1 bins of each."""
    w = f"(0.5 - 0.5 * cos(2 * pi() * (k - f * {hop}) / {win - 1}))"
    part = lambda fn: f"power(sum({value} * {w} * {fn}(2 * pi() * b * (k - f * {hop}) / {n})), 2)"
    return f"""
select read_id, chunk_index, f, b, ln(1 + sqrt({part('cos')} + {part('sin')})) as m
from d_coarse, range(0, {(SIZE - win) // hop + 1}) u(f), range(0, {n // 2 + 1}) t(b)
where k >= f * {hop} and k < f * {hop} + {win} group by 1, 2, 3, 4"""


def _stft_l1(n: int, win: int, hop: int) -> str:
    return f"""
select read_id, chunk_index, avg(abs(x.m - y.m)) as l1
from ({_stft('pa', n, win, hop)}) x join ({_stft('rebuilt', n, win, hop)}) y using (read_id, chunk_index, f, b) group by 1, 2"""


@query(f"select read_id, chunk_index, f * 5 + b as bin, round(m, 6) as value from ({_stft('pa', 8, 8, 4)})")
def stft_logmag_query(spark, sf):
    rows = coarse(spark, sf).withColumn("m", P.stft_logmag(8, 4, 8)(F.col("original")))  # three frames of five bins
    return _by_chunk(rows, "m").withColumnRenamed("pos", "bin")


QUERIES["stft_logmag"], ORACLE["stft_logmag"] = QUERIES.pop("stft_logmag_query"), ORACLE.pop("stft_logmag_query")


@query(f"select read_id, chunk_index, round(l1, 6) as l1 from ({_stft_l1(8, 6, 3)})")
def stft_l1(spark, sf):
    rows = coarse(spark, sf).select("read_id", *long("chunk_index"), "original", "chunk")
    return P.stft_l1(rows, "original", "chunk", 8, 6, 3).select("read_id", "chunk_index", r6("l1"))


SCALES = [P.scale(16, 16, 4), P.scale(8), P.scale(8, 8, 4), P.scale(8, 4)]


@query(f"""
select read_id, chunk_index, round(sum(l1) / {len(SCALES)}, 6) as l1
from ({' union all '.join(_stft_l1(*x) for x in SCALES)}) group by 1, 2""")
def ms_stft_l1(spark, sf):
    rows = coarse(spark, sf).select("read_id", *long("chunk_index"), "original", "chunk")
    return P.ms_stft_l1(rows, "original", "chunk", SCALES).select("read_id", "chunk_index", r6("l1"))


@query("select read_id, pos, round(value, 6) as value from d_added")
def overlap_add(spark, sf):
    return W.segment_samples(W.overlap_add(coarse(spark, sf), SIZE, HOP, PART)).select("read_id", "pos", r6("value"))


@query("select read_id, start + k as pos, round(arg_max(rebuilt, chunk_index), 6) as value from d_coarse group by 1, 2")
def direct_stitch(spark, sf):
    return W.segment_samples(W.direct_stitch(coarse(spark, sf), SIZE, HOP, PART)).select("read_id", "pos", r6("value"))


@query(f"select read_id, {', '.join(f'round({c}, 6) as {c}' for c in W.ERRORS[2:])} from d_errors")
def read_error_metrics(spark, sf):
    return errors(spark, sf).select("read_id", *[r6(c) for c in W.ERRORS[2:]])


_FOUR = {"mean": "avg", "median": "median", "min": "min", "max": "max"}


@query("select count(*) as processed_reads, coalesce(sum(chunk_count), 0)::bigint as total_chunk_count, "
       + ", ".join(f"round(coalesce({f}({c}), 0), 6)::double as {c}_{n}" for c in W.ERRORS for n, f in _FOUR.items()) + " from d_errors")
def recon_summary(spark, sf):
    out = W.recon_summary(errors(spark, sf))
    return out.select("processed_reads", "total_chunk_count", *[r6(c) for c in out.columns[2:]])


@query("select " + ", ".join(f"round(coalesce({f}(raw_length), 0)::double, 6) as raw_length_{n}" for n, f in _FOUR.items()) + " from reads_meta")
def summarize(spark, sf):
    out = W.summarise(fixture(spark, sf, "reads_meta"), "raw_length")
    return out.select(*[r6(c) for c in out.columns])


@query("select count(distinct source_file) as files, count(distinct read_id) as reads from reads_meta")
def source_counts(spark, sf):
    return fixture(spark, sf, "reads_meta").agg(F.count_distinct("source_file").alias("files"), F.count_distinct("read_id").alias("reads"))


@query("""
select code, j, round(sum(x::double * w) + j, 4) + 0.0 as value
from (select code, x, j, ((i - 1) * 3 + j * 5) % 7 / 4 as w from d_cb, range(0, 5) t(j)) group by 1, 2""")
def codebook_project(spark, sf):
    book = fixture(spark, sf, "codebook")
    weights = [[(i * 3 + j * 5) % 7 / 4 for j in range(5)] for i in range(len(book.first()["vec"]))]
    rows = W.samples(Q.project(book, weights, [float(j) for j in range(5)]), "vec", "code")
    return rows.select("code", F.col("pos").cast("long").alias("j"), r6("value", 4))


@query("select count(*) as pairs, round(sum(d), 3) as total from d_dist")
def codebook_cross(spark, sf):
    """Every latent against every code: the codebook has 32 rows whatever the table's size."""
    codes = fixture(spark, sf, "codebook").withColumnRenamed("vec", "c")
    both = fixture(spark, sf, "latents").crossJoin(F.broadcast(codes))
    d = S.squared_distance(F.col("vec").cast("array<double>"), F.col("c").cast("array<double>"))
    return both.agg(F.count("*").alias("pairs"), F.round(F.sum(d), 3).alias("total"))


def _assigned(spark, sf):
    return Q.nearest_code(fixture(spark, sf, "latents"), fixture(spark, sf, "codebook"))


CODE = "select vec_id, code, round(distance, 6) as distance from d_code"


@query(CODE)
def nearest_code(spark, sf):
    return _assigned(spark, sf).select("vec_id", "code", r6("distance"))


@query(CODE)
def nearest_code_blocked(spark, sf):
    found = Q.nearest_code(fixture(spark, sf, "latents"), fixture(spark, sf, "codebook"), 8)
    return found.select("vec_id", "code", r6("distance"))


@query("""
select vec_id, k.code, round(sum(c.x::double), 5) + 0.0 as total from d_code k join d_cb c on c.code = k.code group by 1, 2""")
def quantise(spark, sf):
    rows = Q.quantise(_assigned(spark, sf), fixture(spark, sf, "codebook"))
    return rows.select("vec_id", "code", (F.round(S.total(F.col("vec").cast("array<double>")), 5) + 0.0).alias("total"))


@query("""
select round(avg(sqrt(distance + 1e-16)), 6) as mean_distance, round(avg(ln(sqrt(distance + 1e-16))), 6) as mean_log from d_code""")
def distortion(spark, sf):
    d = F.sqrt(F.col("distance") + 1e-16)
    return _assigned(spark, sf).agg(F.round(F.avg(d), 6).alias("mean_distance"), F.round(F.avg(F.log(d)), 6).alias("mean_log"))


@query("select code, n from d_counts")
def token_counts(spark, sf):
    return Q.token_counts(_assigned(spark, sf), fixture(spark, sf, "codebook"))


@query("""
select greatest(sum(n), 1)::bigint as total, round(avg((n > 0)::int), 6) as usage,
       round(exp(-sum(p * ln(p + 1e-10))), 5) as perplexity
from (select n, n / (select greatest(sum(n), 1) from d_counts) as p from d_counts)""")
def codebook_stats(spark, sf):
    out = Q.codebook_stats(Q.token_counts(_assigned(spark, sf), fixture(spark, sf, "codebook")))
    return out.select("total", r6("usage"), r6("perplexity", 5))


@query("""
select read_id, chunk_index, round(sum(round_even(norm * 10, 0) / 10), 6) + 0.0 as score from d_norm group by 1, 2""")
def score_chunks(spark, sf):
    rows = chunked(spark, sf).select("read_id", "chunk_index", F.col("norm").alias("chunk"))
    score = (F.round(S.total(F.col("score")), 6) + 0.0).alias("score")
    return Q.score_chunks(rows, factory=lambda: lambda x: x.round(1)).select("read_id", *long("chunk_index"), score)


def _pairs(spark, sf):
    rows = fixture(spark, sf, "feature_pairs")
    return rows.select("vec_id", F.col("y").cast("array<double>").alias("y"), F.col("y_hat").cast("array<double>").alias("z"))


@query("""
select vec_id // 8 as seq, vec_id % 8 as t, i - 1 as i,
       round((a - avg(a) over o) / sqrt(var_pop(a) over o + 1e-10), 4) + 0.0 as value
from d_pair window o as (partition by vec_id // 8, i)""")
def feature_standardise(spark, sf):
    """Eight vectors in a row are the times of one sequence."""
    rows = _pairs(spark, sf).select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("t"), F.col("y").alias("vec"))
    return W.feature_standardise(rows).select("seq", "t", *long("i"), r6("value", 4))


def _norm(name, fn, mean):
    @query(f"""
select vec_id, i - 1 as pos, round(a / sqrt({mean} + 1e-5 * 1e-5), 6) + 0.0 as value
from d_pair join (select vec_id, sum(a * a) as s, count(*) as n from d_pair group by 1) using (vec_id)""")
    def run(spark, sf):
        rows = W.samples(_pairs(spark, sf).withColumn("x", fn(F.col("y"))), "x", "vec_id")
        return rows.select("vec_id", *long("pos"), r6("value"))

    QUERIES[name], ORACLE[name] = QUERIES.pop("run"), ORACLE.pop("run")


_norm("rms_norm", S.rms_norm, "s / n")
_norm("l2_norm", S.l2_norm, "s")


@query("""
select round(avg(1 - greatest(-1, least(1, d))), 6) as loss
from (select vec_id, sum(p * q) / sqrt(sum(p * p) + 1e-10) / sqrt(sum(q * q) + 1e-10) as d
      from (select vec_id, a / sqrt(avg(a * a) over v + 1e-10) as p, b / sqrt(avg(b * b) over v + 1e-10) as q
            from d_pair window v as (partition by vec_id)) group by 1)""")
def cosine_loss(spark, sf):
    return _pairs(spark, sf).agg(F.round(F.avg(S.cosine_loss(F.col("y"), F.col("z"))), 6).alias("loss"))


_SOFT = """
select vec_id, i, exp(a - ma) / sum(exp(a - ma)) over (partition by vec_id) as p,
       exp(b - mb) / sum(exp(b - mb)) over (partition by vec_id) as q
from (select *, max(a) over (partition by vec_id) as ma, max(b) over (partition by vec_id) as mb from d_pair)"""


@query(f"select vec_id, i - 1 as pos, round(p, 6) as value from ({_SOFT})")
def softmax(spark, sf):
    rows = W.samples(_pairs(spark, sf).withColumn("x", S.softmax(F.col("y"))), "x", "vec_id")
    return rows.select("vec_id", *long("pos"), r6("value"))


# the positive parts of the vectors as probabilities that are not yet summed to 1
@query("""
select round(avg(kl), 5) + 0.0 as loss
from (select vec_id, sum(p * (ln(p) - ln(q))) as kl
      from (select vec_id, greatest(1e-6, least(1, greatest(a, 0) / greatest(sum(greatest(a, 0)) over v, 1e-6))) as p,
                   greatest(1e-6, least(1, greatest(b, 0) / greatest(sum(greatest(b, 0)) over v, 1e-6))) as q
            from d_pair window v as (partition by vec_id)) group by 1)""")
def kl_loss(spark, sf):
    positive = lambda c: F.transform(c, lambda v: F.greatest(v, F.lit(0.0)))
    rows = _pairs(spark, sf).select(positive("y").alias("p"), positive("z").alias("q"))
    return rows.agg((F.round(F.avg(S.kl_loss(F.col("p"), F.col("q"))), 5) + 0.0).alias("loss"))
