"""Queries of calls, manifests, logs, sources and streams, each with its equivalent in DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewater.operators import calls as C
from tidewater.operators import manifest as M
from tidewater.operators import nested as N
from tidewater.operators import runlog as L
from tidewater.sources import io
from tidewater.storage import shared_folder, stored
from tidewater.streaming import streams

from .fixtures import fixture, oracle
from .signals import HOP, SIZE, _flag, r6, reads

QUERIES, ORACLE = {}, {}

_CAND = "coalesce(try_cast(nullif({0}, '') as double), 0)"
_NUM = lambda c: f"case when isnan({_CAND.format(c)}) then 0 else {_CAND.format(c)} end"
_INT = lambda c: f"cast(round_even({_NUM(c)}, 0) as bigint)"
_Q = """case when length({0}) = 0 then 0
     else list_sum(list_transform(str_split({0}, ''), lambda c: ascii(c) - 33)) / length({0})::double end"""


def _paired(left: str, right: str) -> str:
    return f"""
select x.read_id, x.seq as a, y.seq as b, levenshtein(x.seq, y.seq) as d,
       greatest(length(x.seq), length(y.seq)) as w, {_Q.format('x.qual')} as qa, {_Q.format('y.qual')} as qb
from {left} x join {right} y on y.read_id = x.read_id"""


_IDENT = "case when w = 0 then 1 when length(a) = 0 or length(b) = 0 then 0 else 1 - d / w::double end"
_EMPIRICAL = "(case when w = 0 or d <= 0 then 60.0 else least(60, -10 * log10(greatest(d / w::double, 1e-12))) end::double + 0.0)"


def _measured(pair: str) -> str:
    """The pair rows with every number that a summary is made of."""
    return f"""
select read_id, a = b as exact_match, w as weight, {_IDENT} as identity, qa as left_q, qb as right_q, qb - qa as q_delta,
       {_EMPIRICAL} as empirical_q, (length(b) - length(a))::double as length_delta
from {pair}"""


DUCK = {
    "d_cand": f"""
select name::bigint as read_id, barcode, {_INT('read_length')} as read_length, {_INT('qstart')} as qstart,
       {_INT('qend')} as qend, {_NUM('acc')} as acc, {_NUM('coverage')} as coverage, {_NUM('mean_quality')} as mean_quality,
       ref, {_INT('rstart')} as rstart, {_INT('rend')} as rend
from readstats""",
    "d_ok": """
select * from d_cand where read_length >= 2000 and acc >= 92 and coverage >= 91 and mean_quality >= 9
  and qstart <= 140 and read_length - qend <= 140""",
    "d_raw": """
select read_id, min(source_file) as source_file, arg_min(raw_length, source_file) as raw_length from raw_index group by 1""",
    "d_truth": """
select read_id, min(miss) = 0 as overlaps, arg_min(ordinal, (miss, ordinal)) as ordinal, arg_min(seq, (miss, ordinal)) as seq
from (select k.read_id, case when a.ref = k.ref and a.start_pos < greatest(k.rstart + 1, k.rend + 512)
                              and a.end_pos > greatest(0, k.rstart - 512) then 0 else 1 end as miss, a.ordinal, a.seq
      from d_ok k join alignments a on a.read_id = k.read_id where a.seq <> '')
group by 1""",
    "d_use": """
select k.*, r.raw_length, t.ordinal, t.seq,
       case when r.raw_length is null then 'no raw read' when t.seq is null then 'no truth' end as reason
from d_ok k left join d_raw r using (read_id) left join d_truth t using (read_id)""",
    "d_top": """
select *, row_number() over (partition by barcode order by acc desc, coverage desc, mean_quality desc, read_length desc,
                             read_id)::int as rank
from d_use where reason is null""",
    "d_group": "select read_id, coalesce(nullif(barcode, ''), 'unknown') as barcode from calls_truth",
    "d_og": _paired("calls_original", "calls_generated"),
    "d_to": _paired("calls_truth", "calls_original"),
    "d_tg": _paired("calls_truth", "calls_generated"),
    "d_mog": _measured("d_og"),
    "d_mto": _measured("d_to"),
    "d_mtg": _measured("d_tg"),
}
STATS = {"mean": "avg", "median": "median", "min": "min", "max": "max"}


def _stats(*columns: str) -> str:
    return ", ".join(f"round(coalesce({f}({c}), 0), 6) + 0.0 as {c}_{n}" for c in columns for n, f in STATS.items())


_RATES = """round(coalesce(avg(exact_match::int), 0), 6) as exact_rate,
       round(coalesce(sum(identity * weight) / nullif(sum(weight), 0), 0), 6) as weighted_identity"""
CALL = f"""
select count(*) as shared, l as left_count, r as right_count, l - count(*) as left_only, r - count(*) as right_only, {_RATES},
       round(coalesce(avg(q_delta), 0), 6) + 0.0 as q_delta_avg, round(coalesce(avg(abs(q_delta)), 0), 6) as q_delta_abs,
       {_stats('identity', 'length_delta', 'q_delta')}
from d_mog, (select count(distinct read_id) as l from calls_original), (select count(distinct read_id) as r from calls_generated)
group by l, r"""
_TRUTH_STATS = f"""{_RATES}, round(coalesce(avg(empirical_q), 0), 6) as mean_empirical_q,
       round(coalesce(avg(right_q), 0), 6) as mean_predicted_q, round(coalesce(avg(left_q), 0), 6) as mean_truth_q,
       {_stats('identity', 'empirical_q', 'right_q', 'left_q', 'length_delta')}"""


def _truth_sql(pair: str, other: str) -> str:
    return f"""
select count(*) as shared, l as truth_count, r as predicted_count, greatest(l - count(*), 0) as truth_only,
       greatest(r - count(*), 0) as predicted_only, {_TRUTH_STATS}
from {pair}, (select count(distinct read_id) as l from calls_truth), (select count(distinct read_id) as r from {other})
group by l, r"""


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = oracle(sql, DUCK)
        return f

    return add


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[r6(n) if t == "double" else F.col(n) for n, t in rows.dtypes])


def calls(spark: SparkSession, sf: str, which: str) -> DataFrame:
    return fixture(spark, sf, f"calls_{which}")


def _both(spark, sf, left="original", right="generated"):
    return C.pairs(calls(spark, sf, left), calls(spark, sf, right))


@query("select read_id, length(a) as left_length, length(b) as right_length, a = b as exact_match from d_og")
def join_shared_reads(spark, sf):
    return _both(spark, sf).select("read_id", "left_length", "right_length", "exact_match")


@query(f"""
select read_id, length(a) as left_length, length(b) as right_length, round({_IDENT}, 6) as identity, d as edit_distance,
       w as weight, round(qa, 6) as left_q, round(qb, 6) as right_q, round(qb - qa, 6) + 0.0 as q_delta,
       round({_EMPIRICAL}, 6) as empirical_q, length(b) - length(a) as length_delta, a = b as exact_match
from d_og""")
def pair_metrics(spark, sf):
    return _rounded(_both(spark, sf))


@query("select read_id from calls_original except select read_id from calls_generated")
def left_only(spark, sf):
    return C.only(calls(spark, sf, "original"), calls(spark, sf, "generated"))


@query("select read_id from calls_generated except select read_id from calls_original")
def right_only(spark, sf):
    return C.only(calls(spark, sf, "generated"), calls(spark, sf, "original"))


@query("select read_id from calls_original intersect select read_id from calls_generated")
def ids_intersect(spark, sf):
    return calls(spark, sf, "original").select("read_id").intersect(calls(spark, sf, "generated").select("read_id"))


@query("""
select 'left' as side, read_id from (select read_id from calls_original except select read_id from calls_generated)
union all
select 'right', read_id from (select read_id from calls_generated except select read_id from calls_original)""")
def ids_except(spark, sf):
    a, b = (calls(spark, sf, x).select("read_id") for x in ("original", "generated"))
    return a.subtract(b).select(F.lit("left").alias("side"), "read_id").union(b.subtract(a).select(F.lit("right"), "read_id"))


@query("select read_id, length(seq) as n from calls_truth where read_id in (select read_id from calls_generated)")
def select_by_ids(spark, sf):
    rows = calls(spark, sf, "truth").join(calls(spark, sf, "generated"), "read_id", "left_semi")
    return rows.select("read_id", F.length("seq").cast("long").alias("n"))


@query("""
select count(*) as n, min(read_id) as first
from (select read_id from calls_original except select read_id from calls_truth)""")
def require_all_ids(spark, sf):
    return M.missing_ids(calls(spark, sf, "original"), calls(spark, sf, "truth"))


@query(CALL)
def call_summary(spark, sf):
    return _rounded(C.call_summary(calls(spark, sf, "original"), calls(spark, sf, "generated")))


def _truth(spark, sf, right):
    a, b = calls(spark, sf, "truth"), calls(spark, sf, right)
    count = lambda df, name: df.agg(F.count_distinct("read_id").alias(name))
    return C.truth_summary(C.pairs(a, b), count(a, "truth_count").crossJoin(count(b, "predicted_count")))


@query(_truth_sql("d_mto", "calls_original"))
def truth_summary(spark, sf):
    return _rounded(_truth(spark, sf, "original"))


@query("select round(coalesce(sum(identity * weight) / nullif(sum(weight), 0), 0), 6) as weighted_identity from d_mtg")
def weighted_identity(spark, sf):
    return _rounded(_both(spark, sf, "truth", "generated").agg(C.weighted_identity().alias("weighted_identity")))


@query(f"""
select barcode, count(read_id) as shared, truth_count, count(read_id) as predicted_count,
       greatest(truth_count - count(read_id), 0) as truth_only, 0::bigint as predicted_only, {_TRUTH_STATS}
from (select barcode, count(distinct read_id) as truth_count from d_group group by 1)
     left join (select g.barcode, d.* from d_mto d join d_group g using (read_id)) using (barcode)
group by barcode, truth_count""")
def group_truth_summary(spark, sf):
    by = calls(spark, sf, "truth").select("read_id", F.coalesce(F.nullif("barcode", F.lit("")), F.lit("unknown")).alias("barcode"))
    counts = by.groupBy("barcode").agg(F.count_distinct("read_id").alias("truth_count"))
    return _rounded(C.truth_summary(_both(spark, sf, "truth", "original").join(by, "read_id"), counts, "barcode"))


@query(f"""
select x.m as metric, round(x.d, 6) + 0.0 as delta
from (select unnest([{", ".join(f"{{'m': '{c}', 'd': n.{c}::double - o.{c}::double}}" for c in C.DELTAS)}]) as x
      from ({_truth_sql('d_mto', 'calls_original')}) o, ({_truth_sql('d_mtg', 'calls_generated')}) n)""")
def summary_delta(spark, sf):
    new, old = (_rounded(C.truth_means(_both(spark, sf, "truth", x))) for x in ("generated", "original"))
    return C.summary_delta(new, old).select("metric", r6("delta"))


@query("select read_id, round(qa, 6) as left_q, round(qb, 6) as right_q from d_og")
def mean_qscore(spark, sf):
    return _rounded(_both(spark, sf).select("read_id", "left_q", "right_q"))


@query(f"select read_id, d as edit_distance, round({_IDENT}, 6) as identity from d_tg")
def alignment_identity(spark, sf):
    return _rounded(_both(spark, sf, "truth", "generated").select("read_id", "edit_distance", "identity"))


@query(f"select read_id, round({_EMPIRICAL}, 6) as q from d_tg")
def empirical_qscore(spark, sf):
    return _rounded(_both(spark, sf, "truth", "generated").select("read_id", F.col("empirical_q").alias("q")))


@query("""
select ordinal, case when ordinal % 2 = 1 then reverse(translate(upper(seq), 'ACGT', 'TGCA')) else upper(seq) end as forward
from alignments""")
def forward_sequence(spark, sf):
    rows = fixture(spark, sf, "alignments")
    return rows.select("ordinal", C.forward_sequence(F.upper("seq"), F.col("ordinal") % 2 == 1).alias("forward"))


@query("""
select ordinal, case when ordinal % 5 = 0 then repeat('I', length(seq))
       else array_to_string(list_transform(str_split(seq, ''), lambda c: chr(((ascii(c) % 40) + 33)::int)), '') end as qual
from alignments where seq <> ''""")
def phred_encode(spark, sf):
    rows = fixture(spark, sf, "alignments").where("seq != ''")
    quals = F.transform(F.split("seq", ""), lambda c: F.ascii(c) % 40)
    other = F.when(F.col("ordinal") % 5 == 0, F.slice(quals, F.lit(1), F.lit(3))).otherwise(quals)
    return rows.select("ordinal", C.phred_encode(other, F.col("seq")).alias("qual"))


def cand(spark, sf):
    return M.candidates(fixture(spark, sf, "readstats"))


def ok(spark, sf):
    return M.candidate_filter(cand(spark, sf), "strict", 2000, 92, 91, 9, 140, 140)


def raw(spark, sf):
    return M.first_file_lookup(ok(spark, sf), fixture(spark, sf, "raw_index"))


def usable(spark, sf):
    """Candidates are parsed and filtered once and written; both look-ups and the joins read them."""
    rows = stored(ok(spark, sf), "candidates")
    found = M.first_file_lookup(rows, fixture(spark, sf, "raw_index"))
    return M.usable_join(rows, found, M.truth_lookup(rows, fixture(spark, sf, "alignments")))


_REALS = ("acc", "coverage", "mean_quality")


def _clean(spark, sf):
    return cand(spark, sf).select("read_id", "read_length", "qstart", "qend", *[r6(c) for c in _REALS])


_CLEAN = f"select read_id, read_length, qstart, qend, {', '.join(f'round({c}, 6) as {c}' for c in _REALS)} from d_cand"
query(_CLEAN, "clean_numeric")(_clean)
query("select *, 'FC' as fc from d_cand", "project_candidate")(cand)


@query("""
select 'len_only' as mode, read_id from d_cand where read_length >= 2000
union all select 'strict', read_id from d_ok""")
def candidate_filter(spark, sf):
    loose = M.candidate_filter(cand(spark, sf), "len_only", 2000)
    return loose.select(F.lit("len_only").alias("mode"), "read_id").union(ok(spark, sf).select(F.lit("strict"), "read_id"))


@query("select read_id, barcode from calls_truth")
def drop_wide_columns(spark, sf):
    return calls(spark, sf, "truth").drop("seq", "qual")


@query("select read_id, source_file, raw_length from d_raw where read_id in (select read_id from d_ok)")
def first_file_lookup(spark, sf):
    return raw(spark, sf)


@query("""
select read_id, arg_max(miss = 0, barcode) as overlaps, arg_max(ordinal, barcode) as ordinal, arg_max(seq, barcode) as seq
from (select read_id, barcode, min(miss) as miss, arg_min(ordinal, (miss, ordinal)) as ordinal, arg_min(seq, (miss, ordinal)) as seq
      from (select k.read_id, k.barcode, case when a.ref = k.ref and a.start_pos < greatest(k.rstart + 1, k.rend + 512)
                                               and a.end_pos > greatest(0, k.rstart - 512) then 0 else 1 end as miss, a.ordinal, a.seq
            from (select * from d_ok union all
                  select * replace ('barcode0' || (1 + right(barcode, 1)::int % 3) as barcode, rstart + 900 as rstart, rend + 900 as rend) from d_ok where read_id % 4 < 2) k
                 join (select *, 'barcode0' || (1 + ordinal % 3) as barcode from alignments) a on a.read_id = k.read_id and a.barcode = k.barcode
            where a.seq <> '')
      group by 1, 2)
group by 1""")
def truth_lookup_interval(spark, sf):
    """Records by barcode, and every second id a candidate in two barcodes, elsewhere on the reference in the second."""
    rows = ok(spark, sf)
    following = F.concat(F.lit("barcode0"), (1 + F.right("barcode", F.lit(1)).cast("int") % 3).cast("string"))
    moved = {"barcode": following, "rstart": F.col("rstart") + 900, "rend": F.col("rend") + 900}
    both = rows.union(rows.where("read_id % 4 < 2").withColumns(moved))
    barcode = F.concat(F.lit("barcode0"), (1 + F.col("ordinal") % 3).cast("string"))
    return M.truth_lookup(both, fixture(spark, sf, "alignments").withColumn("barcode", barcode))


@query("""
select read_id, barcode, raw_length, ordinal, reason from d_use where reason is null
union all
(select read_id, barcode, raw_length, ordinal, reason from d_use where reason is not null order by read_id limit 64)""")
def usable_join(spark, sf):
    rows = stored(usable(spark, sf).select("read_id", "barcode", "raw_length", "ordinal", "reason"), "usable")
    return rows.where("reason is null").union(rows.where("reason is not null").orderBy("read_id").limit(64))


@query("""
select read_id, case when raw_length is null then 'unknown' else 'out of bounds' end as problem
from (select distinct read_id from d_ok) left join d_raw using (read_id)
where raw_length is null or raw_length < 20000 or raw_length > 45000""")
def manifest_containment(spark, sf):
    return M.not_contained(ok(spark, sf), fixture(spark, sf, "raw_index"), 20000, 45000)


_REPORT = """
select barcode, coalesce(candidates, 0) as candidates, coalesce(usable, 0)::bigint as usable, coalesce(selected, 0) as selected,
       coalesce(min_raw, 0) as min_raw, coalesce(max_raw, 0) as max_raw, coalesce(min_truth, 0) as min_truth,
       coalesce(max_truth, 0) as max_truth
from {} left join (select barcode, count(*) as candidates, sum((reason is null)::int) as usable from d_use group by 1)
       using (barcode)
     left join (select barcode, count(*) as selected, min(raw_length) as min_raw, max(raw_length) as max_raw,
                       min(length(seq)) as min_truth, max(length(seq)) as max_truth from d_top where rank <= 20 group by 1)
       using (barcode)"""


def _report(groups: DataFrame, rows: DataFrame) -> DataFrame:
    top = M.topk_per_barcode(rows.where("reason is null"), 20)
    return M.group_report(groups, rows, top)


def _usable_with_truth(spark, sf):
    return stored(usable(spark, sf).select("barcode", "read_id", "raw_length", "seq", "reason", *_REALS, "read_length"), "usable")


@query(_REPORT.format("(select unnest(['barcode01', 'barcode02', 'barcode09']) as barcode)"))
def group_driver_join(spark, sf):
    names = F.array(*map(F.lit, ("barcode01", "barcode02", "barcode09")))
    return _report(spark.range(1).select(F.explode(names).alias("barcode")), _usable_with_truth(spark, sf))


@query(_REPORT.format("(select distinct barcode from d_ok)"))
def barcode_counts(spark, sf):
    rows = _usable_with_truth(spark, sf)  # every candidate is among them, usable or not
    return _report(rows.select("barcode").distinct(), rows)


@query("""
select barcode, read_id, rank
from (select barcode, read_id, row_number() over (partition by barcode order by acc desc, coverage desc, mean_quality desc,
             read_length desc, read_id)::int as rank from d_ok)
where rank <= 20""")
def topk_per_barcode(spark, sf):
    return M.topk_per_barcode(ok(spark, sf), 20).select("barcode", "read_id", "rank")


@query("select barcode, read_id from (select barcode, read_id from d_ok order by md5('7:' || read_id), read_id limit 100)")
def stable_sample(spark, sf):
    return M.stable_sample(ok(spark, sf), 100, 7).select("barcode", "read_id")


@query("""
select source_file, read_id, raw_length from raw_index where raw_length >= 10000 order by source_file, read_id limit 64""")
def first_n_reads(spark, sf):
    return fixture(spark, sf, "raw_index").where("raw_length >= 10000").orderBy("source_file", "read_id").limit(64)


@query("select barcode, read_id from d_ok order by barcode, read_id")
def stable_order(spark, sf):
    return M.stable_order(ok(spark, sf).select("barcode", "read_id"))


@query("select barcode, count(*) as n, count(distinct read_id) as ids from d_cand group by 1")
def candidates_union(spark, sf):
    rows = cand(spark, sf)
    one, two, three = (rows.where(F.col("barcode") == f"barcode0{k}") for k in (1, 2, 3))  # all that there are
    both = one.unionByName(two).unionByName(three)
    return both.groupBy("barcode").agg(F.count("*").alias("n"), F.count_distinct("read_id").alias("ids"))


#: Losses and feature layers that the return flag, the status and the line of an item stand for.
_LOSS = """
select l_orderkey as step, l_extendedprice / 1000 as value,
       case when l_returnflag = 'A' then 'time_l1' when l_returnflag = 'N' and l_linestatus = 'F' then 'small_stft_logmag_l1'
            when l_returnflag = 'N' then 'large_stft_logmag_l1' when l_linenumber % 3 = 0 then 'conv1'
            when l_linenumber % 3 = 1 then 'conv2' else 'other' end as metric
from lineitem"""
_SUMS = """select step, sum(value * case metric when 'time_l1' then 1.0 when 'small_stft_logmag_l1' then 2.0
                             when 'large_stft_logmag_l1' then 0.25 else 0 end) as reconstruct,
            sum(case when metric in ('conv1', 'conv2') then value / 2 else 0 end) as layers_raw"""


@query(f"""
select step, round(reconstruct, 7) as reconstruct, round(layers_raw, 7) as layers_raw, round(layers_raw * r, 7) as layers,
       round(reconstruct + layers_raw * r, 7) as total
from (select *, 0.5 * case when step < 100 then 0 else greatest(0, least(1, (step - 100 + 1) / 391.0)) end as r
      from ({_SUMS} from ({_LOSS}) group by 1))""")
def loss_weighting(spark, sf):
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("lineitem")
    weights = {"small_stft_logmag_l1": 2.0, "stft_logmag_l1": 0.25}
    out = L.loss_weighting(spark.sql(_LOSS), weights, ("conv1", "conv2"), scale=0.5, start=100, warm=391)
    return out.select("step", *[r6(c, 7) for c in ("reconstruct", "layers_raw", "layers", "total")])


@query("""
select step, 'valid/' || case metric when 'purchase' then 'buy' when 'perplexity' then 'codebook_perplexity' else metric end as metric,
       value
from step_log where metric in ('purchase', 'perplexity') or metric like 'c%'""")
def metric_rename(spark, sf):
    names = {"purchase": "buy", "perplexity": "codebook_perplexity"}
    return L.metric_rename(fixture(spark, sf, "step_log"), names, "valid", "c")


def _metrics_sql(prefix: str) -> str:
    names = ", ".join(f"{c} as {prefix}{d}".replace(f"{prefix}{d}", f'"{prefix}{d}"') for c, d in C.DOCUMENT.items())
    return f"select metric, value from (unpivot (select columns(*)::double from (select {names} from ({CALL}))) on columns(*) into name metric value value)"


@query(_metrics_sql("valid/"))
def flatten_metrics(spark, sf):
    return C.flatten(C.call_document(call_summary(spark, sf)))


_BLOCK = """
select block, metric, round(case when metric in ('perplexity', 'code_usage') then last else mean end, 6) as value
from (select (step - 1) // 50 as block, metric, avg(value) as mean, arg_max(value, (step, value)) as last, max(step) as step
      from step_log group by 1, 2)
where (block + 1) * 50 <= (select max(step) from step_log)
  and (metric not in ('perplexity', 'code_usage') or step = (block + 1) * 50)"""


@query(_BLOCK)
def step_window_mean(spark, sf):
    return L.step_window_mean(fixture(spark, sf, "step_log"), 50).select("block", "metric", r6("value"))


@query("""
select block, round(wait, 6) as wait, round(wait + compute, 6) as step_ms,
       round(100 * sync / greatest(1e-6, compute + sync), 6) as host_sync_pct,
       round(100 * wait / greatest(1e-6, wait + compute), 6) as input_wait_pct
from (select (step - 1) // 50 as block, avg(value) as wait, avg(value * 3) as compute, avg(value / 4) as sync
      from step_log group by 1)
where (block + 1) * 50 <= (select max(step) from step_log)""")
def perf_window(spark, sf):
    value = F.col("value")
    rows = fixture(spark, sf, "step_log").select("step", value.alias("wait"), (value * 3).alias("compute"), (value / 4).alias("sync"))
    return L.perf_window(rows, 50).select("block", *[r6(c) for c in ("wait", "step_ms", "host_sync_pct", "input_wait_pct")])


@query("""
select event_id + 1 as step, 'loss' as metric, case when event_id % 41 = 0 then 'nan'::double when event_id % 43 = 0 then '-inf'::double else round(value, 3) end as value
from events
union all select event_id + 1, 'rate', user_id::double from events""")
def parse_step_log(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    odd = F.when(F.col("event_id") % 41 == 0, float("nan")).when(F.col("event_id") % 43 == 0, float("-inf"))
    # the double nearest to value * 1000 is rounded, as DuckDB does; Spark's own round to 3 places rounds the decimal that a double is shown as
    # (which also loses the sign of a zero); a value too large for that stays as it is
    near = F.signum("value") * (F.round(F.abs("value") * 1000, 0) / 1000)
    loss = F.coalesce(odd, F.when(near.isin(float("inf"), float("-inf")), F.col("value")).otherwise(near))
    line = F.format_string("[step %s] loss=%s, rate=%s", *map(L.printed, (F.col("event_id") + 1, loss, F.col("user_id"))))
    return L.parse_step_log(rows.select(line.alias("value"))).drop("perf")


_KEPT = """
select step, step_ms from (select *, row_number() over (order by step) as r, count(*) over () as n from timings)
where r > 20 and r <= n - 20"""


@query(_KEPT)
def trim_rank_range(spark, sf):
    return L.trim_rank_range(fixture(spark, sf, "timings"), "step", 20).select("step", "step_ms")


@query(f"""
select count(*) as kept, min(step) as first_step, max(step) as last_step, round(avg(step_ms), 6) as mean_ms,
       round(quantile_cont(step_ms, 0.5), 6) as median_ms, round(quantile_cont(step_ms, 0.9), 6) as p90_ms,
       round(quantile_cont(step_ms, 0.95), 6) as p95_ms, round(stddev_pop(step_ms), 6) as std_ms,
       round(1000 / avg(step_ms), 6) as batches_s, round(1000 / avg(step_ms) * 32, 4) as chunks_s,
       round(1000 / avg(step_ms) * 32 * 12288, 1) as points_s
from ({_KEPT})""")
def timing_summary(spark, sf):
    out = L.timing_summary(fixture(spark, sf, "timings"), 32, 12288, 20)
    exact = ("mean_ms", "median_ms", "p90_ms", "p95_ms", "std_ms", "batches_s")
    return out.select("kept", "first_step", "last_step", *[r6(c) for c in exact], r6("chunks_s", 4), r6("points_s", 1))


_EVALS = "select step, run, coalesce(mean_qscore_delta, summary_mean) as metric from eval_history"


def _best_sql(by: str) -> str:
    over = "partition by run order by step" if by else "order by step"
    number = "max(metric) filter (where not isnan(metric)) over"
    return f"""
select {by}step, metric, best, max(case when is_new_best then step end) over ({over} rows unbounded preceding) as best_step,
       is_new_best
from (select *, {number} ({over} rows unbounded preceding) as best,
             not isnan(metric) and coalesce(metric > {number} ({over} rows between unbounded preceding and 1 preceding), true) as is_new_best
      from ({_EVALS}) where metric is not null)"""


def _evals(spark, sf):
    rows = fixture(spark, sf, "eval_history").withColumn("summary", F.struct(F.col("summary_mean").alias("mean")))
    return rows.withColumn("metric", L.eval_metric(F.col("mean_qscore_delta"), F.col("summary")))


@query(_best_sql(""))
def running_best(spark, sf):
    return L.running_best(_evals(spark, sf), F.col("metric"), block=500, nan_stays=False)


_RUNS = """
select o_orderkey as position, 'ckpt/run' || (o_custkey % 40) || '/best' as checkpoint,
       'models/v@' || (o_orderkey % 3) || '.x y' as model
from orders"""


@query(f"""
select position, case when n > 1 then tagged || '_' || n else tagged end as name
from (select *, row_number() over (partition by tagged order by position) as n
      from (select position, case when count(*) over (partition by base) > 1 then base || '_' ||
                   replace(replace(replace(str_split(model, '/')[-1], '@', '_at_'), '.', '_'), ' ', '_') else base end as tagged
            from (select *, str_split(checkpoint, '/')[-2] || '_' || str_split(checkpoint, '/')[-1] as base from ({_RUNS}))))""")
def unique_run_names(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    return M.unique_run_names(spark.sql(_RUNS))


_SIDES = {"original": "d_mto", "generated": "d_mtg"}
#: Numbers as they are: a report rounds them once.
_SIDE = " union all ".join(
    f"select '{k}' as side, count(*) as shared, coalesce(sum(identity * weight) / nullif(sum(weight), 0), 0) as weighted_identity,"
    f" coalesce(avg(empirical_q), 0) as mean_empirical_q, coalesce(avg(right_q), 0) as mean_predicted_q from {d}" for k, d in _SIDES.items()
)


@query(f"""
select position, name, g.shared, printf('%.6f', g.weighted_identity) as identity, printf('%.4f', g.mean_empirical_q) as empirical_q,
       printf('%.4f', g.mean_predicted_q) as fastq_q, printf('%+.6f', g.weighted_identity - o.weighted_identity) as delta_identity,
       printf('%+.4f', g.mean_empirical_q - o.mean_empirical_q) as delta_empirical_q
from (values (0, 'a_best_one', 'generated', 'original'), (1, 'a_best_two_1', 'original', 'generated')) r(position, name, gen, orig)
     join ({_SIDE}) g on g.side = gen join ({_SIDE}) o on o.side = orig""")
def compare_runs(spark, sf):
    """Two runs from one checkpoint by two models: the second takes for original what the first generated, and the other way round."""
    runs = [(0, "ckpt/a/best", "models/one"), (1, "ckpt/a/best", "models/two.1")]
    names = M.unique_run_names(spark.createDataFrame(runs, "position int, checkpoint string, model string"))
    sides = {k: stored(_truth(spark, sf, k), f"summary-{k}") for k in _SIDES}
    one = {k: rows.select(F.struct(*rows.columns).alias("s")) for k, rows in sides.items()}

    def pair(position: int, generated: str, original: str) -> DataFrame:
        both = one[generated].withColumnRenamed("s", "generated").crossJoin(one[original].withColumnRenamed("s", "original"))  # one row each
        return both.withColumn("position", F.lit(position))

    return C.comparison(names.join(pair(0, "generated", "original").union(pair(1, "original", "generated")), "position"))


@query(_CLEAN)
def scan_readstats(spark, sf):
    path = shared_folder(spark, "stats")
    names = [x.split()[0] for x in io.STATS.split(", ")]
    fixture(spark, sf, "readstats").select(*names).write.csv(path, sep="\t", header=True, compression="gzip")
    rows = M.candidates(io.scan_stats(spark, path, 8))
    return rows.select("read_id", "read_length", "qstart", "qend", *[r6(c) for c in _REALS])


@query("select read_id::varchar as read_id, seq, qual from calls_truth")
def scan_fastq(spark, sf):
    path = shared_folder(spark, "fastq")
    io.write_fastq(calls(spark, sf, "truth"), path)
    return io.scan_fastq(spark, path)


@query("""
select unnest(['@' || read_id, seq, '+', qual]) as line from calls_original""")
def write_fastq(spark, sf):
    path = shared_folder(spark, "fastq")
    io.write_fastq(calls(spark, sf, "original"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("select read_id, source_file, raw_length from reads_meta")
def scan_manifest(spark, sf):
    path = shared_folder(spark, "manifest")
    one = F.struct("source_file", "read_id", "raw_length")
    part = F.floor(F.col("read_id") / 100).alias("part")  # so a document has no more reads, however many its source has
    rows = fixture(spark, sf, "reads_meta").groupBy("source_file", part).agg(F.collect_list(one).alias("selected_reads"))
    # documents of several lines, one a file
    doc = F.to_json(F.struct(F.col("source_file").alias("fc"), "selected_reads"), {"pretty": "true"})
    rows.select(doc.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    kind = "selected_reads array<struct<source_file:string,read_id:long,raw_length:long>>"
    return io.scan_manifest(spark, path, kind).select("read_id", "source_file", "raw_length")


def _round_trip(spark, sf, write):
    path = shared_folder(spark, "rows")
    rows = usable(spark, sf).select("read_id", "barcode", "raw_length", "reason")
    write(rows, path)
    return spark.read.schema(rows.schema).json(path)


_USE = "select read_id, barcode, raw_length, reason from d_use"
query(_USE, "write_jsonl")(lambda spark, sf: _round_trip(spark, sf, io.write_jsonl))


@query(f"""
select run as evaluation, step, 'ok' as status, metric, null::varchar as checkpoint_path from ({_EVALS}) where metric is not null
union all
select run || '-failed', step, 'failed', null, 'ckpt/' || step from ({_EVALS}) where metric is null""")
def append_history(spark, sf):
    """The results of every run, its failed evaluations, and the results once more, which adds nothing."""
    path, rows = shared_folder(spark, "history"), _evals(spark, sf).select("run", "step", "metric")
    results = rows.where("metric is not null").select(F.col("run").alias("evaluation"), "step", F.lit("ok").alias("status"), "metric")
    checkpoint = F.concat(F.lit("ckpt/"), F.col("step").cast("string")).alias("checkpoint_path")
    failed = rows.where("metric is null").select(F.concat("run", F.lit("-failed")).alias("evaluation"), "step", checkpoint)
    for documents in (results, io.failures(failed), results):
        io.append_history(documents, path)
    return io.read_history(spark, path, "evaluation string, step long, status string, metric double, checkpoint_path string")


@query(_metrics_sql(""))
def write_summary_json(spark, sf):
    """The nested document, written, read back by its own schema and shown as its numbers."""
    path, document = shared_folder(spark, "summary"), C.call_document(call_summary(spark, sf))
    io.write_summary(N.flat(document), path)
    return N.metrics(spark.read.schema(document.schema).json(path))


@query("select read_id, source_file, raw_length from reads_meta")
def write_reads(spark, sf):
    path = shared_folder(spark, "reads")
    io.write_reads(reads(spark, sf), path)
    return spark.read.parquet(path).select("read_id", "source_file", F.size("adc").cast("long").alias("raw_length"))


@query("""
select read_id, source_file, raw_length, null::varchar as reason from reads_meta
union all select null, 'bad.parquet', null, 'no parquet file' union all select null, 'empty.parquet', null, 'no parquet file'""")
def scan_skip_corrupt(spark, sf):
    """The reads of the sound files, twice, and the files that the first scan found damaged and the second didn't open."""
    path, rows = shared_folder(spark, "damaged"), reads(spark, sf)
    rows.where("read_id % 2 = 0").write.parquet(path)
    for name, content in (("bad", b"no parquet"), ("empty", b"")):
        io.write_bytes(f"{path}/{name}.parquet", content)
    scan = lambda: io.scan_reads(spark, path, schema=rows.schema, skip_corrupt=True).select("read_id", "source_file", "raw_length")
    first = stored(scan(), "first")
    rows.where("read_id % 2 != 0").write.mode("append").parquet(path)
    both = first.union(scan().where("read_id % 2 != 0")).withColumn("reason", F.lit(None).cast("string"))
    bad = io.quarantined(spark, f"{path}/_quarantine")
    return both.union(bad.select(F.lit(None).cast("long"), F.substring_index("path", "/", -1), F.lit(None).cast("long"), "reason"))


DELAY = 500  # steps by which evaluations arrive out of order
TOGETHER = 1_000_000  # rows that arrive together, about, in a table of many


def _streamed(spark: SparkSession, parts: list[DataFrame], op, mode: str = "append") -> DataFrame:
    """What ``op`` gives over ``parts`` that arrive one after the other, with the number of the batch.

    A part is written when the one before it has been read, so its files are one batch, however many they are.
    """
    root, kind = shared_folder(spark, "stream"), parts[0].schema
    for k, part in enumerate(parts):
        part.write.parquet(f"{root}/in/{k:03}")
        out = op(spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{root}/in"))
        writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        writer.foreachBatch(streams.batch_sink(f"{root}/out")).start().awaitTermination()
    return streams.read_sink(spark, f"{root}/out", out)


def _arriving(rows: DataFrame, order) -> list[DataFrame]:
    """Rows by an order that is no secret to the stream, in three parts, or more of about ``TOGETHER`` rows."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "arriving")
    n = max(3, -(-rows.count() // TOGETHER))
    at = rows.select(order.alias("arrives")).stat.approxQuantile("arrives", [k / n for k in range(1, n)], 0.03 / n)
    part = sum([F.when(order > x, 1).otherwise(0) for x in at], F.lit(0)).alias("part")
    rows.select("*", part).write.partitionBy("part").parquet(path)
    parts = spark.read.schema(StructType([*rows.schema, StructField("part", IntegerType())])).parquet(path)
    return [parts.where(F.col("part") == k).drop("part") for k in range(n)]


@query(None)
def stream_chunks(spark, sf):
    rows = reads(spark, sf)
    return _flag(_streamed(spark, [rows.where(F.pmod("read_id", F.lit(3)) == k) for k in range(3)], lambda s: streams.stream_chunks(s, SIZE, HOP)))


@query(_BLOCK)
def stream_step_windows(spark, sf):
    """The log arrives in the order of its steps, but for ``DELAY`` of them; its last line comes when the run has ended."""
    rows = fixture(spark, sf, "step_log")
    parts = _arriving(rows, F.col("step") + F.pmod(F.xxhash64("step"), F.lit(DELAY)))
    end = rows.agg((F.max("step") + 1 + DELAY).alias("step")).select("step", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"))
    out = _streamed(spark, [*parts, end], lambda s: streams.stream_step_windows(s, 50, DELAY))
    return out.select("block", "metric", r6("value"))


@query(_best_sql("run, "))
def stream_running_best(spark, sf):
    """Evaluations arrive out of order by up to ``DELAY`` steps; each run's last line ends it."""
    for name, value in streams.STATE_STORE.items():
        spark.conf.set(name, value)
    rows = _evals(spark, sf).select("run", "step", "metric")
    parts = _arriving(rows, F.col("step") + F.pmod(F.xxhash64("step"), F.lit(DELAY)))
    end = rows.select("run").distinct().select("run", F.lit(None).cast("long").alias("step"), F.lit(None).cast("double").alias("metric"))
    return _streamed(spark, [*parts, end], lambda s: streams.stream_running_best(s, DELAY, nan_stays=False)).drop("batch", "late")
