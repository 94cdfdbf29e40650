"""Training logs: parsing, block means, timing, running best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.storage import stored

from .quantiles import quantiles

NUMBERS = r"([A-Za-z_][\w./]*)=(None\b|-?(?:nan|inf|[\d.]+(?:[eE][-+]?\d+)?))"
SPARSE = ("perplexity", "code_usage")


def parse_step_log(lines: DataFrame) -> DataFrame:
    """step, perf, metric, value of lines ``[step N] k=v, ...`` and ``[perf step N] ...`` in a column ``value``.

    Numbers are what the writer prints: also ``nan``, ``inf`` and ``-inf``. ``None`` is a metric without a value, or a line without a step.
    """
    head = F.regexp_extract("value", r"^\[(perf )?step\s+(None|-?\d+)\]", 2)
    pairs = F.regexp_extract_all("value", F.lit(NUMBERS), F.lit(0))
    rows = lines.where(head != "").select(F.nullif(head, F.lit("None")).cast("long").alias("step"), F.col("value").startswith("[perf").alias("perf"), F.explode(pairs).alias("kv"))
    return rows.select("step", "perf", F.substring_index("kv", "=", 1).alias("metric"), F.nullif(F.substring_index("kv", "=", -1), F.lit("None")).cast("double").alias("value"))


def printed(number: Column) -> Column:
    """A number as the writer of a log prints it, in Python's spelling of what is none."""
    infinite = F.when(number == float("inf"), "inf").when(number == float("-inf"), "-inf")
    return F.when(number.isNull(), "None").when(F.isnan(number), "nan").otherwise(F.coalesce(infinite, number.cast("string")))


def metric_rename(log: DataFrame, names: dict[str, str], split: str = "train", keep: str | None = None) -> DataFrame:
    """``log`` with the metrics of ``names`` renamed, and those that start with ``keep`` as they are; all others go.

    Splits other than ``train`` are put before the name.
    """
    new = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("metric")] if names else F.lit(None)
    kept = F.when(F.col("metric").startswith(keep), F.col("metric")) if keep else F.lit(None)
    rows = log.withColumn("metric", F.coalesce(new, kept)).where("metric is not null")
    return rows if split == "train" else rows.withColumn("metric", F.concat(F.lit(f"{split}/"), "metric"))


def step_window_mean(log: DataFrame, n: int) -> DataFrame:
    """Mean per metric over whole blocks of n steps; sparse metrics give the last step's value, if logged there."""
    block = F.floor((F.col("step") - 1) / n)
    last = log.agg(F.max("step").alias("last"))
    rows = log.withColumn("block", block).groupBy("block", "metric").agg(*block_sums())
    whole = rows.crossJoin(F.broadcast(last)).where((F.col("block") + 1) * n <= F.col("last"))  # one row
    return block_value(whole, n)


def block_sums() -> list[Column]:
    """What `block_value` needs of the rows of a block and metric."""
    at_last = F.max_by("value", F.struct("step", "value"))
    return [F.avg("value").alias("mean"), at_last.alias("at_last"), F.max("step").alias("step")]


def block_value(rows: DataFrame, n: int) -> DataFrame:
    """block, metric, value: the mean, but of sparse metrics what the block's last step logged, if it did."""
    sparse = F.col("metric").isin(*SPARSE)
    value = F.when(sparse, F.col("at_last")).otherwise(F.col("mean")).alias("value")
    return rows.where(~sparse | (F.col("step") == (F.col("block") + 1) * n)).select("block", "metric", value)


def perf_window(log: DataFrame, n: int) -> DataFrame:
    """Block means of wait, step (``compute``) and sync time with their shares, over whole blocks of n steps: a last, incomplete one is never read."""
    block = F.floor((F.col("step") - 1) / n)
    last = F.broadcast(log.agg(F.max("step").alias("last")))  # one row
    rows = log.groupBy(block.alias("block")).agg(*[F.avg(c).alias(c) for c in ("wait", "compute", "sync")])
    rows = rows.crossJoin(last).where((F.col("block") + 1) * n <= F.col("last"))
    step, host = F.col("wait") + F.col("compute"), F.col("compute") + F.col("sync")
    share = lambda part, whole: 100 * F.col(part) / F.greatest(F.lit(1e-6), whole)
    shares = share("sync", host).alias("host_sync_pct"), share("wait", step).alias("input_wait_pct")
    return rows.select("block", "wait", "compute", "sync", step.alias("step_ms"), *shares)


def trim_rank_range(rows: DataFrame, order: str, d: int) -> DataFrame:
    """All but the first d and last d rows by ``order``, which no two rows share; an error unless there are more than 2 d."""
    n = rows.count()
    if n <= 2 * d:
        raise ValueError(f"{n} rows are not more than {2 * d}")
    if not d:
        return rows
    # two bounded sorts, of d rows each, give the bounds
    low = rows.select(order).orderBy(order).limit(d).agg(F.max(order)).first()[0]
    high = rows.select(order).orderBy(F.desc(order)).limit(d).agg(F.min(order)).first()[0]
    return rows.where((F.col(order) > F.lit(low)) & (F.col(order) < F.lit(high)))


def timing_summary(times: DataFrame, batch: int, chunk: int, discard: int = 0) -> DataFrame:
    """Summary of ``times(step, step_ms)`` without the first and last ``discard`` steps, and the rates that follow."""
    ms, kept = F.col("step_ms"), stored(trim_rank_range(times, "step", discard).select("step", "step_ms"), "kept")
    stats = kept.agg(
        F.count("*").alias("kept"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.avg(ms).alias("mean_ms"),
        F.stddev_pop(ms).alias("std_ms"),
    )
    names = {0.5: "median_ms", 0.9: "p90_ms", 0.95: "p95_ms"}
    tails = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()]
    stats = stats.crossJoin(quantiles(kept, ("step_ms",), tuple(names)).agg(*tails))  # one row each
    rate = F.try_divide(F.lit(1000.0), F.col("mean_ms"))
    rates = rate.alias("batches_s"), (rate * batch).alias("chunks_s"), (rate * batch * chunk).alias("points_s")
    return stats.select("kept", "first_step", "last_step", "mean_ms", *names.values(), "std_ms", *rates)


def running_best(evals: DataFrame, metric: Column, *by: str, block: int = 100_000, nan_stays: bool = True) -> DataFrame:
    """step, metric, best so far, its step and whether the step is a new best; rows without a metric are skipped.

    A new best is more than the best so far. NaN is never more, so none replaces a number; nothing is more than NaN, so one that
    comes first stays the best. Without ``nan_stays`` NaN is never the best, also if it comes first. Windows see ``block`` steps each; what came before a block is known from one row per block.
    """
    rows = evals.withColumn("metric", metric).where("metric is not null").withColumn("block", F.floor(F.col("step") / block))
    rows = rows.withColumn("number", F.when(~F.isnan("metric"), F.col("metric")))
    top = F.max(F.when(F.col("number").isNotNull(), F.struct("number", (-F.col("step")).alias("back")))).alias("top")
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, "block").agg(top).select(*by, "block", F.max("top").over(earlier).alias("top"))
    begin = rows.groupBy(*by).agg(F.min(F.struct("step", F.isnan("metric").alias("nan"))).alias("begin"))  # one row a run
    rows = rows.join(tops, [*by, "block"])
    if nan_stays:
        rows = rows.join(begin, list(by)) if by else rows.crossJoin(begin)
    within = Window.partitionBy(*by, "block").orderBy("step")
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    past = F.greatest(F.max("number").over(before), F.col("top.number"))
    more = F.col("number").isNotNull() & (past.isNull() | (F.col("number") > past))
    stuck = F.col("begin.nan")  # known only if ``nan_stays``
    rows = rows.withColumn("is_new_best", F.when(stuck, F.col("step") == F.col("begin.step")).otherwise(more) if nan_stays else more)
    best = F.greatest(F.max("number").over(upto), F.col("top.number"))
    at = F.coalesce(F.last(F.when(F.col("is_new_best"), F.col("step")), ignorenulls=True).over(upto), -F.col("top.back"))
    if nan_stays:
        best, at = F.when(stuck, float("nan")).otherwise(best), F.when(stuck, F.col("begin.step")).otherwise(at)
    return rows.select(*by, "step", "metric", best.alias("best"), at.alias("best_step"), "is_new_best")


def eval_metric(delta: Column, summary: Column) -> Column:
    """What an evaluation is judged by: ``delta``, or the mean of its ``summary`` struct where that is missing."""
    return F.coalesce(delta, summary["mean"])


#: Weights of the losses over time where none is given.
DEFAULTS = {"time_l1": 1.0, "diff1_l1": 0.0, "diff2_l1": 0.0}
SPECTRAL = "_stft_logmag_l1"


def loss_weighting(
    raw: DataFrame, weights: dict[str, float], layers: tuple[str, ...] = (), layer_weights: dict[str, float] | None = None,
    scale: float = 1.0, start: int = 0, warm: int = 0,
) -> DataFrame:
    """step, reconstruct, layers_raw, layers and total of ``raw(step, metric, value)``.

    A loss counts with its weight; one over a spectral scale (``<scale>_stft_logmag_l1``) without a weight of its own with that
    of ``stft_logmag_l1``. Feature ``layers`` count with theirs, 1 / n each where none are given, times ``scale`` and the ramp.
    Metrics that are neither count nothing.
    """
    if layer_weights is not None and set(layer_weights) != set(layers):
        raise ValueError("layers and layer weights differ")
    of = lambda names: F.create_map(*[F.lit(x) for n, w in names.items() for x in (n, float(w))])[F.col("metric")]
    own = dict.fromkeys(layers, 1.0 / max(len(layers), 1)) if layer_weights is None else layer_weights
    legacy = F.when(F.col("metric").endswith(SPECTRAL), F.lit(float(weights.get(SPECTRAL[1:], 0.0))))
    named = {n: w for n, w in (DEFAULTS | weights).items() if n != SPECTRAL[1:]}
    loss = F.sum(F.col("value") * F.coalesce(of(named), legacy, F.lit(0.0)))
    layer = F.sum(F.col("value") * (F.coalesce(of(own), F.lit(0.0)) if own else F.lit(0.0)))
    rows = raw.groupBy("step").agg(loss.alias("reconstruct"), layer.alias("layers_raw"))
    rows = rows.withColumn("layers", F.col("layers_raw") * scale * ramp(F.col("step"), start, warm))
    return rows.withColumn("total", F.col("reconstruct") + F.col("layers"))


def ramp(step: Column, start: int, warm: int) -> Column:
    """0 before ``start``, then a rise to 1 over ``warm`` steps."""
    rise = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - start + 1) / F.lit(float(max(warm, 1)))))
    return F.when(step < start, 0.0).otherwise(rise if warm > 0 else F.lit(1.0))
