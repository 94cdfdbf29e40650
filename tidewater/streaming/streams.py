"""Structured Streaming forms of the chunk and log operators, and a sink that a repeated batch leaves as it was."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions import signal as S
from tidewater.operators import runlog as L
from tidewater.operators import windows as W

#: What keyed state of any kind needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a folder of its own that a repeated batch replaces, so repeats add nothing."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def read_sink(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What `batch_sink` holds, with the number of the batch as ``batch``."""
    return spark.read.schema(like.schema.add("batch", "long")).parquet(path)


def stream_chunks(reads: DataFrame, size: int, hop: int) -> DataFrame:
    """Stateless: the same chunks as in batch, whatever arrives together."""
    rows = W.calibration_valid(reads).withColumn("pa", S.to_picoamps(F.col("adc"), F.col("offset_adc"), F.col("scale")))
    return W.normalised(W.chunks(rows, F.col("pa"), size, hop))


def stream_step_windows(log: DataFrame, n: int, delay: int = 0) -> DataFrame:
    """block, metric, value of ``log(step, metric, value)``, each once, when a later step closes its block; for append mode.

    Steps are the seconds of event time, so blocks are windows and Spark keeps only those still open. A block is closed when a
    step arrives that is more than ``delay`` steps past its last one; rows of a closed block are late and dropped. A row without
    metric and value is a step like any other that closes blocks: the last line of a run that has ended, ``delay`` + 1 past its last
    step, closes a last block that is whole and leaves one that is not.
    """
    rows = log.withColumn("time", F.timestamp_seconds("step")).withWatermark("time", f"{delay} seconds")
    block = F.window("time", f"{n} seconds", startTime="1 second")
    per = rows.groupBy(block.alias("w"), "metric").agg(*L.block_sums())
    per = per.where("mean is not null")  # known only after the sums, so it can't be moved before the watermark
    first = F.unix_seconds(F.col("w.start")) - 1
    return L.block_value(per.select(F.floor(first / n).alias("block"), "metric", "mean", "at_last", "step"), n)


class RunningBest(StatefulProcessor):
    """State of one run: the best so far, and the steps whose predecessors can still come."""

    def __init__(self, delay: int, nan_stays: bool = True):
        self.delay, self.nan_stays = delay, nan_stays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "best double, at long")
        self.seen = handle.getValueState("seen", "last long, released long")
        self.held = handle.getMapState("held", "step long", "metric double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802, ARG002
        best, at = self.best.get() if self.best.exists() else (None, None)
        judged = Row(*[x.split()[0] for x in BEST.split(", ")])
        last, released = self.seen.get() if self.seen.exists() else (-(1 << 62), -(1 << 62))
        before = {k[0]: v[0] for k, v in self.held.iterator()}  # of the last ``delay`` steps
        held, end = dict(before), False
        for row in rows:
            if row.step is None:
                end = True
                continue
            last = max(last, row.step)
            if row.metric is None:
                continue
            if row.step <= released:
                yield judged(key[0], row.step, row.metric, best, at, False, True)
                continue
            held[row.step] = max(held.get(row.step, row.metric), row.metric, key=lambda m: (not math.isnan(m), m))
        ready = sorted(k for k in held if end or k <= last - self.delay)
        for step in ready:
            metric = held.pop(step)
            # NaN is no more than any number, and no number more than NaN
            new = metric > best if best is not None else self.nan_stays or not math.isnan(metric)
            if new:
                best, at = metric, step
            yield judged(key[0], step, metric, best, at, new, False)
            if step in before:
                self.held.removeKey((step,))
        # what a batch brings and judges never gets into the state
        for step, metric in held.items():
            if before.get(step) != metric:
                self.held.updateValue((step,), (float(metric),))
        released = max([released, *ready[-1:], last if end else last - self.delay])
        if best is not None:
            self.best.update((float(best), int(at)))
        self.seen.update((last, released))

    def close(self) -> None:
        pass


BEST = "run string, step long, metric double, best double, best_step long, is_new_best boolean, late boolean"


def stream_running_best(evals: DataFrame, delay: int = 0, nan_stays: bool = True) -> DataFrame:
    """run, step, metric, best, best_step, is_new_best, late of ``evals(run, step, metric)``, judged in the order of their steps.

    A step is held until a step ``delay`` or more past it has come, as until then its predecessors may; then it is judged
    and returned. A step that comes after it could be judged is late: it is returned as such, with the best of then, and changes
    nothing. A row without a step ends its run: what is held is judged. Rows without a metric count for the order only; a
    step that comes twice before it is judged counts once, with the greater metric. NaN is as in `operators.runlog.running_best`.
    The rows of a run that arrive in one batch are held by its task. Needs STATE_STORE.
    """
    return evals.select("run", "step", "metric").groupBy("run").transformWithState(RunningBest(delay, nan_stays), BEST, "append", "None")
