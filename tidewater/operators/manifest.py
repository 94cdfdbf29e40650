"""Candidate tables to evaluation manifests: cleaning, filters, lookups, ranking, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_double(c: Column) -> Column:
    """Null, empty and NaN become 0.0; other text that is no number raises."""
    return F.nanvl(F.coalesce(F.nullif(c, F.lit("")).cast("double"), F.lit(0.0)), F.lit(0.0))


def clean_long(c: Column) -> Column:
    """The same, rounded half-even."""
    return F.rint(clean_double(c)).cast("long")


def candidates(stats: DataFrame) -> DataFrame:
    whole = lambda *names: [clean_long(F.col(c)).alias(c) for c in names]
    real = [clean_double(F.col(c)).alias(c) for c in ("acc", "coverage", "mean_quality")]
    return stats.select(
        F.col("name").cast("long").alias("read_id"), "barcode", *whole("read_length", "qstart", "qend"), *real,
        "ref", *whole("rstart", "rend"), F.lit("FC").alias("fc"),
    )


def candidate_filter(
    rows: DataFrame, mode: str, min_length: int, acc: float = 0, coverage: float = 0, quality: float = 0,
    max_start: int = 0, max_tail: int = 0,
) -> DataFrame:
    rows = rows.where(F.col("read_length") >= min_length)
    if mode == "len_only":
        return rows
    rows = rows.where((F.col("acc") >= acc) & (F.col("coverage") >= coverage) & (F.col("mean_quality") >= quality))
    return rows.where((F.col("qstart") <= max_start) & (F.col("read_length") - F.col("qend") <= max_tail))


def first_file_lookup(ids: DataFrame, index: DataFrame) -> DataFrame:
    """File and length of each id; the first file in order wins."""
    found = index.join(ids.select("read_id"), "read_id", "left_semi")
    return found.groupBy("read_id").agg(F.min(F.struct("source_file", "raw_length")).alias("m")).select("read_id", "m.source_file", "m.raw_length")


def truth_lookup(rows: DataFrame, alignments: DataFrame, slack: int = 512) -> DataFrame:
    """The record of the same id, one that overlaps on the same reference preferred, the first with a sequence.

    An id that is a candidate in several barcodes is looked up in each, among the barcode's own records if ``alignments`` has
    a ``barcode``; of what is found, that of the last barcode in order counts.
    """
    low = F.greatest(F.col("rstart") - slack, F.lit(0))
    high = F.greatest(F.col("rstart") + 1, F.col("rend") + slack)
    keys = ["read_id", "barcode"] if "barcode" in alignments.columns else ["read_id"]
    wanted = rows.select("read_id", "barcode", F.col("ref").alias("want"), low.alias("low"), high.alias("high"))
    both = wanted.join(alignments.where("seq != ''"), keys)
    overlap = (F.col("ref") == F.col("want")) & (F.col("start_pos") < F.col("high")) & (F.col("end_pos") > F.col("low"))
    found = F.struct((~overlap).cast("int").alias("miss"), "ordinal", "seq")
    best = both.groupBy("read_id", "barcode").agg(F.min(found).alias("m"))
    last = best.groupBy("read_id").agg(F.max_by("m", "barcode").alias("m"))
    return last.select("read_id", (F.col("m.miss") == 0).alias("overlaps"), F.col("m.ordinal").alias("ordinal"), F.col("m.seq").alias("seq"))


def usable_join(rows: DataFrame, raw: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates with what was found on either side and the reason why one is not usable."""
    joined = rows.join(raw, "read_id", "left").join(truth.select("read_id", "ordinal", "seq"), "read_id", "left")
    reason = F.when(F.col("raw_length").isNull(), "no raw read").when(F.col("seq").isNull(), "no truth")
    return joined.withColumn("reason", reason)


def not_contained(selected: DataFrame, index: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """read_id, problem of the ``selected`` reads that ``index`` lacks or whose length there is out of bounds."""
    found = selected.select("read_id").distinct().join(first_file_lookup(selected, index), "read_id", "left")
    length = F.col("raw_length")
    out = (length < low) | (length > high) if high is not None else length < low
    return found.select("read_id", F.when(length.isNull(), "unknown").when(out, "out of bounds").alias("problem")).where("problem is not null")


def require_contained(selected: DataFrame, index: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """``selected`` if every read is in ``index`` and within bounds; otherwise an error with their number and the first."""
    bad = not_contained(selected, index, low, high).agg(F.count("*").alias("n"), F.min("read_id").alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} reads are unknown or out of bounds, the first is {bad['first']}")
    return selected


def group_report(groups: DataFrame, usable: DataFrame, selected: DataFrame) -> DataFrame:
    """Per barcode of ``groups``: how many candidates, usable and selected, and bounds of the selected; 0 where there are none.

    ``usable(barcode, reason)`` are candidates as `usable_join` gives them, ``selected(barcode, raw_length, seq)`` some of them.
    """
    per = usable.groupBy("barcode").agg(F.count("*").alias("candidates"), F.sum(F.col("reason").isNull().cast("long")).alias("usable"))
    length = F.length("seq").cast("long")
    own = selected.groupBy("barcode").agg(
        F.count("*").alias("selected"), F.min("raw_length").alias("min_raw"), F.max("raw_length").alias("max_raw"),
        F.min(length).alias("min_truth"), F.max(length).alias("max_truth"),
    )
    both = groups.join(per, "barcode", "left").join(own, "barcode", "left")
    names = ("candidates", "usable", "selected", "min_raw", "max_raw", "min_truth", "max_truth")
    return both.select("barcode", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def topk_per_barcode(rows: DataFrame, k: int) -> DataFrame:
    best = [F.desc(c) for c in ("acc", "coverage", "mean_quality", "read_length")]
    order = Window.partitionBy("barcode").orderBy(*best, "read_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stable_sample(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """A seeded sample of exactly k rows (all if there are fewer, none if k <= 0), whatever the partitioning."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("read_id").cast("string")))
    return rows.orderBy(draw, "read_id").limit(max(k, 0))


def stable_order(rows: DataFrame) -> DataFrame:
    """``rows`` by barcode and read: a plain distributed sort, to be written as it is."""
    return rows.orderBy("barcode", "read_id")


def missing_ids(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """n, first: how many ids of ``wanted`` are not in ``have``, and the smallest."""
    gone = wanted.select("read_id").join(have.select("read_id"), "read_id", "left_anti")
    return gone.agg(F.count("*").alias("n"), F.min("read_id").alias("first"))


def require_all_ids(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """``wanted`` if every id is in ``have``; otherwise an error with their number and the first."""
    missing = missing_ids(wanted, have).first()
    if missing["n"]:
        raise ValueError(f"{missing['n']} ids are missing, the first is {missing['first']}")
    return wanted


def unique_run_names(runs: DataFrame) -> DataFrame:
    """position, name: parent_file; with a model tag where that repeats; numbered where that still repeats."""
    part = lambda c, k: F.coalesce(F.try_element_at(F.split(F.col(c), "/"), F.lit(k)), F.lit(""))
    base = F.concat(part("checkpoint", -2), F.lit("_"), part("checkpoint", -1))
    tag = part("model", -1)
    for mark, by in (("@", "_at_"), (".", "_"), (" ", "_")):
        tag = F.replace(tag, F.lit(mark), F.lit(by))
    tag = F.concat(F.lit("_"), F.when(tag == "", "unknown_model").otherwise(tag))
    many = F.count("*").over(Window.partitionBy("base")) > 1
    rows = runs.withColumn("base", base).withColumn("tagged", F.concat("base", F.when(many, tag).otherwise("")))
    n = F.row_number().over(Window.partitionBy("tagged").orderBy("position"))
    number = F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise("")
    return rows.withColumn("n", n).select("position", F.concat("tagged", number).alias("name"))
