"""Exact quantiles without sorting a column or holding one in a task.

The value of a rank is found by refining ranges. A round cuts the open range of every wanted rank into ``buckets`` of equal width,
counts them (partial sums in the tasks that read the rows, so what is shuffled is buckets, not values) and keeps the bucket that
holds the rank, with its own smallest and largest value as the next range. Infinities and NaN are buckets of their own, NaN above
all. A rank is found when its bucket holds one value only, or few enough rows (``small``) to be numbered in order.

Every range loses at least its largest or smallest value a round, and each round divides its width by ``buckets``, so columns take two
or three rounds; values that are spread over many powers of ten take more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.storage import stored

INFINITE = float("inf")


def _long(rows: DataFrame, columns: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """by, column, x: one row per value that is not null."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]
    return rows.select(*by, F.explode(F.array(*parts)).alias("e")).select(*by, "e.column", "e.x").where("x is not null")


def _bucket(buckets: int) -> Column:
    """The bucket of x in the range from low to high, -1 for -inf, and the last two for inf and NaN; rises with x."""
    x, low, high = F.col("x"), F.col("low") / 2, F.col("high") / 2  # halves, so that the width is finite
    place = F.floor((x / 2 - low) / (high - low) * buckets)
    place = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), place))
    inner = F.when(x <= F.col("low"), 0).when(x >= F.col("high"), buckets - 1).otherwise(place)
    return F.when(F.isnan(x), buckets + 1).when(x == INFINITE, buckets).when(x == -INFINITE, -1).otherwise(inner).cast("int").alias("bucket")


def values_at(rows: DataFrame, columns: tuple[str, ...], probabilities: tuple[float, ...], *by: str, buckets: int = 2048, small: int = 32_768) -> DataFrame:
    """by, column, p, n, lower, upper, part: the values around each probability's place among the n values that are not null.

    ``rows`` are read once a round and twice besides, so they should be a written table. Null values don't count; a group or column
    without values has no row.
    """
    long, key = _long(rows, columns, by), [*by, "column"]
    if rows.count() <= small:  # no column has more: its values are numbered at once, which is what the rounds below end with
        own = Window.partitionBy(*key)
        ranked = long.withColumn("i", F.row_number().over(own.orderBy("x")) - 1).withColumn("n", F.count("*").over(own))
        ranked = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        ranked = ranked.withColumn("at", F.col("p") * (F.col("n") - 1)).where((F.col("i") == F.floor("at")) | (F.col("i") == F.ceil("at")))
        return _around(ranked, key, "x", "i")
    finite = ~F.isnan("x") & (F.abs("x") < INFINITE)
    ends = F.min(F.when(finite, F.col("x"))).alias("low"), F.max(F.when(finite, F.col("x"))).alias("high")
    ranges = long.groupBy(*key).agg(F.count("*").alias("n"), *ends).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    at = F.col("p") * (F.col("n") - 1)
    ranks = F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank")
    # a range is open until its rank is found; a first one holds all rows, also those beyond its finite ends
    first = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("low", "high")]
    wanted = stored(ranges.select(*key, "p", "n", at.alias("at"), ranks, *first), "ranks")
    open_ = wanted.select(*key, "low", "high", "rank", F.col("rank").alias("left"), F.col("n").alias("rows"), F.lit(True).alias("whole")).distinct()
    inside = F.col("whole") | (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
    few, found = F.col("rows") <= small, None
    while True:
        n = open_.agg(F.count_if(few).alias("few"), F.count_if(~few).alias("many")).first()
        if n["few"] or found is None:
            order = Window.partitionBy(*key, "rank").orderBy("x")  # at most `small` rows
            held = long.join(open_.where(few), key).where(inside).withColumn("i", F.row_number().over(order) - 1).where("i = left")
            held = held.select(*key, "rank", F.col("x").alias("value"))
            found = held if found is None else found.union(held)
        if not n["many"]:
            break
        held = long.join(open_.where(~few), key).where(inside).groupBy(*key, "rank", "left", _bucket(buckets))
        held = held.agg(F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = Window.partitionBy(*key, "rank").orderBy("bucket")  # one row a bucket
        held = held.withColumn("upto", F.sum("rows").over(upto))
        held = held.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("rows") <= F.col("left")))
        left = (F.col("left") - F.col("upto") + F.col("rows")).alias("left")
        held = stored(held.select(*key, "low", "high", "rank", left, "rows", F.lit(False).alias("whole")), "open")
        same = F.col("low").eqNullSafe(F.col("high"))
        found, open_ = found.union(held.where(same).select(*key, "rank", F.col("low").alias("value"))), held.where(~same)
    return _around(wanted.select(*key, "p", "n", "at", "rank").join(found, [*key, "rank"]), key, "value", "rank")


def _around(rows: DataFrame, key: list[str], value: str, rank: str) -> DataFrame:
    """The values of the ranks on both sides of each place ``at``, and how far it lies between them."""
    both = rows.groupBy(*key, "p", "n", "at").agg(F.min_by(value, rank).alias("lower"), F.max_by(value, rank).alias("upper"))
    return both.select(*key, "p", "n", "lower", "upper", (F.col("at") - F.floor("at")).alias("part"))


def quantiles(rows: DataFrame, columns: tuple[str, ...], probabilities: tuple[float, ...], *by: str, **options) -> DataFrame:
    """by, column, p, value: linear between the two values around the place p * (n - 1)."""
    around = values_at(rows, columns, probabilities, *by, **options)
    between = F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")
    exact = (F.col("part") == 0) | (F.col("lower") == F.col("upper"))
    return around.select(*by, "column", "p", F.when(exact, F.col("lower")).otherwise(between).alias("value"))
