"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Sources in code point order (null last) get ``weights`` in turn and share ``share`` times the corpus; a target stops at
``most`` times its source and the excess goes to the others by weight, until none is above. A source is first taken
whole as often as its target holds it; the rest of the target is drawn without replacement by the exponential
keys -ln(u) / w, u from a hash of the document and w its quality weight: ascending keys, prefix-summed to the budget.

A source ends at a cut: the last document in the order of the keys that the budget takes, so all documents up to it are taken
and none beyond. The cut is found by sums: over coarse buckets of the key, then over fine ones inside the bucket where the
budget ends, then over the few documents of that fine bucket. Every sum is aggregated partially where the rows are; no window
sees more than BUCKETS rows or one fine bucket of a source, about one in BUCKETS * BUCKETS of its documents. The cuts, one
row per source, are broadcast if there are at most BROADCAST_SOURCES, so the documents themselves are never shuffled.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source of its own; a null id is hashed by
its text; rows that repeat id and text are one unit, taken together or not at all; an empty table gives no rows, one without
words targets of 0; columns other than the four read are passed over, those in ``keep`` are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, space_words

BUCKETS = 4096
#: Cuts (under 200 bytes each) that are broadcast; more sources are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1.1: how much of the text is letters and spaces rather than marks and digits."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    return F.round(F.lit(1.1) - marks / F.greatest(F.length(text), F.lit(1)), 3)


def unit(*columns: Column) -> Column:
    """A reproducible uniform number above 0 and below 1."""
    digits = F.substring(F.md5(F.concat_ws("\x1f", *columns)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target from ``sizes(source, size)``; one row per source goes through these windows."""
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    everyone = Window.partitionBy()
    place = (F.row_number().over(order) - 1) % len(weights)
    rows = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
    # Filling in order of cap / weight settles all sources at once: those that stop do so before any that doesn't.
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everyone))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.encode("source", "UTF-8"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("heavy", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("spent")) / F.col("heavy"))  # words a unit of weight
    rows = rows.withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    rows = rows.withColumn("rate", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everyone)["level"])
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("rate") * F.col("w"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def named(source: Column) -> Column:
    """A name for each source, null included, that joins match."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, name, size, key, tie and code (where the key lies, in BUCKETS * BUCKETS steps) of every document."""
    text = F.col(text_col)
    ident = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), named(F.col(source_col)).alias("name"),
        F.size(space_words(text)).cast("long").alias("size"), (-F.log(unit(ident, F.lit("mix"))) / quality(text)).alias("key"),
        F.xxhash64(text).alias("tie"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)],
    )
    return rows.withColumn("code", F.floor(F.lit(float(BUCKETS * BUCKETS)) * (1 - F.exp(-F.col("key")))).cast("long"))


def _ending(sums: DataFrame, goals: DataFrame, order: tuple[str, ...], *carry: str) -> DataFrame:
    """The row of each name in ``sums(name, *order, size)`` within which ``goals(name, budget, spent)`` ends, with what is spent before."""
    along = Window.partitionBy("name").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.join(goals, "name").withColumn("before", F.col("spent") + F.coalesce(F.sum("size").over(along), F.lit(0)))
    return rows.where("before <= budget and before + size > budget").select("name", *carry, "budget", F.col("before").alias("spent"))


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """name, cut (struct of key, doc_id and tie) of the sources of ``goals(name, budget)`` whose budget ends inside them.

    ``rows`` are measured documents. A document is taken if the budget reaches its middle.
    """
    coarse = F.floor(F.col("code") / BUCKETS).alias("bucket")
    sums = rows.groupBy("name", coarse).agg(F.sum("size").alias("size"))
    ends = materialise(_ending(sums, goals.withColumn("spent", F.lit(0).cast("long")), ("bucket",), "bucket"), "ends")
    some = rows.withColumn("bucket", coarse).join(_small(ends.select("name", "bucket")), ["name", "bucket"])
    sums = some.groupBy("name", "code").agg(F.sum("size").alias("size"))
    fine = materialise(_ending(sums, ends.drop("bucket"), ("code",), "code"), "fine")
    units = rows.join(_small(fine.select("name", "code")), ["name", "code"]).groupBy("name", "key", "doc_id", "tie").agg(F.sum("size").alias("size"))
    order = ("key", "doc_id", "tie")
    along = Window.partitionBy("name").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    units = units.join(fine.drop("code"), "name")
    units = units.withColumn("before", F.col("spent") + F.coalesce(F.sum("size").over(along), F.lit(0)))
    # `below`: what lies in earlier fine buckets is taken whole, even if nothing of this one is
    taken = F.max(F.when(F.col("before") + F.col("size") / 2 <= F.col("budget"), F.struct(*order)))
    last = units.groupBy("name").agg(taken.alias("cut"))
    return fine.select("name", "code").join(last, "name", "left").select("name", F.col("code").alias("end"), "cut")


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, one per source, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rows


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document with size, source_size, target, copies (how often the mix takes it) and taken (words)."""
    rows = materialise(measured(docs, id_col, text_col, source_col), "measured")  # some fifty bytes a document
    goal = targets(rows.groupBy("source").agg(F.sum("size").cast("long").alias("size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goal = goal.select(named(F.col("source")).alias("name"), "source_size", "target", epochs.alias("epochs"))
    goal = materialise(goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "goal")
    plan = materialise(goal.join(cuts(rows, goal.select("name", "budget")), "name", "left"), "plan")
    rows = measured(docs, id_col, text_col, source_col, keep) if keep else rows
    rows = rows.join(_small(plan), "name")
    inside = (F.col("code") == F.col("end")) & (F.struct("key", "doc_id", "tie") <= F.col("cut"))
    extra = F.coalesce((F.col("code") < F.col("end")) | inside, F.lit(False)).cast("int")
    rows = rows.withColumn("copies", F.col("epochs") + extra)
    kept = [F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)]
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken, "copies", *kept)
