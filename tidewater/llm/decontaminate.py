"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``span`` consecutive words of an item (all of them, if an item has fewer). Both sides keep, in every run
of ``span - gram + 1`` consecutive ``gram``-word hashes, the leftmost smallest one; a run of ``span`` shared words
holds the same hashes on both sides, so it keeps the same fingerprint at the same place, whatever stands around it.
Fingerprints are joined, and each hit is extended: the words around it on both sides are compared, window by window.

Fingerprints are joined bare, without words; the texts that hold a shared one, few in a clean corpus, are read again and only
their hits get the words around them. Items shorter than ``span`` are looked up whole, one pass per distinct length.

Defined cases: null or empty text has no words and is never hit; items without words have no window; a null item_id
counts as an item but not in items_sha256; rows that repeat get each their own result; an empty benchmark or
documents table gives no hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import letter_words, materialise

#: Fingerprints that are broadcast (under 200 bytes each with the words around); a larger benchmark is shuffled.
BROADCAST_PRINTS = 250_000
#: Keys of documents with a shared fingerprint (16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def grams(words: Column, size: int) -> Column:
    """Hash of every ``size`` consecutive words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    if size == 1:
        return hashes
    # the words' hashes are bound once by a one-element array, not worked out again for every place
    bound = F.transform(F.array(hashes), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))
    return F.when(F.size(words) >= size, F.element_at(bound, 1))


def prints(words: Column, gram: int, span: int) -> Column:
    """Winnowed fingerprints as structs: print, at (0-based), near (up to span - gram words before to span after)."""
    run = span - gram + 1

    def choose(g: Column) -> Column:
        def smallest(i: Column) -> Column:
            some = F.slice(g, i + 1, run)
            return (i + F.array_position(some, F.array_min(some)) - 1).cast("int")

        at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - run), smallest))
        return F.transform(at, lambda p: F.struct(F.get(g, p).alias("print"), p.alias("at")))

    picked = F.transform(F.array(grams(words, gram)), choose)
    return F.when(F.size(words) >= span, F.element_at(picked, 1))


def around(words: Column, at: Column, span: int, gram: int) -> Column:
    """The words from span - gram before ``at`` to span after it."""
    first = F.greatest(at - (span - gram), F.lit(0))
    return F.slice(words, first + 1, (at - first) + span)


def _bare(rows: DataFrame, key: str, gram: int, span: int) -> DataFrame:
    """One row per fingerprint: key, print, at."""
    return rows.select(key, F.explode(prints(F.col("words"), gram, span)).alias("p")).select(key, "p.print", "p.at")


def _few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, to be broadcast if they are at most ``most``."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def hits(docs: DataFrame, items: DataFrame, gram: int, span: int) -> DataFrame:
    """key, start, length, item_id of every window of ``items(item_id, words)`` in ``docs(key, words)``."""
    long = items.where(F.size("words") >= span)
    near = lambda: around(F.col("words"), F.col("at"), span, gram)
    listed = long.select("item_id", "words", F.explode(prints(F.col("words"), gram, span)).alias("p"))
    listed = listed.select("item_id", "p.print", F.col("p.at").alias("at"), "words")
    bench = listed.select("item_id", "print", F.col("at").alias("item_at"), near().alias("item_near")).distinct()
    bench = materialise(bench, "bench")
    met = _bare(docs, "key", gram, span).join(_few(bench.select("print").distinct(), BROADCAST_PRINTS), "print")
    met = materialise(met, "met")
    again = docs.join(_few(met.select("key").distinct(), BROADCAST_KEYS), "key", "left_semi")
    left = again.dropDuplicates(["key"]).join(met.distinct(), "key").select("key", "print", "at", near().alias("near"))
    joined = left.join(_few(bench, BROADCAST_PRINTS), "print")
    # windows that hold the fingerprint: it is `shift` words into the window
    lead, item_lead = (F.least(F.col(c), F.lit(span - gram)) for c in ("at", "item_at"))
    window = lambda near, lead, k: F.slice(near, lead - k + 1, F.lit(span))

    def shifted(k: int) -> Column:
        own, other = window(F.col("near"), lead, k), window(F.col("item_near"), item_lead, k)
        return F.when((lead >= k) & (item_lead >= k), F.when((F.size(own) == span) & (own == other), F.col("at") - k))

    starts = F.explode(F.array_compact(F.array(*[shifted(k) for k in range(span - gram + 1)])))
    found = joined.select("key", "item_id", starts.alias("start")).withColumn("length", F.lit(span))
    short = items.where((F.size("words") > 0) & (F.size("words") < span))
    for length in sorted(r[0] for r in short.select(F.size("words")).distinct().collect()):  # at most span - 1 lengths
        print_ = F.element_at(grams(F.col("words"), length), 1).alias("print")
        whole = short.where(F.size("words") == length).select("item_id", F.col("words").alias("item_words"), print_)
        same = _every(docs, length).join(_few(whole, BROADCAST_PRINTS), "print").where("near = item_words")
        found = found.unionByName(same.select("key", "item_id", "start", F.lit(length).alias("length")))
    return found.distinct()


def _every(docs: DataFrame, length: int) -> DataFrame:
    """Every run of ``length`` words: key, start, print, near."""
    near = lambda i: F.slice(F.col("words"), i + 1, F.lit(length)).alias("near")
    g = F.transform(grams(F.col("words"), length), lambda h, i: F.struct(i.alias("start"), h.alias("print"), near(i)))
    return docs.select("key", F.explode(g).alias("p")).select("key", "p.*")


def contamination(
    docs: DataFrame, benchmark: DataFrame, gram: int = 5, span: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), spans, contaminated."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))  # equal rows share their hits
    words = letter_words(F.col("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), letter_words(F.col(item_text)).alias("words"))
    found = hits(docs.select(key.alias("key"), words.alias("words")).where(F.size("words") > 0), items, gram, span)
    spans = found.groupBy("key").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"),
        F.count_distinct(F.coalesce("item_id", F.lit("\0"))).alias("n_items"),
    )
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    spans = spans.select(
        F.col("key.doc_id").alias("found_id"), F.col("key.h").alias("found_h"), "items", "n_items",
        F.array_sort("spans").alias("spans"), F.size(F.array_distinct(inside)).cast("long").alias("n_hit"),
    )
    rows = docs.select("doc_id", F.size(words).cast("long").alias("n_words"), key["h"].alias("h"))
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("h") == F.col("found_h")), "left")
    n_hit, n_items = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items"))
    held = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return out.select("doc_id", "n_words", n_hit, n_items, held, "spans", F.col("n_hit").isNotNull().alias("contaminated"), "h")
