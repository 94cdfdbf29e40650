"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a fixed and of a learned lexicon, the same after undoing character substitutions, second
person words near lexicon words, capitals, punctuation, symbol and digit rates, obfuscated words, and length. All are
built-in expressions; the trees score on the JVM as well.

Training rows are at most ``most_rows`` labelled ids, a bounded sample by id hash, each with one text. They are dealt by id into three parts:
one learns the lexicon, one the trees, one the calibration, so no part judges what it was learned from.

Defined cases: null or empty text has features 0 and is scored; labels that are null, not 0 or 1, or contradict each other
count by their largest value; an id with several texts is learned by the smallest of them; with one class or none to train on every score is that share; rows that repeat are scored
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, letter_words, materialise

#: General insults, and second person words of the corpus languages.
INSULTS = (
    "idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "garbage", "jerk",
    "ugly", "hate", "imbecile", "freak", "liar", "coward",
)
SECOND = ("you", "your", "youre", "yourself", "du", "dich", "dein", "tu", "toi", "vous", "votre", "usted", "ti")
#: Characters that stand in for letters, and the letters.
STAND_IN, LETTER = "013457@$!", "oieastasi"


def features(text: Column, learned: list[str]) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words, plain = letter_words(text), letter_words(F.translate(text, STAND_IN, LETTER))
    length, n = F.greatest(F.length(text), F.lit(1)).cast("double"), F.greatest(F.size(words), F.lit(1)).cast("double")
    fixed, own = F.array(*map(F.lit, INSULTS)), F.array(*map(F.lit, learned or ["\0"]))
    lost = lambda marks: (F.length(text) - F.length(F.translate(text, marks, ""))) / length
    many = lambda w: F.coalesce(F.size(F.array_intersect(w, F.array_union(fixed, own))), F.lit(0))
    second, insult, between = "|".join(SECOND), "|".join(INSULTS), r"(?:\W+\w+){0,3}?\W+"
    near = rf"(?i)\b(?:{second})\b{between}(?:{insult})\b|\b(?:{insult})\b{between}(?:{second})\b"
    hits = F.size(F.array_intersect(words, fixed))
    return {
        "fixed": hits / n, "fixed_kinds": hits.cast("double"),
        "learned": F.size(F.array_intersect(words, own)) / n, "learned_kinds": F.size(F.array_intersect(words, own)).cast("double"),
        "hidden": (many(plain) - many(words)).cast("double"), "second": F.when(hits > 0, F.regexp_count(text, F.lit(near))).otherwise(0).cast("double"),
        "capitals": lost(UPPER) / (lost(UPPER + LOWER) + 1e-9), "exclaim": lost("!"), "question": lost("?"), "punctuation": lost(".,;:'\"()-"), "symbols": lost("#$%&*@^~"),
        "digits": lost("0123456789"), "obfuscated": F.regexp_count(text, F.lit(r"[A-Za-z][0-9@$!*]+[A-Za-z]")) / n, "words": F.log1p(n),
    }


def lexicon(rows: DataFrame, size: int) -> list[str]:
    """The ``size`` words of ``rows(text, label)`` most typical of label 1, by smoothed log-odds over documents."""
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not total["n"] or not total["toxic"] or total["toxic"] == total["n"]:
        return []
    toxic, clean = float(total["toxic"]), float(total["n"] - total["toxic"])
    own = F.explode(F.array_distinct(letter_words(F.col("text")))).alias("w")
    seen = rows.select("label", own).groupBy("w").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    weight = odds * F.sqrt(F.col("t").cast("double"))
    best = seen.where((F.col("t") >= max(3.0, 0.02 * toxic)) & (odds > 2)).orderBy(weight.desc(), "w").limit(size)
    return [r["w"] for r in best.select("w").collect()]


class Model:
    def __init__(self, share: float, words: list[str], trees=None, curve=None):
        self.share, self.words, self.trees, self.curve = share, words, trees, curve

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with a column score; the columns of ``docs`` are kept as they are."""
        if self.trees is None:
            return docs.select("*", F.lit(self.share).alias("score"))
        rows = _vectors(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), self.words)
        rows = self.trees.transform(rows).withColumn("p", vector_to_array("probability")[1])
        rows = self.curve.transform(rows.select("row", "p"))
        # the curve has flat steps; a hundredth of the trees' own score orders what lies on one step
        return rows.select("row.*", F.least(F.greatest(0.99 * F.col("calibrated") + 0.01 * F.col("p"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def _vectors(rows: DataFrame, words: list[str]) -> DataFrame:
    parts = features(F.col("text"), words)
    rows = rows.select([c for c in rows.columns if c != "text"] + [v.alias(f"f_{k}") for k, v in parts.items()])
    return VectorAssembler(inputCols=[f"f_{k}" for k in parts], outputCol="features", handleInvalid="keep").transform(rows)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, lexicon_size: int = 60, trees: int = 25, depth: int = 4) -> Model:
    """Learn from the labelled rows that aren't held out; ``docs(doc_id, text)``, ``labels(doc_id, label)``."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # bounded by most_rows, so it may be broadcast; one text an id keeps the rows as few, however often an id repeats
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # six parts by id, in the order of ids, at every size, so that reruns agree
    rows = materialise(rows.withColumn("part", part).repartition(6, "doc_id").sortWithinPartitions("doc_id"), "labelled")
    words = lexicon(rows.where("part = 0"), lexicon_size)
    shares = rows.agg(F.avg("label"), *[F.count_distinct(F.when(F.col("part") == p, F.col("label"))) for p in (1, 3)]).first()
    if min(shares[1], shares[2]) < 2:
        return Model(float(shares[0] or 0.0), words)
    vectors = _vectors(rows, words).select("part", "label", "features").cache()
    trainer = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=3, seed=7, maxMemoryInMB=64)
    boosted = trainer.fit(vectors.where("part = 1"))
    judged = boosted.transform(vectors.where("part = 3")).select("label", vector_to_array("probability")[1].alias("p"))
    curve = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(judged)
    vectors.unpersist()
    return Model(float(shares[0]), words, boosted, curve)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.3, label_col: str = "toxic", **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels.select("doc_id", F.col(label_col).alias("label")), **options)
    return model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
