"""Secret scans, in DataFrame operations only: known forms, and tokens that look random to character Markov models.

Two first-order models over ASCII characters are counted: one from labelled random strings (``drawn`` digests in three alphabets,
which no form of secret has had a part in, and the values that the known forms find), one from labelled ordinary
identifiers: long words of the texts, and constants, paths and names in mixed case that ``composed`` makes of their words. A
transition not seen often falls back on how often its second character is seen, so that a character that no identifier
holds counts, however few there are. A candidate token, 20 or more token characters in a row, is a secret if the
log-likelihood ratio of its transitions, in nats a character, reaches a threshold. That is set on a fifth of the labelled
tokens, by hash, that the counts leave out: the middle of the values with the least misses + FALSE * false alarms, in shares.
The training sample is every document whose id hash falls below ``sample`` documents' share, a bounded sample that is as large
for any number of documents; the known forms and the scan itself read every text whole.

Positions are code points. A pattern's matches and the gaps between them come from the same leftmost search, so running
lengths give every start without a loop over characters.

Defined cases: null or empty text has no spans; rows that repeat get each their own result; with nothing to train
on only known forms are found, with nothing held out of one of the labels the threshold is LEAST_RATIO; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.signal import once

#: Fixed values of the contract: kind and Java pattern; a pattern may match what LEAST then drops.
KINDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
LEAST_VALUE = 12
SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"
#: What the models judge: every long run of token characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Steps of the id hash, far more than documents, so that the sample isn't empty however many there are.
STEPS = 1 << 52
#: Tokens whose hash is 0 of PARTS set the threshold and are not counted; it is sought in steps of 1 / GRID up to RANGE either way.
PARTS, GRID, RANGE = 5, 20, 10
#: What a share of false alarms weighs against the same share of misses; ordinary tokens are far more than secrets.
FALSE = 10
LEAST_RATIO = 0.5
#: What a count of transitions weighs that single characters stand for.
BACK = 8.0
WORD = r"[A-Za-z]{3,}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{7,}"


def spans(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Structs start, end, kind, value of the leftmost non-overlapping matches; null where none."""
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, value_group))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    first = F.struct(F.lit(0).alias("end"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["end"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))
        return F.struct(end.alias("end"), F.concat(acc["found"], F.array(one)).alias("found"))

    found = F.aggregate(zipped, first, step)["found"]
    if least:
        found = F.filter(found, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), found)


def known(text: Column) -> Column:
    """All spans of the known forms, by kind as listed."""
    none = F.array().cast(SPANS)
    parts = [spans(text, p, k, 1 if k == "assign" else 0, LEAST_VALUE if k == "assign" else 0) for k, p in KINDS.items()]
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _pairs(token: Column) -> Column:
    """Transitions of a token, each as one number: 128 * code + next code. The token is cut into characters once, whatever its length."""
    codes = F.transform(F.split(token, ""), F.ascii)
    but_one = lambda c, at: F.slice(c, F.lit(at), F.greatest(F.size(c) - 1, F.lit(0)))
    return once(codes, lambda c: F.zip_with(but_one(c, 1), but_one(c, 2), lambda x, y: x * 128 + y))


def drawn(spark: SparkSession, n: int) -> DataFrame:
    """``n`` random strings (token) in base 64, hexadecimal digits, and capitals and digits: digests of 0 to n - 1."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    capitals = F.translate(F.upper(F.base64(F.unhex(digest))), "+/=", "79")
    token = F.when(F.col("id") % 3 == 0, F.base64(F.unhex(digest))).when(F.col("id") % 3 == 1, digest).otherwise(capitals)
    return spark.range(n).select(token.alias("token"))


def below(sample: int, total: int) -> int:
    """The hash, of STEPS, below which about ``sample`` of ``total`` documents lie; STEPS for all of them."""
    return min(STEPS, sample * STEPS // max(total, 1))


class Model(NamedTuple):
    """Log-likelihood ratio of every transition, random against ordinary, and the threshold of a token's mean."""

    table: list[float]
    least: float


def composed(text: Column) -> Column:
    """Ordinary identifiers of four words in a row: constants, paths, mixed case, marks between, a number at the end, in turn."""

    def written(words: Column) -> Column:
        def form(i: Column) -> Column:
            four = F.slice(words, i * 4 + 1, F.lit(4))
            low = F.transform(four, F.lower)
            numbered = F.concat(F.array_join(low, "_"), F.lit("_"), (i % 100).cast("string"))
            constant, mixed = F.array_join(F.transform(four, F.upper), "_"), F.array_join(F.transform(four, F.initcap), "")
            forms = (constant, F.array_join(low, "/"), mixed, F.array_join(low, "-"), numbered)
            return F.element_at(F.array(*forms), (i % len(forms)).cast("int") + 1)

        groups = F.floor(F.size(words) / 4).cast("int")
        return F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), form))

    return once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), written)


def labelled(docs: DataFrame, sample: int, random_rows: int) -> DataFrame:
    """label (1 random, 0 ordinary) and token, of two characters or more, from a sample of ``docs(doc_id, text)``."""
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < below(sample, docs.count()))
    tokens = part.select(F.explode(known(F.col("text"))).alias("s")).select("s.value").union(drawn(docs.sparkSession, random_rows))
    own = F.filter(
        F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)), lambda t: ~t.rlike(KINDS["hex"] + "|" + KINDS["access"])
    )
    made = F.coalesce(composed(F.col("text")), F.array().cast("array<string>"))
    plain = part.select(F.explode(F.concat(own, made)).alias("token"))
    both = tokens.toDF("token").withColumn("label", F.lit(1)).unionByName(plain.withColumn("label", F.lit(0)))
    return both.where(F.length("token") > 1).select("label", "token")


def train(docs: DataFrame, sample: int, random_rows: int) -> Model | None:
    """The model of ``docs(doc_id, text)``; None without counted tokens of both labels.

    Counts are aggregated on the executors; at most 2 * 128 * 128 rows of transitions and 4 * GRID * RANGE + 2 of ratios reach the driver.
    """
    rows = labelled(docs, sample, random_rows)
    held = F.crc32("token") % PARTS == 0
    pairs = rows.where(~held).select("label", F.explode(_pairs(F.col("token"))).alias("pair"))
    table = {(r["label"], r["pair"]): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}
    if len({label for label, _ in table}) < 2:
        return None
    ascii_ = range(128)
    first = {(k, a): sum(table.get((k, a * 128 + b), 0) for b in ascii_) for k in (0, 1) for a in ascii_}
    second = {(k, b): sum(table.get((k, a * 128 + b), 0) for a in ascii_) for k in (0, 1) for b in ascii_}
    total = {k: sum(first[k, a] for a in ascii_) for k in (0, 1)}

    def log(k: int, a: int, b: int) -> float:
        alone = (second[k, b] + 0.5) / (total[k] + 64)
        return math.log((table.get((k, a * 128 + b), 0) + BACK * alone) / (first[k, a] + BACK))

    ratios = [round(log(1, a, b) - log(0, a, b), 4) for a in ascii_ for b in ascii_]
    step = F.floor(ratio(F.col("token"), ratios) * GRID)
    step = F.least(F.greatest(step, F.lit(-RANGE * GRID)), F.lit(RANGE * GRID)).alias("step")
    judged = rows.where(held & F.col("token").rlike("^" + CANDIDATE + "$")).groupBy("label", step).count()
    return Model(ratios, threshold([tuple(r) for r in judged.collect()]))


def threshold(counts: list[tuple[int, int, int]]) -> float:
    """The middle of the ratios with the least cost on ``counts`` (label, step, tokens); LEAST_RATIO without both labels."""
    total = {k: sum(n for label, _, n in counts if label == k) for k in (0, 1)}
    if not all(total.values()):
        return LEAST_RATIO
    cost = {}
    for t in range(-RANGE * GRID, RANGE * GRID + 2):
        missed = sum(n for k, step, n in counts if k == 1 and step < t)
        false = sum(n for k, step, n in counts if k == 0 and step >= t)
        cost[t] = missed * total[0] + FALSE * false * total[1]
    least = min(cost.values())
    best = [t for t, c in cost.items() if c == least]
    return best[len(best) // 2] / GRID


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    own = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(_pairs(token), F.lit(0.0), lambda acc, p: acc + F.coalesce(F.get(own, p), F.lit(0.0)))
    return total / (F.length(token) - 1)


def scan(
    docs: DataFrame, sample: int = 20_000, random_rows: int = 3000, least_ratio: float | None = None,
    id_col: str = "doc_id", text_col: str = "text", model: Model | None = None,
) -> DataFrame:
    """doc_id, base and spans: arrays of structs start, end, kind, value; ``spans`` adds the models' (kind markov), by ``least_ratio`` if it is given.

    A ``model`` of `train` may come from other documents; without one it is trained on these.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = model or train(rows, sample, random_rows)
    none = F.array().cast(SPANS)
    text = F.col("text")
    own = none
    if model:
        least = model.least if least_ratio is None else least_ratio
        own = F.coalesce(F.filter(spans(text, CANDIDATE, "markov"), lambda s: ratio(s["value"], model.table) >= least), none)
    rows = rows.select("doc_id", known(text).alias("base"), own.alias("own"))
    return rows.select("doc_id", "base", F.concat("base", "own").alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, comma-joined."""
    order = [*KINDS, "markov"]
    place = lambda s: F.array_position(F.array(*map(F.lit, order)), s["kind"]).alias("k")
    keyed = F.transform(found, lambda s: F.struct(s["start"], place(s), s["end"], s["kind"]))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(keyed), written), ",")
