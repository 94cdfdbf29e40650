"""License scans by a positional rare-token index, in DataFrame operations only.

Templates are word sequences with a label and mandatory key phrases. The index has a posting for each place of a template: its
word, as a number, and the place. A document is reduced in one pass over its text to the places of the licence words in it,
usually a few in a hundred words; these lists are written once, and all that follows reads them.

Document frequencies of the licence words are counted over all documents. In each document the words that it holds itself are
ranked by them, and a template is looked up by the rarest: their places propose starts (place in the document minus place
in the template; below 0 if the document begins inside the template). So many are looked up that no start can agree
without one of them. A start stands if the other postings agree by relative position: all of them for a phrase, at least
``cover`` of them for a longer template, which must hold its key phrase as well.

Everything about one document happens in its row, so a frequent word or line costs no shuffle and has no hot key; only
the frequencies of the licence words are aggregated and sent to the driver, a table as small as the templates.

Defined cases: null or empty text has no words, no places, null first and last, empty labels and score 0; rows that repeat
get each their own result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import letter_words, materialise

#: Fixed values of the contract: phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening words of well-known licence notices, their label and one phrase that must be there.
TEMPLATES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "mit", "permission is hereby granted",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license",
        "boost", "person or organization",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "apache", "apache license",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        "bsd", "redistribution and use in source",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "gpl", "gnu general public license",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "agpl", "gnu affero general public license",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "lgpl", "gnu lesser general public license",
    ),
    ("this work is licensed under the gnu general public license", "gpl-notice", "licensed under"),
    ("this work is licensed under a creative commons attribution license", "cc", "creative commons"),
    (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "cc0", "waived all copyright",
    ),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla public license"),
    (
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "epl", "eclipse public license",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "isc", "with or without fee",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software",
        "zlib", "express or implied warranty",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense", "public domain"),
)

STRUCT = "array<struct<c:int,i:int>>"


def places(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, at (number and place of every licence word) and own (the distinct numbers)."""
    known = F.array(*map(F.lit, vocabulary))
    posting = lambda w, i: F.struct(F.array_position(known, w).cast("int").alias("c"), i.alias("i"))
    at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), posting(w, i)))).cast(STRUCT)
    rows = docs.select(F.col(id_col).alias("doc_id"), letter_words(F.col(text_col)).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), at.alias("at"))
    return rows.withColumn("own", F.array_distinct(F.transform("at", lambda x: x["c"])))


def frequencies(rows: DataFrame) -> tuple[dict[int, int], int]:
    """In how many of all documents each licence word occurs, and the number of documents."""
    counts = rows.select(F.explode(F.concat("own", F.array(F.lit(0)))).alias("c")).groupBy("c").count().collect()
    found = {r["c"]: r["count"] for r in counts}  # no more rows than the vocabulary
    return found, found.get(0, 0)


def _starts_by(at: Column, c: Column, k: Column) -> Column:
    """Where a template would start, by every place of word ``c``, which stands at place ``k`` of it."""
    return F.transform(F.filter(at, lambda x: x["c"] == c), lambda x: x["i"] - k)


def _phrase(codes: list[int], idf: dict[int, float]) -> Column:
    """Starts at which all words of a phrase stand, rarest first."""
    at, own = F.col("at"), F.col("own")
    ranked = sorted(enumerate(codes), key=lambda x: (-idf[x[1]], x[1], x[0]))
    starts = reduce(F.array_intersect, [_starts_by(at, F.lit(c), F.lit(k)) for k, c in ranked])
    return F.when(F.array_contains(own, ranked[0][1]), starts).otherwise(F.array().cast("array<int>"))


def _best(codes: list[int], idf: dict[int, float], least: int) -> Column:
    """The most words of a template that agree at one start, if at least ``least`` do; else null."""
    at, own = F.col("at"), F.col("own")
    ranked = sorted(enumerate(codes), key=lambda x: (-idf[x[1]], x[1], x[0]))
    posted = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).alias("k")) for k, c in ranked])
    held = F.filter(posted, lambda p: F.array_contains(own, p["c"]))
    every = lambda some: F.flatten(F.transform(some, lambda p: _starts_by(at, p["c"], p["k"])))

    def agreeing(held: Column) -> Column:
        # of n places whose words the document holds `least` agree, so any n - least + 1 of them hold one that agrees
        asked = F.array_distinct(every(F.slice(held, F.lit(1), F.size(held) - least + 1)))
        # each place of a held word speaks for one start: a start agrees in as many words as speak for it
        return F.transform(F.array(every(held)), lambda all_: F.array_max(F.transform(asked, lambda s: F.size(F.filter(all_, lambda x: x == s)))))[0]

    found = F.transform(F.array(held), lambda h: F.when(F.size(h) >= least, agreeing(h)))[0]
    return F.when(found >= least, found)


def scan(
    docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple = TEMPLATES, cover: float = 0.8,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, places (starts of base phrases), base_labels and labels (arrays), score."""
    phrases = PHRASES if phrases is None else phrases
    vocabulary = sorted({w for t in (*phrases, *(t[0] for t in templates), *(t[2] for t in templates)) for w in t.split()})
    code = {w: k + 1 for k, w in enumerate(vocabulary)}
    rows = materialise(places(docs, vocabulary, id_col, text_col), "places")
    seen, total = frequencies(rows)
    idf = {c: math.log((1 + total) / (1 + seen.get(c, 0))) for c in code.values()}
    codes = lambda text: [code[w] for w in text.split()]
    base = {f"p{k}": (_phrase(codes(p), idf), label) for k, (p, label) in enumerate(phrases.items())}
    own = {}
    for k, (text, label, phrase) in enumerate(templates):
        t = codes(text)
        best = F.when(F.size(_phrase(codes(phrase), idf)) > 0, _best(t, idf, math.ceil(cover * len(t))))
        own[f"t{k}"] = F.coalesce(best / F.lit(float(len(t))), F.lit(0.0)), label
    rows = rows.select("doc_id", "n_words", *[v.alias(n) for n, (v, _) in (base | own).items()])
    named = lambda some, hit: F.array_compact(F.array(*[F.when(hit(n), F.lit(label)) for n, (_, label) in some.items()]))
    found = F.array_sort(F.flatten(F.array(*base)))
    rows = rows.withColumn("places", found).withColumn("base_labels", F.array_sort(F.array_distinct(named(base, lambda n: F.size(n) > 0))))
    labels = F.array_sort(F.array_union("base_labels", named(own, lambda n: F.col(n) > 0)))
    certain = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    score = F.greatest(certain, F.lit(0.0), *own)
    return rows.select("doc_id", "n_words", "places", "base_labels", labels.alias("labels"), score.alias("score"))
