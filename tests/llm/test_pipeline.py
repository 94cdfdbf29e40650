"""Every stage of the pipeline against a plain version, each on what its predecessor kept."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline as p
from tidewater.llm.toxicity import toxicity


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, data, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), {}
    columns = sorted(docs.columns)
    for name, stage in p.STAGES:
        seen[name] = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "token_ids":
            assert sorted(docs.columns) == columns
    after = dict(zip(list(seen), [*list(seen.values())[1:], docs], strict=True))

    labels = spark.read.parquet(f"{data}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity(seen["toxicity"], labels).collect()}
    assert {d for d, _ in texts(after["toxicity"])} == {d for d, bad in scored.items() if not bad}

    near = brute.near(texts(seen["near_dedup"]), size=5)
    assert {d for d, _ in texts(after["near_dedup"])} == {d for d, v in near.items() if v[2]}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    hit = brute.contamination(texts(seen["decontamination"]), items)
    assert {d for d, _ in texts(after["decontamination"])} == {d for d, v in hit.items() if not v[4]}

    sources = {r.doc_id: r.source for r in seen["mixing"].collect()}
    size = {d: len(brute.re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in texts(seen["mixing"])}
    total, taken = Counter(), Counter()
    for d, n in size.items():
        total[sources[d]] += n
    copies = Counter(d for d, _ in texts(after["mixing"]))
    for d, n in copies.items():
        taken[sources[d]] += n * size[d]
    assert max(copies.values()) <= 2 and dict(texts(after["mixing"])).items() <= dict(texts(seen["mixing"])).items()
    for s, want in brute.targets(dict(total)).items():
        assert abs(taken[s] - want) <= max(n for d, n in size.items() if sources[d] == s)

    t, want, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for d, text in sorted(texts(seen["token_ids"]), key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(want)

    assert sorted(map(tuple, p.run(spark, data).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark, data):
    """Null, empty and very long texts, null ids and sources, repeated rows and ids, ties, clashing columns, empty tables."""
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("text is not null").first().text
    long = " ".join(f"word{k}" for k in range(60_000))
    near = " ".join(f"same{k}" for k in range(100))
    rows = [(1, None), (2, ""), (3, long), (None, "no id here"), (None, "no id here"), (4, near), (5, near + " end"), (6, near), (7, f"a {item} b"), (None, f"c {item} d"), (7, "another text of seven"), (8, "x y"), (8, "x y")]
    docs = spark.createDataFrame(
        [(d, t, "en", "src" if k % 2 else None, 0, 0.5, "h", 1, [1]) for k, (d, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, score double, h string, copies int, words array<int>",
    )
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    stage = dict(p.STAGES)
    kept = {n: stage[n](spark, docs, data) for n in ("toxicity", "near_dedup", "decontamination", "mixing")}
    assert all(df.columns == p.COLUMNS for df in kept.values())
    every = key(docs)
    assert key(kept["toxicity"]) <= every
    assert every - key(kept["near_dedup"]) == Counter([(5, near + " end"), (6, near)])
    assert every - key(kept["decontamination"]) == Counter([(7, f"a {item} b"), (None, f"c {item} d")])
    mixed = key(kept["mixing"])
    assert all(n <= 2 * every[k] for k, n in mixed.items())
    tokens = stage["token_ids"](spark, docs, data).collect()
    assert sorted(str(r.doc_id) for r in tokens) == sorted(str(d) for d, _ in rows)
    assert [r.n_tokens for r in tokens if r.doc_id in (1, 2)] == [1, 1]
    none = docs.where("false")
    for _, f in p.STAGES:
        assert f(spark, none, data).count() == 0
