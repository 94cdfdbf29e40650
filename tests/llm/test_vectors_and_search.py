"""op11 to op13 against plain versions, on hand-made rows and on whole small tables."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import embedding_dups as E
from tidewater.llm import hard_negatives as H
from tidewater.llm import neighbours as N
from tidewater.llm import ranked_search as R
from tidewater.llm import secrets as X

from brute import words

VECTORS = "vec_id long, embedding array<double>, label int, rank int, v string"


def finite(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def plain_links(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of every row, all pairs compared."""
    top, links = list(range(len(rows))), Counter()

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (_, v, x) in enumerate(rows):
        for b, (_, w, y) in enumerate(rows[:a]):
            if x is not None and x == y and finite(v) and finite(w) and any(v) and any(w) and len(v) == len(w):
                cos = sum(p * q for p, q in zip(v, w, strict=True)) / math.sqrt(sum(p * p for p in v)) / math.sqrt(sum(q * q for q in w))
                if cos >= threshold:
                    links[a] += 1
                    links[b] += 1
                    top[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r[0])
    least = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    return Counter((r[0], links[k], least[find(k)], r[0] == least[find(k)]) for k, r in enumerate(rows))


def clustered(rng, n, width=6):
    """Vectors in tight, loose and no groups, equal ones among them."""
    heads = rng.normal(size=(5, width))
    out = []
    for _ in range(n):
        kind = rng.integers(4)
        v = heads[rng.integers(5)] + rng.normal(size=width) * (0, 0.02, 0.3, 3)[kind]
        out.append((v * rng.choice([0.5, 1, 7])).tolist())
    return out


def test_links_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), v, int(rng.integers(2))) for k, v in enumerate(clustered(rng, 300))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = plain_links(rows)
    for options in ({}, {"block": 20, "centres": 4}, {"block": 7, "centres": 1}):
        assert Counter(map(tuple, E.similar(df, **options).collect())) == want, options


def test_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [1.0, None], [inf, 1.0], [1.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [1e200, 1e199], [1e-200, 1e-201], [1.0], [2.0, 0.0, 0.0]]
    rows = [(k, v, 1) for k, v in enumerate(odd)] + [(6, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [5.0, 1.0], 2), (40, [1.0, 0.0], None), (41, [1.0, 0.0], None)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS)
    assert Counter(map(tuple, E.similar(df).collect())) == Counter(
        {r: n for r, n in plain_links([(i, None if v is None or not finite(v) else [x / max(map(abs, v)) for x in v] if any(v) else v, y) for i, v, y in rows]).items()}
    )
    assert E.similar(df.where("false")).count() == 0


def test_a_large_group_is_not_expanded(spark):
    """3,000 near copies have 4.5 million links; no task returns more than a row for each."""
    rng = np.random.default_rng(5)
    near = (np.ones(16) + rng.normal(size=(3000, 16)) * 0.01).tolist()
    df = spark.createDataFrame([(k + 1, v, 0) for k, v in enumerate(near)] + [(0, [1.0] + [0.0] * 15, 0)], "vec_id long, embedding array<double>, label int")
    got = E.similar(df, block=500).groupBy("n_links", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1), (2999, 1, 3000)]


def test_tree_covers_and_halves():
    rng = np.random.default_rng(1)
    u = E.unit(np.array(clustered(rng, 400)))
    order, sizes, radii = E.grow(u)
    assert sorted(order.tolist()) == list(range(400))
    tree = E.read_tree([sizes[k] for k in order], [radii[k] for k in order])
    u = u[order]
    for node in range(len(tree.lo)):
        lo, hi = tree.lo[node], tree.hi[node]
        assert E.distance(u[lo:hi] @ u[lo]).max() <= tree.radius[node] + E.SLACK
        kids = tree.children[node]
        assert not kids or (kids[0] and tree.lo[kids[0]] == lo and [tree.hi[k] for k in kids] == [*(tree.lo[k] for k in kids[1:]), hi])
        if len(kids) > 1 and tree.radius[node] > E.SLACK:  # a net of the largest power of two below the radius
            level = 2.0 ** math.floor(math.log2(tree.radius[node] - 1e-12)) if tree.radius[node] > 0 else 0
            apart = E.distance(u[[tree.lo[k] for k in kids]] @ u[[tree.lo[k] for k in kids]].T)
            assert (apart[~np.eye(len(kids), dtype=bool)] > level - E.SLACK).all() and max(tree.radius[k] for k in kids) <= level + E.SLACK


def test_neighbours_of_several_lengths_and_norms(spark):
    """A query meets vectors of its own length, all of them if they are few; long vectors are found although few pivots are like them."""
    rng = np.random.default_rng(9)
    rows = [(k, (rng.normal(size=16) * np.exp(rng.normal())).tolist()) for k in range(1500)]
    rows += [(2000 + k, rng.normal(size=2 + k % 2).tolist()) for k in range(60)] + [(8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in N.nearest(df, "vec_id % 20 = 0", k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = total = 0
    for q, x in rows:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if len(y) == len(x) and i != q)[:20]
            want = [i for _, i in scores]
            if q >= 2000:
                assert got[q] == want
            else:
                hit, total = hit + len(set(want) & set(got[q])), total + len(want)
    assert got.keys() == {q for q, _ in rows if q % 20 == 0} and hit / total >= 0.95


def test_long_tokens_take_time_in_proportion(spark):
    """Random and ordinary texts of half a million characters without a break, and what a short one of each is."""
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    long = ["".join(rng.choices(letters, k=500_000)), "".join(rng.choices("0123456789abcdef", k=500_000)), "the_quick_brown_fox_" * 25_000]
    texts = ["some_ordinary_identifier of_the_usual_form and words in a sentence about nothing"] * 50 + [f"x {long[0][k * 40 : k * 40 + 40]} y" for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(long + texts)), "doc_id long, text string")
    begun = time.time()
    rows = {r.doc_id: r for r in X.scan(docs).collect()}
    assert time.time() - begun < 60
    assert [(s.start, s.end) for s in rows[1].base if s.kind == "hex"] == [(0, 500_000)]
    assert [(s.start, s.end) for s in rows[0].spans if s.kind == "markov"] == [(0, 500_000)]


def plain_ranks(docs, items, k=10):
    docs = [(i, Counter(words(t))) for i, t in docs if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df, asked = Counter(t for _, c in docs for t in c), defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(words(t))
    out = set()
    for item, terms in asked.items():
        scores = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scores += [(-s, i)] if s > 0 else []
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


DOCS, ITEMS = "doc_id long, text string, term string, rank int", "item_id long, text string, weight double"


def test_ranks_of_odd_rows(spark):
    rng = random.Random(8)
    vocabulary = ["Ärger", "ärger", "I", "i", "x2", "don", "t", "naïve", "漢字", "the", "THE", *map(str, range(40))]
    docs = [(k, rng.choice([" ", "-", "\n", "’", "\x00"]).join(rng.choices(vocabulary, k=rng.choice([1, 3, 30, 200])))) for k in range(150)]
    docs += [(k + 500, docs[7][1]) for k in range(15)] + [(3, "the 1 2"), (3, "the 1 2"), (900, None), (901, ""), (902, "--"), (None, "the 5"), (903, "long " * 50_000 + "7")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 12])))) for k in range(20)]
    items += [(20, docs[7][1]), (21, None), (22, ""), (23, "unheard of"), (None, "the"), (24, "1 1 1 2"), (24, "the"), (25, "long 7")]
    d = spark.createDataFrame([(*r, "t", 1) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1.0) for r in items], ITEMS)
    want = plain_ranks(docs, items)
    for block in ({}, {"documents": 7}, {"tokens": 50}):
        assert {tuple(r) for r in R.ranked(d, i, **block).collect()} == want, block
    assert R.ranked(d.where("false"), i).count() == 0 and R.ranked(d, i.where("false")).count() == 0


def test_queries_in_pages(spark):
    docs = spark.createDataFrame([(k, f"a{k % 7} b{k % 11} c") for k in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(f"q{k}", f"a{k % 7} b{k % 11}") for k in range(40)], "item_id string, text string")
    blocks = R.forward(docs, documents=16)
    n, total = R.corpus(blocks)
    index, asked = R.build(blocks, n, total), R.weighted_items(items, blocks, n, "item_id", "text")
    one, many = (sorted(map(tuple, R.search(index, asked, page=p).collect())) for p in (10**6, 9))
    assert one == many and len({r[0] for r in one}) == 40


def test_treap_finds_the_best_columns():
    rng = np.random.default_rng(0)
    for _ in range(100):
        grid = (rng.random((rng.integers(1, 70), rng.integers(1, 50))) < 0.2) * rng.integers(1, 40)
        rows, columns = np.nonzero(grid)
        if not len(rows):
            continue
        tree = R.K2Treap.build(rows, columns, grid[rows, columns].astype(np.int64), max(1, int(max(grid.shape) - 1).bit_length()))
        tree = R.K2Treap.unpacked(tree.height, *tree.packed(), tree.top)
        ask, weight = rng.choice(len(grid), rng.integers(1, len(grid) + 1), replace=False), rng.integers(1, 9)
        weights = np.full(len(ask), weight, np.int64)
        score, column = tree.best(ask, weights, 5, opened=2)
        want = sorted((-int(s), c) for c, s in enumerate(weights @ grid[ask]) if s > 0)[:5]
        assert sorted((-int(s), int(c)) for s, c in zip(score, column, strict=True))[:5] == want


def plain_negatives(rows, is_anchor, positives=5, negatives=3):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out, anchors = [], {}
    for i, y, v in ok:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    for a, (y, v) in anchors.items():
        scores = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, z, w in ok if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scores if x[2] == y)[:positives]:
            fits = sorted(x[:2] for x in scores if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits[:negatives], 1)]
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"block": 40, "least": 10, "members": 2, "step": 7}, {"clusters": 1, "step": 1000}])
def test_negatives(spark, options):
    rng = np.random.default_rng(11)
    rows = [(int(k), int(rng.integers(3)), [int(x) for x in np.floor(np.array(v) * 20)]) for k, v in enumerate(clustered(rng, 260))]
    rows += [(300 + k, 0, rows[4][2]) for k in range(30)] + [(0, 1, rows[1][2]), (400, 1, [0] * 6)]
    rows += [(500, 1, None), (501, None, [1] * 6), (None, 1, [1] * 6), (502, 1, [1, None, 3, 4, 5, 6]), (510, 1, [3, 4]), (520, 1, [3, 5]), (521, 2, [2, 3]), (530, 1, [])]
    rows += [(600, 2, [2**40, 1, 0, 0, 0, 0]), (601, 2, [2**20, 3, 0, 0, 0, 0]), (602, 1, [2**20 - 2**17, 1, 0, 0, 0, 0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, v array<long>, shard int, kind string")
    got = H.mine(df, F.col("vec_id") % 10 == 0, **options).collect()
    assert Counter(map(tuple, got)) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert H.mine(df.where("false"), F.col("vec_id") % 10 == 0, **options).count() == 0


def test_a_walk_ends_early():
    """Anchors of one cluster see a small part of a list whose bounds fall."""
    rng = np.random.default_rng(2)
    v = np.floor(E.unit(rng.normal(size=(20_000, 8))) * 256 * rng.uniform(0.1, 1, (20_000, 1))).astype(np.int64)
    head = np.zeros(8)
    head[0] = 1.0
    shard, seen = H.Shard(np.arange(20_000), np.zeros(20_000, int), v), []
    scores = shard.scores
    shard.scores = lambda q, size, at: seen.append(len(at)) or scores(q, size, at)
    q = np.floor(256 * (head + rng.normal(size=(10, 8)) * 0.02)).astype(np.int64)
    members = np.arange(-10, 0), np.zeros(10, int), q
    ask, found, value = shard.walk(members, head, 5, True, (np.arange(10), np.full(10, -np.inf), np.full(10, np.inf)), 256)
    want = [sorted((-int(s), i) for i, s in enumerate(v @ x))[:5] for x in q]
    assert [[(-int(s), int(i)) for a, i, s in zip(ask, found, value, strict=True) if a == k] for k in range(10)] == want
    assert sum(seen) < 5000
