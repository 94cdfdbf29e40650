"""Near copies among embeddings by cover trees: every pair of one label whose cosine reaches a threshold.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2 t), which obeys the triangle inequality. Equal vectors
of a label are one *class*. The classes of a label are dealt into blocks: a cell holds what lies nearest to one of the first
centres of a greedy permutation (of a bounded sample; the more classes a label has the more centres it uses), and a cell
beyond ``block`` rows is cut by a hash. A block becomes a cover tree: the root covers all, each node's children are a net of half
its radius, a node's centre is the centre of its first child, and a node keeps the distance of its farthest row. Pairs of
blocks whose centres lie too far apart for their covering radii are passed over; the trees of the others are walked together:

* nodes whose balls are farther apart than the threshold are dropped with all their rows,
* nodes whose balls lie within the threshold are linked as a whole: counts and membership by ranges, no pair is written,
* otherwise both are replaced by their children; single rows are decided by their cosine, near ties by the original vectors.

A task returns a row per class that has links: their number and one member of what it hangs together with. Sums of the numbers and
connected components of those links give the result, so a group of near copies of any size costs a row per member and block.

Blocks of a label that no bound tells apart are all compared with each other, so for vectors without any structure the work
grows with the square of a label, as an exact join in many dimensions does; it is spread over blocks of bounded size.

Defined cases: a label of its own null, vectors that are null, empty or zero or hold null or non-finite components link
with nothing and are their own component; vectors of different lengths don't link; rows that repeat an id are vectors of their
own; a component is named by its smallest id that is not null (null if all are); an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

MANY, ROWS = 1 << 18, 512
SLACK = 1e-6  # above what rounding does to a distance of unit vectors
TREE = "label string, width int, centre int, salt int, cid long, v array<double>, n long, sizes array<int>, radii array<double>"
LINKS = "cid long, links long, root long"
BLOCK = ["label", "width", "centre", "salt"]
PAIR = ["label", "width", "a_centre", "a_salt", "b_centre", "b_salt"]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def greedy(u: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` points of a greedy permutation: each is the farthest from all before, so every prefix is a net."""
    picked, far = [0], distance(u @ u[0])
    while len(picked) < min(most, len(u)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, distance(u @ u[picked[-1]]))
    return u[picked]


class CoverTree:
    """Nodes are ranges of the rows in ``order``; a node's centre is its first row. Children follow as lists of nodes."""

    def __init__(self):
        self.lo, self.hi, self.radius, self.children = [], [], [], []

    def add(self, lo: int, hi: int, radius: float) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.radius.append(radius)
        self.children.append([])
        return len(self.lo) - 1

    def close(self) -> CoverTree:
        """Lists to arrays: the children of node i are kids[first[i]:first[i + 1]], a single row is its own child."""
        self.lo, self.hi, self.radius = np.array(self.lo), np.array(self.hi), np.array(self.radius)
        self.single = self.hi - self.lo == 1
        own = [c or [i] for i, c in enumerate(self.children)]
        self.first = np.cumsum([0, *map(len, own)])
        self.kids = np.array([k for c in own for k in c], int)
        return self

    def count(self, nodes: np.ndarray) -> np.ndarray:
        return self.first[nodes + 1] - self.first[nodes]


def net(u: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """``rows`` by the first of the net's centres that covers them; a group begins with its centre, the first with rows[0]."""
    owner, centres = np.full(len(rows), -1), 0
    for at in range(0, len(rows), 256):
        ask = at + np.flatnonzero(owner[at : at + 256] < 0)
        near = distance(u[rows[ask]] @ u[rows].T) <= radius
        for k, close in zip(ask, near, strict=True):
            if owner[k] < 0:
                owner[close & (owner < 0)] = centres
                owner[k] = centres
                centres += 1
    order = np.argsort(owner, kind="stable")
    return [rows[g] for g in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)]


def grow(u: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
    """The order of the rows in the tree and, for the row that each node begins with, the nodes' sizes and radii, outermost first."""
    order, sizes, radii = [], [[] for _ in u], [[] for _ in u]
    todo = [(np.arange(len(u)), None)]
    while todo:
        rows, level = todo.pop()
        reach = float(distance(u[rows] @ u[rows[0]]).max()) if len(rows) > 1 else 0.0
        sizes[rows[0]].append(len(rows))
        radii[rows[0]].append(reach)
        if len(rows) == 1 or reach <= SLACK:
            for r in rows if len(rows) == 1 else rows[1:]:
                if len(rows) > 1:  # rows too close to be told apart by distance hang below their node as they are
                    sizes[r].append(1)
                    radii[r].append(0.0)
            order += rows.tolist()
            if len(rows) > 1:
                sizes[rows[0]].append(1)
                radii[rows[0]].append(0.0)
            continue
        level = 2.0 if level is None else level
        while level / 2 >= reach:
            level /= 2  # levels at which the node has itself as its only child
        # the last child is walked first off the stack, so the first, which keeps the centre, is pushed last
        todo += [(group, level / 2) for group in reversed(net(u, rows, level / 2))]
    return np.array(order), sizes, radii


def read_tree(sizes: list, radii: list) -> CoverTree:
    """The tree from what `grow` says of its rows, in their order."""
    tree, open_ = CoverTree(), []
    for k, (own, reach) in enumerate(zip(sizes, radii, strict=True)):
        while open_ and tree.hi[open_[-1]] <= k:
            open_.pop()
        for size, radius in zip(own, reach, strict=True):
            node = tree.add(k, k + size, radius)
            if open_:
                tree.children[open_[-1]].append(node)
            open_.append(node)
    return tree.close()


class Links:
    """Links among rows a and rows b, gathered by ranges: numbers by steps up and down, membership by edges."""

    def __init__(self, weight_a: np.ndarray, weight_b: np.ndarray, same: bool):
        self.weight = np.concatenate([[0], np.cumsum(weight_a)]), np.concatenate([[0], np.cumsum(weight_b)])
        self.n, self.same = (len(weight_a), len(weight_b)), same
        self.step = np.zeros(len(weight_a) + 1, np.int64), np.zeros(len(weight_b) + 1, np.int64)
        self.joined = np.zeros(len(weight_a) + 1, np.int64), np.zeros(len(weight_b) + 1, np.int64)
        self.edges = []

    def ranges(self, side: int, lo: np.ndarray, hi: np.ndarray, more: np.ndarray) -> None:
        np.add.at(self.step[side], lo, more)
        np.add.at(self.step[side], hi, -more)
        np.add.at(self.joined[side], lo, 1)
        np.add.at(self.joined[side], hi - 1, -1)

    def all_of(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> None:
        """Every row of a range of a with every row of the range of b beside it."""
        of = lambda side, r: self.weight[side][r[1]] - self.weight[side][r[0]]
        self.ranges(0, *a, of(1, b))
        self.ranges(0 if self.same else 1, *b, of(0, a))
        self.edges.append((a[0], b[0]))

    def within(self, lo: int, hi: int, weight: np.ndarray) -> None:
        """Every two rows of a range; a row is not linked with its own class."""
        self.ranges(0, *(np.array([x]) for x in (lo, hi, self.weight[0][hi] - self.weight[0][lo])))
        np.subtract.at(self.step[0], np.arange(lo, hi), weight[lo:hi])
        np.add.at(self.step[0], np.arange(lo, hi) + 1, weight[lo:hi])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of links and the first row reached (rows of b follow those of a) of every row."""
        sides = (0,) if self.same else (0, 1)
        count = np.concatenate([np.cumsum(self.step[s])[:-1] for s in sides])
        shift = 0 if self.same else self.n[0]
        chain = [np.flatnonzero(np.cumsum(self.joined[s])[:-1] > 0) + s * shift for s in sides]
        u = np.concatenate([*chain, *(e[0] for e in self.edges)]).astype(int)
        v = np.concatenate([*(c + 1 for c in chain), *(e[1] + shift for e in self.edges)]).astype(int)
        root = np.arange(len(count))
        while len(u):
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            root = np.minimum(root, root[root])
            if (root == before).all():
                break
        return count, root


def walk(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """`Links.result` of two blocks (tree, vectors, weights), or of one with itself if ``b`` is ``a``.

    What waits is a stack of arrays of node pairs; a pair of very many children is opened by itself, ROWS rows of one side at a time
    and what they leave before the next, the others together, so that no more than about MANY pairs are measured at once.
    """
    (ta, va, wa), (tb, vb, wb) = a, b
    same, ua, ub, most = a is b, unit(va), unit(vb), float(distance(np.float64(threshold)))
    links = Links(wa, wb, same)
    exact = lambda x, y: float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y)))
    todo = [(np.zeros(1, int), np.zeros(1, int), None)]

    def decide(p: np.ndarray, q: np.ndarray, cosine: np.ndarray) -> None:
        """Drop, link or keep for later each pair of nodes, whose centres' cosines are given."""
        gap, reach = distance(cosine), ta.radius[p] + tb.radius[q]
        single, self_ = ta.single[p] & tb.single[q], (p == q) & same
        whole = np.where(single, cosine >= threshold, gap + reach < most - SLACK) & ~self_
        for k in np.flatnonzero(single & ~self_ & (np.abs(cosine - threshold) < 1e-9)):
            whole[k] = exact(va[ta.lo[p[k]]], vb[tb.lo[q[k]]]) >= threshold
        if whole.any():
            links.all_of((ta.lo[p[whole]], ta.hi[p[whole]]), (tb.lo[q[whole]], tb.hi[q[whole]]))
        rest = ~single & ~whole & (gap <= most + reach + SLACK)
        if rest.any():
            todo.append((p[rest], q[rest], None))

    while todo:
        i, j, at = todo.pop()
        if at is None and same:  # a node with itself
            close = (i == j) & (2 * ta.radius[i] < most - SLACK)
            for k in i[close]:
                links.within(ta.lo[k], ta.hi[k], wa)
            i, j = i[~close], j[~close]
        size = ta.count(i) * tb.count(j)
        if at is None:
            todo += [(i[k : k + 1], j[k : k + 1], c) for k in np.flatnonzero(size > MANY // 4) for c in range(0, int(ta.count(i[k : k + 1])[0]), ROWS)]
            i, j, size = i[size <= MANY // 4], j[size <= MANY // 4], size[size <= MANY // 4]
            if not len(i):
                continue
            if size.sum() > MANY:  # as many as may be opened at once; the others wait
                n = max(1, int(np.searchsorted(np.cumsum(size), MANY, "right")))
                if n < len(i):
                    todo.append((i[n:], j[n:], None))
                i, j, size = i[:n], j[:n], size[:n]
            of = np.repeat(np.arange(len(i)), size)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            across = tb.count(j)[of]
            p, q = ta.kids[ta.first[i[of]] + inner // across], tb.kids[tb.first[j[of]] + inner % across]
            if same:
                keep = (i[of] != j[of]) | (p <= q) & ~(ta.single[p] & (p == q))
                p, q = p[keep], q[keep]
            decide(p, q, np.einsum("ij,ij->i", ua[ta.lo[p]], ub[tb.lo[q]]))
            continue
        ci, cj = ta.kids[ta.first[i[0]] + at : ta.first[i[0] + 1]][:ROWS], tb.kids[tb.first[j[0]] : tb.first[j[0] + 1]]
        cosine = ua[ta.lo[ci]] @ ub[tb.lo[cj]].T
        # what the bound drops goes before pairs are made of it
        reach = most + SLACK + ta.radius[ci][:, None] + tb.radius[cj]
        open_ = cosine >= 1 - np.square(np.minimum(reach, 2)) / 2 - 1e-12
        if same and i[0] == j[0]:
            open_ &= ci[:, None] <= cj
            open_ &= ~((ci[:, None] == cj) & ta.single[ci][:, None])
        p, q = np.nonzero(open_)
        decide(ci[p], cj[q], cosine[p, q])
    return links.result()


def classes(vectors: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """label, v, cid, n, least: one row per different vector of a label, with its number of rows and their smallest id."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & (F.size("v") > 0)).where(~bad & F.exists("v", lambda x: x != 0))
    found = rows.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return materialise(found.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _cells(found: DataFrame, block: int, centres: int, sample: int) -> tuple[DataFrame, np.ndarray]:
    """``found`` with centre and gap (distance to it), and the centres; vectors of another length have centre 0 and gap 2."""
    some = [r.v for r in found.orderBy(F.xxhash64("label", "v"), "cid").limit(sample).select("v").collect()]  # bounded by `sample`
    width = max({len(v) for v in some}, key=lambda n: (sum(len(v) == n for v in some), n), default=1)
    heads = greedy(unit(np.array([v for v in some if len(v) == width])), centres) if some else np.zeros((1, 1))
    used = F.least(F.lit(len(heads)), F.ceil(F.col("all") / block)).cast("int")
    rows = found.withColumn("width", F.size("v"))
    rows = rows.join(rows.groupBy("label", "width").agg(F.count("*").alias("all")), ["label", "width"]).withColumn("used", used)

    def nearest(batches):
        for batch in batches:
            n, at, gap = batch.column("width").to_numpy(), np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            own = np.flatnonzero(n == width)
            if len(own):
                cosine = unit(matrix(batch.column("v").take(pa.array(own)), width)) @ heads.T
                cosine[np.arange(len(heads)) >= batch.column("used").to_numpy()[own][:, None]] = -2
                at[own] = cosine.argmax(1)
                gap[own] = distance(cosine.max(1))
            keep = ["label", "width", "cid", "v", "n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(at), pa.array(gap)], names=[*keep, "centre", "gap"])

    schema = "label string, width int, cid long, v array<double>, n long, centre int, gap double"
    rows = rows.select("label", "width", "cid", "v", "n", "used").mapInArrow(nearest, schema)
    return materialise(rows, "cells"), heads


def _plant(table: pa.Table) -> pa.Table:
    """The rows of a block in the order of its cover tree, which their sizes and radii describe."""
    v = matrix(table.column("v"), table.column("width")[0].as_py())
    order, sizes, radii = grow(unit(v))
    out = table.take(pa.array(order)).append_column("sizes", pa.array([sizes[k] for k in order], pa.list_(pa.int32())))
    return out.append_column("radii", pa.array([radii[k] for k in order], pa.list_(pa.float64())))


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("pos", "ascending")])
        width, first = table.column("width")[0].as_py(), int((table.column("side").to_numpy() == 0).sum())

        def block(part: pa.Table) -> tuple:
            tree = read_tree(part.column("sizes").to_pylist(), part.column("radii").to_pylist())
            return tree, matrix(part.column("v"), width), part.column("n").to_numpy()

        a = block(table.slice(0, first))
        b = block(table.slice(first)) if first < table.num_rows else a
        count, root = walk(a, b, threshold)
        cid, some = table.column("cid").to_numpy(), count > 0
        columns = [cid[some], count[some], cid[root[some]]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cid", "links", "root"])

    return compare


def similar(
    vectors: DataFrame, threshold: float = 0.93, block: int = 4096, centres: int = 64, sample: int = 2048,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = classes(vectors, id_col, label_col, vec_col)
    rows, heads = _cells(found, block, centres, sample)
    cells = rows.groupBy("label", "width", "centre").agg(F.count("*").alias("rows"), F.max("gap").alias("radius"))
    cells = materialise(cells.withColumn("salts", F.ceil(F.col("rows") / block).cast("int")), "cell-sizes")
    # a cell's rows are cut by a hash of their own, so however many rows a label holds a block has about `block`
    salt = F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int").alias("salt")
    dealt = rows.join(cells.select("label", "width", "centre", "salts"), ["label", "width", "centre"])
    dealt = dealt.select(*BLOCK[:3], salt, "cid", "v", "n").repartition(tasks, *BLOCK)
    numbered = dealt.groupBy(*BLOCK).applyInArrow(_plant, TREE).withColumn("pos", F.monotonically_increasing_id())
    trees = materialise(numbered, "trees")

    between = F.array(*[F.lit(float(d)) for d in distance(heads @ heads.T).ravel()])
    apart = F.element_at(between, F.col("a_centre") * len(heads) + F.col("b_centre") + 1)
    blocks = cells.select("label", "width", "centre", "radius", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    side = lambda s: blocks.select("label", "width", *[F.col(c).alias(f"{s}_{c}") for c in ("centre", "salt", "radius")])
    pairs = side("a").join(side("b"), ["label", "width"]).where(F.struct("a_centre", "a_salt") <= F.struct("b_centre", "b_salt"))
    most = float(distance(np.float64(threshold)))
    pairs = materialise(pairs.where(apart <= F.col("a_radius") + F.col("b_radius") + most + SLACK).select(*PAIR), "pairs")
    one = pairs.withColumnsRenamed({"a_centre": "centre", "a_salt": "salt"})
    other = pairs.where("a_centre != b_centre or a_salt != b_salt").withColumnsRenamed({"b_centre": "centre", "b_salt": "salt"})
    keep = [*PAIR, F.col("side"), "cid", "v", "n", "sizes", "radii", "pos"]

    def of(p: DataFrame, s: str, k: int) -> DataFrame:
        named = {f"{s}_centre": F.col("centre"), f"{s}_salt": F.col("salt"), "side": F.lit(k)}
        return trees.join(p, BLOCK).withColumns(named).select(*keep)

    both = of(one, "a", 0).union(of(other, "b", 1)).repartition(tasks, *PAIR)
    links = materialise(both.groupBy(*PAIR).applyInArrow(_compare(threshold), LINKS), "links")

    # equal vectors are linked with each other as well, so every class of several rows has links
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = found.select("label", "v", "cid", "n", "least").join(counts, "cid", "left").join(joined.withColumnRenamed("id", "cid"), "cid", "left")
    named = materialise(named.withColumn("component", F.coalesce("component", "cid")), "named")
    least = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = named.join(least, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    all_rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v")
    )
    out = all_rows.join(materialise(named, "classes-done"), ["label", "v"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
