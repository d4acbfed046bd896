"""Exact top-k search by inner product: a dual-tree search over cover trees.

Queries and data are indexed together. The upper levels of the tree have at most ``NODES`` centres,
chosen farthest first on a bounded sample (``SAMPLE`` rows, by hash of the id); every row goes to its
nearest centre, and covering radii are taken over all rows. Below a centre rows lie in blocks of
bounded size (a crowded centre has many blocks), each of which is one task's cover tree.

1. Each block is searched for the queries that lie in it. That gives each query a k-th score, which is a lower
   bound, and each group of queries (a node: centre, covering radius) its worst one.
2. A query group descends the upper tree: a pair of nodes is pruned if no vector of the one can have, with any
   of the other, a product above the group's worst k-th score. By Cauchy-Schwarz, with centres
   ``p, q`` and covering radii ``r, s``, a product is at most ``p.q + r |q| + s |p| + r s``.
3. Groups are sent to the blocks that are left. There the pairs of (group, block) trees descend
   together, and only pairs of leaves that cannot be pruned are multiplied out. Only products that
   reach a query's bound leave the task, ``k`` at most.

A task holds one block and streams the groups past it. Results are exact: pruning uses bounds with a margin for
rounding, products are integers below 2 ** 53 in doubles, or Python integers where they may be larger.

Defined cases: components are ``floor(scale * x)``; a vector that is null or empty or holds a null or non-finite component takes
no part; of vectors of different lengths the missing components count as 0; ties go to the smaller id; rows with
the same id and vector are one row, rows with the same id and different vectors count each (and none is a candidate
of a query with that id); rows without id take no part; fewer candidates than ``k`` give fewer rows; products outside 64 bits stop at the largest (smallest) long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.storage import Staging

SAMPLE = 4096
NODES = 1024
BLOCK = 1 << 17
GROUP = 256
_FAN = 16
_LEAF = 256
_EXACT = float(1 << 53)
_VECTOR = "vec_id long, query boolean, node long, far double, v binary"


def packed(m: np.ndarray) -> list[bytes]:
    """Rows of integers kept in doubles, each in the narrowest type."""
    wide = np.abs(m).max(axis=1, initial=0)
    kind = np.where(wide < 2**15, 2, np.where(wide < 2**31, 4, 8))
    small, middle = m.astype(np.int16, casting="unsafe") if (kind == 2).any() else None, None
    if (kind == 4).any():
        middle = np.where(wide[:, None] < 2**31, m, 0).astype(np.int32)
    return [(small[i] if k == 2 else middle[i] if k == 4 else m[i]).tobytes() for i, k in enumerate(kind.tolist())]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    size = np.array([len(x) for x in rows])
    out = np.zeros((len(rows), dim))
    for width, dtype in ((2, np.int16), (4, np.int32), (8, np.float64)):
        at = np.flatnonzero(size == width * dim)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at.tolist()), dtype).reshape(len(at), dim)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exact; float64 where they all fit, else Python integers."""
    if np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0) < _EXACT:
        return a @ b.T
    whole = [[int(x) for x in row] for row in b.tolist()]
    out = np.empty((len(a), len(b)), object)
    for i, row in enumerate(a.tolist()):
        row = [int(x) for x in row]
        out[i] = [sum(x * y for x, y in zip(row, other, strict=True)) for other in whole]
    return out


def farthest_first(m: np.ndarray, n: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of up to ``n`` centres, each the row farthest from those before it (a cover at
    every scale, with centres at least that scale apart), the nearest centre of every row and the distance to it."""
    chosen, near = [first], np.zeros(len(m), np.int64)
    far = np.sqrt(((m - m[first]) ** 2).sum(axis=1))
    while len(chosen) < n and far.max(initial=0) > 0:
        c = int(far.argmax())
        d = np.sqrt(((m - m[c]) ** 2).sum(axis=1))
        closer = d < far
        far[closer], near[closer] = d[closer], len(chosen)
        chosen.append(c)
    return np.array(chosen), near, far


class Tree(NamedTuple):
    """Nodes in the order of their levels. Rows of node ``i`` are ``order[lo[i]:hi[i]]``, its children ``first[i]`` to
    ``last[i]`` (none: a leaf)."""

    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray
    order: np.ndarray


def build(m: np.ndarray, leaf: int = _LEAF, fan: int = _FAN) -> Tree:
    """A cover tree: a node's children are centred on its own rows, farthest first, its own centre among
    them, at the scale that ``fan`` centres cover; radii are those of the rows below."""
    order = np.arange(len(m))
    nodes: list[list] = [[0, 0, len(m), 0, 0]]  # centre row, lo, hi, first and last child
    i = 0
    while i < len(nodes):
        c, lo, hi, _, _ = nodes[i]
        if hi - lo > leaf:
            rows = order[lo:hi].copy()
            chosen, near, far = farthest_first(m[rows], fan, int(np.flatnonzero(rows == c)[0]))
            if len(chosen) > 1:  # else all rows are equal
                by = np.argsort(near, kind="stable")
                order[lo:hi] = rows[by]
                edge = lo + np.searchsorted(near[by], np.arange(len(chosen) + 1))
                nodes[i][3:] = [len(nodes), len(nodes) + len(chosen)]
                nodes += [[int(rows[x]), int(edge[k]), int(edge[k + 1]), 0, 0] for k, x in enumerate(chosen.tolist())]
        i += 1
    table = np.array(nodes, np.int64)
    centre = m[table[:, 0]] if len(m) else np.zeros((1, m.shape[1]))
    radius = np.array([np.sqrt(((m[order[lo:hi]] - c) ** 2).sum(axis=1).max(initial=0)) for c, lo, hi in zip(centre, table[:, 1], table[:, 2], strict=True)])
    return Tree(centre, np.sqrt((centre**2).sum(axis=1)), radius, table[:, 1], table[:, 2], table[:, 3], table[:, 4], order)


def bound(p: np.ndarray, p_norm: np.ndarray, r: np.ndarray, q: np.ndarray, q_norm: np.ndarray, s: np.ndarray) -> np.ndarray:
    """No product of a vector within ``r`` of ``p`` and one within ``s`` of ``q`` is larger; row by row."""
    top = (p * q).sum(axis=1) + r * q_norm + s * p_norm + r * s
    return top + 1e-9 * (1 + (p_norm + r) * (q_norm + s))


class Best:
    """The ``k`` best (score, id) of each query so far, best first; a score must reach ``floor``."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.floor, self.k = ids, floor, k
        self.score = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def worst(self) -> np.ndarray:
        """What a product must reach, for each query."""
        last = self.score[:, -1].astype(float)
        if self.score.dtype == object:  # rounded to a double: never above the product itself
            last = np.nextafter(last, -np.inf)
        return np.maximum(self.floor, last)

    def offer(self, rows: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        """Products of some queries with some vectors."""
        if score.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        hit = (score >= self.worst()[rows][:, None]) & (who[None, :] != self.ids[rows][:, None])
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            q, at = int(rows[i]), np.flatnonzero(hit[i])
            s, w = np.concatenate([self.score[q], score[i, at]]), np.concatenate([self.who[q], who[at]])
            first = np.lexsort((w, -s))[: self.k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], w[j]))[: self.k])
            self.score[q], self.who[q] = s[first], w[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of everything found."""
        q, j = np.nonzero(self.who != np.iinfo(np.int64).max)
        s = self.score[q, j]
        low, high = -(2**63), 2**63 - 1
        return q, self.who[q, j], np.array([min(max(int(x), low), high) for x in s.tolist()], np.int64)


def dual_search(queries: np.ndarray, data: np.ndarray, tree: Tree, ids: np.ndarray, best: Best) -> None:
    """Descend the trees of the queries and of the data together; fills ``best``."""
    if not len(queries) or not len(data):
        return
    own = build(queries, leaf=32)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def group_worst() -> np.ndarray:
        worst = best.worst()[own.order]
        return np.array([worst[lo:hi].min() for lo, hi in zip(own.lo, own.hi, strict=True)])

    worst = group_worst()
    while len(a):
        top = bound(own.centre[a], own.norm[a], own.radius[a], tree.centre[b], tree.norm[b], tree.radius[b])
        open_ = top >= worst[a]
        a, b, top = a[open_], b[open_], top[open_]
        n_a, n_b = own.last[a] - own.first[a], tree.last[b] - tree.first[b]
        done = (n_a == 0) & (n_b == 0)
        leaves.append((a[done], b[done], top[done]))
        a, b, n_a, n_b = a[~done], b[~done], n_a[~done], n_b[~done]
        many = np.maximum(n_a, 1) * np.maximum(n_b, 1)
        pair = np.repeat(np.arange(len(a)), many)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        wide = np.maximum(n_b, 1)[pair]
        a, b = np.where(n_a[pair] > 0, own.first[a[pair]] + k // wide, a[pair]), np.where(n_b[pair] > 0, tree.first[b[pair]] + k % wide, b[pair])
    a, b, top = (np.concatenate(x) for x in zip(*leaves, strict=True))
    # the most promising data leaves first, so that the worst k-th scores rise early
    promise = np.full(len(tree.lo), -np.inf)
    np.maximum.at(promise, b, top)
    by = np.lexsort((b, -promise[b]))
    a, b, top = a[by], b[by], top[by]
    for part in np.split(np.arange(len(b)), np.flatnonzero(b[1:] != b[:-1]) + 1) if len(b) else []:
        node = int(b[part[0]])
        rows = np.concatenate([own.order[own.lo[x] : own.hi[x]] for x in a[part].tolist()])
        # within the open pairs, each query by itself against the covering radius
        q = queries[rows]
        size = np.sqrt((q**2).sum(axis=1))
        top = q @ tree.centre[node] + size * tree.radius[node]
        rows = rows[top + 1e-9 * (1 + size * (tree.norm[node] + tree.radius[node])) >= best.worst()[rows]]
        if len(rows):
            at = tree.order[tree.lo[node] : tree.hi[node]]
            best.offer(rows, products(queries[rows], data[at]), ids[at])


def whole(column: pa.ChunkedArray | pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of the lists in a column, filled up with zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, dim))
    count = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
    out[np.repeat(np.arange(len(column)), count), place] = np.floor(np.clip(flat, -1e290, 1e290) * scale)
    return out


def groups(m: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers of groups of neighbouring rows, ``most`` at most in each."""
    if len(m):
        tree = build(m, leaf=most)
        for lo, hi in zip(tree.lo[tree.first == tree.last].tolist(), tree.hi[tree.first == tree.last].tolist(), strict=True):
            for at in range(lo, hi, most):  # equal rows are not divided by the tree
                yield tree.order[at : min(at + most, hi)]


class Upper(NamedTuple):
    """The upper levels, with radii over all rows below: the tree over the centres, and the first block of each centre."""

    tree: Tree
    begin: np.ndarray


def upper_levels(centre: np.ndarray, radius: np.ndarray, shares: np.ndarray) -> Upper:
    tree = build(centre, leaf=1)
    reach = []
    for c, lo, hi in zip(tree.centre, tree.lo, tree.hi, strict=True):
        below = tree.order[lo:hi]
        reach.append((np.sqrt(((centre[below] - c) ** 2).sum(axis=1)) + radius[below]).max(initial=0))
    return Upper(tree._replace(radius=np.array(reach)), np.concatenate([[0], np.cumsum(shares)]))


def open_blocks(queries: np.ndarray, floor: np.ndarray, upper: Upper) -> list[int]:
    """Blocks that a group of queries must visit: those of upper nodes that its worst k-th score does not rule out."""
    tree, p = upper.tree, queries.mean(axis=0)
    r = np.sqrt(((queries - p) ** 2).sum(axis=1).max(initial=0))
    at, out = np.zeros(1, np.int64), []
    while len(at):
        one = np.ones((len(at), 1))
        top = bound(one * p, one[:, 0] * np.sqrt((p**2).sum()), one[:, 0] * r, tree.centre[at], tree.norm[at], tree.radius[at])
        at = at[top >= floor.min()]
        last = at[tree.last[at] == tree.first[at]]
        for x in np.concatenate([np.zeros(0, np.int64), *[tree.order[tree.lo[i] : tree.hi[i]] for i in last.tolist()]]).tolist():
            out += range(int(upper.begin[x]), int(upper.begin[x + 1]))
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(tree.first[i], tree.last[i]) for i in at.tolist()]])
    return out


class Block:
    """The rows of one block as they arrive, each (id, vector) once; then their tree."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.seen: dict[tuple[int, bytes], bool] = {}
        self.tree: Tree | None = None

    def add(self, ids: list[int], vectors: list[bytes], asks: list[bool]) -> None:
        for i, v, a in zip(ids, vectors, asks, strict=True):
            self.seen[i, v] = self.seen.get((i, v), False) or a

    def close(self) -> None:
        self.ids = np.array([i for i, _ in self.seen], np.int64)
        self.m = unpacked([v for _, v in self.seen], self.dim)
        self.asks = np.array(list(self.seen.values()), bool)
        self.seen = {}
        self.tree = build(self.m)

    def search(self, ids: np.ndarray, m: np.ndarray, floor: np.ndarray, k: int) -> Best:
        if self.tree is None:
            self.close()
        best = Best(ids, floor, k)
        dual_search(m, self.m, self.tree, self.ids, best)
        return best


_GROUP = "block long, ids array<long>, vectors array<binary>, floor array<double>"
_HITS = "query_id array<long>, vec_id array<long>, score array<long>"


def _spans(blocks: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of the stretches of equal blocks in a batch."""
    b = blocks.to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(b[lo]), lo, hi


def _hit_arrays(ids: np.ndarray, best: Best) -> list[pa.Array]:
    q, who, score = best.rows()
    return [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (ids[q], who, score)]


def top_k(vectors: DataFrame, staging: Staging, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest inner product for each row that
    ``queries`` marks, among all other rows. A block has about ``block`` rows, a query group at most ``group``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("query"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.coalesce(F.size("v"), F.lit(0)) > 0) & ~F.coalesce(odd, F.lit(True)))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    points = whole(sample.column("v"), dim, scale)
    n_nodes = min(NODES, max(1, -(-n // block), round(n**0.5 / 16)))
    centre = points[farthest_first(points, n_nodes)[0]] if len(points) else np.zeros((1, dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centre**2).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m = whole(part.column("v"), dim, scale)
                node = (square[None, :] - 2 * (m @ centre.T)).argmin(axis=1)
                far = np.sqrt(((m - centre[node]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("query"), pa.array(node, pa.int64()), pa.array(far), pa.array(packed(m), pa.binary())], names=["vec_id", "query", "node", "far", "v"])

    placed = staging.write(rows.mapInArrow(place, _VECTOR), "placed")
    found = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("far")).toArrow()  # at most NODES rows
    at, size, radius = found.column("node").to_numpy(), np.zeros(len(centre), np.int64), np.zeros(len(centre))
    size[at], radius[at] = found.column("n").to_numpy(), found.column("far").to_numpy()
    shares = np.maximum(1, -(-size // block))
    upper = upper_levels(centre, radius, shares)
    blocks = int(shares.sum())

    numbers = spark.createDataFrame(list(zip(range(len(centre)), upper.begin[:-1].tolist(), shares.tolist(), strict=True)), "node long, begin long, share long")
    data = placed.join(numbers, "node").select((F.col("begin") + F.pmod(F.xxhash64("vec_id"), F.col("share"))).alias("block"), "vec_id", "query", "v")

    def look_at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            here.close()
            mine = np.flatnonzero(here.asks)
            for part in groups(here.m[mine], group):
                ids, m = here.ids[mine[part]], here.m[mine[part]]
                best = here.search(ids, m, np.full(len(ids), -np.inf), k)
                own = [pa.array([number], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([packed(m)], pa.list_(pa.binary())), pa.array([best.worst().tolist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*own, *_hit_arrays(ids, best)], names=["block", "ids", "vectors", "floor", "query_id", "vec_id", "score"])

        number, here = -1, Block(dim)
        for batch in batches:
            for to, lo, hi in _spans(batch.column("block")):
                if to != number:
                    yield from done()
                    number, here = to, Block(dim)
                some = batch.slice(lo, hi - lo)
                here.add(*[some.column(c).to_pylist() for c in ("vec_id", "v", "query")])
        yield from done()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                home, _, m, floor = (one.column(c)[0].as_py() for c in ("block", "ids", "vectors", "floor"))
                to = [x for x in open_blocks(unpacked(m, dim), np.array(floor), upper) if x != home]
                same = one.take(pa.array(np.zeros(len(to), np.int64)))
                yield same.set_column(0, "block", pa.array(to, pa.int64()))

    def look_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, here = -1, Block(dim)
        for batch in batches:
            for to, lo, hi in _spans(batch.column("block")):
                if to != number:
                    number, here = to, Block(dim)
                some = batch.slice(lo, hi - lo)
                n_data = int((some.column("kind").to_numpy() == 0).sum())  # the block's rows come first
                if n_data:
                    rows = some.slice(0, n_data)
                    here.add(rows.column("vec_id").to_pylist(), rows.column("v").to_pylist(), [False] * n_data)
                for i in range(n_data, some.num_rows):
                    ids, m, floor = (some.column(c)[i].as_py() for c in ("ids", "vectors", "floor"))
                    best = here.search(np.array(ids, np.int64), unpacked(m, dim), np.array(floor, float), k)
                    yield pa.RecordBatch.from_arrays(_hit_arrays(np.array(ids, np.int64), best), names=["query_id", "vec_id", "score"])

    looked = data.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(look_at_home, f"{_GROUP}, {_HITS}")
    looked = staging.write(looked, "looked")
    sent = looked.select("block", "ids", "vectors", "floor").mapInArrow(send, _GROUP)
    both = data.select("block", F.lit(0).alias("kind"), "vec_id", "v").unionByName(sent.select("block", F.lit(1).alias("kind"), "ids", "vectors", "floor"), allowMissingColumns=True)
    more = both.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(look_elsewhere, _HITS)
    every = looked.select("query_id", "vec_id", "score").unionByName(more)
    every = every.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("x")).select("x.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
