"""Exact top-k search by inner product with a dual-tree cover-tree search.

Components become integers, so scores are exact.  Candidates are dealt by hash
into blocks and each block is indexed once by a cover tree: a node has a centre
among its points and the radius that covers them, and its children are a net of
centres at most half the radius apart from their points (or as many centres as
leaves need, FAN at most, where the data have too many dimensions for a finer
net).  Queries are indexed in the same way, in blocks of their own.

Blocks of candidates are dealt in groups to tasks and never leave theirs.  Each
query block is sent to each group once, as one packed row after the group's
candidates, and meets the group's blocks one after the other; what it has found
in one is the least that counts in the next.  A pair of nodes is dropped if
``<p, q> + rp |q| + rq |p| + rp rq``, the most that any of its pairs can score,
is below the worst k-th score within the query group.  Where the children of a
query node would drop few candidates more than the node itself, its queries meet
the leaves that are left together, as products of matrices.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

SCALE = 256
LEAF, FAN = 256, 32
#: Rows per indexed block.
CANDIDATES, QUERIES = 8192, 1024
#: Components of a group of candidates, all of which one task holds.
GROUP = 2 ** 24
#: Candidates of one product of matrices.
TILE = 256
#: A query node is opened if its children have less than this share of its work left.
WORTH = 0.8
_EXACT, _SHORT = 2 ** 53, 2 ** 24
_LAST, _LARGEST = np.iinfo(np.int64).max, float(np.finfo(np.float64).max)


@dataclass
class Tree:
    """Nodes of a cover tree over the rows of ``points``; node 0 is the root and
    parents come before children.  ``order`` has the rows so that each node's lie
    together, from ``first`` to ``stop``; ``kids`` its children (none: a leaf)."""

    ids: np.ndarray
    points: np.ndarray
    order: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    level: np.ndarray
    parent: np.ndarray
    kids: list

    def __post_init__(self):
        self.leaf = np.array([x for x in np.argsort(self.first, kind="stable") if not self.kids[x]], np.int64)
        self.size = (self.stop - self.first)[self.leaf]
        self.below = [np.flatnonzero(self.level == d) for d in range(1, self.level.max() + 1)]
        self.names = self.ids[self.order]
        self.by_name = np.argsort(self.names)
        near = self.points.astype(np.float64)
        #: No sum of products of two points' components is beyond the product of their lengths.
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", near, near).max()))
        self._laid = {}

    @property
    def rows(self) -> list:
        """Each node's rows."""
        return [self.order[a:b] for a, b in zip(self.first, self.stop, strict=True)]

    def laid(self, kind: type) -> np.ndarray:
        """Points in the nodes' order as numbers of ``kind``; the last kind is kept, unless it is objects."""
        if kind is object:
            return np.array([[int(x) for x in row] for row in self.points[self.order]], object).reshape(self.points.shape)
        if kind not in self._laid:
            self._laid = {kind: self.points[self.order].astype(kind)}
        return self._laid[kind]

    def reached(self, alive: np.ndarray) -> np.ndarray:
        """Which leaves, in the nodes' order, are reached through nodes that are
        ``alive``; a row for each row of ``alive``."""
        for at in self.below:
            alive[:, at] &= alive[:, self.parent[at]]
        return alive[:, self.leaf]


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover_tree(ids: np.ndarray, points: np.ndarray) -> Tree:
    """Index of the rows of ``points`` (whole numbers of any numeric type), one at the least."""
    near = points.astype(np.float64)
    order = np.arange(len(ids))
    centres, radii, first, stop, level, parents, children = [], [], [], [], [], [], []
    todo = [(0, len(ids), 0, None)]
    while todo:
        start, end, centre, parent = todo.pop()
        rows, me = order[start:end].copy(), len(radii)
        if parent is not None:
            children[parent].append(me)
        gap = _distances(near[rows], near[centre])
        centres.append(centre)
        radii.append(gap.max(initial=0.0))
        first.append(start)
        stop.append(end)
        level.append(0 if parent is None else level[parent] + 1)
        parents.append(0 if parent is None else parent)
        children.append([])
        if len(rows) <= LEAF or not radii[-1]:
            continue
        nearest, net, many = np.zeros(len(rows), np.int64), [centre], min(FAN, -(-2 * len(rows) // LEAF))
        while gap.max() > radii[-1] / 2 and len(net) < many:
            pick = rows[gap.argmax()]
            other = _distances(near[rows], near[pick])
            closer = other < gap
            nearest[closer], gap[closer] = len(net), other[closer]
            net.append(pick)
        order[start:end] = rows[np.argsort(nearest, kind="stable")]
        ends = start + np.cumsum(np.bincount(nearest, minlength=len(net)))
        todo.extend((a, b, c, me) for a, b, c in zip([start, *ends[:-1]], ends, net, strict=True) if b > a)
    whole = lambda x: np.array(x, np.int64)
    return Tree(ids, points, order, near[centres], np.array(radii), whole(first), whole(stop), whole(level), whole(parents), children)


class Best:
    """The k best of each query so far, best first; rows in the order of the query tree's nodes."""

    def __init__(self, queries: Tree, k: int):
        shape = (len(queries.ids), k)
        self.score, self.who = np.full(shape, -np.inf), np.full(shape, _LAST)
        #: What a candidate must score at least to count.
        self.low = np.full(shape[0], -np.inf)

    def add(self, row: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        """Take candidates none of which was taken before."""
        some, k = np.unique(row), self.score.shape[1]
        row = np.concatenate([np.repeat(some, k), row])
        who = np.concatenate([self.who[some].ravel(), who])
        score = np.concatenate([self.score[some].ravel(), score])
        by = np.lexsort((who, -score, row))
        row, who, score = row[by], who[by], score[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.score[row[keep], place[keep]], self.who[row[keep], place[keep]] = score[keep], who[keep]
        self.low[some] = np.maximum(self.low[some], self.score[some, -1])


def search(queries: Tree, found: Tree, k: int, best: Best | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's k best, its own id left
    out, ties to the smaller id.  ``best`` has what other candidates gave and
    takes what these give."""
    best = best or Best(queries, k)
    _meet(queries, found, k, best)
    row, place = np.nonzero(best.score > -np.inf)
    return queries.order[row], best.who[row, place], best.score[row, place]


def _meet(queries: Tree, found: Tree, k: int, best: Best) -> None:
    width = max(queries.points.shape[1], found.points.shape[1])
    wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x
    longest = queries.longest * found.longest * (1 + 1e-9)
    kind = np.float32 if longest < _SHORT else np.float64 if longest < _EXACT else object
    if kind is object:
        best.score, best.low = best.score.astype(object), best.low.astype(object)
    q, p = wide(queries.laid(kind)), wide(found.laid(kind))
    qc, pc = wide(queries.centres), wide(found.centres)
    qn, pn = (np.sqrt(np.einsum("ij,ij->i", c, c)) for c in (qc, pc))
    most = (qc @ pc.T + queries.radii[:, None] * pn[None, :] + qn[:, None] * found.radii[None, :]
            + queries.radii[:, None] * found.radii[None, :])
    # Rounding must never prune: widen by far more than the sums can lose.
    most += 1e-9 * (qn[:, None] + queries.radii[:, None]) * (pn[None, :] + found.radii[None, :]) + 1e-6
    most[np.isnan(most)] = np.inf  # infinity less infinity, of numbers whose squares are too large
    at = found.by_name[np.searchsorted(found.names, queries.names, sorter=found.by_name).clip(max=len(p) - 1)]
    own = np.where(found.names[at] == queries.names, at, -1)

    def scores(a: int, b: int, start: int, stop: int) -> np.ndarray:
        out = q[a:b] @ p[start:stop].T
        mine = np.flatnonzero((own[a:b] >= start) & (own[a:b] < stop))
        out[mine, own[a:b][mine] - start] = -np.inf
        return out

    def lowest(nodes: list) -> np.ndarray:
        low = [best.low[queries.first[x]:queries.stop[x]].min() for x in nodes]
        return np.array([float(min(x, _LARGEST)) if x > -_LARGEST else -np.inf for x in low])

    # What a query's likeliest leaf holds tells before the search how much counts.
    for node in queries.leaf:
        if lowest([node])[0] > -np.inf:
            continue
        a, b = queries.first[node], queries.stop[node]
        likely = found.leaf[most[node, found.leaf].argmax()]
        while found.stop[likely] - found.first[likely] <= k and likely:
            likely = found.parent[likely]
        start = found.first[likely]
        stop = min(found.stop[likely], start + TILE)
        if stop - start > k:
            best.low[a:b] = np.maximum(best.low[a:b], np.partition(scores(a, b, start, stop), -k, axis=1)[:, -k])

    todo = [(0, np.ones(len(found.radii), bool))]
    while todo:
        node, alive = todo.pop()
        alive = alive & (most[node] >= lowest([node])[0])
        reached = found.reached(alive[None, :])[0]
        work = (queries.stop[node] - queries.first[node]) * found.size[reached].sum()
        if not work:
            continue
        if kids := queries.kids[node]:
            each = found.reached(alive & (most[kids] >= lowest(kids)[:, None])) @ found.size
            if ((queries.stop[kids] - queries.first[kids]) * each).sum() < WORTH * work:
                todo.extend((x, alive) for x in kids)
                continue
        leaves = found.leaf[reached]
        leaves = np.stack([found.first[leaves], found.stop[leaves]], axis=1)
        a, b = queries.first[node], queries.stop[node]
        cuts = np.flatnonzero(leaves[1:, 0] != leaves[:-1, 1]) + 1
        for run in np.split(leaves, cuts):
            for start in range(run[0, 0], run[-1, 1], TILE):
                score = scores(a, b, start, stop := min(start + TILE, run[-1, 1]))
                high, low = score.max(axis=1), best.low[a:b]
                hit = np.flatnonzero((high >= low) & (high > -np.inf))
                if not len(hit):
                    continue
                score, low = score[hit], low[hit]
                if (low == -np.inf).any() and stop - start > k:
                    low = np.maximum(low, np.partition(score, -k, axis=1)[:, -k])
                row, column = np.nonzero((score >= low[:, None]) & (score > -np.inf))
                score = score[row, column]
                best.add(a + hit[row], found.names[start + column], score if kind is object else score.astype(np.float64))


def _points(values: pa.ChunkedArray) -> np.ndarray:
    """floor(SCALE * x) of every component, a whole number; shorter vectors end in zeros."""
    flat = pa.chunked_array([c.flatten() for c in values.chunks], values.type.value_type)
    many = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in values.chunks])
    width = int(many.max(initial=0))
    out = np.zeros((len(many), width))
    out[np.arange(width)[None, :] < many[:, None]] = flat.to_numpy()
    out = np.floor(SCALE * out)
    return out.astype(np.int16) if np.abs(out).max(initial=0) < 2 ** 15 else out


def _index(ids: np.ndarray, vectors: pa.ChunkedArray, most: int | None = None) -> Tree:
    """Tree over one block's rows.  Of equal points the ``most`` of the smallest ids
    are kept: no list of that many but one, the query's own, has room for others."""
    order = np.argsort(ids)
    ids, points = ids[order], _points(vectors)[order]
    if most and len(points) > most and points.shape[1]:
        as_one = np.ascontiguousarray(points + 0).view(np.dtype((np.void, points.itemsize * points.shape[1]))).ravel()
        by = np.argsort(as_one, kind="stable")
        new = np.concatenate([[True], as_one[by][1:] != as_one[by][:-1]])
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        keep = np.sort(by[place < most])
        ids, points = ids[keep], points[keep]
    return cover_tree(ids, points)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` candidates from ``vectors``
    with the highest integer inner product with each row of ``queries``.

    A query never finds its own id; ties go to the smaller id; with fewer
    candidates all are returned.  Rows without id, null vectors and vectors
    with a null or non-finite component take no part.  Rows that share an id
    count once, with the least of their vectors.  A shorter vector ends in
    zeros.  A score beyond a long ends there.
    """
    def kind(df: DataFrame) -> str:
        short = isinstance(getattr(df.select(df[vector]).schema[0].dataType, "elementType", None), FloatType)
        return "array<float>" if short else "array<double>"

    same = kind(vectors) if kind(vectors) == kind(queries) else "array<double>"

    def clean(df: DataFrame, out: Callable[[Column], Column] = F.min, name: str = "vector") -> DataFrame:
        v = df[vector].cast(same)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < F.lit(float("inf"))))
        return (df.where(df[id_col].isNotNull() & v.isNotNull() & fine)
                .groupBy(df[id_col].cast("long").alias("id")).agg(out(v).alias(name)))

    many, wide = clean(vectors, lambda v: F.max(F.size(v)), "size").agg(F.count("*"), F.max("size")).first()
    asked = clean(queries).count()
    blocks, chunks = max(1, -(-many // CANDIDATES)), max(1, -(-asked // QUERIES))
    # As many groups as memory needs; more if they copy no more queries than there are candidates.
    groups = max(-(-many * (wide or 1) // GROUP), min(blocks, many // max(1, asked)), 1)
    each = -(-blocks // min(groups, blocks))
    groups = -(-blocks // each)

    def deal(df: DataFrame, parts: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        tree = _index(table["id"].to_numpy(), table["vector"])
        return pa.table({"tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query block to each group, copy by copy, behind the group's candidates."""
        for b in batches:
            for i in range(b.num_rows):
                for g in range(groups):
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([each * groups], pa.int32()), b.column(0).slice(i, 1)],
                                                     names=["group", "block", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group and block, queries last: trees are built block by
        block, and only those of one group are held."""
        group, block, held, trees = None, None, [], []
        for b in batches:
            g, at = (b.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (at[1:] != at[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if stop == start:
                    continue
                if (g[start], at[start]) != (group, block):
                    if held:
                        trees.append(_tree(held, k))
                    held = []
                    if g[start] != group:
                        trees = []
                    group, block = g[start], at[start]
                if block < each * groups:
                    held.append(b.slice(start, stop - start))
                    continue
                for i in range(start, stop):
                    yield _answer(pickle.loads(b.column(4)[i].as_py()), trees, k)

    packed = deal(clean(queries), chunks).groupBy("block").applyInArrow(pack, "tree binary")
    copies = packed.mapInArrow(send, "group int, block int, tree binary")
    dealt = deal(clean(vectors), blocks).select(F.expr(f"block div {each}").cast("int").alias("group"), "block", "id", "vector")
    stream = dealt.unionByName(copies, allowMissingColumns=True).repartition(4 * groups, "group").sortWithinPartitions("group", "block")
    near = stream.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _tree(held: list[pa.RecordBatch], k: int) -> Tree:
    table = pa.Table.from_batches(held)
    return _index(table["id"].to_numpy(), table["vector"], k + 1)


def _answer(queries: Tree, trees: list[Tree], k: int) -> pa.RecordBatch:
    best = Best(queries, k)
    at = who = score = np.zeros(0, np.int64)
    for found in trees:
        at, who, score = search(queries, found, k, best)
    if score.dtype == object:
        score = np.array([max(-2 ** 63, min(2 ** 63 - 1, int(s))) for s in score], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(queries.ids[at], pa.int64()), pa.array(who, pa.int64()), pa.array(score.astype(np.int64))],
        names=["query_id", "vec_id", "score"])
