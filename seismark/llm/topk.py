"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(256 x). Equal vectors are one point that carries its smallest ids (k + 1, which is all that
k hits without the query itself can need). A greedy net of a bounded sample (at most ``SAMPLE`` points) gives the top level:
every point goes to the cell of its nearest centre, and each cell, in chunks of about ``POINTS``, becomes one cover tree,
built once and stored. A node's children are a greedy net of its points (farthest first, the node's own centre first of
all): centres lie at least as far apart as their covering radius, which is half the node's where ``CHILDREN`` centres do,
or else what that many centres reach.

Queries are searched in a chunk of their own cell first. With the kth score from there, a query goes to another cell only if
<q, c> + |q| r of the cell reaches it. In each task a tree of queries meets a tree of points, and a pair of nodes goes when
<q, p> + |q| r_p + |p| r_q + r_q r_p cannot reach the worst kth score of the query node. Leaves are compared as blocks of
integers, exactly. The best of each task are merged by Spark.

Defined cases: vectors that are null, empty, or that hold a null or non-finite component take no part; shorter vectors count
as followed by zeros; components and scores beyond 64 bits are cut to the range of a long; rows with a null vec_id take no
part; repeated rows count as often as they are given; of equal scores the smaller vec_id comes first; with fewer candidates
than k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SCALE, K, EVERY = 256, 5, 50
#: Points of a chunk and queries of a block; centres of a node's net; points of a leaf.
POINTS, QUERIES, CHILDREN, LEAF = 8192, 1024, 16, 128
#: Points that the top level is chosen from, and its centres at most.
SAMPLE, CELLS = 4096, 512
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def greedy_net(points: np.ndarray, first: int, most: int, enough: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres picked farthest first until ``most`` or until all points lie within ``enough``; each point's centre and distance."""
    centres, owner = [first], np.zeros(len(points), np.int64)
    away = np.sqrt(((points - points[first]) ** 2).sum(1))
    while len(centres) < min(most, len(points)) and away.max() > enough:
        far = int(away.argmax())
        new = np.sqrt(((points - points[far]) ** 2).sum(1))
        nearer = new < away
        owner[nearer], away = len(centres), np.minimum(away, new)
        centres.append(far)
    return centres, owner, away


class Tree:
    """A cover tree as arrays: the points' order, and per node its centre (a row), covering radius, rows [start, end) and children."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.centre, self.radius, self.start, self.end, self.children = [], [], [], [], []
        if len(points):
            self._add(0, len(points), 0)

    def _add(self, start: int, end: int, centre: int) -> int:
        """The node of the rows order[start:end], of which ``centre`` is the first's place among them."""
        rows = self.order[start:end]
        held = self.points[rows]
        radius = float(np.sqrt(((held - held[centre]) ** 2).sum(1).max()))
        node = len(self.centre)
        for values, value in ((self.centre, rows[centre]), (self.radius, radius), (self.start, start), (self.end, end), (self.children, ())):
            values.append(value)
        if len(rows) > LEAF and radius > 0:
            centres, owner, _ = greedy_net(held, centre, CHILDREN, radius / 2)
            by_owner = np.argsort(owner, kind="stable")
            self.order[start:end] = rows[by_owner]
            cuts = np.searchsorted(owner[by_owner], np.arange(len(centres) + 1))
            places = [int(np.searchsorted(by_owner[a:b], c)) for c, a, b in zip(centres, cuts, cuts[1:], strict=False)]
            self.children[node] = tuple(self._add(start + int(a), start + int(b), place) for a, b, place in zip(cuts, cuts[1:], places, strict=False))
        return node

    def packed(self) -> tuple[bytes, bytes]:
        """Nodes and order as bytes; children are those nodes, in order, that name the node as their parent."""
        parent = np.full(len(self.centre), -1.0)
        for node, below in enumerate(self.children):
            parent[list(below)] = node
        return np.column_stack([self.centre, self.radius, self.start, self.end, parent]).astype(np.float64).tobytes(), self.order.astype(np.int64).tobytes()

    @classmethod
    def unpacked(cls, points: np.ndarray, nodes: bytes, order: bytes) -> Tree:
        tree = cls(points[:0])
        tree.points, tree.order = points.astype(np.float64), np.frombuffer(order, np.int64)
        centre, radius, start, end, parent = np.frombuffer(nodes, np.float64).reshape(-1, 5).T
        tree.centre, tree.radius, tree.start, tree.end = centre.astype(np.int64), radius, start.astype(np.int64), end.astype(np.int64)
        tree.children = [() for _ in parent]
        for node, above in enumerate(parent.astype(np.int64)):
            if above >= 0:
                tree.children[above] += (node,)
        return tree


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, cut to the range of a long."""
    size = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    most = size(q) * size(p) * q.shape[1]
    if most < 1 << 53:
        return np.rint(q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return q @ p.T
    return np.clip(q.astype(object) @ p.T.astype(object), int(_LEAST) + 1, int(_MOST)).astype(np.int64)


class Search:
    """The k best points of each query so far (scores, ids and places of points), and the walk that betters them."""

    def __init__(self, queries: np.ndarray, worst: np.ndarray, k: int) -> None:
        self.queries, self.k, self.tree = queries, k, Tree(queries)
        self.score, self.id, self.row = (np.full((len(queries), k), x) for x in (_LEAST, _MOST, -1))
        self.known = worst.astype(np.float64)
        self.met = self.pruned = 0

    def walk(self, points: np.ndarray, ids: np.ndarray, tree: Tree) -> None:
        self.points, self.ids, self.other = points, ids, tree
        if not len(points) or not len(self.queries):
            return
        a, b = self.tree, tree
        self.norms = [np.sqrt((t.points[np.asarray(t.centre, np.int64)] ** 2).sum(1)) for t in (a, b)]
        self.dots = a.points[np.asarray(a.centre, np.int64)] @ b.points[np.asarray(b.centre, np.int64)].T
        self.worst = np.array([self.known[a.order[s:e]].min() for s, e in zip(a.start, a.end, strict=True)])
        self._pair(0, 0)

    def bound(self, a: int, b: int) -> float:
        spread = self.norms[0][a] * self.other.radius[b] + self.norms[1][b] * self.tree.radius[a] + self.tree.radius[a] * self.other.radius[b]
        return self.dots[a, b] + spread + 1 + 1e-9 * (self.norms[0][a] * self.norms[1][b] + spread)

    def _pair(self, a: int, b: int) -> None:
        self.met += 1
        if self.bound(a, b) < self.worst[a]:
            self.pruned += 1
            return
        mine, theirs = self.tree.children[a], self.other.children[b]
        if not mine and not theirs:
            self._leaves(a, b)
        elif mine and (not theirs or self.tree.radius[a] >= self.other.radius[b]):
            for child in mine:
                self._pair(child, b)
            self.worst[a] = min(self.worst[c] for c in mine)
        else:
            for child in sorted(theirs, key=lambda c: -self.bound(a, c)):
                self._pair(a, child)

    def _leaves(self, a: int, b: int) -> None:
        rows, held = self.tree.order[self.tree.start[a] : self.tree.end[a]], self.other.order[self.other.start[b] : self.other.end[b]]
        found = products(self.queries[rows], self.points[held])
        hit = found.max(1) >= np.maximum(self.score[rows, -1], self.known[rows])
        if hit.any():
            rows, found = rows[hit], found[hit]
            scores = np.concatenate([self.score[rows], found], 1)
            ids = np.concatenate([self.id[rows], np.broadcast_to(self.ids[held], found.shape)], 1)
            places = np.concatenate([self.row[rows], np.broadcast_to(held, found.shape)], 1)
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            i, j = np.nonzero(scores >= least[:, None])
            order = np.lexsort((ids[i, j], ~scores[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, rank = i[rank < self.k], j[rank < self.k], rank[rank < self.k]
            for kept, new in ((self.score, scores), (self.id, ids), (self.row, places)):
                kept[rows[i], rank] = new[i, j]
            last = self.score[rows, -1]
            self.known[rows] = np.maximum(self.known[rows], np.where(last > _LEAST, last.astype(np.float64), -np.inf))
        self.worst[a] = self.known[self.tree.order[self.tree.start[a] : self.tree.end[a]]].min()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _index(key: tuple, rows: pa.Table) -> pa.Table:
    """One row per chunk: its points, their ids and its tree."""
    points = _matrix(rows["vector"])
    nodes, order = Tree(points).packed()
    lists = rows["vec_ids"].combine_chunks()
    return pa.table({"cell": [key[0].as_py()], "chunk": [key[1].as_py()], "points": [points.tobytes()], "vec_ids": pa.ListArray.from_arrays([0, len(lists)], lists), "nodes": [nodes], "order": [order]}, schema=pa.schema([("cell", pa.int32()), ("chunk", pa.int32()), ("points", pa.binary()), ("vec_ids", pa.list_(lists.type)), ("nodes", pa.binary()), ("order", pa.binary())]))


_FOUND = "query long, vec_ids array<long>, score long"


def _search(k: int):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out = {"query": pa.array([], pa.int64()), "vec_ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.int64())}
        if len(queries) and len(index):
            q, worst = _matrix(queries["vector"]), queries["worst"].to_numpy()
            p = np.frombuffer(index["points"][0].as_py(), np.int64).reshape(-1, q.shape[1])
            lists = index["vec_ids"].combine_chunks().flatten()
            first = lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]
            search = Search(q, worst, k)
            search.walk(p, first, Tree.unpacked(p, index["nodes"][0].as_py(), index["order"][0].as_py()))
            some = search.row >= 0
            owner = np.repeat(queries["query"].to_numpy(), some.sum(1))
            out = {"query": pa.array(owner, pa.int64()), "vec_ids": lists.take(pa.array(search.row[some])), "score": pa.array(search.score[some])}
        return pa.table(out)

    return run


def _nearest_centre(centres: np.ndarray):
    """Adds cell and distance to batches with a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centres * centres).sum(1)
        for batch in batches:
            x = _matrix(batch.column("vector")).astype(np.float64)
            cell = (squares - 2 * x @ centres.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - centres[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _cells_within_reach(centres: np.ndarray, radius: np.ndarray):
    """(query, vector, worst, seed, cell): the cells that may hold a score of ``worst`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.sqrt((centres * centres).sum(1))
        for batch in batches:
            q = _matrix(batch.column("vector")).astype(np.float64)
            if not len(q):
                continue
            size = np.sqrt((q * q).sum(1))[:, None]
            bound = q @ centres.T + size * radius + 1 + 1e-9 * size * (norms + radius)
            rows, cells = np.nonzero((bound >= batch.column("worst").to_numpy()[:, None]) & (radius >= 0))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest integer inner product for each vec_id divisible by ``every``."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", real))
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("vector"))
    longest = usable.agg(F.max(F.size("vector"))).first()[0] or 0
    usable = usable.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("vector"))))
    first = Window.partitionBy("vector").orderBy("vec_id")
    least = usable.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k + 1)
    points = written(least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")))
    asked = usable.where(F.col("vec_id") % every == 0)
    named = written(asked.groupBy("vector").agg(F.min("vec_id").alias("query")))
    n_points = points.count()
    sample = points.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toArrow()
    sample = _matrix(sample["vector"]).astype(np.float64).reshape(-1, max(longest, 1))
    chosen, _, _ = greedy_net(sample, 0, min(CELLS, max(1, n_points // POINTS))) if len(sample) else ([], None, None)
    centres = sample[chosen] if chosen else np.zeros((1, max(longest, 1)))

    # the top level: cells with their true radii (one row per cell), and one stored tree per chunk
    dealt = written(points.select("vector", "vec_ids").mapInArrow(_nearest_centre(centres), "vector array<long>, vec_ids array<long>, cell int, away double"))
    radius, chunks = np.full(len(centres), -1.0), {}
    for cell, n, far in dealt.groupBy("cell").agg(F.count("*"), F.max("away")).collect():
        radius[cell], chunks[cell] = far, max(1, -(-n // POINTS))
    n_chunks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(chunks.items()) for x in kv]), F.col("cell")), F.lit(1)) if chunks else F.lit(1)
    chunk = F.pmod(F.xxhash64("vector"), n_chunks).cast("int")
    index_schema = "cell int, chunk int, points binary, vec_ids array<array<long>>, nodes binary, order binary"
    index = written(dealt.select("vector", "vec_ids", "cell", chunk.alias("chunk")).groupBy("cell", "chunk").applyInArrow(_index, index_schema))

    def searched(queries: DataFrame) -> DataFrame:
        """The best of (query, vector, worst, cell, chunk) in those chunks; queries of a chunk are cut into blocks."""
        counts = queries.groupBy("cell", "chunk").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_blocks"))
        keys = ["cell", "chunk", "block"]
        blocked = queries.join(F.broadcast(counts), ["cell", "chunk"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("_blocks")).cast("int")).drop("_blocks")
        spread = index.join(F.broadcast(counts), ["cell", "chunk"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        return written(blocked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_search(k + 1), _FOUND))

    home = named.mapInArrow(_nearest_centre(centres), "vector array<long>, query long, cell int, away double").drop("away")
    home = written(home.withColumn("chunk", F.pmod(F.xxhash64("query"), n_chunks).cast("int")))
    seeds = searched(home.withColumn("worst", F.lit(float("-inf"))))
    kth = seeds.groupBy("query").agg(F.when(F.count("*") > k, F.min("score").cast("double")).otherwise(float("-inf")).alias("worst"))
    known = home.select("query", "vector", F.struct("cell", "chunk").alias("seed")).join(kth, "query")
    reach = known.mapInArrow(_cells_within_reach(centres, radius), "query long, vector array<long>, seed struct<cell:int,chunk:int>, worst double, cell int")
    rest = reach.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks.cast("int") - 1))).where(F.struct("cell", "chunk") != F.col("seed"))
    near = seeds.union(searched(written(rest.select("query", "vector", "worst", "cell", "chunk"))))

    # a point's ids are spread out first; k + 1 ids of all of a query's points hold the k that are left without its own
    listed = near.select("query", "score", F.explode("vec_ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    listed = listed.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k + 1).drop("_place")
    every_query = asked.join(named, "vector").select(F.col("vec_id").alias("query_id"), "query")
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = every_query.join(listed, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
