"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

The upper part of the tree is fitted on a bounded sample of the vectors (``sample`` of them, by hash) and broadcast: its size depends on
the sample, not on the table. Its leaves are cells of about ``cell_rows`` vectors. Every vector of the table goes down to its cell, and
below it each cell is a k-means tree over all of its own vectors, down to leaves of ``leaf_rows``, in the task that has the cell. A cell
of more than twice ``cell_rows`` vectors is split by hash, each part with a tree of its own, and a query to it visits all parts.

A query has a priority queue over the upper tree: it holds the branches not yet taken, by the distance of their centroids, and
gives the cells in order of rank; within a cell the queue goes on over its tree. How many leaves a query visits in the
cell of each rank is calibrated on a sample of queries, whose exact neighbours are known from a pass over all vectors: the visits
are widened where they bring the most neighbours for each leaf, until the recall is reached (or all leaves are visited).

Equal vectors are at one place: of their ids only the k + 1 least can be neighbours of anything (ties go to the smaller id), so the others are
represented by these, whatever their number. The default sample suits tables of up to ``sample / 64 * cell_rows`` vectors (34 million);
beyond that more parts of cells are visited, unless the sample is raised.

Distance is Euclidean between vectors scaled to length 1 (cosine), or between the vectors as they are. Defined results: rows
whose id is null, or whose vector is null, empty, of another length than most, or has null or not finite numbers,
are not searched and have no neighbours; a vector of zeros stays as it is; repeated rows are no neighbours of each other (their ids are
equal), rows with equal vectors and other ids are, at distance 0; ties go to the smaller id; where there are fewer than k others, all
are listed; an empty table, or one without queries, gives no rows. Ids are integers or strings. Further columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import quoted, written

K = 10
RECALL = 0.95
CELL_ROWS = 16_384
LEAF_ROWS = 48
BRANCHES = 8
#: Vectors that the upper tree is fitted on, and queries that the search is calibrated on, at most.
SAMPLE, QUERIES = 131_072, 256
#: Vectors of the sample for each cell at least.
PER_CELL = 64


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of a to each of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


def nearest(a: np.ndarray, b: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """The row of b nearest to each row of a, a few rows of a at once."""
    step = max(1, most // max(1, len(b)))
    return np.concatenate([squares(a[i : i + step], b).argmin(1) for i in range(0, len(a), step)]) if len(a) else np.zeros(0, dtype=np.int64)


# The tree of a cell


class Tree:
    """A k-means tree over the rows of x."""

    def __init__(self, x: np.ndarray, leaf_rows: int, branches: int, seed: int) -> None:
        self.x, self.leaf_rows, self.branches, self.rng = x, leaf_rows, branches, np.random.default_rng(seed)
        self.centres: list[np.ndarray | None] = []
        self.kids: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        self.leaves = 0
        todo = [(self._node(), np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = self._split(rows) if len(rows) > leaf_rows else None
            if parts is None:
                self.rows[node] = rows
                self.leaves += 1
                continue
            self.kids[node] = [self._node() for _ in parts]
            self.centres[node] = np.stack([x[p].mean(0) for p in parts])
            todo += zip(self.kids[node], parts)

    def _node(self) -> int:
        self.centres.append(None)
        self.kids.append([])
        self.rows.append(None)
        return len(self.kids) - 1

    def _split(self, rows: np.ndarray) -> list[np.ndarray] | None:
        x = self.x[rows]
        centres = x[self.rng.choice(len(rows), self.branches, replace=False)]
        for _ in range(6):
            own = nearest(x, centres)
            centres = np.stack([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(self.branches)])
        own = nearest(x, centres)
        parts = [rows[own == k] for k in range(self.branches) if (own == k).any()]
        if len(parts) > 1:
            return parts
        # Equal vectors: any split is as good, and keeps leaves small.
        return [*np.array_split(rows, ceil(len(rows) / self.leaf_rows))] if len(rows) > self.leaf_rows * self.branches else None

    def finish(self) -> None:
        """Numbers the leaves, and puts all centroids into one matrix: each query meets them in one product."""
        self.leaf_of = [-1] * len(self.rows)
        self.leaf_list: list[np.ndarray] = []
        self.first = [0] * len(self.rows)
        stacked, at = [], 0
        for node, rows in enumerate(self.rows):
            if rows is not None:
                self.leaf_of[node] = len(self.leaf_list)
                self.leaf_list.append(rows)
            else:
                self.first[node] = at
                stacked.append(self.centres[node])
                at += len(self.kids[node])
        self.stack = np.concatenate(stacked) if stacked else None

    def down(self, q: np.ndarray) -> np.ndarray:
        """The leaf where each row of q ends, going to the nearest centroid each time."""
        out = np.zeros(len(q), dtype=np.int32)
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if not self.kids[node]:
                out[rows] = self.leaf_of[node]
                continue
            own = nearest(q[rows], self.centres[node])
            todo += [(kid, rows[own == k]) for k, kid in enumerate(self.kids[node]) if (own == k).any()]
        return out

    def ranked(self, q: np.ndarray, most: int) -> list[list[int]]:
        """The leaves of each row of q, best bin first."""
        return [self.order(d, most) for d in (squares(q, self.stack).tolist() if self.stack is not None else [[]] * len(q))]

    def order(self, d: list[float], leaves: int) -> list[int]:
        """The leaves that a query visits, best bin first. d: its distances to the stacked centroids."""
        kids, first, leaf_of = self.kids, self.first, self.leaf_of
        heap, out = [(0.0, 0)], []
        push, pop = heapq.heappush, heapq.heappop
        while heap and len(out) < leaves:
            node = pop(heap)[1]
            while kids[node]:
                at, low, next_node = first[node], None, -1
                for kid in kids[node]:
                    gap = d[at]
                    at += 1
                    if low is None:
                        low, next_node = gap, kid
                    elif gap < low:
                        push(heap, (low, next_node))
                        low, next_node = gap, kid
                    else:
                        push(heap, (gap, kid))
                node = next_node
            out.append(leaf_of[node])
        return out

    def search(self, q: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query (squared distances, rows, visits) of all it meets, padded with infinity: by leaf, so that vectors are compared in blocks."""
        leaves = min(leaves, self.leaves)
        visits = np.array(self.ranked(q, leaves), dtype=np.int64)
        widest = max(map(len, self.leaf_list))
        shape = (len(q), leaves, widest)
        d, rows = np.full(shape, np.inf, dtype=np.float32), np.zeros(shape, dtype=np.int32)
        by_leaf = np.argsort(visits, axis=None, kind="stable")
        flat = visits.reshape(-1)[by_leaf]
        bounds = np.searchsorted(flat, np.arange(self.leaves + 1))
        for leaf, members in enumerate(self.leaf_list):
            pairs = by_leaf[bounds[leaf] : bounds[leaf + 1]]
            if len(pairs):
                who, place = pairs // leaves, pairs % leaves
                d[who, place, : len(members)] = squares(q[who], self.x[members])
                rows[who, place, : len(members)] = members
        number = np.broadcast_to(np.arange(1, leaves + 1)[None, :, None], shape)
        return d.reshape(len(q), -1), rows.reshape(len(q), -1), number.reshape(len(q), -1)


def best(ids: np.ndarray, d: np.ndarray, me: object, k: int, repeated: bool = False) -> np.ndarray:
    """The places of the k nearest ids, without the query's own, ties by id. repeated: ids may occur more than once; each counts once."""
    at = np.flatnonzero((ids != me) & (d < np.inf))
    if len(at) > k and not repeated:
        at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
    at = at[np.lexsort((ids[at], d[at]))]
    if repeated:
        at = at[np.sort(np.unique(ids[at], return_index=True)[1])]
    return at[:k]


# The search


def named(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids, integers or strings, as an array that can be sorted."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=str)


def usable(vectors: DataFrame, queries: DataFrame | None, id_col: str, vec_col: str, cosine: bool) -> tuple[DataFrame, DataFrame]:
    """(id, v) of the rows that can be searched, and of the queries."""

    def fine(rows: DataFrame) -> DataFrame:
        v = rows.select(quoted(id_col).alias("id"), F.transform(quoted(vec_col), lambda x: x.cast("double")).alias("v"))
        return v.filter("id is not null and size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))

    every = fine(vectors)
    most = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = most["n"] if most is not None else 0

    def scaled(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.size("v") == size)
        if cosine:
            length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
            rows = rows.withColumn("length", length).withColumn("v", F.transform("v", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(x)))
        return rows.select("id", F.col("v").cast("array<float>").alias("v"))

    return scaled(every), scaled(every if queries is None else fine(queries))


def places(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors`` with only the k + 1 least ids of equal vectors. The limit is applied before the shuffle too."""
    same = W.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    return vectors.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy")


def fitted(vectors: DataFrame, count: int, cell_rows: int, sample: int) -> Tree:
    """The upper tree, from rows whose hash is low enough that there are about ``sample`` of them."""
    span = 1 << 40
    low = F.pmod(F.xxhash64("id", "v"), F.lit(span)) < int(span * min(1.0, sample / count))
    rows = vectors.filter(low).select("id", "v").toArrow()
    x, ids = matrix(rows.column("v").combine_chunks()) if len(rows) else np.zeros((0, 1), dtype=np.float32), named(rows.column("id"))
    x = x[np.lexsort((x[:, 0], ids))]
    cells = ceil(count / cell_rows)
    tree = Tree(x, max(PER_CELL, ceil(len(x) / cells)) if cells > 1 else max(1, len(x)), BRANCHES, 0)
    tree.finish()
    # The tree goes to the executors without the sample.
    tree.x = np.zeros((0, x.shape[1]), dtype=np.float32)
    tree.rows, tree.leaf_list = [], []
    return tree


def placed(vectors: DataFrame, tree: Tree, kind: str) -> DataFrame:
    """(cell, id, v) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.down(matrix(b.column(1)))), b.column(0), b.column(1)], ["cell", "id", "v"])

    return vectors.select("id", "v").mapInArrow(run, f"cell int, id {kind}, v array<float>")


def routed(queries: DataFrame, tree: Tree, visits: list[int], kind: str) -> DataFrame:
    """(cell, rank, id, v): each query once for each cell that it goes to. visits: leaves by rank."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)
    wanted = [r for r, n in enumerate(visits) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            near = np.array([x[: len(visits)] for x in shared.value.ranked(matrix(b.column(1)), len(visits))], dtype=np.int32)
            ranks = [r for r in wanted if r < near.shape[1]]
            row = pa.array(np.repeat(np.arange(len(b)), len(ranks)))
            yield pa.RecordBatch.from_arrays([pa.array(near[:, ranks].reshape(-1)), pa.array(np.tile(np.array(ranks, dtype=np.int32), len(b))), b.column(0).take(row), b.column(1).take(row)], ["cell", "rank", "id", "v"])

    return queries.select("id", "v").mapInArrow(run, f"cell int, rank int, id {kind}, v array<float>")


def visited(index: DataFrame, questions: DataFrame, parts: dict[int, int], visits: list[int], k: int, leaf_rows: int, kind: str) -> DataFrame:
    """(id, neighbour, distance, rank, visit): the best k in the leaves that each question visits in its cell; visit is the leaf's place in the visits.

    parts: of the cells that have more than one. questions and index have the cells.
    """
    of = F.lit(1)
    if parts:
        of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.col("cell")), of)
    data = index.select("cell", F.pmod(F.xxhash64("id", "v"), of).cast("int").alias("part"), F.lit(-1).alias("rank"), "id", "v")
    asked = questions.select("cell", F.explode(F.sequence(F.lit(0), of - 1)).alias("part"), "rank", "id", "v")

    def search(table: pa.Table) -> pa.Table:
        rank = table.column("rank").to_numpy()
        ids = named(table.column("id"))
        x = matrix(table.column("v").combine_chunks())
        order = np.lexsort((x[:, 0], ids, rank))  # the tree doesn't depend on the order in which rows arrive
        ids, x, rank = ids[order], x[order], rank[order]
        data, names = x[rank < 0], ids[rank < 0]
        out: list[tuple] = []
        if len(data) and len(data) < len(x):
            tree = Tree(data, leaf_rows, BRANCHES, int(table.column("cell")[0].as_py()))
            tree.finish()
            repeated = len(np.unique(names)) < len(names)
            for r in np.unique(rank[rank >= 0]).tolist():
                q, me, leaves = x[rank == r], ids[rank == r], visits[r]
                step = max(1, 4_000_000 // (min(leaves, tree.leaves) * max(map(len, tree.leaf_list))))
                for i in range(0, len(q), step):
                    d, rows, numbers = tree.search(q[i : i + step], leaves)
                    # Only what is as near as the k-th other can be among the best.
                    most = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k and not repeated else np.full(len(d), np.inf, dtype=np.float32)
                    who, where = np.nonzero((d <= most[:, None]) & (d < np.inf))
                    bounds = np.searchsorted(who, np.arange(len(d) + 1))
                    for j in range(len(d)):
                        near = where[bounds[j] : bounds[j + 1]]
                        near = near[best(names[rows[j, near]], d[j, near], me[i + j], k, repeated)]
                        out.append((me[i + j], names[rows[j, near]], d[j, near], numbers[j, near], r))
        sizes = [len(o[1]) for o in out]
        many = lambda i, empty: np.concatenate([o[i] for o in out]) if out else empty
        kind = table.schema.field("id").type
        return pa.table(
            {
                "id": pa.array(np.repeat(np.array([o[0] for o in out], dtype=ids.dtype), sizes), kind),
                "neighbour": pa.array(many(1, ids[:0]), kind),
                "distance": pa.array(np.sqrt(many(2, np.zeros(0))).astype(np.float64)),
                "rank": pa.array(np.repeat(np.array([o[4] for o in out], dtype=np.int32), sizes)),
                "visit": pa.array(many(3, np.zeros(0)).astype(np.int32)),
            }
        )

    return data.union(asked).groupBy("cell", "part").applyInArrow(search, f"id {kind}, neighbour {kind}, distance double, rank int, visit int")


def exact(queries: DataFrame, vectors: DataFrame, k: int, kind: str) -> DataFrame:
    """(id, neighbour, distance) of a bounded number of queries, by comparison with all vectors."""
    asked = queries.select("id", "v").collect()
    names = np.array([r["id"] for r in asked])
    q = vectors.sparkSession.sparkContext.broadcast((names, np.array([r["v"] for r in asked], dtype=np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = q.value
        for b in batches:
            if not len(b):
                continue
            ids = named(b.column(0))
            d = squares(x, matrix(b.column(1)))
            repeated = len(np.unique(ids)) < len(ids)
            got = [best(ids, row, me, k, repeated) for me, row in zip(names, d)]
            kind = b.schema.field(0).type
            columns = [pa.array(np.repeat(names, [len(at) for at in got]), kind), pa.array(ids[np.concatenate(got)], kind), pa.array(np.sqrt(np.concatenate([row[at] for row, at in zip(d, got)])).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "neighbour", "distance"])

    found = vectors.select("id", "v").mapInArrow(run, f"id {kind}, neighbour {kind}, distance double").groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    return found.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))).filter(F.col("place") <= k).drop("place")


def widened(hits: list[list[int]], wanted: int) -> list[int]:
    """Leaves to visit by rank, so that ``wanted`` hits are met. hits: for each rank the visits that met one.

    Each step widens the rank that brings the most hits for each further leaf.
    """
    hits = [sorted(x) for x in hits]
    visits, met, at = [0] * len(hits), 0, [0] * len(hits)
    while met < wanted:
        steps = [((i + 1 - at[r]) / (x[i] - visits[r]), -r, -x[i], i) for r, x in enumerate(hits) for i in range(at[r], len(x)) if i + 1 == len(x) or x[i + 1] > x[i]]
        if not steps:
            break
        _, r, n, i = max(steps)
        met += i + 1 - at[-r]
        at[-r], visits[-r] = i + 1, -n
    while visits and not visits[-1]:
        visits.pop()
    return visits or [1]


def calibrated(vectors: DataFrame, index: DataFrame, count: int, tree: Tree, parts: dict[int, int], k: int, recall: float, queries: int, leaf_rows: int, kind: str) -> list[int]:
    """The leaves by rank with which a sample of queries finds enough of its exact neighbours."""
    span = 1 << 40
    low = F.pmod(F.xxhash64("id", "v", F.lit(7)), F.lit(span)) < int(span * min(1.0, queries / count))
    sample = written(vectors.filter(low).dropDuplicates(["id"]), "queries")
    truth = written(exact(sample, vectors, k, kind), "truth")
    near = truth.select("id", F.col("neighbour").alias("other")).join(index.select(F.col("id").alias("other"), "cell"), "other").select("id", "cell").distinct().collect()  # of the sample only
    if not near:
        return [1]
    asked = {r["id"]: r["v"] for r in sample.collect()}
    ranks = {i: {c: r for r, c in enumerate(tree.ranked(np.array([v], dtype=np.float32), tree.leaves)[0])} for i, v in asked.items()}
    questions = vectors.sparkSession.createDataFrame([(r["cell"], ranks[r["id"]][r["cell"]], r["id"], asked[r["id"]]) for r in near], f"cell int, rank int, id {kind}, v array<float>")
    met = visited(index, questions, parts, [1 << 30] * tree.leaves, k, leaf_rows, kind).join(truth.select("id", "neighbour"), ["id", "neighbour"], "left_semi")
    hits: list[list[int]] = [[] for _ in range(tree.leaves)]
    for r in met.select("rank", "visit").collect():
        hits[r["rank"]].append(r["visit"])
    return widened(hits, min(sum(map(len, hits)), ceil(recall * truth.count())))


def neighbours(
    vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, recall: float = RECALL, cell_rows: int = CELL_ROWS,
    leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, calibration: int = QUERIES, cosine: bool = True,
) -> DataFrame:
    """The k nearest others, among ``vectors``, of every row of ``queries`` (of ``vectors``, if there are none): ``vec_id``, ``neighbour``, ``distance``, ``place`` from 1."""
    kind = vectors.schema[id_col].dataType.simpleString()
    spark = vectors.sparkSession
    fine, asked = usable(vectors, queries, id_col, vec_col, cosine)
    known = written(places(fine, k), "vectors")
    count = known.count()
    if not count:
        return spark.createDataFrame([], f"vec_id {kind}, neighbour {kind}, distance double, place int")
    tree = fitted(known, count, cell_rows, sample)
    index = written(placed(known, tree, kind), "index")
    large = index.groupBy("cell").count().filter(F.col("count") > 2 * cell_rows).collect()  # cells are as many as the sample allows
    parts = {r["cell"]: ceil(r["count"] / cell_rows) for r in large}
    visits = calibrated(known, index, count, tree, parts, k, recall, calibration, leaf_rows, kind)
    found = visited(index, routed(asked, tree, visits, kind), parts, visits, k, leaf_rows, kind)
    # A repeated query or neighbour is found more than once.
    found = found.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select(F.col("id").alias("vec_id"), "neighbour", "distance", "place")
