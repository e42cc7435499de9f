"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is filed in a leaf. A query walks the tree through
a priority queue, always opening the node whose centre has the largest inner product with it, until it
has met enough leaves. How many are enough is calibrated: a few queries are compared with every vector,
and the number of leaves is widened until their mean recall reaches the target (all leaves, if need be).

Equal vectors are one entry with their k + 1 smallest ids, of which no more can matter. Leaves stand on
shelves; a query goes once to each shelf where it visits leaves and brings back its best there. Shelves
and the queries that visit them are cut into blocks of bounded size, so a full or popular one spreads.

Vectors that are null or zero, hold null or non-finite components, have no id or another length than
most take no part, neither as queries nor as candidates. Repeated rows count once. Ties go to the
smaller id. Very long vectors are vectors like others, read in Arrow batches. Fewer candidates than k give
fewer rows; an empty table gives an empty one. Only the two named columns are read, whatever others are
named.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

#: Vectors that the tree is fitted on and queries that calibrate it, at most: those of smallest hashes.
SAMPLE, CALIBRATION = 20_000, 128
BRANCHES, LEAF_ROWS, MAX_LEAVES = 16, 512, 4_096
RECALL = 0.96
#: Neighbouring leaves share a shelf of about so many vectors (a fuller leaf has several blocks), and so
#: many queries that visit a shelf make a block.
SHELF, ASKS = 8_192, 2_048


class Tree:
    """Centres and children of the nodes; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaves: int, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []  # of the children of each inner node
        self.children: list[np.ndarray] = []  # inner nodes as numbers >= 0, leaves as -1 - leaf
        self.leaves = 0
        self.root = self._build(points, leaves)

    def _build(self, points: np.ndarray, leaves: int) -> int:
        k = min(BRANCHES, leaves, len(points))
        if k < 2 or (points == points[0]).all():
            self.leaves += 1
            return -self.leaves
        centres = points[np.sort(self.rng.choice(len(points), k, replace=False))].copy()
        for _ in range(10):
            near = self._nearest(points, centres)
            for c in range(k):
                if (mine := near == c).any():
                    centres[c] = points[mine].mean(0)
        near = self._nearest(points, centres)
        used = [c for c in range(k) if (near == c).any()]
        if len(used) < 2:
            self.leaves += 1
            return -self.leaves
        at = len(self.centres)
        self.centres.append(centres[used])
        self.children.append(np.empty(0, np.int64))
        self.children[at] = np.array([self._build(points[near == c], max(1, round(leaves * (near == c).mean()))) for c in used])
        return at

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres**2).sum(1) - 2 * (points @ centres.T), axis=1)

    def file(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        out, todo = np.empty(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            near = self._nearest(points[rows], self.centres[node])
            todo += [(int(child), rows[near == c]) for c, child in enumerate(self.children[node]) if (near == c).any()]
        return out

    def visit(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        queue, out = [(0.0, self.root)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
            else:
                for score, child in zip((self.centres[node] @ query).tolist(), self.children[node].tolist(), strict=True):
                    heapq.heappush(queue, (-score, child))
        return out


def _matrix(column) -> np.ndarray:
    """Rows of a list column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(queries: np.ndarray, vectors: np.ndarray, firsts: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, vector rows and scores of each query's k best, ties to the smaller first id. Scores
    are summed row by row in one order, so equal vectors get equal ones wherever they stand."""
    if len(queries) > 256:
        parts = [_best(queries[i : i + 256], vectors, firsts, k, None if allowed is None else allowed[i : i + 256]) for i in range(0, len(queries), 256)]
        return np.concatenate([p[0] + 256 * i for i, p in enumerate(parts)]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    rough = queries @ vectors.T
    if allowed is not None:
        rough[~allowed] = -np.inf
    k = min(k, len(vectors))
    least = np.partition(rough, len(vectors) - k, axis=1)[:, len(vectors) - k, None]
    slack = 1e-9 * (np.abs(queries) @ np.abs(vectors).max(0))[:, None]
    q, v = np.nonzero((rough >= least - slack) & (rough > -np.inf))
    exact = np.concatenate([(queries[q[i : i + 65536]] * vectors[v[i : i + 65536]]).sum(1) for i in range(0, len(q), 65536)] or [np.empty(0)])
    order = np.lexsort((firsts[v], -exact, q))
    q, v, exact = q[order], v[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], v[place < k], exact[place < k]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding, entry (128 bits of hash of the vector) of the rows that take part."""
    # Two hashes of different seeds, -0.0 read as 0.0.
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))
    entry = F.concat(F.hex(F.xxhash64(plain)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), plain)))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows.limit(0).withColumn("entry", entry)
    return rows.where(F.size("embedding") == sizes[0].d).withColumn("entry", entry)


def search(vectors: DataFrame, is_query: Callable[[], Column], k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows found of every query row."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    by_id = Window.partitionBy("entry").orderBy("vec_id")
    few = rows.withColumn("_at", F.dense_rank().over(by_id)).where(F.col("_at") <= k + 1)
    entries = few.groupBy("entry").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("v"))
    entries = stored(entries, "ann-entries")
    queries = stored(rows.where(is_query()).select(F.col("vec_id").alias("query_id"), "entry").distinct(), "ann-queries")
    out = "query_id long, rank int, vec_id long, score double"
    n = entries.count()
    if not n:
        return spark.createDataFrame([], out)
    sample = entries.orderBy(F.xxhash64("entry", F.lit(1)), "entry").limit(SAMPLE).select("v").toArrow()
    tree = Tree(_matrix(sample["v"]), min(MAX_LEAVES, max(1, min(16, n // 16), n // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(tree)  # MAX_LEAVES centres or so

    def file(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.file(_matrix(b.column(2)))), *b.columns], ["leaf", "entry", "ids", "v"])

    kind = entries.schema["v"].dataType.simpleString()
    filed = stored(entries.select("entry", "ids", "v").mapInArrow(file, f"leaf long, entry string, ids array<long>, v {kind}"), "ann-filed")
    asked = stored(queries.select("entry").distinct().join(entries.select("entry", "v"), "entry"), "ann-asked")
    visits = _calibrate(asked, filed, tree, k, recall)

    sizes = dict.fromkeys(range(tree.leaves), 0) | {r.leaf: r["count"] for r in filed.groupBy("leaf").count().collect()}  # a row for each leaf
    before = np.cumsum([0, *(sizes[i] for i in range(tree.leaves))])
    shelf_of = np.unique(before[:-1] // SHELF, return_inverse=True)[1]
    shelved = spark.sparkContext.broadcast(shelf_of)

    def visit(batches):
        for b in batches:
            out = []
            for at, q in enumerate(_matrix(b.column(1))):
                by_shelf: dict[int, list[int]] = {}
                for leaf in shared.value.visit(q, visits):
                    by_shelf.setdefault(int(shelved.value[leaf]), []).append(leaf)
                out += [(shelf, at, leaves) for shelf, leaves in by_shelf.items()]
            at = pa.array([x[1] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["shelf", "entry", "v", "leaves"]
            )

    visiting = stored(asked.mapInArrow(visit, f"shelf long, entry string, v {kind}, leaves array<long>"), "ann-visits")
    asks = {r.shelf: -(-r["count"] // ASKS) for r in visiting.groupBy("shelf").count().collect()}  # a row for each shelf
    rows_in = np.bincount(shelf_of, [sizes[i] for i in range(tree.leaves)])
    blocks = {"rows": [max(1, -(-int(n) // SHELF)) for n in rows_in], "asks": [asks.get(i, 1) for i in range(len(rows_in))]}
    cut = lambda which: F.get(F.lit(blocks[which]), F.col("shelf").cast("int"))
    own = lambda which: F.pmod(F.xxhash64("entry", F.lit(2)), cut(which))
    every = lambda which: F.explode(F.sequence(F.lit(0).cast("long"), (cut(which) - 1).cast("long")))
    left = filed.withColumn("shelf", F.get(F.lit([int(x) for x in shelf_of]), F.col("leaf").cast("int")).cast("long"))
    left = left.withColumn("a", own("rows").cast("long")).withColumn("b", every("asks"))
    right = visiting.withColumn("b", own("asks").cast("long")).withColumn("a", every("rows"))
    schema = pa.schema([("ask", pa.string()), ("entry", pa.string()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def compare(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return schema.empty_table()
        rows, asks = rows.combine_chunks(), asks.combine_chunks()
        offsets = rows["ids"].chunk(0).offsets.to_numpy()
        firsts = rows["ids"].chunk(0).values.to_numpy()[offsets[:-1]]
        names, leaf = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
        wanted = asks["leaves"].chunk(0)
        row = np.repeat(np.arange(asks.num_rows), np.diff(wanted.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(names, wanted.flatten().to_numpy()), len(names) - 1)
        visited = np.zeros((asks.num_rows, len(names)), bool)
        visited[row, at] = names[at] == wanted.flatten().to_numpy()
        parts, step = [], 256
        queries, vectors = _matrix(asks["v"]), _matrix(rows["v"])
        for i in range(0, len(queries), step):
            q, v, score = _best(queries[i : i + step], vectors, firsts, k + 1, visited[i : i + step][:, leaf])
            parts.append((q + i, v, score))
        q, v, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        pick = pa.array(v)
        return pa.Table.from_arrays([asks["entry"].take(pa.array(q)), rows["entry"].take(pick), rows["ids"].take(pick), pa.array(score)], schema=schema)

    by = ("shelf", "a", "b")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "ask string, entry string, ids array<long>, score double")
    top = Window.partitionBy("ask").orderBy(F.desc("score"), F.col("ids")[0])
    best = met.withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= k + 1).select("ask", "score", F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("_at", F.row_number().over(nearest)).where(F.col("_at") <= k + 1).select("ask", "score", "vec_id")
    full = queries.join(best, queries["entry"] == best["ask"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(asked: DataFrame, filed: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit, so that the sampled queries find ``recall`` of their true neighbours."""
    chosen = asked.orderBy(F.xxhash64("entry", F.lit(3)), "entry").limit(CALIBRATION).select("entry", "v").toArrow()
    if not chosen.num_rows or tree.leaves == 1:
        return tree.leaves
    queries, own = _matrix(chosen["v"]), np.array(chosen["entry"].to_pylist(), object)
    shared = asked.sparkSession.sparkContext.broadcast((queries, own))

    def scan(batches):
        for b in batches:
            firsts = b.column(1).offsets.to_numpy()
            ids = b.column(1).values.to_numpy()[firsts[:-1]] if b.num_rows else np.empty(0, np.int64)
            if b.num_rows:
                asks, own = shared.value
                q, v, score = _best(asks, _matrix(b.column(2)), ids, k + 1)
                other = np.array(b.column(3).to_pylist(), object)[v] != own[q]  # a query does not look for itself
                q, v, score = q[other], v[other], score[other]
                yield pa.RecordBatch.from_arrays([pa.array(q), b.column(0).take(pa.array(v)), pa.array(score), pa.array(ids[v])], ["q", "leaf", "score", "first"])

    found = filed.select("leaf", "ids", "v", "entry").mapInArrow(scan, "q long, leaf long, score double, first long")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    truth = found.withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= k).select("q", "leaf").collect()  # k * CALIBRATION rows
    if not truth:
        return tree.leaves
    order = [{leaf: i for i, leaf in enumerate(tree.visit(q, tree.leaves))} for q in queries]
    needed = np.sort([order[r.q][r.leaf] + 1 for r in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
