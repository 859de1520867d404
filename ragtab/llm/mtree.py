"""Exact top-k search of inner products in M-trees of paged metric nodes, best first.

Components become integers x = floor(1024 * c); a score is an integer inner product. Adding the
coordinate sqrt(B - x.x) to every candidate (B: the largest x.x) and 0 to a query makes the Euclidean
distance metric and monotone in the score: d(q, x)^2 = q.q + B - 2 q.x, so the highest scores are the
nearest neighbours.

Index. Candidates are dealt to the nearest of at most ``ROOTS`` routing objects (a sample by hash, used
for the layout only), and each routing object's rows by a count to subtrees of about ``SUBTREE`` rows, so
a crowded region becomes several subtrees of one routing object. A subtree is bulk-loaded in a task:
leaf pages of up to ``PAGE`` entries around routing objects, inner pages of up to ``FAN`` leaf pages; each
page has its covering radius and its distance to the page above, each entry its distance to the leaf's
routing object. A subtree is a row of a stored table.

Search. A block of queries (bounded in bytes) is broadcast. For each query a subtree's pages are visited nearest bound first. With r the distance of the k-th best
score so far, a page or entry is skipped without computing its distance if |d(q, parent) - d(parent, it)|
less its radius exceeds r, after computing it if d(q, it) less its radius does, and the visit ends when
the nearest waiting page does. The first round visits the subtrees of each query's nearest routing object
and gives every query a k-th best score; the second starts from that and visits all other subtrees. Only
distances that are proven worse are skipped, with a margin far over rounding; scores are exact.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as filled with zeros; components and scores beyond 64-bit integers saturate; a query's own
rows are those with its vec_id; a row with a null vec_id is no query and, as a candidate, comes last among
ties; rows that repeat a vec_id and vector are a candidate each, and one query; two vectors under one
query's id are two queries under it; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .whitening import integers as scaled_integers
from .whitening import usable

SCALE = 1024
#: Routing objects at the top, at most; rows of a subtree, about; entries of a leaf page; pages of an inner page.
ROOTS, SUBTREE, PAGE, FAN = 512, 8192, 256, 16
#: Bytes of a block of queries that is broadcast.
BLOCK_BYTES = 16 << 20
#: Of a distance's scale, what rounding may be off by, and far more.
MARGIN = 1e-6
PAGES = ("subtree long, root int, radius double, ids binary, no_id binary, x binary, width int, to_leaf binary, leaf_start binary, leaf_at binary, "
         "leaf_radius binary, leaf_to_inner binary, inner_start binary, inner_at binary, inner_radius binary, inner_to_root binary")


def integers(vectors: pa.Array, dims: int) -> np.ndarray:
    return scaled_integers(vectors, dims, SCALE)


def squares(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.einsum("ij,ij->i", x, x)


def augmented(x: np.ndarray, bound: float) -> np.ndarray:
    """Candidates with the coordinate that gives all of them the same length."""
    return np.column_stack([x.astype(np.float64), np.sqrt(np.maximum(bound - squares(x), 0.0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b."""
    d = squares(a)[:, None] + squares(b)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def routing_objects(rows: DataFrame, dims: int, count: int) -> np.ndarray:
    """At most ``count`` vectors, drawn by hash, without the repeated ones."""
    drawn = rows.select(F.xxhash64("embedding").alias("h"), "embedding").groupBy("h").agg(F.first("embedding").alias("embedding"))
    found = drawn.orderBy("h").limit(count).select("embedding").toArrow()["embedding"]
    return np.unique(integers(found, dims), axis=0)


def spread(n: int, of: int) -> np.ndarray:
    """n places spread over a range."""
    return np.unique(np.linspace(0, of - 1, n).astype(np.int64))


def dealt(items: np.ndarray, size: int) -> tuple[list[np.ndarray], list[int]]:
    """Items dealt to the nearest of about len / size of them, groups of over 2 size cut; each group's routing item."""
    heads = spread(-(-len(items) // size), len(items))
    nearest = distances(items, items[heads]).argmin(axis=1)
    groups, of = [], []
    for k, head in enumerate(heads):
        members = np.flatnonzero(nearest == k)
        for part in np.array_split(members, -(-len(members) // (2 * size))) if len(members) else ():
            groups.append(part)
            of.append(int(head))
    return groups, of


def build(subtree: int, root: int, ids: np.ndarray, no_id: np.ndarray, x: np.ndarray, centre: np.ndarray, bound: float) -> dict:
    """A subtree's pages as flat arrays: entries by leaf, leaves by inner page."""
    points = augmented(x, bound)
    leaves, of_leaf = dealt(points, PAGE)
    inners, of_inner = dealt(points[of_leaf], FAN)
    leaf_order = np.concatenate(inners)
    entry_order = np.concatenate([leaves[k] for k in leaf_order])
    heads = np.array(of_leaf)[leaf_order]
    inner_heads = np.array(of_leaf)[of_inner]
    leaf_sizes = np.array([len(leaves[k]) for k in leaf_order])
    inner_sizes = np.array([len(g) for g in inners])
    leaf_of, inner_of = np.repeat(np.arange(len(heads)), leaf_sizes), np.repeat(np.arange(len(inners)), inner_sizes)
    to_leaf = np.sqrt(squares(points[entry_order] - points[heads][leaf_of]))
    starts = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    leaf_start, inner_start = starts(leaf_sizes), starts(inner_sizes)
    to_inner = np.sqrt(squares(points[entry_order] - points[inner_heads][inner_of][leaf_of]))
    wide = int(max(-int(x.min()), int(x.max())))
    kind = next(t for t in (np.int16, np.int32, np.int64) if wide <= np.iinfo(t).max)
    return {"subtree": subtree, "root": root, "radius": float(np.sqrt(squares(points - centre)).max()), "ids": ids[entry_order], "no_id": no_id[entry_order],
            "x": x[entry_order].astype(kind), "width": np.dtype(kind).itemsize, "to_leaf": to_leaf, "leaf_start": leaf_start,
            "leaf_at": heads_in(entry_order, heads), "leaf_radius": np.maximum.reduceat(to_leaf, leaf_start[:-1]),
            "leaf_to_inner": np.sqrt(squares(points[heads] - points[inner_heads][inner_of])), "inner_start": inner_start,
            "inner_at": heads_in(entry_order, inner_heads), "inner_radius": np.maximum.reduceat(to_inner, leaf_start[inner_start[:-1]]),
            "inner_to_root": np.sqrt(squares(points[inner_heads] - centre))}


def heads_in(order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where the items ``heads`` stand in ``order``."""
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return at[heads]


class Subtree:
    """The pages of a stored row."""

    def __init__(self, row: dict, dims: int, bound: float):
        get = lambda c, t=np.float64: np.frombuffer(row[c], t)
        self.ids, self.no_id = get("ids", np.int64), get("no_id", bool)
        self.x = get("x", np.dtype(f"i{row['width']}")).reshape(-1, dims)
        self.wide = int(max(-int(self.x.min()), int(self.x.max())))
        self.real = self.x.astype(np.float64)
        self.to_leaf, self.radius, self.root, self.bound = get("to_leaf"), row["radius"], row["root"], bound
        self.leaf_start, self.leaf_at, self.leaf_radius, self.leaf_to_inner = get("leaf_start", np.int64), get("leaf_at", np.int64), get("leaf_radius"), get("leaf_to_inner")
        self.inner_start, self.inner_at, self.inner_radius, self.inner_to_root = get("inner_start", np.int64), get("inner_at", np.int64), get("inner_radius"), get("inner_to_root")


class Best:
    """The k best (score, id) of a query, falling by score, then by id, null ids last."""

    def __init__(self, query_id: int, x: np.ndarray, bound: float, k: int, least: int | None):
        self.id, self.x, self.real, self.k = query_id, x, x.astype(np.float64), k
        self.wide = int(max(-int(x.min()), int(x.max())))
        self.scale = float(self.real @ self.real) + bound
        self.margin = MARGIN * self.scale ** 0.5
        self.scores, self.no_id, self.ids = [], [], []
        self.least = least  # a score that k candidates reach, if known
        self.computed = 0
        self.reach = self._reach()

    def _reach(self) -> float:
        """The distance over which nothing can be among the best."""
        if self.least is None:
            return float("inf")
        return max(self.scale - 2.0 * float(self.least), 0.0) ** 0.5 + self.margin

    def distances(self, tree: Subtree, at: np.ndarray) -> np.ndarray:
        self.computed += len(at)
        return np.sqrt(np.maximum(self.scale - 2.0 * (tree.real[at] @ self.real), 0.0))

    def offer(self, tree: Subtree, at: np.ndarray) -> None:
        """Scores of the entries, exact; those that are among the best stay."""
        self.computed += len(at)
        if tree.wide * self.wide * len(self.x) < 1 << 53:
            scores = (tree.real[at] @ self.real).astype(np.int64)
        else:
            scores = tree.x[at].astype(object) @ self.x.astype(object)
        good = (tree.ids[at] != self.id) | tree.no_id[at]
        if self.least is not None:
            good &= (scores >= self.least).astype(bool)
        if not good.any():
            return
        at = at[good]
        rows = [*zip(self.scores, self.no_id, self.ids, strict=True), *zip(scores[good].tolist(), tree.no_id[at].tolist(), tree.ids[at].tolist(), strict=True)]
        rows = heapq.nsmallest(self.k, rows, key=lambda r: (-r[0], r[1], r[2]))
        self.scores, self.no_id, self.ids = map(list, zip(*rows, strict=True))
        if len(rows) == self.k and (self.least is None or self.scores[-1] > self.least):
            self.least = self.scores[-1]
            self.reach = self._reach()


def search(tree: Subtree, query: Best, to_root: float) -> None:
    """Visits the subtree's pages, the one with the nearest bound first."""
    if to_root - tree.radius > query.reach:
        return
    waiting: list[tuple[float, int, int, float]] = []  # bound, 0 (inner) or 1 (leaf), page, distance of its routing object

    def add(level: int, pages: np.ndarray, at: np.ndarray, radius: np.ndarray, to_parent: np.ndarray, d_parent: float) -> None:
        near = np.abs(d_parent - to_parent) - radius <= query.reach  # known without computing a distance
        pages, radius = pages[near], radius[near]
        if not len(pages):
            return
        d = query.distances(tree, at[near])
        for low, page, dist in zip(np.maximum(d - radius, 0.0).tolist(), pages.tolist(), d.tolist(), strict=True):
            if low <= query.reach:
                heapq.heappush(waiting, (low, level, page, dist))

    add(0, np.arange(len(tree.inner_at)), tree.inner_at, tree.inner_radius, tree.inner_to_root, to_root)
    while waiting:
        low, level, page, dist = heapq.heappop(waiting)
        if low > query.reach:
            return
        if level == 0:
            part = slice(tree.inner_start[page], tree.inner_start[page + 1])
            add(1, np.arange(part.start, part.stop), tree.leaf_at[part], tree.leaf_radius[part], tree.leaf_to_inner[part], dist)
        else:
            start, stop = tree.leaf_start[page], tree.leaf_start[page + 1]
            at = start + np.flatnonzero(np.abs(dist - tree.to_leaf[start:stop]) <= query.reach)
            if len(at):
                query.offer(tree, at)


class Index:
    """Subtrees of all vectors in a stored table, with the routing objects at the top."""

    def __init__(self, pages: DataFrame, roots: np.ndarray, dims: int, bound: float):
        self.pages, self.roots, self.dims, self.bound = pages, roots, dims, bound

    @classmethod
    def of(cls, rows: DataFrame, subtree: int = SUBTREE) -> Index | None:
        """The index of the rows (vec_id, embedding) that take part; None if there are none."""
        spark = rows.sparkSession
        rows = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
        dims, n = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
        if not dims:
            return None
        length = F.aggregate("embedding", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(2)))
        bound = float(rows.agg(F.max(length)).first()[0]) * (1 + 1e-9) + 1.0
        roots = routing_objects(rows, dims, min(ROOTS, -(-n // subtree)))
        shared = spark.sparkContext.broadcast(augmented(roots, bound))

        def nearest(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    d = distances(augmented(integers(part.column(1), dims), bound), shared.value)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d.argmin(axis=1).astype(np.int32))], ["vec_id", "embedding", "root"])

        kind = rows.schema["embedding"].dataType.simpleString()
        near = stored(rows.mapInArrow(nearest, f"vec_id long, embedding {kind}, root int").withColumn("serial", F.monotonically_increasing_id()), "mtree-rows")
        counts = near.groupBy("root").agg(F.count(F.lit(1)).alias("n"))  # a row for each routing object
        first, many, total = {}, {}, 0
        for r in counts.orderBy("root").collect():
            first[r["root"]], many[r["root"]] = total, -(-r["n"] // subtree)
            total += many[r["root"]]
        size = F.array(*(F.lit(many.get(k, 1)) for k in range(len(roots))))[F.col("root")]
        start = F.array(*(F.lit(first.get(k, 0)) for k in range(len(roots))))[F.col("root")]
        keyed = near.withColumn("subtree", (start + F.pmod(F.xxhash64("serial"), size)).cast("long"))

        def load(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            root = table["root"][0].as_py()
            ids = table["vec_id"].combine_chunks()
            row = build(table["subtree"][0].as_py(), root, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                        integers(table["embedding"], dims), shared.value[root], bound)
            return pa.table({c: [v.tobytes() if isinstance(v, np.ndarray) else v] for c, v in row.items()}, schema=schema)

        fields = [f.strip().rsplit(" ", 1) for f in PAGES.split(", ")]
        of_name = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        schema = pa.schema([(c, of_name[t]) for c, t in fields])
        parts = max(1, min(total, 4 * spark.sparkContext.defaultParallelism + total // 8))
        pages = keyed.repartition(parts, "subtree").groupBy("subtree").applyInArrow(load, PAGES)
        return cls(stored(pages, "mtree-pages"), roots, dims, bound)

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id, score of the k best candidates of every row (vec_id, embedding) of ``queries``, in blocks
        of queries."""
        queries = usable(queries.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
        queries = stored(queries.distinct(), "mtree-queries")
        each = 8 * (self.dims + 32)
        blocks = -(-queries.count() * each // BLOCK_BYTES)
        keyed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(1, blocks))))
        found = [self._block(keyed.filter(F.col("block") == k_block).select("vec_id", "embedding"), k) for k_block in range(blocks)]
        out = found[0] if found else None
        for more in found[1:]:
            out = out.union(more)
        return out if out is not None else queries.sparkSession.createDataFrame([], RESULT)

    def _block(self, queries: DataFrame, k: int) -> DataFrame:
        """The result for queries whose bytes are bounded."""
        spark = self.pages.sparkSession
        table = queries.orderBy("vec_id", "embedding").toArrow().combine_chunks()  # BLOCK_BYTES at most
        ids, x, dims, bound = table["vec_id"].to_numpy(), integers(table["embedding"], self.dims), self.dims, self.bound
        points, tops = np.column_stack([x.astype(np.float64), np.zeros(len(x))]), augmented(self.roots, bound)
        home = np.concatenate([np.zeros(0, np.int64), *(distances(points[at:at + 4096], tops).argmin(axis=1) for at in range(0, len(x), 4096))])
        shared = spark.sparkContext.broadcast((ids, x, points, home, tops))

        def visit(at_home: bool, least: dict):
            known = spark.sparkContext.broadcast(least)

            def run(batches: Iterator[pa.RecordBatch]):
                ids, x, points, home, tops = shared.value
                best: dict[int, Best] = {}
                reach = np.full(len(ids), np.inf)
                for q, score in known.value.items():
                    best[q] = Best(int(ids[q]), x[q], bound, k, score)
                    reach[q] = best[q].reach
                for b in batches:
                    for row in b.to_pylist():
                        tree = Subtree(row, dims, bound)
                        to_root = distances(points, tops[tree.root:tree.root + 1])[:, 0]
                        for q in np.flatnonzero(((home == tree.root) == at_home) & (to_root - tree.radius <= reach)).tolist():
                            if q not in best:
                                best[q] = Best(int(ids[q]), x[q], bound, k, None)
                            search(tree, best[q], float(to_root[q]))
                            reach[q] = best[q].reach
                rows = [(q, b.id, i, score, lost) for q, b in best.items() for score, lost, i in zip(b.scores, b.no_id, b.ids, strict=True)]
                low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
                for at in range(0, len(rows), 10_000):
                    q, query_id, i, score, lost = zip(*rows[at:at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(q, pa.int32()), pa.array(query_id, pa.int64()), pa.array([None if gone else v for v, gone in zip(i, lost, strict=True)], pa.int64()),
                        pa.array([min(max(s, low), high) for s in score], pa.int64())], ["q", "query_id", "vec_id", "score"])

            return self.pages.mapInArrow(run, "q int, query_id long, vec_id long, score long")

        near = stored(visit(True, {}), "mtree-near")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        kth = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("q", "score")
        least = {r["q"]: r["score"] for r in kth.collect()}  # one a query of the block
        rows = near.union(visit(False, least)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return rows.select("query_id", "rank", "vec_id", "score")


RESULT = "query_id long, rank int, vec_id long, score long"


def exact_top_k(rows: DataFrame, of: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` highest scores of every row whose vec_id is divisible by ``of``, among all other rows."""
    index = Index.of(rows)
    if index is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    return index.top_k(rows.filter(F.col("vec_id") % of == 0), k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.x, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
      FROM q JOIN v ON v.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
"""
