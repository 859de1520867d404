"""Nearest neighbours with an inverted-file (IVF) index and a stop bound.

1. MLlib ``KMeans`` learns ``nlist`` centroids (bounded by ``MAX_LISTS``) on a stated sample of at most
   ``TRAIN_ROWS`` vectors a list; every vector is put into the list of its nearest centroid, and each list
   knows its size and its radius (the largest distance of a member).
2. A query visits lists in the order of its distance to their centroids. After the first ``nprobe`` lists it
   knows a k-th best distance r; a further list is skipped if the distance to its centroid less its radius
   exceeds r (triangle inequality: it can't hold anything better), and the visit ends before the lists visited
   and skipped hold more than ``budget`` of all vectors. With ``budget=1`` the result is exact; on clustered
   vectors the bound ends most visits long before the budget does.
3. Lists are put together to units of at most ``block_rows`` vectors; a larger list is split into units of its own,
   so a list holding a third of the corpus is spread over many tasks. Candidates are scored exactly with the blocked
   kernel per (unit, query part). A query goes to a unit once, with a bit for each list that it visits there: what is
   shuffled grows with the units, not with the lists.

Distances are Euclidean; for the cosine, of vectors of unit length (a vector of zeros has none and is in no
list). Pairs are never Spark rows; only k rows per (query, block) leave a task. Recall is measured against
the exact search (``dense_topk``)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtab.functions.vectors import norm
from ragtab.operators.topk import BLOCK_BYTES, DenseKernel, _col, _matrix, _TopK
from ragtab.session import ensure_checkpoint_dir, sized_broadcast

#: Lists at most; vectors of the training sample for each list.
MAX_LISTS, TRAIN_ROWS = 1024, 256
HITS = "query_id long, doc_id long, score double, raw double"
#: Numbers of a matrix (queries x lists, or x dimensions) when visits are chosen: a batch of queries is taken in slices.
VISIT_CELLS = 1 << 20
#: Of distances, what rounding may be off by, and more.
MARGIN = 1e-6


def _vectors(df: DataFrame, ids: str, vec: str, name: str, metric: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    out = df.where(F.col(vec).isNotNull()).select(F.col(ids).cast("long").alias(name), v.alias("payload"))
    if metric == "cosine":
        out = out.withColumn("_n", norm("payload")).where((F.col("_n") > 0) & (F.col("_n") < float("inf")))
        out = out.select(name, F.transform("payload", lambda x: x / F.col("_n")).alias("payload"))
    return out


def _to_centroids(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None] - 2.0 * (x @ centroids.T)
    return np.sqrt(np.maximum(d, 0.0))


class IvfIndex:
    """Assigned vectors (did, payload, cluster), checkpointed; centroids, sizes and radii of the lists."""

    def __init__(self, corpus: DataFrame, nlist: int | None, *, doc_id: str, vec: str, metric: str, seed: int = 7, max_iter: int = 20):
        spark = corpus.sparkSession
        ensure_checkpoint_dir(spark)
        rows = _vectors(corpus, doc_id, vec, "did", metric)
        n = rows.count()
        nlist = max(1, min(nlist or math.isqrt(max(n, 1)), MAX_LISTS, max(n, 1)))
        feats = rows.select(array_to_vector("payload").alias("features"))
        share = min(1.0, TRAIN_ROWS * nlist / max(n, 1))
        sample = feats.sample(fraction=share, seed=seed) if share < 1 else feats
        self.metric, self.n = metric, n
        self.centroids = np.zeros((0, 1))  # of an empty corpus
        if n and nlist == 1:
            self.centroids = np.array([rows.first()["payload"]])
        elif n:
            model = KMeans(k=nlist, seed=seed, maxIter=max_iter).fit(sample)
            self.centroids = np.vstack([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
        shared = spark.sparkContext.broadcast(self.centroids)  # MAX_LISTS vectors at most

        def assign(batches):
            step = max(1, VISIT_CELLS // max(1, *shared.value.shape))
            for b in (x.slice(lo, step) for x in batches for lo in range(0, x.num_rows, step)):
                d = _to_centroids(_matrix(b.column(1)), shared.value)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int64)), pa.array(d[np.arange(len(at)), at])],
                                                 ["did", "payload", "cluster", "distance"])

        self.rows = rows.mapInArrow(assign, "did long, payload array<double>, cluster long, distance double").checkpoint(eager=True)
        stats = self.rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()  # a row a list
        self.sizes, self.radii = np.zeros(len(self.centroids), np.int64), np.zeros(len(self.centroids))
        for r in stats:
            self.sizes[r["cluster"]], self.radii[r["cluster"]] = r["n"], r["radius"]


def _units(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Lists put together to units of at most ``rows`` vectors, and a larger list cut to units of its own: the first unit and
    the number of units of each list, and the lists of each unit."""
    first, many, members, room = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [], 0
    for c, n in enumerate(sizes):
        if n == 0:
            continue
        many[c] = -(-n // rows)
        if many[c] > 1 or n > room:
            first[c], room = len(members), 0 if many[c] > 1 else rows
            members += [[] for _ in range(many[c])]
        else:
            first[c] = len(members) - 1
        for u in range(first[c], first[c] + many[c]):
            members[u].append(c)
        room -= min(room, n)
    return first, many, [np.array(m, np.int64) for m in members]


def _lists(index: IvfIndex, q: DataFrame, nprobe: int, budget: float, first: bool, units: tuple) -> DataFrame:
    """The units of lists that the queries (qid, payload, and reach: the k-th best distance so far) visit in the first or second
    round: a row for a query and a unit, with a bit for each list of the unit that is visited, and their vectors ``n``."""
    shared = q.sparkSession.sparkContext.broadcast((index.centroids, index.sizes, index.radii, units))
    most = budget * index.n

    def visits(batches):
        centroids, sizes, radii, (start, _, members) = shared.value
        step = max(1, min(VISIT_CELLS // max(1, len(sizes)), VISIT_CELLS // max(1, centroids.shape[1])))
        for whole in batches:
            for lo in range(0, whole.num_rows if len(sizes) else 0, step):
                b = whole.slice(lo, step)
                d = _to_centroids(_matrix(b.column(1)), centroids)
                order = np.argsort(d, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(order), 0), axis=1)
                take = place < nprobe
                if not first:
                    reach = b.column(2).to_numpy(zero_copy_only=False)
                    spent = np.empty_like(order)
                    np.put_along_axis(spent, order, np.cumsum(sizes[order], axis=1), axis=1)
                    take = ~take & (spent <= most) & (d - radii[None] <= reach[:, None] + MARGIN)
                for u, lists in enumerate(members):
                    row = np.flatnonzero(take[:, lists].any(axis=1))
                    if len(row):
                        bits = take[np.ix_(row, lists)]
                        n = bits @ np.where(start[lists] == u, sizes[lists], 0)  # of a list in several units, with the first
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array([u] * len(row), pa.int64()),
                             pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()), pa.array(n.astype(np.int64))],
                            ["qid", "payload", "unit", "lists", "n"])

    return q.mapInArrow(visits, "qid long, payload array<double>, unit long, lists binary, n long")


def _search(index: IvfIndex, q: DataFrame, k: int, exclude_self: bool, rows: int, units: tuple) -> DataFrame:
    """The k best of each (unit, query part) for the visits q (qid, payload, unit, lists)."""
    spark = q.sparkSession
    first, many, members = units
    parts = q.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("nq"))
    parts = F.broadcast(parts.checkpoint(eager=True))  # a row a unit
    places = spark.createDataFrame([(c, int(first[c]), int(n)) for c, n in enumerate(many) if n], "cluster long, first long, many long")
    docs = index.rows.join(F.broadcast(places), "cluster")  # MAX_LISTS rows at most
    docs = docs.withColumn("unit", F.col("first") + F.pmod(F.xxhash64("did"), F.col("many"))).join(parts, "unit").select(
        "did", "payload", "cluster", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("part"))
    q = q.join(parts, "unit").select("qid", "payload", "lists", "unit", F.pmod(F.xxhash64("qid"), F.col("nq")).alias("part"))
    kernel = DenseKernel(index.metric)

    def block(qt: pa.Table, dt: pa.Table) -> pa.Table:
        acc = _TopK(k)
        if qt.num_rows and dt.num_rows:
            lists = members[qt["unit"][0].as_py()]
            visited = np.frombuffer(b"".join(qt["lists"].to_pylist()), np.uint8).reshape(qt.num_rows, -1)
            visited = np.unpackbits(visited, axis=1)[:, :len(lists)].astype(bool)
            cluster, dids, D = _col(dt, "cluster"), _col(dt, "did"), _matrix(dt.column("payload"))
            there = [np.flatnonzero(cluster == c) for c in lists]
            kern = kernel.prepare(_col(qt, "qid"), qt.column("payload"))
            kern.score_visits(acc, visited, [dids[i] for i in there], [D[i] for i in there], exclude_self)
        return pa.Table.from_pandas(acc.frame(), preserve_index=False)

    return q.groupBy("unit", "part").cogroup(docs.groupBy("unit", "part")).applyInArrow(block, HITS).checkpoint(eager=True)


def ivf_topk(queries: DataFrame, corpus: DataFrame, k: int, *, nlist: int | None = None, nprobe: int = 3, budget: float = 0.75,
             metric: str = "cosine", query_id: str = "id", query_vec: str = "embedding",
             doc_id: str = "doc_id", doc_vec: str = "embedding", exclude_self: bool = False,
             block_rows: int = 50_000, seed: int = 7, report: bool = False):
    """query_id, doc_id, score, rank. ``nprobe`` lists are visited always, further ones by the bound and within ``budget`` (share
    of all vectors). With ``report`` also query_id and the share of vectors ``scored``."""
    index = IvfIndex(corpus, nlist, doc_id=doc_id, vec=doc_vec, metric=metric, seed=seed)
    q = _vectors(queries, query_id, query_vec, "qid", metric).checkpoint(eager=True)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    spread = math.isqrt(2 * q.sparkSession.sparkContext.defaultParallelism) + 1  # so that a small search has tasks for all cores
    rows = min(block_rows, max(1024, -(-index.n // spread)), max(1, BLOCK_BYTES // (8 * index.centroids.shape[1])))
    units = _units(index.sizes, rows)
    near = _lists(index, q.withColumn("reach", F.lit(0.0)), nprobe, budget, True, units).checkpoint(eager=True)
    found = _search(index, near, k, exclude_self, rows, units)
    squared = 2.0 - 2.0 * F.col("raw") if metric == "cosine" else (1.0 - F.col("raw")) * math.sqrt(2.0)
    kth = ranked(found).where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.sqrt(F.greatest(squared, F.lit(0.0))).alias("reach"))
    known = q.join(sized_broadcast(kth, 2_000_000), "qid", "left").select("qid", "payload", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    far = _lists(index, known, nprobe, budget, False, units).checkpoint(eager=True)
    hits = ranked(found.unionByName(_search(index, far, k, exclude_self, rows, units))).select("query_id", "doc_id", "score", "rank")
    if not report:
        return hits
    seen = near.unionByName(far).groupBy(F.col("qid").alias("query_id")).agg(
        F.round(F.sum("n") / F.lit(max(index.n, 1)), 6).alias("scored"))
    return hits, seen


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: share of the exact top-k found by the approximate search."""
    hit = exact.join(approx.select("query_id", "doc_id", F.lit(1).alias("found")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("k"), F.round(F.avg(F.coalesce("found", F.lit(0)).cast("double")), 6).alias("recall"))
