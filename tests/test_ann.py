import numpy as np
from pyspark.sql import functions as F

from ragtab.operators import ann as AN
from ragtab.operators import topk


def test_ivf_with_all_probes_and_split_clusters_is_exact(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(3, 8)) * 5
    pts = np.vstack([c + rng.normal(size=(40, 8)) for c in centers])
    pts[:60] = centers[0] + rng.normal(size=(60, 8)) * 0.1      # a hot cluster: half the rows
    df = spark.createDataFrame([(i, pts[i].tolist()) for i in range(len(pts))], "id long, embedding array<double>")
    approx = AN.ivf_topk(df, df, 5, nlist=3, nprobe=3, doc_id="id", exclude_self=True, block_rows=7)
    exact = topk.dense_topk(df, df, 5, doc_id="id", exclude_self=True)
    a = sorted((r["query_id"], r["doc_id"]) for r in approx.collect())
    e = sorted((r["query_id"], r["doc_id"]) for r in exact.collect())
    assert a == e
    rec = AN.recall_at_k(AN.ivf_topk(df, df, 5, nlist=3, nprobe=1, doc_id="id", exclude_self=True), exact)
    assert rec.agg(F.avg("recall")).first()[0] > 0.9                 # clustered data: one probe suffices


def points(spark, pts):
    return spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(pts)], "id long, embedding array<double>")


def test_bound_is_exact_and_ends_visits_early(spark):
    rng = np.random.default_rng(3)
    pts = np.repeat(rng.normal(size=(20, 6)) * 3, 30, axis=0) + rng.normal(size=(600, 6)) * 0.05
    df = points(spark, [*pts, np.zeros(6)])
    for metric in ("cosine", "l2_relevance"):
        hits, seen = AN.ivf_topk(df, df, 4, nlist=20, nprobe=1, budget=1.0, metric=metric, doc_id="id", exclude_self=True, report=True)
        exact = topk.dense_topk(df, df, 4, metric=metric, doc_id="id", exclude_self=True)
        want = sorted(tuple(r) for r in exact.select("query_id", "doc_id", "score", "rank").collect())
        assert sorted(tuple(r) for r in hits.collect()) == want
        assert seen.agg(F.avg("scored")).first()[0] < 0.4


def test_default_recall_on_random_vectors_and_budget(spark):
    """No cluster structure: the bound rules nothing out, so the budget decides."""
    df = points(spark, np.random.default_rng(5).normal(size=(800, 64)))
    exact = topk.dense_topk(df, df, 4, doc_id="id", exclude_self=True)
    hits, seen = AN.ivf_topk(df, df, 4, doc_id="id", exclude_self=True, report=True)
    assert AN.recall_at_k(hits, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert seen.agg(F.max("scored")).first()[0] <= 0.75


def test_few_rows(spark):
    assert AN.ivf_topk(points(spark, [[1.0, 0.0]]), points(spark, [[0.0, 2.0]]), 3, doc_id="id").count() == 1
    none = points(spark, [[1.0, 0.0]]).limit(0)
    assert AN.ivf_topk(none, points(spark, [[0.0, 2.0]]), 3, doc_id="id").count() == 0
    assert AN.ivf_topk(points(spark, [[0.0, 2.0]]), none, 3, doc_id="id").count() == 0


def test_a_query_goes_to_units_not_to_lists(spark):
    """What a search sends out grows with the units of lists, and a slice of queries at a time is looked at."""
    df = points(spark, np.random.default_rng(6).normal(size=(500, 8)))
    index = AN.IvfIndex(df, 40, doc_id="id", vec="embedding", metric="cosine")
    units = AN._units(index.sizes, 200)
    assert 3 <= len(units[2]) <= 5 and sorted(np.concatenate(units[2])) == list(np.flatnonzero(index.sizes))
    q = AN._vectors(df, "id", "embedding", "qid", "cosine").withColumn("reach", F.lit(0.0))
    near = AN._lists(index, q, 40, 1.0, True, units)
    assert near.count() == 500 * len(units[2])
    assert {r["n"] for r in near.groupBy("qid").agg(F.sum("n").alias("n")).collect()} == {500}
    first, many, members = AN._units(np.array([10, 0, 450, 30, 170, 5]), 200)
    assert list(many) == [1, 0, 3, 1, 1, 1] and [list(m) for m in members] == [[0], [2], [2], [2], [3, 4], [5]]
