"""Exact top-k against brute force, broadcast vs grid plans, and plan shape."""

from collections import Counter
import math

import numpy as np
import pytest

from ragtab.operators import topk


def brute_dense(q, d, k, metric, exclude_self):
    out = []
    for qi, qv in q:
        cand = []
        for di, dv in d:
            if exclude_self and qi == di:
                continue
            a, b = np.asarray(qv), np.asarray(dv)
            if metric == "cosine":
                den = np.linalg.norm(a) * np.linalg.norm(b)
                if den == 0:
                    continue
                s = float(a @ b / den)
            else:
                s = 1 - float(((a - b) ** 2).sum()) / math.sqrt(2)
            cand.append((round(s, 6), di))
        cand.sort(key=lambda x: (-x[0], x[1]))
        out += [(qi, di, s, r + 1) for r, (s, di) in enumerate(cand[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2_relevance"])
@pytest.mark.parametrize("plan", ["broadcast", "grid"])
def test_dense_topk_equals_brute_force(spark, metric, plan):
    rng = np.random.default_rng(3)
    vecs = rng.integers(-2, 3, size=(60, 4)).astype(float)   # small integers: many exact ties
    vecs[5] = 0.0                                              # zero vector
    rows = [(i, vecs[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    kw = {"broadcast_bytes": 10, "corpus_blocks": 4} if plan == "grid" else {}
    got = topk.dense_topk(df, df, 5, metric=metric, doc_id="id", exclude_self=True, **kw)
    got = sorted(tuple(r) for r in got.select("query_id", "doc_id", "score", "rank").collect())
    exp = brute_dense(rows, rows, 5, metric, True)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in exp]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, exp))


def brute_lexical(q, d, k):
    import regex
    pat = regex.compile(r"[\p{L}\p{N}]+")
    out = []
    for qi, qt in q:
        cq = Counter(pat.findall(qt.lower()))
        cand = []
        for di, dt in d:
            cd = Counter(pat.findall(dt.lower()))
            dot = sum(cq[t] * cd[t] for t in cq)
            if dot <= 0:
                continue
            s = dot / (math.sqrt(sum(v * v for v in cq.values())) * math.sqrt(sum(v * v for v in cd.values())))
            cand.append((math.floor(s * 1e6 + 0.5) / 1e6, di))
        cand.sort(key=lambda x: (-x[0], x[1]))
        out += [(qi, di, s, r + 1) for r, (s, di) in enumerate(cand[:k])]
    return sorted(out)


@pytest.mark.parametrize("plan", ["broadcast", "grid"])
def test_lexical_topk_equals_brute_force_with_hot_token(spark, plan):
    words = ["the", "cat", "dog", "bird", "Ünï", "ß", "red", "blue", "x1", "y2"]
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(["the"] * int(rng.integers(1, 4)) + list(rng.choice(words, size=int(rng.integers(0, 6))))))
            for i in range(80)]
    docs += [(100, ""), (101, None), (102, "the the the")]
    qs = [(i, " ".join(rng.choice(words, size=3))) for i in range(12)] + [(50, "zzz")]
    dq = spark.createDataFrame(qs, "id long, question string")
    dd = spark.createDataFrame(docs, "doc_id long, question string").repartition(4)
    kw = {"broadcast_bytes": 10, "corpus_blocks": 5} if plan == "grid" else {}
    got = sorted(tuple(r) for r in topk.lexical_topk(dq, dd, 4, **kw)
                 .select("query_id", "doc_id", "score", "rank").collect())
    exp = brute_lexical(qs, [(i, t or "") for i, t in docs], 4)
    assert got == exp


def test_plan_has_window_group_limit_and_no_cartesian(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<double>")
    plan = topk.dense_topk(df, df, 3, doc_id="id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    opt = topk.dense_topk(df, df, 3, doc_id="id")._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in opt


def test_fewer_candidates_than_k(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "id long, question string")
    d = spark.createDataFrame([(7, "beta"), (8, "gamma")], "doc_id long, question string")
    rows = topk.lexical_topk(q, d, 5).collect()
    assert [(r["doc_id"], r["rank"]) for r in rows] == [(7, 1)]


def test_nan_vectors_never_rank(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = topk.dense_topk(df.where("id = 1"), df, 3, doc_id="id", exclude_self=True).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [3]          # NaN vector and zero vector are not hits
    got = topk.dense_topk(df.where("id = 1"), df, 3, metric="l2_relevance", doc_id="id", exclude_self=True).collect()
    assert sorted(r["doc_id"] for r in got) == [3, 4]


def test_a_third_of_the_corpus_are_copies(spark):
    # 60 of 180 documents are the same text: ties are cut by doc_id, k rows exactly
    docs = [(i, "alpha beta gamma") for i in range(0, 180, 3)] + \
           [(i, f"alpha word{i} other{i % 7}") for i in range(1, 180, 3)] + \
           [(i, f"beta x{i}") for i in range(2, 180, 3)]
    d = spark.createDataFrame(docs, "doc_id long, question string").repartition(6)
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta")], "id long, question string")
    got = topk.lexical_topk(q, d, 4).orderBy("query_id", "rank").collect()
    assert [r["doc_id"] for r in got if r["query_id"] == 1] == [0, 3, 6, 9]
    assert [r["score"] for r in got if r["query_id"] == 1] == [1.0] * 4
    assert len([r for r in got if r["query_id"] == 2]) == 4


def test_blocks_are_bounded_in_bytes(spark):
    """A corpus in one split, a very long text, and an id that many texts share."""
    from pyspark.sql import functions as F

    rows = [(i, "w" * (50 + i % 7)) for i in range(2000)] + [(5000, "x" * 20_000)] + [(7, f"y{i}" * 40) for i in range(900)]
    d = spark.createDataFrame(rows, "did long, payload string").coalesce(1)
    most = 6000
    blocked, n = topk.with_byte_blocks(d, "did", F.length("payload"), most, "db")
    sizes = {r["db"]: (r["bytes"], r["rows"]) for r in
             blocked.groupBy("db").agg(F.sum(F.length("payload")).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    assert blocked.count() == len(rows) and set(sizes) <= set(range(n)) and n > 30
    assert sorted(b for b, _ in sizes.values())[-2] <= most and 20_000 <= max(b for b, _ in sizes.values()) <= 20_000 + most
    q = spark.createDataFrame([(i, "w" * (50 + i)) for i in range(7)], "id long, question string")
    docs = d.withColumnsRenamed({"did": "doc_id", "payload": "question"})
    a = topk.lexical_topk(q, docs, 3, broadcast_bytes=300, block_bytes=most).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, topk.lexical_topk(q, docs, 3).collect()))


def test_few_cells_are_rounded_and_sorted(monkeypatch):
    """Of many queries a chunk holds few columns: cells that cannot reach a query's k-th score are not candidates."""
    rounded, plain = [], topk.round6
    monkeypatch.setattr(topk, "round6", lambda x: rounded.append(x.size) or plain(x))
    rng = np.random.default_rng(8)
    Q, D = rng.normal(size=(6000, 8)), rng.normal(size=(3000, 8))
    words = np.array([f"w{i}" for i in range(60)])
    texts = [words[rng.integers(0, 60, size=12)].tolist() for _ in range(4000)]
    for kern, payload, k in ((topk.DenseKernel("cosine").prepare(np.arange(6000), list(Q)), list(D), 4),
                             (topk.DenseKernel("l2_relevance").prepare(np.arange(6000), list(Q)), list(D), 4),
                             (topk.LexicalKernel().prepare(np.arange(3000), texts[:3000]), texts[3000:], 4)):
        rounded.clear()
        acc = topk._TopK(k)
        kern.score_into(acc, np.arange(len(payload)), payload)
        assert len(acc.q) == k * len(kern.qids)
        assert sum(rounded) < 0.05 * len(kern.qids) * len(payload)


def test_rows_with_one_id_and_ids_that_are_text():
    """Query rows that share an id are ranked together; ties of text ids go by code points, whichever chunk has them."""
    kern = topk.DenseKernel("cosine").prepare(np.array(["a", "a", "b"]), [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    acc = topk._TopK(2, "string", "string")
    for ids, vecs in ((["z", "long id"], [[1.0, 0.0], [0.0, 2.0]]), (["k", "a much longer id"], [[3.0, 0.0], [1.0, 1.0]])):
        kern.score_into(acc, np.array(ids), vecs)
    assert list(zip(acc.q.tolist(), acc.d.tolist(), acc.s.tolist())) == [
        ("a", "k", 1.0), ("a", "long id", 1.0), ("b", "a much longer id", 1.0), ("b", "k", 0.707107)]


def test_small_blocks_do_not_multiply_what_is_shuffled(spark, monkeypatch):
    """Blocks far smaller than what a task may hold: neither side is copied once for each block of the other."""
    parts, plain = {}, topk.with_byte_blocks

    def spy(df, key, *how):
        out = plain(df, key, *how)
        parts[key] = out[1]
        return out

    monkeypatch.setattr(topk, "with_byte_blocks", spy)
    q = spark.createDataFrame([(i, f"alpha word{i} " * 20) for i in range(300)], "id long, question string")
    d = spark.createDataFrame([(i, f"alpha word{i % 300} other{i} " * 20) for i in range(900)], "doc_id long, question string")
    small = topk.lexical_topk(q, d, 3, broadcast_bytes=2000, block_bytes=3000).collect()
    assert parts["qid"] == 1 and parts["did"] <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, small)) == sorted(map(tuple, topk.lexical_topk(q, d, 3).collect()))


def test_counting_is_done_in_slices(monkeypatch):
    """A batch of long texts is counted in slices of bounded tokens, with the same result."""
    from ragtab.operators import judge

    rng = np.random.default_rng(4)
    texts = [[f"w{x}" for x in rng.integers(0, 9, size=int(rng.integers(0, 30)))] for _ in range(80)]
    a, b = (topk.pa.array(t, type=topk.pa.list_(topk.pa.string())) for t in (texts, texts[::-1]))
    want = judge.cosine_batch(a, b)
    seen, plain = [], topk.np.unique
    monkeypatch.setattr(topk, "SLICE_ITEMS", 100)
    monkeypatch.setattr(np, "unique", lambda x, **how: seen.append(len(x)) or plain(x, **how))
    np.testing.assert_array_equal(judge.cosine_batch(a, b), want)
    kern = topk.LexicalKernel().prepare(np.arange(1), [["w1", "w2"]])
    seen_before = len(seen)
    acc = topk._TopK(80)
    kern.score_into(acc, np.arange(80), a)
    assert max(seen) <= 200 and len(seen) > seen_before + 5 and len(acc.q) == sum(bool({"w1", "w2"} & set(t)) for t in texts)


def _mixed_texts(n: int, seed: int) -> list[list[str]]:
    """Texts of three vocabularies that share few words, some empty."""
    rng = np.random.default_rng(seed)
    words = [[f"{lang}{i}" for i in range(60)] + ["in", "de"] for lang in "xyz"]
    return [[words[i % 3][min(61, int(rng.exponential(6)))] for _ in range(int(rng.integers(0, 40)))] for i in range(n)]


def test_a_floor_cuts_the_search_and_no_hit(monkeypatch):
    """With a floor the search returns the hits of the whole one that reach it, and scores fewer pairs."""
    monkeypatch.setattr(topk, "TILE_ROWS", 64)
    monkeypatch.setattr(topk, "LEXICAL_CELLS", 1024)
    qs, ds = _mixed_texts(700, 1), _mixed_texts(900, 2)
    ids = np.random.default_rng(3).permutation(900)
    for k in (1, 3):
        hits, cells = [], []
        for floor in (None, 0.8):
            kern, acc = topk.LexicalKernel().prepare(np.arange(700), qs), topk._TopK(k, floor=floor)
            plain, seen = kern.cells, []
            kern.cells = lambda tile, part, n_q, n_d, plain=plain, seen=seen: seen.append(n_q * n_d) or plain(tile, part, n_q, n_d)
            for at in range(0, 900, 300):
                kern.score_into(acc, ids[at:at + 300], ds[at:at + 300])
            hits.append({(q, d, s) for q, d, s in zip(acc.q.tolist(), acc.d.tolist(), acc.s.tolist())})
            cells.append(sum(seen))
        assert hits[1] == {h for h in hits[0] if h[2] >= 0.8} and 0 < len(hits[1]) < len(hits[0])
        assert cells[1] < 0.97 * cells[0], cells


def test_groups_and_tiles_change_no_result(monkeypatch):
    """Rows laid out by groups in small tiles, some tokens dense: as the brute force has it, own rows left out or not."""
    from collections import Counter

    monkeypatch.setattr(topk, "TILE_ROWS", 32)
    monkeypatch.setattr(topk, "LEXICAL_CELLS", 1024)
    qs = _mixed_texts(150, 5)
    counts = [Counter(t) for t in qs]
    for k, share, own in ((1, 1 / 50, True), (4, 1 / 2000, False), (40, 1 / 400, True)):
        monkeypatch.setattr(topk.LexicalKernel, "DENSE_SHARE", share)
        acc = topk._TopK(k)
        topk.LexicalKernel().prepare(np.arange(150), qs).score_into(acc, np.arange(150), topk.pa.array([" ".join(t) or None for t in qs]), own)
        want = []
        for i, a in enumerate(counts):
            dots = {j: sum(a[t] * b[t] for t in a) for j, b in enumerate(counts) if j != i or not own}
            norm = [sum(v * v for v in c.values()) ** 0.5 for c in counts]
            best = sorted((-round(float(topk.round6(np.array(s / (norm[i] * norm[j])))), 6), j) for j, s in dots.items() if s)[:k]
            want += [(i, j, -s) for s, j in best]
        assert sorted(zip(acc.q.tolist(), acc.d.tolist(), acc.s.tolist())) == sorted(want)


def test_words_are_shuffled_as_text(spark):
    """The grid plan sends a row's words as one text, not as an array of them."""
    q = spark.createDataFrame([(i, f"Alpha word{i}") for i in range(300)], "id long, question string")
    plan = topk.lexical_topk(q, q.withColumnRenamed("id", "doc_id"), 2, broadcast_bytes=100)._jdf.queryExecution().analyzed().toString()
    assert "CoGroup" in plan and "array_join" in plan


def test_dense_floor_scores_few_pairs_again():
    """With a floor the dense search returns the same hits that reach it; few cells are more than rounded."""
    rng = np.random.default_rng(9)
    V = rng.normal(size=(900, 16)) * 10.0 ** rng.integers(-3, 4, size=(900, 1))
    for metric, floor in (("cosine", 0.75), ("l2_relevance", -5.0)):
        hits, offered = [], []
        for f in (None, floor):
            acc = topk._TopK(2, floor=f)
            plain, seen = acc.offer, []
            acc.offer = lambda *x, plain=plain, seen=seen: seen.append(len(x[2])) or plain(*x)
            topk.DenseKernel(metric).prepare(np.arange(900), list(V)).score_into(acc, np.arange(900), list(V), True)
            hits.append({(q, d, s) for q, d, s in zip(acc.q.tolist(), acc.d.tolist(), acc.s.tolist())})
            offered.append(sum(seen))
        assert hits[1] == {h for h in hits[0] if h[2] >= floor} and 0 < len(hits[1]) < len(hits[0]) and offered[1] < offered[0]


def test_whole_products_are_scored_as_they_are(monkeypatch):
    """Pairs of texts are scored from their tile's product of counts, and summed again only where it may not be whole."""
    calls, exact = [], topk.LexicalKernel.exact
    monkeypatch.setattr(topk.LexicalKernel, "exact", lambda self, *a: calls.append(1) or exact(self, *a))
    qs, ds = _mixed_texts(150, 5), _mixed_texts(400, 6)
    found = []
    for long in ([], [["xa"] * 3_000_000]):
        for whole in (topk.LexicalKernel.WHOLE, 0.0):
            monkeypatch.setattr(topk.LexicalKernel, "WHOLE", whole)
            calls.clear()
            acc, texts = topk._TopK(5), qs + long
            topk.LexicalKernel().prepare(np.arange(len(texts)), topk.pa.array([" ".join(t) or None for t in texts])).score_into(
                acc, np.arange(len(ds) + len(long)), topk.pa.array([" ".join(t) or None for t in ds + long]))
            assert bool(calls) == (whole == 0.0 or bool(long))
            found.append(acc.frame().query("query_id < 150 and doc_id < 400").reset_index(drop=True))
        monkeypatch.undo()
        monkeypatch.setattr(topk.LexicalKernel, "exact", lambda self, *a: calls.append(1) or exact(self, *a))
    assert len(found[0]) > 500
    for other in found[1:]:
        topk.pd.testing.assert_frame_equal(found[0], other)
