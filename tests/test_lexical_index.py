"""The stored lexical index: rows of the direct search, batches, sessions, and the cells its bounds leave out."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from ragtab.operators import lexical_index as LI
from ragtab.operators import retrieve as RT
from ragtab.operators import topk
from ragtab.plans.views import Tables
from ragtab.session import work_path
from ragtab.sources import batches as B

WORDS = ["the", "cat", "dog", "bird", "Ünï", "ß", "red", "blue", *(f"x{k}" for k in range(40))]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, len(WORDS) + 1)
    return [" ".join(["the"] * int(rng.integers(0, 3)) + list(rng.choice(WORDS, size=int(rng.integers(0, 40)), p=p / p.sum()))) for _ in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


def make(spark, docs, **kw):
    index = LI.LexicalIndex.create(spark, work_path(spark, "ix"), docs.schema, **kw)
    index.append(docs, "b")
    return index


@pytest.mark.parametrize("text_ids, embedder", [(False, "lexical"), (True, "hashed")])
def test_equals_direct_search(spark, monkeypatch, text_ids, embedder):
    monkeypatch.setattr(LI, "SEGMENT_DOCS", 16)     # many segments
    kind = "string" if text_ids else "long"
    name = (lambda i: f"é{i}") if text_ids else (lambda i: i)
    docs = [(name(i), t) for i, t in enumerate(texts(300, 1))] + [(name(900 + i), t) for i, t in enumerate(["", None, "the the", "cat " * 5000, "cat dog", "dog cat"])]
    asked = [(name(i), t) for i, t in enumerate(texts(25, 2))] + [(name(500), "zzz"), (name(501), None), (name(502), "the"), (name(503), "cat dog")]
    d = spark.createDataFrame(docs, f"doc_id {kind}, question string").repartition(5)
    q = spark.createDataFrame(asked, f"id {kind}, question string")
    index = make(spark, d, embedder=embedder)
    for exclude in (False, True):
        want = rows(topk.lexical_topk(q, d, 4, embedder=embedder, exclude_self=exclude))
        assert rows(index.topk(q, 4, exclude_self=exclude)) == want
    assert rows(index.topk(q, 4, block_bytes=2000)) == rows(topk.lexical_topk(q, d, 4, embedder=embedder))


def test_bounds_leave_cells_out(spark):
    """Every document is a candidate of the direct search; few reach the end of the bounded one."""
    t = Tables(spark, SF_MID)
    index = make(spark, t.corpus_docs())
    hits, cells = index.topk(t.bench_questions(), 4, report=True)
    assert rows(hits) == rows(topk.lexical_topk(t.bench_questions(), t.corpus_docs(), 4))
    n, asked = t.corpus_docs().count(), t.bench_questions().count()
    got = cells.agg(*(F.sum(c) for c in ("sharing", "looked_at", "scored"))).first()
    assert cells.count() == asked and got[2] <= got[1] <= got[0] <= n * asked
    assert got[2] < 0.1 * n * asked and got[1] < 0.9 * got[0]


def test_search_reads_no_texts(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, question string")
    index = make(spark, d)
    read = B.BatchTables.read

    def postings_only(self, name, *a, **kw):
        assert name == "postings"
        return read(self, name, *a, **kw)

    monkeypatch.setattr(B.BatchTables, "read", postings_only)
    q = spark.createDataFrame([(7, "b")], "id long, question string")
    assert [r[1] for r in rows(index.topk(q, 3))] == [1, 2]


def test_batches_replace_themselves(spark):
    """Overlapping batches, a repeated key, a batch run again with other rows, a run that died before its manifest row."""
    schema = "doc_id long, question string"
    frame = lambda r: spark.createDataFrame(r, schema)
    index = LI.LexicalIndex.create(spark, work_path(spark, "ix"), frame([]).schema)
    q = frame([(1, "alpha")]).withColumnRenamed("doc_id", "id")
    assert rows(index.topk(q, 5)) == []
    index.append(frame([(1, "alpha"), (2, "alpha beta"), (2, "alpha beta")]), "one")
    index.append(frame([(2, "other"), (3, "alpha alpha")]), "two")
    first = rows(index.topk(q, 5))
    assert [r[1:] for r in first] == [(1, 1.0, 1), (2, 0.707107, 3), (3, 1.0, 2)]
    before = index.snapshot()
    index.append(frame([(1, "alpha"), (2, "alpha beta")]), "one")
    assert rows(index.topk(q, 5)) == first
    index.append(frame([(1, "gamma")]), "one")
    assert [r[1] for r in rows(index.topk(q, 5))] == [3] and rows(before.topk(q, 5)) == first
    frame([(9, "alpha")]).write.parquet(f"{index.store.path}/documents/orphan")     # written, never named
    other = LI.LexicalIndex.open(spark.newSession(), index.store.path)
    assert [r[1] for r in rows(other.topk(q, 5))] == [3]
    assert sorted(r["doc_id"] for r in other.documents().collect()) == [1, 3]
    assert other.version() == 4 and set(other.store.batches()) == {"one", "two"}


def test_retrieve_from_index(spark):
    schema = "doc_id string, question string, response string"
    d = spark.createDataFrame([("a", "reset my password", "use the portal"), ("b", "open the door", "turn the key")], schema)
    q = spark.createDataFrame([("q1", "how to reset a password"), ("q2", "zebra")], "id string, question string")
    index = make(spark, d)
    for advanced in (False, True):
        want = RT.retrieve(q, d, advanced=advanced, as_prompt=True).orderBy("id").collect()
        assert RT.retrieve(q, index, advanced=advanced, as_prompt=True).orderBy("id").collect() == want
    with pytest.raises(ValueError):
        RT.retrieve_hits(q, index, dedupe_questions=True)
    with pytest.raises(ValueError):
        RT.retrieve_hits(q, index, embedder="hashed")
    with pytest.raises(ValueError):
        LI.LexicalIndex.open(spark, work_path(spark, "nothing"))
    with pytest.raises(ValueError):
        LI.LexicalIndex.create(spark, index.store.path, d.schema)


def test_ingest_is_repeatable(spark):
    schema = "k string, v long"
    store = B.BatchTables.create(spark, work_path(spark, "in"))
    put = lambda batch, r: B.append_batch(store, "t", spark.createDataFrame(r, schema), batch, "k")
    read = lambda: sorted((tuple(r) for r in store.read("t", schema).collect()), key=repr)
    assert read() == []
    put("a", [("x", 1), ("x", 1), ("y", 2), (None, 3)])
    put("b", [("y", 5), ("z", 6), (None, 7)])
    want = sorted([("x", 1), ("y", 2), (None, 3), ("z", 6)], key=repr)
    assert read() == want
    put("a", [("x", 1), ("y", 2), (None, 3)])
    put("b", [("y", 5), ("z", 6), (None, 7)])
    assert read() == want
    with pytest.raises(ValueError):
        store.snapshot().put("c", {})
    assert json.dumps(sorted(store.batches())) == '["a", "b"]'


def test_a_threshold_is_known_to_the_search(spark, monkeypatch):
    """Many queries are scored by tiles over the segments, with the threshold of the caller."""
    monkeypatch.setattr(LI, "SEGMENT_DOCS", 16)
    d = spark.createDataFrame(list(enumerate(texts(200, 5))), "doc_id long, question string")
    q = spark.createDataFrame(list(enumerate(texts(150, 6))), "id long, question string")
    index = make(spark, d)
    monkeypatch.setattr(LI.LexicalIndex, "_block", None)     # the search query by query
    want = rows(topk.lexical_topk(q, d, 2, floor=0.9))
    assert 0 < len(want) < 300 and rows(index.topk(q, 2, floor=0.9)) == want
    assert RT.first_stage(q, index, 2, floor=0.9).count() == len(want)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_null_and_repeated_ids(spark, kind):
    """A document and a question without an id are ones like others; questions with one id are one query."""
    name = (lambda i: f"é{i}") if kind == "string" else (lambda i: i)
    d = spark.createDataFrame([(None, "red cat"), (name(1), "red dog"), (name(2), "blue dog bird")], f"doc_id {kind}, question string")
    q = spark.createDataFrame([(None, "cat"), (name(1), "red"), (name(2), "blue"), (name(2), "blue dog bird"), (name(3), None)], f"id {kind}, question string")
    index = make(spark, d)
    got = {tuple(r) for r in index.topk(q, 4).select("query_id", "doc_id", "score").collect()}
    assert got == {(None, None, 0.707107), (name(1), None, 0.707107), (name(1), name(1), 0.707107), (name(2), name(2), 0.942809), (name(2), name(1), 0.288675)}
    assert got == {tuple(r) for r in index.topk(q, 4, report=True)[0].select("query_id", "doc_id", "score").collect()}
    assert index.topk(q, 4, exclude_self=True).count() == 3
