import llm_cases as C
import pytest

from ragtab.llm import exact_dedup as X


@pytest.mark.parametrize("clash", [False, True])
def test_oracle_on_odd_rows(spark, clash):
    rows = C.odd_rows()
    C.same_rows(X.exact_dedup(C.frame(spark, rows, clash)).drop("text_key"), C.duck(documents=C.pdf_of(rows)).execute(X.ORACLE))


def test_empty_table(spark):
    assert X.exact_dedup(C.frame(spark, [])).count() == 0


def test_index_grows_by_new_texts_only(spark):
    ix = X.DigestIndex.create(spark, buckets=4)
    a = C.frame(spark, [(1, "a b", "", "", 3), (2, "ab", "", "", 2), (3, "c", "", "", 1)])
    b = C.frame(spark, [(4, "a  b", "", "", 4), (5, "d", "", "", 1), (6, "d ", "", "", 2)])
    first = {r["doc_id"]: r for r in X.exact_dedup(a, ix).collect()}
    second = {r["doc_id"]: r for r in X.exact_dedup(b, ix).collect()}
    assert [first[i]["kept"] for i in (1, 2, 3)] == [True, False, True]
    assert [(second[i]["kept"], second[i]["keep_id"]) for i in (4, 5, 6)] == [(False, 1), (False, 6), (True, 6)]
    assert ix.rows().count() == 3
    plan = ix.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_stage_keeps_columns(spark):
    docs = C.frame(spark, C.odd_rows(), clash=True)
    out = X.dedup_stage(docs)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == X.exact_dedup(docs).filter("kept").select("doc_id").distinct().count()


def test_rerun_and_a_second_session(spark):
    """A job that fails after its append and is run again keeps what it kept; a later session opens the index by its path."""
    ix = X.DigestIndex.create(spark, buckets=4)
    a = C.frame(spark, [(1, "a b", "", "", 3), (2, "ab", "", "", 2), (3, "c", "", "", 1)])
    rows = lambda df, ix, **kw: sorted(tuple(r) for r in X.exact_dedup(df, ix, **kw).select("doc_id", "keep_id", "kept").collect())
    first = rows(a, ix)
    assert first == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert rows(a, ix) == first and ix.rows().count() == 2
    other = X.DigestIndex.open(spark.newSession(), ix.path)
    assert rows(a, other) == first
    b = C.frame(spark, [(7, "c", "", "", 1), (8, "e", "", "", 1)])
    assert rows(b, other, batch="monday") == [(7, 3, False), (8, 8, True)]
    assert rows(b, X.DigestIndex.open(spark, ix.path), batch="monday") == [(7, 3, False), (8, 8, True)]
    assert rows(b, X.DigestIndex.open(spark, ix.path), batch="tuesday") == [(7, 3, False), (8, 8, False)]


def test_one_row_of_repeats_and_ids_that_repeat(spark):
    rows = [(5, "same", "", "", 4)] * 3 + [(1, "alpha", "", "", 5), (1, "gamma", "", "", 5), (0, "gamma", "", "", 5), (None, "gamma", "", "", 5), (None, "z", "", "", 1)]
    got = X.exact_dedup(C.frame(spark, rows)).filter("kept").collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == [0, 1, 5, None]
    out = X.dedup_stage(C.frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == [(0, "gamma"), (1, "alpha"), (5, "same"), (None, "z")]
    long = "x " * 1_000_000
    assert X.dedup_stage(C.frame(spark, [(1, long, "", "", 1), (2, long + "x", "", "", 1), (3, long + " ", "", "", 1)])).count() == 2
