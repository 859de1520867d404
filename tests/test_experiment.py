"""The experiment lifecycle end to end on the smallest fixture, with resume."""


from conftest import SF_SMALL
from ragtab.operators import experiment as X
from ragtab.operators import report as R
from ragtab.plans.views import Tables
from ragtab.session import work_path


def test_sweep_answers_judges_resumes_and_ranks(spark):
    t = Tables(spark, SF_SMALL)
    qs = t.qa_pairs()
    corpora = {"test": t.corpus_pairs(), "docs": t.corpus_docs()}
    settings = [(None, False), ("test", False), ("docs", True)]
    a_root, j_root = work_path(spark, "sweep-answers"), work_path(spark, "sweep-judged")
    first = X.answer_sweep(spark, qs, corpora, ["m1", "m2"], settings, a_root)
    assert len(first) == 3
    assert X.answer_sweep(spark, qs, corpora, ["m1", "m2"], settings, a_root) == []     # resume: nothing left
    n_pairs = qs.count()
    judged = X.judge_sweep(spark, a_root, ["gemma2", "llama3.1"], j_root)
    assert judged.count() == 3 * 2 * 2 * n_pairs
    again = X.judge_sweep(spark, a_root, ["gemma2", "llama3.1"], j_root)
    assert again.count() == judged.count()                                              # resume: no new rows
    board = {(r["experiment"], r["model"]): r for r in R.leaderboard(judged).collect()}
    test_exp = board[("dataset_test_emb_lexical_rerank_False", "m1")]["judge_accuracy"]
    # answers echoed from the test set itself beat answers without retrieval
    assert test_exp > board[("no_rag", "m1")]["judge_accuracy"]
    assert test_exp > board[("dataset_docs_emb_lexical_rerank_True", "m1")]["judge_accuracy"]


def test_failed_calls_and_new_questions_stay_pending(spark):
    def fails_on_even(system, prompt, model):   # local functions travel to the workers by value
        if len(prompt) % 2 == 0:
            raise RuntimeError("no model server")
        return prompt

    def echo(system, prompt, model, **options):
        return prompt + options.get("tail", "")

    qs = spark.createDataFrame([(i, "q" * i, "r") for i in range(1, 7)], "id long, question string, response string")
    root, judged, failed = (work_path(spark, x) for x in ("a", "j", "f"))
    X.answer_sweep(spark, qs, {}, ["m"], [(None, False)], root, fails_on_even, failed_root=failed)
    assert sorted(r["id"] for r in spark.read.parquet(root).collect()) == [1, 3, 5]
    assert sorted(r["id"] for r in spark.read.parquet(failed).collect()) == [2, 4, 6]
    more = qs.union(spark.createDataFrame([(7, "new", "r")], qs.schema))
    X.answer_sweep(spark, more, {}, ["m"], [(None, False)], root, echo, options={"tail": "!"})
    rows = {r["id"]: r["llm_response"] for r in spark.read.parquet(root).collect()}
    assert spark.read.parquet(root).count() == 7 and rows[2] == "qq!" and rows[1] == "q" and rows[7] == "new!"
    assert X.answer_sweep(spark, more, {}, ["m"], [(None, False)], root, echo) == []

    def judge(system, prompt, model):
        if "A: qqqq!" in system:
            raise RuntimeError("down")
        return '{"consistent": "True"}'

    got = X.judge_sweep(spark, root, ["v"], judged, judge)
    assert got.count() == 6 and {r["consistent"] for r in got.collect()} == {"True"}     # a failed call is no verdict
    again = X.judge_sweep(spark, root, ["v"], judged, lambda s, p, m: '{"consistent": "False"}')
    assert again.count() == 7 and again.where("consistent = 'False'").count() == 1


def test_read_failures_surface(spark, tmp_path):
    import pytest

    assert X._existing(spark, str(tmp_path / "nothing"), ["id"]) is None
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(Exception, match="model"):
        X._existing(spark, str(tmp_path / "t"), ["model"])
