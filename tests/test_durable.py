"""Answers that outlive a failed job, errors that are tried again, and null prompts."""

import pytest
from pyspark import TaskContext
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ragtab.operators import answer as A
from ragtab.operators import durable as D
from ragtab.session import work_path

SCHEMA = "system string, prompt string, model string, id long"


def asked(spark, n=40):
    rows = [("s", f"p{i % n}", f"m{i % 2}", i) for i in range(3 * n)] + [(None, None, "m", 900), ("", None, "m", 901), ("", "", "m", 902)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_second_job_does_the_rest_only(spark):
    path, calls = work_path(spark, "answers"), spark.sparkContext.accumulator(0)

    class Gone(BaseException):
        pass

    def dies(system, prompt, model):
        if int(TaskContext.get().getLocalProperty("streaming.sql.batchId")) == 1:
            raise Gone("gone")
        return f"1 {prompt}"

    def works(system, prompt, model):
        calls.add(1)
        return f"2 {prompt}"

    df = asked(spark)
    total = df.select(*A.GEN_KEYS).distinct().count()
    with pytest.raises(StreamingQueryException):
        D.generate_durably(df, path, dies, files_a_batch=1)
    kept = D.stored_answers(D.answer_store(spark, path)).count()
    assert 0 < kept < total
    out = D.generate_durably(df, path, works).collect()
    assert calls.value == total - kept and len(out) == df.count()
    assert all(r["llm_response"][2:] == str(r["prompt"]) and r["error"] is None and r["time"] is not None for r in out)
    D.generate_durably(df, path, works)
    assert calls.value == total - kept


def test_errors_are_tried_again(spark):
    path = work_path(spark, "answers")

    def odd(system, prompt, model):
        if model == "m1":
            raise ValueError("no")
        return prompt

    df = asked(spark, 6)
    first = D.generate_durably(df, path, odd, setup=None)
    assert first.where("error IS NOT NULL").count() == df.where("model = 'm1'").count()
    second = D.generate_durably(df, path, lambda s, p, m: f"again {p}")
    assert second.where("error IS NOT NULL").count() == 0
    assert {r["model"] for r in second.where(F.startswith("llm_response", F.lit("again"))).collect()} == {"m1"}


def test_same_rows_as_generate(spark):
    df = asked(spark, 5)
    def rows(x):
        return sorted(map(tuple, x.select("id", "llm_response", "error").collect()))
    assert rows(D.generate_durably(df, work_path(spark, "answers"))) == rows(A.generate(df))


def test_setups_answer_as_themselves(spark):
    import functools

    def load(word):
        return lambda s, p, m: f"{word} {p}"

    df = asked(spark, 8)
    for word in ("first", "second", "third"):
        for setup in (lambda w=word: load(w), functools.partial(load, word)):
            assert {r["llm_response"].split()[0] for r in A.generate(df, setup=setup).select("llm_response").collect()} == {word}


def test_micro_batches_do_not_grow_with_the_calls(spark, monkeypatch):
    monkeypatch.setattr(D, "BATCHES", 2, raising=False)
    n = spark.sparkContext.defaultParallelism * D.FILE_CALLS * 8
    df = spark.range(n).select(F.lit("s").alias("system"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit("m").alias("model"))
    path = work_path(spark, "answers")
    assert D.generate_durably(df, path).where("llm_response IS NOT NULL").count() == n
    assert len(D.answer_store(spark, path).batches()) <= 4
