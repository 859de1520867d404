"""The experiment lifecycle as Spark jobs: answer every question with every
model under every retrieval setting, judge the answers with every verifier, and
keep both result sets as partitioned tables that a rerun resumes.

Each step is one distributed job over whole tables; tasks already present in the
output (per question) are skipped by an anti join and new rows are appended, so a
rerun does exactly what is missing: failed calls, new questions, new models."""

from __future__ import annotations

import json
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtab.functions import prompts as P
from ragtab.functions.text import TOKEN_PATTERN
from ragtab.operators import answer as A
from ragtab.operators import grid as G
from ragtab.operators import judge as J
from ragtab.plans.views import explode_grid
from ragtab.sources import files as FS


def _existing(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """Keys of the finished tasks; None where nothing has been written. Any other read failure surfaces."""
    try:
        return spark.read.parquet(root).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def pending_answers(spark: SparkSession, questions: DataFrame, models: list[str], name: str, out_root: str) -> DataFrame:
    """(model, id) of the questions that have no answer in experiment ``name`` yet."""
    tasks = explode_grid(questions.select("id"), "mi", "model", models).select("model", "id")
    done = _existing(spark, out_root, ["experiment", "model", "id"])
    return tasks if done is None else tasks.join(done.where(F.col("experiment") == name).select("model", "id"), ["model", "id"], "left_anti")


def answer_sweep(spark: SparkSession, questions: DataFrame, corpora: dict[str, DataFrame], models: list[str],
                 settings: list[tuple], out_root: str, scorer: Callable[..., str] = A.context_echo_scorer, k: int = 1,
                 options: dict | None = None, failed_root: str | None = None) -> list[str]:
    """Answers for every (setting, model); ``settings`` holds (corpus mode or None for no retrieval, advanced) or
    (mode, advanced, embedder). Only tasks without an answer are run, so new questions and failed calls are taken up
    by the next run; failed calls are appended to ``failed_root``, if given, and never stored as answers. ``options``
    go to every model call. Returns the experiments that got answers now."""
    written = []
    for mode, advanced, *emb in settings:
        embedder = emb[0] if emb else "lexical"
        name = G.NO_RAG if mode is None else G.NAME_FORMAT % (mode, embedder, advanced)
        todo = pending_answers(spark, questions, models, name, out_root)
        if todo.isEmpty():
            continue
        ans = A.answer_all(questions, None if mode is None else corpora[mode], models, name, scorer,
                           k=k, advanced=advanced, options=options, pending=todo, **({} if mode is None else {"embedder": embedder}))
        good = ans.where(F.col("error").isNull()).drop("error")
        if failed_root:
            ans.where(F.col("error").isNotNull()).select("experiment", "model", "id", "error").write.mode("append").parquet(failed_root)
        if not good.isEmpty():
            FS.write_results(good, out_root, keys=("experiment", "model"), mode="append")
            written.append(name)
    return written


def lexical_judge(system: str, prompt: str, model: str) -> str:
    """A stand-in judge for tests and dry runs: reads information A and B back
    from the judge prompt and answers in the judge's JSON format, consistent when
    the token Jaccard of A and B is at least 0.5."""
    import regex

    a, _, rest = system.partition(P.JUDGE_HEAD)[2].partition(P.JUDGE_MID)
    b = rest.partition(P.JUDGE_TAIL)[0]
    pat = regex.compile(TOKEN_PATTERN)
    ta, tb = set(pat.findall(a.lower())), set(pat.findall(b.lower()))
    jac = len(ta & tb) / len(ta | tb) if ta | tb else 0.0
    return json.dumps({"consistent": "True" if jac >= 0.5 else "False",
                       "justification": f"token overlap {jac:.2f} ({model})"})


def judge_sweep(spark: SparkSession, answers_root: str, verifiers: list[str], out_root: str,
                judge: Callable[..., str] = lexical_judge, options: dict | None = None) -> DataFrame:
    """Judge every written answer with every verifier that has not judged it yet
    and append the judged rows, partitioned by experiment, verifier and model. A
    failed call gives no row, so the next run takes it up."""
    answers = spark.read.parquet(answers_root)
    keys = ["experiment", "verifier", "model", "id"]
    work = explode_grid(answers, "vi", "verifier", list(verifiers))
    done = _existing(spark, out_root, keys)
    if done is not None:
        work = work.join(done, keys, "left_anti")
    prompts = work.select(*keys, P.judge_system("llm_response", "response").alias("system"), F.lit(P.JUDGE_USER_PROMPT).alias("prompt"))
    raw = A.generate(prompts.withColumnRenamed("model", "answer_model").withColumnRenamed("verifier", "model"), judge, options=options)
    raw = raw.select("experiment", F.col("model").alias("verifier"), F.col("answer_model").alias("model"), "id",
                     F.col("llm_response").alias("raw_text"))
    FS.write_results(J.answered(J.judge_rows(answers, raw)), out_root, mode="append")
    return spark.read.parquet(out_root)
