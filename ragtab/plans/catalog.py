"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL.

Each query reads whole driver tables (or views Spark derives from them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtab.operators import topk
from ragtab.plans import oracle as O
from ragtab.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- retrieval
@register("lexical_topk", O.with_views(
    ["bench_questions", "corpus_docs"],
    O.lexical_scores_ctes("lx", "bench_questions", "id", "question", "corpus_docs", "doc_id", "question")
    + [O.topk_cte("lx", 4)],
    "SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM lx_top"))
def q_lexical_topk(spark, sf):
    t = Tables(spark, sf)
    return topk.lexical_topk(t.bench_questions(), t.corpus_docs(), 4)


@register("dense_topk_cosine", O.with_views(
    ["vectors"], O.dense_scores_cte("dc", "cosine", "vectors", "vectors", True) + [O.topk_cte("dc", 4)],
    "SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM dc_top"))
def q_dense_cos(spark, sf):
    v = Tables(spark, sf).vectors()
    return topk.dense_topk(v, v, 4, metric="cosine", doc_id="id", exclude_self=True)


@register("dense_topk_l2_relevance", O.with_views(
    ["vectors"], O.dense_scores_cte("dl", "l2", "vectors", "vectors", True) + [O.topk_cte("dl", 4)],
    "SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM dl_top"))
def q_dense_l2(spark, sf):
    v = Tables(spark, sf).vectors()
    return topk.dense_topk(v, v, 4, metric="l2_relevance", doc_id="id", exclude_self=True)


# ---------------------------------------------------------------- text and vectors (F-*)
from ragtab.functions import text as T  # noqa: E402
from ragtab.functions import vectors as V  # noqa: E402
from ragtab.operators import judge as J  # noqa: E402
from ragtab.operators import report as R  # noqa: E402


@register("word_rate", O.with_views(["answers"], [], f"""
SELECT experiment, model, id, {O.WORDS.format(x='llm_response')} AS words, time,
       round(CAST({O.WORDS.format(x='llm_response')} AS DOUBLE) / time, 6) AS tps FROM answers"""))
def q_word_rate(spark, sf):
    a = Tables(spark, sf).answers()
    return a.select("experiment", "model", "id", T.word_count("llm_response").alias("words"), "time",
                    F.round(T.words_per_second("llm_response", "time"), 6).alias("tps"))


@register("sem_score_pairs", O.with_views(
    ["answers"], O.sem_ctes("answers", "experiment, model, id", "response", "llm_response"),
    "SELECT a.experiment, a.model, a.id, round(s.sem_score, 6) AS sem_score FROM answers a LEFT JOIN sem s USING (experiment, model, id)"))
def q_sem_score_pairs(spark, sf):
    a = Tables(spark, sf).answers()
    return J.with_sem_score(a).select("experiment", "model", "id", F.round("sem_score", 6).alias("sem_score"))


@register("vector_norms", O.with_views(["vectors"], [], """
SELECT id, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm,
       round(list_dot_product(embedding, embedding), 6) AS sq_norm FROM vectors"""))
def q_vector_norms(spark, sf):
    v = Tables(spark, sf).vectors()
    return v.select("id", F.round(V.norm("embedding"), 6).alias("norm"),
                    F.round(V.dot("embedding", "embedding"), 6).alias("sq_norm"))


# ---------------------------------------------------------------- judging (F-judge, A1-A3, G9)
@register("parse_judgements", O.with_views(["judge_raw"], [("parsed", O.PARSED)], "SELECT * FROM parsed"))
def q_parse_judgements(spark, sf):
    return J.parse_judgements(Tables(spark, sf).judge_raw())


_ACC_SQL = """SELECT experiment, verifier, model, CAST(count(*) AS BIGINT) AS n,
       round(count_if({cond}) / count(*), 6) AS accuracy FROM parsed WHERE status <> 'error' GROUP BY ALL"""


@register("judge_strict_accuracy", O.with_views(["judge_raw"], [("parsed", O.PARSED)],
          _ACC_SQL.format(cond="consistent = 'True' AND consistent_kind = 'str'")))
def q_judge_strict(spark, sf):
    return R.accuracy_by_group(J.parse_judgements(Tables(spark, sf).judge_raw()), lenient=False)


@register("judge_lenient_accuracy", O.with_views(["judge_raw"], [("parsed", O.PARSED)],
          _ACC_SQL.format(cond="lower(trim(consistent)) = 'true'")))
def q_judge_lenient(spark, sf):
    return R.accuracy_by_group(J.parse_judgements(Tables(spark, sf).judge_raw()), lenient=True)


_JT_BODY = """
SELECT experiment, verifier, model, id, consistent, justification, status, round(sem_score, 6) AS sem_score,
       round(avg(time) FILTER (WHERE status <> 'error') OVER g, 6) AS mean_time,
       round(avg(tps) FILTER (WHERE status <> 'error') OVER g, 6) AS mean_tps,
       round(count_if(consistent = 'True' AND consistent_kind = 'str') OVER g / count_if(status <> 'error') OVER g, 6) AS accuracy,
       round(count_if(status <> 'error' AND coalesce(sem_score > 0.7, false)) OVER g / count_if(status <> 'error') OVER g, 6) AS sem_acc
FROM jrows WINDOW g AS (PARTITION BY experiment, verifier, model)"""


@register("judged_table", O.with_views(["judge_raw", "answers"], O.judged_rows_ctes(), _JT_BODY))
def q_judged_table(spark, sf):
    t = Tables(spark, sf)
    a = t.answers()
    return J.judged_table(a, t.judge_raw(a))


# ---------------------------------------------------------------- leaderboards
def _mean_sql(cols) -> str:
    return ("(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + ") / nullif("
            + " + ".join(f"({c} IS NOT NULL)::INT" for c in cols) + ", 0)")


def _board_sql(src: str, lenient: bool, with_time: bool, inside: str = "TRUE", sem_pick: str = "min", digits: int | None = 6) -> str:
    """``inside``: which rows count; a model without such rows stays, with NULLs."""
    cond = "lower(trim(consistent)) = 'true'" if lenient else "consistent = 'True' AND consistent_kind = 'str'"
    tm = ", avg(time) AS mean_time, avg(tps) AS mean_tps" if with_time else ""
    pick = "arg_min_null" if sem_pick == "min" else "arg_max_null"
    rnd = (lambda x, c: f"round({x}, {digits}) AS {c}") if digits else (lambda x, c: f"{x} AS {c}")
    acc = ("gemma2_accuracy", '"llama3.1_accuracy"')
    out = [*([rnd(c, c) for c in ("time", "tps")] if with_time else []), *(rnd(c, c) for c in (*acc, "sem_accuracy")),
           rnd(_mean_sql((*acc, "sem_accuracy")), "average_accuracy"),
           *([rnd(_mean_sql(acc), "judge_accuracy")] if with_time else [])]
    n = f"nullif(count_if({inside}), 0)"
    return f"""
, pv AS (SELECT experiment, verifier, model, count_if(({inside}) AND {cond}) / {n} AS accuracy,
               count_if(({inside}) AND coalesce(sem_score > 0.7, false)) / {n} AS sem_acc{tm}
        FROM {src} WHERE status <> 'error' AND verifier IN ('gemma2', 'llama3.1') GROUP BY ALL)
, g AS (SELECT experiment, model, {"arg_min(mean_time, verifier) AS time, arg_min(mean_tps, verifier) AS tps, " if with_time else ""}
               max(CASE WHEN verifier = 'gemma2' THEN accuracy END) AS gemma2_accuracy,
               max(CASE WHEN verifier = 'llama3.1' THEN accuracy END) AS "llama3.1_accuracy",
               {pick}(sem_acc, verifier) AS sem_accuracy
        FROM pv GROUP BY ALL)
SELECT experiment, model, {", ".join(out)}
FROM g"""


def _board_query(body_sql: str, views=("judge_raw", "answers"), extra=()):
    ctes = O.judged_rows_ctes() + list(extra)
    head = O.with_views(list(views), ctes, "")
    return head.rstrip() + body_sql


_LB_SQL = _board_query(_board_sql("jrows", lenient=False, with_time=True))


@register("leaderboard", _LB_SQL)
def q_leaderboard(spark, sf):
    t = Tables(spark, sf)
    a = t.answers()
    return R.leaderboard(J.judge_rows(a, t.judge_raw(a)))


@register("leaderboard_sorted", _LB_SQL)
def q_leaderboard_sorted(spark, sf):
    return R.sort_leaderboard(q_leaderboard(spark, sf))


@register("leaderboard_filtered", _board_query(
    _board_sql("jrows", lenient=True, with_time=False, inside="id IN (SELECT id FROM filter_ids)", sem_pick="max"),
    views=("judge_raw", "answers", "filter_ids")))
def q_leaderboard_filtered(spark, sf):
    t = Tables(spark, sf)
    a = t.answers()
    return R.leaderboard_filtered(J.judge_rows(a, t.judge_raw(a)), t.filter_ids())


# ---------------------------------------------------------------- retrieval modes
from ragtab.functions import prompts as P  # noqa: E402
from ragtab.operators import answer as A  # noqa: E402
from ragtab.operators import grid as G  # noqa: E402
from ragtab.operators import retrieve as RT  # noqa: E402
from ragtab.operators import route as RO  # noqa: E402
from ragtab.plans.views import MODELS, VERIFIERS, explode_grid  # noqa: E402


@register("retrieve_naive_threshold", O.with_views(
    ["route_questions", "corpus_docs"], O.hits_ctes("h", "route_questions", "corpus_docs", 1, False, 0.5),
    "SELECT * FROM h_hits"))
def q_retrieve_naive(spark, sf):
    t = Tables(spark, sf)
    return RT.retrieve_hits(t.route_questions(), t.corpus_docs(), k=1, threshold=0.5)


@register("retrieve_advanced_rerank", O.with_views(
    ["bench_questions", "corpus_docs"], O.hits_ctes("h", "bench_questions", "corpus_docs", 4, True, 0.5),
    "SELECT * FROM h_hits"))
def q_retrieve_advanced(spark, sf):
    t = Tables(spark, sf)
    return RT.retrieve_hits(t.bench_questions(), t.corpus_docs(), k=4, advanced=True, threshold=0.5)


@register("retrieve_context_prompt", O.with_views(
    ["bench_questions", "corpus_docs"],
    O.hits_ctes("h", "bench_questions", "corpus_docs", 4, True, 0.5) + [O.context_cte("h", "bench_questions")],
    "SELECT id, context FROM h_ctx"))
def q_retrieve_context(spark, sf):
    t = Tables(spark, sf)
    return RT.retrieve(t.bench_questions(), t.corpus_docs(), advanced=True, threshold=0.5, as_prompt=True)


# ---------------------------------------------------------------- routing
_CYBER_RE = r"(^|[^\p{L}\p{N}])(" + "|".join(RO.CYBER_STEMS) + ")"
_ROUTE_CTES = O.hits_ctes("h", "route_questions", "corpus_docs", 1, False, 0.5) + [
    O.context_cte("h", "route_questions"),
    ("routed", f"""SELECT q.id, q.question, q.type, c.context,
        CASE WHEN length(c.context) > 0 THEN 'retrieval'
             WHEN contains(lower(q.question), '{RO.COMPANY}') THEN 'company_specific'
             WHEN regexp_matches(lower(q.question), '{_CYBER_RE}') THEN 'generic_cyber'
             ELSE 'generic_external' END AS rtype
        FROM route_questions q JOIN h_ctx c ON c.id = q.id"""),
]


def _routed(spark, sf):
    t = Tables(spark, sf)
    return RO.route(t.route_questions(), t.corpus_docs())


@register("route_questions", O.with_views(["route_questions", "corpus_docs"], _ROUTE_CTES,
                                          "SELECT id, question, type, context, rtype FROM routed"))
def q_route_questions(spark, sf):
    return _routed(spark, sf).select("id", "question", "type", "context", "rtype")


@register("routing_confusion_long", O.with_views(["route_questions", "corpus_docs"], _ROUTE_CTES + [
    ("labels", "SELECT DISTINCT l FROM (SELECT type AS l FROM routed UNION ALL SELECT rtype FROM routed) WHERE l IS NOT NULL"),
    ("cnt", "SELECT type, rtype, count(*) AS n FROM routed GROUP BY ALL")],
    """SELECT a.l AS type, b.l AS rtype, CAST(coalesce(c.n, 0) AS BIGINT) AS n
       FROM labels a CROSS JOIN labels b LEFT JOIN cnt c ON c.type = a.l AND c.rtype = b.l"""))
def q_confusion_long(spark, sf):
    return RO.confusion_long(_routed(spark, sf))


@register("routing_confusion_wide", O.with_views(["route_questions", "corpus_docs"], _ROUTE_CTES + [
    ("labels", "SELECT DISTINCT l FROM (SELECT type AS l FROM routed UNION ALL SELECT rtype FROM routed) WHERE l IS NOT NULL")],
    "SELECT l.l AS type, " + ", ".join(
        f"CAST(count(r.rtype) FILTER (WHERE r.rtype = '{x}') AS BIGINT) AS {x}" for x in P.ROUTES)
    + " FROM labels l LEFT JOIN routed r ON r.type = l.l GROUP BY l.l"))
def q_confusion_wide(spark, sf):
    return RO.confusion_wide(_routed(spark, sf))


@register("routing_accuracy", O.with_views(["route_questions", "corpus_docs"], _ROUTE_CTES,
    "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(type = rtype AS DOUBLE)), 6) AS accuracy FROM routed"))
def q_routing_accuracy(spark, sf):
    return RO.routing_accuracy(_routed(spark, sf))


@register("route_prompts", O.with_views(["route_questions", "corpus_docs"], _ROUTE_CTES, f"""
SELECT id, rtype,
  CASE rtype {' '.join(f"WHEN '{r}' THEN {P.sql_str(P.ROUTE_SYSTEM[r].format(company='ACME'))}" for r in P.ROUTES)} END AS system,
  CASE rtype WHEN 'retrieval' THEN question || chr(10) || context
             WHEN 'company_specific' THEN {P.sql_str(P.ROUTE_USER[P.ROUTE_COMPANY])}
             WHEN 'generic_cyber' THEN question
             WHEN 'generic_external' THEN {P.sql_str(P.ROUTE_USER[P.ROUTE_GENERAL])} || question END AS prompt
FROM routed"""))
def q_route_prompts(spark, sf):
    return RO.route_prompts(_routed(spark, sf)).select("id", "rtype", "system", "prompt")


# ---------------------------------------------------------------- prompts and answers
@register("qa_prompts", O.with_views(["qa_pairs", "corpus_docs"],
    O.hits_ctes("h", "qa_pairs", "corpus_docs", 1, False, None) + [O.context_cte("h", "qa_pairs")],
    f"SELECT q.id, {P.sql_str(P.QA_SYSTEM)} AS system, q.question || ' ' || c.context AS prompt "
    "FROM qa_pairs q JOIN h_ctx c ON c.id = q.id"))
def q_qa_prompts(spark, sf):
    t = Tables(spark, sf)
    return A.qa_prompts(t.qa_pairs(), t.corpus_docs(), k=1).select("id", "system", "prompt")


def _judge_system_sql(a: str, b: str) -> str:
    return (f"{P.sql_str(P.JUDGE_HEAD)} || coalesce({a}, '') || {P.sql_str(P.JUDGE_MID)} || coalesce({b}, '') "
            f"|| {P.sql_str(P.JUDGE_TAIL)}")


@register("judge_prompts", O.with_views(["answers"], [], f"""
SELECT experiment, model, id, {_judge_system_sql('llm_response', 'response')} AS system,
       '{P.JUDGE_USER_PROMPT}' AS prompt FROM answers"""))
def q_judge_prompts(spark, sf):
    a = Tables(spark, sf).answers()
    return a.select("experiment", "model", "id", P.judge_system("llm_response", "response").alias("system"),
                    F.lit(P.JUDGE_USER_PROMPT).alias("prompt"))


EXT_DOCS = "dataset_docs_emb_lexical_rerank_False"
EXT_TEST = "dataset_test_emb_lexical_rerank_False"


def _ext_answers_sql(name: str, exp: str, corpus: str, advanced: bool = False, hashed: bool = False) -> list[tuple[str, str]]:
    return O.hits_ctes(name, "qa_pairs", corpus, 1, advanced, None, hashed=hashed) + [
        (f"{name}_ans", f"""SELECT '{exp}' AS experiment, m.model, q.id, q.question, q.response,
            coalesce(CAST(h.value AS VARCHAR), '{A.APOLOGY}') AS llm_response, CAST(NULL AS DOUBLE) AS time
            FROM qa_pairs q LEFT JOIN {name}_hits h ON h.query_id = q.id AND h.rank = 1 CROSS JOIN models m""")]


@register("answer_extractive", O.with_views(["qa_pairs", "corpus_docs", "models"],
    _ext_answers_sql("ex", EXT_DOCS, "corpus_docs"), "SELECT * FROM ex_ans"))
def q_answer_extractive(spark, sf):
    t = Tables(spark, sf)
    return A.answer_extractive(t.qa_pairs(), t.corpus_docs(), MODELS, EXT_DOCS)


def _all_answers(spark, sf):
    t = Tables(spark, sf)
    ext = A.answer_extractive(t.qa_pairs(), t.corpus_pairs(), MODELS, EXT_TEST)
    return t.answers().unionByName(ext)


_ALL_CTES = _ext_answers_sql("ex", EXT_TEST, "corpus_pairs") + [
    ("all_answers", "SELECT * FROM answers UNION ALL SELECT * FROM ex_ans"),
    ("all_raw", O.raw_from("all_answers")),
]


#: The settings compared: no retrieval, and two corpora x embedder x plain or advanced retrieval.
SETTINGS = [(mode, emb, adv) for mode in ("test", "docs") for emb in ("lexical", "hashed") for adv in (False, True)]
_CORPUS = {"test": "corpus_pairs", "docs": "corpus_docs"}


def _settings_ctes():
    out, names = [], ["answers"]
    for i, (mode, emb, adv) in enumerate(SETTINGS):
        exp = G.NAME_FORMAT % (mode, emb, adv)
        out += _ext_answers_sql(f"s{i}", exp, _CORPUS[mode], advanced=adv, hashed=emb == "hashed")
        names.append(f"s{i}_ans")
    return out + [("all_answers", " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)), ("all_raw", O.raw_from("all_answers"))]


@register("compare_settings", O.with_views(["answers", "corpus_pairs", "corpus_docs", "judge_raw"],
    _settings_ctes() + O.judged_rows_ctes("all_answers", "all_raw"),
    "").rstrip() + _board_sql("jrows", lenient=False, with_time=True, digits=None).replace(
    "\nSELECT experiment, model, time AS time", "\n, lb AS (SELECT experiment, model, time AS time", 1)
    + """)
SELECT experiment, CAST(count(*) AS BIGINT) AS n_models, round(avg(time), 6) AS time,
       round(avg(sem_accuracy), 6) AS sem_accuracy, round(avg(judge_accuracy), 6) AS judge_accuracy,
       round(avg(average_accuracy), 6) AS average_accuracy FROM lb GROUP BY experiment""")
def q_compare_settings(spark, sf):
    t = Tables(spark, sf)
    pairs, corpora = t.qa_pairs(), {"test": t.corpus_pairs(), "docs": t.corpus_docs()}
    a, found = t.answers(), {}
    for mode, emb, adv in SETTINGS:
        if (mode, emb) not in found:  # one search for plain and reranked answers
            found[mode, emb] = RT.candidates(pairs, corpora[mode], RT.ADVANCED_CANDIDATES, embedder=emb)
        a = a.unionByName(A.answer_extractive(pairs, corpora[mode], MODELS, G.NAME_FORMAT % (mode, emb, adv), advanced=adv, found=found[mode, emb]))
    a = a.checkpoint(eager=True)  # judged, and joined with its judgements
    return R.compare_settings(J.judge_rows(a, t.judge_raw(a)))


# ---------------------------------------------------------------- experiment bookkeeping
def _tasks(spark, sf):
    """(experiment, model) of the answers, from the settings: no search is run for names."""
    a = Tables(spark, sf).answers().select("experiment", "model")
    return a.union(a.select(F.lit(EXT_TEST), "model")).distinct()


@register("experiment_names", O.with_views(["answers", "corpus_pairs", "models"], _ALL_CTES, r"""
SELECT experiment, experiment <> 'no_rag' AS rag,
       CASE WHEN regexp_matches(experiment, '^dataset_(.+)_emb_(.+)_rerank_(True|False)$') THEN regexp_extract(experiment, '^dataset_(.+)_emb_(.+)_rerank_(True|False)$', 1) END AS mode,
       CASE WHEN regexp_matches(experiment, '^dataset_(.+)_emb_(.+)_rerank_(True|False)$') THEN regexp_extract(experiment, '^dataset_(.+)_emb_(.+)_rerank_(True|False)$', 2) END AS emb_model,
       CASE WHEN regexp_matches(experiment, '^dataset_(.+)_emb_(.+)_rerank_(True|False)$') THEN regexp_extract(experiment, '^dataset_(.+)_emb_(.+)_rerank_(True|False)$', 3) = 'True' END AS advanced,
       format('dataset_{}_emb_{}_rerank_{}', 'test', 'lexical', 'False') AS formatted_example
FROM (SELECT DISTINCT experiment FROM all_answers)"""))
def q_experiment_names(spark, sf):
    e = _tasks(spark, sf).select("experiment").distinct()
    return e.select("experiment", *G.parse_experiment("experiment"),
                    G.experiment_name(F.lit("test"), F.lit("lexical"), False).alias("formatted_example"))


@register("experiment_grid", O.with_views(["answers", "corpus_pairs", "models", "verifiers"], _ALL_CTES,
    "SELECT experiment, verifier, model FROM (SELECT DISTINCT experiment, model FROM all_answers) CROSS JOIN verifiers"))
def q_experiment_grid(spark, sf):
    return G.experiment_grid(_tasks(spark, sf))


@register("pending_tasks", O.with_views(["answers", "corpus_pairs", "models", "verifiers", "judge_raw"], _ALL_CTES, """
SELECT e.experiment, g.verifier, e.model FROM (SELECT DISTINCT experiment, model FROM all_answers) e CROSS JOIN verifiers g
WHERE NOT EXISTS (SELECT 1 FROM judge_raw d WHERE d.experiment = e.experiment AND d.verifier = g.verifier AND d.model = e.model)"""))
def q_pending_tasks(spark, sf):
    t = Tables(spark, sf)
    tasks = G.experiment_grid(_tasks(spark, sf))
    done = t.judge_raw().select("experiment", "verifier", "model")
    return G.pending_tasks(tasks, done)


@register("ingest_new_docs", O.with_views(["corpus_docs"], [], """
SELECT * FROM corpus_docs c WHERE c.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"""))
def q_ingest_new(spark, sf):
    t = Tables(spark, sf)
    index = t.table("documents").where(F.col("lang") == "en").select("doc_id")
    return G.ingest_new(index, t.corpus_docs())


@register("leakfree_corpus", O.with_views(["corpus_docs", "corpus_pairs"], [
    ("full_corpus", "SELECT 'docs' AS origin, doc_id, question FROM corpus_docs UNION ALL SELECT 'pairs', doc_id, question FROM corpus_pairs")],
    r"""SELECT origin, doc_id, question FROM full_corpus
WHERE trim(regexp_replace(lower(question), '\s+', ' ', 'g')) NOT IN
      (SELECT trim(regexp_replace(lower(question), '\s+', ' ', 'g')) FROM qa_pairs WHERE question IS NOT NULL)"""))
def q_leakfree(spark, sf):
    t = Tables(spark, sf)
    full = t.corpus_docs().select(F.lit("docs").alias("origin"), "doc_id", "question").unionByName(
        t.corpus_pairs().select(F.lit("pairs").alias("origin"), "doc_id", "question"))
    return G.leak_free(full, t.qa_pairs())


# ---------------------------------------------------------------- chat data
from ragtab.operators import chat as CH  # noqa: E402

_MP_SQL = ("coalesce(instruction, '') || CASE WHEN coalesce(input, '') <> '' THEN chr(10) || 'Your input is:' || chr(10) "
           "|| input ELSE '' END")
_EXT_CTES = [
    ("mp", f"SELECT id, output, {_MP_SQL} AS mp FROM instructions"),
    ("p0", "SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM mp"),
    ("p1", "SELECT *, row_number() OVER (ORDER BY md5('7:1:' || id), id) - 1 AS pos FROM mp"),
    ("p2", "SELECT *, row_number() OVER (ORDER BY md5('7:2:' || id), id) - 1 AS pos FROM mp"),
    ("ext", """SELECT a.id, a.mp AS mp0, a.output AS out0, b.id AS partner_1, b.mp AS mp1, b.output AS out1,
                      c.id AS partner_2, c.mp AS mp2, c.output AS out2
               FROM p0 a JOIN p1 b ON b.pos = a.pos JOIN p2 c ON c.pos = a.pos"""),
]


def _extended(spark, sf):
    return CH.extend_conversations(Tables(spark, sf).instructions(), n=3)


@register("instruction_rows", O.with_views(["qa_pairs"], [],
          "SELECT id, question AS instruction, response AS output, '' AS input FROM qa_pairs"))
def q_instruction_rows(spark, sf):
    return CH.prepare_instruction(Tables(spark, sf).qa_pairs()).select("id", "instruction", "output", "input")


@register("merged_prompts", O.with_views(["instructions"], [], f"SELECT id, {_MP_SQL} AS merged FROM instructions"))
def q_merged_prompts(spark, sf):
    return Tables(spark, sf).instructions().select("id", CH.merge_prompt().alias("merged"))


@register("extended_conversations", O.with_views(["instructions"], _EXT_CTES,
          "SELECT id, partner_1, partner_2 FROM ext"))
def q_extended(spark, sf):
    return _extended(spark, sf).select("id", "partner_1", "partner_2")


@register("chat_roles", O.with_views(["instructions"], _EXT_CTES, """
SELECT id, CAST(t AS BIGINT) AS turn_index, CASE WHEN t % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
       CASE t WHEN 0 THEN mp0 WHEN 1 THEN out0 WHEN 2 THEN mp1 WHEN 3 THEN out1 WHEN 4 THEN mp2 ELSE out2 END AS content
FROM ext CROSS JOIN range(6) r(t)"""))
def q_chat_roles(spark, sf):
    e = _extended(spark, sf)
    return e.select("id", F.posexplode(CH.standardize_roles("conversations")).alias("turn_index", "m")).select(
        "id", F.col("turn_index").cast("long"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def _chat_text_sql() -> str:
    head, end, user_pre, mid2 = CH._template_parts()
    asst = mid2[len(end):]
    turns = " || ".join(f"{P.sql_str(user_pre)} || coalesce(mp{i}, '') || {P.sql_str(end + asst)} || coalesce(out{i}, '') || {P.sql_str(end)}"
                        for i in range(3))
    return f"{P.sql_str(head)} || {P.sql_str(CH.DEFAULT_SYSTEM)} || {P.sql_str(end)} || {turns}"


def _chat_text(spark, sf):
    e = _extended(spark, sf)
    return e.select("id", CH.apply_chat_template(CH.standardize_roles("conversations")).alias("text"))


@register("chat_text", O.with_views(["instructions"], _EXT_CTES, f"SELECT id, {_chat_text_sql()} AS text FROM ext"))
def q_chat_text(spark, sf):
    return _chat_text(spark, sf)


@register("chat_length_bound", O.with_views(["instructions"], _EXT_CTES + [("ct", f"SELECT id, {_chat_text_sql()} AS text FROM ext")],
          f"SELECT id, {O.WORDS.format(x='text')} AS n_words, {O.WORDS.format(x='text')} > 2048 AS over_limit FROM ct"))
def q_chat_length(spark, sf):
    return _chat_text(spark, sf).select("id", *CH.length_bound("text"))


def _segments_sql() -> str:
    head, end, user_pre, mid2 = CH._template_parts()
    begin = head.split("<|start_header_id|>")[0]
    opener = mid2[len(end):]
    return f"""
SELECT conv_id, turn AS seq, '<|start_header_id|>' || role
       || '<|end_header_id|>' || chr(10) || chr(10) || coalesce(text, '') || {P.sql_str(end)} AS segment FROM conversations
UNION ALL
SELECT conv_id, max(turn) + 1 AS seq, {P.sql_str(opener)} AS segment FROM conversations GROUP BY conv_id
UNION ALL
SELECT conv_id, min(turn) - 1 AS seq, {P.sql_str(begin)} AS segment FROM conversations GROUP BY conv_id"""


@register("generation_prompts", _segments_sql())
def q_generation_prompts(spark, sf):
    return CH.generation_segments(Tables(spark, sf).table("conversations"))


@register("generation_prompt_text", """
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10)
       || coalesce(max(CASE WHEN k = 1 AND role = 'system' THEN text END), """ + P.sql_str(CH.DEFAULT_SYSTEM) + """) || '<|eot_id|>'
       || coalesce(string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || coalesce(text, '')
                              || '<|eot_id|>', '' ORDER BY k) FILTER (WHERE NOT (k = 1 AND role = 'system')), '')
       || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt
FROM m GROUP BY conv_id""")
def q_generation_prompt_text(spark, sf):
    convs = CH.conversations_of(Tables(spark, sf).table("conversations"))
    return convs.select("conv_id", CH.generation_prompt().alias("prompt"))


# ---------------------------------------------------------------- sources and sinks
from ragtab.operators import ann as AN  # noqa: E402
from ragtab.operators import embed as EM  # noqa: E402
from ragtab.session import work_path  # noqa: E402
from ragtab.sources import files as FS  # noqa: E402
from ragtab.streaming import route_stream as ZS  # noqa: E402

_ALLOWED_MODELS = [m for m in MODELS if m != "phi3"]
ANSWER_SCHEMA = "id long, question string, response string, llm_response string, time double"


@register("results_tree_scan", O.with_views(["judge_raw", "answers"], O.judged_rows_ctes() + [("jt", _JT_BODY)],
          "SELECT * FROM jt WHERE verifier IN ('gemma2', 'llama3.1') AND model IN ("
          + ", ".join(f"'{m}'" for m in _ALLOWED_MODELS) + ")"))
def q_results_tree_scan(spark, sf):
    t = Tables(spark, sf)
    a = t.answers()
    root = work_path(spark, "results")
    FS.write_results(J.judged_table(a, t.judge_raw(a)), root)
    r = FS.read_results(spark, root, verifiers=VERIFIERS, models=_ALLOWED_MODELS)
    return r.select("experiment", "verifier", "model", "id", "consistent", "justification", "status",
                    "sem_score", "mean_time", "mean_tps", "accuracy", "sem_acc")


@register("list_models", O.with_views(["answers"], [], "SELECT DISTINCT model FROM answers"))
def q_list_models(spark, sf):
    root = work_path(spark, "results")
    FS.write_results(Tables(spark, sf).answers().select("experiment", "model", "id"), root)
    return FS.list_models(FS.read_results(spark, root))


@register("answers_roundtrip", O.with_views(["answers"], [], "SELECT * FROM answers"))
def q_answers_roundtrip(spark, sf):
    a = Tables(spark, sf).answers()
    root = work_path(spark, "answers-csv")
    FS.write_qa_csv(a, root, partition_by=("experiment", "model"))
    back = FS.read_experiments(spark, root, ANSWER_SCHEMA)
    return back.select("experiment", "model", "id", "question", "response", "llm_response", "time")


@register("answers_json_roundtrip", O.with_views(["answers"], [], "SELECT * FROM answers"))
def q_answers_json(spark, sf):
    a = Tables(spark, sf).answers()
    root = work_path(spark, "answers-json")
    FS.write_answer_json(a, root)
    back = FS.read_answer_json(spark, root, "experiment string, " + ANSWER_SCHEMA + ", model string")
    return back.select("experiment", "model", "id", "question", "response", "llm_response", "time")


@register("index_roundtrip", O.with_views(["vectors"], [],
          "SELECT id, label, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm FROM vectors"))
def q_index_roundtrip(spark, sf):
    v = Tables(spark, sf).vectors()
    root = work_path(spark, "index")
    FS.write_index(v, root)
    return FS.read_index(spark, root).select("id", "label", F.round("norm", 6).alias("norm"))


@register("route_stream", O.with_views(["route_questions", "corpus_docs"], _ROUTE_CTES,
                                       "SELECT id, question, type, context, rtype FROM routed"))
def q_route_stream(spark, sf):
    t = Tables(spark, sf)
    src, sink, ck = work_path(spark, "stream-in"), work_path(spark, "stream-out"), work_path(spark, "stream-ckpt")
    t.route_questions().repartition(4).write.parquet(src)
    q = ZS.start_route_stream(spark, src, "id long, question string, type string", t.corpus_docs(), sink, ck,
                              max_files_per_trigger=2)
    q.awaitTermination()
    return ZS.read_routed(spark, sink).select("id", "question", "type", "context", "rtype")


# ---------------------------------------------------------------- model slots (G6, X1, X2) and ANN
@register("generate_batch", O.with_views(["qa_pairs", "corpus_docs", "models"],
    O.hits_ctes("h", "qa_pairs", "corpus_docs", 1, False, None) + [O.context_cte("h", "qa_pairs")], f"""
SELECT q.id, m.model,
       CASE WHEN regexp_matches(q.question || ' ' || c.context, '(?m)^- ')
            THEN regexp_extract(q.question || ' ' || c.context, '(?m)^- ([^\\n]*)', 1) ELSE '{A.APOLOGY}' END AS llm_response,
       false AS has_error, true AS timed
FROM qa_pairs q JOIN h_ctx c ON c.id = q.id CROSS JOIN models m"""))
def q_generate_batch(spark, sf):
    t = Tables(spark, sf)
    p = explode_grid(A.qa_prompts(t.qa_pairs(), t.corpus_docs(), k=1), "mi", "model", MODELS)
    g = A.generate(p.select("id", "model", "system", "prompt"))
    return g.select("id", "model", "llm_response", F.col("error").isNotNull().alias("has_error"),
                    F.col("time").isNotNull().alias("timed"))


@register("embed_batch", O.with_views(
    ["bench_questions", "corpus_docs"],
    O.weighted_scores_ctes("eb", "bench_questions", "id", "question", "corpus_docs", "doc_id", "question") + [O.topk_cte("eb", 4)],
    "SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM eb_top"))
def q_embed_batch(spark, sf):
    """IDF fitted on the corpus, both sides embedded, searched; sparse from the text to the score."""
    t = Tables(spark, sf)
    idf = EM.fit_idf(t.corpus_docs())
    return EM.sparse_topk(EM.embed(t.bench_questions(), idf), EM.embed(t.corpus_docs(), idf), 4)


@register("approx_topk_all_probes", ORACLE["dense_topk_cosine"])
def q_approx_all_probes(spark, sf):
    """J3 with every list probed: equals the exact search."""
    v = Tables(spark, sf).vectors()
    return AN.ivf_topk(v, v, 4, nlist=16, nprobe=16, doc_id="id", exclude_self=True)


@register("approx_topk_by_bound", ORACLE["dense_topk_cosine"])
def q_approx_by_bound(spark, sf):
    """J3 without a budget: the triangle inequality alone ends the visits, so the result is exact."""
    v = Tables(spark, sf).vectors()
    return AN.ivf_topk(v, v, 4, budget=1.0, doc_id="id", exclude_self=True)


@register("pair_score_batch", ORACLE["retrieve_advanced_rerank"])
def q_pair_score_batch(spark, sf):
    t = Tables(spark, sf)
    return RT.retrieve_hits(t.bench_questions(), t.corpus_docs(), k=4, advanced=True, threshold=0.5,
                            pair_score=EM.pandas_pair_score)


@register("approx_topk_recall")
def q_approx_recall(spark, sf):
    v = Tables(spark, sf).vectors()
    approx, seen = AN.ivf_topk(v, v, 4, doc_id="id", exclude_self=True, report=True)
    exact = topk.dense_topk(v, v, 4, doc_id="id", exclude_self=True)
    return AN.recall_at_k(approx, exact).join(seen, "query_id")


# ---------------------------------------------------------------- projections, unions, head
@register("union_results", O.with_views(["answers", "qa_pairs", "corpus_docs", "models"],
    _ext_answers_sql("ex", EXT_DOCS, "corpus_docs"), """
SELECT experiment, model, id, llm_response, time FROM answers
UNION ALL SELECT experiment, model, id, llm_response, CAST(NULL AS DOUBLE) FROM ex_ans"""))
def q_union_results(spark, sf):
    t = Tables(spark, sf)
    ext = A.answer_extractive(t.qa_pairs(), t.corpus_docs(), MODELS, EXT_DOCS).select(
        "experiment", "model", "id", "llm_response")
    return t.answers().select("experiment", "model", "id", "llm_response", "time").unionByName(
        ext, allowMissingColumns=True)


@register("head_questions", O.with_views(["qa_pairs"], [], "SELECT * FROM qa_pairs ORDER BY id LIMIT 3"))
def q_head_questions(spark, sf):
    return Tables(spark, sf).qa_pairs().orderBy("id").limit(3)


@register("metadata_subset", O.with_views(["corpus_docs"], [], "SELECT doc_id, context, response FROM corpus_docs"))
def q_metadata_subset(spark, sf):
    docs = Tables(spark, sf).corpus_docs()
    keys = [k for k in ("id", "context", "response") if k in docs.columns]   # P3: keys present
    return docs.select("doc_id", *keys)


@register("renamed_corpus", O.with_views(["qa_pairs"], [], "SELECT id, question, response AS answer FROM qa_pairs"))
def q_renamed_corpus(spark, sf):
    full = Tables(spark, sf).qa_pairs().withColumnsRenamed({"question": "Question", "response": "Answer"})
    return full.withColumnsRenamed({"Question": "question", "Answer": "answer"})


@register("company_question_ids", O.with_views(["filter_ids"], [], "SELECT id FROM filter_ids"))
def q_company_ids(spark, sf):
    return Tables(spark, sf).filter_ids("de")


@register("route_dataset", O.with_views(["route_questions", "corpus_docs"], _ROUTE_CTES, f"""
SELECT id, question, type,
       CASE WHEN rtype = 'retrieval' AND regexp_matches(question || chr(10) || context, '(?m)^- ')
            THEN regexp_extract(question || chr(10) || context, '(?m)^- ([^\\n]*)', 1)
            WHEN rtype = 'generic_cyber' AND regexp_matches(question, '(?m)^- ')
            THEN regexp_extract(question, '(?m)^- ([^\\n]*)', 1)
            ELSE '{A.APOLOGY}' END AS response,
       rtype
FROM routed"""))
def q_route_dataset(spark, sf):
    t = Tables(spark, sf)
    return RO.route_dataset(t.route_questions(), t.corpus_docs())


@register("retrieve_dense_threshold", O.with_views(["vectors"], O.dense_scores_cte("dv", "cosine", "vectors", "vectors", True) + [
    O.topk_cte("dv", 1)], """
SELECT t.query_id, CAST(t.rank AS BIGINT) AS rank, t.doc_id, t.score, CAST(NULL AS DOUBLE) AS rerank_score, v.label AS value
FROM dv_top t JOIN vectors v ON v.id = t.doc_id WHERE t.score > 0.35"""))
def q_retrieve_dense(spark, sf):
    """G2 with dense vectors (J1) and another metadata key (P11: the label)."""
    v = Tables(spark, sf).vectors()
    return RT.retrieve_hits(v, v.withColumnRenamed("id", "doc_id"), k=1, threshold=0.35, method="cosine",
                            key="label", query_text="embedding", doc_text="embedding", exclude_self=True)


@register("route_questions_model", O.with_views(["route_questions", "corpus_docs"], _ROUTE_CTES,
                                                "SELECT id, question, type, context, rtype FROM routed"))
def q_route_questions_model(spark, sf):
    """G10-G12 through the batch scoring slot (G6) with a stand-in classifier."""
    t = Tables(spark, sf)
    return RO.route_with_model(t.route_questions(), t.corpus_docs(), RO.keyword_classifier).select(
        "id", "question", "type", "context", "rtype")


@register("lexical_topk_grid", O.with_views(
    ["qa_pairs", "corpus_docs"],
    O.lexical_scores_ctes("lg", "qa_pairs", "id", "question", "corpus_docs", "doc_id", "question")
    + [O.topk_cte("lg", 3)],
    "SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM lg_top"))
def q_lexical_topk_grid(spark, sf):
    """J2 through the block-grid plan: every Q/A question against every document
    with the broadcast limit set to 32 KB and corpus blocks of 1 MB, so the query
    side is cut into blocks and cogrouped with the corpus blocks (the plan used when
    questions are many). The corpus comes in one split: blocks follow its bytes."""
    t = Tables(spark, sf)
    return topk.lexical_topk(t.qa_pairs(), t.corpus_docs().coalesce(1), 3, broadcast_bytes=32 * 1024, block_bytes=1 << 20)


# ---------------------------------------------------------------- sweeps (lifecycle: failed calls stay pending)
from ragtab.operators import experiment as X  # noqa: E402


def flaky_row_scorer(system, prompt, model):
    """Fails for about a quarter of the prompts (by their MD5), else repeats the prompt."""
    import hashlib

    if hashlib.md5((prompt or "").encode()).hexdigest()[0] in "0123":
        raise RuntimeError("no model server")
    return prompt


@register("sweep_pending", O.with_views(["qa_pairs", "models"], [], """
SELECT q.id, m.model FROM qa_pairs q CROSS JOIN models m WHERE substr(md5(coalesce(q.question, '')), 1, 1) IN ('0', '1', '2', '3')"""))
def q_sweep_pending(spark, sf):
    """Answer sweep with failing calls: they are no answers, and are what the next run has to do."""
    q = Tables(spark, sf).qa_pairs()
    root = work_path(spark, "sweep")
    X.answer_sweep(spark, q, {}, MODELS, [(None, False)], root, flaky_row_scorer)
    return X.pending_answers(spark, q, MODELS, G.NO_RAG, root).select("id", "model")


from ragtab.plans import catalog_stored  # noqa: E402,F401  (registers the queries over stored tables)
