from collections import Counter
import math

from pyspark.sql import functions as F

from ragtab.operators import judge as J

Q = "'"
CASES = [
    # raw text, status, consistent, kind, strict, lenient
    ('{"consistent": "True", "justification": "same (mostly)"}', "ok", "True", "str", 1, 1),
    ('{"consistent": "True", "justification": "same"}', "ok", "True", "str", 1, 1),
    ('Sure! {"consistent": "True", "justification": "ok", "extra": "x"} Bye {"consistent": "False"}', "ok", "True", "str", 1, 1),
    ('{"consistent": "False", "justification": "differs"}', "ok", "False", "str", 0, 0),
    ("{'consistent': 'False', 'justification': 'no'}", "ok", "False", "str", 0, 0),
    ('{\n"consistent": "True"\n}', "missed", "False", "bool", 0, 0),
    ('{"consistent": True, "justification": "bare"}', "ok", "True", "bool", 0, 1),
    ("{}", "ok", None, None, 0, 0),
    ("I cannot compare these.", "missed", "False", "bool", 0, 0),
    ('{"consistent": "True" "justification": }', "malformed", None, None, 0, 0),
    ("{'consistent': 'True', 'justification': 'it\\'s fine'}", "ok", "True", "str", 1, 1),
    ('{"consistent": None}', "ok", None, "none", 0, 0),
    ('{"consistent": "True", "justification": "The statement: True in both texts"}', "ok", "True", "str", 1, 1),
    ("""{'consistent': 'True', 'justification': "it's: None, False"}""", "ok", "True", "str", 1, 1),
    ('{"consistent": "__py_True"}', "ok", "__py_True", "str", 0, 0),
    ('{"consistent": "' + "x" * 2_000_000 + '"}', "ok", "x" * 2_000_000, "str", 0, 0),
    (None, "error", None, None, 0, 0),
]


def test_judgement_shapes(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, raw_text string")
    out = J.parse_judgements(df).withColumn("s", J.strict_true().cast("int")).withColumn(
        "l", J.lenient_true().cast("int")).orderBy("id").collect()
    for r, c in zip(out, CASES):
        assert (r["status"], r["consistent"], r["consistent_kind"], r["s"], r["l"]) == c[1:], c[0]
    assert out[0]["justification"] == "same mostly"  # parentheses are deleted
    assert out[5]["justification"] == "missed"
    assert out[12]["justification"] == "The statement: True in both texts"
    assert out[13]["justification"] == "it's: None, False"


def _py_cos(a, b):
    import regex
    pat = regex.compile(r"[\p{L}\p{N}]+")
    ca, cb = Counter(pat.findall(a.lower())), Counter(pat.findall(b.lower()))
    na = math.sqrt(sum(v * v for v in ca.values()))
    nb = math.sqrt(sum(v * v for v in cb.values()))
    if not na or not nb:
        return None
    return sum(ca[t] * cb[t] for t in ca) / (na * nb)


def test_sem_score_matches_python(spark):
    pairs = [("a b b c", "b c c d"), ("", "x"), ("Same text", "same TEXT"), ("x y", "z"),
             ("Ünïcode wörds ß", "wörds ß ß"), ("tab\tsep", "tab sep")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, response string, llm_response string")
    got = {r["id"]: r["sem_score"] for r in J.with_sem_score(df).collect()}
    for i, (a, b) in enumerate(pairs):
        exp = _py_cos(a, b)
        assert (got[i] is None and exp is None) or abs(got[i] - exp) < 1e-9


def test_group_metrics_keep_unjudged_rows_in_denominator(spark):
    rows = [("e", "v", "m", 1, "True", "str", 0.9, 1.0, 2.0), ("e", "v", "m", 2, None, None, None, None, None),
            ("e", "v", "m", 3, "True", "bool", 0.5, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "experiment string, verifier string, model string, id long, consistent string, "
                                     "consistent_kind string, sem_score double, time double, tps double")
    m = J.group_metrics(df).first()
    assert m["accuracy"] == round(1 / 3, 6)          # only the quoted 'True'
    assert m["accuracy_lenient"] == round(2 / 3, 6)
    assert m["sem_acc"] == round(1 / 3, 6)           # NULL score is a miss
    assert m["mean_time"] == 2.0                      # NULL skipped


def test_nan_is_not_above_threshold(spark):
    from ragtab.functions.vectors import cosine, nan_to_null
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])],
                               "a array<double>, b array<double>")
    r = df.select(cosine("a", "b").alias("c")).collect()
    assert r[0]["c"] is None and r[1]["c"] is None and abs(r[2]["c"] - 1.0) < 1e-12
    x = spark.range(1).select(nan_to_null(F.lit(float("nan"))).alias("v")).first()["v"]
    assert x is None


def test_cosine_symmetric_and_bounded(spark):
    import numpy as np
    from ragtab.functions.vectors import cosine, l2_relevance
    rng = np.random.default_rng(4)
    rows = [(rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    out = df.select(cosine("a", "b").alias("ab"), cosine("b", "a").alias("ba"), l2_relevance("a", "a").alias("self")).collect()
    assert all(r["ab"] == r["ba"] and -1 - 1e-12 <= r["ab"] <= 1 + 1e-12 for r in out)
    assert all(r["self"] == 1.0 for r in out)


def test_tokens_split_equals_extract(spark):
    from ragtab.functions.text import TOKEN_PATTERN, tokens
    texts = ["", "  lead and trail  ", "Ünïcode wörds ß, x1-y2!", "a", "...", None, "tab\tsep\nline", "İstanbul KELVIN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tokens("t").alias("a"),
                    F.coalesce(F.regexp_extract_all(F.lower("t"), F.lit(TOKEN_PATTERN), 0),
                               F.array().cast("array<string>")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_failed_replies_are_no_verdicts(spark):
    rows = [("e", "v", "m", 1, "ok", "True", "str", 0.9, 1.0, 2.0), ("e", "v", "m", 2, "error", None, None, 0.9, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "experiment string, verifier string, model string, id long, status string, consistent string, "
                                     "consistent_kind string, sem_score double, time double, tps double")
    m = J.group_metrics(df).first()
    assert (m["accuracy"], m["n"], m["mean_time"]) == (1.0, 1, 1.0)


def test_each_reply_is_parsed_once(spark):
    """Fields, filters and metrics over the parsed reply read one parse of it (and one tokenising of a pair's texts)."""
    from ragtab.functions.text import token_jaccard, tokens
    from ragtab.operators import report as R

    raw = spark.createDataFrame([("e", "gemma2", "m", 1, "{'consistent': 'True'}")], "experiment string, verifier string, model string, id long, raw_text string")
    a = spark.createDataFrame([("e", "m", 1, "x y", "x", 1.0)], "experiment string, model string, id long, response string, llm_response string, time double")
    plan = R.compare_settings(J.judge_rows(a, raw))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    pair = a.select(token_jaccard(tokens("response"), tokens("llm_response")).alias("j"))
    assert pair._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert pair.first()["j"] == 0.5


def test_reranked_answers_are_ranked_once(spark):
    """The size check of the best hits and their join read the same reranked rows."""
    from ragtab.operators import answer as A

    q = spark.createDataFrame([(1, "a b", "r")], "id long, question string, response string")
    d = spark.createDataFrame([(5, "a b", "yes"), (6, "a c", "no")], "doc_id long, question string, response string")
    out = A.answer_extractive(q, d, ["m"], "e", advanced=True)
    assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["llm_response"] for r in out.collect()] == ["yes"]
