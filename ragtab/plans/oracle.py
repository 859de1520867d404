"""DuckDB SQL for the oracle check: the derived views as CTEs and SQL builders for
the retrieval scores. Only the driver tables are registered on the DuckDB side,
so every oracle statement inlines the views it needs."""

from __future__ import annotations

from ragtab.plans.views import SHAPES

TOKEN_RE = r"[\p{L}\p{N}]+"

VIEWS: dict[str, str] = {
    "qa_pairs": """
SELECT conv_id * 10000000 + turn AS id, text AS question, nxt_text AS response
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt_text
      FROM conversations) t
WHERE role = 'user' AND nxt_role = 'assistant'""",
    "corpus_pairs": "SELECT id AS doc_id, question, response, CAST(NULL AS VARCHAR) AS context FROM qa_pairs",
    "corpus_docs": """
SELECT doc_id, text AS question, concat('answer from ', source, ' / ', lang) AS response, source AS context
FROM documents""",
    "bench_questions": "SELECT item_id AS id, text AS question FROM benchmark",
    "vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
    "models": "SELECT * FROM (VALUES (0,'phi3'),(1,'mistral'),(2,'gemma2'),(3,'llama3'),(4,'llama3.1'),(5,'qwen2')) AS m(mi, model)",
    "verifiers": "SELECT * FROM (VALUES (0,'gemma2'),(1,'llama3.1')) AS v(vi, verifier)",
    "answers": """
SELECT 'no_rag' AS experiment, m.model, q.id, q.question, q.response,
       CASE WHEN (q.id + m.mi) % 3 = 0 THEN q.response
            WHEN (q.id + m.mi) % 3 = 1 THEN concat(q.question, ' ', q.response)
            ELSE q.question END AS llm_response,
       CAST((q.id * 37 + m.mi * 11) % 97 + 3 AS DOUBLE) / CAST(8 AS DOUBLE) AS time
FROM qa_pairs q CROSS JOIN models m""",
    "judge_raw": """
SELECT a.experiment, v.verifier, a.model, a.id, (a.id + m.mi * 5 + v.vi * 3) % """ + str(len(SHAPES)) + """ AS shape,
       regexp_replace(a.question, '[^A-Za-z ]', ' ', 'g') AS q
FROM answers a JOIN models m ON m.model = a.model CROSS JOIN verifiers v""",
    "route_questions": """
SELECT id,
       CASE WHEN r = 0 THEN concat('Does ACME support this? ', text)
            WHEN r = 1 THEN concat('Is this malware on my network? ', text)
            WHEN r = 2 THEN concat('What is acme? ', text)
            ELSE text END AS question,
       CASE r WHEN 0 THEN 'company_specific' WHEN 1 THEN 'generic_cyber'
              WHEN 2 THEN 'company_specific' ELSE 'generic_external' END AS type
FROM (SELECT item_id AS id, text, item_id % 4 AS r FROM benchmark
      UNION ALL
      SELECT -(conv_id * 10000000 + turn + 1) AS id, text, (conv_id + turn) % 4 AS r
      FROM conversations WHERE role = 'user') u""",
    "filter_ids": "SELECT id FROM qa_pairs WHERE contains(lower(question), 'de')",
    "instructions": """
SELECT id, question AS instruction, response AS output,
       CASE WHEN id % 4 = 0 THEN CAST(id AS VARCHAR) ELSE '' END AS input
FROM qa_pairs""",
}

# view -> views it reads
DEPS: dict[str, list[str]] = {
    "corpus_pairs": ["qa_pairs"],
    "answers": ["qa_pairs", "models"],
    "judge_raw": ["answers", "models", "verifiers"],
    "filter_ids": ["qa_pairs"],
    "instructions": ["qa_pairs"],
}


def _closure(names):
    out: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(views: list[str], extra: list[tuple[str, str]], body: str) -> str:
    """``WITH <views..., extra...> body``."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _closure(views)]
    parts += [f"{n} AS ({s})" for n, s in extra]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def lexical_scores_ctes(prefix: str, q_src: str, q_id: str, q_text: str, d_src: str, d_id: str,
                        d_text: str, hashed: bool = False) -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}_sc(query_id, doc_id, score)``: term-count (or hash
    bucket) cosine of texts sharing a token, rounded to 6 decimals."""
    p = prefix
    if hashed:
        def bucketed(sql):
            return sql.replace("SELECT query_id, tok, count", "SELECT query_id, substr(md5(tok), 1, 3) AS tok, count").replace(
                "SELECT doc_id, tok, count", "SELECT doc_id, substr(md5(tok), 1, 3) AS tok, count").replace("GROUP BY ALL", "GROUP BY 1, 2")
        plain = lexical_scores_ctes(prefix, q_src, q_id, q_text, d_src, d_id, d_text)
        return [(n, bucketed(sql) if n in (f"{p}_qt", f"{p}_dt") else sql) for n, sql in plain]
    return [
        (f"{p}_qt", f"SELECT query_id, tok, count(*) AS c FROM (SELECT {q_id} AS query_id, "
                    f"unnest(regexp_extract_all(lower({q_text}), '{TOKEN_RE}', 0)) AS tok FROM {q_src}) GROUP BY ALL"),
        (f"{p}_dt", f"SELECT doc_id, tok, count(*) AS c FROM (SELECT {d_id} AS doc_id, "
                    f"unnest(regexp_extract_all(lower({d_text}), '{TOKEN_RE}', 0)) AS tok FROM {d_src}) GROUP BY ALL"),
        (f"{p}_qn", f"SELECT query_id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM {p}_qt GROUP BY ALL"),
        (f"{p}_dn", f"SELECT doc_id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM {p}_dt GROUP BY ALL"),
        (f"{p}_dot", f"SELECT query_id, doc_id, CAST(sum(q.c * d.c) AS DOUBLE) AS dot FROM {p}_qt q JOIN {p}_dt d USING (tok) GROUP BY ALL"),
        (f"{p}_sc", f"SELECT query_id, doc_id, round(dot / (qn.n * dn.n), 6) AS score FROM {p}_dot "
                    f"JOIN {p}_qn qn USING (query_id) JOIN {p}_dn dn USING (doc_id)"),
    ]


def weighted_scores_ctes(prefix: str, q_src: str, q_id: str, q_text: str, d_src: str, d_id: str, d_text: str) -> list[tuple[str, str]]:
    """Like ``lexical_scores_ctes`` on hash buckets whose counts are weighted by the corpus's IDF, ``ln((n + 1) / (df + 1))``."""
    p = prefix
    counts = [c for c in lexical_scores_ctes(p, q_src, q_id, q_text, d_src, d_id, d_text, True) if c[0] in (f"{p}_qt", f"{p}_dt")]
    weight = "c * ln(((SELECT count(*) FROM {d}) + 1) / CAST(coalesce(f.df, 0) + 1 AS DOUBLE))".format(d=d_src)
    return counts + [
        (f"{p}_df", f"SELECT tok, count(*) AS df FROM {p}_dt GROUP BY ALL"),
        (f"{p}_qw", f"SELECT query_id, tok, {weight} AS w FROM {p}_qt LEFT JOIN {p}_df f USING (tok)"),
        (f"{p}_dw", f"SELECT doc_id, tok, {weight} AS w FROM {p}_dt LEFT JOIN {p}_df f USING (tok)"),
        (f"{p}_qn", f"SELECT query_id, sqrt(sum(w * w)) AS n FROM {p}_qw GROUP BY ALL"),
        (f"{p}_dn", f"SELECT doc_id, sqrt(sum(w * w)) AS n FROM {p}_dw GROUP BY ALL"),
        (f"{p}_sc", f"SELECT query_id, doc_id, round(sum(q.w * d.w) / (any_value(qn.n) * any_value(dn.n)), 6) AS score FROM {p}_qw q JOIN {p}_dw d USING (tok) "
                    f"JOIN {p}_qn qn USING (query_id) JOIN {p}_dn dn USING (doc_id) GROUP BY ALL HAVING sum(q.w * d.w) > 0"),
    ]


def dense_scores_cte(prefix: str, metric: str, q_src: str, d_src: str, exclude_self: bool) -> list[tuple[str, str]]:
    if metric == "cosine":
        expr = ("CASE WHEN list_dot_product(q.embedding, q.embedding) > 0 AND list_dot_product(d.embedding, d.embedding) > 0 "
                "THEN round(list_dot_product(q.embedding, d.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) "
                "* sqrt(list_dot_product(d.embedding, d.embedding))), 6) END")
    else:
        expr = ("round(1 - list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) "
                "/ sqrt(2), 6)")
    cond = "q.id <> d.id" if exclude_self else "TRUE"
    return [(f"{prefix}_sc", f"SELECT query_id, doc_id, score FROM (SELECT q.id AS query_id, d.id AS doc_id, {expr} AS score "
                             f"FROM {q_src} q JOIN {d_src} d ON {cond}) WHERE score IS NOT NULL")]


def topk_cte(prefix: str, k: int) -> tuple[str, str]:
    """``{prefix}_top(query_id, doc_id, score, rank)`` from ``{prefix}_sc``."""
    return (f"{prefix}_top", f"SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, "
                             f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank "
                             f"FROM {prefix}_sc) WHERE rank <= {k}")


# ---------------------------------------------------------------- judging
def _by_shape(field: int) -> str:
    """The value of a field of ``SHAPES`` for a row's shape."""
    def lit(x):
        return "NULL" if x is None else "'" + x.replace("'", "''").replace("{q}", "' || q || '") + "'"
    return "CASE shape " + " ".join(f"WHEN {i} THEN {lit(x[field])}" for i, x in enumerate(SHAPES)) + " END"


# what each reply says is known from its shape; nothing is parsed here
PARSED = f"""
SELECT experiment, verifier, model, id, {_by_shape(1)} AS status, {_by_shape(2)} AS consistent, {_by_shape(3)} AS consistent_kind,
       {_by_shape(4)} AS justification, {_by_shape(5)} AS justification_kind
FROM judge_raw"""


def sem_ctes(src: str, keys: str, a: str, b: str, out: str = "sem") -> list[tuple[str, str]]:
    """``{out}({keys}, sem_score)``: term-count cosine of two text columns per row."""
    return [
        (f"{out}_t", f"""SELECT {keys}, tok, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(cb) AS BIGINT) AS cb FROM (
             SELECT {keys}, unnest(regexp_extract_all(lower({a}), '{TOKEN_RE}', 0)) AS tok, 1 AS ca, 0 AS cb FROM {src}
             UNION ALL
             SELECT {keys}, unnest(regexp_extract_all(lower({b}), '{TOKEN_RE}', 0)) AS tok, 0 AS ca, 1 AS cb FROM {src}) GROUP BY ALL"""),
        (out, f"""SELECT {keys}, CASE WHEN sum(ca * ca) > 0 AND sum(cb * cb) > 0 THEN
             CAST(sum(ca * cb) AS DOUBLE) / sqrt(CAST(sum(ca * ca) AS DOUBLE) * CAST(sum(cb * cb) AS DOUBLE))
             END AS sem_score FROM {out}_t GROUP BY ALL"""),
    ]


WORDS = r"CAST(len(regexp_extract_all(coalesce({x}, ''), '\S+')) AS BIGINT)"


def judged_rows_ctes(answers: str = "answers", raw: str = "judge_raw") -> list[tuple[str, str]]:
    """``jrows``: parsed verdicts joined to answers with tps and sem_score."""
    return [("parsed", PARSED.replace("FROM judge_raw", f"FROM {raw}"))] + sem_ctes(
        answers, "experiment, model, id", "response", "llm_response") + [
        ("jrows", f"""SELECT p.*, a.time, CAST({WORDS.format(x='a.llm_response')} AS DOUBLE) / a.time AS tps,
                          s.sem_score
                   FROM parsed p JOIN {answers} a USING (experiment, model, id)
                   LEFT JOIN sem s USING (experiment, model, id)"""),
    ]


def raw_from(answers: str) -> str:
    """The judge_raw view over another answers table."""
    return VIEWS["judge_raw"].replace("FROM answers a", f"FROM {answers} a")


JACCARD = """CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN
  round(len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b}))), 6)
  ELSE 0.0 END"""


def tok_list(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN_RE}', 0)"


def hits_ctes(prefix: str, q_src: str, d_src: str, k: int, advanced: bool, threshold: float | None,
              key: str = "response", hashed: bool = False) -> list[tuple[str, str]]:
    """``{prefix}_hits(query_id, rank, doc_id, score, rerank_score, value)`` --
    the retrieval order: top-k (10 when advanced) -> rerank by token Jaccard ->
    top 3 -> threshold on the first-stage score."""
    ck = 10 if advanced else k
    ctes = lexical_scores_ctes(prefix, q_src, "id", "question", d_src, "doc_id", "question", hashed) + [topk_cte(prefix, ck)]
    thr = f"WHERE score > {threshold}" if threshold is not None else ""
    if advanced:
        j = JACCARD.format(a=tok_list("q.question"), b=tok_list("d.question"))
        ctes.append((f"{prefix}_rr", f"""SELECT t.query_id, t.doc_id, t.score, {j} AS rerank_score, d.{key} AS value
            FROM {prefix}_top t JOIN {q_src} q ON q.id = t.query_id JOIN {d_src} d ON d.doc_id = t.doc_id"""))
        ctes.append((f"{prefix}_hits", f"""SELECT query_id, rank, doc_id, score, rerank_score, value FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS BIGINT) AS rank
            FROM {prefix}_rr) WHERE rank <= 3 {'AND score > ' + str(threshold) if threshold is not None else ''}"""))
    else:
        ctes.append((f"{prefix}_hits", f"""SELECT t.query_id, CAST(t.rank AS BIGINT) AS rank, t.doc_id, t.score,
            CAST(NULL AS DOUBLE) AS rerank_score, d.{key} AS value
            FROM {prefix}_top t JOIN {d_src} d ON d.doc_id = t.doc_id {thr}"""))
    return ctes


CONTEXT_HEADER_SQL = "'Use the following information to generate your answer:' || chr(10)"


def context_cte(prefix: str, q_src: str) -> tuple[str, str]:
    """``{prefix}_ctx(id, context)`` for every query."""
    return (f"{prefix}_ctx", f"""SELECT q.id, coalesce(c.context, '') AS context FROM {q_src} q LEFT JOIN (
        SELECT query_id, {CONTEXT_HEADER_SQL} || string_agg('- ' || coalesce(CAST(value AS VARCHAR), '') || chr(10), '' ORDER BY rank) AS context
        FROM {prefix}_hits GROUP BY query_id) c ON c.query_id = q.id""")
