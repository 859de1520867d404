"""Derived tables built from the driver's parquet tables (see FIXTURES.md).

Every view reads whole tables; none filters ids to shrink the work. The SQL
text of each view, used by the DuckDB oracle, lives in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtab.session import ensure_checkpoint_dir, ensure_parallel

# The model and verifier grids of the experiments.
MODELS = ["phi3", "mistral", "gemma2", "llama3", "llama3.1", "qwen2"]
VERIFIERS = ["gemma2", "llama3.1"]

#: Judge replies by shape: the text ({q}: letters of the question) and what it says, as status, verdict and its kind,
#: justification and its kind. None: a failed call.
SHAPES = [
    ('{"consistent": "True", "justification": "same (mostly)"}', "ok", "True", "str", "same mostly", "str"),
    ('{"consistent": "True", "justification": "same"}', "ok", "True", "str", "same", "str"),
    ('Sure! {"consistent": "True", "justification": "ok", "extra": "x"} Bye {"consistent": "False"}', "ok", "True", "str", "ok", "str"),
    ('{"consistent": "False", "justification": "differs"}', "ok", "False", "str", "differs", "str"),
    ("{'consistent': 'False', 'justification': 'no'}", "ok", "False", "str", "no", "str"),
    ('{\n"consistent": "True"\n}', "missed", "False", "bool", "missed", "str"),
    ('{"consistent": True, "justification": "bare"}', "ok", "True", "bool", "bare", "str"),
    ("{}", "ok", None, None, None, None),
    ("I cannot compare these.", "missed", "False", "bool", "missed", "str"),
    ('{"consistent": "True" "justification": }', "malformed", None, None, None, None),
    ('{"consistent": "True", "justification": "The statement: True in both texts"}', "ok", "True", "str",
     "The statement: True in both texts", "str"),
    ("""{'consistent': 'True', 'justification': "it's the same: None, False or True"}""", "ok", "True", "str",
     "it's the same: None, False or True", "str"),
    ('{"consistent": "False", "justification": "about: {q}"}', "ok", "False", "str", "about: {q}", "str"),
    ('{"consistent": "__py_True", "justification": None}', "ok", "__py_True", "str", None, "none"),
    (None, "error", None, None, None, None),
]

#: More turns than any conversation has: conversation and turn make a unique id.
TURNS = 10_000_000


def explode_grid(df: DataFrame, idx_name: str, name: str, values: list[str]) -> DataFrame:
    """Repeat every row once per value of a literal parameter list (a generator,
    not a join); adds the value and its position."""
    grid = F.array(*[F.struct(F.lit(i).cast("long").alias(idx_name), F.lit(v).alias(name)) for i, v in enumerate(values)])
    return df.select("*", F.inline(grid))


def model_index(model) -> "F.Column":
    """Position of a model name in the model grid (NULL when absent)."""
    pos = F.array_position(F.array(*[F.lit(m) for m in MODELS]), model)
    return F.when(pos > 0, pos - 1).cast("long")


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.materialize = materialize
        self._memo: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A driver table; spread over the cluster's parallelism when it comes
        from too few file splits (no shuffle for a large, many-file table)."""
        return ensure_parallel(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    # ---- question/answer pairs -------------------------------------------------
    def qa_pairs(self) -> DataFrame:
        """A user turn followed by an assistant turn is one Q/A pair.

        Turns are numbered densely per conversation, so the next turn is an
        equi-join on ``(conv_id, turn + 1)``: no window over a conversation, so a
        conversation holding a third of all turns is not one task. Many jobs read
        the pairs in several branches; with ``materialize`` they are computed once
        and checkpointed to the shared folder instead of re-scanning the
        conversations in every branch."""
        if "qa_pairs" not in self._memo:
            df = self._qa_pairs()
            if self.materialize:
                ensure_checkpoint_dir(self.spark)
                df = df.checkpoint(eager=True)
            self._memo["qa_pairs"] = df
        return self._memo["qa_pairs"]

    def _qa_pairs(self) -> DataFrame:
        c = self.table("conversations").select("conv_id", "turn", "role", "text")
        cur = c.where(F.col("role") == "user").select(
            "conv_id", (F.col("turn") + 1).alias("nturn"), F.col("turn"), F.col("text").alias("question")
        )
        nxt = c.where(F.col("role") == "assistant").select(
            "conv_id", F.col("turn").alias("nturn"), F.col("text").alias("response")
        )
        return cur.join(nxt, ["conv_id", "nturn"]).select(
            (F.col("conv_id") * TURNS + F.col("turn")).alias("id"), "question", "response"
        )

    def corpus_pairs(self) -> DataFrame:
        """The Q/A pairs as a retrieval corpus (the 'test' store of the experiments)."""
        return self.qa_pairs().select(
            F.col("id").alias("doc_id"), "question", "response", F.lit(None).cast("string").alias("context")
        )

    def corpus_docs(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            "doc_id",
            F.col("text").alias("question"),
            F.concat(F.lit("answer from "), F.col("source"), F.lit(" / "), F.col("lang")).alias("response"),
            F.col("source").alias("context"),
        )

    def bench_questions(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))

    def vectors(self) -> DataFrame:
        """Every embedding, as query and as corpus (leave-one-out search)."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
        )

    # ---- parameter grids (literal, tiny) ----------------------------------------
    def models(self) -> DataFrame:
        return self.spark.createDataFrame([(i, m) for i, m in enumerate(MODELS)], "mi long, model string")

    def verifiers(self) -> DataFrame:
        return self.spark.createDataFrame([(i, v) for i, v in enumerate(VERIFIERS)], "vi long, verifier string")

    # ---- answers and raw judgements ---------------------------------------------
    def answers(self) -> DataFrame:
        """Synthetic model answers for every pair and model: the ground truth, the
        question plus the truth, or the question alone, in turn."""
        q = explode_grid(self.qa_pairs(), "mi", "model", MODELS)
        k = F.pmod(F.col("id") + F.col("mi"), F.lit(3))
        return q.select(
            F.lit("no_rag").alias("experiment"),
            "model",
            "id",
            "question",
            "response",
            F.when(k == 0, F.col("response"))
            .when(k == 1, F.concat(F.col("question"), F.lit(" "), F.col("response")))
            .otherwise(F.col("question"))
            .alias("llm_response"),
            (((F.col("id") * 37 + F.col("mi") * 11) % 97 + 3).cast("double") / F.lit(8.0)).alias("time"),
        )

    def judge_raw(self, answers: DataFrame | None = None) -> DataFrame:
        """Judge model text for every answer and verifier, in the shapes of ``SHAPES``; some calls failed."""
        a = self.answers() if answers is None else answers
        a = a.withColumn("mi", model_index(F.col("model")))
        a = explode_grid(a, "vi", "verifier", VERIFIERS)
        sel = F.pmod(F.col("id") + F.col("mi") * 5 + F.col("vi") * 3, F.lit(len(SHAPES)))
        q = F.regexp_replace("question", "[^A-Za-z ]", " ")
        text = F.lit(None).cast("string")
        for i, (shape, *_) in enumerate(SHAPES):
            if shape is not None:
                text = F.when(sel == i, F.concat_ws("", *[x for part in shape.split("{q}") for x in (q, F.lit(part))][1:])).otherwise(text)
        return a.select("experiment", "verifier", "model", "id", text.alias("raw_text"))

    # ---- routing -----------------------------------------------------------------
    def route_questions(self) -> DataFrame:
        """Labelled routing questions, whole texts only: every benchmark passage
        (these occur in the documents, so retrieval tends to answer them) and
        every user turn of the conversations (not in the documents, so the
        company and cyber tests decide), each framed by a fixed lead-in that
        sets its label. Conversation ids are negative so both sources keep
        distinct ids."""
        b = self.table("benchmark").select(F.col("item_id").alias("id"), "text",
                                           F.pmod(F.col("item_id"), F.lit(4)).alias("r"))
        c = (self.table("conversations").where(F.col("role") == "user")
             .select((-(F.col("conv_id") * TURNS + F.col("turn") + 1)).alias("id"), "text",
                     F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).alias("r")))
        r = F.col("r")
        return b.unionByName(c).select(
            "id",
            F.when(r == 0, F.concat(F.lit("Does ACME support this? "), F.col("text")))
            .when(r == 1, F.concat(F.lit("Is this malware on my network? "), F.col("text")))
            .when(r == 2, F.concat(F.lit("What is acme? "), F.col("text")))
            .otherwise(F.col("text"))
            .alias("question"),
            F.when(r == 0, "company_specific")
            .when(r == 1, "generic_cyber")
            .when(r == 2, "company_specific")
            .otherwise("generic_external")
            .alias("type"),
        )

    def filter_ids(self, word: str = "de") -> DataFrame:
        """Ids of the pairs whose question names ``word`` (case-insensitive)."""
        return self.qa_pairs().where(F.contains(F.lower("question"), F.lit(word))).select("id")

    def instructions(self) -> DataFrame:
        """Fine-tuning rows; a quarter carry a non-empty ``input``."""
        return self.qa_pairs().select(
            "id",
            F.col("question").alias("instruction"),
            F.col("response").alias("output"),
            F.when(F.pmod(F.col("id"), F.lit(4)) == 0, F.col("id").cast("string")).otherwise(F.lit("")).alias("input"),
        )
