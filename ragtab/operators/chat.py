"""Chat fine-tuning data (F1-F8, J10): instruction rows, merged prompts,
conversation extension, role standardisation and chat-template rendering.

Conversations are ``ARRAY<STRUCT<from|role, value|content>>`` columns built and
rendered with higher-order functions; dense positions for the extension are
computed without a single-partition window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ragtab.functions.text import word_count
from ragtab.session import ensure_checkpoint_dir

# Merged-prompt format (the bracketed part is dropped when input is
# empty), role names before and after standardisation, the chat template and the
# default system message, and the sequence-length bound.
MERGED_PROMPT = "{instruction}[[\nYour input is:\n{input}]]"
ROLE_MAP = {"human": "user", "gpt": "assistant", "system": "system", "user": "user", "assistant": "assistant"}
CHAT_TEMPLATE = """<|begin_of_text|><|start_header_id|>system<|end_header_id|>

{SYSTEM}<|eot_id|><|start_header_id|>user<|end_header_id|>

{INPUT}<|eot_id|><|start_header_id|>assistant<|end_header_id|>

{OUTPUT}<|eot_id|>"""
DEFAULT_SYSTEM = ("You are a Cyber helpful assistant. Below are some examples of questions you are able to "
                  "answer, and their correct answers")
MAX_SEQ_LENGTH = 2048


def prepare_instruction(df: DataFrame, question: str = "question", answer: str = "response") -> DataFrame:
    """rename to instruction/output and add an empty input (P1 + P2)."""
    return df.withColumnsRenamed({question: "instruction", answer: "output"}).withColumn("input", F.lit(""))


def merge_prompt(instruction="instruction", input_="input", fmt: str = MERGED_PROMPT) -> Column:
    """fill ``{instruction}``/``{input}``; a ``[[...]]`` part is kept only when
    every field inside it is non-empty. The format is split on the driver."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x

    cols = {"instruction": c(instruction), "input": c(input_)}

    def render(piece: str) -> tuple[Column, list[str]]:
        parts, used, rest = [], [], piece
        while "{" in rest:
            pre, _, after = rest.partition("{")
            name, _, rest = after.partition("}")
            parts += [F.lit(pre), F.coalesce(cols[name], F.lit(""))]
            used.append(name)
        parts.append(F.lit(rest))
        return F.concat(*parts), used

    out, rest = [], fmt
    while "[[" in rest:
        pre, _, after = rest.partition("[[")
        opt, _, rest = after.partition("]]")
        out.append(render(pre)[0])
        expr, used = render(opt)
        cond = F.lit(True)
        for u in used:
            cond = cond & (F.coalesce(cols[u], F.lit("")) != "")
        out.append(F.when(cond, expr).otherwise(F.lit("")))
    out.append(render(rest)[0])
    return F.concat(*out)


def dense_positions(df: DataFrame, order: list[Column], out: str = "pos", partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` without a global window.

    Range-partition on the order, sort inside partitions, take the index inside
    the partition from ``monotonically_increasing_id`` (partition id in the high
    bits), and add the row count of all earlier partitions (a table with one row
    per partition, broadcast). The ranked rows are checkpointed to the shared
    folder first, so both uses read the same partitioning."""
    spark = df.sparkSession
    # at least as many range partitions as the input has splits, so a large
    # table keeps split-sized partitions
    n = partitions or max(1, spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    ranked = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    ensure_checkpoint_dir(spark)
    ranked = ranked.checkpoint(eager=True)
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (ranked.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_loc")).cast("long"))
            .drop("_pid", "_mid", "_loc", "_off"))


def shuffle_key(id_col: str, copy: int, seed: int = 7) -> Column:
    """Shuffle order of copy ``copy``: a hash of seed, copy and id, so copies are independent of each other (the same
    text in any SQL engine)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(copy)), F.col(id_col).cast("string")))


def extend_conversations(df: DataFrame, n: int = 3, id_col: str = "id", seed: int = 7) -> DataFrame:
    """each row gains the (merged prompt, output) pairs of ``n - 1`` other rows
    taken from seeded shuffled copies: copy c's row at position i joins the row at
    position i of the id order (J10). N rows in, N rows out, and every row is
    used exactly n times. Only ids are sorted and joined by position; texts are
    fetched by id. Adds ``partner_1..`` ids and ``conversations``
    (``ARRAY<STRUCT<from, value>>``)."""
    ids = df.select(id_col)
    pairs = dense_positions(ids, [F.col(id_col)], "_p0")
    partners = [f"partner_{c}" for c in range(1, n)]
    for c, name in enumerate(partners, 1):
        order = dense_positions(ids.withColumn("_k", shuffle_key(id_col, c, seed)), [F.col("_k"), F.col(id_col)], "_p0")
        pairs = pairs.join(order.select("_p0", F.col(id_col).alias(name)), "_p0")
    base = df.withColumn("_mp", merge_prompt())
    cur = base.join(pairs.drop("_p0"), id_col)
    turns = [F.struct(F.lit("human").alias("from"), F.col("_mp").alias("value")),
             F.struct(F.lit("gpt").alias("from"), F.col("output").alias("value"))]
    for c, name in enumerate(partners, 1):
        cur = cur.join(base.select(F.col(id_col).alias(name), F.col("_mp").alias(f"_mp{c}"), F.col("output").alias(f"_out{c}")), name)
        turns += [F.struct(F.lit("human").alias("from"), F.col(f"_mp{c}").alias("value")),
                  F.struct(F.lit("gpt").alias("from"), F.col(f"_out{c}").alias("value"))]
    return cur.select(*df.columns, *partners, F.array(*turns).alias("conversations"))


def standardize_roles(conv="conversations") -> Column:
    """``from``/``value`` -> ``role``/``content`` with human->user, gpt->assistant."""
    m = F.create_map(*[F.lit(x) for kv in ROLE_MAP.items() for x in kv])
    c = F.col(conv) if isinstance(conv, str) else conv
    return F.transform(c, lambda t: F.struct(F.coalesce(m[t["from"]], t["from"]).alias("role"),
                                             t["value"].alias("content")))


def _template_parts(template: str = CHAT_TEMPLATE):
    head, rest = template.split("{SYSTEM}")
    mid1, rest = rest.split("{INPUT}")
    mid2, end = rest.split("{OUTPUT}")
    if not mid1.startswith(end):
        raise ValueError("template: the system block must end with the turn end marker")
    return head, end, mid1[len(end):], mid2


def _role_block(template: str):
    """Renders one message: a header naming its role, the content, the end marker."""
    _, end, user_pre, _ = _template_parts(template)
    before, _, after = user_pre.partition("user")
    return lambda role, content: F.concat(F.lit(before), role, F.lit(after), F.coalesce(content, F.lit("")), F.lit(end))


def apply_chat_template(messages="messages", system=None, template: str = CHAT_TEMPLATE,
                        default_system: str = DEFAULT_SYSTEM) -> Column:
    """system block once (``system``, else the conversation's own opening system
    turn, else the default message), then a block per message with its own role, later
    system turns included. The template is split into literals once on the driver."""
    head, end, _, _ = _template_parts(template)
    block = _role_block(template)
    msgs = F.col(messages) if isinstance(messages, str) else messages
    first = F.get(msgs, F.lit(0))
    own = F.coalesce(first["role"] == "system", F.lit(False))
    given = system if system is not None else F.lit(None).cast("string")
    sys_c = F.coalesce(given, F.when(own, first["content"]), F.lit(default_system))
    rest = F.filter(msgs, lambda m, i: ~(own & (i == 0)))
    body = F.array_join(F.transform(rest, lambda m: block(m["role"], m["content"])), "")
    return F.concat(F.lit(head), sys_c, F.lit(end), body)


def generation_prompt(messages="messages", template: str = CHAT_TEMPLATE, **kw) -> Column:
    """F8 as one value: the rendered conversation and the opening of the assistant's answer."""
    _, end, _, mid2 = _template_parts(template)
    return F.concat(apply_chat_template(messages, template=template, **kw), F.lit(mid2[len(end):] if mid2.startswith(end) else mid2))


def conversations_of(turns: DataFrame) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) -> one row per conversation with ``messages`` in turn order. A
    conversation is one value here; ``generation_segments`` is the form for conversations of any length."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(m.alias("messages"))


def length_bound(text="text", limit: int = MAX_SEQ_LENGTH) -> list[Column]:
    """a length in whitespace words and whether it exceeds the bound (rows are
    flagged, never dropped)."""
    n = word_count(text)
    return [n.alias("n_words"), (n > limit).alias("over_limit")]


def tokenizer_length_bound(text, count_tokens, limit: int = MAX_SEQ_LENGTH) -> list[Column]:
    """F7 with a model tokenizer: ``count_tokens(list[str]) -> list[int]`` runs on
    Arrow batches (load the tokenizer once per worker inside the callable).
    Returns the token count and the over-limit flag; rows are never dropped."""
    @F.pandas_udf(LongType())
    def _count(s: pd.Series) -> pd.Series:
        return pd.Series(list(count_tokens([x if isinstance(x, str) else "" for x in s])), dtype="int64")

    n = _count(F.col(text) if isinstance(text, str) else text)
    return [n.alias("n_tokens"), (n > limit).alias("over_limit")]


def generation_segments(turns: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """F8: role/content rows (conv_id, turn, role, text) -> prompt segments in
    turn order: the begin marker before the first turn, a block per turn, the
    assistant opener after the last; concatenating a conversation's segments by
    ``seq`` gives its generation prompt. Long form, so a very long conversation is
    never one row or one task."""
    head, end, user_pre, mid2 = _template_parts(template)
    begin = head.split("<|start_header_id|>")[0]
    opener = mid2[len(end):] if mid2.startswith(end) else mid2
    msgs = turns.select("conv_id", F.col("turn").alias("seq"), _role_block(template)(F.col("role"), F.col("text")).alias("segment"))
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi")).select("conv_id", F.inline(F.array(
        F.struct((F.col("lo") - 1).alias("seq"), F.lit(begin).alias("segment")),
        F.struct((F.col("hi") + 1).alias("seq"), F.lit(opener).alias("segment")))))
    return msgs.unionByName(ends)
