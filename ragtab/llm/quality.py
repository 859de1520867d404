"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes 1 (good), -1 (bad) or abstains (0) on a document. Documents with the same votes
count as one row of a table of at most 3 ** len(RULES) rows; on it expectation-maximisation
estimates, over the documents that pass the base rules, the share of good ones and, for every rule,
how often it is right on good and on bad documents when it votes. A document stays if it passes the base rules and its posterior
probability of being good is at least ``KEEP_FROM``; no single vote decides.

Defined cases: a null text has no words and fails the base rules, as does an empty one; a table
where no rule votes leaves every posterior at the prior; an empty table gives no rows; repeated
rows are documents of their own; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep_documents, stored, text_key

WORD = r"[^\x20\x09-\x0D]"
#: Base rules: fewest words, most words (per cent) that repeated windows may cover, words of a window.
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
KEEP_FROM = 0.5
ROUNDS = 25
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "der", "die", "und", "den", "von", "zu",
                  "das", "mit", "de", "la", "le", "et", "les", "des", "en", "que", "un", "est", "el", "los", "se", "por")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and, of the whole text, the base counts and what the rules look at."""
    d = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("words", F.array_remove(F.split("t", SPACE + "+"), ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    # one hash per window; only where two are equal are positions looked at
    d = d.withColumn("windows", F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int")),
        lambda i: F.xxhash64(F.slice("words", i, WINDOW)))))
    d = d.withColumn("repeats", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hash_at = lambda j: F.get("repeats", j)["h"]
    d = d.withColumn("starts", F.sort_array(F.transform(
        F.filter("repeats", lambda p, j: F.coalesce(p["h"] == hash_at(j - 1), F.lit(False)) | F.coalesce(p["h"] == hash_at(j + 1), F.lit(False))),
        lambda p: p["i"])))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(
        F.transform("starts", lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    ends = F.size(F.filter("lines", lambda x: x.rlike(r"[.!?]" + SPACE + r"*$")))
    known = F.size(F.filter("words", lambda w: F.lower(w).isin(*FUNCTION_WORDS)))
    return d.select(
        "doc_id", "text_key", "n_words", F.length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.size("lines").alias("n_lines"), ends.alias("n_ended"), known.alias("n_known"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count("t", F.lit(r"\p{Lu}\p{Lu}+")).cast("long").alias("n_upper_runs"),
        F.regexp_count("t", F.lit(r"[!?]{2,}")).cast("long").alias("n_shouts"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _share(of: str, whole: str = "n_words") -> Column:
    return F.col(of) / F.greatest(F.col(whole), F.lit(1))


#: What each rule votes on the counts of ``features``; between the two limits it abstains.
RULES = {
    "word_length": lambda: _vote(_share("word_chars").between(3, 10), ~_share("word_chars").between(2, 20)),
    "symbols": lambda: _vote(_share("n_symbols") <= 0.02, _share("n_symbols") > 0.1),
    "dup_lines": lambda: _vote((F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0), _share("n_dup_lines", "n_lines") > 0.3),
    "repeat_words": lambda: _vote((F.col("n_words") >= 40) & (_share("n_repeat_words") <= 0.05), _share("n_repeat_words") > 0.2),
    "length": lambda: _vote(F.col("n_words") >= 60, F.col("n_words") < 20),
    "function_words": lambda: _vote(_share("n_known") >= 0.05, (F.col("n_words") >= 40) & (F.col("n_known") == 0)),
    "letters": lambda: _vote(_share("n_letters", "word_chars") >= 0.85, _share("n_letters", "word_chars") < 0.75),
    "line_ends": lambda: _vote(_share("n_ended", "n_lines") >= 0.6, _share("n_ended", "n_lines") < 0.1),
    "shouting": lambda: _vote((_share("n_shouts") <= 0.01) & (_share("n_upper_runs") <= 0.05),
                              (_share("n_shouts") > 0.1) | (_share("n_upper_runs") > 0.5)),
}


def votes(counts: DataFrame) -> DataFrame:
    return counts.select("*", *(rule().alias(f"v_{name}") for name, rule in RULES.items()))


def posterior(model: dict) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r in RULES:
        on_good, on_bad = model[r]
        odds += F.when(F.col(f"v_{r}") == 1, math.log(on_good / (1 - on_bad))) \
            .when(F.col(f"v_{r}") == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rounds: int = ROUNDS, tolerance: float = 1e-5) -> dict:
    """EM over the table of vote patterns (v_<rule>..., n). What comes back in each round is one row of sums.
    A rule's parameters are (right on good, right on bad) documents, kept at 0.5 or more so that good means good."""
    model: dict = {"prior": 0.8} | {r: (0.8, 0.7) for r in RULES}
    clip = lambda x, low=0.5: min(max(x, low), 0.999)
    for _ in range(rounds):
        q = patterns.withColumn("good", posterior(model) * F.col("n")).withColumn("bad", F.col("n") - F.col("good"))
        sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
        for r in RULES:
            v = F.col(f"v_{r}")
            sums += [F.sum(F.when(v == 1, F.col("good")).otherwise(0.0)).alias(f"g1_{r}"), F.sum(F.when(v != 0, F.col("good")).otherwise(0.0)).alias(f"g_{r}"),
                     F.sum(F.when(v == -1, F.col("bad")).otherwise(0.0)).alias(f"b1_{r}"), F.sum(F.when(v != 0, F.col("bad")).otherwise(0.0)).alias(f"b_{r}")]
        s = q.agg(*sums).first()
        if not s["n"]:
            return model
        new: dict = {"prior": clip(s["good"] / s["n"], 0.001)}
        for r in RULES:  # one pseudo-document at the start value on each side
            new[r] = (clip((s[f"g1_{r}"] + 0.8) / (s[f"g_{r}"] + 1)), clip((s[f"b1_{r}"] + 0.7) / (s[f"b_{r}"] + 1)))
        moved = max(abs(new["prior"] - model["prior"]), *(abs(x - y) for r in RULES for x, y in zip(new[r], model[r], strict=True)))
        model = new
        if moved < tolerance:
            break
    return model


def quality(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior of every row of ``docs``."""
    voted = stored(votes(features(docs)), "quality-votes")
    names = [f"v_{r}" for r in RULES]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    # only documents that the base rules leave are for the votes to decide
    model = fit(stored(voted.filter(~failed).groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "quality-patterns"))
    p = posterior(model)
    return voted.select("doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & (p >= keep_from)).alias("kept"), p.alias("posterior"), *names)


def quality_stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    return keep_documents(docs, quality(docs).filter("kept"))
