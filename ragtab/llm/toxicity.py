"""Toxicity by class-conditional Kneser-Ney models.

Both classes have a model of the letters of words (n-grams of ``ORDER`` letters within the padded
lower-cased word), fitted on a bounded sample of labelled documents. Where a class has seen little,
it backs off to lower-order continuation counts that both share, from ``ORDER`` - 1 letters down to
one; those are of every n-gram of every document, in a table that grows with them. So a rare form of an expression is judged by the parts it shares with others. A context
that one class lacks has that class's probabilities by the shared counts alone.

A document's evidence is log-likelihood under the toxic minus under the ordinary model, divided by
length: over all its words, and the largest over windows of a few words, so that a long document's
other words don't hide a passage. A logistic regression on other labelled rows than the models'
turns these into the score.

Bounds: at most ``per_class`` documents of each class for the models and ``calibrate`` of each for
the regression, taken by a hash of the id; the models' table is bounded by that sample, and so are
the shared counts that are looked up for it. The shared counts themselves and the scores cover all
documents and whole texts.

Defined cases: a null text, or one without letters, has no evidence and the score of the intercept
(less than 0.5); labels that are null or given twice for an id count as missing, or as the largest;
without labels of both classes every score is 0; repeated rows are documents of their own; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import bucket, sample_by_hash, stored

ORDER = 5
DISCOUNT = 0.75
#: Words of the windows whose length-normalised evidence is taken, besides the whole text.
SPANS = (1, 4, 16, 64)
PER_CLASS, CALIBRATE = 2000, 1000
FOLDS, HELD = 5, 0
#: Words, and n-grams, that a task remembers before it starts afresh.
MOST_SEEN = 300_000
LETTERS = re.compile(r"[^\W\d_]+")
PAD = "\x02" * (ORDER - 1)


def words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(word: str) -> list[str]:
    w = PAD + word + "\x03"
    return [w[i:i + ORDER] for i in range(len(w) - ORDER + 1)]


class Model:
    """Evidence of words. table: of an n-gram; default: of a context's other letters."""

    def __init__(self, table: dict[str, float], default: dict[str, float], weights=None, center=None, scale=None):
        self.table, self.default, self.weights, self.center, self.scale = table, default, weights, center, scale

    def word(self, w: str) -> float:
        """Difference of the log-likelihoods a letter."""
        table, default = self.table, self.default
        total, gs = 0.0, grams(w)
        for g in gs:
            x = table.get(g)
            total += default.get(g[:-1], 0.0) if x is None else x
        return total / len(gs)

    def evidence(self, text: str, of) -> np.ndarray:
        v = np.fromiter(map(of, words(text)), float)
        out = np.zeros(1 + len(SPANS))
        if len(v):
            sums = np.concatenate([[0.0], np.cumsum(v)])
            out[0] = sums[-1] / len(v)
            for k, span in enumerate(SPANS, 1):
                out[k] = ((sums[span:] - sums[:-span]).max() if len(v) >= span else sums[-1]) / span
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([np.ones((len(x), 1)), (x - self.center) / self.scale]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def backoff_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables over all documents. counts: gram (of 1 to ORDER - 1 letters), n: how many letters stand before it.
    contexts: context (an n-gram without its last letter), total, kinds: sum and number of its n-grams' counts."""

    def types(batches):
        seen, done = set(), set()
        for pdf in batches:
            fresh = set()
            for t in pdf["text"]:
                fresh.update(words(t))
            fresh -= seen
            new = {g for w in fresh for g in grams(w)} - done
            done = done | new if len(done) < MOST_SEEN else new  # an n-gram handed on again costs time only
            seen = seen | fresh if len(seen) < MOST_SEEN else fresh  # so does a word seen again
            if new:
                yield pd.DataFrame({"gram": list(new)})

    longest = docs.filter("text is not null").select("text").mapInPandas(types, "gram string").distinct()
    ends = F.array("gram", *(F.expr(f"substring(gram, {k})") for k in range(2, ORDER)))
    found = longest.select(F.explode(ends).alias("gram")).distinct()
    counts = stored(found.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")), "toxic-counts")
    contexts = stored(counts.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context"))
                      .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), "toxic-contexts")
    return counts, contexts


def backoff(docs: DataFrame, wanted: set[str], d: float = DISCOUNT) -> dict[str, float]:
    """Of each n-gram of ORDER - 1 letters in ``wanted``, the probability of its last letter after the others by the
    continuation counts of all documents, interpolated down to single letters. Only the counts that these need are gathered."""
    counts, contexts = backoff_counts(docs)
    ends = {g[k:] for g in wanted for k in range(ORDER - 1)}

    def of(table: DataFrame, key: str, keys: set[str]) -> list:  # bounded by ``wanted``
        need = docs.sparkSession.createDataFrame([(k,) for k in sorted(keys)], f"{key} string")
        return table.join(need, key, "left_semi").collect()

    n = {r["gram"]: r["n"] for r in of(counts, "gram", ends)}
    context = {r["context"]: (r["total"], r["kinds"]) for r in of(contexts, "context", {"", *(g[:-1] for g in ends)})}
    prob = {"": 1 / (context.get("", (0, 0))[1] + 1)}  # any letter, or one that no document has
    for g in sorted(ends, key=len):
        total, kinds = context.get(g[:-1], (0, 0))
        prob[g] = max(n.get(g, 0) - d, 0) / total + d * kinds / total * prob[g[1:]] if total else prob[g[1:]]
    return {g: prob[g] for g in wanted}


def with_contexts(counts: dict[str, int]) -> tuple[dict[str, int], Counter, Counter]:
    """The counts, and the sum and number of each context's counts."""
    total, kinds = Counter(), Counter()
    for g, c in counts.items():
        total[g[:-1]] += c
        kinds[g[:-1]] += 1
    return counts, total, kinds


def probability(g: str, p: float, counts: dict[str, int], total: Counter, kinds: Counter, d: float = DISCOUNT) -> float:
    """A class's probability of an n-gram's last letter; ``p``: what the shared counts give it."""
    h = g[:-1]
    if h not in total:
        return p
    return max(counts.get(g, 0) - d, 0) / total[h] + d * kinds[h] / total[h] * p


def kneser_ney(toxic: dict[str, int], ordinary: dict[str, int], shared: dict[str, float], d: float = DISCOUNT) -> Model:
    """Evidence tables from the class's n-gram counts and what the shared counts give the n-grams without their first letter."""
    totals = [with_contexts(counts) for counts in (toxic, ordinary)]
    table = {g: log(probability(g, p := shared[g[1:]], *totals[0], d)) - log(probability(g, p, *totals[1], d)) for g in {*toxic, *ordinary}}
    rest = lambda h, _, total, kinds: d * kinds[h] / total[h] if h in total else 1.0
    default = {h: log(rest(h, *totals[0])) - log(rest(h, *totals[1])) for h in {*totals[0][1], *totals[1][1]}}
    return Model(table, default)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method; the intercept isn't penalised."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + penalty, a.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, calibrate: int = CALIBRATE) -> Model | None:
    """Fit on rows of ``labels`` outside the held-out fold. None without documents of both classes."""
    marked = labels.filter((bucket(F.col("doc_id"), FOLDS) != HELD) & F.col("toxic").isin(0, 1)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.filter(F.col("text").isNotNull())
    there = marked.join(usable.select("doc_id"), "doc_id", "left_semi")
    there = stored(there, "toxic-labels")
    rates = {r["toxic"]: r["n"] for r in there.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(rates) < 2:
        return None
    # half of a small class's rows at least calibrate
    take = {c: min(per_class, (n + 1) // 2) for c, n in rates.items()}
    limit = F.when(F.col("toxic") == 1, take[1]).otherwise(take[0])
    picked = sample_by_hash(there, "toxic", {c: take[c] + calibrate for c in rates}).withColumn("for_model", F.col("rank") <= limit)
    sample = stored(usable.select("doc_id", "text").join(F.broadcast(picked.drop("rank")), "doc_id").dropDuplicates(["doc_id"]), "toxic-sample")

    def count(batches):
        n: dict[int, Counter] = defaultdict(Counter)
        for pdf in batches:
            for t, c in zip(pdf["text"], pdf["toxic"], strict=True):
                n[c].update(words(t))
        for c, ws in n.items():
            gs: Counter = Counter()
            for w, k in ws.items():
                for g in grams(w):
                    gs[g] += k
            if gs:
                yield pd.DataFrame({"toxic": c, "gram": list(gs), "n": list(gs.values())})

    counted = sample.filter("for_model").select("text", F.col("toxic").cast("int").alias("toxic")) \
        .mapInPandas(count, "toxic int, gram string, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n")).toPandas()
    by = {c: dict(zip(x["gram"], x["n"].astype(int), strict=True)) for c, x in counted.groupby("toxic")}
    toxic, ordinary = by.get(1, {}), by.get(0, {})
    model = kneser_ney(toxic, ordinary, backoff(docs, {g[1:] for g in {*toxic, *ordinary}}))
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.default))

    def measure(batches):
        m = Model(*shared.value)
        of = Remembered(m.word).__getitem__
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [m.evidence(t, of).tolist() for t in pdf["text"]]})

    rest = sample.filter("not for_model").select("text", F.col("toxic").cast("int").alias("toxic")) \
        .mapInPandas(measure, "toxic int, x array<double>").toPandas()
    if rest["toxic"].nunique() < 2:
        return None
    x, y = np.array(rest["x"].tolist()), rest["toxic"].to_numpy(float)
    order = np.lexsort(x.T)  # the same sums whatever order the rows came in
    x, y = x[order], y[order]
    model.center, model.scale = x.mean(0), x.std(0) + 1e-9
    n = sum(rates.values())  # weights: the classes as frequent as among the labels
    weight = np.where(y == 1, rates[1] / n / max((y == 1).mean(), 1e-9), rates[0] / n / max((y == 0).mean(), 1e-9))
    model.weights = logistic((x - model.center) / model.scale, y, weight)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model and model.__dict__)

    def run(batches):
        m = Model(**shared.value) if shared.value else None
        of = Remembered(m.word).__getitem__ if m else None
        for pdf in batches:
            s = m.score(np.array([m.evidence(t, of) for t in pdf["t"]]).reshape(len(pdf), 1 + len(SPANS))) if m else np.zeros(len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), F.coalesce("text", F.lit("")).alias("t")) \
        .mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    return score(docs, fit(docs, labels, **fit_options))
