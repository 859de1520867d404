"""Language identification with a string kernel.

The kernel is the blended-spectrum presence kernel: the number of byte n-grams (n = 2, 3, 4 of
the lower-cased text, everything but letters as one space) that two texts share, divided by the
root of the product of their own numbers. n-grams are hashed into a fixed number of columns.
Nystroem landmarks L (a bounded sample) turn the kernel into features k(x, L) K_LL^(-1/2), on
which one-versus-rest ridge regression is fitted (kernel ridge regression on the Nystroem
approximation). Both steps after the presence vector are linear, so landmarks, whitening and
ridge weights fold into one matrix (columns x languages), and a batch of texts is scored by one
product of its presence matrix with it.

Only the fit uses a sample: at most ``per_class`` labelled texts of each language, chosen by a
hash of their id; what comes to the driver are their presence bitmaps. Every text is scored whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; a table without
labelled texts makes every prediction ``und``; equal decision values go to the language first in
sorted order; null ids count as the empty text for the fold; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, keep_documents, sample_by_hash, text_key

#: n and log2 of the number of columns that its n-grams are hashed into.
SPECTRUM = ((2, 13), (3, 15), (4, 15))
COLUMNS = sum(1 << bits for _, bits in SPECTRUM)
UND = "und"
#: Bytes below 128 that are no letters become a space.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
#: The pipeline rejects predictions below this score (chance for two languages is 0.5), and texts whose decision value is below
#: MIN_DECISION: clearly less like their language than like the others together, as letters of no language are where at least
#: three were learned. A text of fewer than FEW distinct n-grams, about 15 words, says too little for the latter.
MIN_SCORE, MIN_DECISION, FEW = 0.3, -0.1, 300
#: Rows of the fit that are unpacked at a time.
BLOCK = 256


def columns(text: str) -> np.ndarray:
    """The distinct columns of a text's n-grams, sorted."""
    b = np.frombuffer((" " + " ".join(text.lower().encode().translate(LETTERS).decode(errors="replace").split()) + " ").encode(), np.uint8)
    out, base, code = [], 0, b.astype(np.uint32)
    for n, bits in SPECTRUM:
        while len(code) > max(0, len(b) - n + 1):  # one byte longer
            j = len(b) - len(code) + 1
            code = code[:-1] | b[j:].astype(np.uint32) << np.uint32(8 * j)
        seen = np.zeros(1 << bits, np.bool_)
        seen[(code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)] = True
        out.append(np.flatnonzero(seen) + base)
        base += 1 << bits
    return np.concatenate(out)


@dataclass
class Model:
    """``weights``: columns x languages, to be applied to presence vectors divided by the root of their sum."""
    languages: list[str]
    weights: np.ndarray
    sharpness: float = 8.0

    def score(self, texts: list[str], block: int = 32) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Predicted languages, their scores (softmax of the decision values) and decision values, numbers of distinct n-grams."""
        best, score, decision, sizes = [], [], [], []
        for at in range(0, len(texts), block):
            part = texts[at:at + block]
            x = np.zeros((len(part), COLUMNS), np.float32)
            for row, t in zip(x, part, strict=True):
                row[columns(t)] = 1
            size = x.sum(1, keepdims=True)
            norm = np.sqrt(np.maximum(size, 1))
            f = (x @ self.weights) / norm
            p = np.exp(self.sharpness * (f - f.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            k = f.argmax(1)
            best += [self.languages[i] for i in k]
            score.append(p[np.arange(len(part)), k])
            decision.append(f.max(1))
            sizes.append(size[:, 0])
        joined = lambda xs: np.concatenate(xs).astype(float) if xs else np.zeros(0)
        return best, joined(score), joined(decision), joined(sizes)


def fit(labelled: DataFrame, per_class: int = 200, landmarks: int = 32, ridge: float = 1e-2) -> Model | None:
    """Fit on at most ``per_class`` rows of each language of ``labelled`` (doc_id, text, lang), the first
    ``landmarks`` of each as landmarks. None where nothing is labelled."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    picked = sample_by_hash(usable.select("doc_id", "lang").distinct(), "lang", defaultdict(lambda: per_class))
    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(picked), ["doc_id", "lang"])

    def bitmaps(batches):
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "rank": pdf["rank"], "doc_id": pdf["doc_id"],
                                "bits": [_pack(columns(t)) for t in pdf["text"]]})

    kind = labelled.schema["doc_id"].dataType.simpleString()
    sample = sorted(rows.mapInPandas(bitmaps, f"lang string, rank int, doc_id {kind}, bits binary").collect(),
                    key=lambda r: (r["lang"], r["rank"], r["bits"]))
    sample = list({(r["lang"], r["rank"]): r for r in reversed(sample)}.values())[::-1]  # one row for an id that repeats
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    packed = np.stack([np.frombuffer(r["bits"], np.uint8) for r in sample])

    def blocks(rows: list[int]) -> Iterator[tuple[slice, np.ndarray]]:
        """The presence vectors of some rows, a block at a time; all at once would be eight times the packed ones."""
        for i in range(0, len(rows), BLOCK):
            yield slice(i, i + BLOCK), np.unpackbits(packed[rows[i:i + BLOCK]], axis=1, count=COLUMNS).astype(np.float32)

    every, at = list(range(len(sample))), [i for i, r in enumerate(sample) if r["rank"] <= landmarks]
    norm = np.sqrt(np.maximum(np.concatenate([x.sum(1) for _, x in blocks(every)]), 1)).astype(np.float64)
    k = np.empty((len(sample), len(at)))
    for to, marks in blocks(at):
        for of, x in blocks(every):
            k[of, to] = x @ marks.T
    k /= np.outer(norm, norm[at])
    k_ll = k[at]
    values, vectors = np.linalg.eigh((k_ll + k_ll.T) / 2)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = k @ whiten
    y = np.where(np.array([r["lang"] for r in sample])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weight = 1 / np.array([sum(r["lang"] == s["lang"] for s in sample) for r in sample])  # each language counts alike
    beta = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * np.eye(z.shape[1]), z.T @ (y * weight[:, None]))
    by_mark = ((whiten @ beta) / norm[at][:, None]).astype(np.float32)
    folded = np.zeros((COLUMNS, len(langs)), np.float32)
    for of, marks in blocks(at):
        folded += marks.T @ by_mark[of]
    return Model(langs, folded)


def _pack(cols: np.ndarray) -> bytes:
    flags = np.zeros(COLUMNS, np.uint8)
    flags[cols] = 1
    return np.packbits(flags).tobytes()


def predict(docs: DataFrame, model: Model | None, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, text_key, decision, n_grams for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # columns x languages: of fixed size

    def run(batches):
        m = shared.value
        for pdf in batches:
            lang, score, decision, n_grams = np.full(len(pdf), UND, object), *(np.zeros(len(pdf)) for _ in range(3))
            rows = np.flatnonzero(pdf["scored"].to_numpy(bool)) if m else np.zeros(0, int)
            if len(rows):
                lang[rows], score[rows], decision[rows], n_grams[rows] = m.score([pdf["text"].iat[i] for i in rows])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": lang, "score": score, "text_key": pdf["text_key"],
                                "decision": decision, "n_grams": n_grams.astype(int)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", (bucket(F.col("doc_id"), folds) == held).alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("scored"), text_key(F.col("text")).alias("text_key")) \
        .mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, text_key long, decision double, n_grams long")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, **fit_options) -> DataFrame:
    """Fit on the rows of ``docs`` outside the held-out fold and predict all rows."""
    return predict(docs, fit(docs.filter(bucket(F.col("doc_id"), folds) != held), **fit_options), folds, held)


def langid_stage(docs: DataFrame, min_score: float = MIN_SCORE, min_decision: float = MIN_DECISION, few: int = FEW) -> DataFrame:
    """Rows whose language is known with a score of at least ``min_score`` and, but for texts of fewer than ``few`` distinct
    n-grams, a decision value of at least ``min_decision``; columns unchanged."""
    good = identify(docs).filter((F.col("lang_pred") != UND) & (F.col("score") >= min_score)
                                 & ((F.col("decision") >= min_decision) | (F.col("n_grams") < few)))
    return keep_documents(docs, good)
