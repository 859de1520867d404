"""Small inputs that the tests of the training-data operators share."""

import random

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = {"t": "x", "n": 1, "key": "k", "order": 2, "node": 3, "digest": "d", "words": "w", "kept": False, "component": 9, "rank": 1,
         "text_key": 5, "keep_id": 7, "score": 0.5, "path": "p", "hash": 4}

ODD = ["", None, " ", "\n\n", "a", "A b", "one two three four", "one two three four five", "x" * 3000, "é ü ß 日本 😀 ́",
       "\t tab\x0b and\x0c feed\r\n", "the same line\nthe same line\nthe same line", "no letters? 123 ... 456", "<|endoftext|> in text",
       "aaaa " * 400, "The of and to. " * 30]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Odd texts, near and exact copies, shared passages, a null id, a repeated row."""
    rng = random.Random(seed)
    texts = list(ODD)
    base = [prose(rng, rng.randrange(20, 300)) for _ in range(12)]
    texts += base
    for b in base[:6]:
        ws = b.split()
        for k in range(4):
            w = list(ws)
            for _ in range(k * max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    passage = prose(rng, 40)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    texts += [passage + passage]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts, 1)]
    rng.shuffle(rows)
    return [*rows, rows[0], rows[5], (None, "without an id", None, None, None)]


def frame(spark, rows, clash=False, parts=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


def duck(**tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(f"_{name}", pdf)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    return con


def same_rows(df, rel):
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def pdf_of(rows):
    import pandas as pd

    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=cols).astype({"doc_id": "Int64", "n_chars": "Int64", "text": object, "lang": object, "source": object})
