import llm_cases as C

from ragtab.llm import license_scan as X

APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
FILES = [("a/LICENSE", MIT), ("a/x.txt", "own words"), ("a/b/y.txt", APACHE + "\nwords"), ("a/b/c/z.txt", "words\n" + "more words"),
         ("a/b/c/COPYING", "nothing to see"), ("q/w.txt", "words"), ("a/b/d/license.md", "text\n" + APACHE), ("a/b/d/e/f.txt", None),
         ("LICENSE", "All rights reserved."), (None, "words"), (None, MIT), ("", "words"), ("a/x.txt", "own words"), ("ab/x.txt", "words"),
         ("t/LICENSE", MIT), ("t/COPYING", MIT), ("t/v.txt", "")]


def test_inheritance_from_the_nearest_directory(spark):
    rows = [(i, p, t, "x") for i, (p, t) in enumerate(FILES)]
    got = {r["key"]: (r["own_license"], r["license"], r["from_path"]) for r in
           X.license_scan(spark.createDataFrame(rows, "key long, path string, text string, dir string").repartition(3)).collect()}
    assert got == {0: ("MIT", "MIT", None), 1: (None, "MIT", "a/LICENSE"), 2: ("Apache-2.0", "Apache-2.0", None), 3: (None, "MIT", "a/LICENSE"),
                   4: (None, "MIT", "a/LICENSE"), 5: (None, "proprietary", "LICENSE"), 6: ("Apache-2.0", "Apache-2.0", None),
                   7: (None, "Apache-2.0", "a/b/d/license.md"), 8: ("proprietary", "proprietary", None), 9: (None, None, None), 10: ("MIT", "MIT", None),
                   11: (None, "proprietary", "LICENSE"), 12: (None, "MIT", "a/LICENSE"), 13: (None, "proprietary", "LICENSE"),
                   14: ("MIT", "MIT", None), 15: ("MIT", "MIT", None), 16: (None, "MIT", "t/COPYING")}


def test_cosine_against_dense_vectors():
    import numpy as np

    m = X.Matcher(X.TEMPLATES, 1000, {"the": 900, "of": 800, "license": 3})
    text = "Licensed under the MIT License, all of the rest."
    ws = sorted({*X.words(text), *m.idf})
    vec = lambda t: np.array([X.words(t).count(w) * m.idf.get(w, m.other) for w in ws])
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    best = max(cos(vec(text), vec(t)) for ts in X.TEMPLATES.values() for t in ts)
    assert abs(m.best(text)[0] - best) < 1e-9


def test_documents_of_the_driver(spark):
    from conftest import SF_MID

    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = X.license_scan(X.document_files(docs)).join(docs.withColumnRenamed("doc_id", "key").select("key", "text"), "key").toPandas()
    assert len(got) == docs.count()
    for line, name in ((APACHE, "Apache-2.0"), (MIT, "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
                       ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0")):
        has = got["text"].map(lambda t, line=line: line in t.split("\n"))
        assert has.any() and (got[has]["own_license"] == name).all()
    none = got["text"].map(lambda t: "icense" not in t and "rights" not in t)
    assert got[none]["own_license"].isna().all()


def test_odd_rows_and_empty_table(spark):
    docs = C.frame(spark, C.odd_rows(), clash=True)
    assert X.license_scan(X.document_files(docs)).count() == docs.count()
    assert X.license_scan(X.document_files(C.frame(spark, []))).count() == 0


def commented(text, mark, width=9):
    ws = text.split()
    return "\n".join(mark + " " + " ".join(ws[k:k + width]) for k in range(0, len(ws), width))


def real_texts():
    gnu = X._GNU_HEADER
    return [("bsd.c", commented(X._BSD.replace("holder", "owner") + X._BSD_WARRANTY, " *"), "BSD-2-Clause"),
            ("gpl2.py", "# Copyright 2020 Jo Doe\n#\n" + commented(gnu.format(kind="", n=2), "#") + "\nimport os\nprint(os)", "GPL-2.0"),
            ("gpl3.py", "x = 1\n" + commented(gnu.format(kind="", n=3), "#", 13), "GPL-3.0"),
            ("agpl.js", commented(gnu.format(kind="Affero ", n=3), "//"), "AGPL-3.0"),
            ("tag.rs", "// SPDX-License-Identifier: GPL-2.0-only\nfn main() {}", "GPL-2.0"),
            ("isc.h", commented(X._ISC_GRANT, " *", 7) + "\nint x;", "ISC"),
            ("corp.txt", "Copyright (c) 2024 Example Corp. All rights reserved.", "proprietary"),
            ("inside.txt", "the file is old and odd and, as said, Licensed under the Apache License, Version 2.0. the rest of it is plain prose", "Apache-2.0"),
            ("mit.txt", "Copyright 2021 Jo Doe\n\n" + X._MIT_GRANT, "MIT"),
            ("mpl.cc", "/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. */", "MPL-2.0"),
            ("members.txt", "All rights reserved for members. the rights", None),
            ("rights.txt", "all of the rights that the members have are reserved for a later version of the work", None),
            ("foo.txt", "Licensed under the Foo Bar Agreement, Version 7.", None)]


def prose():
    import random

    rnd = random.Random(5)
    ws = "the of and to in a is that for it as was with on by this be or are from which at not software version work".split() + [f"word{k}" for k in range(300)]
    return ["\n".join(" ".join(rnd.choice(ws) for _ in range(rnd.randint(3, 20))) for _ in range(rnd.randint(1, 12))) for _ in range(120)]


def test_real_notices(spark):
    data = [(p, t) for p, t, _ in real_texts()] + [(f"p/{k}.txt", t) for k, t in enumerate(prose())]
    got = {r["key"]: r["own_license"] for r in
           X.license_scan(spark.createDataFrame([(p, p, t) for p, t in data], "key string, path string, text string").repartition(4)).collect()}
    assert len(got) == len(data)
    assert {p: got[p] for p, _, _ in real_texts()} == {p: name for p, _, name in real_texts()}
    assert not any(v for k, v in got.items() if k.startswith("p/"))


def test_whole_scan_against_brute_force(spark):
    """Every unit of every text, with the inverse document frequency of every word of the corpus."""
    import re
    from collections import Counter
    from math import log

    import numpy as np

    texts = [t for _, t, _ in real_texts()] + prose() + ["", None, "All rights reserved.", "All rights\nreserved.", X._MIT_GRANT + " " + X._WARRANTY]
    data = [(k, f"d{k}/" + ("LICENSE" if k % 5 == 0 else "x.txt"), t) for k, t in enumerate(texts)]
    tokens = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
    own_lines = lambda t: [x for x in (t or "").split("\n") if x.strip()]
    every = [set(tokens(x)) for t in texts for x in own_lines(t)]
    n = Counter(w for x in every for w in x)
    idf = lambda w: log((1 + len(every)) / (1 + n[w])) + 1

    def cos(a, b):
        a, b = Counter(a), Counter(b)
        va, vb = {w: c * idf(w) for w, c in a.items()}, {w: c * idf(w) for w, c in b.items()}
        size = np.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))
        return sum(va[w] * vb.get(w, 0) for w in va) / size if size else 0.0

    def expected(path, text):
        found, ws = [], tokens(text or "")
        for name, ts in X.TEMPLATES.items():
            for t in map(tokens, ts):
                if path.endswith("LICENSE"):
                    units = [ws]
                else:
                    units = []
                if len(t) >= X.SENTENCE:
                    size = min(len(t), len(ws))
                    units += [ws[s:s + size] for s in range(len(ws) - size + 1) if ws and ws[s] in t]
                else:
                    units += [tokens(s) for x in own_lines(text) for s in re.split(r"(?<=[.;!?])\s+", x)]
                for u in units:
                    if u and set(u) & set(t) and (c := cos(u, t)) >= (X.THRESHOLD if len(t) >= X.SHORT else X.SHORT_THRESHOLD) - 1e-9:
                        found.append((-round(c, 9), name))
        return min(found, default=(None, None))

    want = {k: expected(p, t) for k, p, t in data}
    got = X.license_scan(spark.createDataFrame(data, "key long, path string, text string").repartition(5)).collect()
    assert len(got) == len(data)
    for r in got:
        score, name = want[r["key"]]
        assert r["own_license"] == name, (r, want[r["key"]])
        assert (r["score"] is None) == (score is None) and (score is None or abs(r["score"] + score) < 1e-6)


def test_very_long_text(spark):
    text = "plain words " * 200_000 + X._ISC_GRANT + " plain words" * 50_000  # one line of 3 MB
    df = spark.createDataFrame([(1, "a/x.txt", text), (2, "a/y.txt", "plain words\n" * 300)], "key long, path string, text string")
    assert {r["key"]: r["own_license"] for r in X.license_scan(df).collect()} == {1: "ISC", 2: None}
