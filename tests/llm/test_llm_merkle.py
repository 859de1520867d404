import hashlib
import random
import zlib

import llm_cases as C
import pytest

from ragtab.llm import merkle as M


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, by whole levels."""

    def leaf(doc_id, text, lang, source, n_chars):
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
        return levels

    def climb(levels, k, digest):
        seen = []
        for d in levels[:-1]:
            start = k - k % 3
            before, after = d[start:k], d[k + 1:start + 3]
            digest = h("".join([*before, digest, *after]))
            seen += before + after
            k //= 3
        return digest, seen

    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = tree([leaf(*r) for r in by_source[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for k, r in enumerate(by_source[s]):
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                shown = (r[0], r[1].replace("\n", ""), *r[2:])
            sub, seen = climb(trees[s], k, leaf(*shown))
            root, more = climb(top, at, sub)
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], h("".join(seen + more)), root, root == top[-1][0], len(seen + more)))
    return sorted(out, key=repr)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "a\nb", "plain", "x\n" * 5, "é\n日"]) if rng.random() < 0.5 else C.prose(rng, 8) + "\n", rng.choice(["en", None]),
             rng.choice(sources), rng.choice([None, 3, 10**10])) for i in range(n)]


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, clash):
    rows = C.odd_rows() + [(10**6, "x\n" * 1_500_000, "en", "src0", 1)]
    got = sorted((tuple(r) for r in M.merkle_manifest(C.frame(spark, rows, clash)).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds_of_small_superblocks(spark, levels):
    """Superblocks of 3 and 9 leaves: several rounds within sources and across them; a source with half the rows."""
    rows = rows_of(levels, 130, ["hot"] * 12 + [f"s{k}" for k in range(11)] + [None, "é", "z"])
    rows += rows[:7] + [(None, "no id\n", None, "hot", None)] * 3
    got = M.merkle_manifest(C.frame(spark, rows), levels).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_small_tables(spark, n):
    rows = [(7 * i, f"t{i}\n", "en", "one", 2) for i in range(n)]
    got = M.merkle_manifest(C.frame(spark, rows))
    assert got.columns == [c.split()[0] for c in M.RESULT.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == (brute(rows) if rows else [])


def test_oracle(spark):
    rows = C.odd_rows() + rows_of(9, 60, ["hot", "hot", "b", "c", None, "d", "e"])
    con = C.duck(documents=C.pdf_of(rows))
    C.same_rows(M.merkle_manifest(C.frame(spark, rows)), con.execute(M.ORACLE))
