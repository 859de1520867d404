import random

import llm_cases as C
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ragtab.llm import bpe, packing

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TEXTS = [t or "" for t in C.ODD] + [
    " a", "a  b\n c", "it's  'tis don't x  y　", "<|endoftext|> a<|endoftext|>", "a" * 5000, "ab" * 3000 + " é́..., ,. \x1c \x85 q",
    "x\n\n y\t\tz ", "日本語 テキスト 한국어", "The END. a.́ É. KK <|STARTOFTEXT|> <|endoftext|>b", "3.14, A.,b ., . ,", "ΑΣ ΣΑΣ. İ I",
    "ﬁ Ⅻ", "😀😀 👍🏽", "a\r\nb", "'S 'll it'LL,\n", "x'", "\x00\x01", "a, b. c,\nd.\te", "end.", "end,", "\nstart", "a\n", "a \n", "a\x0bb"]


@pytest.fixture(scope="module")
def byte():
    return bpe.ByteBpe(open(BYTE, encoding="utf-8").read())


def test_ids_and_texts_as_the_library(byte):
    t = Tokenizer.from_file(BYTE)
    for x in TEXTS:
        ids = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(byte.encode(x), "<u4").tolist() == ids, x[:60]
        assert byte.decode(byte.encode(x)) == t.decode(ids, skip_special_tokens=False), x[:60]


def test_segment_tree_against_plain_merging(byte):
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("theinganor ") for _ in range(rng.randrange(1, 60)))
        ids = [byte.first[b] for b in word.encode()]
        want = list(ids)
        while True:
            ranks = [byte.rank.get(a << 16 | b, bpe.NONE) for a, b in zip(want, want[1:], strict=False)]
            if not ranks or min(ranks) == bpe.NONE:
                break
            k = ranks.index(min(ranks))
            want[k:k + 2] = [byte.merged[ranks[k]]]
        assert bpe.merge_all(ids, byte.rank, byte.merged) == want


def test_remembered_is_bounded():
    m = bpe.Remembered(str, 10)
    assert [m[k] for k in range(35)] == [str(k) for k in range(35)] and len(m) <= 10


def test_roundtrip_query(spark):
    import hashlib

    rows = C.odd_rows()
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.roundtrip(C.frame(spark, rows, clash=True), BYTE).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.roundtrip(C.frame(spark, []), BYTE).count() == 0


def test_word_ids_as_the_library():
    t, w = Tokenizer.from_file(WORD), packing.WordEncoder(open(WORD, encoding="utf-8").read())
    for x in TEXTS:
        assert np.frombuffer(w.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x[:60]


@pytest.mark.parametrize("parts", [1, 3])
def test_pieces_cover_documents(spark, parts):
    rng = random.Random(4)
    rows = [*C.odd_rows(), (900, C.prose(rng, 9000), "", "", 0)]
    t = Tokenizer.from_file(WORD)
    want = {}
    for i, x, *_ in rows:
        want[i] = t.encode(x or "", add_special_tokens=False).ids + [2]
    got = packing.pack(C.frame(spark, rows, clash=True, parts=parts), WORD, step_tokens=8192).collect()
    docs, seqs, steps = {}, {}, {}
    for r in got:
        assert r["length"] * 4 == len(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        docs.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
        steps.setdefault(r["step_group"], {})[r["sequence_id"]] = r["sequence_length"]
    copies = {i: sum(1 for r in rows if r[0] == i) for i in want}
    for i, pieces in docs.items():
        ids = sorted(pieces)
        assert sum(len(p) for _, p in ids) == len(want[i]) * copies[i]
        assert all(want[i][s:s + len(p)] == p for s, p in ids)
    assert set(docs) == set(want)
    for pieces in seqs.values():
        end = 0
        for offset, length, whole in sorted(pieces):
            assert offset == end
            end += length
        assert end == whole <= 4096 and end & (end - 1) == 0  # full, so nothing is padded
    full = sorted(sum(s.values()) for s in steps.values())
    assert full[-1] == 8192 and sum(x < 8192 for x in full) <= 2 * parts
    checks = packing.packed_pieces(C.frame(spark, rows, parts=parts), WORD)
    assert checks.filter("ids_crc32 is null").count() == 0


def test_packer_blocks():
    rng = random.Random(6)
    p, rows, n = packing.Packer((4, 8, 16), 32), [], 0
    for k in range(500):
        ids = np.arange(n, n + (m := rng.choice([1, 2, 3, 5, 9, 16, 17, 70]))).astype("<u4")
        n += m
        p.add(k, ids.tobytes())
        if p.held >= 100:
            rows += p.flush()
            assert p.held < 16 and len(p.docs) <= 16
    rows += p.flush(last=True)
    assert sorted(x for r in rows for x in np.frombuffer(r[8], "<u4").tolist()) == list(range(n))
    sizes = {}
    for r in rows:
        sizes[r[4]] = sizes.get(r[4], 0) + r[2]
        assert r[6] in (1, 2, 4, 8, 16)
    assert all(sizes[r[4]] == r[6] for r in rows)
    assert sum(1 for s in sizes.values() if s < 4) <= 2


def test_no_pieces_of_an_empty_table(spark):
    assert packing.packed_pieces(C.frame(spark, []), WORD).count() == 0
