import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import suffix_dedup as S


def brute(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), len(S.runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_long_prefixes_against_sorting():
    rng = np.random.default_rng(0)
    for n, symbols, length in ((200, 2, 6), (500, 4, 5), (300, 1, 9), (64, 30, 3), (1, 3, 4)):
        text = rng.integers(1, symbols + 1, n).astype(np.uint16)
        order, joined = S.long_prefixes(text, length)
        t = text.tolist()
        assert not joined[0]
        for a, b, j in zip(order[:-1], order[1:], joined[1:]):
            x, y = t[a : a + length], t[b : b + length]
            assert x <= y and (j == (x == y and len(x) == length) or len(x) < length or len(y) < length)


def test_windows_of_an_anchor_are_equal_for_equal_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    p, h, w, c = S.anchors(data, np.array([0, 1500, 1500, 1530, 3000]), 40, 8)
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(w, c)])
    want = np.concatenate((np.arange(0, 1461), np.arange(1530, 2961)))
    assert sorted(covered.tolist()) == want.tolist() and ((p >= w + c - 1) & (p < w + 33)).all()
    by = {x: (hh, int(pp - x)) for pp, hh, a, n in zip(p, h, w, c) for x in range(a, a + n)}
    assert all(by[100 + k] == by[2000 + k] for k in range(361))


@pytest.mark.parametrize("group,piece", [(1024, 1 << 20), (2, 1 << 20), (1024, 100)])
def test_against_brute_force(spark, monkeypatch, group, piece):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "TEXT_BYTES", 4000)
    rng = random.Random(3)
    word = lambda n: " ".join(rng.choice(["alpha", "béta", "gam", "d", "epsilon é"]) + str(rng.randrange(99)) for _ in range(n))
    passages = [word(12) for _ in range(6)]
    texts = [None, "", "short", "a" * 500, "ab" * 100]
    for _ in range(60):
        parts = [word(rng.randrange(30))]
        for _ in range(rng.choice([0, 1, 2])):
            p = passages[rng.randrange(6)]
            a = rng.randrange(len(p) // 3)
            parts += [p[a:], word(rng.randrange(9))]
        texts.append(rng.choice(["", "x", " "]).join(parts))
    texts += [texts[7], texts[9], texts[9], texts[10][5:], texts[11] + "!", passages[0] + passages[1] * 3]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(8, texts[8], "z"), (None, texts[12], "z")]
    want = brute([r[1] for r in rows], 50)
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = S.dedup_substrings(df, 50, 8).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(map(key, map(tuple, got))) == sorted(key((r[0], *w)) for r, w in zip(rows, want))


def test_empty(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
