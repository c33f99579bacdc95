import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from graphloom.llm import bloom_lm as B
from graphloom.llm.textbytes import mix


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_filter_reads_back_levels():
    rng = np.random.default_rng(0)
    h = mix(np.arange(40_000, dtype=np.uint64))
    n = rng.zipf(1.6, 20_000).astype(np.int64).clip(1, 10**6)
    f = B.LogCounts(B.LogCounts.sized(int(B.level(n).sum())))
    f.add(h[:20_000], B.level(n))
    got = f.counts(h[:20_000])
    assert (got >= B.VALUES[B.level(n) - 1]).all() and (got > n).mean() < 0.01 and (got >= n * 0.8).all()
    assert (f.counts(h[20_000:]) > 0).mean() < 0.01


def plain_model(texts, own):
    """P of (u, w) over dictionaries, w an own word, None (end) or True (the class); and what a class word has of it."""
    c = Counter(w for t in texts for w in toks(t))
    head = {w for w, _ in c.items() if own(c[w])}
    kind = lambda w: w if w is None or w in head else True
    pairs, seen = Counter(), Counter()
    for t in texts:
        seq = [None, *map(kind, toks(t)), None]
        pairs.update(zip(seq, seq[1:]))
        seen.update(seq[:-1])
    n, v = sum(c.values()) + len(texts), len(c) + 1
    norm = n + 0.5 * (v + 1)
    one = {w: (c[w] + 0.5) / norm for w in head} | {None: (len(texts) + 0.5) / norm}
    one[True] = 1 - sum(one.values())
    ones, twos = (sum(k == x for k in pairs.values()) for x in (1, 2))
    d = ones / (ones + 2 * twos)
    q = {k: int(B.VALUES[B.level(np.array([x]))[0] - 1]) for k, x in pairs.items()}
    left = Counter({u: x for u, x in seen.items()})
    for (u, _), x in q.items():
        left[u] -= x - d
    p = lambda u, w: max(q.get((u, w), 0) - d, 0) * ((u, w) in q) / max(seen[u], 1) + (left[u] / seen[u] if seen[u] else 1) * one[w]
    return p, kind, one, lambda w: (c[w] + 0.5) / norm / one[True]


def test_scores_against_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(B, "HEAD", 60)
    monkeypatch.setattr(B, "ENTRY_BITS", 400)
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(150)], [1 / (i + 1) for i in range(150)], k=rng.choice([0, 5, 90]))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in toks(t))
    least = B._head_count(spark.createDataFrame([(x,) for x in counts.values()], "n long"), B.HEAD)
    p, kind, one, share = plain_model(train, lambda x: x >= least)
    assert len(one) > 10 and any(kind(w) is True for w in counts)
    for u in list(one)[:20]:
        assert abs(sum(p(u, w) for w in one) - 1) < 1e-9
    want = {}
    for i, t in enumerate(texts):
        seq = [None, *toks(t), None]
        want[i] = sum(math.log10(p(kind(u), kind(w)) * (share(w) if kind(w) is True else 1)) for u, w in zip(seq, seq[1:]))
    for regions, hot in ((256, 1 << 18), (2, 50), (2, 0)):  # one part, and many; all pairs hot, some, none
        monkeypatch.setattr(B, "PART_REGIONS", regions)
        monkeypatch.setattr(B, "HOT", hot)
        got = {r["doc_id"]: r["score"] for r in B.score_texts(df).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_every_word_has_pairs_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST", 60)
    monkeypatch.setattr(B, "ENTRY_BITS", 400)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(150)], [1 / (i + 1) for i in range(150)], k=rng.choice([0, 5, 90]))) for _ in range(150)]
    texts += [f"w1 new{i} new{i} w140 w141 new{i} new{i}" for i in range(40)] + ["x1 x2", "x1 x2 x3 x1 x2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    p, kind, one, share = plain_model(train, lambda x: True)
    want = {}
    for i, t in enumerate(texts):
        seq = [None, *toks(t), None]
        want[i] = sum(math.log10(p(kind(u), kind(w)) * (share(w) if kind(w) is True else 1)) for u, w in zip(seq, seq[1:]))
    for most, tail_bytes in ((60, 32 << 20), (60, 4000), (0, 4000), (1 << 18, 4000)):  # one bucket, and many; no word known to all, and all
        monkeypatch.setattr(B, "BROADCAST", most)
        monkeypatch.setattr(B, "TAIL_BYTES", tail_bytes)
        got = {r["doc_id"]: r["score"] for r in B.score_texts(df).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_pairs_of_the_rarest_of_many_words(spark):
    words = [f"w{i}" for i in range(280_000)]
    texts = [" ".join(words[a : a + 100]) for a in range(0, len(words), 100)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    p, kind, one, _ = plain_model(train, lambda x: True)
    want = [sum(math.log10(p(kind(u), kind(w))) for u, w in zip([None, *toks(t)], [*toks(t), None])) for t in texts]
    got = {r["doc_id"]: r["score"] for r in B.score_texts(df).collect()}
    near = [abs(got[i] - x) < 0.05 * abs(x) for i, x in enumerate(want)]  # the filter has false positives
    assert len(got) == len(texts) and sum(near) > 0.99 * len(near)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "HEAD", 40)
    rng = random.Random(1)
    vocab = [f"W{i}," for i in range(200)] + ["été", "the", "The\x0b", "a b"]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))], k=rng.choice([0, 3, 50, 400]))) for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "", "x"), (502, "new " * 3, "x"), (None, "the the", "x"), (3, texts[3], "x"), (3, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter()
    for d, t, _ in rows:
        if not held(d):
            c.update([*toks(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((d is not None, d or 0, held(d), len(toks(t)) + 1, sum(c[w] > 0 for w in [*toks(t), None]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*toks(t), None]), 6)) for d, t, _ in rows)
    res = B.score_texts(df).collect()
    assert sorted((r[0] is not None, r[0] or 0, r[1], r[2], r[3], r[4], round(r[5], 6)) for r in res) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in res)


def test_pairs_help_on_held_out_texts(spark):
    rng = random.Random(2)
    after = {i: [rng.randrange(300) for _ in range(3)] for i in range(300)}

    def text():
        w, out = rng.randrange(300), []
        for _ in range(150):
            out.append(f"w{w}")
            w = rng.choice(after[w])
        return " ".join(out)

    res = B.score_texts(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in res) > sum(r["base_score"] for r in res) * 0.5


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.score_texts(df).count() == 0


def test_beats_its_base_on_the_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = B.score_texts(docs).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert r["s"] > r["b"]
