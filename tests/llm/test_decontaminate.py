import random
import re

import numpy as np

from graphloom.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def align(a, b):
    prev, best = [0] * (len(b) + 1), 0
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(max(0, prev[j] + (1 if x == y else -1), prev[j + 1] - 1, cur[j] - 1))
        best, prev = max(best, *cur), cur
    return best


def test_alignment_against_plain_dynamic_programming():
    rng = np.random.default_rng(0)
    a, b = rng.integers(2, 6, (40, 9)).astype(np.uint64), rng.integers(2, 6, (40, 20)).astype(np.uint64)
    a[:5, 7:] = 0
    b[:9, 15:] = 1
    best, _ = D.smith_waterman(a, b)
    assert best.tolist() == [align([x for x in p.tolist() if x], [x for x in q.tolist() if x != 1]) for p, q in zip(a, b)]


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)] + ["été", "Ünde"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(n) for n in (40, 35, 12, 7, 4, 3, 2, 25)]
    bench = [(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, ""), (None, " ".join(items[1]))]
    docs = []
    for i in range(160):
        body = text(rng.choice([0, 5, 120, 300]))
        if i % 2:
            t = list(items[i % len(items)])
            for _ in range(rng.choice([0, 0, 1, 3])):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], ["edited"], [t[k], "more"]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = t
        docs.append((i, rng.choice([" ", ", "]).join(body).upper() if i % 5 == 0 else " ".join(body), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, " ".join(items[0]), "x"), (502, " ".join(items[0] * 40 + text(9000)), "x"), docs[1], docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    bm = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(df, bm).collect()}
    lower = lambda t: words(" ".join(t))
    ids = {**dict(enumerate(items)), None: items[1]}
    for d, t, _ in docs:
        for i, item in ids.items():
            own, body = lower(item), words(t)
            n = min(5, len(own))
            grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            shares = any(tuple(body[k : k + n]) in grams for k in range(len(body) - n + 1))
            want = align(own, body) / len(own) if shares and len(own) >= 3 and len(body) < 2000 else 0
            if want >= 0.5:
                assert abs(got[(d, i)] - want) < 1e-9, (d, i)
            elif len(body) < 2000:
                assert (d, i) not in got
    assert got[(502, 0)] == 1.0 and got[(None, 0)] == 1.0
    assert D.contaminated(df, bm.where("false")).count() == 0 and D.contaminated(df.where("false"), bm).count() == 0


def test_items_in_several_passes_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"start of it all and item number {i % 7} has these very words inside end") for i in range(20)], "doc_id long, text string")
    bm = spark.createDataFrame([(i, f"item number {i} has these very words inside") for i in range(7)], "item_id long, text string")
    one = sorted(map(tuple, D.contaminated(docs, bm).collect()))
    monkeypatch.setattr(D, "ITEM_WORDS", 20)
    assert sorted(map(tuple, D.contaminated(docs, bm).collect())) == one and len(one) >= 20


def test_edited_and_partial_copies_are_found_however_often_they_stand(spark):
    sizes = (26, 39, 59)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate(sizes)]
    cuts = []
    for k, t in enumerate(items):
        cuts += [(k, [f"x{j}" if j % step == step - 1 else w for j, w in enumerate(t)]) for step in (6, 7)]
        cuts.append((k, t[: -(-52 * len(t) // 100)]))
        cuts.append((k, t[: len(t) // 2] + [f"y{j}" for j in range(len(t) * 45 // 100)] + t[len(t) // 2 :]))  # one long insertion
    docs = [(c * 100 + copy, f"some words before {' '.join(body)} and some after") for c, (_, body) in enumerate(cuts) for copy in range(1 if c % 2 else 30)]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {(d, cuts[d // 100][0]): align(items[cuts[d // 100][0]], t.split()) / sizes[cuts[d // 100][0]] for d, t in docs}
    assert min(want.values()) >= D.THRESHOLD and got == want


def test_short_items_stand_whole(spark):
    docs = spark.createDataFrame([(1, "a quixotic thing"), (2, "nothing here"), (3, "open sesame now"), (4, "open the sesame"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Quixotic"), (2, "open sesame"), (3, "  "), (4, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(docs, items).collect()}
    assert got == {(1, 1): 1.0, (3, 2): 1.0}
