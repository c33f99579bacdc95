import random

import numpy as np
import pytest

from graphloom.llm import near_dedup as N
from graphloom.llm.textbytes import mix


def vec(t):
    """Unweighted shingle counts, for brute force."""
    w = t.lower().split()
    n = min(5, len(w))
    out = {}
    for k in range(len(w) - n + 1) if n else []:
        s = tuple(w[k : k + n])
        out[s] = out.get(s, 0) + 1
    return out


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for k in range(60):
        grams = np.sort(mix(rng.integers(0, 1 << 62, 300).astype(np.uint64)) >> np.uint64(16))
        wa, wb = (rng.integers(900, 4000, 300).astype(np.uint64) for _ in range(2))
        share = rng.random(300)
        a = ((grams << np.uint64(16)) | wa)[share < 0.9]
        b = ((grams << np.uint64(16)) | np.where(share < 0.6, wa, wb))[share > 0.05]
        sig = N.samples(np.concatenate((a, b)), np.array([0, len(a)]))
        errors.append((sig[0] == sig[1]).mean() - N.weighted_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def base(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def corpus():
    rng = random.Random(4)
    rows, group = [], {}
    for g in range(25):
        t = base(rng, rng.choice([60, 200, 700]))
        for c in range(rng.choice([1, 2, 3, 40])):
            x = list(t)
            for _ in range(len(t) // 120 if c % 3 else 0):
                x[rng.randrange(len(x))] = "edit%d" % rng.randrange(10**6)
            group[len(rows)] = g
            rows.append((len(rows), (" ".join(x) if c % 2 else ", ".join(x)), "z"))
    passage = base(rng, 60)
    for k in range(60):  # one passage, different surroundings: similar, not near
        group[len(rows)] = 1000 + k
        rows.append((len(rows), " ".join(passage + base(rng, 60)), "z"))
    for t in ("only three words", "only three words", "other three words", "", None, "!!"):
        group[len(rows)] = t if t and t[0] == "o" else -len(rows)
        rows.append((len(rows), t, "z"))
    return rows, group


def test_groups_against_the_planted_ones(spark):
    rows, group = corpus()
    df = spark.createDataFrame([*rows, (None, rows[0][1], "z"), rows[3], rows[3]], "doc_id long, text string, class_id string")
    got = N.near_duplicates(df).collect()
    assert len(got) == len(rows) + 3
    by = {r["doc_id"]: r["class_id"] for r in got}
    first = {}
    for d in sorted(group):
        first.setdefault(group[d], d)
    wrong = [d for d in group if by[d] != first[group[d]]]
    assert not wrong, wrong
    assert by[None] == 0


def test_pairs_that_no_hub_sees(spark, monkeypatch):
    """With one sample a band, buckets mix components; blocks must find the links between them."""
    monkeypatch.setattr(N, "BLOCK", 3)
    rows, group = corpus()
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    first = {}
    for d in sorted(group):
        first.setdefault(group[d], d)
    assert all(got[d] == first[group[d]] for d in group)


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("edges,want", [([(5, 4), (4, 3), (3, 9), (1, 2), (7, 7), (1, 2)], {5: 3, 4: 3, 3: 3, 9: 3, 1: 1, 2: 1, 7: 7}), ([], {})])
def test_components(spark, edges, want):
    from graphloom.operators.components import connected_components
    from graphloom.storage import Stage

    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df, Stage(spark, "t")).collect()} == want


def test_recall_and_precision_on_the_given_texts(spark):
    """Every pair by the operator's own weights against its classes: at least 0.9 of both."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    texts = t["text"].combine_chunks().fill_null("")
    data, offsets = N._bytes(pa.RecordBatch.from_arrays([texts], ["text"]))
    text, gram, count = N.features(data, offsets)
    df = {}
    for g in gram.tolist():
        df[g] = df.get(g, 0) + 1
    docs = len(texts)
    top = np.log(docs + 1)
    idf = np.array([(top - np.log(df[g] + 1)) / top for g in gram.tolist()])
    w = (1 + np.log(count)) * (1 + N.IDF_SHARE * idf)
    vec = [dict(zip(gram[text == i].tolist(), w[text == i].tolist())) for i in range(docs)]
    total = [sum(v.values()) for v in vec]

    def alike(i, j):
        both = sum(min(x, vec[j][g]) for g, x in vec[i].items() if g in vec[j])
        return both / (total[i] + total[j] - both) if total[i] and total[j] else 0.0

    ids = t["doc_id"].to_pylist()
    sure = {(i, j) for i in range(docs) for j in range(i) if alike(i, j) >= N.THRESHOLD}
    maybe = {(i, j) for i in range(docs) for j in range(i) if alike(i, j) >= N.THRESHOLD - 0.02}
    class_of = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(t.to_pandas())).collect()}
    found = {(i, j) for i in range(docs) for j in range(i) if class_of[ids[i]] == class_of[ids[j]]}
    assert len(sure) >= 10 and len(sure & found) >= 0.9 * len(sure)
    # what a class joins is linked by a chain of similar pairs
    link = {i: {i} for i in range(docs)}
    for i, j in maybe:
        if link[i] is not link[j]:
            link[i] |= link[j]
            for x in link[j]:
                link[x] = link[i]
    assert sum(link[i] is link[j] for i, j in found) >= 0.9 * len(found)
