import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphloom.llm import huffman_ids as H
from graphloom.llm import packing as P
from graphloom.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, source string, n_tokens string, part string"


def rows():
    texts = ["Hello, World!", "", None, "it's  they're\n\ta <|endoftext|>b", "naïve Été ſ İ " * 9, "word " * 9000, "x", "Hello, World!", "日本語 a1b2"]
    out = [(i * 3 % 7, t, f"s{i % 3}" if i % 4 else None, "x", "y") for i, t in enumerate(texts)]
    return out + [(None, "no id", "s0", "x", "y"), out[0], out[0]]


def expected(end):
    t = Tokenizer.from_file(word_tokenizer())
    return [(d, np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")) for d, x, *_ in rows()]


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    for limit in (4, 5, 8, 16):
        n = H.code_lengths(counts, limit)
        assert n[0] == 0 and n.max() <= limit and abs(sum(2.0 ** -int(x) for x in n[1:]) - 1) < 1e-12
    import heapq

    heap = [(int(c), 0) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        cost += a + b
        heapq.heappush(heap, (a + b, 0))
    assert int((counts * H.code_lengths(counts, 16)).sum()) == cost


def test_block_round_trip():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 5000) % 300).astype("<u4")
    n = H.code_lengths(np.bincount(ids), 12)
    blob = H.encode_block([5, None], np.array([1000, 4000]), ids, n, H.canonical_codes(n))
    keys, sizes, back = H.decode_block(blob, H.decode_table(n))
    assert keys == [5, None] and sizes.tolist() == [1000, 4000] and (back == ids).all()


def test_files_hold_every_id_in_order(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    H.write_token_files(docs, f"file://{tmp_path}/ids", word_tokenizer(), 2)
    got = sorted(H.read_token_files(spark, f"file://{tmp_path}/ids").collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in got) == sorted((d is not None, d or 0, i.tolist()) for d, i in expected(2))
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4"))
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("shares", [None, {"s0": 0.5, "s1": 0.4, "s2": 0.1}])
def test_packing_places_every_id_once(spark, shares):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = P.pack(docs, word_tokenizer(), 1, 64, shares=shares, with_ids=True).collect()
    want = sorted((d is not None, d or 0, i.tolist()) for d, i in expected(1))
    total = sum(len(x[2]) for x in want)
    assert sum(r["length"] for r in got) == total
    by = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4"))
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or s >= total // 64 and at & (at - 1) == 0
    docs_back = {}
    for r in got:
        docs_back.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    flat = sorted((d is not None, d or 0, n) for (d, n), v in docs_back.items() for _ in range(sum(r["length"] for r in v) // n))
    assert flat == [(a, b, len(c)) for a, b, c in want]


def test_windows_keep_the_mixture():
    totals = np.array([50_000, 30_000, 20_000])
    s = P.Schedule(totals, P.scaled(totals))
    sent = s.sent(np.arange(0, 100_001, 100))
    share = np.diff(sent, axis=0)[:-2]
    assert (abs(share - np.array([50, 30, 20])) <= 1).all() and (sent[-1] == totals).all()
    skewed = P.Schedule(totals, P.scaled(totals, np.array([0.1, 0.6, 0.3])))
    assert (np.diff(skewed.sent(np.arange(0, 40_001, 100)), axis=0) - np.array([10, 60, 30]) <= 1).all()
    for q in range(3):
        for p in (0, 7, 19_999):
            r = skewed.rank(q, p)
            a, b = skewed.sent(np.array([r, r + 1]))
            assert a[q] == p and b[q] == p + 1


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    H.write_token_files(docs, f"file://{tmp_path}/none", word_tokenizer(), 2)
    assert H.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    assert P.pack(docs, word_tokenizer()).count() == 0


def test_schedule_against_sorted_credit_dates():
    rng = np.random.default_rng(4)
    for totals, weights in [(rng.integers(1, 60, 40), None), (np.array([7, 7, 7, 14]), None), (rng.integers(1, 90, 12), rng.random(12)), (np.array([5]), None)]:
        w = P.scaled(totals, weights)
        s = P.Schedule(totals, w)
        tokens = sorted(((k + 1) / w[q], q, k) for q, n in enumerate(totals) for k in range(n))
        counts = np.zeros((len(tokens) + 1, len(totals)), np.int64)
        for i, (_, q, k) in enumerate(tokens):
            assert s.rank(q, k) == i
            counts[i + 1] = counts[i]
            counts[i + 1, q] += 1
        assert (s.sent(np.arange(len(tokens) + 1)) == counts).all()


def test_over_256_sources_keep_their_own_proportions(spark):
    docs = [(i, "many words stand here again " * 12, "hot" if i % 2 else f"s{i // 2 % 300}") for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = P.pack(df, word_tokenizer(), 1, 512, shares={"hot": 0.2, "s0": 0.2}).collect()
    source = {d: s for d, _, s in docs}
    first = {s: sum(r["length"] for r in got if r["sequence_id"] == 0 and source[r["doc_id"]] == s) for s in ("hot", "s0")}
    even = P.pack(df, word_tokenizer(), 1, 512).collect()
    done = dict.fromkeys(source.values(), 0)
    for w in range(sum(r["length"] for r in even) // 512):
        for r in even:
            if r["sequence_id"] == w:
                done[source[r["doc_id"]]] += r["length"]
        small = [n for s, n in done.items() if s != "hot"]  # all weigh a 300th of the hot one
        assert max(small) - min(small) <= 1 and 300 * min(small) - 1 <= done["hot"] <= 300 * (min(small) + 1)
    # each of the other sources weighs a 600th: it sends one token when those with a target have sent 120
    assert all(abs(n - 120) <= 2 for n in first.values()), first
    assert sum(r["length"] for r in got) == sum(r["length"] for r in even)
