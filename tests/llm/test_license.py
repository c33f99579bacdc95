import random
import re

from graphloom.llm import license_scan as L


def brute(text, templates, threshold):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(pat, low)
    places, base = [], set()
    for p, label in L.PHRASES.items():
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    met = []
    for label, t in L.template_words(templates):
        own, size = {x.decode() for x in t}, len(t) + max(2, len(t) // 4)
        for a in range(len(words)):
            n = len(own & set(words[a : a + size]))
            if n / len(own) >= threshold - 1e-9:
                met.append((label, own, a, a + size, n / len(own)))
    for label, own, a, z, share in met:
        if not any(own < o and a < y and x < z for _, o, x, y, _ in met):
            labels.add(label)
            score = max(score, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [w for ts in L.TEMPLATES.values() for t in ts for w in t.split()] + ["the", "été", "x1", "ÀB", "re"]
    texts = [None, "", "MIT License, GNU\nGeneral  public-license. gnu general public licenses", "cc-by cc by", "Apache licenseapache license é apache license"]
    texts += ["Released under the MIT License." + " pad" * 200 + " licensed under, the! cc by-nc 4.0 " + "pad " * 100]
    for ts in L.TEMPLATES.values():
        for t in ts:
            w = t.split()
            texts.append(" ".join(w))
            texts.append(" ".join(x for x in w if rng.random() > 0.08).upper())
    texts += [rng.choice([" ", "\n", ", "]).join(rng.choice(pool) for _ in range(rng.choice([3, 12, 70, 300]))) for _ in range(150)]
    wrapped = L.TEMPLATES["mit"][1].split()  # over lines of a comment
    texts += ["\n".join(" * " + " ".join(wrapped[k : k + 7]) for k in range(0, len(wrapped), 7)), "licensed under cc by 4.0 " + "pad " * 30 + "licensed under cc by-nc 4.0"]
    texts += texts[:3]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, "mit license", "", "")], "doc_id long, text string, labels string, score string")
    for threshold in (0.9, 0.6):
        got = {r["doc_id"]: tuple(r)[1:] for r in L.scan_licenses(df, threshold=threshold).collect()}
        for i, t in enumerate(texts):
            assert got[i] == brute(t, L.TEMPLATES, threshold), (threshold, i, t)
        assert got[None][1] == 1
        assert "mit" in got[len(texts) - 5][5]
        assert threshold < 0.9 or {"cc-by-4.0", "cc-by-nc"} <= set(got[len(texts) - 4][5].split(","))


def test_long_templates_and_texts(spark):
    words = [f"word{i}" for i in range(150)]
    text = "pad " * 50_000 + "\n".join(words[:70] + ["other"] * 5 + words[75:]) + " pad" * 50_000
    got = L.scan_licenses(spark.createDataFrame([(1, text), (2, " ".join(words[:120]))], "doc_id long, text string"), {"long": [" ".join(words)]}, {}).collect()
    assert {r["doc_id"]: (r["labels"], round(r["score"], 3)) for r in got} == {1: ("long", 0.967), 2: ("", 0.0)}


def test_empty(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
