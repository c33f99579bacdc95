import zlib

import numpy as np

from graphloom.llm import convnet, language_id


def test_gradients_match_differences():
    net = convnet.ConvNet(3, (2, 3), 4, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, (5, 12)), np.array([0, 1, 2, 1, 0])
    _, g = net._step(x, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-6
            up = net._step(x, y)[0]
            flat[i] = old - 1e-6
            down = net._step(x, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[k].reshape(-1)[i]) < 1e-4


def test_tables_give_the_filters_values():
    net = convnet.ConvNet(2)
    x = np.random.default_rng(2).integers(0, 256, (7, 40)).astype(np.uint8)
    emb = net.p["E"][x]
    h = []
    for w in net.widths:
        z = np.stack([emb[:, i : i + w].reshape(7, -1) @ net.p[f"W{w}"] for i in range(40 - w + 1)], 1)
        h.append(z.max(1) + net.p[f"b{w}"])
    want = np.maximum(np.concatenate(h, 1), 0) @ net.p["V"] + net.p["c"]
    assert np.allclose(net.logits(x, 3), want, atol=1e-4)


def test_windows_cover_the_text():
    data = np.arange(600, dtype=np.uint32).astype(np.uint8)
    x, text, size = language_id.windows(data, np.array([0, 0, 300, 300, 600]))
    assert text.tolist() == [1, 1, 3, 3] and size.tolist() == [256, 44, 256, 44]
    assert (x[1, :44] == data[256:300]).all() and not x[1, 44:].any()


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    rows = [(i, f"the cat {i} sat on it", "en", "x") for i in range(30)] + [(i, f"le chat {i} était là", "fr", "x") for i in range(30, 60)]
    rows += [(None, "the cat", "en", "x"), (70, None, "en", "x"), (71, "", "fr", "x"), (72, "12 345 !!", "fr", "x"), (73, "the cat sat", None, "x"), (74, "été " * 5000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert len(got) == 66 and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (70, 71, 72))
    assert all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(df.where("lang is null")).select("lang_pred").distinct().collect() == [("und",)]
    assert language_id.identify(df.where("false")).count() == 0


def test_every_window_of_every_labelled_document_is_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 5)
    rows = [(i, f"the cat {i} sat on it and " * (i % 40), "en") for i in range(200)] + [(i, f"le chat {i} était là sur " * (i % 30), "fr") for i in range(200, 300)]
    rows += [(300, None, "en"), (301, "the dog", None), (None, "le chien", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    seen, mean = [], convnet.ConvNet.averaged
    monkeypatch.setattr(convnet.ConvNet, "averaged", lambda net, rows: seen.extend(r["n"] for r in rows) or mean(net, rows))
    used = [t for i, t, lang in rows if i is not None and t and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    classes, net = language_id.train(df, language_id.fold(language_id.F.col("doc_id"), 4) != 2)
    assert classes == ["en", "fr"] and sum(seen) == sum(-(-len(t.encode()) // language_id.WINDOW) for t in used)
    got = language_id.predict(df, (classes, net), ["doc_id", "lang"]).where("lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
