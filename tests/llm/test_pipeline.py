import random

import corpus_pipeline as C


def test_every_stage_decides(spark, tmp_path):
    rng = random.Random(1)
    en, fr = [f"the{i}th" for i in range(900)], [f"été{i}ou" for i in range(900)]
    text = lambda pool, n: " ".join(rng.choice(pool) for _ in range(n))
    item = text(en, 30)
    docs = [(i, text(en if i % 2 else fr, 80), "en" if i % 2 else "fr", f"s{i % 3}", 5) for i in range(60)]
    copy = docs[7]
    docs += [(100, copy[1], "en", "s0", 5), (None, copy[1] + " more", "en", None, 5), copy, (102, "12 34 !!", "en", "s0", 5), (103, None, "fr", "s0", None), (104, "", None, "s1", 5)]
    docs += [(105, text(en, 40) + " " + item + " " + text(en, 40), "en", "s0", 5), (106, text(en, 30) + " token = 'abcdefgh12345678' " + text(en, 30), "en", "s0", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).selectExpr("*", "'mine' as _row").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, fn) in enumerate(C.STAGES[:-1]):
        out = fn(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(df.collect())
        assert {r["_row"] for r in kept[-1]} == {"mine"}
    ids = [sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) for rows in kept]
    plain = [(True, i) for i in range(60)]
    assert ids[0] == sorted([*plain, (False, 0), (True, 7), (True, 100), (True, 105), (True, 106)])
    group = {r["doc_id"] for r in kept[1]} & {7, 100, None}
    assert len(kept[1]) == 62 and len(group) == 1
    assert sorted(set(ids[1]) - set(ids[2])) == [(True, 105)] and len(kept[2]) == 61
    got = next(r for r in kept[3] if r["doc_id"] == 106)
    assert "abcdefgh" not in got["text"] and "[secret]" in got["text"] and got["n_chars"] == len(got["text"]) and len(kept[3]) == 61
    assert sum(r["text"] != next(d[1] for d in docs if d[0] == r["doc_id"]) for r in kept[3] if r["doc_id"] is not None and r["doc_id"] != 106) == 0
    pieces = C.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept[3]}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_rows_go_by_their_place_without_a_copy_of_the_texts(spark, tmp_path):
    rows = [(i % 50, f"text {i}", None if i % 3 else "x") for i in range(200_000)]
    spark.createDataFrame(rows, "_file long, text string, _metadata string").repartition(5).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    numbered, row = C._numbered(docs, "rows")
    assert "_metadata" in numbered.columns and numbered.select(row).distinct().count() == 200_000
    again = {r[0]: r[1] for r in C._numbered(docs, "rows")[0].select("text", row).collect()}
    assert again == {r["text"]: r[row] for r in numbered.select("text", row).collect()}
    gone = numbered.where("text like '%7'").select(row)
    left = C._without(numbered, row, gone)
    assert left.schema == docs.schema and left.count() == 180_000 and left.where("text like '%7'").count() == 0
    plan = left._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert C._without(numbered, row, gone.where("false")).count() == 200_000
    local = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    numbered, row = C._numbered(local, "rows")
    assert C._without(numbered, row, numbered.where("text = 'a'").select(row)).collect() == [(1, "b")]
