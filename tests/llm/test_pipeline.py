"""The pipeline on planted rows, stage by stage."""

from __future__ import annotations

import random

import corpus_pipeline


def text(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def test_stages(spark, tmp_path):
    rows, labels = [], []
    for i in range(240):
        t = text(80, i)
        if i % 6 == 0:
            t += " vilest scumbag"
        elif i % 6 == 1:
            t = " ".join(w + "###" for w in t.split())
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        if i % 2 or i % 4 == 0:
            labels.append((i, int(i % 6 != 1), int(i % 6 == 0)))
    item = text(30, 999)
    rows += [(500, rows[2][1], "en", "s0", 1), (501, rows[3][1] + " end", "en", "s0", 1), (502, item + " " + text(60, 7), "en", "s1", 1), (503, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids and all(i % 6 > 1 and i < 500 for i in ids)
    clean = {i for i in range(240) if i % 6 > 1}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert clean <= left, name
    assert left == clean
