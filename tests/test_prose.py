"""The prose corpus is worked on by all cores, and the lines of a file are built and read once."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from inkproof.plans.catalog.learning import csv_lines
from inkproof.sources import datasets
from inkproof.sources.tables import dealt, prose_documents, table


def corpus(tmp_path):
    rows = {"doc_id": list(range(200)), "text": [f"Text {i}, \"quoted\"." for i in range(199)] + [None]}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    folder = corpus(tmp_path)
    sizes = [s for s in prose_documents(spark, folder).rdd.glom().map(len).collect() if s]
    assert sum(sizes) == 200 and len(sizes) >= 4 and max(sizes) < 50
    spark.read.parquet(f"{folder}/documents.parquet").repartition(6).write.parquet(f"{folder}/many.parquet")
    many = table(spark, folder, "many")
    assert dealt(many, "doc_id") is many


def test_features_in_lines_are_computed_once(spark, tmp_path):
    lines = csv_lines(spark, corpus(tmp_path), False)
    rows = datasets.labelled_dataset(datasets.parse_lines(lines, ["doc_id", "Content", "target"]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_csv") + plan.count("csvtostructs") == 1 and plan.count("concat_ws") == 1
    got = rows.orderBy(rows.doc_id.cast("int")).collect()
    assert len(got) == 199 and got[0].text == 'Text 0, "quoted".' and got[0].label == 0
