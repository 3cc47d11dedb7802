"""A run on more rows than one task grows trees on learns from all of them."""

import random

from pyspark.sql import functions as F

from inkproof.operators import training
from inkproof.operators.learning import roc_auc


def test_all_rows_take_part_in_parts_and_turns(spark):
    r = random.Random(5)
    made = []
    for i in range(700):
        y = int(r.random() < 0.4)
        cells = {c: float(r.randrange(1, 5)) for c in r.sample(range(40), 5)}
        if y and r.random() < 0.9:
            cells[3] = 3.0
        made.append((i, y, sorted(cells), [cells[c] for c in sorted(cells)]))
    df = spark.createDataFrame(made, "doc_id long, label int, columns array<int>, values array<double>")
    run = training.train(df, 40, trees=20, rounds=21, limit=200)
    s = run.summary
    assert (s["training_samples"], s["genuine"] + s["fake"]) == (700, 700)
    trees = {m: sorted(x.tree for x in run.models.trees.where(F.col("model") == m).collect()) for m in ("random_forest", "xgboost")}
    assert trees == {"random_forest": list(range(20)), "xgboost": list(range(22))}
    out = training.scored(run.models, df).withColumnRenamed("fake_probability", "score")
    assert min(x.roc_auc for x in roc_auc(out).collect()) > 0.8
    again = training.train(df.repartition(3), 40, trees=20, rounds=21, limit=200)
    held = lambda x: {(t.model, t.tree, tuple(t.feature), tuple(t.value)) for t in x.models.trees.collect()}
    assert held(again) == held(run)
