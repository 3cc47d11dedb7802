"""Headline timings: one JSON line for the data in $BENCH_SF_DIR."""

from __future__ import annotations

import json
import os
import sys
import time

from inkproof.plans import registry
from inkproof.session import local_session

HEADLINE = [
    "f_word_count", "f_repeated_phrase_count", "m_repeated_sentences_prose",
    "m_detect_all_prose", "t_doctype_counts", "r_decision",
    # the first query on the stored warehouse scores the corpus and writes it, the next two read it
    "w_dashboard_totals", "w_risk_bands", "w_decision_distribution",
    "c_token_jaccard", "ml_tfidf_vectorize", "ml_roc_auc",
    "ml_stratified_split", "l_font_variance", "st_scan_volume_window", "c_corpus_pair_join",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    entries = registry.load()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
