"""The stored warehouses that the queries read: written once for each session and data folder, then only read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkproof.operators.store import AnalysisStore
from inkproof.session import shared_folder

#: Folders of this session's warehouses; the commits inside say what they hold.
_folders: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, kind: str, documents: Callable[[], DataFrame], analyses: Callable[[], DataFrame]) -> AnalysisStore:
    """The warehouse of a kind for a data folder; documents and analyses are computed if its batches are not committed yet."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _folders:
        _folders[key] = f"{shared_folder(spark)}-{kind}"
    store = AnalysisStore(spark, _folders[key])
    done = {r.batch_id for r in store.commits()}
    if "documents" not in done:
        store.register("documents", documents())
    if "analyses" not in done:
        store.write("analyses", analyses())
    return store
