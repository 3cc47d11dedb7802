"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Every one of these can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The rule stages are CPU-bound on small rows: let AQE keep one task per core
    # instead of merging a few megabytes of shuffle output into a single task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkproof")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # recording the call site of every column expression takes seconds on big projections
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that is unset, as in tests on one machine, below a temporary folder of this process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: computed once, and not again if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_session(build):
    """Keeps what a function of hashable arguments returns, for the running application only: columns belong to one."""
    kept: dict = {}
    application = None

    @wraps(build)
    def found(*args, **named):
        nonlocal application
        now = SparkContext.getOrCreate().applicationId
        if now != application:
            kept.clear()
            application = now
        key = args, tuple(sorted(named.items()))
        if key not in kept:
            kept[key] = build(*args, **named)
        return kept[key]

    return found
