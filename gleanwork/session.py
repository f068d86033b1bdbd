"""Session settings and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_metrics: weakref.WeakKeyDictionary[DataFrame, dict] = weakref.WeakKeyDictionary()


def build_session(app: str = "gleanwork", **conf: str) -> SparkSession:
    """A session with the settings the operators count on; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # per-group limits (page caps) are cut before the shuffle up to this size
        "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without it; there a temporary folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="gleanwork-")
    return _local_dirs[sc.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{label}"


def stage(df: DataFrame, label: str, **metrics: Column) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives executor loss.

    A written table also gives the optimizer true sizes, so later joins broadcast
    it only when it really is small. Its row count and the ``metrics`` are taken
    while it is written; ``staged_metrics`` gives them.
    """
    path = fresh_path(df.sparkSession, label)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in metrics.items()])
    counted.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _metrics[staged] = seen.get
    return staged


def staged_metrics(df: DataFrame) -> dict | None:
    """Row count and metrics of a staged table, None for any other DataFrame.

    A retried task may count twice, so take a number as an upper bound; zero is exact.
    """
    return _metrics.get(df)


def task_count(spark: SparkSession) -> int:
    """Number of tasks for work whose cost does not show in the size of its rows.

    Adaptive execution would pack a few thousand paths into one task, although each
    of them stands for a file to open.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
