"""Session construction and lineage cutting helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "panelkit",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and UTC time. On a cluster the
    master comes from spark-submit; locally pass e.g. ``local[8]``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when the session has none (local tests) a private scratch folder is
    created; on a cluster the setting must name shared storage, or this raises
    ("local-cluster" counts as a cluster)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="panelkit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    read it back: the lineage is cut (an iterative job survives executor loss
    without replaying it) and the optimizer sees the real file size - a
    checkpointed plan would keep its origin's size estimate, which compounds
    across iterations of self-joins."""
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)  # known: no job reads it from the files
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` has stored and that no later step
    reads: an iteration's own tables, once the next ones are stored."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def run_concurrently(tasks, workers: int = 8) -> list:
    """Run independent Spark actions (e.g. model fits) as concurrent jobs from
    driver threads; results in task order.  Each fit is a chain of small jobs,
    so running them side by side keeps executors busy instead of waiting on
    job latency."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, workers)) as ex:
        return list(ex.map(lambda t: t(), tasks))
