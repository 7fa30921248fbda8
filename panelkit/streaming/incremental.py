"""File-triggered incremental processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def run_incremental(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame],
                    sink: str, *, fmt: str = "parquet", name: str = "panelkit-incremental",
                    checkpoint: str | None = None, partition_by: tuple[str, ...] = (), wait: bool = True):
    """Apply ``transform`` to every new file under ``source`` and add the
    result to the parquet table ``sink``.  Runs with Trigger.AvailableNow
    (process what is there, then stop) so it suits scheduled runs; progress
    is kept in ``checkpoint`` (default: under the session's checkpoint folder).
    Each micro-batch is a partition ``batch=<name>-<number>`` of the sink, so a
    batch that is run again after a failure replaces its own rows.  A stream
    that starts over with a new checkpoint needs a new name or an empty sink."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    stream = spark.readStream.schema(schema).format(fmt).load(source)

    def batch(df: DataFrame, epoch_id: int) -> None:
        w = transform(df).write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{sink.rstrip('/')}/batch={name}-{epoch_id}")

    q = (stream.writeStream.queryName(name).foreachBatch(batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    if wait:
        q.awaitTermination()
    return q
