"""Streaming (ST1, ST2): mask an append-only stream with frozen policies.

Masks are pure functions of (key, value), so the streaming query is a
stateless ``select`` — the same expression as the batch job — and every
micro-batch can be recomputed after a failure from the checkpoint.  Without
audit the file sink commits each batch once; with audit every batch has an
output folder of its own (``batch_id=N``), which a repeated batch replaces.
"""

from __future__ import annotations

import time
from typing import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import MaskKey
from ..operators.mask import MaskRules, mask_table

AUDIT_SCHEMA = "batch_id bigint, rows bigint, seconds double, rows_per_s double, written_at double"


def mask_stream(stream: DataFrame, policies: Mapping[str, str], rules=None,
                key: MaskKey = None, targets: list[str] | None = None) -> DataFrame:
    """ST1: the batch ``mask_table`` projection applied to a streaming frame."""
    return mask_table(stream, policies, rules, key, targets=targets)


def start_masking(spark: SparkSession, stream: DataFrame, policies: Mapping[str, str],
                  key: MaskKey, out_path: str, checkpoint: str, audit_path: str | None = None,
                  rules=None, fmt: str = "parquet", available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """ST1 + ST2: write the masked stream (append) with a checkpoint; with
    ``audit_path`` each micro-batch also appends one audit row."""
    masked = mask_stream(stream, policies, MaskRules.coerce(rules), key)

    if audit_path is None:
        # the file sink commits each batch once
        w = masked.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
        return _start(w, available_now, processing_time)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # a folder per batch, overwritten: a batch run again replaces itself
        t0 = time.time()
        seen = Observation("rows")
        (batch.observe(seen, F.count(F.lit(1)).alias("n"))
              .write.mode("overwrite").format(fmt).save(f"{out_path}/batch_id={batch_id}"))
        n = seen.get["n"]
        dt = max(time.time() - t0, 1e-3)
        batch.sparkSession.createDataFrame(
            [(batch_id, n, dt, n / dt, time.time())], AUDIT_SCHEMA
        ).coalesce(1).write.mode("overwrite").parquet(f"{audit_path}/run={batch_id}")

    w = masked.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    return _start(w, available_now, processing_time)


def _start(w, available_now: bool, processing_time: str | None) -> StreamingQuery:
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
