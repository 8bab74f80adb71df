"""Audit and run log (A1-A6, W1-W3, leak scan) as ordinary aggregates.

Identities are counted over keyed digests, never raw values (SURVEY Q18).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import MaskKey
from ..functions.surrogates import digest, family
from ..session import ensure_checkpoint_dir
from .mask import MaskRules, find_pii, mask_text_struct

PERSON_TYPES = ["PER", "NOME_SOLTO"]
DOCUMENT_TYPES = ["CPF", "RG", "PLATE", "PLACA"]


def _masked(df: DataFrame, text_col: str, rules, key: MaskKey,
            approved_terms: Column | None = None) -> DataFrame:
    t = F.col(text_col)
    return df.select(t.alias("_text"), mask_text_struct(t, rules, key, approved_terms).alias("_m"))


def audit_summary(df: DataFrame, text_col: str, rules, key: MaskKey,
                  approved_terms: Column | None = None) -> DataFrame:
    """A3 + A4: cells evaluated/changed, substitutions (spans and propagated
    mentions apart, SURVEY Q20), distinct persons and documents protected."""
    m = _masked(df, text_col, rules, key, approved_terms)
    nonblank = F.col("_text").isNotNull() & (F.regexp_replace("_text", r"(?U)^\s+|\s+$", "") != "")
    spans = F.col("_m.spans")

    counters = {"cells_evaluated": nonblank.cast("long"),
                "cells_changed": (nonblank & (F.col("_m.masked") != F.col("_text"))).cast("long"),
                "span_substitutions": F.size(spans).cast("long"), "propagated_substitutions": F.col("_m.extra").cast("long"),
                "persons_protected": F.lit(0).cast("long"), "documents_protected": F.lit(0).cast("long")}

    def row(metric, value, ident):
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"), ident.alias("id"))
    nobody = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    found = F.concat(
        F.array(*[row(name, F.coalesce(v, zero), nobody) for name, v in counters.items()]),
        F.transform(F.filter(spans, lambda s: s["type"].isin(PERSON_TYPES)),
                    lambda s: row("persons_protected", zero, digest(s["value"], "PER", key))),
        F.transform(F.filter(spans, lambda s: s["type"].isin(DOCUMENT_TYPES)),
                    lambda s: row("documents_protected", zero, F.concat(s["type"], F.lit(":"), digest(s["value"], "DOC", key)))))
    # one pass: counters are summed and identities counted in one aggregate
    per = m.select(F.inline(found)).groupBy("metric").agg(
        (F.sum("value") + F.countDistinct("id")).alias("value"))
    names = df.sparkSession.createDataFrame([(n,) for n in counters], "metric string")
    return names.join(per, "metric", "left").select("metric", F.coalesce("value", zero).alias("value"))


def audit_by_type(df: DataFrame, text_col: str, rules, key: MaskKey | None = None) -> DataFrame:
    """A3/A5 per type: spans, cells with at least one, distinct values.
    Only detection is needed (no surrogates), so nothing is masked here."""
    t = F.col(text_col)
    cells = df.select(F.monotonically_increasing_id().alias("_cell"), find_pii(t, rules).alias("_found"))
    ex = cells.select("_cell", F.explode("_found").alias("s"))
    return (ex.groupBy(F.col("s.type").alias("type"))
              .agg(F.count(F.lit(1)).alias("n_spans"),
                   F.countDistinct("_cell").alias("n_cells"),
                   F.countDistinct(F.col("s.value")).alias("n_distinct")))


def row_numbers(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_pos``, the place (from 0) of each row in its partition by
    ``order``, without bringing a partition together: rows are range-sorted,
    and the counts per (range, partition) are summed.  Ties are told apart by
    the order in which the range sort leaves them."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sombra-order/{uuid.uuid4().hex}"
    (df.repartitionByRange(n, *partition, *order).sortWithinPartitions(*partition, *order)
     .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    # one row per (range, partition): a partition has at most as many as there are ranges
    parts = rows.groupBy(*partition, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)], F.col("_range").alias("_r"),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    return (rows.join(parts, same).withColumn("_pos", F.col("_at") + F.col("_shift"))
            .select(*df.columns, "_pos"))


def moving_window(log: DataFrame, partition: str | None, order: list[str], value: str,
                  window: int = 30, block: int = 65_536) -> DataFrame:
    """Sum, count and mean of ``value`` over the last ``window`` rows, as
    ``sum_<window>``, ``n_<window>`` and ``mean_<window>``.

    A partition (a run, a user; None: the whole log) is cut into blocks of
    ``block`` rows by place, and the last ``window - 1`` rows of each block are
    sent to the next one too, so one partition spans many tasks.  A null value
    counts as a row but adds nothing (as a plain window would have it)."""
    keys = ["_all"] if partition is None else [partition]
    rows = log.withColumn("_all", F.lit(0)) if partition is None else log
    halo = window - 1
    block = max(block, window)          # so that a halo comes from one block
    placed = row_numbers(rows, keys, order).withColumn("_blk", F.floor(F.col("_pos") / block))
    late = F.col("_pos") % block >= block - halo
    both = placed.withColumn("_to", F.explode(F.when(late, F.array("_blk", F.col("_blk") + 1)).otherwise(F.array("_blk"))))
    w = Window.partitionBy(*keys, "_to").orderBy("_pos").rowsBetween(-halo, 0)
    out = (both.withColumn(f"sum_{window}", F.sum(value).over(w)).withColumn(f"n_{window}", F.count(F.lit(1)).over(w))
           .withColumn(f"mean_{window}", F.avg(F.col(value).cast("double")).over(w)).where("_to = _blk"))
    return out.drop("_pos", "_blk", "_to", "_all")


def moving_speed(log: DataFrame, partition: str | None, order: list[str], speed: str,
                 window: int = 30, block: int = 65_536) -> DataFrame:
    """Mean of the last ``window`` speeds."""
    out = moving_window(log, partition, order, speed, window, block)
    return out.withColumnRenamed(f"mean_{window}", f"speed_{window}").drop(f"sum_{window}", f"n_{window}")


def eta(remaining: Column, speed: Column) -> Column:
    """``h:m:s`` left at ``speed`` rows/s (null when speed is 0)."""
    secs = F.floor(remaining / speed).cast("bigint")
    text = F.format_string("%dh %02dm %02ds", F.floor(secs / 3600).cast("int"),
                           F.floor((secs % 3600) / 60).cast("int"), (secs % 60).cast("int"))
    return F.when(speed > 0, text)


def progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), F.when(total > 0, done / total).otherwise(F.lit(0.0)))


RUN_LOG_SCHEMA = ("run_id string, batch_id bigint, phase string, table_name string, "
                  "tables_done int, tables_total int, rows_done bigint, rows_total bigint, "
                  "rows_per_s double, elapsed_s double, finished boolean")


def append_run_log(spark: SparkSession, path: str, records: list[dict]) -> None:
    """Append one row per table/batch to a run-log table (parquet)."""
    spark.createDataFrame(records, RUN_LOG_SCHEMA).write.mode("append").parquet(path)
