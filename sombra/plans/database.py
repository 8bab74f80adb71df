"""Whole copy-and-mask jobs.

Database: list tables -> allow-list -> classify all target columns in one
sampling job -> create missing targets -> truncate all targets -> per table one
masking ``select``, cut or quarantine what the target would reject, append ->
run log.
The policy frame is the only thing collected (one row per column).
"""

from __future__ import annotations

import time
import uuid
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import MaskKey
from ..operators import audit as A
from ..operators import classify as C
from ..operators.mask import MaskRules, direct_copy, mask_table, mask_text
from ..sources import files as FS
from ..sources import jdbc as J
from . import catalog as CAT

FULL = "mask"
COPY = "copy"            # K12: "Cópia Direta"


def plan_tables(frames: Mapping[str, DataFrame], mode: str = FULL, rules=None,
                key: MaskKey | None = None, target_columns: list[str] | None = None,
                ignored: list[str] | None = None,
                policies: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Masked frames for every table (lazy) plus the policy frame used.

    ``target_columns`` are qualified ``table.column`` names (default: all);
    ``ignored`` are removed from them (P2).
    """
    if mode == COPY:
        return {t: direct_copy(df) for t, df in frames.items()}, None
    if key is None:
        raise ValueError("masking needs a MaskKey")
    rules = MaskRules.coerce(rules)
    quals = target_columns or [f"{t}.{c}" for t, df in frames.items() for c in df.columns]
    quals = [q for q in quals if q not in set(ignored or [])]
    targets = {t: CAT.local_columns(quals, t) for t in frames}
    if policies is None:
        string_targets = {t: [c for c in C.string_columns(df) if c in targets[t]] for t, df in frames.items()}
        policies = C.classify_tables(dict(frames), string_targets)
    rows = policies.collect()          # one row per column
    out = {}
    for t, df in frames.items():
        pol = {r["column"]: r["tag"] for r in rows if r["table"] == t}
        out[t] = mask_table(df, pol, rules, key, targets=targets[t])
    return out, policies


def copy_database(spark: SparkSession, src_url: str, dst_url: str, schema: str,
                  key: MaskKey | None, mode: str = FULL, rules=None, allow: str | None = None,
                  target_columns: list[str] | None = None, ignored: list[str] | None = None,
                  props: dict | None = None, dst_props: dict | None = None,
                  partition_columns: Mapping[str, str] | None = None,
                  max_lengths: Mapping[str, Mapping[str, int]] | None = None,
                  truncate_first: bool = True, run_log: str | None = None,
                  quarantine_path: str | None = None) -> DataFrame:
    """The database pipeline as Spark jobs; returns the run-log frame.

    Targets are created if missing, then all are truncated, then all are
    loaded, so a cascading truncate never empties a table already loaded.
    Strings longer than ``max_lengths`` are cut to fit (K3); with
    ``quarantine_path`` the rows go there instead (K4).  No row is dropped:
    rows_total counts the source, rows_done the target plus the quarantine."""
    run_id = uuid.uuid4().hex[:12]
    allowed = CAT.allow_list(allow)
    tables = [t for t in J.list_tables(spark, src_url, schema, props) if not allowed or t in allowed]
    frames = {t: J.read_table(spark, src_url, f"{schema}.{t}", props,
                              partition_column=(partition_columns or {}).get(t)) for t in tables}
    masked, _ = plan_tables(frames, mode, rules, key, target_columns, ignored)
    there = set(J.list_tables(spark, dst_url, schema, dst_props))
    for t in tables:
        if t not in there:
            J.clone_structure(frames[t], dst_url, f"{schema}.{t}", dst_props)
    if truncate_first:
        for t in tables:
            J.truncate(frames[t], dst_url, f"{schema}.{t}", dst_props)
    t0 = time.time()
    log = []
    for i, t in enumerate(tables, start=1):
        out, n_rejected = masked[t], 0
        lengths = (max_lengths or {}).get(t)
        if lengths and quarantine_path:
            out, rejected = FS.split_rejects(out, max_lengths=lengths)
            path = f"{quarantine_path}/{run_id}/{t}"
            rejected.write.parquet(path)
            n_rejected = spark.read.parquet(path).count()
        elif lengths:
            out = FS.fit_lengths(out, lengths)
        start = time.time()
        J.load(out, dst_url, f"{schema}.{t}", dst_props)
        dt = max(time.time() - start, 1e-3)
        done = int(J.query(spark, dst_url, f"SELECT COUNT(*) AS n FROM {schema}.{t}", dst_props).first()[0]) + n_rejected
        total = int(J.query(spark, src_url, f"SELECT COUNT(*) AS n FROM {schema}.{t}", props).first()[0])
        log.append({"run_id": run_id, "batch_id": i, "phase": "done" if done >= total else "rows missing", "table_name": t,
                    "tables_done": i, "tables_total": len(tables), "rows_done": done,
                    "rows_total": total, "rows_per_s": done / dt, "elapsed_s": time.time() - t0,
                    "finished": i == len(tables)})
    if run_log and log:
        A.append_run_log(spark, run_log, log)
    return spark.createDataFrame(log, A.RUN_LOG_SCHEMA) if log else spark.createDataFrame([], A.RUN_LOG_SCHEMA)


def mask_csv_files(spark: SparkSession, path: str, out_path: str, key: MaskKey, rules=None,
                   ignored: list[str] | None = None, quarantine_path: str | None = None) -> DataFrame:
    """SURVEY 3.2, CSV: read a file or a folder of files with any headers and
    separators all-string, classify, mask, write each file with its own columns
    and header under its ``SEGURO_`` name (K7, K10).  A column of one name has
    one policy, decided over all files.  Returns all masked rows."""
    groups, aside = FS.read_csv_groups(spark, path)
    both = FS.stack(groups)
    targets = [c for c in both.columns if c not in {*(ignored or []), FS.SOURCE_FILE}]
    pol = C.policy_map(C.classify_columns(both, targets, table="csv"))
    masked = [mask_table(g, pol, rules, key, targets=[c for c in targets if c in g.columns]) for g in groups]
    for i, m in enumerate(masked):
        named = m.withColumn("name", FS.output_name(F.col(FS.SOURCE_FILE), "csv")).drop(FS.SOURCE_FILE)
        FS.write_csv(named, out_path, mode="append" if i else "overwrite", by="name")
    long_rows = FS.stack(aside)
    if quarantine_path:
        long_rows.write.mode("append").parquet(quarantine_path)
    elif long_rows.limit(1).count():
        raise ValueError("rows with more fields than their header: pass quarantine_path to set them aside")
    return FS.stack(masked).drop(FS.SOURCE_FILE)


def mask_text_files(spark: SparkSession, path: str, out_path: str, key: MaskKey, rules=None,
                    quarantine_path: str | None = None) -> DataFrame:
    """SURVEY 3.2, text: every file of a folder masked and written under its
    ``SEGURO_`` name (K8, K10); files that are not UTF-8 are set aside.  One
    job for all files; returns (name, text)."""
    good, bad = FS.read_text_files(spark, path)
    out = good.select(FS.output_name(F.col("path"), "txt").alias("name"),
                      mask_text(F.col("text"), rules, key).alias("text"))
    FS.write_texts(out, out_path)
    if quarantine_path:
        bad.write.mode("append").parquet(quarantine_path)
    elif bad.limit(1).count():
        raise ValueError("files that are not UTF-8: pass quarantine_path to set them aside")
    return out
