"""Catalogue and referential checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def allow_list(spec: str | list[str] | None) -> list[str]:
    """Comma list, trimmed; empty = all."""
    if spec is None:
        return []
    items = spec.split(",") if isinstance(spec, str) else spec
    return [t.strip() for t in items if t and t.strip()]


def column_catalogue(spark: SparkSession, frames: dict[str, DataFrame],
                     allow: str | list[str] | None = None,
                     ignored: list[str] | None = None) -> DataFrame:
    """S13 + P1 + P2: sorted distinct ``table.column`` of allowed tables minus
    ignored ones.  Built from schemas (metadata), no data is scanned."""
    allowed = allow_list(allow)
    rows = [(t, f.name, f.dataType.simpleString())
            for t, df in frames.items() if not allowed or t in allowed
            for f in df.schema.fields]
    cat = spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
    cat = cat.withColumn("qualified", F.concat_ws(".", "table_name", "column_name"))
    if ignored:
        cat = cat.filter(~F.col("qualified").isin(list(ignored)))
    return cat.select("table_name", "column_name", "qualified").distinct() \
              .orderBy("table_name", "column_name")


def local_columns(qualified: list[str], table: str) -> list[str]:
    """Targets of one table, ``"<table>."`` prefix stripped."""
    prefix = table + "."
    return [q[len(prefix):] for q in qualified if q.startswith(prefix)]


def fk_edges(spark: SparkSession, edges: list[tuple], selected: list[str]) -> DataFrame:
    """FK edges whose both ends are selected tables, self-edges removed.
    A key of several columns is given as two lists of columns, paired."""
    listed = [(c, p, [cc] if isinstance(cc, str) else list(cc), [pc] if isinstance(pc, str) else list(pc)) for c, p, cc, pc in edges]
    e = spark.createDataFrame(listed, "child string, parent string, child_cols array<string>, parent_cols array<string>")
    sel = spark.createDataFrame([(t,) for t in selected], "t string")
    return (e.join(sel.withColumnRenamed("t", "child"), "child")
             .join(sel.withColumnRenamed("t", "parent"), "parent")
             .filter(F.col("child") != F.col("parent"))
             .select("child", "parent", "child_cols", "parent_cols"))


def key_text(cols: list[str]) -> Column:
    """A key of one or several columns as one text, null if any part is null."""
    parts = [F.col(f"`{c}`").cast("string") for c in cols]
    if len(parts) == 1:
        return parts[0]
    return F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def orphan_counts(frames: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """Per FK edge, child rows whose (masked) key has no parent row; a key
    with a null part refers to nothing.

    Every table is read once: its keys, as child and as parent of all edges,
    are unpivoted with the edge's number.  One aggregate per (edge, key), with
    map-side partial sums, tells keys that only children hold, so a key that
    holds a third of the rows is shuffled as one row per task and no join is
    needed.  The edge list is metadata (tiny), so it is collected to build the
    plan."""
    rows = edges.orderBy("child", "parent", "child_cols").collect()
    spark = edges.sparkSession
    keys = []
    for t in sorted({r["child"] for r in rows} | {r["parent"] for r in rows}):
        cells = [F.struct(F.lit(i).alias("edge"), F.lit(side == "child").alias("is_child"), key_text(r[f"{side}_cols"]).alias("k"))
                 for i, r in enumerate(rows) for side in ("child", "parent") if r[side] == t]
        keys.append(frames[t].select(F.inline(F.array(*cells))).where("k is not null"))
    labels = spark.createDataFrame([(i, r["child"], r["parent"], ", ".join(r["child_cols"])) for i, r in enumerate(rows)],
                                   "edge int, child string, parent string, child_col string")
    if not keys:
        return labels.select("child", "parent", "child_col", F.lit(0).cast("long").alias("orphans"))
    both = (reduce(DataFrame.union, keys).groupBy("edge", "k")
            .agg(F.sum(F.col("is_child").cast("long")).alias("n"), F.bool_and("is_child").alias("alone")))
    per = both.where("alone").groupBy("edge").agg(F.sum("n").alias("orphans"))
    return (labels.join(per, "edge", "left")
            .select("child", "parent", "child_col", F.coalesce("orphans", F.lit(0).cast("long")).alias("orphans")))
