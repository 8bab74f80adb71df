"""File sources and sinks.

CSV is read all-string so leading zeros survive; text files are read as
bytes and decoded strictly, with undecodable files set aside (SURVEY Q21).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import csv_records as CR

# Candidate CSV separators, in preference order for ties.
SEPARATORS = [",", ";", "\t", "|"]
OUTPUT_PREFIX = "SEGURO_"
PAGE_SEPARATOR = "\n\n"


def csv_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header, sep) of every CSV file under ``path``: the first line
    of each file and the separator it uses most (ties in ``SEPARATORS`` order).
    One scan job over all files; the text is pruned to first blocks."""
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("at"))
             .filter("at = 0").withColumn("no", F.monotonically_increasing_id()))
    first = lines.groupBy("file").agg(F.min_by("value", "no").alias("header"))
    first = first.withColumn("header", F.regexp_replace("header", "^\\uFEFF", ""))
    uses = F.array(*[F.struct((F.length("header") - F.length(F.replace("header", F.lit(x)))).alias("n"),
                              F.lit(-i).alias("order"), F.lit(x).alias("sep")) for i, x in enumerate(SEPARATORS)])
    return first.select("file", "header", F.array_max(uses)["sep"].alias("sep"))


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of the first file's header."""
    row = csv_headers(spark, path).orderBy("file").select("sep").first()
    return row["sep"] if row else SEPARATORS[0]


CORRUPT = "_corrupt_record"


def header_names(header: str, sep: str, spark: SparkSession) -> list[str]:
    """Column names of a header line: an empty name becomes ``_c<place>``, a
    repeated one gets a number (``id``, ``id_1``), so no column is lost."""
    n = header.count(sep) + 1
    row = spark.createDataFrame([(header,)], "h string").select(
        F.from_csv("h", ", ".join(f"c{i} string" for i in range(n)), {"sep": sep, "multiLine": "true"}).alias("r")).select("r.*").first()
    fields = list(row)
    while len(fields) > 1 and fields[-1] is None and not header.rstrip().endswith(sep):
        fields.pop()             # separators inside quoted names
    names: list[str] = []
    for i, f in enumerate(fields):
        base = f.strip() if f and f.strip() else f"_c{i}"
        name, k = base, 0
        while name.lower() in {x.lower() for x in names}:
            k += 1
            name = f"{base}_{k}"
        names.append(name)
    return names


SOURCE_FILE = "_source_file"


def read_csv_groups(spark: SparkSession, path: str | list[str],
                    sep: str | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """The rows of each (header, separator) group of files, all-string, with
    each row's file as ``SOURCE_FILE``, and what is set aside.  A short row
    keeps its values (the rest is null); a row with more fields than its header,
    and the lines of a last record whose quoted cell never ends, go to the
    quarantine frames (header, line) instead of being dropped.

    Files in which no line leaves a quoted cell open are split by Spark's CSV
    reader; the others are split too, by :mod:`csv_records`."""
    heads = csv_headers(spark, path)
    if sep:
        heads = heads.withColumn("sep", F.lit(sep))
    lines = CR.lines_of(spark, path)
    multi = CR.files_with_open_lines(lines, heads.select("file", "sep")).withColumn("multi", F.lit(True))
    groups = (heads.join(multi, "file", "left").groupBy("header", "sep", F.coalesce("multi", F.lit(False)).alias("multi"))
              .agg(F.sort_array(F.collect_list("file")).alias("files"))
              .orderBy("header", "sep", "multi").collect())     # one row per kind of file
    if not groups:
        raise ValueError(f"no CSV file with a header under {path}")
    good, bad = [], []
    for g in groups:
        if g["multi"]:
            rows, rest = _read_records(spark, g["files"], g["sep"])
            good += rows
            bad += rest
            continue
        names = header_names(g["header"], g["sep"], spark)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
        df = (spark.read.schema(schema).option("header", True).option("sep", g["sep"]).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("escape", '"')
              .option("encoding", "UTF-8").option("enforceSchema", True).csv(g["files"]))
        df = df.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
        wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
        extra = F.from_csv(F.col(CORRUPT), wide, {"sep": g["sep"], "mode": "PERMISSIVE", "escape": '"'})[f"c{len(names)}"]
        # Spark wants a data column read beside the corrupt record
        read = F.length(F.concat_ws("", *[F.col(f"`{n}`") for n in names])) >= 0
        long = F.col(CORRUPT).isNotNull() & extra.isNotNull() & read
        good.append(df.filter(~F.coalesce(long, F.lit(False))).drop(CORRUPT))
        bad.append(df.filter(long).select(F.lit(g["header"]).alias("header"), F.col(CORRUPT).alias("line")))
    return good, bad


def stack(frames: list[DataFrame]) -> DataFrame:
    """Frames under one another, by column name."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def read_csv_checked(spark: SparkSession, path: str | list[str], sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of all files, joined by column name, so files
    whose columns differ in order or number never shift."""
    good, bad = read_csv_groups(spark, path, sep)
    rows = stack(good)
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != SOURCE_FILE]), stack(bad)


def _read_records(spark: SparkSession, files: list[str], sep: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows and quarantined lines of files whose records may span lines."""
    seps = spark.createDataFrame([(sep,)], "sep string").join(
        CR.lines_of(spark, files).select("file").distinct())
    recs, unclosed = CR.records(CR.lines_of(spark, files), seps)
    recs = recs.withColumn("value", F.when(F.col("rec") == 1, F.regexp_replace("value", "^\\uFEFF", "")).otherwise(F.col("value")))
    heads = recs.where("rec = 1").select("file", F.col("value").alias("header"))
    kinds = heads.select("header").distinct().orderBy("header").collect()     # one row per kind of file
    good, bad = [], [unclosed.join(heads, "file", "left").select("header", F.col("value").alias("line"))]
    body = recs.where("rec > 1").where(F.length(F.trim("value")) > 0).join(heads, "file")
    opts = {"sep": sep, "mode": "PERMISSIVE", "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    for k in kinds:
        names = header_names(k["header"], sep, spark)
        wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
        rows = body.where(F.col("header") == k["header"]).withColumn("r", F.from_csv("value", wide, opts))
        long = F.col(f"r.c{len(names)}").isNotNull()
        good.append(rows.where(~long).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)],
                                             F.col("file").alias(SOURCE_FILE)))
        bad.append(rows.where(long).select("header", F.col("value").alias("line")))
    return good, bad


def read_csv(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """The rows of :func:`read_csv_checked`."""
    return read_csv_checked(spark, path, sep)[0]


def csv_header_union(spark: SparkSession, paths: list[str]) -> list[str]:
    """Sorted union of header names of every file (one job)."""
    cut = F.split("header", F.concat(F.lit("["), "sep", F.lit("]")))
    names = csv_headers(spark, paths).select(F.explode(cut).alias("n"))
    names = names.select(F.regexp_replace("n", '^"|"$', "").alias("n")).distinct().orderBy("n")
    return [r["n"] for r in names.collect()]


def read_text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) with columns (path, text) / (path, reason).
    A file is one row; invalid UTF-8 goes to quarantine instead of aborting."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    as_text = raw.select("path", F.col("content").cast("string").alias("text"))
    ok = F.is_valid_utf8(F.col("text"))
    good = as_text.filter(ok)
    bad = as_text.filter(~ok).select("path", F.lit("invalid utf-8").alias("reason"))
    return good, bad


def stitch_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page",
                 text: str = "text") -> DataFrame:
    """Non-empty page texts in page order, each followed by a blank line.

    A document is one row in the reference's data model, so its pages are
    gathered per document (pages of other documents are never combined).
    """
    keep = pages.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    agg = keep.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"),
                                                                     F.col(text).alias("t")))).alias("_pg"))
    return agg.select(doc, F.array_join(F.transform("_pg", lambda s: F.concat(s["t"], F.lit(PAGE_SEPARATOR))),
                                        "").alias(text))


def latin1(c: Column) -> Column:
    """K9: characters outside Latin-1 become '?'."""
    return F.regexp_replace(c, r"[^\x00-\xFF]", "?")


def output_name(path: Column, ext: Column | str | None = None) -> Column:
    """``SEGURO_<base>.<ext>`` from a source path."""
    fname = F.regexp_extract(path, r"([^/\\]+)$", 1)
    base = F.regexp_replace(fname, r"\.[^.]*$", "")
    src_ext = F.lower(F.regexp_extract(fname, r"\.([^.]*)$", 1))
    e = src_ext if ext is None else (F.lit(ext) if isinstance(ext, str) else ext)
    return F.concat(F.lit(OUTPUT_PREFIX), base, F.lit("."), e)


def fit_lengths(df: DataFrame, max_lengths: dict[str, int]) -> DataFrame:
    """K3: cut strings to the target column's declared length."""
    return df.select(*[F.substring(F.col(c), 1, max_lengths[c]).alias(c) if c in max_lengths
                       else F.col(c) for c in df.columns])


def row_signature(df: DataFrame) -> Column:
    """K4: short, non-reversible id of a row for the reject log."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256), 1, 8)


def split_rejects(df: DataFrame, max_lengths: dict[str, int] | None = None,
                  required: list[str] | None = None,
                  unique_key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """K4: rows that would fail the target's checks go to a quarantine frame
    (with signature and reason) instead of being written or dropped silently.

    With ``unique_key``, every row after the first of a key is rejected as a
    duplicate, as the target's primary key would; "first" is the smallest row
    signature, so the choice does not depend on partitioning.  The window
    streams each key's rows (``row_number``), so a hot key needs no memory
    beyond its sort.
    """
    reasons = []
    if unique_key:
        from pyspark.sql import Window
        sig = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)
        w = Window.partitionBy(*[F.col(c) for c in unique_key]).orderBy(sig)
        df = df.withColumn("_dup", F.row_number().over(w) > 1)
        reasons.append(F.when(F.col("_dup"), F.lit("duplicate key")))
    for c, n in (max_lengths or {}).items():
        reasons.append(F.when(F.length(c) > n, F.lit(f"{c} longer than {n}")))
    for c in required or []:
        reasons.append(F.when(F.col(c).isNull(), F.lit(f"{c} is null")))
    reason = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    base = [c for c in df.columns if c != "_dup"]
    tagged = df.withColumn("_reason", reason).drop("_dup")
    accepted = tagged.filter(F.col("_reason") == "").drop("_reason")
    rejected = (tagged.filter(F.col("_reason") != "")
                .withColumn("_signature", row_signature(tagged.select(*base)))
                .withColumnRenamed("_reason", "reason").withColumnRenamed("_signature", "signature"))
    return accepted, rejected


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """K7: header, UTF-8, quotes doubled, spaces at the ends of a cell kept; with
    ``by``, one folder per value."""
    w = (df.write.mode(mode).option("header", True).option("encoding", "UTF-8").option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    (w.partitionBy(by) if by else w).csv(path)


def write_texts(df: DataFrame, path: str, name_col: str = "name", text_col: str = "text",
                mode: str = "overwrite") -> None:
    """K8: one text output per document, partitioned by output name."""
    df.select(name_col, text_col).write.mode(mode).partitionBy(name_col).text(path)
