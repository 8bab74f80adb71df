"""CSV records that span lines, read in parallel.

A quoted cell may hold line breaks, so a line is not a record and a task that
starts in the middle of a file cannot tell whether it stands inside a cell.
Each line is therefore seen as a function on two states, "a quoted cell is
open" or not: most lines keep the state, some flip it, some force it.  Such
functions compose associatively, so the state at every line follows from
running sums inside each file split and over the few rows that summarise the
splits of a file.  Only the lines of records that do span lines are gathered.

Quotes follow the usual reader's rules: a quote opens a cell only at the start
of a field, a doubled quote stays inside, any other text after the closing
quote is kept as it is.  A quote in the middle of a plain field is a character.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# places of the quote automaton, between two quotes of a line
START, INSIDE, CLOSED, PLAIN = 0, 1, 2, 3


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, no, value): the lines of text files; ``at`` is the split's
    offset, ``no`` orders the lines of a split.  Lines end at a line feed; a
    carriage return before it belongs to the line end only outside cells."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("no"), "value")


def leaves_open(line: Column, sep: Column, inside: bool) -> Column:
    """Whether a quoted cell is open at the end of ``line``, which begins
    inside such a cell or at the start of a field."""
    pieces = F.split(line, '"', -1)

    def at_quote(state: Column, piece: Column) -> Column:
        opens = F.when(F.endswith(piece, sep), INSIDE).otherwise(PLAIN)
        return (F.when(state == INSIDE, CLOSED)
                .when((state == CLOSED) & (piece == ""), INSIDE)
                .when((state == START) & (piece == ""), INSIDE)
                .otherwise(opens))

    quotes = F.slice(pieces, 1, F.size(pieces) - 1)
    folded = F.aggregate(quotes, F.lit(INSIDE if inside else START), at_quote) == INSIDE
    return F.when(line.contains('"'), folded).otherwise(F.lit(inside))


def files_with_open_lines(lines: DataFrame, seps: DataFrame) -> DataFrame:
    """The files in which some line leaves a quoted cell open.  In all other
    files every line is a record, by induction from the first."""
    quoted = lines.where(F.col("value").contains('"')).select("file", "value").join(seps, "file")
    return quoted.where(leaves_open(F.col("value"), F.col("sep"), False)).select("file").distinct()


def records(lines: DataFrame, seps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, unclosed): (file, rec, value) with whole records in ``value``,
    numbered from 1 in each file, and the lines of a last record whose cell is
    never closed, as they are.

    One shuffle deals the lines by file split, windows over a split's lines find
    their states; the rest touches one row per split and the lines of records
    that span lines."""
    spark = lines.sparkSession
    v, sep = F.col("value"), F.col("sep")
    seen = (lines.join(seps, "file")
            .withColumn("o", leaves_open(v, sep, False).cast("int"))
            .withColumn("i", leaves_open(v, sep, True).cast("int")))
    split = Window.partitionBy("file", "at").orderBy("no")
    upto = split.rowsBetween(Window.unboundedPreceding, 0)
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    # flips so far, and the state a forcing line sets (as if flips began there)
    flips = F.sum(F.when((F.col("o") == 1) & (F.col("i") == 0), 1).otherwise(0))
    marked = seen.withColumn("flips", flips.over(upto)).withColumn("flips_before", F.coalesce(flips.over(before), F.lit(0)))
    forced = F.when(F.col("o") == F.col("i"), F.pmod(F.col("o") + F.col("flips"), F.lit(2)))
    marked = (marked.withColumn("forced", F.last(forced, True).over(upto))
              .withColumn("forced_before", F.last(forced, True).over(before)))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sombra-csv/{uuid.uuid4().hex}"
    marked.select("file", "at", "no", "value", "flips", "flips_before", "forced", "forced_before", "o", "i").write.parquet(path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(fs_path)
    marked = spark.read.parquet(path)

    # the state each split begins in, from one row per split
    ends = marked.groupBy("file", "at").agg(F.max_by("flips", "no").alias("flips"), F.max_by("forced", "no").alias("forced"))
    over = Window.partitionBy("file").orderBy("at")
    total = F.sum("flips").over(over.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("total", total).withColumn("total_before", F.col("total") - F.col("flips"))
    # what a forcing split leaves, as if flips began with the file
    left = F.when(F.col("forced").isNotNull(), F.pmod(F.col("forced") + F.col("total_before"), F.lit(2)))
    first = F.coalesce(F.last(left, True).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = ends.withColumn("begin", F.pmod(first + F.col("total_before"), F.lit(2))).select("file", "at", "begin")

    inside = F.pmod(F.coalesce("forced_before", "begin") + F.col("flips_before"), F.lit(2))
    state = (marked.join(begin, ["file", "at"]).withColumn("inside", inside)
             .withColumn("open_after", F.when(F.col("inside") == 1, F.col("i")).otherwise(F.col("o"))))
    begun = state.groupBy("file", "at").agg(F.sum(1 - F.col("inside")).alias("n"), F.max_by("open_after", "no").alias("end"))
    done = begun.select("file", "at", (F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"),
                        F.sum("n").over(Window.partitionBy("file")).alias("last"),
                        F.last("end").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    numbered = (state.join(done, ["file", "at"])
                .withColumn("rec", F.col("base") + F.sum(1 - F.col("inside")).over(upto)))
    torn = (F.col("end") == 1) & (F.col("rec") == F.col("last"))
    whole = numbered.where(~torn)
    alone = (F.col("inside") == 0) & (F.col("open_after") == 0)
    ending = lambda c: F.regexp_replace(c, "\r$", "")
    single = whole.where(alone).select("file", "rec", ending(v).alias("value"))
    spread = (whole.where(~alone).groupBy("file", "rec")
              .agg(F.array_sort(F.collect_list(F.struct("at", "no", "value"))).alias("parts"))
              .select("file", "rec", ending(F.array_join(F.transform("parts", lambda p: p["value"]), "\n")).alias("value")))
    return single.unionByName(spread), numbered.where(torn).select("file", ending(v).alias("value"))
