"""Column classifier (C1-C11): sample each string column, score it, pick a policy.

Sample (C1).  Per column, the 50 distinct trimmed values with the smallest
``md5`` (a deterministic order that DuckDB can reproduce; never "first
rows").  To avoid shuffling every distinct value of a 100 TB table, a first
pass estimates each column's distinct count (HyperLogLog, map-side partial
aggregates); the second pass keeps only values whose hash falls below a
per-column threshold expected to admit ~8x the sample, then de-duplicates
and ranks that small remainder.  The result is exact: if a column ends up
with fewer than 50 samples while its threshold was below the maximum, it is
sampled again with no threshold.

Scores (C2-C10) are Catalyst expressions over the samples, aggregated per
column; the policy frame has one row per column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.text import py_strip, word_count
from ..session import ensure_checkpoint_dir
from .lexicon import recognise_names

HASH_DIGITS = 15                      # 60 bits of md5 as a bigint
HASH_SPACE = 16 ** HASH_DIGITS
OVERSAMPLE = 8

VOTE_TYPES = ["CPF", "IP", "RG", "EMAIL", "PLATE", "PHONE", "CHASSI", "DATE_TIME"]
# Tie order for equal scores (explicit, SURVEY C7 and Q7: DATE_TIME beats RG).
TAG_PRIORITY = ["CPF", "DATE_TIME", "IP", "RG", "EMAIL", "PLATE", "PHONE", "CHASSI",
                "TEXTO_LIVRE", "NOME_SOLTO"]
POLICY_SCHEMA = "table string, column string, tag string, confidence double, n_samples int"


def name_parts(column: str) -> list[str]:
    """``nr_cpfTitular`` -> ["nr", "cpf", "titular"] (whole parts, SURVEY Q22)."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", column)
    return [p for p in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if p]


def name_hints(column: str) -> set[str]:
    return {P.NAME_HINTS[p] for p in name_parts(column) if p in P.NAME_HINTS}


def name_is_ignored(column: str) -> bool:
    return any(p in P.IGNORE_NAME_PARTS for p in name_parts(column))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def sample_hash(value: Column) -> Column:
    return F.md5(value)


def _hash_prefix(h: Column) -> Column:
    return F.conv(F.substring(h, 1, HASH_DIGITS), 16, 10).cast("bigint")


def long_values(df: DataFrame, columns: list[str], table: str = "") -> DataFrame:
    """Unpivot to (table, column, value), trimmed, null tokens dropped."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                      for c in columns])
    v = py_strip(F.col("value"))
    return (df.select(F.inline(cells))
              .select(F.lit(table).alias("table"), "column", v.alias("value"))
              .filter(F.col("value").isNotNull() & ~F.upper("value").isin(P.NULL_TOKENS)))


def _key(table: Column | str, column: Column | str) -> Column:
    t = F.lit(table) if isinstance(table, str) else table
    c = F.lit(column) if isinstance(column, str) else column
    return F.concat(t, F.lit("\u0000"), c)


def _ranked(long: DataFrame, thresholds: dict[tuple[str, str], int] | None, k: int) -> DataFrame:
    """(table, column, value, h, rank): the k distinct values with the smallest
    hash per column.  ``row_number() <= k`` lets Spark keep only k rows per
    column on the map side before the window's shuffle."""
    x = long.withColumn("h", sample_hash(F.col("value")))
    if thresholds is not None:
        tmap = F.create_map(*[a for (t, c), th in thresholds.items() for a in (_key(t, c), F.lit(th))])
        x = x.filter(_hash_prefix(F.col("h")) < F.element_at(tmap, _key(F.col("table"), F.col("column"))))
    w = Window.partitionBy("table", "column").orderBy("h", "value")
    return (x.select("table", "column", "value", "h").distinct()
             .withColumn("rank", F.row_number().over(w))
             .filter(F.col("rank") <= k))


# A sample that is wholly a document number is not a GPS sample, although
# "123.456.789-01" holds "123.456" (design, README: the GPS rule would
# otherwise jitter CPF columns as coordinates and leave most digits).  A value
# that is one whole decimal number stays a coordinate although a latitude with
# six decimals also fits RG.
#
# In a longer value coordinates must cover most of what is written: a sentence
# with a CPF, a date or an amount in it is prose, not a position (the GPS rule
# alone would jitter such a column and leave its names and documents in clear).
COORD_COVER = 0.5
WHOLE_DECIMAL = r"^[-+]?[0-9]{1,3}[.,][0-9]{3,}$"
DOCUMENT_SHAPES = ["CPF", "RG", "IP", "PHONE"]


def _written(c: Column) -> Column:
    """Letters and digits of a text, counted."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def coordinate_cover(v: Column) -> Column:
    """The share of a value's letters and digits that coordinates cover,
    after e-mails, amounts, CPFs and dates are taken out."""
    rest = v
    for pattern in (P.DETECTORS["EMAIL"].pattern, P.UNICODE + P.MONEY, P.DETECTORS["CPF"].pattern, P.DETECTORS["DATE_TIME"].pattern):
        rest = F.regexp_replace(rest, pattern, " ")
    covered = _written(rest) - _written(F.regexp_replace(rest, P.DETECTORS["COORD_SINGLE"].pattern, " "))
    return covered / F.greatest(_written(v), F.lit(1))


def _sample_features(samples: DataFrame) -> DataFrame:
    v = F.col("value")
    n_len = F.greatest(F.length(v), F.lit(1))
    votes = {t: (F.length(F.regexp_extract(v, P.DETECTORS[t].pattern, 0)) / n_len) >= P.FULL_MATCH_SHARE
             for t in VOTE_TYPES}
    is_document = F.lit(False)
    for t in DOCUMENT_SHAPES:
        is_document = is_document | votes[t]
    is_document = is_document & ~v.rlike(WHOLE_DECIMAL)
    feats = [
        ((coordinate_cover(v) > COORD_COVER) & ~is_document).cast("int").alias("gps"),
        v.rlike(P.DETECTORS["COORD"].pattern).cast("int").alias("pair"),
        word_count(v).alias("words"),
        v.rlike(P.UNICODE + P.PROSE_PUNCT).cast("int").alias("punct"),
    ]
    feats += [votes[t].cast("int").alias("v_" + t) for t in VOTE_TYPES]
    return samples.select("table", "column", *feats)


def name_votes(samples: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(table, column, v_NOME): samples that names from ``lexicon`` cover, by
    the share that the other votes ask for.  A single word counts: a column of
    first names is a column of names."""
    ids = ["table", "column", "rank"]
    found = recognise_names(samples, ids, "value", lexicon, min_words=1)
    covered = found.groupBy(*ids).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    hit = F.col("covered") / F.greatest(F.length("value"), F.lit(1)) >= P.FULL_MATCH_SHARE
    return (samples.join(covered, ids).where(hit).groupBy("table", "column")
            .agg(F.count(F.lit(1)).cast("double").alias("v_NOME")))


def score_columns(samples: DataFrame, columns: list[tuple[str, str]], lexicon: DataFrame | None = None) -> DataFrame:
    """C2-C11 over a sample frame -> policy frame, one row per (table, column)."""
    agg = (_sample_features(samples).groupBy("table", "column").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.avg("gps").alias("gps_share"),
        F.max("pair").alias("any_pair"),
        F.avg("words").alias("mean_words"),
        F.max("punct").alias("any_punct"),
        *[F.sum("v_" + t).cast("double").alias("v_" + t) for t in VOTE_TYPES]))
    if lexicon is None:
        agg = agg.withColumn("v_NOME", F.lit(0.0))
    else:
        agg = agg.join(name_votes(samples, lexicon), ["table", "column"], "left").na.fill(0.0, ["v_NOME"])

    # plan-time facts about the names (metadata, one entry per column)
    key = _key(F.col("table"), F.col("column"))
    ignored = [_key(t, c) for t, c in columns if name_is_ignored(c)]

    n = F.col("n").cast("double")
    scores = []
    for t in TAG_PRIORITY:
        if t in VOTE_TYPES:
            s = F.col("v_" + t)
            with_hint = [(tb, c) for tb, c in columns if t in name_hints(c)]
            if with_hint:
                hinted = F.lit(False)
                for tb, c in with_hint:
                    hinted = hinted | ((F.col("table") == tb) & (F.col("column") == c))
                s = s + F.when(hinted, n * P.NAME_HINT_WEIGHT).otherwise(0.0)
        elif t == "TEXTO_LIVRE":
            s = F.when((F.col("mean_words") >= P.PROSE_MEAN_WORDS) | (F.col("any_punct") == 1),
                       n * P.PROSE_WEIGHT).otherwise(0.0)
        else:
            s = F.col("v_NOME")  # NOME_SOLTO: 0 without a dictionary (SURVEY Q13)
        scores.append(F.struct(s.alias("score"), F.lit(-TAG_PRIORITY.index(t)).alias("neg_prio"),
                               F.lit(t).alias("tag")))
    positive = F.filter(F.array(*scores), lambda s: s["score"] > 0)
    best = F.array_max(positive)
    total = F.aggregate(positive, F.lit(0.0), lambda a, s: a + s["score"])
    conf = best["score"] / n
    mapped = F.coalesce(F.element_at(F.create_map(*[a for k, v in P.TAG_TO_POLICY.items()
                                                     for a in (F.lit(k), F.lit(v))]), best["tag"]),
                        best["tag"])
    coord_tag = F.when(F.col("any_pair") == 1, "COORD").otherwise("COORD_SINGLE")
    is_ignored = key.isin(ignored) if ignored else F.lit(False)
    tag = (F.when(F.col("gps_share") >= P.GPS_SHARE, coord_tag)
            .when(best.isNotNull() & (conf >= P.MIN_CONFIDENCE), mapped)
            .when(is_ignored, "IGNORAR")
            .when(total > 0, "TEXTO_LIVRE")
            .otherwise("IGNORAR"))
    confidence = (F.when(F.col("gps_share") >= P.GPS_SHARE, F.col("gps_share"))
                  .otherwise(F.coalesce(conf, F.lit(0.0))))
    # C11: columns with no usable sample are free text with n_samples = 0
    # (one row per column on both sides of this join)
    every = samples.sparkSession.createDataFrame(columns, "table string, column string")
    joined = every.join(agg, ["table", "column"], "left")
    has = F.col("n").isNotNull()
    return joined.select("table", "column",
                         F.when(has, tag).otherwise(F.lit("TEXTO_LIVRE")).alias("tag"),
                         F.when(has, F.round(confidence, 6)).otherwise(F.lit(0.0)).alias("confidence"),
                         F.coalesce(F.col("n"), F.lit(0)).alias("n_samples"))


def classify_tables(frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None,
                    k: int = P.SAMPLE_SIZE, lexicon: DataFrame | None = None) -> DataFrame:
    """C1-C11 for many tables at once: policy frame
    (table, column, tag, confidence, n_samples).  ``lexicon`` is a frame (term)
    of names for the name vote (C6).

    Jobs: one HyperLogLog pass for distinct counts, one sampling pass whose
    small result (<= k rows per column) is checkpointed, one count check,
    then the scoring over the checkpoint.  Nothing grows with table size
    except the two scans.
    """
    pairs: list[tuple[str, str]] = []
    longs = []
    for t, df in frames.items():
        cols = (columns or {}).get(t) or string_columns(df)
        if not cols:
            continue
        pairs += [(t, c) for c in cols]
        longs.append(long_values(df, cols, t))
    if not longs:
        return next(iter(frames.values())).sparkSession.createDataFrame([], POLICY_SCHEMA)
    spark = longs[0].sparkSession
    long = longs[0]
    for x in longs[1:]:
        long = long.unionByName(x)

    ndv = {(r["table"], r["column"]): r["ndv"] for r in
           long.groupBy("table", "column").agg(F.approx_count_distinct("value").alias("ndv")).collect()}
    # a small column's threshold is the whole hash space
    thresholds = {p: min(HASH_SPACE, int(HASH_SPACE * OVERSAMPLE * k / max(ndv.get(p, 0), 1))) for p in pairs}
    cut = {p for p, th in thresholds.items() if th < HASH_SPACE}
    # the sample is small (<= k rows per column): cut its lineage once so the
    # count check and the scoring do not scan the tables again
    ensure_checkpoint_dir(spark)
    samples = _ranked(long, thresholds, k).checkpoint()
    if cut:
        counts = {(r["table"], r["column"]): r["n"] for r in
                  samples.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [p for p in cut if counts.get(p, 0) < k]
        if short:   # threshold admitted too few values: sample those columns in full
            redo_keys = [_key(t, c) for t, c in short]
            redo = _ranked(long.filter(_key(F.col("table"), F.col("column")).isin(redo_keys)), None, k)
            samples = samples.filter(~_key(F.col("table"), F.col("column")).isin(redo_keys)) \
                             .unionByName(redo)
    return score_columns(samples, pairs, lexicon)


def classify_columns(df: DataFrame, columns: list[str] | None = None, table: str = "",
                     k: int = P.SAMPLE_SIZE, lexicon: DataFrame | None = None) -> DataFrame:
    """C1-C11 for one table."""
    return classify_tables({table: df}, {table: columns} if columns else None, k, lexicon)


def policy_map(policies: DataFrame, table: str | None = None) -> dict[str, str]:
    """The policy frame is one row per column: collect it to build the mask
    plan.  Two tables' columns of one name are refused without ``table``."""
    if table is not None:
        policies = policies.filter(F.col("table") == table)
    rows = policies.select("column", "tag").collect()
    out = {r["column"]: r["tag"] for r in rows}
    if len(out) < len(rows):
        raise ValueError("several policies for a column: pass the table they are meant for")
    return out
