"""Names by a caller's dictionary (C6, D14, D16): joins and folds, no model.

``recognise_names`` is a position-preserving dictionary join: every text is cut
into tokens with their offsets, runs of up to n tokens meet the dictionary's
normal forms in a join, and the hits, which carry their positions, are merged
into names.  The dictionary is a frame ``(term)`` of single or several words;
Spark broadcasts it when its size allows and shuffles the hits' keys otherwise.

``trim_candidate`` is a state machine over a candidate's tokens: leading
prepositions and articles are skipped, and a verb, number or punctuation mark
ends the name.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.expr import let
from ..functions.text import MARK_CLOSE, MARK_OPEN, MARK_SAFE, normalize, py_strip
from ..session import ship_package

# A word, or anything else that is not white space: only white space may stand
# between the tokens of one name.
TOKEN = r"(?U)\p{L}[\p{L}\p{M}'’\-]*|[^\s\p{L}]+"
CHUNK = 32


def prefix_sums(lengths: Column) -> Column:
    """Sums of all elements before each one.  Folded in chunks: growing one
    array over a long text would copy it once per element."""
    def by_chunk(a: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / CHUNK).cast("int"), F.lit(0)))
        part = lambda c: F.slice(a, c * CHUNK + 1, F.lit(CHUNK))
        running = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(
            acc, F.array(F.element_at(acc, -1) + x)))
        sums = F.transform(chunks, lambda c: F.aggregate(part(c), F.lit(0), lambda s, x: s + x))
        return let(running(sums, F.lit(0)), lambda offs: F.flatten(F.transform(
            chunks, lambda c: let(running(part(c), F.element_at(offs, c + 1)),
                                  lambda r: F.slice(r, F.lit(1), F.size(r) - 1)))))
    return let(lengths, by_chunk)


def tokens(text: Column) -> Column:
    """array<struct<start, end, value>> of the tokens of a text, in order."""
    clear = F.translate(text, MARK_OPEN + MARK_CLOSE, MARK_SAFE + MARK_SAFE)
    pieces = F.split(F.regexp_replace(clear, TOKEN, MARK_OPEN + "$0" + MARK_CLOSE), MARK_OPEN)

    def located(ps: Column) -> Column:
        rest = F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0)))
        first = F.length(F.element_at(ps, 1))
        return let(rest, lambda r: F.when(F.size(r) > 0, F.zip_with(
            r, prefix_sums(F.transform(r, lambda p: F.length(p) - 1)),
            lambda p, s: let(F.substring_index(p, MARK_CLOSE, 1), lambda v: F.struct(
                (first + s).alias("start"), (first + s + F.length(v)).alias("end"), v.alias("value"))))))
    return let(pieces, located)


def dictionary(lexicon: DataFrame) -> DataFrame:
    """Distinct normal forms (key) of a frame (term), words parted by one space."""
    key = F.regexp_replace(normalize(F.col("term")), r"(?U)\s+", " ")
    return lexicon.select(key.alias("key")).where(F.length("key") > 0).distinct()


def name_hits(df: DataFrame, id_cols: list[str], text_col: str, lexicon: DataFrame) -> DataFrame:
    """(ids, at, n, start, end): runs of ``n`` tokens from token ``at`` on whose
    normal form is in the dictionary, and particles (n = 0), which can join
    names but are none.

    The dictionary's longest term (one number) sets how many tokens a run has."""
    words = dictionary(lexicon)
    longest = words.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0
    if not longest:
        return df.select(*id_cols, F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    if longest > 1:
        row = df.select(*id_cols, tokens(F.col(text_col)).alias("ts"))
        row = row.withColumn("ws", F.transform("ts", lambda t: normalize(t["value"])))
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(
            F.when(F.size("ws") >= n, F.sequence(F.lit(1), F.size("ws") - n + 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct((i - 1).alias("at"), n.alias("n"), F.element_at("ts", i)["start"].alias("start"),
                               F.element_at("ts", i + n - 1)["end"].alias("end"),
                               F.array_join(F.slice("ws", i, n), " ").alias("key")))))
        grams = row.select(*id_cols, F.inline(runs))
    else:
        toks = df.select(*id_cols, F.posexplode(tokens(F.col(text_col))).alias("at", "t"))
        grams = toks.select(*id_cols, "at", F.lit(1).alias("n"), F.col("t.start").alias("start"), F.col("t.end").alias("end"),
                            normalize(F.col("t.value")).alias("key"))
    # texts are cut once: a run may be a term, a particle (n = 0), or both
    met = grams.join(words.withColumn("term", F.lit(True)), "key", "left")
    kinds = F.array(F.when(F.col("term"), F.col("n")),
                    F.when((F.col("n") == 1) & F.col("key").isin(P.NAME_PARTICLES), F.lit(0)))
    return (met.select(*id_cols, "at", F.explode(kinds).alias("kind"), "start", "end").where("kind is not null")
            .select(*id_cols, "at", F.col("kind").alias("n"), "start", "end"))


def recognise_names(df: DataFrame, id_cols: list[str], text_col: str, lexicon: DataFrame,
                    min_words: int = P.MIN_NAME_WORDS) -> DataFrame:
    """(ids, start, end, n_words): maximal runs of dictionary words,
    particles between them included, with at least ``min_words`` words of the
    dictionary, three characters and no stop word (checked by the caller, who
    has the text).  ``id_cols`` name a row."""
    hits = name_hits(df, id_cols, text_col, lexicon)
    # the tokens that hits cover, each once; a name's word outranks a particle
    cover = (hits.select(*id_cols, F.explode(F.sequence("at", F.col("at") + F.greatest(F.col("n") - 1, F.lit(0)))).alias("k"),
                         "at", "n", "start", "end"))
    tok = cover.groupBy(*id_cols, "k").agg(
        F.max(F.when(F.col("n") > 0, 1).otherwise(0)).alias("word"),
        F.min(F.when(F.col("k") == F.col("at"), F.col("start"))).alias("start"),
        F.max(F.when(F.col("k") == F.col("at") + F.greatest(F.col("n") - 1, F.lit(0)), F.col("end"))).alias("end"))
    order = Window.partitionBy(*id_cols).orderBy("k")
    run = tok.withColumn("run", F.col("k") - F.row_number().over(order))
    return (run.groupBy(*id_cols, "run")
            .agg(F.min(F.when(F.col("word") == 1, F.col("start"))).alias("start"),
                 F.max(F.when(F.col("word") == 1, F.col("end"))).alias("end"), F.sum("word").cast("int").alias("n_words"))
            .where((F.col("n_words") >= min_words) & F.col("start").isNotNull())
            .select(*id_cols, "start", "end", "n_words"))


def with_entities(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, out_col: str = "entity_terms") -> DataFrame:
    """``df`` with the names found in each text, ready for
    ``mask_text(entity_terms=…)``.  Names with a stop word or a digit are left
    out there.  ``id_col`` must be unique."""
    found = recognise_names(df.select(id_col, text_col), [id_col], text_col, lexicon)
    spans = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_found"))
    cut = F.transform("_found", lambda s: F.substr(F.col(text_col), s["start"] + 1, s["end"] - s["start"]))
    return (df.join(spans, id_col, "left")
            .withColumn(out_col, F.coalesce(F.array_distinct(cut), F.array().cast("array<string>"))).drop("_found"))


def recognise(df: DataFrame, text_col: str, recogniser: Callable[[pd.Series], pd.Series],
              out_col: str = "entity_terms") -> DataFrame:
    """add the names a caller's recogniser finds.

    ``recogniser`` maps a batch of texts to a batch of name lists, so a model
    can score whole Arrow batches.  Case (title case for texts in one case) and
    the names' edge punctuation are handled by Spark before and after it.  Blank
    texts come in as empty strings.  The rows keep their partition and columns."""
    ship_package(df.sparkSession)
    t = F.coalesce(F.col(text_col), F.lit(""))
    one_case = (F.upper(t) == t) | (F.lower(t) == t)
    ready = df.withColumn("_in", F.when(one_case, F.initcap(t)).otherwise(t))
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = recogniser(b["_in"])
            if len(names) != len(b):
                raise ValueError("the recogniser must give one list per text")
            yield b.drop(columns="_in").assign(**{out_col: list(names)})

    edge = r"^[.,;:?!() \n'\"]+|[.,;:?!() \n'\"]+$"
    found = ready.mapInPandas(run, schema)
    return found.withColumn(out_col, F.transform(out_col, lambda n: F.regexp_replace(n, edge, "")))


# ---------------------------------------------------------------------------
# D16
# ---------------------------------------------------------------------------

TRIM_TOKEN = r"(?U)(\p{L}[\p{L}\p{M}'’\-]*|\d[\d.,]*|[^\s])\s*"
LEADING, TAKING, ENDED = 0, 1, 2


def trim_candidate(value: Column, verbs: Column | None = None) -> Column:
    """struct(value, skip): the candidate without its leading closed-class
    words, up to the first verb, number or punctuation mark, and how many
    characters were skipped before it.  ``verbs`` is an array of lower-case
    verbs beside the auxiliaries that are known anyway."""
    stop_words = F.array(*[F.lit(w) for w in P.AUXILIARIES])
    if verbs is not None:
        stop_words = F.concat(stop_words, verbs)
    lead = F.length(F.regexp_extract(value, r"(?U)^\s*", 0))

    def step(acc: Column, tok: Column) -> Column:
        word = F.lower(py_strip(tok))
        skip = (acc["state"] == LEADING) & word.isin(P.LEADING_WORDS)
        stop = ~tok.rlike(r"^\p{L}") | F.array_contains(stop_words, word)
        return F.when((acc["state"] == ENDED), acc).otherwise(
            F.when(skip, acc.withField("skip", acc["skip"] + F.length(tok)))
            .when(stop, acc.withField("state", F.lit(ENDED)))
            .otherwise(acc.withField("state", F.lit(TAKING)).withField("out", F.concat(acc["out"], tok))))

    zero = F.struct(F.lit(LEADING).alias("state"), lead.alias("skip"), F.lit("").alias("out"))
    folded = F.aggregate(F.regexp_extract_all(value, F.lit(TRIM_TOKEN), F.lit(0)), zero, step)
    return let(folded, lambda r: F.struct(py_strip(r["out"]).alias("value"), r["skip"].cast("int").alias("skip")))


def trim_spans(spans: Column, verbs: Column | None = None) -> Column:
    """D16 on name spans: values trimmed, offsets moved with them."""
    def one(s: Column) -> Column:
        return let(trim_candidate(s["value"], verbs), lambda t: s.withField("value", t["value"])
                   .withField("start", (s["start"] + t["skip"]).cast("int"))
                   .withField("end", (s["start"] + t["skip"] + F.length(t["value"])).cast("int")))
    return F.transform(spans, one)
