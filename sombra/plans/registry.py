"""Registered queries: each reads the given tables and exercises operators of
SURVEY section 2 end to end.  ``__spark_entry__`` exposes them; the matching
DuckDB SQL lives in ``oracle``.

Inputs that the reference takes from Brazilian records (CPF, plates, ...)
are derived from table keys by the same expression text on both sides, so
the work of every query grows with the tables.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import surrogates as S
from ..functions.hashing import MaskKey
from ..functions.text import html_escape, html_unescape, normalize
from ..operators import audit as A
from ..operators import classify as C
from ..operators import fragments as FR
from ..operators import lexicon as L
from ..operators import names as N
from ..operators.mask import MaskRules, find_pii, mask_table, mask_text, mask_text_struct, mask_with_verdicts
from ..operators.spans import regex_spans, restore, shield, shield_tags
from ..functions import patterns as P
from ..session import ensure_checkpoint_dir
from ..sources import files as FS
from . import catalog as CAT

# A fixed demonstration key: the oracle SQL embeds the same padded blocks.
DEMO_KEY = MaskKey(b"sombra-demo-key")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str, key: str, cols: list[str] | None = None) -> DataFrame:
    """A table about to go through per-row heavy work.  Its parallelism is the
    scan's: set ``spark.sql.files.maxPartitionBytes`` for smaller splits."""
    df = table(spark, sf_dir, name)
    return df.select(*cols) if cols else df


ROWS_PER_TASK = 20_000
KEYS_PER_TASK = 200_000         # at most: of distinct ones there are fewer


def spread(df: DataFrame) -> DataFrame:
    """``df``, of a few short columns, dealt evenly over tasks of
    ``ROWS_PER_TASK`` rows: a file of short rows is one split, or one row group,
    however many rows it holds.  Rows are counted from the files' footers."""
    n = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(n) if n > 1 else df


# ---------------------------------------------------------------------------
# Detectors (D1-D10): every match of one detector, before overlap resolution
# ---------------------------------------------------------------------------

def _matches(spark, sf_dir, tag: str, with_pos: bool) -> DataFrame:
    d = P.DETECTORS[tag]
    docs = heavy(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    spans = regex_spans(F.col("text"), d.pattern, tag, d.prio)
    cols = ["doc_id", (F.col("pos") + 1).alias("match_no")]
    if with_pos:
        cols += [F.col("s.start").alias("start"), F.col("s.end").alias("end")]
    cols.append(F.col("s.value").alias("value"))
    return docs.select("doc_id", F.posexplode(spans).alias("pos", "s")).select(*cols)


def _detector_query(tag: str, with_pos: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _matches(spark, sf_dir, tag, with_pos)


def find_all_pii(spark, sf_dir) -> DataFrame:
    """F4 + D19: kept findings of every detector (reference profile)."""
    docs = heavy(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    return (docs.select("doc_id", F.inline(find_pii(F.col("text"), MaskRules(names=False))))
                .select("doc_id", "start", "end", "type", "value"))


# ---------------------------------------------------------------------------
# Surrogates (M1-M14) on values derived from keys
# ---------------------------------------------------------------------------

def cpf_source(k: Column) -> Column:
    """A valid CPF per key: scattered payload digits and their check digits."""
    payload = F.lpad(((k * 7919) % 1000000000).cast("string"), 9, "0")
    c1, c2 = S.cpf_checks([F.substring(payload, i + 1, 1).cast("int") for i in range(9)])
    return F.concat(payload, c1.cast("string"), c2.cast("string"))


def coord_source(k: Column) -> Column:
    return F.concat(F.lit("-"), (k % 89).cast("string"), F.lit("."),
                    F.lpad(((k * 37) % 10000).cast("string"), 4, "0"), F.lit(",-"),
                    (k % 179).cast("string"), F.lit("."),
                    F.lpad(((k * 53) % 10000).cast("string"), 4, "0"))


def seed_customer(spark, sf_dir) -> DataFrame:
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return c.select("c_custkey", normalize(F.col("c_name")).alias("norm"),
                    S.digest(F.col("c_name"), "PER", DEMO_KEY).alias("seed_hex"))


def _mask_values(tag: str, source: Callable[[Column], Column]):
    def q(spark, sf_dir):
        c = spread(table(spark, sf_dir, "customer").select("c_custkey"))
        src = c.select("c_custkey", source(F.col("c_custkey")).alias("src"))
        return S.add_surrogates(src, {"masked": (tag, "src")}, DEMO_KEY, keep_blank=False)
    return q


def shaped_sources(k: Column) -> dict[str, Column]:
    """A value of each type's own shape per key, with the separators and case
    that the canonical forms have to see through."""
    pad = lambda x, n: F.lpad((x % 10 ** n).cast("string"), n, "0")
    part = lambda t, at, n: F.substring(t, at, n)
    rg, tel = pad(k * 7919, 8), pad(k * 104729, 8)
    octet = lambda m: (k * m % 256).cast("string")
    return {
        "RG": F.concat(part(rg, 1, 2), F.lit("."), part(rg, 3, 3), F.lit("."), part(rg, 6, 3), F.lit("-"),
                       F.when(k % 11 == 10, "x").otherwise((k % 11).cast("string"))),
        "PHONE": F.concat(F.lit("("), (k % 89 + 11).cast("string"), F.lit(") 9"), part(tel, 1, 4), F.lit("-"), part(tel, 5, 4)),
        "IP": F.concat_ws(".", octet(3), octet(7), octet(11), octet(13)),
        "CHASSI": F.concat(F.lit("9bw zzz-377vt"), pad(k * 31, 6)),
        "PLATE": F.concat(F.lit("a"), F.substr(F.lit("BCDEFGHJKL"), (k % 10 + 1).cast("int"), F.lit(1)), F.lit("c-"), pad(k * 17, 4)),
        "EMAIL": F.concat(F.lit(" User"), k, F.lit("@Exemplo.COM ")),
    }


def mask_shapes(spark, sf_dir) -> DataFrame:
    """M8-M13 on values of their own shape: source and mask of every type."""
    src = shaped_sources(F.col("c_custkey"))
    c = spread(table(spark, sf_dir, "customer").select("c_custkey"))
    both = S.add_surrogates(c.select("c_custkey", *[x.alias(f"src_{t}") for t, x in src.items()]),
                            {f"masked_{t}": (t, f"src_{t}") for t in src}, DEMO_KEY, keep_blank=False)
    return both.select("c_custkey", *[x for t in src for x in (f"src_{t}", f"masked_{t}")])


def mask_person(spark, sf_dir) -> DataFrame:
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return S.add_surrogates(c, {"masked": ("PER", "c_name")}, DEMO_KEY, keep_blank=False).select("c_custkey", "masked")


def jitter_coord(spark, sf_dir) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    src = o.select("o_orderkey", coord_source(F.col("o_orderkey")).alias("src"))
    return S.add_surrogates(src, {"masked": ("COORD", "src")}, DEMO_KEY, keep_blank=False)


def masked_join(spark, sf_dir) -> DataFrame:
    """Join customer and orders on masked keys; per segment counts equal
    the unmasked join's."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    o = spread(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"))
    mc = S.add_surrogates(c.filter(F.col("c_custkey").isNotNull())
                           .select(cpf_source(F.col("c_custkey")).alias("k"), "c_mktsegment"),
                          {"k": ("CPF", "k")}, DEMO_KEY, non_null=True)
    mo = S.add_surrogates(o.filter(F.col("o_custkey").isNotNull())
                           .select(cpf_source(F.col("o_custkey")).alias("k"), "o_totalprice"),
                          {"k": ("CPF", "k")}, DEMO_KEY, non_null=True)
    # orders are reduced to one row per masked key before the join, so a hot
    # customer costs one row in the shuffle, not a third of the orders
    per_key = mo.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return (per_key.join(mc, "k").groupBy("c_mktsegment")
              .agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("revenue")))


# ---------------------------------------------------------------------------
# Text masking
# ---------------------------------------------------------------------------

def mask_documents_email(spark, sf_dir) -> DataFrame:
    d = heavy(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", mask_text(F.col("text"), MaskRules.only("EMAIL"), DEMO_KEY).alias("masked"))


def mask_documents(spark, sf_dir) -> DataFrame:
    d = heavy(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", mask_text(F.col("text"), MaskRules(), DEMO_KEY).alias("masked"))


def strip_shield_roundtrip(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    h = F.col("html")
    return p.select("page_id", restore(shield(h), shield_tags(h)).alias("html"))


def mask_pages_email(spark, sf_dir) -> DataFrame:
    """P12 + D4: e-mails in page text are masked, markup is kept byte for byte."""
    p = heavy(spark, sf_dir, "pages", "page_id")
    return p.select("page_id", mask_text(F.col("html"), MaskRules.only("EMAIL"), DEMO_KEY).alias("html"))


def candidate_terms(spark, sf_dir) -> DataFrame:
    d = heavy(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"]).select("text")
    c = heavy(spark, sf_dir, "conversations", "conv_id", ["conv_id", "text"]).select("text")
    return N.candidate_terms(d.unionByName(c), "text")


def _rule_scorer(terms):
    """Stand-in adjudicator (F2): a term is a person when it has two to four
    words and every word is alphabetic.  Runs per Arrow batch."""
    import pandas as pd
    words = terms.str.split()
    return words.map(lambda ws: 2 <= len(ws) <= 4 and all(w.isalpha() for w in ws)).astype(bool) \
        if len(terms) else pd.Series([], dtype=bool)


def name_verdict_semi(spark, sf_dir) -> DataFrame:
    """D18 + J3: distinct candidate terms, adjudicated with mapInPandas, kept
    when the verdict approves them (left-semi join on the term)."""
    cands = candidate_terms(spark, sf_dir)
    verdicts = N.adjudicate(cands, _rule_scorer)
    return N.verdict_terms(cands, verdicts)


def name_trusted_anti(spark, sf_dir) -> DataFrame:
    """Per document, suspect names that are not already trusted there."""
    docs = heavy(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    t = F.col("text")
    sus = N.approved_suspects(N.suspect_names(t), N.trusted_names(t), None, approve_all=True)
    return docs.select("doc_id", F.inline(sus)).select("doc_id", "start", "value")


def demo_verdicts(terms: DataFrame) -> DataFrame:
    """Stand-in verdicts over the distinct terms: an even number of letters is
    a person, so some terms are refused."""
    return terms.select("term_key", (F.length("term_key") % 2 == 0).alias("is_person"))


def name_verdict_docs(spark, sf_dir) -> DataFrame:
    """J3 + D18 per document: the terms approved for each document's mask."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = N.approved_row_terms(docs, "doc_id", "text", demo_verdicts(N.candidate_terms(docs, "text")))
    return terms.select("doc_id", F.array_join("_terms", "|").alias("terms"))


def mask_documents_verdict(spark, sf_dir) -> DataFrame:
    """D18 + J3 + D23: documents masked with the approved names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    verdicts = demo_verdicts(N.candidate_terms(docs, "text"))
    return mask_with_verdicts(docs, "doc_id", "text", verdicts, MaskRules(), DEMO_KEY).withColumnRenamed("text", "masked")


def mask_collisions(spark, sf_dir) -> DataFrame:
    """Distinct keys and distinct masks of the join-key types."""
    src = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(cpf_source(F.col("o_orderkey")).alias("CPF"),
                                                F.concat(F.lit("u"), F.col("o_orderkey"), F.lit("@example.com")).alias("EMAIL"))
    both = S.add_surrogates(src, {"m_CPF": ("CPF", "CPF"), "m_EMAIL": ("EMAIL", "EMAIL")}, DEMO_KEY)
    pairs = both.select(F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("k"), F.col(f"m_{t}").alias("m"))
                                           for t in ("CPF", "EMAIL")])))
    return pairs.groupBy("type").agg(F.countDistinct("k").alias("n_keys"), F.countDistinct("m").alias("n_masks"))


def upper_runs(spark, sf_dir) -> DataFrame:
    """D13 + D15 + D17: upper-case name candidates per document."""
    docs = heavy(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    spans = N.suspect_names(F.col("text"))
    return (docs.select("doc_id", F.posexplode(spans).alias("pos", "s"))
                .select("doc_id", F.col("s.start").alias("start"), F.col("s.value").alias("value")))


def fragment_text(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    frags = FR.fragments(F.col("text"))
    return d.select("doc_id", F.posexplode(frags).alias("frag_no", "fragment")) \
            .select("doc_id", "frag_no", F.length("fragment").alias("n_chars"))


def mask_long_documents(spark, sf_dir) -> DataFrame:
    """D22 + D23: fragment, mask each fragment, concatenate in order."""
    d = heavy(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", FR.mask_fragmented(F.col("text"), MaskRules(), DEMO_KEY).alias("masked"))


def stitch_pages(spark, sf_dir) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return FS.stitch_pages(conv, doc="conv_id", page="turn", text="text") \
             .select(F.col("conv_id"), F.col("text"))


def escape_pages(spark, sf_dir) -> DataFrame:
    """2.9, M15: every page escaped for display, and decoded again from that."""
    shown = html_escape(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", shown.alias("shown"), html_unescape(shown).alias("html"))


def latin1_text(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", FS.latin1(F.col("text")).alias("text"))


# ---------------------------------------------------------------------------
# Classifier (C1-C11) and table masking
# ---------------------------------------------------------------------------

CLASSIFY_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "events",
                   "pages", "conversations", "benchmark", "documents", "lineitem"]


def classify_columns(spark, sf_dir) -> DataFrame:
    """C1-C11 over every string column of twelve tables in one sampling job."""
    return C.classify_tables({t: table(spark, sf_dir, t) for t in CLASSIFY_TABLES})


def identity_table(spark, sf_dir) -> DataFrame:
    """Customers with identifiers of every shape, built from their keys."""
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad((x % 10 ** n).cast("string"), n, "0")
    lat = F.concat(F.lit("-"), (k % 89).cast("string"), F.lit("."), pad(k * 37, 6))
    letter = lambda m: F.substr(F.lit("ABCDEFGHJK"), (k * m % 10 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", cpf_source(k).alias("nr_documento"), F.concat(F.lit("user"), k, F.lit("@example.com")).alias("contato"),
        F.concat(letter(1), letter(3), letter(7), pad(k, 1), letter(9), pad(k * 31, 2)).alias("veiculo"),
        lat.alias("posicao"), F.concat(F.lit("01/02/20"), pad(k, 2)).alias("quando"), "c_mktsegment", "c_acctbal")


def classify_identities(spark, sf_dir) -> DataFrame:
    """Columns whose values, not names, decide the policy."""
    return C.classify_columns(identity_table(spark, sf_dir), table="customer")


def demo_lexicon(spark: SparkSession) -> DataFrame:
    """Stand-in dictionary of names (term): the engine's own two lists."""
    return spark.createDataFrame([(n,) for n in [*S.FIRST_NAMES, *S.LAST_NAMES]], "term string")


def _name(words: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))


def named_person(k: Column) -> Column:
    """A person's name per key, in title case, some with a particle."""
    first, last = _name(S.FIRST_NAMES, k * 7 + 3), _name(S.LAST_NAMES, k * 11 + 5)
    return F.concat(F.initcap(first), F.when(k % 3 == 0, F.lit(" de ")).otherwise(F.lit(" ")), F.initcap(last))


def classify_names(spark, sf_dir) -> DataFrame:
    """Columns of names found by a dictionary, beside prose that holds names
    and columns that hold none."""
    k = F.col("c_custkey")
    src = table(spark, sf_dir, "customer").select(
        named_person(k).alias("titular"), _name(S.FIRST_NAMES, k).alias("apelido"),
        F.concat(named_person(k), F.lit(" comprou "), k, F.lit(" itens na loja")).alias("relato"),
        F.concat(F.lit("rua "), k).alias("local"), "c_mktsegment")
    return C.classify_columns(src, table="customer", lexicon=demo_lexicon(spark))


def lexicon_names(spark, sf_dir) -> DataFrame:
    """Names of a dictionary with their places, in every document; each
    text also ends with a sentence that names two persons."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.coalesce("text", F.lit("")), F.lit(" Relato de "), named_person(k), F.lit(", e "), F.upper(named_person(k * 5 + 1)),
        F.lit(" (presente).")).alias("text"))
    return L.recognise_names(docs, ["doc_id"], "text", demo_lexicon(spark))


def trim_candidates(spark, sf_dir) -> DataFrame:
    """The first 60 characters of every document as a candidate, without
    leading prepositions and articles, up to a verb, number or mark."""
    raw = F.substring("text", 1, 60)
    return (table(spark, sf_dir, "documents").where("text is not null")
            .select("doc_id", L.trim_candidate(F.concat(F.lit("da "), raw)).alias("t"))
            .select("doc_id", "t.value", "t.skip"))


def mask_identities(spark, sf_dir) -> DataFrame:
    """D24 by classified policy: documents, e-mails and plates are swapped,
    dates and segments stay."""
    src = identity_table(spark, sf_dir).drop("posicao")
    pol = C.policy_map(C.classify_columns(src, table="customer"), "customer")
    return mask_table(spread(src), pol, MaskRules(), DEMO_KEY)


def mask_customer(spark, sf_dir) -> DataFrame:
    c = heavy(spark, sf_dir, "customer", "c_custkey")
    pol = C.policy_map(C.classify_columns(c, table="customer"))
    return mask_table(spread(c), pol, MaskRules(), DEMO_KEY)


# ---------------------------------------------------------------------------
# Catalogue, referential checks, sinks
# ---------------------------------------------------------------------------

def column_catalogue(spark, sf_dir) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in TABLES}
    return CAT.column_catalogue(spark, frames, allow=["customer", "orders", "lineitem", "part",
                                                      "documents", "events"],
                                ignored=["orders.o_comment", "customer.c_acctbal"])


TPCH_FKS = [
    ("lineitem", "orders", "l_orderkey", "o_orderkey"),
    ("lineitem", "part", "l_partkey", "p_partkey"),
    ("lineitem", "supplier", "l_suppkey", "s_suppkey"),
    ("orders", "customer", "o_custkey", "c_custkey"),
    ("customer", "nation", "c_nationkey", "n_nationkey"),
    ("supplier", "nation", "s_nationkey", "n_nationkey"),
    ("nation", "region", "n_regionkey", "r_regionkey"),
    ("nation", "nation", "n_nationkey", "n_nationkey"),        # self-edge: dropped (J5)
    ("labels", "documents", "doc_id", "doc_id"),
]


def fk_orphans(spark, sf_dir) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in TABLES}
    edges = CAT.fk_edges(spark, TPCH_FKS, selected=list(frames))
    return CAT.orphan_counts(frames, edges)


def fk_orphans_masked(spark, sf_dir) -> DataFrame:
    """J6 + J7 on masked keys, one of two columns: orders whose customer has no
    account balance above zero, documents without labels, and (part, supplier)
    pairs that no first line of an order holds.  lineitem is read once as child."""
    def mask(df: DataFrame, cols: list[str]) -> DataFrame:
        # a mask hangs on its key alone: each key is masked once, its mask joined to all rows that hold it
        tasks = -(-df.count() // KEYS_PER_TASK)
        rows = df.select(*cols)
        for c in cols:
            keys = rows.select(F.col(c).alias("_key")).where("_key is not null").distinct().repartition(max(1, tasks))
            masks = S.add_surrogates(keys.select("_key", cpf_source(F.col("_key")).alias("_mask")), {"_mask": ("CPF", "_mask")}, DEMO_KEY)
            rows = rows.join(masks, F.col(c) == F.col("_key"), "left").withColumn(c, F.col("_mask")).drop("_key", "_mask")
        return rows

    line = table(spark, sf_dir, "lineitem")
    frames = {"orders": mask(table(spark, sf_dir, "orders"), ["o_custkey"]),
              "solvent": mask(table(spark, sf_dir, "customer").where("c_acctbal > 0"), ["c_custkey"]),
              "documents": mask(table(spark, sf_dir, "documents"), ["doc_id"]),
              "labels": mask(table(spark, sf_dir, "labels"), ["doc_id"]),
              "lineitem": mask(line, ["l_partkey", "l_suppkey"]),
              "first_lines": mask(line.where("l_linenumber = 1"), ["l_partkey", "l_suppkey"])}
    pair = ["l_partkey", "l_suppkey"]
    edges = CAT.fk_edges(spark, [("orders", "solvent", "o_custkey", "c_custkey"), ("documents", "labels", "doc_id", "doc_id"),
                                 ("lineitem", "first_lines", pair, pair)], list(frames))
    return CAT.orphan_counts(frames, edges)


def quarantine_split(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    accepted, rejected = FS.split_rejects(p, max_lengths={"p_name": 11, "p_type": 7},
                                          required=["p_brand"])
    return (accepted.select("p_partkey", F.lit("accepted").alias("status"), F.lit("").alias("reason"))
            .unionByName(rejected.select("p_partkey", F.lit("quarantine").alias("status"), "reason")))


def fit_length(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return FS.fit_lengths(p, {"p_name": 10, "p_type": 6})


def csv_roundtrip(spark, sf_dir) -> DataFrame:
    """S4 + K7: all documents written as CSV (texts with line breaks, quotes and
    separators) and read back in parallel."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("\r\n", "text", F.lit('"fim", ;\n')).alias("text"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sombra-csv/{uuid.uuid4().hex}"
    FS.write_csv(docs, path)
    back = FS.read_csv(spark, path, ",")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")


def direct_copy(spark, sf_dir) -> DataFrame:
    from ..operators.mask import direct_copy as copy
    o = table(spark, sf_dir, "orders")
    return copy(o)


# ---------------------------------------------------------------------------
# Audit and run log
# ---------------------------------------------------------------------------

def audit_email(spark, sf_dir) -> DataFrame:
    d = heavy(spark, sf_dir, "documents", "doc_id")
    return A.audit_summary(d, "text", MaskRules.only("EMAIL"), DEMO_KEY)


def audit_identities(spark, sf_dir) -> DataFrame:
    """A3 + A4 with identities in them: a report per customer that names a person
    (trusted context) and that person's CPF, and blank ones."""
    k = F.col("c_custkey")
    text = F.when(k % 10 == 0, F.lit("  ")).otherwise(F.concat(
        F.lit("Corpo de "), named_person(k), F.lit(". CPF "), cpf_source(k), F.lit("; fim.")))
    # strict: 17 letters in a row ("de Renata de Andrade") are no vehicle number
    return A.audit_summary(spread(table(spark, sf_dir, "customer").select("c_custkey")).select(text.alias("text")), "text", MaskRules(strict=True), DEMO_KEY)


def audit_by_type(spark, sf_dir) -> DataFrame:
    d = heavy(spark, sf_dir, "documents", "doc_id")
    return A.audit_by_type(d, "text", MaskRules(names=False), DEMO_KEY)


def run_speed_30(spark, sf_dir) -> DataFrame:
    """Mean of the last 30 values per user, and its parts (an exact decimal
    sum and the number of rows); the mean is sum / n, so it does not hinge on
    the order of float additions.  Blocks are short, so users span several."""
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("decimal(18,2)"))
    out = A.moving_window(e, partition="user_id", order=["ts", "event_id"], value="v", window=30, block=256)
    mean = F.col("sum_30").cast("double") / F.col("n_30")
    return out.select("event_id", "user_id", "sum_30", "n_30", mean.alias("mean_30"))


def mask_orders_cpf(spark, sf_dir) -> DataFrame:
    """D24 with direct-swap policies: each order carries its customer's CPF
    (derived from the key); ``mask_table`` swaps it by policy, keeps the
    status as is (IGNORAR) and leaves non-string columns untouched."""
    o = spread(heavy(spark, sf_dir, "orders", "o_orderkey"))
    src = o.withColumn("cpf", cpf_source(F.col("o_custkey")))
    return mask_table(src, {"cpf": "CPF", "o_orderstatus": "IGNORAR", "o_orderpriority": "IGNORAR"}, MaskRules(), DEMO_KEY)


def table_counts(spark, sf_dir) -> DataFrame:
    """A1 + A2: rows per table and the total over all of them."""
    per = None
    for t in TABLES:
        one = table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")) \
                                      .select(F.lit(t).alias("table_name"), "n_rows")
        per = one if per is None else per.unionByName(one)
    total = per.agg(F.sum("n_rows").alias("n_rows")).select(F.lit("*").alias("table_name"), "n_rows")
    return per.unionByName(total)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "find_email": _detector_query("EMAIL"),
    "find_cpf": _detector_query("CPF"),
    "find_ip": _detector_query("IP"),
    "find_rg": _detector_query("RG"),
    "find_coord": _detector_query("COORD"),
    "find_coord_single": _detector_query("COORD_SINGLE"),
    "find_datetime": _detector_query("DATE_TIME"),
    "find_phone": _detector_query("PHONE"),
    "find_plate": _detector_query("PLATE"),
    "find_chassi": _detector_query("CHASSI"),
    "find_all_pii": find_all_pii,
    "seed_customer": seed_customer,
    "mask_cpf": _mask_values("CPF", cpf_source),
    "mask_rg": _mask_values("RG", cpf_source),
    "mask_plate": _mask_values("PLATE", cpf_source),
    "mask_phone": _mask_values("PHONE", cpf_source),
    "mask_ipv4": _mask_values("IP", cpf_source),
    "mask_vin": _mask_values("CHASSI", cpf_source),
    "mask_email": _mask_values("EMAIL", cpf_source),
    "mask_word": _mask_values("OTHER", cpf_source),
    "mask_person": mask_person,
    "jitter_coord": jitter_coord,
    "masked_join": masked_join,
    "mask_documents_email": mask_documents_email,
    "mask_pages_email": mask_pages_email,
    "mask_documents": mask_documents,
    "strip_shield_roundtrip": strip_shield_roundtrip,
    "candidate_terms": candidate_terms,
    "upper_runs": upper_runs,
    "name_verdict_semi": name_verdict_semi,
    "name_trusted_anti": name_trusted_anti,
    "name_verdict_docs": name_verdict_docs,
    "mask_documents_verdict": mask_documents_verdict,
    "mask_collisions": mask_collisions,
    "fragment_text": fragment_text,
    "mask_long_documents": mask_long_documents,
    "stitch_pages": stitch_pages,
    "escape_pages": escape_pages,
    "latin1_text": latin1_text,
    "classify_columns": classify_columns,
    "mask_customer": mask_customer,
    "classify_identities": classify_identities,
    "classify_names": classify_names,
    "lexicon_names": lexicon_names,
    "trim_candidates": trim_candidates,
    "mask_identities": mask_identities,
    "column_catalogue": column_catalogue,
    "fk_orphans": fk_orphans,
    "fk_orphans_masked": fk_orphans_masked,
    "quarantine_split": quarantine_split,
    "fit_length": fit_length,
    "csv_roundtrip": csv_roundtrip,
    "direct_copy": direct_copy,
    "audit_email": audit_email,
    "audit_by_type": audit_by_type,
    "audit_identities": audit_identities,
    "mask_shapes": mask_shapes,
    "run_speed_30": run_speed_30,
    "table_counts": table_counts,
    "mask_orders_cpf": mask_orders_cpf,
}
