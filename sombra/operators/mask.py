"""Masking operators: ``mask_text`` (free text) and ``mask_table`` (policies).

Both produce one projection: every cell is rewritten by Catalyst expressions,
partition by partition, with no shuffle and no Python on the row path.
Expensive sub-results (the span array, the shielded text) are bound once with
``_let`` so Catalyst never evaluates them twice.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Mapping

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.expr import let
from ..functions.hashing import MaskKey
from ..functions.surrogates import MASKABLE_TYPES, add_surrogates, surrogate_any, surrogate_for
from ..functions.text import MARK_SAFE, MARK_TAG, html_unescape, is_blank
from . import names as N
from .spans import (SPANS_FAKE, empty_spans, escape_marks, regex_spans, resolve_overlaps, restore,
                    shield, shield_tags, splice, unescape_marks)

IGNORE = "IGNORAR"
FREE_TEXT = "TEXTO_LIVRE"
DIRECT_POLICIES = ["NOME_SOLTO", "COORD", "COORD_SINGLE", "PLACA", "CPF", "RG", "EMAIL",
                   "PLATE", "PHONE", "IP", "CHASSI", "GENERIC_CODE", "DOC_GENERICO"]
TEXT_TYPES = ["CPF", "IP", "RG", "EMAIL", "PLATE", "PHONE", "CHASSI", "COORD", "COORD_SINGLE"]
DIGIT_TYPES = {"CPF", "IP", "RG", "PHONE", "PLATE", "COORD", "COORD_SINGLE"}   # need a digit


@dataclass(frozen=True)
class MaskRules:
    """Per-type switches (P10, P11).  Free text honours them too."""

    cpf: bool = True
    rg: bool = True
    email: bool = True
    plate: bool = True
    phone: bool = True
    ip: bool = True
    chassi: bool = True
    coord: bool = True
    names: bool = True
    strict: bool = False            # VIN needs a digit, upper runs use \p{Lu}
    unknown_names: str = "keep"     # "keep" | "mask": suspects without verdict

    _KEYS = {"CPF": "cpf", "RG": "rg", "EMAIL": "email", "PLATE": "plate", "PLACA": "plate",
             "PHONE": "phone", "IP": "ip", "CHASSI": "chassi", "COORD": "coord",
             "COORD_SINGLE": "coord", "NOME_SOLTO": "names", "PER": "names"}

    @classmethod
    def coerce(cls, rules) -> "MaskRules":
        """A bool switches coordinates only; a dict uses the reference's
        keys (missing = on); None = everything on."""
        if rules is None:
            return cls()
        if isinstance(rules, MaskRules):
            return rules
        if isinstance(rules, bool):
            return cls(coord=rules)
        kw = {}
        for k, v in dict(rules).items():
            name = cls._KEYS.get(str(k).upper())
            if name is not None:
                kw[name] = bool(v) and kw.get(name, True)
            elif k in {f.name for f in fields(cls)}:
                kw[k] = v
        return cls(**kw)

    def on(self, tag: str) -> bool:
        name = self._KEYS.get(tag)
        return True if name is None else bool(getattr(self, name))

    @classmethod
    def only(cls, *tags: str) -> "MaskRules":
        off = {n: False for n in set(cls._KEYS.values())}
        for t in tags:
            off[cls._KEYS[t]] = True
        return cls(**off)


_let = let


def detect_spans(text: Column, rules: MaskRules, approved_terms: Column | None = None,
                 entity_terms: Column | None = None) -> Column:
    """Kept, ordered, non-overlapping spans of ``text``."""
    return _let(text.rlike(r"(?U)\d"), lambda has_digit: _detect(text, rules, approved_terms, entity_terms, has_digit))


def _detect(text: Column, rules: MaskRules, approved_terms: Column | None, entity_terms: Column | None,
            has_digit: Column) -> Column:
    parts = []
    for tag in TEXT_TYPES:
        if not rules.on(tag):
            continue
        d = P.DETECTORS[tag]
        s = regex_spans(text, d.pattern, tag, d.prio, marks_checked=True)   # input escaped
        if tag == "CHASSI" and rules.strict:
            s = F.filter(s, lambda x: x["value"].rlike(r"(?U)\d"))
        if tag in DIGIT_TYPES:
            s = F.when(has_digit, s).otherwise(empty_spans())
        elif tag == "EMAIL":
            s = F.when(text.contains("@"), s).otherwise(empty_spans())
        parts.append(s)
    if rules.names:
        def names_of(tr: Column) -> Column:
            cands = N.suspect_names(text, rules.strict, marks_checked=True)
            if entity_terms is not None:
                cands = F.concat(cands, N.entity_spans(text, entity_terms, marks_checked=True))
            sus = N.approved_suspects(cands, tr, approved_terms,
                                      approve_all=rules.unknown_names == "mask")
            return F.concat(tr, sus)
        parts.append(_let(N.trusted_names(text, marks_checked=True), names_of))
    if not parts:
        return empty_spans()
    return resolve_overlaps(F.concat(*parts) if len(parts) > 1 else parts[0])


def with_fakes(spans: Column, key: MaskKey, rules: MaskRules | None = None) -> Column:
    """Attach the surrogate of each span (field ``fake``); only enabled types
    get a branch, which keeps the expression (and planning) small."""
    rules = rules or MaskRules()
    tags = [t for t in TEXT_TYPES if rules.on(t)] + (["PER"] if rules.names else [])
    return F.transform(spans, lambda s: s.withField("fake", surrogate_any(s["type"], s["value"], key, tags)))


def _mask_shielded(text: Column, rules: MaskRules, key: MaskKey,
                   approved_terms: Column | None, entity_terms: Column | None = None) -> Column:
    """Mask text that is already escaped; returns struct(masked, spans)."""
    def on_shielded(st: Column) -> Column:
        def on_spans(sp: Column) -> Column:
            spliced = splice(st["s"], sp)
            masked = N.propagate(spliced, sp) if rules.names else spliced
            return F.struct(restore(masked, st["tags"]).alias("masked"), sp.alias("spans"),
                            (N.propagated_count(spliced, sp) if rules.names else F.lit(0).cast("bigint"))
                            .alias("extra"))
        return _let(with_fakes(detect_spans(st["s"], rules, approved_terms, entity_terms), key, rules), on_spans)

    return _let(F.struct(shield(text).alias("s"), shield_tags(text).alias("tags")), on_shielded)


def mask_text_struct(text: Column, rules=None, key: MaskKey = None,
                     approved_terms: Column | None = None,
                     entity_terms: Column | None = None) -> Column:
    """struct(masked string, spans array, extra bigint) — masked text plus
    what was found (for audit).  Null/blank text passes through (P7)."""
    if key is None:
        raise ValueError("a MaskKey is required")
    rules = MaskRules.coerce(rules)
    res = _let(escape_marks(text), lambda e: _let(
        _mask_shielded(e, rules, key, approved_terms, entity_terms),
        lambda r: r.withField("masked", unescape_marks(r["masked"]))))
    blank = F.struct(text.alias("masked"), F.array().cast(SPANS_FAKE).alias("spans"),
                     F.lit(0).cast("bigint").alias("extra"))
    return F.when(is_blank(text), blank).otherwise(res)


def mask_text(text: Column, rules=None, key: MaskKey = None,
              approved_terms: Column | None = None,
              entity_terms: Column | None = None) -> Column:
    """Masked free text (string).  ``approved_terms``: upper-case names
    approved by a verdict; ``entity_terms``: names from a recogniser (F1)."""
    return mask_text_struct(text, rules, key, approved_terms, entity_terms)["masked"]


def find_pii(text: Column, rules=None, approved_terms: Column | None = None) -> Column:
    """F4 input: kept spans of ``text`` (markup shielded, nothing replaced);
    offsets are those of the text itself."""
    rules = MaskRules.coerce(rules)

    def located(st: Column) -> Column:
        def move(sp: Column) -> Column:
            before = F.substr(st["s"], F.lit(1), sp["start"])
            count = lambda mark: F.length(before) - F.length(F.replace(before, F.lit(mark), F.lit("")))
            # a tag was three characters wide, an escaped mark two
            tags = F.aggregate(F.slice(st["tags"], 1, count(MARK_TAG)), F.lit(0), lambda a, t: a + F.length(t) - 3)
            shift = (tags - count(MARK_SAFE)).cast("int")
            return sp.withField("start", sp["start"] + shift).withField("end", sp["end"] + shift)
        plain = (F.size(st["tags"]) == 0) & ~st["s"].contains(MARK_SAFE)
        return _let(detect_spans(st["s"], rules, approved_terms),
                    lambda spans: F.when(plain, spans).otherwise(F.transform(spans, move)))
    return _let(escape_marks(text), lambda e: _let(F.struct(shield(e).alias("s"), shield_tags(e).alias("tags")), located))


# ---------------------------------------------------------------------------
# Tables (P5, P6, P9, P10, D24, K12)
# ---------------------------------------------------------------------------

def mask_cell(c: Column, policy: str, rules: MaskRules, key: MaskKey,
              approved_terms: Column | None = None) -> Column:
    """Expression for one cell under its column policy (plan-time choice)."""
    if policy == IGNORE:
        return c
    if policy == FREE_TEXT:
        # entities are decoded first, so that an encoded value is found
        return mask_text(html_unescape(c), rules, key, approved_terms)
    if policy in DIRECT_POLICIES:
        if not rules.on(policy):
            return c
        return F.when(is_blank(c), c).otherwise(surrogate_for(policy, c, key))
    raise ValueError(f"unknown policy {policy!r}")


STAGED = "__sombra_texts"
TEXTS_PER_TASK = 2_000
_ARRAYS: dict[tuple, Column] = {}


def masked_array(rules: MaskRules, key: MaskKey) -> Column:
    """The mask of every text of the array column ``STAGED``.  The free-text
    expression is large; it is built once per session, key and rules and used
    for all free-text columns of all tables."""
    app = SparkContext._active_spark_context.applicationId
    at = (app, rules, key.ipad_hex, key.opad_hex)
    if at not in _ARRAYS:
        _ARRAYS[at] = F.transform(F.col(STAGED), lambda c: mask_cell(c, FREE_TEXT, rules, key))
    return _ARRAYS[at]


def mask_with_verdicts(df: DataFrame, id_col: str, text_col: str, verdicts: DataFrame, rules=None,
                       key: MaskKey = None) -> DataFrame:
    """J3, J4, D18 in the mask: ``df`` with its text masked, names included
    whose term the frame ``verdicts`` (term_key, is_person) approves.

    The terms meet the verdicts in a join, never as a literal or on the driver;
    each row then carries its own few approved terms.  ``id_col`` must be
    unique."""
    if key is None:
        raise ValueError("a MaskKey is required")
    terms = N.approved_row_terms(df, id_col, text_col, verdicts)
    # dealt by rows: texts are masked in the tasks of the join, and partitions
    # that are merged by their size alone would mask too many in one task
    tasks = -(-df.count() // TEXTS_PER_TASK)
    df = df.repartition(tasks, id_col) if tasks > 1 else df
    none = F.array().cast("array<string>")
    joined = df.join(terms, id_col, "left").withColumn("_terms", F.coalesce("_terms", none))
    return joined.select(*[mask_text(F.col(c), rules, key, F.col("_terms")).alias(c) if c == text_col else F.col(f"`{c}`")
                           for c in df.columns])


def mask_table(df: DataFrame, policies: Mapping[str, str] | DataFrame, rules=None,
               key: MaskKey = None, targets: list[str] | None = None,
               numeric_as_text: list[str] | None = None,
               approved_terms: Column | None = None, table: str | None = None) -> DataFrame:
    """One ``select`` that rewrites every target string column.

    ``policies`` maps column -> policy (or is a policy frame with ``column``
    and ``tag``; it has one row per column, so it is collected).  A policy frame
    of several tables needs ``table``, and a column may have one policy only;
    an unknown policy is an error, never a cell left in clear.  Columns
    without a policy default to free text; non-target and non-string columns
    pass through untouched (P5, P6).  ``numeric_as_text`` lists numeric
    columns to cast and mask anyway (SURVEY Q11).
    """
    if key is None:
        raise ValueError("a MaskKey is required")
    rules = MaskRules.coerce(rules)
    if isinstance(policies, DataFrame):
        if table is not None and "table" in policies.columns:
            policies = policies.filter(F.col("table") == table)
        rows = policies.select("column", "tag").collect()
        policies = {r["column"]: r["tag"] for r in rows}
        if len(policies) < len(rows):
            raise ValueError("several policies for a column: pass the table they are meant for")
    wanted = set(df.columns if targets is None else targets)
    cast_cols = set(numeric_as_text or [])
    out, direct, texts = [], {}, {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        is_str = isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))
        if f.name in wanted and (is_str or f.name in cast_cols):
            src = c if is_str else c.cast("string")
            policy = policies.get(f.name, FREE_TEXT)
            if policy in DIRECT_POLICIES and rules.on(policy):
                direct[f.name] = (policy, f.name)       # staged below (codegen path)
                out.append(src.alias(f.name))
            elif policy == FREE_TEXT and approved_terms is None:
                texts[f.name] = len(texts)              # staged below (one expression for all)
                out.append(src.alias(f.name))
            else:
                out.append(mask_cell(src, policy, rules, key, approved_terms).alias(f.name))
        else:
            out.append(c)
    projected = df.select(*out)
    if texts:
        names = projected.columns
        staged = projected.withColumn(STAGED, F.array(*[F.col(f"`{c}`") for c in texts]))
        staged = staged.withColumn(STAGED, masked_array(rules, key))
        projected = staged.select(*[F.element_at(STAGED, texts[c] + 1).alias(c) if c in texts else F.col(f"`{c}`") for c in names])
    return add_surrogates(projected, direct, key) if direct else projected


def direct_copy(df: DataFrame) -> DataFrame:
    """Copy with no masking (identity projection)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns])
