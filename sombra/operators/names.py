"""Person names in free text.

Three regex passes propose names: a trusted context (``corpo de …``, kept
without adjudication), role contexts (``vítima: …``) and upper-case runs.
Candidates shorter than three characters or holding a stop word are dropped.
Role and upper-case candidates ("suspects") are masked only when approved:
either every suspect of two or more words (``unknown="mask"``), or those whose
upper-case term is in a verdict set.

Verdicts come from a DataFrame ``(term_key, is_person)``, from a scorer run
over the *distinct* candidate terms (``adjudicate``), or from nothing
(default: suspects stay, as in the reference without its language model).
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import normalize, word_count
from ..session import ship_package
from .lexicon import trim_spans
from .spans import SPANS, regex_spans

PRIO_TRUSTED = P.SPAN_ORDER.index("PER_TRUSTED")
PRIO_SUSPECT = P.SPAN_ORDER.index("PER")


def _keep_candidate(s: Column) -> Column:
    """At least 3 characters and no stop word in the normal form."""
    return (F.length(s["value"]) >= P.MIN_NAME_CHARS) & \
        ~normalize(s["value"]).rlike(P.stop_words_pattern())


def trusted_names(text: Column, marks_checked: bool = False) -> Column:
    spans = regex_spans(text, P.trusted_context_pattern(), "PER", PRIO_TRUSTED, group=True,
                        marks_checked=marks_checked)
    return F.filter(spans, _keep_candidate)


def suspect_names(text: Column, strict: bool = False, marks_checked: bool = False, trim: bool = False) -> Column:
    """D12, D13 and, with ``trim``, D16 (the baseline only strips)."""
    role = regex_spans(text, P.role_context_pattern(), "PER", PRIO_SUSPECT, group=True,
                       marks_checked=marks_checked)
    run = regex_spans(text, P.upper_run_pattern(strict), "PER", PRIO_SUSPECT,
                      marks_checked=marks_checked)
    found = F.concat(role, run)
    return F.filter(trim_spans(found) if trim else found, _keep_candidate)


def entity_spans(text: Column, terms: Column, marks_checked: bool = False) -> Column:
    """Every occurrence of the recogniser's names in ``text`` (literal,
    case-sensitive), filtered like the other candidates.  They are suspects:
    masked only when approved."""
    usable = F.filter(terms, lambda t: t.isNotNull() & (F.length(t) >= P.MIN_NAME_CHARS)
                      & ~t.rlike(r"\d") & ~t.contains(r"\E"))
    pat = F.concat(F.lit("(?U)"), F.array_join(
        F.transform(usable, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|"))
    found = regex_spans(text, pat, "PER", PRIO_SUSPECT, marks_checked=marks_checked)
    return F.when(F.size(usable) > 0, F.filter(found, _keep_candidate)).otherwise(F.array().cast(SPANS))


def term_key(value: Column) -> Column:
    return F.upper(value)


def approved_suspects(suspects: Column, trusted: Column, approved_terms: Column | None,
                      approve_all: bool) -> Column:
    """J4 then J3: drop suspects already trusted in this text, keep those of
    two or more words whose term is approved."""
    trusted_values = F.transform(trusted, lambda s: s["value"])
    out = F.filter(suspects, lambda s: ~F.array_contains(trusted_values, s["value"])
                   & (word_count(s["value"]) >= P.MIN_NAME_WORDS))
    if approve_all:
        return out
    if approved_terms is None:
        return F.filter(out, lambda s: F.lit(False))
    return F.filter(out, lambda s: F.array_contains(approved_terms, term_key(s["value"])))


def candidate_terms(df: DataFrame, text_col: str, strict: bool = False) -> DataFrame:
    """U3/D18 input: distinct adjudication terms (>= 2 words, not trusted in
    their own text).  Map-side partial distinct, then one small shuffle."""
    t = F.col(text_col)
    tr = trusted_names(t)
    sus = approved_suspects(suspect_names(t, strict), tr, None, approve_all=True)
    return (df.select(F.explode(F.transform(sus, lambda s: term_key(s["value"]))).alias("term_key"))
              .distinct())


def verdict_terms(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates that the verdict frame approves."""
    yes = verdicts.filter(F.col("is_person")).select(F.upper("term_key").alias("term_key"))
    return candidates.join(yes, "term_key", "left_semi")


def approved_row_terms(df: DataFrame, id_col: str, text_col: str, verdicts: DataFrame,
                       strict: bool = False) -> DataFrame:
    """J3 + J4 per row: (id, _terms) the approved terms of each text's suspects.
    Suspects trusted in their own text need no verdict; the others meet the
    verdicts in a semi-join on the term."""
    t = F.col(text_col)
    sus = approved_suspects(suspect_names(t, strict), trusted_names(t), None, approve_all=True)
    seen = df.select(id_col, F.explode(F.array_distinct(F.transform(sus, lambda s: term_key(s["value"])))).alias("term_key"))
    return verdict_terms(seen, verdicts).groupBy(id_col).agg(F.array_sort(F.collect_set("term_key")).alias("_terms"))


def adjudicate(candidates: DataFrame,
               scorer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """F2: run ``scorer`` (terms -> bool) over distinct terms with mapInPandas.

    A scorer failure fails the task (and the job): nothing is approved by
    accident and nothing unmasked is written (SURVEY Q1).
    """
    ship_package(candidates.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = scorer(b["term_key"]).astype(bool).to_numpy()
            yield pd.DataFrame({"term_key": b["term_key"], "is_person": ok})

    return candidates.mapInPandas(run, "term_key string, is_person boolean")


def propagate(spliced: Column, kept_with_fakes: Column) -> Column:
    """Every other case-insensitive, word-bounded mention of a masked
    name of two or more words gets the same surrogate."""
    names = F.filter(kept_with_fakes, lambda s: (s["type"] == "PER")
                     & (word_count(s["value"]) >= P.MIN_NAME_WORDS))

    def step(acc: Column, s: Column) -> Column:
        pat = F.concat(F.lit(r"(?iuU)\b\Q"), s["value"], F.lit(r"\E\b"))
        return F.regexp_replace(acc, pat, s["fake"])

    return F.when(F.size(names) == 0, spliced).otherwise(F.aggregate(names, spliced, step))


def propagated_count(spliced: Column, kept_with_fakes: Column) -> Column:
    """Extra mentions replaced by ``propagate`` (counted apart, SURVEY Q20)."""
    names = F.filter(kept_with_fakes, lambda s: (s["type"] == "PER")
                     & (word_count(s["value"]) >= P.MIN_NAME_WORDS))
    counts = F.transform(names, lambda s: F.regexp_count(
        spliced, F.concat(F.lit(r"(?iuU)\b\Q"), s["value"], F.lit(r"\E\b"))))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
