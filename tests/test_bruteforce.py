"""Queries without a DuckDB oracle, checked against brute force in Python's
``re`` (the semantics the patterns were written for) over the whole sf0.001
documents table."""

import re
import unicodedata

import pytest

from sombra.functions import patterns as P
from sombra.plans import registry as R

SF = "/root/testdata/sf0.001"
ORDER = ["CPF", "IP", "RG", "EMAIL", "PLATE", "PHONE", "CHASSI", "COORD", "COORD_SINGLE"]


def py_pattern(java: str) -> re.Pattern:
    flags = 0
    for prefix, f in (("(?iuU)", re.I), ("(?d)", 0), ("(?U)", 0)):
        while java.startswith(prefix):
            java, flags = java[len(prefix):], flags | f
    return re.compile(java, flags)


RAW = {t: re.compile(getattr(P, t), re.I if t in P.NOCASE_TAGS else 0) for t in ORDER}


def norm(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).upper().strip()


STOP = re.compile(r"\b(?:" + "|".join(P.STOP_WORDS) + r")\b", re.I)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("tag", ["PHONE", "PLATE", "CHASSI", "CPF"])
def test_single_detector(spark, docs, tag):
    got = rows(R.QUERIES["find_" + tag.lower()](spark, SF), ["doc_id", "start", "end", "value"])
    want = sorted((d, m.start(), m.end(), m.group()) for d, t in docs.items() if t
                  for m in RAW[tag].finditer(t))
    assert got == want


def test_all_detectors_with_overlaps(spark, docs):
    got = rows(R.QUERIES["find_all_pii"](spark, SF), ["doc_id", "start", "end", "type", "value"])
    want = []
    for d, t in docs.items():
        if not t or not t.strip():
            continue
        found = [(m.start(), m.end(), m.group(), tag) for tag in ORDER for m in RAW[tag].finditer(t)]
        found.sort(key=lambda x: (x[0], -(x[1] - x[0])))          # stable: detector order breaks ties
        last = -1
        for s, e, v, tag in found:
            if s >= last:
                want.append((d, s, e, tag, v))
                last = e
    assert got == sorted(want)


def name_candidates(t: str):
    trusted_p = py_pattern(P.trusted_context_pattern())
    role_p = py_pattern(P.role_context_pattern())
    run_p = py_pattern(P.upper_run_pattern())
    keep = lambda v: len(v) >= 3 and not STOP.search(norm(v))
    trusted = [m.group(2) for m in trusted_p.finditer(t) if keep(m.group(2))]
    sus = [(m.start(2), m.group(2)) for m in role_p.finditer(t) if keep(m.group(2))]
    sus += [(m.start(), m.group()) for m in run_p.finditer(t) if keep(m.group())]
    return trusted, sus


def test_upper_runs_and_roles(spark, docs):
    got = rows(R.QUERIES["upper_runs"](spark, SF), ["doc_id", "start", "value"])
    want = sorted((d, s, v) for d, t in docs.items() if t for s, v in name_candidates(t)[1])
    assert got == want


def test_candidate_terms(spark, docs):
    conv = [r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    want = set()
    for t in list(docs.values()) + conv:
        if not t:
            continue
        trusted, sus = name_candidates(t)
        want |= {v.upper() for _, v in sus if v not in trusted and len(v.split()) >= 2}
    got = {r.term_key for r in R.QUERIES["candidate_terms"](spark, SF).collect()}
    assert got == want


def test_mask_documents_hides_findings(spark, docs):
    masked = {r.doc_id: r.masked for r in R.QUERIES["mask_documents"](spark, SF).collect()}
    assert set(masked) == set(docs)
    for d, t in docs.items():
        if not t:
            continue
        for tag in ("EMAIL", "IP", "CPF"):
            for m in RAW[tag].finditer(t):
                if len(m.group()) > 8:
                    assert m.group() not in masked[d], (d, tag)


def test_name_trusted_anti_and_verdicts(spark, docs):
    got = rows(R.QUERIES["name_trusted_anti"](spark, SF), ["doc_id", "start", "value"])
    want = []
    for d, t in docs.items():
        if not t:
            continue
        trusted, sus = name_candidates(t)
        want += [(d, s, v) for s, v in sus if v not in trusted and len(v.split()) >= 2]
    assert got == sorted(want)
    approved = {r.term_key for r in R.QUERIES["name_verdict_semi"](spark, SF).collect()}
    cands = {r.term_key for r in R.QUERIES["candidate_terms"](spark, SF).collect()}
    assert approved == {c for c in cands if 2 <= len(c.split()) <= 4 and all(w.isalpha() for w in c.split())}


def test_audit_by_type(spark, docs):
    per = {}
    for d, t in docs.items():
        if not t or not t.strip():
            continue
        found = [(m.start(), m.end(), m.group(), tag) for tag in ORDER for m in RAW[tag].finditer(t)]
        found.sort(key=lambda x: (x[0], -(x[1] - x[0])))
        last = -1
        for s, e, v, tag in found:
            if s >= last:
                spans, cells, values = per.setdefault(tag, [0, set(), set()])
                per[tag][0] += 1
                cells.add(d)
                values.add(v)
                last = e
    want = sorted((tag, n, len(c), len(v)) for tag, (n, c, v) in per.items())
    got = rows(R.QUERIES["audit_by_type"](spark, SF), ["type", "n_spans", "n_cells", "n_distinct"])
    assert got == want
