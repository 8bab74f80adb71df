"""Detector table (FIXTURES B1): expected spans after overlap resolution."""

import csv
import os
from collections import defaultdict

from pyspark.sql import functions as F

from sombra.functions import patterns as P
from sombra.operators.mask import MaskRules, find_pii
from sombra.operators.spans import regex_spans

HERE = os.path.dirname(os.path.abspath(__file__))


def load_cases():
    cases, expect = {}, defaultdict(list)
    with open(os.path.join(HERE, "fixtures", "spans.csv"), newline="") as f:
        for r in csv.DictReader(f):
            cases[r["case_id"]] = r["text"]
            if r["type"]:
                expect[r["case_id"]].append((int(r["start"]), int(r["end"]), r["value"], r["type"]))
    return cases, expect


def test_fixture_spans(spark):
    cases, expect = load_cases()
    df = spark.createDataFrame(list(cases.items()), "case_id string, text string")
    got = {r.case_id: [(s.start, s.end, s.value, s.type) for s in r.spans]
           for r in df.select("case_id", find_pii(F.col("text")).alias("spans")).collect()}
    for cid in cases:
        assert got[cid] == expect.get(cid, []), cid


def test_strict_profile(spark):
    df = spark.createDataFrame([("la auxch de eau entre",), ("9BWZZZ377VT004251",)], "text string")
    got = [len(r.s) for r in df.select(find_pii(F.col("text"), MaskRules(strict=True)).alias("s")).collect()]
    assert got == [0, 1]


def test_role_context_needs_verdict(spark):
    df = spark.createDataFrame([("vítima: Carlos Exemplo",)], "text string")
    none = df.select(find_pii(F.col("text")).alias("s")).first().s
    assert none == []
    approved = df.select(find_pii(F.col("text"), approved_terms=F.array(F.lit("CARLOS EXEMPLO"))).alias("s")).first().s
    assert [(s.start, s.end, s.value) for s in approved] == [(8, 22, "Carlos Exemplo")]


def test_offsets_with_accents_and_emoji(spark):
    text = "Olá 🙂 ça e-mail: zé.x@example.com e IP 10.0.0.1"
    df = spark.createDataFrame([(text,)], "text string")
    spans = df.select(find_pii(F.col("text"), MaskRules(names=False)).alias("s")).first().s
    for s in spans:
        assert text[s.start:s.end] == s.value


def test_single_detector_matches_python_semantics(spark):
    import re
    texts = ["a 123.456.789-01 b 98765432100 c", "1.2.3.4 5.6.7.8", "x 12345678 y 1234567890123"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for tag in ["CPF", "IP", "RG", "COORD_SINGLE", "DATE_TIME"]:
        py = re.compile(getattr(P, tag))
        rows = df.select(regex_spans(F.col("text"), P.DETECTORS[tag].pattern, tag, 0).alias("s")).collect()
        for t, r in zip(texts, rows):
            assert [(s.start, s.end) for s in r.s] == [(m.start(), m.end()) for m in py.finditer(t)], (tag, t)
