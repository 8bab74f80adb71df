"""Property tests on random text, evaluated in one batch."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sombra.functions import patterns as P
from sombra.operators.fragments import fragments
from sombra.operators.mask import MaskRules, mask_text
from sombra.operators.spans import regex_spans, restore, shield, shield_tags

ALPHABET = st.sampled_from(list("ab Z9<>/&;.-@\n\t") + ["é", "ção", "🙂", "", "  ", "123.456", "<b>", "</p>"])
TEXT = st.lists(ALPHABET, max_size=40).map("".join)
TEXTS = st.lists(TEXT, min_size=1, max_size=25)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(TEXTS)
def test_shield_restore_and_fragments_identity(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    out = df.select("t", restore(shield(t), shield_tags(t)).alias("r"),
                    F.array_join(fragments(t, 20), "").alias("f")).collect()
    for r in out:
        assert r.r == r.t and r.f == r.t


@SETTINGS
@given(TEXTS)
def test_offsets_agree_with_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pats = {tag: re.compile(getattr(P, tag)) for tag in ["CPF", "IP", "COORD_SINGLE", "EMAIL"]}
    cols = [regex_spans(F.col("t"), P.DETECTORS[tag].pattern, tag, 0).alias(tag) for tag in pats]
    for r in df.select("t", *cols).collect():
        for tag, p in pats.items():
            got = [(s.start, s.end, s.value) for s in r[tag]]
            assert got == [(m.start(), m.end(), m.group()) for m in p.finditer(r.t)], (tag, r.t)


@SETTINGS
@given(TEXTS)
def test_masking_is_deterministic_and_keeps_nulls(spark, key, texts):
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    m = df.select("t", mask_text(F.col("t"), MaskRules(), key).alias("m"))
    a = sorted(map(tuple, m.collect()), key=str)
    b = sorted(map(tuple, m.repartition(3).collect()), key=str)
    assert a == b
    for t, masked in a:
        if t is None or not t.strip():
            assert masked == t
