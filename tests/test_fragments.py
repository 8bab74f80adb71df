"""Fragmenter (D22) against a direct Python statement of the rule."""

import re

from pyspark.sql import functions as F

from sombra.operators.fragments import fragments, mask_fragmented
from sombra.operators.mask import MaskRules, mask_text


def py_fragments(text: str, limit: int = 1000) -> list[str]:
    out, cur = [], ""
    for block in re.split(r"(\n+)", text):
        cur += block
        if len(cur) > limit and "\n" in block:
            out.append(cur)
            cur = ""
    if cur:
        out.append(cur)
    return out


def test_fragments_match_rule(spark):
    texts = ["a" * 1500, "line\n" * 600, "\n\n\nstart", "x" * 999 + "\n" + "y" * 5,
             ("para " * 150 + "\n\n") * 5, "", "only\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.f for r in df.select(fragments(F.col("t")).alias("f")).collect()]
    for t, g in zip(texts, got):
        assert g == py_fragments(t), t[:20]
        assert "".join(g) == t


def test_documents_fragments_rejoin(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bad = d.filter(F.array_join(fragments(F.col("text")), "") != F.col("text")).count()
    assert bad == 0


def test_mask_fragmented_equals_mask_when_short(spark, key):
    df = spark.createDataFrame([("mail a@b.com\nfim",)], "t string")
    r = df.select(mask_fragmented(F.col("t"), MaskRules(), key).alias("a"),
                  mask_text(F.col("t"), MaskRules(), key).alias("b")).first()
    assert r.a == r.b and "a@b.com" not in r.a
