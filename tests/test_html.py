"""References decoded exactly as html.unescape does."""

import html
import html.entities

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sombra.functions.text import html_escape, html_unescape

PIECES = ["&", "#", "x", "X", "1", "9", "f", ";", " ", "amp", "lt", "notin", "not", "copy", "AMP", "&#", "&#x", "0", "80",
          "\n", "é", "a", "Afr;", "&nbsp", "&NotEqualTilde;", "&#128;", "&#xD800;", "&#0;", "&#x1F600;", "&#99999999999;",
          "&#xFFFFFFFFFFFF", "&#65", "&#x41g", "&#11;", "&#xFFFE;", "<", "\t&lt", "&unknown;", "&amp;lt;", "&#0000000065;"]


def same(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html_unescape(F.col("t")).alias("u"))
    for r in df.collect():
        assert r.u == (None if r.t is None else html.unescape(r.t)), r


def test_every_name_whole_and_as_a_beginning(spark):
    names = list(html.entities.html5)
    same(spark, ["&" + n for n in names] + ["&" + n.rstrip(";") + "z" for n in names] + ["&" + n.rstrip(";") for n in names] + [None, ""])


def test_numbers(spark):
    numbers = [*range(0, 0x200), *range(0xD7F0, 0xD810), *range(0xDFF0, 0xE010), *range(0xFDC0, 0x10010), 0x1FFFE, 0x10FFFF, 0x110000]
    same(spark, [f"&#{n};" for n in numbers] + [f"&#x{n:x}" for n in numbers] + [f"&#X{n:X};" for n in numbers[:40]])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=10).map("".join), min_size=200, max_size=400))
def test_mixed_texts(spark, texts):
    same(spark, texts)


def test_escape(spark):
    texts = ["", "a < b & \"c\" > 'd'", "&amp;", "é", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html_escape(F.col("t")).alias("u"))
    assert all(r.u == (None if r.t is None else html.escape(r.t)) for r in df.collect())
