"""Exact regex spans on the JVM, overlap resolution and splicing.

Spans (D1-D10, D19, D20) are found without Python: every match is wrapped in
two private-use marks with ``regexp_replace`` (which scans the original text,
so look-behinds see the real neighbours), the result is split on the open
mark, and a fold over the pieces turns their lengths into start offsets.
Offsets are 0-based code points with an exclusive end, like Python slices.

Marks already present in the input are escaped first (``escape_marks``) and
put back at the very end (``unescape_marks``), so user text cannot forge one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.expr import let
from ..functions.text import MARK_CLOSE, MARK_OPEN, MARK_SAFE, MARK_TAG

SPAN = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("value", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("prio", T.IntegerType()),
])
SPANS = T.ArrayType(SPAN)
SPAN_FAKE = T.StructType(SPAN.fields + [T.StructField("fake", T.StringType())])
SPANS_FAKE = T.ArrayType(SPAN_FAKE)

_ESC = {MARK_SAFE: "\ue010", MARK_OPEN: "\ue011", MARK_CLOSE: "\ue012", MARK_TAG: "\ue013"}
_ANY_MARK = "[" + MARK_OPEN + "-" + MARK_SAFE + "]"


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def escape_marks(text: Column) -> Column:
    """Each mark character in the input becomes MARK_SAFE + a code."""
    out = text
    for ch, code in _ESC.items():          # MARK_SAFE first, so codes stay unique
        out = F.replace(out, F.lit(ch), F.lit(MARK_SAFE + code))
    return F.when(text.rlike(_ANY_MARK), out).otherwise(text)


def unescape_marks(text: Column) -> Column:
    out = text
    for ch, code in reversed(list(_ESC.items())):   # MARK_SAFE last
        out = F.replace(out, F.lit(MARK_SAFE + code), F.lit(ch))
    return F.when(text.contains(MARK_SAFE), out).otherwise(text)


def regex_spans(text: Column, pattern: str | Column, tag: str, prio: int, group: bool = False,
                marks_checked: bool = False) -> Column:
    """All non-overlapping matches of ``pattern`` as spans, in text order.

    With ``group=True`` the pattern has two groups, (context)(target), and the
    span covers the target only (D11, D12).  Unless the caller already
    escaped the marks (``marks_checked``), a text holding one is matched with
    a same-width stand-in and its span values are read back from the text.
    """
    if not marks_checked:
        has_mark = text.rlike("[" + MARK_OPEN + MARK_CLOSE + "]")
        stand_in = F.translate(text, MARK_OPEN + MARK_CLOSE, MARK_SAFE + MARK_SAFE)
        raw = regex_spans(stand_in, pattern, tag, prio, group, marks_checked=True)
        exact = F.transform(raw, lambda s: s.withField(
            "value", F.substr(text, s["start"] + 1, s["end"] - s["start"])))
        return F.when(has_mark, exact).otherwise(
            regex_spans(text, pattern, tag, prio, group, marks_checked=True))
    repl = ("$1" + MARK_OPEN + "$2" + MARK_CLOSE) if group else (MARK_OPEN + "$0" + MARK_CLOSE)

    def from_parts(parts: Column) -> Column:
        first_len = F.length(F.element_at(parts, 1))
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        zero = F.struct(first_len.cast("int").alias("pos"), empty_spans().alias("out"))

        def step(acc: Column, p: Column) -> Column:
            v = F.substring_index(p, MARK_CLOSE, 1)
            start = acc["pos"]
            span = F.struct(start.alias("start"), (start + F.length(v)).cast("int").alias("end"),
                            v.alias("value"), F.lit(tag).alias("type"), F.lit(prio).alias("prio"))
            return F.struct((start + F.length(p) - 1).cast("int").alias("pos"),
                            F.concat(acc["out"], F.array(span)).alias("out"))

        found = F.aggregate(rest, zero, step, lambda acc: acc["out"])
        # cheap skip: no match, no fold
        return F.when(F.size(parts) > 1, found).otherwise(empty_spans())

    # the marked-and-split text is bound once: one regex pass per detector
    pat = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return let(F.split(F.regexp_replace(text, pat, F.lit(repl)), MARK_OPEN), from_parts)


def _compare(l: Column, r: Column) -> Column:
    ll, rl = l["end"] - l["start"], r["end"] - r["start"]
    return (F.when(l["start"] < r["start"], -1).when(l["start"] > r["start"], 1)
            .when(ll > rl, -1).when(ll < rl, 1)
            .when(l["prio"] < r["prio"], -1).when(l["prio"] > r["prio"], 1)
            .otherwise(0))


def resolve_overlaps(spans: Column) -> Column:
    """Order by start, then longest, then detector priority; keep a span
    only if it starts at or after the end of the last kept one."""
    ordered = F.array_sort(spans, _compare)
    zero = F.struct(F.lit(-1).alias("last"), empty_spans().alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] >= acc["last"],
                      F.struct(s["end"].alias("last"),
                               F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)

    return F.aggregate(ordered, zero, step, lambda acc: acc["kept"])


def splice(text: Column, spans: Column, fake_field: str = "fake") -> Column:
    """Untouched slices of ``text`` interleaved with each span's fake.

    ``spans`` must be ordered and non-overlapping.  Built as one array of
    pieces and one ``array_join`` (linear), not a string fold.
    """
    def prev_end(i: Column) -> Column:
        return F.when(i == 0, F.lit(0)).otherwise(
            F.try_element_at(spans, F.greatest(i, F.lit(1)))["end"])

    def piece(s: Column, i: Column) -> Column:
        pe = prev_end(i)
        return F.concat(F.substr(text, pe + 1, s["start"] - pe), s[fake_field])

    last_end = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    body = F.array_join(F.transform(spans, piece), "")
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(body, F.substr(text, last_end + 1, F.length(text))))


# ---------------------------------------------------------------------------
# Markup shield
# ---------------------------------------------------------------------------

def shield_tags(text: Column) -> Column:
    """Markup tags of ``text`` in order (array<string>); no '<', no scan."""
    return F.when(text.contains("<"), F.regexp_extract_all(text, F.lit(P.TAG_PATTERN), 0)) \
            .otherwise(F.array().cast("array<string>"))


def shield(text: Column) -> Column:
    """Each tag becomes `` MARK_TAG `` so detectors see a word break there and
    never match inside markup."""
    return F.when(text.contains("<"), F.regexp_replace(text, P.TAG_PATTERN, " " + MARK_TAG + " ")) \
            .otherwise(text)


def restore(masked: Column, tags: Column) -> Column:
    """Put the tags back in order; the spaces the shield added are removed
    when they are still next to the mark."""
    parts = F.split(masked, " " + MARK_TAG + " |" + MARK_TAG)
    joined = F.array_join(F.zip_with(parts, tags, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return F.when(F.size(tags) == 0, masked).otherwise(joined)
