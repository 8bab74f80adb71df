"""String helpers as Catalyst expressions (M1, M2, M15, P7, word counts).

Every function takes and returns a ``Column`` so it can be used at the top
level of a ``select`` or inside a higher-order-function lambda.
"""

from __future__ import annotations

import html
import html.entities
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .expr import let

# Private-use marks.  They are stripped from (or swapped in) the input before
# any of them is used as a sentinel, so user text can never forge one.
MARK_OPEN = "\ue000"
MARK_CLOSE = "\ue001"
MARK_TAG = "\ue002"
MARK_SAFE = "\ue00f"            # stands in for a mark found in the input
MARKS_CLASS = "[\ue000-\ue002]"


def py_strip(c: Column) -> Column:
    """``str.strip()``: Unicode whitespace at both ends (Spark's trim only drops ' ').
    The regex runs only when the first or last character is whitespace."""
    edge = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(edge.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def is_blank(c: Column) -> Column:
    """Null or only whitespace (P7).  Stops at the first non-space character."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def word_count(c: Column) -> Column:
    """``len(s.split())``."""
    s = py_strip(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+")))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Translate table built by rule: every Latin letter whose NFKD form is one
    base letter plus combining marks maps to that base letter."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(c: Column) -> Column:
    src, dst = _accent_table()
    # letters composed with a mark, then marks that stand by themselves
    return F.regexp_replace(F.translate(c, src, dst), r"\p{M}+", "")


def normalize(c: Column) -> Column:
    """M1: drop accents, upper-case, strip.  Null stays null."""
    return py_strip(F.upper(strip_accents(c)))


def remove_tags(c: Column) -> Column:
    return F.regexp_replace(c, P.TAG_PATTERN, "")


# References as the HTML 5 rules read them, from the standard library's table:
# numeric ones with or without ";", names up to 32 characters, of which the
# longest known beginning counts where the whole is unknown.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


ROW = "\x01"


def _as_text(table: dict[str, str]) -> str:
    """A lookup table as one string: one literal, however long, keeps the plan
    small, where a map literal is hashed and compared by every optimizer rule."""
    return ROW + "".join(f"{k}={v}{ROW}" for k, v in sorted(table.items()))


def _look_up(table: str, name: Column) -> Column:
    """The value of a name in such a table, null if it has none."""
    key = F.concat(F.lit(ROW), name, F.lit("="))
    return let(F.instr(F.lit(table), key), lambda at: F.when((at > 0) & ~name.contains("="), F.substring_index(
        F.substr(F.lit(table), at + F.length(key), F.lit(8)), ROW, 1)))


@lru_cache(maxsize=1)
def _entity_names() -> tuple[str, str]:
    """(the table as one text, pattern of the names that need no ";", longest
    first)."""
    bare = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return _as_text(html.entities.html5), "^(?:" + "|".join(bare) + ")"


@lru_cache(maxsize=1)
def _code_points() -> tuple[str, list[int]]:
    """(replacements of invalid numbers as one text, numbers that stand for
    nothing), found by asking the standard library."""
    moved, gone = {}, []
    for n in [*range(0, 0xA0), *range(0xFDD0, 0xFDF0), *(p * 0x10000 + k for p in range(17) for k in (0xFFFE, 0xFFFF))]:
        got = html.unescape(f"&#{n};")
        if got == "":
            gone.append(n)
        elif got != chr(n):
            moved[str(n)] = got
    return _as_text(moved), gone


def _codepoint_char(n: Column) -> Column:
    # U+FEFF would be read as a byte order mark
    return F.when(n == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def html_unescape(c: Column) -> Column:
    """M15 on the JVM: equal to ``html.unescape``.

    References are wrapped in marks, the text is split on the open mark, and each
    piece's reference is decoded; unknown names are kept as written.
    """
    table, bare = _entity_names()
    moved, gone = _code_points()
    def number(name: Column) -> Column:
        hexadecimal = name.rlike("^#[xX]")
        digits = F.regexp_replace(F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
        # more digits than any code point has: out of range
        value = F.when(F.length(digits) > 9, F.lit(0x110000)).when(
            hexadecimal, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.cast("bigint"))
        # only control characters are replaced by the table
        return let(value, lambda n: F.when(n.between(0x20, 0x7E), F.chr(n)).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
                   .when(n < 0xA0, F.coalesce(_look_up(moved, n.cast("string")), F.when(n.isin(gone), F.lit("")), _codepoint_char(n)))
                   .when(n.isin(gone), F.lit("")).otherwise(_codepoint_char(n)))

    def named(name: Column) -> Column:
        start = F.regexp_extract(name, bare, 0)
        usual = None                 # most references are one of these: no search through the table
        for n in ("amp;", "lt;", "gt;", "quot;", "nbsp;"):
            usual = (F if usual is None else usual).when(name == n, F.lit(html.entities.html5[n]))
        return F.coalesce(usual, _look_up(table, name), F.when(start != "", F.concat(
            _look_up(table, start), F.substr(name, F.length(start) + 1))), F.concat(F.lit("&"), name))

    def decode(p: Column, i: Column) -> Column:
        name = F.substring_index(p, MARK_CLOSE, 1)
        tail = F.substring_index(p, MARK_CLOSE, -1)
        return F.when(i == 0, p).otherwise(F.concat(F.when(name.startswith("#"), number(name)).otherwise(named(name)), tail))

    def decoded(text: Column) -> Column:
        parts = F.split(F.regexp_replace(text, REFERENCE, MARK_OPEN + "$1" + MARK_CLOSE), MARK_OPEN)
        return F.array_join(F.transform(parts, decode), "")
    # no '&' -> nothing to do; text that already holds a mark is left as is
    return F.when(~c.contains("&") | c.rlike(MARKS_CLASS), c).otherwise(decoded(c))


def html_escape(c: Column) -> Column:
    """SURVEY 2.9: text made safe to show as markup, quotes included."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def clean_value(c: Column) -> Column:
    """M2: tags removed, entities decoded, stripped."""
    return py_strip(html_unescape(remove_tags(c)))
