"""Long-text fragmenter (D22): split after newline runs, close a fragment at a
newline once it is longer than 1,000 characters, mask each fragment on its
own, and join them back in order.

All of it is one expression per row (``split`` + ``aggregate`` +
``transform``): a document never leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import MaskKey
from .mask import mask_text

FRAGMENT_CHARS = 1000


def fragments(text: Column, limit: int = FRAGMENT_CHARS) -> Column:
    """array<string>; concatenating it gives ``text`` back."""
    pieces = F.split(text, r"(?<=\n)(?!\n)")
    zero = F.struct(F.array().cast(T.ArrayType(T.StringType())).alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        cur = F.concat(acc["cur"], p)
        close = (F.length(cur) > limit) & p.contains("\n")
        return F.when(close, F.struct(F.concat(acc["done"], F.array(cur)).alias("done"),
                                      F.lit("").alias("cur"))) \
                .otherwise(F.struct(acc["done"].alias("done"), cur.alias("cur")))

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))

    return F.when(text.isNull(), F.lit(None).cast(T.ArrayType(T.StringType()))) \
            .otherwise(F.aggregate(pieces, zero, step, finish))


def mask_fragmented(text: Column, rules=None, key: MaskKey = None,
                    limit: int = FRAGMENT_CHARS) -> Column:
    """D22 + D23: each fragment masked independently, concatenated in order."""
    masked = F.array_join(F.transform(fragments(text, limit), lambda f: mask_text(f, rules, key)), "")
    return F.when(text.isNull(), text).otherwise(masked)
