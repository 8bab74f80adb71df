"""SQL surface.

Masking expressions contain lambdas, which SQL function bodies cannot hold,
so SQL users get the operators as temporary views: the masked table, the
masked text and the findings (one row per finding, the ``inline`` of the
span array — a table function with no Python).
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import MaskKey
from ..operators.mask import MaskRules, find_pii, mask_table, mask_text


def register_masked_table(df: DataFrame, name: str, policies: Mapping[str, str], key: MaskKey,
                          rules=None, targets: list[str] | None = None) -> DataFrame:
    """``SELECT … FROM <name>`` reads the masked table."""
    out = mask_table(df, policies, rules, key, targets=targets)
    out.createOrReplaceTempView(name)
    return out


def register_masked_text(df: DataFrame, name: str, text_col: str, key: MaskKey,
                         rules=None) -> DataFrame:
    """the table with ``text_col`` replaced by its masked form."""
    out = df.withColumn(text_col, mask_text(F.col(text_col), MaskRules.coerce(rules), key))
    out.createOrReplaceTempView(name)
    return out


def register_findings(df: DataFrame, name: str, id_col: str, text_col: str,
                      rules=None) -> DataFrame:
    """``find_pii`` as rows (id, start, end, type, value)."""
    out = (df.select(F.col(id_col), F.inline(find_pii(F.col(text_col), MaskRules.coerce(rules))))
             .select(id_col, "start", "end", "type", "value"))
    out.createOrReplaceTempView(name)
    return out
