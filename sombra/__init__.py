"""sombra: find and mask personal data in tables, text and streams with Spark."""

from .functions.hashing import MaskKey
from .functions.surrogates import add_surrogates, surrogate_for
from .operators.classify import classify_columns, classify_tables, policy_map
from .operators.mask import MaskRules, find_pii, mask_table, mask_text, mask_text_struct

__all__ = ["MaskKey", "MaskRules", "add_surrogates", "classify_columns", "classify_tables",
           "find_pii", "mask_table", "mask_text", "mask_text_struct", "policy_map",
           "surrogate_for"]
