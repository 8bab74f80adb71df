"""The corpus pipeline: toxicity, near-duplicate join, personal data, packing.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sombra.llm import pipeline as P
from sombra.llm.common import materialise, read

STAGES = [
    ("toxicity", P.drop_toxic),
    ("ngram_join", P.one_of_each_group),
    ("pii", P.mask_personal_data),
    ("packing", P.pack_sequences),
]

# No stage can be stated in SQL from end to end (trained models); tests hold
# each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
