"""Stage functions of the corpus pipeline (see corpus_pipeline.py).

Each takes (spark, docs, sf_dir) and works on every row of ``docs``: a null
text is the empty text, empty and very long texts are documents like others,
repeated rows are rows of their own (but one of a group of copies), null ids
stay null, an empty table gives no rows, and further columns, whatever their
names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, packing, pii, toxicity
from .common import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels table, does not
    call toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the
    document with the smallest id.  Exact repeats of a row stay once; rows
    without an id cannot be told apart and stay."""
    groups = jaccard.jaccard_components(docs, k=5, pct=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).union(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by kind marks; n_chars
    follows the new text where there is such a column."""
    out = pii.redact(docs, pii.train(docs))
    if "n_chars" not in docs.columns:
        return out
    return (out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
                        .cast(docs.schema["n_chars"].dataType)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return (packing.pack(docs)
            .select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                    "sequence_id", "offset"))
