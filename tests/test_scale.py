"""Heavy per-row work is dealt over tasks by rows, whatever the files' splits."""

import pytest
from pyspark.sql import functions as F

from sombra.functions import surrogates as S
from sombra.operators import lexicon as L
from sombra.operators.mask import MaskRules, mask_with_verdicts
from sombra.plans import registry as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def one_split(spark, tmp_path_factory):
    """45 customers in one file of one row group; tasks take 20 rows in these tests."""
    d = tmp_path_factory.mktemp("one_split")
    rows = [(k, f"Customer#{k}", k % 25, 1.0 * k, "BUILDING") for k in range(45)]
    (spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
     .coalesce(1).write.parquet(f"{d}/customer.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["audit_identities", "mask_shapes", "mask_email", "mask_vin", "mask_ipv4", "mask_phone",
                                  "mask_rg", "mask_plate", "mask_cpf", "mask_word", "mask_person", "seed_customer"])
def test_masks_of_one_row_group_take_several_tasks(spark, one_split, monkeypatch, name):
    whole = R.QUERIES[name](spark, one_split)
    before = sorted(map(str, whole.collect()))
    monkeypatch.setattr(R, "ROWS_PER_TASK", 20)
    dealt = R.QUERIES[name](spark, one_split)
    assert "RoundRobinPartitioning(3)" in plan(dealt) and sorted(map(str, dealt.collect())) == before


@pytest.mark.parametrize("name", ["mask_ipv4", "mask_phone", "mask_rg", "mask_plate", "mask_vin", "mask_email", "mask_word",
                                  "mask_person", "jitter_coord"])
def test_a_value_is_digested_once(spark, one_split, tmp_path, name):
    """One HMAC (two hashes) a row, by the columns' own expressions."""
    spark.createDataFrame([(7,), (None,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    q = R.QUERIES[name](spark, str(tmp_path) if name == "jitter_coord" else one_split)
    assert plan(q).count("sha2(") == 2


def test_digest_bytes_are_cut_from_one_digest(spark, key):
    df = spark.createDataFrame([("1.2.3.4",), (None,), (" ",)], "v string")
    assert plan(df.select(S.surrogate_for("IP", F.col("v"), key).alias("m"))).count("sha2(") == 2


@pytest.mark.parametrize("tag", [*S.MASKABLE_TYPES, "OTHER"])
def test_column_path_gives_blanks_what_the_expression_gives(spark, key, tag):
    df = spark.createDataFrame([("x",), ("12.345.678-9",), ("-25.4284,-49.2733",), (None,), ("",), (" ",)], "v string")
    got = S.add_surrogates(df, {"m": (tag, "v")}, key, keep_blank=False).collect()
    assert got == df.select("v", S.surrogate_for(tag, F.col("v"), key).alias("m")).collect()


def test_verdict_masks_are_dealt_by_texts(spark, key, monkeypatch):
    from sombra.operators import mask as M
    monkeypatch.setattr(M, "TEXTS_PER_TASK", 10)
    docs = spark.createDataFrame([(i, f"texto {i}") for i in range(45)] + [(None, None)], "doc_id long, text string")
    verdicts = spark.createDataFrame([("ANA LIMA", True)], "term_key string, is_person boolean")
    out = mask_with_verdicts(docs, "doc_id", "text", verdicts, MaskRules(), key)
    assert out.rdd.getNumPartitions() == 5 and out.count() == 46


def test_names_are_cut_from_a_text_once(spark):
    lex = spark.createDataFrame([("ana",), ("de",), ("lima",)], "term string")
    df = spark.createDataFrame([(1, "Ana de Lima e Rui, Ana"), (2, None)], "doc_id long, text string")
    hits = L.name_hits(df, ["doc_id"], "text", lex)
    assert plan(hits).count("Generate posexplode") == 1
    # "de" is a term here and a particle too
    assert sorted((r["at"], r["n"], r["start"], r["end"]) for r in hits.collect()) == [
        (0, 1, 0, 3), (1, 0, 4, 6), (1, 1, 4, 6), (2, 1, 7, 11), (3, 0, 12, 13), (6, 1, 19, 22)]


def test_each_key_of_a_reference_is_masked_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(S, "add_surrogates", lambda df, *a, real=S.add_surrogates, **kw: made.append(df) or real(df, *a, **kw))
    tables = {"orders": ("o_custkey long", [(1,), (1,), (2,), (None,), (9,)]), "customer": ("c_custkey long, c_acctbal double", [(1, 5.0), (2, -1.0), (1, 7.0)]),
              "documents": ("doc_id long", [(1,), (2,), (None,)]), "labels": ("doc_id long", [(2,), (2,)]),
              "lineitem": ("l_partkey long, l_suppkey long, l_linenumber int", [(1, 1, 1), (1, 2, 2), (1, 2, 3), (None, 1, 2), (2, 2, 1)])}
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    out = {r["child"]: r["orphans"] for r in R.fk_orphans_masked(spark, str(tmp_path)).collect()}
    assert out == {"orders": 2, "documents": 1, "lineitem": 2}
    assert made and all(df.count() == df.select("_key").distinct().count() for df in made)
