"""Rows that must not be lost, values that must not stay in clear."""

import time

import pytest
from pyspark.sql import functions as F

from sombra.functions.text import normalize
from sombra.operators import audit as A
from sombra.operators import classify as C
from sombra.operators.mask import MaskRules, find_pii, mask_table, mask_text, mask_with_verdicts
from sombra.plans import database as D
from sombra.sources import files as FS


def write(path, text):
    path.write_text(text, encoding="utf-8")


def test_csv_files_of_any_header_order_and_separator(spark, tmp_path):
    write(tmp_path / "a.csv", "id,nome,cpf\n1,Ana,529.982.247-25\n2,Rui\n")
    write(tmp_path / "b.csv", "nome;id;cpf;obs\nBia;3;111.444.777-35;x\n")
    write(tmp_path / "c.csv", 'id,nome,cpf\n4,"Silva, Eva",1\n5,Zé,2,extra\n')
    good, bad = FS.read_csv_checked(spark, str(tmp_path))
    rows = {r.id: (r.nome, r.cpf, r.obs) for r in good.collect()}
    assert rows == {"1": ("Ana", "529.982.247-25", None), "2": ("Rui", None, None), "3": ("Bia", "111.444.777-35", "x"),
                    "4": ("Silva, Eva", "1", None)}
    assert good.count() == 4
    assert [r.line for r in bad.collect()] == ["5,Zé,2,extra"]
    assert FS.csv_header_union(spark, [str(tmp_path)]) == ["cpf", "id", "nome", "obs"]


def test_csv_job_needs_a_place_for_long_rows(spark, key, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "a.csv", "id,cpf\n1,529.982.247-25\n2,111.444.777-35,more\n")
    with pytest.raises(ValueError):
        D.mask_csv_files(spark, str(src), str(tmp_path / "o1"), key)
    D.mask_csv_files(spark, str(src), str(tmp_path / "o2"), key, quarantine_path=str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1
    out = spark.read.option("header", True).csv(str(tmp_path / "o2")).collect()
    assert len(out) == 1 and out[0].cpf != "529.982.247-25"


def test_text_files_are_masked_under_their_names(spark, key, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "um.txt", "mail a@b.com")
    (src / "mau.txt").write_bytes(b"\xff\xfe\x00bad")
    D.mask_text_files(spark, str(src), str(tmp_path / "out"), key, quarantine_path=str(tmp_path / "q"))
    out = spark.read.text(str(tmp_path / "out")).collect()
    assert [r.name for r in out] == ["SEGURO_um.txt"] and "a@b.com" not in out[0].value
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_policies(spark, key):
    df = spark.createDataFrame([("ABC-9", "a@b.com", "joao&#64;example.com")], "codigo string, mail string, obs string")
    row = mask_table(df, {"codigo": "GENERIC_CODE", "mail": "EMAIL", "obs": "TEXTO_LIVRE"}, None, key).first()
    assert row.codigo != "ABC-9" and row.mail != "a@b.com"
    assert "joao@example.com" not in row.obs and "joao&#64;" not in row.obs
    with pytest.raises(ValueError):
        mask_table(df, {"codigo": "NO_SUCH"}, None, key)
    two = spark.createDataFrame([("t", "mail", "EMAIL"), ("u", "mail", "IGNORAR")], "table string, column string, tag string")
    with pytest.raises(ValueError):
        mask_table(df, two, None, key)
    assert mask_table(df, two, None, key, table="t").first().mail != "a@b.com"


def test_digits_beyond_ascii_are_seen(spark, key):
    wide = "".join(chr(0xFF10 + int(c)) for c in "52998224725")
    df = spark.createDataFrame([("doc " + wide,)], "t string")
    assert wide not in df.select(mask_text(F.col("t"), None, key).alias("m")).first().m


def test_latitude_with_six_decimals_is_a_coordinate(spark):
    df = spark.createDataFrame([(f"-23.5{i:05d}",) for i in range(60)], "x string")
    assert C.classify_columns(df).first().tag == "COORD_SINGLE"


def test_accents_by_themselves_fold(spark):
    df = spark.createDataFrame([("JOSÉ",), ("JOSÉ",)], "t string")
    assert {r.n for r in df.select(normalize(F.col("t")).alias("n")).collect()} == {"JOSE"}


def test_offsets_are_those_of_the_text(spark):
    texts = ["<b>x</b> a@b.com", "<i>é</i><b>y</b> c@d.com e@f.com", " a@b.com", "a@b.com"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", find_pii(F.col("t"), MaskRules.only("EMAIL")).alias("s")).collect():
        assert r.s and all(r.t[s.start:s.end] == s.value for s in r.s)


def test_cells_are_counted_by_row(spark):
    df = spark.createDataFrame([("a@b.com c@d.com",)] * 3, "t string")
    row = A.audit_by_type(df, "t", MaskRules.only("EMAIL")).first()
    assert (row.n_spans, row.n_cells, row.n_distinct) == (6, 3, 2)


def test_audit_is_one_pass(spark, key):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = A.audit_summary(df, "text", MaskRules.only("EMAIL"), key)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_free_text_columns_share_one_expression(spark, key):
    df = spark.createDataFrame([("a@b.com",) * 10], ", ".join(f"c{i} string" for i in range(10)))
    first = mask_table(df.select("c0"), {}, None, key)
    assert first.first().c0 != "a@b.com"
    t0 = time.time()
    mask_table(df.select("c0"), {}, None, key)
    one = time.time() - t0
    t0 = time.time()
    out = mask_table(df, {}, None, key)
    ten = time.time() - t0
    assert ten < 3 * one + 1
    assert len(set(out.first())) == 1 and out.first().c3 == first.first().c0


def test_verdicts_reach_the_mask(spark, key):
    df = spark.createDataFrame([(1, "vítima: MARIA SOUZA LIMA."), (2, "vítima: CARLOS PRADO NETO."), (3, None)], "id long, t string")
    verdicts = spark.createDataFrame([("MARIA SOUZA LIMA", True), ("CARLOS PRADO NETO", False)], "term_key string, is_person boolean")
    got = {r.id: r.t for r in mask_with_verdicts(df, "id", "t", verdicts, None, key).collect()}
    assert "MARIA SOUZA LIMA" not in got[1] and got[2] == "vítima: CARLOS PRADO NETO." and got[3] is None


def test_valid_cpfs_never_share_a_mask(spark, key):
    from sombra.functions.surrogates import add_surrogates
    from sombra.plans.registry import cpf_source

    src = spark.range(200_000).select(cpf_source(F.col("id")).alias("k"))
    out = add_surrogates(src, {"m": ("CPF", "k")}, key)
    assert out.select("m").distinct().count() == 200_000
