"""Sources and sinks: CSV, text files, pages, JDBC through embedded Derby."""

import os
import tempfile

from pyspark.sql import functions as F

from sombra.plans import catalog as CAT
from sombra.plans.database import copy_database, plan_tables
from sombra.sources import files as FS
from sombra.sources import jdbc as J


def scratch():
    return tempfile.mkdtemp(prefix="sombra-test-")


def test_csv_sniff_and_all_string(spark):
    d = scratch()
    p = os.path.join(d, "a.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("id;cpf;nome\n001;123.456.789-01;Ana\n002;987.654.321-00;Bia\n")
    assert FS.sniff_separator(spark, p) == ";"
    df = FS.read_csv(spark, p)
    assert df.columns == ["id", "cpf", "nome"] and df.first()["id"] == "001"
    q = os.path.join(d, "b.csv")
    with open(q, "w", encoding="utf-8") as f:
        f.write("x\ty\n1\t2\n")
    assert FS.csv_header_union(spark, [p, q]) == ["cpf", "id", "nome", "x", "y"]


def test_text_files_quarantine_invalid_utf8(spark):
    d = scratch()
    with open(os.path.join(d, "ok.txt"), "wb") as f:
        f.write("olá a@b.com".encode("utf-8"))
    with open(os.path.join(d, "bad.txt"), "wb") as f:
        f.write(b"\xff\xfe bad")
    good, bad = FS.read_text_files(spark, d)
    assert [os.path.basename(r.path) for r in good.collect()] == ["ok.txt"]
    assert [os.path.basename(r.path) for r in bad.collect()] == ["bad.txt"]


def test_output_name_latin1_and_stitch(spark):
    df = spark.createDataFrame([("/x/y/relatorio.final.pdf", "a€b🙂")], "p string, t string")
    r = df.select(FS.output_name(F.col("p"), "txt").alias("n"), FS.latin1(F.col("t")).alias("l")).first()
    assert r.n == "SEGURO_relatorio.final.txt" and r.l == "a?b?"
    pages = spark.createDataFrame([(1, 2, "dois"), (1, 1, "um"), (1, 3, ""), (2, 1, "x")],
                                  "doc_id int, page int, text string")
    got = {r.doc_id: r.text for r in FS.stitch_pages(pages).collect()}
    assert got == {1: "um\n\ndois\n\n", 2: "x\n\n"}


def test_rejects_and_fit(spark):
    df = spark.createDataFrame([(1, "curto", "a"), (2, "comprido demais", "b"), (3, "ok", None)],
                               "id int, nome string, req string")
    acc, rej = FS.split_rejects(df, {"nome": 8}, ["req"])
    assert sorted(r.id for r in acc.collect()) == [1]
    rows = {r.id: r for r in rej.collect()}
    assert set(rows) == {2, 3} and len(rows[2].signature) == 8
    assert FS.fit_lengths(df, {"nome": 4}).filter("id = 2").first().nome == "comp"


def test_jdbc_derby_roundtrip_and_copy(spark, key):
    src = J.build_url("derby", db="src_test")
    dst = J.build_url("derby", db=J.target_database("src_test"))
    people = spark.createDataFrame(
        [(i, f"user{i}@example.com", f"{i:03d}.456.789-01", f"Texto {i}. Com frase e mais palavras")
         for i in range(40)], "id int, email string, cpf string, obs string")
    J.clone_structure(people, src, "APP.PEOPLE")
    J.append(people, src, "APP.PEOPLE")
    J.clone_structure(people, dst, "APP.PEOPLE")
    assert "APP" in J.list_schemas(spark, src)
    assert J.table_exists(spark, src, "APP", "PEOPLE")
    back = J.read_table(spark, src, "APP.PEOPLE", partition_column="id", num_partitions=4)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 40
    log = copy_database(spark, src, dst, "APP", key)
    assert log.first()["rows_done"] == 40
    out = J.read_table(spark, dst, "APP.PEOPLE")
    joined = out.join(back.select("ID", F.col("EMAIL").alias("E0")), "ID")
    assert joined.filter(F.col("EMAIL") == F.col("E0")).count() == 0
    assert J.batch_size(4) == 7500


def test_fk_edges_and_orphans(spark):
    frames = {"p": spark.createDataFrame([(1,), (2,)], "k int"),
              "c": spark.createDataFrame([(1,), (3,), (None,)], "pk int")}
    edges = CAT.fk_edges(spark, [("c", "p", "pk", "k"), ("p", "p", "k", "k"), ("c", "zz", "pk", "k")],
                         selected=["p", "c"])
    assert edges.count() == 1
    assert CAT.orphan_counts(frames, edges).first()["orphans"] == 1


def test_copy_mode_is_identity(spark, key):
    df = spark.createDataFrame([(1, "a@b.com")], "id int, e string")
    out, pol = plan_tables({"t": df}, mode="copy")
    assert pol is None and out["t"].collect() == df.collect()


def test_duplicate_keys_rejected(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    acc, rej = FS.split_rejects(df, unique_key=["id"])
    assert sorted(r.id for r in acc.collect()) == [1, 2]
    assert [(r.id, r.reason) for r in rej.collect()] == [(1, "duplicate key")]
    assert acc.columns == ["id", "v"]


def test_mask_csv_job(spark, key):
    from sombra.plans.database import mask_csv_files
    d = scratch()
    src = os.path.join(d, "in.csv")
    with open(src, "w", encoding="utf-8") as f:
        f.write("id;email;obs\n")
        for i in range(30):
            f.write(f"{i:03d};user{i}@example.com;Texto {i}. Com frase\n")
    out_dir = os.path.join(d, "out")
    mask_csv_files(spark, src, out_dir, key, ignored=["id"])
    out = spark.read.option("header", True).csv(out_dir)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 30 and "000" in rows
    assert all("@example.com" in r.email and not r.email.startswith("user") for r in rows.values())


def test_urls_and_temporal_text(spark):
    assert J.build_url("postgresql", "h", 5432, "db") == "jdbc:postgresql://h:5432/db"
    assert J.build_url("mysql", "h", 3306, "db").startswith("jdbc:mysql://h:3306/db")
    assert J.build_url("mssql", "h", 1433, "db", trusted=True).endswith(";integratedSecurity=true")
    assert J.target_database("prod") == "prod_anon" and J.target_database("prod", "x") == "x"
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(3)
    t = J.temporal_to_text(o)
    assert dict(t.dtypes)["o_orderdate"] == "string" and dict(t.dtypes)["o_totalprice"] == "double"
