"""S1 without a numeric key, S11 keys, K1 exactly once (embedded Derby)."""

import pytest
from pyspark.sql import functions as F

from sombra.plans import catalog as CAT
from sombra.sources import jdbc as J


@pytest.fixture(scope="module")
def db(spark):
    url = J.build_url("derby", db="keys_test")
    ddl = ["CREATE TABLE APP.PESSOA (CPF VARCHAR(14) NOT NULL, UF CHAR(2) NOT NULL, NOME VARCHAR(40), NASC DATE, PRIMARY KEY (UF, CPF))",
           "CREATE TABLE APP.CASO (ID INT NOT NULL PRIMARY KEY, P_CPF VARCHAR(14), P_UF CHAR(2), NOTA VARCHAR(20), "
           "CONSTRAINT CASO_PESSOA FOREIGN KEY (P_UF, P_CPF) REFERENCES APP.PESSOA (UF, CPF))",
           "CREATE TABLE APP.TEXTO (CHAVE VARCHAR(30), V INT)", "CREATE TABLE APP.DIA (D DATE, T VARCHAR(9))",
           "CREATE TABLE APP.VAZIA (K VARCHAR(9))", "CREATE TABLE APP.ALVO (ID INT, NOME VARCHAR(30))"]
    with J.connection(spark, url) as con:
        for x in ddl:
            con.createStatement().executeUpdate(x)
    texts = spark.range(6000).select(
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, F.lit("hot key"))
        .otherwise(F.concat(F.lit("k'"), F.sha1(F.col("id").cast("string")).substr(1, 9))).alias("CHAVE"), F.col("id").cast("int").alias("V"))
    J.load(texts, url, "APP.TEXTO")
    days = spark.range(4000).select(F.expr("date_add(DATE'2020-01-01', cast(id % 900 as int))").alias("D"),
                                    F.col("id").cast("string").alias("T"))
    J.load(days, url, "APP.DIA")
    return url


@pytest.mark.parametrize("table,key", [("APP.TEXTO", None), ("APP.TEXTO", "CHAVE"), ("APP.TEXTO", "v"), ("APP.DIA", None), ("APP.DIA", "T")])
def test_every_row_once_in_several_parts(spark, db, table, key):
    df = J.read_table(spark, db, table, partition_column=key)
    assert df.rdd.getNumPartitions() > 1
    plain = J.query(spark, db, f"SELECT * FROM {table}")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_parts_of_a_text_key_are_balanced_and_exclusive(spark, db, monkeypatch):
    preds = J.text_predicates(spark, db, "APP.TEXTO", "CHAVE", 4, 6000)
    n = [J.query(spark, db, f"SELECT COUNT(*) AS n FROM APP.TEXTO WHERE {p}").first()[0] for p in preds]
    assert len(preds) > 1 and sum(n) == 6000 and max(n) < 4000
    # a database that orders otherwise: the chain of comparisons, still exclusive
    real = J.query
    monkeypatch.setattr(J, "query", lambda s, u, q, p=None: s.createDataFrame([(0, 2)], "lo int, hi int") if "MIN(c)" in q else real(s, u, q, p))
    chain = J.text_predicates(spark, db, "APP.TEXTO", "CHAVE", 4, 6000)
    assert all("CASE" in p for p in chain)
    assert sum(real(spark, db, f"SELECT COUNT(*) AS n FROM APP.TEXTO WHERE {p}").first()[0] for p in chain) == 6000


def test_small_and_empty_tables(spark, db):
    assert J.read_table(spark, db, "APP.VAZIA").collect() == []
    with pytest.raises(ValueError, match="cannot split"):
        J.read_table(spark, db, "APP.TEXTO", partition_column="NADA")


def test_keys_of_several_columns(spark, db):
    info = J.table_info(spark, db, "APP", "CASO")
    assert J.primary_key(spark, db, "APP", "PESSOA") == ["UF", "CPF"] and info["primary_key"] == ["ID"]
    assert info["foreign_keys"] == [{"name": "CASO_PESSOA", "parent": "PESSOA", "child_columns": ["P_UF", "P_CPF"],
                                     "parent_columns": ["UF", "CPF"]}]
    assert info["columns"].fieldNames() == ["ID", "P_CPF", "P_UF", "NOTA"]
    edges = J.fk_edges_from(spark, db, "APP")
    assert [tuple(r) for r in edges.collect()] == [("CASO", "PESSOA", ["P_UF", "P_CPF"], ["UF", "CPF"])]


def test_edges_feed_the_referential_check(spark, db):
    people = spark.createDataFrame([("1", "SP"), ("2", "RJ")], "CPF string, UF string")
    cases = spark.createDataFrame([(1, "1", "SP"), (2, "1", "RJ"), (3, "2", "RJ"), (4, None, "RJ"), (5, "9", "SP")], "ID int, P_CPF string, P_UF string")
    got = CAT.orphan_counts({"CASO": cases, "PESSOA": people}, J.fk_edges_from(spark, db, "APP")).collect()
    assert [(r.child, r.parent, r.child_col, r.orphans) for r in got] == [("CASO", "PESSOA", "P_UF, P_CPF", 2)]


def rows(spark, db):
    return sorted((r.ID, r.NOME) for r in J.query(spark, db, "SELECT * FROM APP.ALVO").collect())


def test_load_adds_each_row_once(spark, db):
    df = spark.range(500).repartition(7).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("nome"))
    before = rows(spark, db)
    assert J.load(df, db, "APP.ALVO") == 500
    assert len(rows(spark, db)) == len(before) + 500
    assert not [t for t in J.list_tables(spark, db, "APP") if "_S" in t]
    with pytest.raises(ValueError, match="no column"):
        J.load(df.withColumn("outra", F.lit(1)), db, "APP.ALVO")


def test_repeated_and_half_written_attempts(spark, db):
    """Partition 0 was written by a task that died half-way, then twice in full
    (the first report was lost); partition 1 once."""
    before = len(rows(spark, db))
    staged = [(i, f"a{i}", 0, 11) for i in range(4)] + [(i, f"a{i}", 0, 15) for i in range(10)] \
        + [(i, f"a{i}", 0, 19) for i in range(10)] + [(100 + i, f"b{i}", 1, 12) for i in range(10)]
    df = spark.createDataFrame(staged, f"id int, nome string, {J.PART} int, {J.ATTEMPT} long")
    df.write.format("jdbc").options(**J._options(db, None)).option("dbtable", "APP.ALVO_S1").save()
    assert J.move_staged(spark, db, "APP.ALVO_S1", "APP.ALVO", ["id", "nome"]) == 20
    assert len(rows(spark, db)) == before + 20


def test_failed_load_leaves_the_target_alone(spark, db):
    before = rows(spark, db)
    bad = spark.range(50).select(F.col("id").cast("int").alias("id"), F.lit("x" * 90).alias("nome"))
    with pytest.raises(Exception):
        J.load(bad, db, "APP.ALVO")
    assert rows(spark, db) == before and not [t for t in J.list_tables(spark, db, "APP") if "_S" in t and t != "ALVO_S1"]
