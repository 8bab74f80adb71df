"""Driver contract and a few oracle comparisons at sf0.001."""

import duckdb

import __spark_entry__ as E
from sombra.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "masked"]
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def test_some_oracles_match(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["find_email", "find_ip", "find_rg", "mask_cpf", "mask_person", "mask_documents_email",
                 "fk_orphans", "stitch_pages"]:
        sdf = E.queries()[name](spark, SF)
        res = con.execute(E.oracle_sql()[name])
        dcols = [d[0] for d in res.description]
        assert sorted(sdf.columns) == sorted(dcols), name
        assert _rows([tuple(r) for r in sdf.collect()], sdf.columns) == _rows(res.fetchall(), dcols), name
