"""Surrogate properties: determinism, keyed, shapes, CPF check digits."""

import re

from pyspark.sql import functions as F

from sombra.functions import hashing as H
from sombra.functions import surrogates as S
from sombra.functions.hashing import MaskKey


def cpf_valid(cpf: str) -> bool:
    d = [int(c) for c in re.sub(r"\D", "", cpf)]
    if len(d) != 11:
        return False
    for n in (9, 10):
        s = sum(d[i] * (n + 1 - i) for i in range(n))
        r = s % 11
        if d[n] != (0 if r < 2 else 11 - r):
            return False
    return True


def test_hmac_matches_python(spark, key):
    df = spark.createDataFrame([("JOÃO SILVA",), ("x",)], "m string")
    got = [r.h for r in df.select(H.hmac_hex(F.col("m"), key).alias("h")).collect()]
    assert got == [key.hmac_hex("JOÃO SILVA"), key.hmac_hex("x")]
    long_key = MaskKey(b"k" * 100)
    assert df.select(H.hmac_hex(F.col("m"), long_key)).first()[0] == long_key.hmac_hex("JOÃO SILVA")


def test_shapes_and_determinism(spark, key):
    vals = [f"{i:011d}" for i in range(0, 3000, 7)]
    df = spark.createDataFrame([(v,) for v in vals], "v string").repartition(5)
    out = df.select("v", *[S.surrogate_for(t, F.col("v"), key).alias(t)
                           for t in ["CPF", "RG", "PLATE", "PHONE", "IP", "CHASSI", "EMAIL", "PER", "OTHER"]])
    rows = out.collect()
    again = {r.v: r.CPF for r in out.coalesce(1).collect()}
    for r in rows:
        assert cpf_valid(r.CPF) and re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d{2}", r.CPF)
        assert re.fullmatch(r"\d{2}\.\d{3}\.\d{3}-\d", r.RG)
        assert re.fullmatch(r"[A-Z]{3}-\d{4}|[A-Z]{3}\d[A-Z]\d{2}", r.PLATE)
        assert re.fullmatch(r"\(\d{2}\) 9\d{4}-\d{4}", r.PHONE)
        assert all(0 <= int(x) <= 255 for x in r.IP.split(".")) and r.IP.count(".") == 3
        assert re.fullmatch(r"[A-HJ-NPR-Z0-9]{17}", r.CHASSI)
        assert r.EMAIL.endswith("@example.com") and r.EMAIL == r.EMAIL.lower()
        assert re.fullmatch(r"[A-Z]+ [A-Z]+", r.PER)
        assert again[r.v] == r.CPF


def test_keyed_and_normalised(spark, key):
    df = spark.createDataFrame([("João da Silva",), ("JOAO DA SILVA",), ("  joão   da silva ",)], "v string")
    a = [r[0] for r in df.select(S.surrogate_for("PER", F.col("v"), key)).collect()]
    assert len(set(a)) == 1
    b = df.select(S.surrogate_for("PER", F.col("v"), MaskKey(b"other"))).first()[0]
    c = df.select(S.surrogate_for("NOME_SOLTO", F.col("v"), key)).first()[0]
    assert c == a[0]
    da = df.select(S.digest(F.col("v"), "PER", key)).first()[0]
    db = df.select(S.digest(F.col("v"), "PER", MaskKey(b"other"))).first()[0]
    assert da != db


def test_surname_differs_from_real(spark, key):
    names = [f"Pessoa{i} {s}" for i, s in enumerate(S.LAST_NAMES * 20)]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    for r in df.select("v", S.surrogate_for("PER", F.col("v"), key).alias("m")).collect():
        assert r.m.split()[-1] != r.v.upper().split()[-1]


def test_jitter_moves_every_coordinate(spark, key):
    df = spark.createDataFrame([("-25.4284,-49.2733",), ("12.345",), ("lat 1,2345 lon 3.4567",)], "v string")
    for r in df.select("v", S.surrogate_for("COORD", F.col("v"), key).alias("m")).collect():
        a = [float(x.replace(",", ".")) for x in re.findall(r"-?\d{1,3}[.,]\d{3,}", r.v)]
        b = [float(x) for x in re.findall(r"-?\d{1,3}\.\d{6}", r.m)]
        assert len(a) == len(b)
        assert all(abs(x - y) <= 0.0030001 for x, y in zip(a, b))
        assert r.m != r.v


def test_staged_path_equals_column_path(spark, key):
    vals = [f"{i:011d}" for i in range(0, 500, 3)] + ["João  Silva", "-25.4284,-49.2733", "  ", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    tags = ["CPF", "RG", "PLATE", "PHONE", "IP", "CHASSI", "EMAIL", "NOME_SOLTO", "COORD", "OTHER"]
    staged = S.add_surrogates(df.select("v", *[F.col("v").alias(t) for t in tags]),
                              {t: (t, t) for t in tags}, key)
    from sombra.functions.text import is_blank
    direct = df.select("v", *[F.when(is_blank(F.col("v")), F.col("v"))
                              .otherwise(S.surrogate_for(t, F.col("v"), key)).alias(t) for t in tags])
    assert sorted(map(tuple, staged.collect()), key=str) == sorted(map(tuple, direct.collect()), key=str)


def test_byte_array_decodes_digest(spark):
    import hashlib
    hs = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(100)]
    df = spark.createDataFrame([(h,) for h in hs], "h string")
    got = [r.b for r in df.select(S.byte_array(F.col("h")).alias("b")).collect()]
    assert got == [list(bytes.fromhex(h)) for h in hs]
