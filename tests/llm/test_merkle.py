import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sombra.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i:i + 8]) for i in range(0, len(low), 8)])
    return levels


def way_up(levels, i):
    out = []
    for low in levels[:-1]:
        s = i - i % 8
        out.append((i - s, low[s:i] + low[i + 1:s + 8]))
        i //= 8
    return out


def brute(rows):
    def leaf(r, text):
        return digest(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf(r, r["text"]), r))
    trees = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(groups[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, levels_of([x[1] for x in leaves])))
    crown = levels_of([t[1][-1][0] for t in trees])
    out = []
    for k, (leaves, levels) in enumerate(trees):
        for i, (d, own, r) in enumerate(leaves):
            path = way_up(levels, i) + way_up(crown, k)
            node, text = own, r["text"]
            if d is not None and text is not None and zlib.crc32(str(d).encode()) % 3 == 0:
                node = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            for place, sib in path:
                node = digest(*sib[:place], node, *sib[place:])
            out.append((d, own, levels[-1][0], crown[-1][0], digest(*[x for _, s in path for x in s]), node,
                        node == crown[-1][0]))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(df):
    got = merkle.manifest(df)
    assert got.columns == COLUMNS
    assert ordered(got.collect()) == ordered(brute([r.asDict() for r in df.collect()]))


def test_odd_rows(odd_docs):
    check(odd_docs.withColumn("source", F.lit("s")).withColumn("pos", F.lit("x")).withColumn("tree", F.lit(1)))
    check(odd_docs.withColumn("source", F.col("text")).withColumn("lang", F.when(F.col("doc_id") > 5, "").otherwise(None)))


def test_empty_and_single(odd_docs, no_docs):
    assert merkle.manifest(no_docs.withColumn("source", F.lit("s"))).collect() == []
    check(odd_docs.withColumn("source", F.lit("s")).where("doc_id = 1"))


def test_many_groups_and_a_hot_one(spark):
    docs = spark.range(1, 1400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("s").alias("source"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 83).cast("string"))).alias("lang"),
        F.col("id").alias("n_chars"))
    check(docs)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 512, 513])
def test_heights(spark, n):
    got = spark.range(1).select(merkle.height(F.lit(n)).alias("h")).first().h
    assert got == len(levels_of(["x"] * n)) - 1
    nodes = [str(i) for i in range(min(n, 512))]
    levels = merkle.regenerate(nodes, len(levels_of(nodes)) - 1)
    assert levels == levels_of(nodes)
    for i in (0, len(nodes) - 1):
        assert merkle.fold(nodes[i], merkle.siblings(levels, i)) == levels[-1][0]


def test_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
