import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sombra.llm import jaccard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, k, pct):
    """[(doc_id, n, component)] by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else
                    frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, c in common.items():
            if 100 * c >= pct * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted(((d is None, d or 0, len(sets[i]), first.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def families(seed):
    """Copies with few and many edits, shared passages, short texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = r.choices(vocab, k=30)
    rows, at = [], 0
    for f in range(12):
        base = r.choices(vocab, k=r.choice([3, 8, 20, 60, 150]))
        for _ in range(r.choice([1, 2, 5, 30])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                t[r.randrange(len(t))] = r.choice(vocab)
            if f % 3 == 0:
                t = passage + t
            rows.append((at, " ".join(t)))
            at += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_families_against_all_pairs(spark, seed):
    rows = families(seed)
    for k, pct in ((4, 85), (5, 80)) if seed == 1 else ((2, 60),):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(jaccard.jaccard_components(df, k, pct)) == brute(rows, k, pct)


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rows = families(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.jaccard_components(df, 3, 70)) == brute(rows, 3, 70)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(jaccard.jaccard_components(odd_docs)) == brute(rows, 4, 85)
    assert got(jaccard.jaccard_components(no_docs)) == []


def test_table_against_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(jaccard.jaccard_components(df)) == brute(rows, 4, 85)


def growing(seed):
    """Families of versions that grow by a tenth each, copies with few edits
    and texts that hold another one and a quarter more."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([40, 80, 120]))
        for _ in range(r.randint(2, 6)):
            kind, t = r.randrange(3), list(base)
            if kind == 0:
                t[r.randrange(len(t))] = r.choice(vocab)
            elif kind == 1:
                t += r.choices(vocab, k=len(t) // 4)
            else:
                base = base + r.choices(vocab, k=len(base) // 10)
            rows.append((len(rows), " ".join(t)))
    r.shuffle(rows)
    return rows


def test_growing_texts_under_a_saturated_sketch(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 6)
    monkeypatch.setattr(jaccard, "SKETCH_CHUNK", 64)
    # workers import the module anew, so what reads the size is sent by value
    monkeypatch.setattr(jaccard, "_cells", lambda h, row: ((h >> np.uint64(58 - 6 * row)) & np.uint64(63)).astype(np.int64))
    for seed in (1, 2, 3):
        rows = growing(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(jaccard.jaccard_components(df)) == brute(rows, 4, 85)


def test_lists_of_one_member_are_dropped_across_batches(spark):
    """Rows come in Arrow batches of three; a list may span several."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(t, 1, 10 * t + i, 0, 0) for t, m in ((1, 1), (2, 2), (3, 1), (4, 7), (5, 3), (6, 1), (7, 2)) for i in range(m)]
        df = spark.createDataFrame(rows, "token long, n long, cls long, pos long, common long").coalesce(1)
        got = sorted(tuple(r) for r in jaccard.shared_lists(df).collect())
        assert got == [r for r in rows if r[0] in (2, 4, 5, 7)]
        assert jaccard.shared_lists(df.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_members_of_a_large_leader_are_dealt_to_several_tasks(spark, monkeypatch):
    from sombra.llm import jaccard
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*words, f"own{k}"])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seats = []
    real = jaccard.class_sets
    monkeypatch.setattr(jaccard, "class_sets", lambda d, wanted, k: seats.append(wanted) or real(d, wanted, k))
    out = jaccard.jaccard_components(docs).collect()
    assert {r.component_id for r in out} == {0} and len(out) == 300
    inlined = seats[0].selectExpr("inline(seats)")
    assert inlined.groupBy("key").agg({"salt": "max"}).collect()[0][1] >= 1
    assert inlined.where("role = 1").groupBy("key", "salt").count().agg({"count": "max"}).first()[0] <= 256
