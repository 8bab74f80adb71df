import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sombra.llm import repeats


def brute(rows, size=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return ordered(out)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, blk int, a string")
    return ordered(repeats.remove_repeats(df, **kw).collect())


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ordered(repeats.remove_repeats(odd_docs).collect())
    assert got == brute(rows)
    assert [r for r in got if r[0] == 5][0][2] == 40_000  # one word over and over recurs within its text


def test_empty(no_docs):
    assert repeats.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("run_rows", [2, 512])
def test_families(spark, run_rows, monkeypatch):
    """Copies, edited copies, excerpts, passages at other places, several
    repeats in one text, and windows one word short."""
    monkeypatch.setattr(repeats, "RUN", run_rows)
    r = random.Random(run_rows)
    vocab = [f"w{i}" for i in range(3000)] + ["Ä", "ä", "A", "a", " x"]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, common = [], text(40)
    for i in range(60):
        t = text(r.randrange(20, 200))
        kind = i % 6
        rows.append((len(rows), t))
        if kind == 0:
            rows.append((len(rows), list(t)))
        elif kind == 1:
            e = list(t)
            for _ in range(3):
                e[r.randrange(len(e))] = r.choice(vocab)
            rows.append((len(rows), e))
        elif kind == 2:
            a = r.randrange(max(1, len(t) - 40))
            rows.append((len(rows), text(30) + t[a:a + r.choice([34, 35, 36, 60])] + text(10)))
        elif kind == 3:
            p = r.randrange(len(t))
            rows.append((len(rows), t[:p] + common + t[p:] + text(3) + common[:35]))
        elif kind == 4:
            rows.append((len(rows), t + t[:50] + t))
    texts = [(d, (" " if d % 2 else "\n\t ").join(t)) for d, t in rows]
    assert run(spark, texts) == brute(texts)
    assert run(spark, texts, size=12, gram=3) == brute(texts, 12)


def test_segments_cover_all_windows():
    g = np.random.default_rng(1)
    col = pa.array([" ".join(f"w{x}" for x in g.integers(0, 4, n)) for n in (0, 3, 34, 35, 36, 400)])
    cut = repeats.Cut(repeats.Words(col, 0, 6), 35, 8)
    assert len(cut.start) == 1 + 2 + 366
    assert (np.diff(cut.start[cut.seg]) > 0).all() and len(cut.seg_of) == len(cut.start)


def test_source_with_two_rows_in_a_block():
    """A block that holds its source segment in two rows still counts it."""
    tile = [f"t{i}" for i in range(40)]
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [" ".join(tile), " ".join(tile)]})
    cut = repeats.Cut(repeats.Words(docs.column("text"), 0, 1), 35, 8)
    keys = {"a": np.repeat(cut.seg_anchor.view(np.int64), 2), "g": np.repeat(cut.digest.view(np.int64), 2),
            "state": np.tile([repeats.WHOLE, repeats.SOURCE], len(cut.seg))}
    out = repeats.settle_or_count(35, 8)(pa.table({"blk": [1], "payload": [repeats.pack(docs)]}), pa.table(keys))
    assert sum(k == repeats.COUNT for k in out["kind"].to_pylist()) == 6


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("n"))
    assert ordered(repeats.remove_repeats(df).collect()) == brute([(r.doc_id, r.text) for r in df.collect()])
