import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sombra.llm import bpe, packing, token_counts
from sombra.llm.common import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aZ'stΣé́\x1c\x85 <|>endoftx1²!_\n ", max_size=60)))
def test_encoding_and_decoding_equal_the_library(text):
    from tokenizers import Tokenizer

    lib = bpe._LOADED.setdefault("lib", Tokenizer.from_file(PATH))
    want = lib.encode(text, add_special_tokens=False).ids
    raw, decoded = bpe.load(PATH).encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == want
    assert decoded == lib.decode(want, skip_special_tokens=False)
    ids = packing._LOADED.setdefault(PATH, packing.Ids(PATH))(pa.array(["other Words", text, ""]))
    assert ids[1].tolist() == [*want, packing.END_ID] and ids[2].tolist() == [packing.END_ID]


def test_special_tokens(library):
    for t in ("a<|endoftext|>b", "<|startoftext|> x <|ENDOFTEXT|>", "<|endoftext|><|endoftext|>"):
        assert np.frombuffer(bpe.load(PATH).encode(t)[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_table_and_odd_rows(spark, odd_docs, no_docs, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, odd_docs.select("doc_id", "text")):
        texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))
        got = sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in bpe.encode_decode(df).collect()))
        want = sorted((a, b, np.array(e.ids, "<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False))
                      for a, b, t in texts for e in [library.encode(t, add_special_tokens=False)])
        assert got == want
    assert bpe.encode_decode(no_docs).collect() == []


def check_packing(df, pieces, library, length):
    want = sorted((r.doc_id is None, r.doc_id or 0, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1]))
                  for r in df.collect())
    seqs, docs = {}, {}
    for p in pieces:
        x = np.frombuffer(bytes(p.ids), "<u4")
        assert len(x) == p.length > 0
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault((p.doc_id is None, p.doc_id or 0, p.doc_tokens), []).append((p.start, tuple(x.tolist())))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= length and at & (at - 1) == 0      # full or a power of two: no padding
    # rebuild documents; repeated rows share a key and are matched as multisets
    for (null, i, n), parts in docs.items():
        full = [w for a, b, w in want if (a, b, len(w)) == (null, i, n)]
        assert sorted(parts) == sorted((s, w[s:s + len(x)]) for w in full for s, x in parts)[::len(full)] or \
            sum(len(x) for _, x in parts) == n * len(full)
    assert sum(p.length for p in pieces) == sum(len(w) for _, _, w in want)


def test_packing(spark, odd_docs, no_docs, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df, length in ((docs, 2048), (odd_docs, 64)):
        pieces = packing.pack(df, length=length, tokens_per_task=20_000).collect()
        check_packing(df, pieces, library, length)
    assert packing.pack(no_docs).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, length=100)


def test_hilbert_is_a_continuous_path():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_powers():
    assert packing.powers(1500) == [1024, 256, 128, 64, 16, 8, 4] and packing.powers(0) == []


def brute_unigram(u, w):
    best = [(0.0, 0)] + [None] * len(w)
    for i in range(1, len(w) + 1):
        for j in range(i):
            p = (u.final if i == len(w) else u.inner).get(w[j:i])
            if p is not None and best[j] is not None:
                c = (best[j][0] + p, best[j][1] - 1)
                best[i] = c if best[i] is None or c > best[i] else best[i]
    return -best[-1][1], best[-1][0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="theronanding", min_size=1, max_size=14), min_size=1, max_size=30))
def test_token_counts_against_plain_dynamic_programming(words):
    u = token_counts._LOADED.setdefault(PATH, None) or token_counts._LOADED.__setitem__(PATH, token_counts.Unigram(PATH)) \
        or token_counts._LOADED[PATH]
    got = u.forward(list(set(words)))
    for w in set(words):
        n, p = brute_unigram(u, w)
        assert got[w][0] == n and abs(got[w][1] - p) < 1e-9


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    rows = token_counts.token_counts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[2].n_tokens, by[3].n_tokens, by[4].n_tokens) == (0, 0, 0)
    assert by[5].n_words == 40_000 and by[5].n_tokens == 40_000 * (by[5].n_tokens // 40_000)
    assert token_counts.token_counts(no_docs).collect() == []


def test_crc_of_pieces(spark):
    """ids_crc32 against zlib over the library's own ids."""
    from tokenizers import Tokenizer

    from sombra.llm import queries

    tok = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op7_packing(spark, "/root/testdata/sf0.001").collect():
        ids = [*tok.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())


def test_projection_of_many_documents():
    r = np.random.default_rng(3)
    up = packing.projection(500)
    found = [r.integers(0, 500, n).astype(np.uint16) for n in (1, 7, 300, 1, 2000, 5)]
    signs = np.stack([2 * (up[k // 2] >> 32 * (k % 2) & 0xFFFFFFFF) - 1 for k in range(packing.DIMS)], 1)
    want = np.array([signs[x].mean(0) for x in found])
    for at_once in (1, 400, 1 << 20):
        assert np.allclose(packing.project(found, up, at_once), want)
    assert packing.project([], up).shape == (0, packing.DIMS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abZ'.,é×÷&<=|#\u0338\u0301…1 ’ñÉß \tstr", max_size=30), min_size=1, max_size=5))
def test_pieces_cut_at_marks_give_the_library_ids(library, texts):
    ids = packing._LOADED.setdefault(PATH, None) or packing._LOADED.__setitem__(PATH, packing.Ids(PATH)) or packing._LOADED[PATH]
    for t, got in zip(texts, ids(pa.array(texts)), strict=True):
        assert got.tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_pieces_are_looked_up_once_for_megabytes_of_text(library, monkeypatch):
    ids = packing.Ids(PATH)
    seen, look_up = [], ids._ids_of
    monkeypatch.setattr(ids, "_ids_of", lambda words: seen.append(words) or look_up(words))
    texts = ["", "Naïve cafés, 12 of them. ", " \t\n", "It's <|x|> A-b " * 3, "", *(f"w{i % 700}x Y{i % 90}. " * 20 for i in range(12_000)), ""]
    assert 2 << 20 < sum(map(len, texts)) < 4 << 20
    col = pa.array(["not in the slice", *texts])[1:]
    got = ids(col)
    assert len(seen) == 1 and len(set(seen[0])) == len(seen[0]) < 2000
    for k in (0, 1, 2, 3, 4, 5, 6, 700, 8000, len(texts) - 1):
        assert got[k].tolist() == [*library.encode(texts[k], add_special_tokens=False).ids, 1]
