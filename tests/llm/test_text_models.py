"""Toxicity, language model, fingerprints, licenses."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sombra.llm import fingerprints, licenses, lm, toxicity

SF = "/root/testdata/sf0.001"


# -- toxicity ---------------------------------------------------------------

def plain_kernel(s, t, order=toxicity.ORDER, lam=toxicity.DECAY):
    """All common subsequences, by enumeration."""
    from itertools import combinations

    def weights(x):
        out = {}
        for c in combinations(range(len(x)), order):
            u = "".join(x[i] for i in c)
            out[u] = out.get(u, 0) + lam ** (c[-1] - c[0] + 1)
        return out
    a, b = weights(s), weights(t)
    return sum(a[u] * b.get(u, 0) for u in a)


def test_kernel_against_enumeration():
    pairs = [("idiot", "idiot"), ("idiot", "i.d.i.o.t"), ("clown", "cl0wn"), ("abc", "xyz"), ("scum", "scxum"), ("banana", "ananas")]
    s, _ = toxicity.encode_words([a for a, _ in pairs])
    t, _ = toxicity.encode_words([b for _, b in pairs])
    got = toxicity.subsequence_kernel(s, t)
    assert np.allclose(got, [plain_kernel(a, b) for a, b in pairs], rtol=1e-4)


def toxic_table(spark):
    r = random.Random(3)
    syl = ["tho", "ner", "ing", "sha", "ble", "ti", "on", "wh"]
    insults = ["idiot", "moron", "clown", "pathetic"]
    docs, labels = [], []
    for i in range(600):
        words = ["".join(r.choices(syl, k=r.randint(1, 4))) for _ in range(r.randint(5, 80))]
        y = int(r.random() < 0.3)
        if y:
            w = r.choice(insults)
            if r.random() < 0.3:
                p = r.randrange(1, len(w) - 1)
                w = w[:p] + "-" + w[p:]
            words[r.randrange(len(words))] = w
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, y))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, y) for i, _, y in labels))


def test_held_out_accuracy(spark):
    docs, labels, truth = toxic_table(spark)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels, _ = toxic_table(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.landmarks == b.landmarks and np.array_equal(a.w, b.w) and (a.a, a.b) == (b.a, b.b)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    docs, labels, _ = toxic_table(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    clean = toxicity.keep_clean(odd_docs, model)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert toxicity.score(no_docs, model).collect() == []
    # no labels, one class, null labels: a constant score
    for rows in ([], [(1, 1, 0)], [(1, 1, None), (None, 1, 1)]):
        m = toxicity.train(odd_docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert len({r.score for r in toxicity.score(odd_docs, m).collect()}) == 1


def test_words_spelt_out_and_long_words():
    r = toxicity.Reader(["idiot"])
    spelt, plain, inside, none = r.sentences(["you i d i o t you", "an idiot.", "thidiotth", "nothing here " + "x" * 200])
    assert spelt.max() > 0.9 and plain.max() > 0.9 and inside.max() > 0.4 and len(none) == 0


def test_marks_between_all_letters(spark):
    docs, labels, _ = toxic_table(spark)
    model = toxicity.train(docs, labels)
    plain = model.scores(pa.array([f"thoner {w} shable." for w in model.landmarks]))
    for mark in ".*-_":
        rows = toxicity.Reader(model.landmarks).sentences([f"thoner {mark.join(w)} shable." for w in model.landmarks])
        assert all(len(r) and r.max() > 0.5 for r in rows)
        got = model.scores(pa.array([f"thoner {mark.join(w)} shable." for w in model.landmarks]))
        assert len(got) >= 4 and (got[plain >= 0.5] >= 0.5).all()


# -- language model ----------------------------------------------------------

def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def base_scores(rows):
    c = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            c.update(split(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = [*split(t), None]
        yield (i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n,
               sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))


def compare(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    want = sorted(base_scores(rows), key=key)
    out = lm.score_texts(df, **kw).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    return out


def test_base_score_and_gain_on_held_out_texts(spark):
    out = compare(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), vocab=5000)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_lm_of_odd_rows(odd_docs, no_docs):
    out = compare(odd_docs, vocab=4)
    assert all(r.bits_per_byte is None or r.bits_per_byte > 0 for r in out)
    assert lm.score_texts(no_docs).collect() == []


def test_no_training_rows(spark):
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    df = spark.createDataFrame([(i, "some words here") for i in only], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in compare(df))


def test_code_is_complete():
    """The mixture is a distribution: probabilities of all next words add to 1."""
    words = [b"a", b"bb", b"ccc", b"dd", b"e", b""]
    code = lm.Code(words, [50, 20, 9, 4, 3, 10], 100)
    table = np.zeros(lm.table_size(code), np.uint32)
    lm.count_bits(code, [[b"a", b"bb", b"a", b"zz", b"ccc"]] * 5, table)
    mixer = lm.Mixer(code, table.astype(np.float32))
    base = mixer.score(code, lm.Stream(code, [[b"a", b"bb"]]))[0]   # a bb end
    total = 0.0
    for w in [*words[:-1], b"unseen"]:
        st = lm.Stream(code, [[b"a", w]])
        st.off = np.array([0, 2])                                     # without the end
        total += math.exp(-mixer.score(code, st)[0])
    st = lm.Stream(code, [[b"a"]])
    total += math.exp(-mixer.score(code, st)[0])
    one = lm.Stream(code, [[b"a"]])
    one.off = np.array([0, 1])
    assert abs(total / math.exp(-mixer.score(code, one)[0]) - 1) < 1e-3 and base > 0


def lm_texts(n, seed=5):
    r = random.Random(seed)
    words = [b"w%d" % i for i in range(50)]
    return [[r.choice(words[:r.randint(2, 50)]) for _ in range(r.randint(400, 700))] for _ in range(n)]


def lm_mixer(texts):
    counts = Counter(w for t in texts for w in (*t, b""))
    words = [*sorted(w for w in counts if w), b""]
    code = lm.Code(words, [counts[w] for w in words], sum(counts.values()))
    table = np.zeros(lm.table_size(code), np.uint32)
    lm.count_bits(code, texts, table)
    return code, table.astype(np.float32)


def test_texts_are_cut_and_their_bits_found_many_at_once():
    r = random.Random(8)
    parts = ["Ab", "É", "c\u00a0d", "x\x1cy", "\x85", "zz", "w" * 300, " ", "\t", "\n\n", "\x0b", "\x0c", "\r", " "]
    texts = ["", " ", "A", *("".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(200))]
    col = pa.array(["skipped by the slice", *texts])[1:]
    words, lens = lm.split(col)
    want = [split(t) for t in texts]
    assert words.to_pylist() == [w for t in want for w in t] and lens.tolist() == [len(t) for t in want]

    known = Counter(w for t in want for w in t).most_common(40)
    code = lm.Code([*(w for w, _ in known), b""], [*(c for _, c in known), len(texts)], 10_000)
    st = lm.Stream(code, words, lens)
    number = {w: i for i, (w, _) in enumerate(known)}
    assert st.ids.tolist() == [x for t in want for x in (*(number.get(w, code.escape) for w in t), code.end)]
    assert st.unknown.to_pylist() == [w for t in want for w in t if w not in number]
    # by depth, all symbols at once, as by symbol
    pos, n = st.paths(code, np.arange(len(st.ids)))
    by_symbol = [2 * code.nodes[pos].astype(int) + code.bits[pos], *st.cells(code, np.arange(len(st.ids)), pos, n)[1:]]
    by_depth = [(step, lm.slots(x1, step >> 1), lm.slots(x2, step >> 1))
                for _, step, x1, x2 in st.layers(code, slice(0, len(st.ids)))]
    assert sorted(zip(*map(list, by_symbol), strict=True)) == sorted(x for d in by_depth for x in zip(*map(list, d), strict=True))


def test_a_text_scores_the_same_in_any_batch():
    texts = lm_texts(80)
    code, table = lm_mixer(texts)
    mixer = lm.Mixer(code, table)
    together = mixer.score(code, lm.Stream(code, texts))
    alone = [mixer.score(code, lm.Stream(code, [t]))[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-12, atol=0)


def test_weights_adapt_within_a_short_text():
    code, table = lm_mixer(lm_texts(20))
    mixer = lm.Mixer(code, table)
    text = lm.Stream(code, [[b"w1", b"w2"] * 100])
    assert mixer.score(code, text)[0] < mixer.score(code, text, rate=0.0)[0]


def test_starting_weights_read_all_training_rows(spark):
    texts = lm_texts(700)
    code, table = lm_mixer(texts)
    df = spark.createDataFrame([(b" ".join(t).decode(),) for t in texts], "text string").repartition(7)
    share = spark.sparkContext.broadcast
    grads, curv, seen = lm.fit_sums(df, share(code), share(table), lm.Mixer(code, table).weights)
    st = lm.Stream(code, texts)
    assert seen.sum() == (code.off[st.ids + 1] - code.off[st.ids]).sum()
    assert np.allclose(curv, curv.transpose(0, 2, 1)) and np.isfinite(grads).all()


def test_starting_weights_take_one_pass_and_fit_as_all_passes_would(spark, monkeypatch):
    texts = lm_texts(300)
    code, table = lm_mixer(texts)
    df = spark.createDataFrame([(b" ".join(t).decode(),) for t in texts], "text string").repartition(5)
    passes, whole = [], lm.bit_histogram
    monkeypatch.setattr(lm, "bit_histogram", lambda *a: passes.append(1) or whole(*a))
    mixer = lm.Mixer(code, table)
    lm.fit(df, spark.sparkContext.broadcast(code), table, mixer)
    assert len(passes) == 1

    # the inputs themselves, not their levels, by Newton steps over every bit
    st = lm.Stream(code, texts)
    at = np.arange(len(st.ids))
    pos, n = st.paths(code, at)
    bit, gate = code.bits[pos].astype(int), code.gate[pos]
    node, s1, s2 = st.cells(code, at, pos, n)
    size = 1 << lm.SLOT_BITS
    cells = table[:2 * (code.n_nodes + 2 * size)].reshape(-1, 2)
    x = []
    for cell in (node, code.n_nodes + s1, code.n_nodes + size + s2):
        c = cells[cell].copy()
        c[np.arange(len(bit)), bit] -= 1
        x.append(lm.inputs(c[:, 0], c[:, 1]).astype(float))
    x = np.array(x)

    def loss(w):
        z = (np.asarray(w, float)[gate].T * x).sum(0)
        return np.log1p(np.exp(z * (1 - 2 * bit))).sum()
    w = np.full((lm.GATES, lm.INPUTS), 0.4)
    start = loss(w)
    for _ in range(lm.ROUNDS):
        p = 1 / (1 + np.exp(-(w[gate].T * x).sum(0)))
        for g in range(lm.GATES):
            k = gate == g
            h = (x[:, k] * (p[k] * (1 - p[k]) + 1e-6)) @ x[:, k].T
            w[g] += np.linalg.solve(h + np.eye(lm.INPUTS) * 1e-2, x[:, k] @ (bit[k] - p[k])).clip(-1, 1)
    assert loss(mixer.weights) - loss(w) < 0.02 * (start - loss(w))


# -- fingerprints -------------------------------------------------------------

def check_fingerprints(df):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()))
    piece = re.compile(rf"[^\n]{{1,{fingerprints.PIECE}}}\n?|\n")
    keys = lambda t: set(piece.findall(t))

    def near(a, b):
        return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))
    want = []
    for k, (known, i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        want.append((known, i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(keys(t), keys(edited)), 9),
                     round(near(keys(t), keys(nxt)), 9)))
    out = fingerprints.fingerprints(df).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out)
    assert got == sorted(want)
    return rows, out


def test_fingerprints(spark, odd_docs, no_docs, monkeypatch):
    check_fingerprints(odd_docs)
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 17)
    rows, out = check_fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))
    by_text = {}
    text = {i: t for _, i, t in rows}
    for r in out:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprints(no_docs).collect() == []


def test_likeness_on_many_documents(spark):
    """Equal to exact sets on 10,000 documents: no false key is peeled."""
    _, out = check_fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert all(0.0 <= r.near_next <= 1.0 and 0.0 <= r.near_edited <= 1.0 for r in out)


# -- licenses -------------------------------------------------------------------

@pytest.mark.parametrize("times", [2, 3, 5])
def test_notices_one_after_another(times):
    """Joined files: every copy of a notice is a find of its own."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, t in licenses.TEMPLATES.items():
        text = "\n".join(["start of it", *[t] * times, "and the end"])
        got = sorted((s, e) for _, n, s, e, _ in scanner.scan(pa.array([text])) if n == name)
        assert len(got) == times, (name, got)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_planted_licenses(spark, odd_docs, no_docs):
    r = random.Random(2)
    names = sorted(licenses.TEMPLATES)
    docs, want = [], []
    for i in range(80):
        noise = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))
        name = r.choice(names)
        text = noise(r.randint(0, 300)) + " é\n" + licenses.TEMPLATES[name] + "\n" + noise(r.randint(0, 300))
        if i % 4 == 0:
            text = noise(200)
        else:
            want.append((i, name))
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = licenses.license_scan(df).collect()
    assert set(want) <= {(g.doc_id, g.license) for g in got}
    assert {g.doc_id for g in got} == {i for i, _ in want}
    text = dict(docs)
    for g in got:
        if (g.doc_id, g.license) in want:
            assert g.containment == 1.0
            assert text[g.doc_id][g.start:g.end].strip('."') == licenses.TEMPLATES[g.license].strip('."')
    assert licenses.license_scan(odd_docs).collect() == [] and licenses.license_scan(no_docs).collect() == []


def plain_containment(text, template):
    word = re.compile(rb"[A-Za-z0-9\x80-\xff]+")
    t, w = ([x.lower() for x in word.findall(x.encode())] for x in (template, text))
    k = min(licenses.WORDS, len(t))
    own = {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}
    spans = 2 * (1 << (len(own) - 1).bit_length())
    sh = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    return max((len(own & set(sh[i:i + spans])) / len(own) for i in range(max(1, len(sh)))), default=0)


def test_licenses_of_the_table_against_all_windows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {}
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for row, name, _, _, c in scanner.scan(pa.array([t for _, t in docs])):
        got[docs[row][0], name] = max(c, got.get((docs[row][0], name), 0))
    want = {(i, n) for i, t in docs for n, x in licenses.TEMPLATES.items() if plain_containment(t, x) >= licenses.SHARE}
    assert set(got) == want


def test_bands_keep_the_promise():
    s = licenses.Scanner(licenses.TEMPLATES)
    least = licenses.SHARE / (4 + 1 - licenses.SHARE)
    assert (1 - least) ** s.bands <= licenses.MISS


@pytest.mark.parametrize("text", ["", "one", "All rights reserved."])
def test_short_texts(text):
    licenses.Scanner(licenses.TEMPLATES).scan(pa.array([text]))
