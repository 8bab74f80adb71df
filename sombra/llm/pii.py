"""Operator 2: personal data in text.

Two finders per text.  (a) Base patterns: e-mail, ip, card and phone by fixed
regular expressions, found in linear time.  (b) A character-level
bidirectional LSTM with a linear-chain CRF on top, trained in numpy on windows
labelled by spans.  Overlapping windows of a text are decoded together; where
windows overlap, every character takes the emissions of the window in whose
middle it lies deepest, and one Viterbi pass over the reconciled emissions of
each run of windows gives globally consistent spans.

A personal-data span of any of the four kinds holds a digit or an '@'.
A tag path is therefore only decoded over windows that hold one: the others
cannot yield a span, so skipping them changes no result.  Spans the model
finds are added when they have the kind's shape (at least one digit or '@'
and the kind's count of digits) and overlap no base span; base spans stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, map_arrow

KINDS = ("email", "ip", "card", "phone")

# The base patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANCHOR = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind then start.

    Leftmost non-overlapping matches per kind; a match that fails its test is
    dropped and the search goes on after it."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        s = at
        if m:
            while s > end and text[s - 1] in _LOCAL:
                s -= 1
        if m and s < at:
            out.append((0, s, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups())):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _DIGITS.sub("", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---------------------------------------------------------------------------
# The tagger
# ---------------------------------------------------------------------------

# Tags: 0 outside, then begin and inside of each kind
N_TAGS = 1 + 2 * len(KINDS)
# Character classes: letters and digits of ASCII lower-cased, each other ASCII
# character by itself, and one class per range beyond it
N_CLASSES = 128 + 2


def char_classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(c < 128, c, np.where(c < 0x250, 128, 129)).astype(np.int16)
    up = (out >= 65) & (out <= 90)
    out[up] += 32
    return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Bidirectional LSTM + CRF in numpy.  ``params`` is a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, hidden: int = 12, emb: int = 8, seed: int = 7) -> "Tagger":
        r = np.random.Generator(np.random.PCG64(seed))
        def init(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)
        p = {"E": init(N_CLASSES, emb, scale=0.3)}
        for d in "fb":
            p["W" + d] = init(emb, 4 * hidden, scale=emb ** -0.5)
            p["U" + d] = init(hidden, 4 * hidden, scale=hidden ** -0.5)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1.0  # forget gate
            p["c" + d] = bias
        p["V"] = init(2 * hidden, N_TAGS, scale=0.2)
        p["v"] = np.zeros(N_TAGS, np.float32)
        trans = np.zeros((N_TAGS, N_TAGS), np.float32)
        p["T"] = trans
        p["S"] = np.zeros(N_TAGS, np.float32)
        return cls(p)

    # -- emissions ---------------------------------------------------------
    def _lstm(self, X, mask, d, keep=False):
        """X (n, t, emb); right-padded; mask (n, t)."""
        p, n, t = self.p, X.shape[0], X.shape[1]
        h4 = p["U" + d].shape[1]
        h = h4 // 4
        pre = X @ p["W" + d] + p["c" + d]
        H = np.zeros((n, t, h), np.float32)
        hs, cs = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        tape = []
        for i in (range(t) if d == "f" else range(t - 1, -1, -1)):
            z = pre[:, i] + hs @ p["U" + d]
            g = _sigmoid(z[:, :3 * h])
            a = np.tanh(z[:, 3 * h:])
            c2 = g[:, h:2 * h] * cs + g[:, :h] * a
            tc = np.tanh(c2)
            h2 = g[:, 2 * h:3 * h] * tc
            m = mask[:, i:i + 1]
            if keep:
                tape.append((i, hs, cs, g, a, tc, m))
            cs = c2 * m
            hs = h2 * m
            H[:, i] = hs
        return H, tape

    def emissions(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        X = self.p["E"][ids]
        Hf, _ = self._lstm(X, mask, "f")
        Hb, _ = self._lstm(X, mask, "b")
        return np.concatenate([Hf, Hb], 2) @ self.p["V"] + self.p["v"]

    # -- training ----------------------------------------------------------
    def _crf_grad(self, em, tags, mask):
        """Negative log likelihood per sequence and its gradients."""
        T, S = self.p["T"], self.p["S"]
        n, t, k = em.shape
        alpha = np.empty_like(em)
        alpha[:, 0] = S + em[:, 0]
        for i in range(1, t):
            x = alpha[:, i - 1][:, :, None] + T
            mx = x.max(1)
            nxt = mx + np.log(np.exp(x - mx[:, None]).sum(1)) + em[:, i]
            m = mask[:, i:i + 1]
            alpha[:, i] = np.where(m > 0, nxt, alpha[:, i - 1])
        last = alpha[:, -1]
        mx = last.max(1, keepdims=True)
        logz = (mx + np.log(np.exp(last - mx).sum(1, keepdims=True)))[:, 0]
        beta = np.zeros((n, k), np.float32)
        gem, gT = np.zeros_like(em), np.zeros_like(T)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            m = mask[:, i]
            post = np.exp(alpha[:, i] + beta - logz[:, None]) * m[:, None]
            gem[:, i] = post
            gem[rows, i, tags[:, i]] -= m
            if i:
                y = em[:, i] + beta
                pair = np.exp(alpha[:, i - 1][:, :, None] + T + (y - logz[:, None])[:, None]) * m[:, None, None]
                gT += pair.sum(0)
                np.subtract.at(gT, (tags[:, i - 1], tags[:, i]), m)
                x = T[None] + y[:, None]
                mx = x.max(2)
                b2 = mx + np.log(np.exp(x - mx[:, :, None]).sum(2))
                beta = np.where(m[:, None] > 0, b2, beta)
        gS = gem[:, 0].sum(0)
        return logz, gem, gT, gS

    def _grads(self, ids, tags, mask):
        p = self.p
        X = p["E"][ids]
        H, tapes = {}, {}
        for d in "fb":
            H[d], tapes[d] = self._lstm(X, mask, d, keep=True)
        HH = np.concatenate([H["f"], H["b"]], 2)
        em = HH @ p["V"] + p["v"]
        _, gem, gT, gS = self._crf_grad(em, tags, mask)
        g = {"T": gT, "S": gS, "V": np.einsum("nth,ntk->hk", HH, gem), "v": gem.sum((0, 1))}
        gH = gem @ p["V"].T
        h = H["f"].shape[2]
        gX = np.zeros_like(X)
        for d, part in (("f", gH[:, :, :h]), ("b", gH[:, :, h:])):
            dh = np.zeros_like(part[:, 0])
            dc = np.zeros_like(dh)
            gW, gU, gc = np.zeros_like(p["W" + d]), np.zeros_like(p["U" + d]), np.zeros_like(p["c" + d])
            for i, hs, cs, gate, a, tc, m in reversed(tapes[d]):
                dh2 = (dh + part[:, i]) * m
                o = gate[:, 2 * h:3 * h]
                dc2 = dc * m + dh2 * o * (1 - tc * tc)
                dz = np.concatenate([dc2 * a, dc2 * cs, dh2 * tc], 1) * gate * (1 - gate)
                dz = np.concatenate([dz, dc2 * gate[:, :h] * (1 - a * a)], 1)
                gW += X[:, i].T @ dz
                gU += hs.T @ dz
                gc += dz.sum(0)
                gX[:, i] += dz @ p["W" + d].T
                dh = dz @ p["U" + d].T
                dc = dc2 * gate[:, h:2 * h]
            g["W" + d], g["U" + d], g["c" + d] = gW, gU, gc
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], ids.ravel(), gX.reshape(-1, gX.shape[2]))
        return g

    def fit(self, ids, tags, mask, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 3) -> "Tagger":
        """Adam over shuffled batches; deterministic for its inputs."""
        r = np.random.Generator(np.random.PCG64(seed))
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, n = 0, len(ids)
        total = epochs * -(-n // batch)
        for _ in range(epochs):
            order = r.permutation(n)
            for lo in range(0, n, batch):
                sel = order[lo:lo + batch]
                g = self._grads(ids[sel], tags[sel], mask[sel])
                step += 1
                lr = rate * (1 - 0.9 * step / total)
                for k, v in g.items():
                    v = np.clip(v / len(sel), -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - lr * (m1[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self

    # -- decoding ----------------------------------------------------------
    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best tag path of one emission matrix (t, tags)."""
        return self.viterbi_many(em[None], np.array([len(em)]))[0][:len(em)]

    def viterbi_many(self, em: np.ndarray, lens: np.ndarray) -> np.ndarray:
        T, S = self.p["T"], self.p["S"]
        n, t, k = em.shape
        score = S + em[:, 0]
        back = np.zeros((n, t, k), np.int8)
        hold = np.arange(k, dtype=np.int8)
        for i in range(1, t):
            x = score[:, :, None] + T
            b = x.argmax(1)
            on = (i < lens)[:, None]
            back[:, i] = np.where(on, b, hold)
            score = np.where(on, np.take_along_axis(x, b[:, None], 1)[:, 0] + em[:, i], score)
        path = np.zeros((n, t), np.int8)
        tag = score.argmax(1)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            path[:, i] = tag
            tag = back[rows, i, tag]
        return path


# ---------------------------------------------------------------------------
# Windows
# ---------------------------------------------------------------------------

WIDTH, STRIDE = 96, 64
# Windows decoded as one chain at most (bounds memory on texts made of digits);
# the next window of such a text starts a chain of its own.
RUN = 512


def anchored_windows(text: str) -> list[int]:
    """Numbers w of the windows [w * STRIDE, w * STRIDE + WIDTH) of a text that
    hold a digit or '@' (the windows without one cannot yield a span)."""
    out, seen = [], -1
    for m in _ANCHOR.finditer(text):
        p = m.start()
        lo = max(seen + 1, -(-(p - WIDTH + 1) // STRIDE), 0)
        for w in range(lo, p // STRIDE + 1):
            out.append(w)
            seen = w
    return out


def _shape_ok(kind: int, piece: str) -> bool:
    d = _DIGITS.sub("", piece)
    if kind == 0:
        return "@" in piece and "." in piece[piece.index("@"):] and len(piece) >= 6
    if kind == 1:
        return 4 <= len(d) <= 12 and len(re.findall(r"[0-9]+", piece)) == 4
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15


def model_spans(texts: list[str], tagger: Tagger, batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """Spans the tagger finds in each text (kind, start, end)."""
    jobs = [(i, w) for i, t in enumerate(texts) for w in anchored_windows(t)]
    classes: dict[int, np.ndarray] = {}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs: list[tuple[int, int, np.ndarray]] = []   # (text, start, emissions) of a run of windows
    run: list = []

    def close():
        if run:
            i, s = run[0][0], run[0][1]
            length = run[-1][1] + len(run[-1][2]) - s
            em = np.empty((length, N_TAGS), np.float32)
            depth = np.full(length, -1)
            for _, w, e in run:
                d = np.minimum(np.arange(len(e)), len(e) - 1 - np.arange(len(e)))
                a = w - s
                take = d > depth[a:a + len(e)]
                em[a:a + len(e)][take] = e[take]
                depth[a:a + len(e)][take] = d[take]
            runs.append((i, s, em))
            run.clear()
            if len(runs) >= batch:
                decode()

    def decode():
        # groups of similar length keep the padding small
        runs.sort(key=lambda r: len(r[2]))
        lo = 0
        while lo < len(runs):
            size = max(1, min(64, 65536 // len(runs[lo][2])))
            part = runs[lo:lo + size]
            lo += size
            lens = np.array([len(e) for _, _, e in part])
            em = np.zeros((len(part), lens.max(), N_TAGS), np.float32)
            for j, (_, _, e) in enumerate(part):
                em[j, :len(e)] = e
            for (i, s, e), path in zip(part, tagger.viterbi_many(em, lens), strict=True):
                for kind, a, b in tag_spans(path[:len(e)]):
                    out[i].append((kind, s + a, s + b))
        runs.clear()

    for lo in range(0, len(jobs), batch):
        part = jobs[lo:lo + batch]
        ids = np.zeros((len(part), WIDTH), np.int16)
        mask = np.zeros((len(part), WIDTH), np.float32)
        for r, (i, w) in enumerate(part):
            if i not in classes:
                classes.clear()
                classes[i] = char_classes(texts[i])
            c = classes[i][w * STRIDE:w * STRIDE + WIDTH]
            ids[r, :len(c)] = c
            mask[r, :len(c)] = 1
        em = tagger.emissions(ids, mask)
        for r, (i, w) in enumerate(part):
            e = em[r, :int(mask[r].sum())]
            if run and (run[-1][0] != i or run[-1][1] + len(run[-1][2]) <= w * STRIDE or len(run) == RUN):
                close()
            run.append((i, w * STRIDE, e))
    close()
    if runs:
        decode()
    return out


def tag_spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of maximal begin-inside runs."""
    out, start, kind = [], None, -1
    for i in np.flatnonzero(path != 0).tolist() + [len(path) + 1]:
        tag = int(path[i]) if i < len(path) else 0
        k = (tag - 1) // 2
        if start is not None and (i != end or k != kind or tag % 2 == 1):
            out.append((kind, start, end))
            start = None
        if i < len(path):
            if start is None:
                start, kind = i, k
            end = i + 1
    return out


def reconcile(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans plus the model's spans that have their kind's shape and
    overlap no base span or earlier added span."""
    taken = sorted((s, e) for _, s, e in base)
    added = []
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        while s < e and text[s] in " \t\r\n,;:":
            s += 1
        while e > s and text[e - 1] in " \t\r\n,;:.":
            e -= 1
        if s < e and _shape_ok(kind, text[s:e]) and not any(a < e and s < b for a, b in taken):
            added.append((kind, s, e))
            taken.append((s, e))
    return sorted(base + added)


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

TRAIN_WINDOWS = 1500


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, spans array<struct<kind,s,e>>) windows around labelled spans, and
    windows with digits but no span, for training."""
    def cut(batches):
        for b in batches:
            texts, spans = [], []
            for t in b.column("text").to_pylist():
                base = base_spans(t)
                for w in anchored_windows(t):
                    lo, hi = w * STRIDE, min(len(t), w * STRIDE + WIDTH)
                    inside = [{"kind": k, "s": max(s, lo) - lo, "e": min(e, hi) - lo}
                              for k, s, e in base if s < hi and e > lo]
                    if all(lo <= s and e <= hi for k, s, e in base if s < hi and e > lo):
                        texts.append(t[lo:hi])
                        spans.append(inside)
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])))],
                    names=["text", "spans"])
    return map_arrow(
        docs.select(*id_text(id_col, text_col)).select("text"), cut, "text string, spans array<struct<kind:int,s:int,e:int>>")


def train(docs: DataFrame, windows: int = TRAIN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Fit a tagger on a bounded sample: per label set (which kinds a window
    holds) the ``windows`` windows with the smallest hash, repeats once.  The
    bound is the parameter; without any window the fresh tagger is returned."""
    w = training_windows(docs, id_col, text_col)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["kind"]))), ",")
    w = w.withColumn("label", kinds).withColumn("h", F.xxhash64("text"))
    # two levels, so that no task sees a whole label set; each level keeps at
    # most ``windows`` rows of a group on the map side
    for keys in (["label", F.pmod("h", F.lit(61))], ["label"]):
        win = Window.partitionBy(*keys).orderBy("h", "text")
        w = w.withColumn("r", F.row_number().over(win)).where(F.col("r") <= windows).drop("r")
    rows = w.select("text", "spans", "h").dropDuplicates(["text"]).orderBy("h", "text").collect()
    tagger = Tagger.fresh()
    if not rows:
        return tagger
    ids = np.zeros((len(rows), WIDTH), np.int16)
    mask = np.zeros((len(rows), WIDTH), np.float32)
    tags = np.zeros((len(rows), WIDTH), np.int64)
    for i, r in enumerate(rows):
        c = char_classes(r["text"])
        ids[i, :len(c)] = c
        mask[i, :len(c)] = 1
        # a later kind never overwrites an earlier one's characters
        for s in sorted(r["spans"], key=lambda s: -s["kind"]):
            tags[i, s["s"]:s["e"]] = 2 * s["kind"] + 2
            tags[i, s["s"]] = 2 * s["kind"] + 1
    return tagger.fit(ids, tags, mask)


def find_spans(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), code points, end
    exclusive, by kind as in ``KINDS`` then start.  One row per input row; null
    text is empty (no spans); null ids stay; texts of any length are read whole."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tagger.p)  # a few thousand floats
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        tagger = Tagger(model.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            found = model_spans(texts, tagger)
            both = [reconcile(t, x, f) if f else sorted(x) for t, x, f in zip(texts, base, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [
                    pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in col], span)
                    for col in (base, both)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_arrow(docs.select(*id_text(id_col, text_col)), run, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in
    angle brackets; other columns stay, null text stays null."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tagger.p)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        tagger = Tagger(model.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            full = [t or "" for t in texts]
            out = []
            for t, raw, f in zip(full, texts, model_spans(full, tagger), strict=True):
                pieces, last = [], 0
                for kind, s, e in sorted(reconcile(t, base_spans(t), f), key=lambda x: (x[1], -x[2])):
                    if s >= last:
                        pieces += [t[last:s], f"<{KINDS[kind]}>"]
                        last = e
                    elif e > last:   # overlaps the span before: its rest goes too
                        last = e
                out.append(None if raw is None else "".join(pieces + [t[last:]]))
            cols = list(b.columns)
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return map_arrow(docs, run, schema)
