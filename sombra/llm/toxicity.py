"""Operator 8: toxicity by a subsequence string kernel.

Words are compared by the gap-weighted subsequence kernel (all common
subsequences of ``ORDER`` characters, each weighted by DECAY to the length it
spans in both words, normalised), so an insult with gaps, inserted characters
or other endings stays close to the insult; a word is also compared without its
non-letters, as a mark between all letters leaves little of the kernel.  Nystroem landmarks are words of
the training rows whose presence tells the classes apart.  A sentence is the
largest kernel value of its words with each landmark (values below ``FLOOR``
count as 0), mapped by K^(-1/2) of the landmarks; a linear support vector
machine is trained on labelled sentences: a labelled document stands for its
highest-scoring sentence, found again after each round.  A document's score is
the calibrated margin of its highest sentence, over the whole text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, id_text, map_arrow, slices, text_bytes, word_hashes, word_spans, worker_cache

ORDER, DECAY, FLOOR = 3, 0.6, 0.25
LANDMARKS = 40
ALIKE = 0.4              # a landmark resembles no earlier one more than this
SAMPLE = 8000            # labelled rows the classifier is fitted on, at most
LONGEST = 24             # longer words are cut into overlapping pieces
MEMO = 400_000

_STOPS = np.frombuffer(b".!?", np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_EDGES = re.compile(r"^\W+|\W+$")
_MARKS = re.compile(r"[\W\d_]+")


def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words (rows, padded with 0) and their lengths."""
    width = max((len(w) for w in words), default=1) or 1
    flat = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        flat[i, :len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.array([len(w) for w in words], np.int64)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Unnormalised kernel of row pairs: code point rows, 0 as padding."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    lam = np.float32(decay)
    lam2 = lam * lam
    same = [[(s[:, i] == t[:, j]) & (s[:, i] != 0) for j in range(lt)] for i in range(ls)]
    # prime[j]: weight of common subsequences so far of s[:i], t[:j], its gaps
    # counted to the end of both
    prime = [[np.ones(n, np.float32)] * (lt + 1) for _ in range(ls + 1)]
    for _ in range(order - 1):
        nxt = [[np.zeros(n, np.float32)] * (lt + 1)]
        for i in range(1, ls + 1):
            row, run = [np.zeros(n, np.float32)], np.zeros(n, np.float32)
            for j in range(1, lt + 1):
                run = lam * run + np.where(same[i - 1][j - 1], lam2 * prime[i - 1][j - 1], np.float32(0))
                row.append(lam * nxt[i - 1][j] + run)
            nxt.append(row)
        prime = nxt
    total = np.zeros(n, np.float32)
    for i in range(1, ls + 1):
        for j in range(1, lt + 1):
            total += np.where(same[i - 1][j - 1], lam2 * prime[i - 1][j - 1], np.float32(0))
    return total


def self_kernel(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.float64)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for lo in range(0, len(order), 4096):
        part = order[lo:lo + 4096]
        code, _ = encode_words([words[i] for i in part])
        out[part] = subsequence_kernel(code, code)
    return out


class Landmarks:
    """Kernel values of words with a fixed list of landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.code, self.lens = encode_words(words)
        self.own = self_kernel(words) if words else np.empty(0)
        self.bits = letter_bits(self.code)

    def features(self, words: list[str]) -> np.ndarray:
        """Normalised kernel (words x landmarks); pairs that share fewer than
        ORDER different letters, or fewer than half of the landmark's, and
        values below FLOOR, are 0."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not words or not self.words:
            return out
        order = np.argsort([len(w) for w in words], kind="stable")
        for lo in range(0, len(order), 8192):
            part = order[lo:lo + 8192]
            code, lens = encode_words([words[i] for i in part])
            bits = letter_bits(code)
            live = [np.flatnonzero(np.bitwise_count(bits & b) >= max(ORDER, -(-int(b).bit_count() // 2))) for b in self.bits]
            if not any(len(x) for x in live):
                continue
            need = np.unique(np.concatenate(live))
            own = np.ones(len(part))
            own[need] = subsequence_kernel(code[need], code[need])
            for k, rows in enumerate(live):
                if len(rows):
                    t = np.broadcast_to(self.code[k, :self.lens[k]], (len(rows), self.lens[k]))
                    v = subsequence_kernel(t, code[rows]) / np.sqrt(np.maximum(own[rows] * self.own[k], 1e-12))
                    out[part[rows], k] = np.where(v >= FLOOR, v, 0)
        return out


def letter_bits(code: np.ndarray) -> np.ndarray:
    """A 64-bit set of the characters of each row (folded beyond ASCII)."""
    bit = np.where(code > 0, np.uint64(1) << (code.astype(np.uint64) & np.uint64(63)), np.uint64(0))
    return np.bitwise_or.reduce(bit, axis=1)


def clean(word: str) -> list[str]:
    """A raw word without edge punctuation, in pieces of LONGEST at most."""
    w = _EDGES.sub("", word)
    if len(w) < ORDER:
        return []
    if len(w) <= LONGEST:
        return [w]
    return [w[i:i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]


def forms(word: str) -> list[str]:
    """The pieces of a raw word as written and without its non-letters."""
    pieces = clean(word)
    if not word.isalpha():
        pieces += [p for p in clean(_MARKS.sub("", word)) if p not in pieces]
    return pieces


class Reader:
    """Sentence features of texts.  Words are told apart by vectorised hashes
    and each distinct one is compared with the landmarks once; a bounded memo
    per worker keeps the feature rows of the words met first."""

    def __init__(self, landmarks: list[str]):
        self.marks = Landmarks(landmarks)
        self.memo: dict[bytes, int] = {}
        self.rows = np.zeros((1, len(landmarks)), np.float32)      # row 0: all zero

    def _numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(feature rows, row number of each distinct word)."""
        got = list(map(self.memo.get, words))
        new = [k for k, g in enumerate(got) if g is None]
        rows = self.rows
        if new:
            pieces, owner = [], []
            for n, k in enumerate(new):
                for p in forms(words[k].decode().lower()):
                    pieces.append(p)
                    owner.append(n)
            feats = self.marks.features(pieces)
            live = np.flatnonzero(feats.any(1))
            at = np.array(owner, np.int64)[live] if len(live) else np.empty(0, np.int64)
            heads = np.flatnonzero(np.diff(at, prepend=-1))         # pieces of a word lie together
            number = np.zeros(len(new), np.int64)
            if len(heads):
                number[at[heads]] = len(rows) + np.arange(len(heads))
                rows = np.concatenate([rows, np.maximum.reduceat(feats[live], heads)])
            for n, k in zip(number.tolist(), new, strict=True):
                got[k] = n
            if len(self.memo) + len(new) <= MEMO:
                self.memo.update((words[k], got[k]) for k in new)
                self.rows = rows
        return rows, np.array(got, np.int64)

    def pooled(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(feature rows of sentences that are not all zero, their texts'
        numbers), in text order."""
        out, owner = [np.zeros((0, len(self.marks.words)), np.float32)], [np.empty(0, np.int64)]
        for i, j in slices(col, 1 << 20):
            f, r = self._slice(*text_bytes(col, i, j))
            out.append(f)
            owner.append(r + i)
        return np.concatenate(out), np.concatenate(owner)

    def _slice(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e, row = word_spans(buf, off)
        if not len(s):
            return np.zeros((0, len(self.marks.words)), np.float32), np.empty(0, np.int64)
        raw = LOWER[buf].tobytes()
        _, first, inv = np.unique(word_hashes(buf, s, e), return_index=True, return_inverse=True)
        rows, number = self._numbers([raw[x:y] for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)])
        number = number[inv]
        # a sentence ends after . ! ? or at a line end
        lines = np.cumsum(buf == 10)
        stop = np.isin(buf[e - 1], _STOPS)
        part = lines[s] + np.concatenate([[0], np.cumsum(stop)[:-1]])
        # three or more single letters in a row are read as one word
        spelt: dict[int, str] = {}
        one = (e - s == 1) & _LETTER[buf[s]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], one.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= ORDER and row[a] == row[b - 1]:
                spelt[a] = "".join(chr(raw[x]) for x in s[a:b])
        if spelt:
            more, at = self._numbers([w.encode() for w in spelt.values()])
            number[list(spelt)] = np.where(at > 0, at + len(rows), number[list(spelt)])
            rows = np.concatenate([rows, more])
        hit = np.flatnonzero(number)
        if not len(hit):
            return np.zeros((0, len(self.marks.words)), np.float32), np.empty(0, np.int64)
        begin = np.flatnonzero(np.diff(row[hit], prepend=-1) | np.diff(part[hit], prepend=-1))
        return np.maximum.reduceat(rows[number[hit]], begin), row[hit][begin]

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its sentences' feature rows that are not all zero."""
        rows, owner = self.pooled(pa.array(texts, pa.string()))
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [rows[cut[i]:cut[i + 1]] for i in range(len(texts))]


_READERS: dict[tuple, Reader] = worker_cache(__name__)


def reader(landmarks: list[str]) -> Reader:
    key = tuple(landmarks)
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(landmarks)
    return _READERS[key]


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------

def svm(X: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by accelerated gradient steps."""
    n, d = X.shape
    A = np.concatenate([X, np.ones((n, 1))], 1)
    s = np.where(y > 0, 1.0, -1.0)
    total = weight.sum()
    lip = 2 * (np.linalg.norm(A * np.sqrt(weight / total)[:, None], 2) ** 2 + penalty)
    w = z = np.zeros(d + 1)
    t = 1.0
    reg = np.full(d + 1, penalty)
    reg[-1] = 0
    for _ in range(steps):
        slack = np.maximum(0, 1 - s * (A @ z))
        grad = -2 * (A * (weight * slack * s / total)[:, None]).sum(0) + 2 * reg * z
        new = z - grad / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the score 1 / (1 + exp(-(a * margin + b))): one half lies
    midway between the margins around the cut with the best F1, and the slope
    puts nine tenths a quarter of the margins' spread above it."""
    order = np.argsort(-margin, kind="stable")
    m, hits = margin[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + y.sum())
    f1[:-1][m[:-1] == m[1:]] = -1            # a cut lies between different margins
    k = int(f1.argmax())
    cut = (m[k] + m[k + 1]) / 2 if k + 1 < len(m) else m[k] - 0.5
    a = np.log(9.0) / max((m[0] - m[-1]) / 4, 1e-6)
    return float(a), float(-a * cut)


class Model:
    """Landmarks, Nystroem map, weights and calibration."""

    def __init__(self, landmarks: list[str], root: np.ndarray, w: np.ndarray, bias: float, a: float, b: float):
        self.landmarks, self.root, self.w, self.bias, self.a, self.b = landmarks, root, w, bias, a, b
        self.direct = root @ w if len(landmarks) else np.empty(0)

    def margins(self, rows: np.ndarray) -> float:
        """Largest sentence margin; a sentence without features has the bias."""
        return max(self.bias, float((rows @ self.direct).max()) + self.bias) if len(rows) else self.bias

    def score(self, rows: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margins(rows) + self.b, -30, 30))))

    def scores(self, col: pa.Array) -> np.ndarray:
        """Scores of all texts of a string column."""
        rows, owner = reader(self.landmarks).pooled(col)
        margin = np.full(len(col), self.bias)
        if len(rows):
            np.maximum.at(margin, owner, (rows.astype(float) @ self.direct) + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def fold(id_col, mod: int = 5):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled rows outside the
    held-out fold, the ones with the smallest id hash; an id with several
    labels takes the largest."""
    named = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").where(fold("doc_id") != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(*id_text(id_col, text_col)).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows


def choose_landmarks(rows: DataFrame, count: int = LANDMARKS) -> list[str]:
    """Words that tell the classes apart most (by document counts), skipping
    those that resemble a chosen one too much."""
    def words(batches):
        for b in batches:
            w, y, k = [], [], []
            for t, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                raw = t.lower().split()
                # copies of a text mostly share this sketch and then count once
                sketch = min((zlib.crc32(" ".join(raw[i:i + 3]).encode("utf-8", "surrogatepass"))
                              for i in range(max(1, len(raw) - 2))), default=0)
                seen = {p for x in raw for p in clean(x)}
                w += seen
                y += [label] * len(seen)
                k += [sketch] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(y, pa.int64()), pa.array(k, pa.int64())],
                                             names=["word", "toxic", "sketch"])
    total = rows.groupBy("toxic").count().collect()
    n1 = sum(r["count"] for r in total if r["toxic"] == 1)
    n0 = sum(r["count"] for r in total if r["toxic"] != 1)
    if not n0 or not n1:
        return []
    counts = (map_arrow(rows.select("text", "toxic"), words, "word string, toxic long, sketch long")
              .distinct().groupBy("word").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("t"),
                                   F.sum((F.col("toxic") != 1).cast("long")).alias("c")).where("t >= 3"))
    # deviance of the word's toxic share from the base rate: a Chernoff bound on
    # its chance, which must hold for all candidate words at once
    base = n1 / (n0 + n1)
    dev = F.expr(f"t * ln(t / (t + c) / {base!r}) + if(c = 0, 0D, c * ln(c / (t + c) / {1 - base!r}))")
    counts = counts.where(f"t / (t + c) > {base!r}").withColumn("dev", dev)
    least = float(np.log(max(counts.count(), 1))) + 3.0
    top = [r["word"] for r in counts.where(F.col("dev") >= least).orderBy(F.desc("dev"), "word").limit(20 * count).collect()]
    chosen: list[str] = []
    for w in top:
        if chosen:
            marks = Landmarks(chosen)
            if marks.features([w]).max() > ALIKE:
                continue
        chosen.append(w)
        if len(chosen) == count:
            break
    return chosen


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text", rounds: int = 3) -> Model:
    """Fit on a bounded sample of labelled rows (``sample`` is the bound)."""
    rows = training_rows(docs, labels, sample, id_col, text_col)
    marks = choose_landmarks(rows)
    if not marks:      # no rows, one class, or no word that tells them apart
        share = rows.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model([], np.empty((0, 0)), np.empty(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    d = len(marks)

    def feats(batches):
        r = reader(marks)
        for b in batches:
            s = r.sentences(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(b.column("toxic").to_pylist(), pa.int64()),
                 pa.array([x[np.lexsort(x.T)].tobytes() for x in s], pa.binary())], names=["doc_id", "toxic", "rows"])
    got = sorted((r["doc_id"], r["toxic"], bytes(r["rows"])) for r in map_arrow(
        rows.select("doc_id", "text", "toxic"), feats, "doc_id long, toxic long, rows binary").collect())
    y = np.array([t == 1 for _, t, _ in got], float)
    bags = [np.frombuffer(r, np.float32).reshape(-1, d).astype(float) for _, _, r in got]
    lm = Landmarks(marks)
    K = lm.features(marks).astype(float)
    K = (K + K.T) / 2
    val, vec = np.linalg.eigh(K + 1e-3 * np.eye(d))
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-3))) @ vec.T
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    pick = np.array([b.max(0) if len(b) else np.zeros(d) for b in bags])
    for _ in range(rounds):
        w, bias = svm(pick @ root, y, weight)
        direct = root @ w
        pick = np.array([b[(b @ direct).argmax()] if len(b) else np.zeros(d) for b in bags])
    model = Model(marks, root, w, bias, 1.0, 0.0)
    margin = np.array([model.margins(b) for b in bags])
    model.a, model.b = calibrate(margin, y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, whole texts.

    Null or empty text scores as a text without any landmark; a null id is
    never held out.  Score depends on the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and a few hundred floats

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(b.column("text")))],
                                             names=["doc_id", "score"])
    scored = map_arrow(docs.select(*id_text(id_col, text_col)), run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under one half, with all their
    columns; no row moves between tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            ok = np.flatnonzero(shared.value.scores(b.column(at).fill_null("")) < 0.5)
            if len(ok):
                yield b.take(pa.array(ok))
    return map_arrow(docs, run, docs.schema)
