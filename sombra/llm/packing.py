"""Operator 7: packing documents into training sequences.

Documents are ordered along a space-filling curve: token ids are hashed into a
signed random projection of a few dimensions, the projections are scaled by
the corpus mean and deviation to a grid, and the cell's Hilbert index is the
sort key.  Documents are range-sorted by (key, hash of the id) - a key shared
by any number of copies is split over partitions by the hash - and neighbours
on the curve are packed one after another into sequences of at most
``length`` tokens.  A document is cut where a sequence ends.  The last, partial
sequence of a partition is cut into sequences whose lengths are powers of two,
which need no padding, so no sequence is padded at all.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TOKENIZER, id_text, map_arrow, materialise, slices, text_bytes, tokenizer_path

END_ID = 1
DIMS, BITS = 4, 8
MEMO = 800_000


def projection(vocab: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """A random sign per token id and dimension, as 0 or 1; two dimensions share
    a word, 32 bits each, so one sum over a document's tokens serves both."""
    r = np.random.Generator(np.random.PCG64(seed))
    up = r.integers(0, 2, (vocab, dims)).astype(np.int64)
    return np.ascontiguousarray((up[:, 0::2] | up[:, 1::2] << 32).T)


def project(found: list[np.ndarray], up: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Mean sign of each document's tokens per dimension (documents of at least
    one token), gathered for many documents at a time."""
    n = np.array([len(x) for x in found], np.int64)
    ends = np.cumsum(n)
    out = np.empty((len(n), 2 * len(up)))
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, "right")))
        flat = np.concatenate(found[i:j])
        begin = ends[i:j] - n[i:j] - (ends[i] - n[i])
        for k, row in enumerate(up):
            sums = np.add.reduceat(row[flat], begin)
            out[i:j, 2 * k], out[i:j, 2 * k + 1] = sums & 0xFFFFFFFF, sums >> 32
        i = j
    return 2.0 * out / n[:, None] - 1.0


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer grid cells (rows, dims), by inverse undo of the
    curve's rotations bit plane by bit plane, then Gray decoding."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)                       # ASCII marks but for the apostrophe
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False


def piece_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the pieces of texts: what stands between ASCII white
    space, cut between a Latin letter and an ASCII mark.  A run of letters and
    a run of marks are never one pre-token, but for contractions, which begin
    with an apostrophe; so the marks after a word do not make it another word."""
    if not len(buf):
        z = np.empty(0, np.int64)
        return z, z, z
    ends = _LETTER[buf]
    ends[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    starts = _LETTER[buf]
    starts[:-1] |= (buf[:-1] == 0xC3) & ends[1:]
    mark = _MARK[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    cut[1:-1] |= (ends[:-1] & mark[1:]) | (mark[:-1] & starts[1:])
    solid = ~_SPACE[buf]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    stop[:-1] &= ~solid[1:] | cut[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(off, s, "right") - 1


class Ids:
    """Token ids of texts by the tokenizers library.

    No pre-token of the vocabulary crosses white space and it ignores case, so
    a text's ids are those of its lower-cased pieces (:func:`piece_spans`), one
    after another.  Arrow numbers the distinct pieces of a few MB of text, the
    library encodes each distinct one once, and a bounded memo per Python
    worker keeps the encodings.  A text that may hold a special
    token (their case matters) goes to the library whole."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.final = np.zeros(self.size, bool)
        for token, i in self.tok.get_vocab().items():
            self.final[i] = token.endswith("</w>")
        self.memo: dict[bytes, int] = {}
        self.off = np.zeros(1, np.int64)          # encoding k is data[off[k]:off[k + 1]]
        self.data = np.empty(0, self.kind)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids per word).  Words of letters
        only are one pre-token each and go to the library in lines of a hundred,
        cut again where a word-end token stands."""
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        rest = [k for k, w in enumerate(words) if not w.isalpha()]
        lines = [" ".join([words[k] for k in plain[lo:lo + 100]]) for lo in range(0, len(plain), 100)]
        ids, ends = self._ids(lines)
        stop = np.flatnonzero(self.final[ids]) + 1
        if len(stop) != len(plain):            # letters that fall apart when normalised
            rest, plain, stop, ids = list(range(len(words))), [], stop[:0], ids[:0]
        more, ends = self._ids([words[k] for k in rest])
        lens = np.empty(len(words), np.int64)
        lens[plain] = np.diff(stop, prepend=0)
        lens[rest] = np.diff(ends, prepend=0)
        begin = np.empty(len(words), np.int64)
        begin[plain] = stop - lens[plain]
        begin[rest] = ends - lens[rest] + len(ids)
        both = np.concatenate([ids, more])
        within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        return both[np.repeat(begin, lens) + within], lens

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        return np.fromiter(chain.from_iterable(got), self.kind, int(ends[-1]) if len(ends) else 0), ends

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data, begin, length) of the encodings of distinct words; words met
        while the memo is full are encoded for this call only."""
        got = list(map(self.memo.get, words))
        new = [k for k, g in enumerate(got) if g is None]
        data, off = self.data, self.off
        if new:
            ids, lens = self.encode([words[k].decode() for k in new])
            base = len(off) - 1
            for n, k in enumerate(new, base):
                got[k] = n
            off = np.concatenate([off, off[-1] + np.cumsum(lens)])
            data = np.concatenate([data, ids])
            if len(self.memo) + len(new) <= MEMO:
                self.memo.update((words[k], got[k]) for k in new)
                self.data, self.off = data, off
        at = np.array(got, np.int64)
        return data, off[at], off[at + 1] - off[at]

    def __call__(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column, ``END_ID`` last."""
        out: list[np.ndarray] = []
        for i, j in slices(col, 4 << 20):
            out += self._slice(*text_bytes(col, i, j))
        return out

    def _slice(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        s, e, row = piece_spans(buf, off)
        pieces = np.zeros(len(s) + 1, np.int64)
        np.cumsum(e - s, out=pieces[1:])
        # pieces leave out white space only
        solid = LOWER[buf[~_SPACE[buf]]]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(pieces), pa.py_buffer(solid)]).dictionary_encode()
        data, begin, size = self._ids_of(found.dictionary.to_pylist())
        inv = found.indices.to_numpy()
        width = size[inv]
        texts = len(off) - 1
        stop = np.cumsum(width)
        ends = np.cumsum(np.bincount(row, width, minlength=texts).astype(np.int64) + 1)
        at = np.repeat(begin[inv] - stop + width, width)
        at += np.arange(len(at))
        flat, inside = np.full(ends[-1], END_ID, self.kind), np.ones(ends[-1], bool)
        inside[ends - 1] = False
        flat[inside] = data[at]
        found = np.split(flat, ends[:-1])
        mark = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))        # "<|"
        for r in np.unique(np.searchsorted(off, mark, "right") - 1).tolist():
            found[r] = self.whole(buf[off[r]:off[r + 1]].tobytes())
        return found

    def whole(self, raw: bytes) -> np.ndarray:
        ids = self.tok.encode(raw.decode(), add_special_tokens=False).ids
        return np.array([*ids, END_ID], self.kind)


_LOADED: dict[str, Ids] = {}


def tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids binary uint16/32, p0..): ids with the end id, and the
    mean signed projection of the document's hashed tokens."""
    def run(batches):
        path = vocabulary or tokenizer_path(TOKENIZER)
        if path not in _LOADED:
            _LOADED[path] = Ids(path)
        ids_of = _LOADED[path]
        signs = projection(ids_of.size)
        for b in batches:
            found = ids_of(b.column("text"))
            n = [len(x) for x in found]
            packed = [x.tobytes() for x in found]
            proj = project(found, signs)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())]
                + [pa.array(proj[:, k]) for k in range(DIMS)],
                names=["doc_id", "n", "ids", *(f"p{k}" for k in range(DIMS))])
    cols = ", ".join(f"p{k} double" for k in range(DIMS))
    return map_arrow(docs.select(*id_text(id_col, text_col)), run, f"doc_id long, n long, ids binary, {cols}")


def curve_key(toks: DataFrame) -> tuple[DataFrame, int]:
    """(``toks`` with its Hilbert key, number of tokens); the grid is scaled by
    the corpus' mean and deviation per dimension (one row of statistics)."""
    names = [f"p{k}" for k in range(DIMS)]
    stats = toks.agg(F.sum("n").alias("total"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    mean = np.array([stats[f"m_{c}"] or 0.0 for c in names])
    dev = np.array([stats[f"s_{c}"] or 0.0 for c in names])
    dev[dev == 0] = 1.0

    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(b.column(c)) for c in names], 1)
            cell = np.clip(((x - mean) / dev + 3.0) / 6.0 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            keep = [c for c in b.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(hilbert(cell))], names=[*keep, "key"])
    return map_arrow(toks, run, "doc_id long, n long, ids binary, key long"), stats["total"] or 0


def powers(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, length: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id",
         text_col: str = "text", tokens_per_task: int = 4 << 20) -> DataFrame:
    """(doc_id, start, length, ids binary uint32, doc_tokens, sequence_id,
    offset): one row per piece; each id of each document row lies in one piece.

    ``length`` must be a power of two.  Null or empty text: its end id alone.
    Null ids stay null; repeated rows are packed each; an empty table gives no
    rows.  sequence_id numbers are unique, not dense."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    toks = materialise(tokens(docs, vocabulary, id_col, text_col), "tokens")
    keyed, total = curve_key(toks)
    parts = max(1, -(-total // tokens_per_task))
    ranged = (keyed.withColumn("tie", F.xxhash64("doc_id"))
              .repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie", "doc_id", "n", "ids"))

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        seq, fill, tail = 0, 0, []   # tail: pieces of the open sequence

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array([x.astype("<u4").tobytes() for x in cols[3]], pa.binary()), pa.array(cols[4], pa.int64()),
                 pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        rows = []
        for b in batches:
            for doc, n, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(),
                                   b.column("ids").to_pylist(), strict=True):
                x = np.frombuffer(raw, f"<u{len(raw) // n}")
                at = 0
                while at < n:
                    take = min(n - at, length - fill)
                    tail.append((doc, at, take, x[at:at + take], n, base + seq, fill))
                    at += take
                    fill += take
                    if fill == length:
                        rows += tail
                        tail, fill = [], 0
                        seq += 1
                if len(rows) >= 2000:
                    yield batch(rows)
                    rows = []
        # the open sequence: cut at powers of two
        cuts, at = powers(fill), 0
        ends = np.cumsum(cuts).tolist()
        k = 0
        for doc, start, take, x, n, _, _ in tail:
            done = 0
            while done < take:
                step = min(take - done, ends[k] - at)
                rows.append((doc, start + done, step, x[done:done + step], n, base + seq + k, at - (ends[k] - cuts[k])))
                done += step
                at += step
                if at == ends[k]:
                    k += 1
        if rows:
            yield batch(rows)

    return map_arrow(
        ranged.select("doc_id", "n", "ids"), run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
