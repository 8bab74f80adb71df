"""Operator 12: substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document; it recurs if its word
sequence starts at two places or more.

1. **Candidates.**  Every window picks the smallest hash among its ``GRAM``-word
   phrases (the leftmost of equal ones): its anchor.  Equal windows pick equal
   anchors, and neighbouring windows mostly the same one, so a document is a
   sequence of segments, each the run of windows that share one anchor.  Only
   (anchor, segment digest) is counted, pre-aggregated per block of documents.
   A window whose anchor occurs once cannot recur.
2. **Confirmation.**  A segment that occurs twice as a whole recurs with all its
   windows.  Where an anchor recurs in different segments, the windows of those
   segments are counted one by one under their anchor; segments that recur as
   a whole take part once, from one block that holds them.
3. **Location.**  Each block of documents is a shard with an Aho-Corasick
   automaton (pyahocorasick, over words): the recurring passages confirmed for
   it, cut into phrases of ``WINDOW`` words that cover them.  All documents of
   the block are streamed through it and every occurrence of a phrase marks
   its words for removal.  A document is located as soon as all its segments
   are settled, the others once their windows are.

Counts saturate at two, as "twice or more" is all that is asked; hashes of
segments and windows are 64 bits beside the anchor's 64.  Blocks are runs of
``RUN`` rows of one file, so they do not depend on how a scan is split; an input
that is not a file scan is staged first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_arrow, materialise, mix64, slices, text_bytes, word_hashes, word_spans

WINDOW = 35
GRAM = 8
RUN = 512
SLICE = 4 << 20

_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)


# ---------------------------------------------------------------------------
# Words, anchors and segments of some documents
# ---------------------------------------------------------------------------

class Words:
    """The words of rows i..j of a text column, unchanged."""

    def __init__(self, col: pa.Array, i: int, j: int):
        self.buf, off = text_bytes(col, i, j)
        self.rows = j - i
        self.s, self.e, self.row = word_spans(self.buf, off)
        self.hash = word_hashes(self.buf, self.s, self.e, lower=False)
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self._sums = None

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Polynomial digests of the word runs lo..hi (end exclusive)."""
        if self._sums is None:
            n = len(self.hash)
            with np.errstate(over="ignore"):
                up = np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(_B))]).cumprod(dtype=np.uint64)
                self._down = np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(_INV))]).cumprod(dtype=np.uint64)
                self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * up[:n], dtype=np.uint64)])
        with np.errstate(over="ignore"):
            return mix64((self._sums[hi] - self._sums[lo]) * self._down[lo] + (hi - lo).astype(np.uint64))

    def windows(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, place of the anchor, hash of the anchor) of every window."""
        n = len(self.hash)
        if n < size:
            z = np.empty(0, np.int64)
            return z, z, np.empty(0, np.uint64)
        m = n - gram + 1
        h = self.digests(np.arange(m), np.arange(m) + gram)
        best, span, want = np.arange(m), 1, size - gram + 1
        while span < want:
            step = min(span, want - span)
            left, right = best[:-step], best[step:]
            best = np.where(h[right] < h[left], right, left)
            span += step
        start = np.flatnonzero(self.row[:n - size + 1] == self.row[size - 1:])
        return start, best[start], h[best[start]]


def segments(start: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where runs of windows with one anchor begin (indices into ``start``)."""
    if not len(start):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1)]))


class Cut:
    """Windows and segments of some words."""

    def __init__(self, words: Words, size: int, gram: int):
        self.words, self.size = words, size
        self.start, place, self.anchor = words.windows(size, gram)
        self.seg = segments(self.start, place)
        ends = np.append(self.seg[1:], len(self.start))[:len(self.seg)] - 1
        lo = self.start[self.seg]
        with np.errstate(over="ignore"):  # the anchor's place in its segment counts too
            self.digest = mix64(words.digests(lo, self.start[ends] + size)
                                + (place[self.seg] - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.seg_of = np.repeat(np.arange(len(self.seg)), np.diff(np.append(self.seg, len(self.start))))
        self.seg_anchor = self.anchor[self.seg]
        self.seg_row = words.row[lo]

    def window_digests(self, which: np.ndarray) -> np.ndarray:
        return self.words.digests(self.start[which], self.start[which] + self.size)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + b.view(np.uint64))


def tally(*cols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns and their counts, at most 2."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    n = len(order)
    if not n:
        return cols, np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in cols], np.minimum(np.diff(np.append(at, n)), 2)


# ---------------------------------------------------------------------------
# The automaton of a block, and what it removes
# ---------------------------------------------------------------------------

def locate(words: Words, recurs: np.ndarray, size: int) -> np.ndarray:
    """Marks the words that a recurring passage covers; ``recurs`` marks the
    starts of windows confirmed for these documents."""
    import ahocorasick

    covered = np.zeros(len(words.hash), bool)
    at = np.flatnonzero(recurs)
    if not len(at):
        return covered
    _, ids = np.unique(words.hash, return_inverse=True)
    ids = (ids + 1).tolist()
    # phrases that tile each passage: every size-th window of a run, and its last
    begin = np.concatenate([[True], (np.diff(at) != 1) | (words.row[at[1:]] != words.row[at[:-1]])])
    run = np.flatnonzero(begin)
    nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    last = np.append(begin[1:], True)
    shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for s in at[(nth % size == 0) | last].tolist():
        shard.add_word(tuple(ids[s:s + size]))
    shard.make_automaton()
    edge = np.zeros(len(ids) + 1, np.int64)
    hits = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= size:
            hits += [lo + end for end, _ in shard.iter(tuple(ids[lo:hi]))]
    hits = np.array(hits, np.int64)
    np.add.at(edge, hits - size + 1, 1)
    np.add.at(edge, hits + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_digests(words: Words, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per document: words, words removed, sha256 of the kept ones joined by
    single spaces."""
    n = np.diff(words.first)
    removed = np.add.reduceat(np.append(covered, False).astype(np.int64), words.first[:-1]) if words.rows else n
    removed = np.where(n > 0, removed, 0)
    keep = np.flatnonzero(~covered)
    s, length = words.s[keep], words.e[keep] - words.s[keep] + 1
    ends = np.cumsum(length)
    take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - s, length)
    out = np.append(words.buf, np.uint8(32))[take] if len(take) else np.empty(0, np.uint8)
    if len(ends):
        out[ends - 1] = 32
    cut = np.concatenate([[0], ends])[np.searchsorted(words.row[keep], np.arange(words.rows + 1))].tolist()
    data = memoryview(np.ascontiguousarray(out))
    return n, removed, [hashlib.sha256(data[a:max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


# ---------------------------------------------------------------------------
# Documents in blocks
# ---------------------------------------------------------------------------

def in_blocks(docs: DataFrame) -> DataFrame:
    """(blk, doc_id, text): rows with the number of their block."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")]

    def numbered(df: DataFrame) -> DataFrame:
        place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / RUN))
        return df.select(F.shiftright(place, 2).alias("blk"), *cols)  # two bits are left for a count

    try:
        return numbered(docs)
    except AnalysisException:  # not a file scan
        return numbered(materialise(docs.select("doc_id", "text"), "repeats-docs"))


def _runs(col: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(col)) + 1, [len(col)]])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0]


def packed_blocks(docs: DataFrame) -> DataFrame:
    """(blk, payload): documents compressed by block, for moving."""
    def run(batches):
        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(c) for c in ("blk", "doc_id", "text")], names=["blk", "doc_id", "text"])
            blk = b.column("blk").to_numpy()
            parts = [(int(blk[i]), pack(b.select(["doc_id", "text"]).slice(i, j - i))) for i, j in _runs(blk)] if len(blk) else []
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()),
                                              pa.array([p[1] for p in parts], pa.binary())], names=["blk", "payload"])

    return map_arrow(docs, run, "blk long, payload binary")


# ---------------------------------------------------------------------------
# Steps
# ---------------------------------------------------------------------------

def segment_counts(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(a, g, bn): anchor and digest of the segments of each block; ``bn`` holds
    the block and, in its two low bits, the count."""
    def run(batches):
        for b in batches:
            col, blk = b.column("text"), b.column("blk").to_numpy()
            for i, j in slices(col, SLICE):
                cut = Cut(Words(col, i, j), size, gram)
                (a, g, k), n = tally(cut.seg_anchor.view(np.int64), cut.digest.view(np.int64), blk[i:j][cut.seg_row])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(g), pa.array(k * 4 + n)], names=["a", "g", "bn"])

    return map_arrow(docs.select("blk", "text"), run, "a long, g long, bn long")


WHOLE, SOURCE, OPEN = 1, 2, 0


def segment_states(counts: DataFrame) -> DataFrame:
    """(blk, a, g, state) of segments whose anchor recurs: recurring as a whole
    (of those whose anchor has other segments, one block is the source), or open."""
    again = (counts.groupBy("a").agg(F.sum(F.expr("bn & 3")).alias("n"), (F.min("g") != F.max("g")).alias("mixed"))
             .where("n > 1").select("a", "mixed"))
    live = materialise(counts.join(again, "a"), "repeats-segments")
    by_segment = live.groupBy("a", "g").agg(F.sum(F.expr("bn & 3")).alias("total"), F.min("bn").alias("owner"))
    state = (F.when(F.col("total") < 2, OPEN)
             .when(F.col("mixed") & (F.col("owner") == F.col("bn")), SOURCE).otherwise(WHOLE))
    return live.join(by_segment, ["a", "g"]).select(F.shiftright("bn", 2).alias("blk"), "a", "g", state.alias("state"))


SETTLED = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_OUT = f"kind int, blk long, a long, w long, n int, payload binary, {SETTLED}"
DONE, LATER, COUNT = 0, 1, 2


def _rows(kind: int, rows: int, **cols) -> pa.Table:
    kinds = {"blk": pa.int64(), "a": pa.int64(), "w": pa.int64(), "n": pa.int32(), "payload": pa.binary(),
             "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
    return pa.table({"kind": pa.array([kind] * rows, pa.int32()),
                     **{c: pa.array(cols[c], t) if c in cols else pa.nulls(rows, t) for c, t in kinds.items()}})


def _settle(docs: pa.RecordBatch, words: Words, recurs: np.ndarray, size: int) -> dict:
    n, removed, digest = kept_digests(words, locate(words, recurs, size))
    return {"doc_id": docs.column("doc_id"), "n_words": n, "n_removed": removed, "kept_sha256": digest}


def settle_or_count(size: int, gram: int):
    def run(packed: pa.Table, states: pa.Table) -> pa.Table:
        known = pair_keys(states["a"].to_numpy(), states["g"].to_numpy())
        state = states["state"].to_numpy()
        order = np.lexsort((-state, known))  # a block may hold a segment in two rows: the source first
        known, state = known[order], state[order]
        out, found = [_rows(DONE, 0)], []
        for payload in packed["payload"].to_pylist():
            batch = unpack(payload)
            for i, j in slices(batch.column("text"), SLICE):
                docs = batch.slice(i, j - i)
                words = Words(docs.column("text"), 0, j - i)
                cut = Cut(words, size, gram)
                key = pair_keys(cut.seg_anchor, cut.digest)
                at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                hit = known[at] == key if len(known) else np.zeros(len(key), bool)
                seg = np.where(hit, state[at] if len(known) else -1, -1)
                win = seg[cut.seg_of] if len(seg) else np.empty(0, np.int64)
                count = np.flatnonzero((win == OPEN) | (win == SOURCE))
                found.append((cut.anchor[count].view(np.int64), cut.window_digests(count).view(np.int64),
                              np.where(win[count] == SOURCE, 2, 1)))
                recurs = np.zeros(len(words.hash), bool)
                recurs[cut.start[(win == WHOLE) | (win == SOURCE)]] = True
                later = np.zeros(j - i, bool)
                later[cut.seg_row[seg == OPEN]] = True
                now = _settle(docs, words, recurs & ~later[words.row], size)
                rest = np.flatnonzero(~later)
                out.append(_rows(DONE, len(rest), **{c: v.take(pa.array(rest)) if c == "doc_id" else
                                                     [v[x] for x in rest.tolist()] for c, v in now.items()}))
                if later.any():
                    sel = np.flatnonzero(later)
                    starts = np.flatnonzero(recurs)
                    mine = [(starts[np.searchsorted(starts, words.first[r]):np.searchsorted(starts, words.first[r + 1])]
                             - words.first[r]).tolist() for r in sel.tolist()]
                    part = docs.take(pa.array(sel))
                    part = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"),
                                                       pa.array(mine, pa.list_(pa.int32()))], names=["doc_id", "text", "starts"])
                    out.append(_rows(LATER, 1, blk=[packed["blk"][0].as_py()], payload=[pack(part)]))
        if found:
            a, w, k = (np.concatenate(x) for x in zip(*found, strict=True))
            (a, w), n = _weighed(a, w, k)
            out.append(_rows(COUNT, len(a), blk=np.full(len(a), packed["blk"][0].as_py() if packed.num_rows else 0),
                             a=a, w=w, n=n.astype(np.int32)))
        return pa.concat_tables(out)

    return run


def _weighed(a: np.ndarray, w: np.ndarray, k: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct (a, w) with the sum of ``k``, at most 2."""
    order = np.lexsort((w, a))
    a, w, k = a[order], w[order], k[order]
    if not len(a):
        return [a, w], k
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])]))
    return [a[at], w[at]], np.minimum(np.add.reduceat(k, at), 2)


def settle_rest(size: int, gram: int):
    def run(packed: pa.Table, windows: pa.Table) -> pa.Table:
        known = np.sort(pair_keys(windows["a"].to_numpy(), windows["w"].to_numpy()))
        out = [_rows(DONE, 0)]
        for payload in packed["payload"].to_pylist():
            docs = unpack(payload)
            words = Words(docs.column("text"), 0, docs.num_rows)
            cut = Cut(words, size, gram)
            recurs = np.zeros(len(words.hash), bool)
            flat = docs.column("starts")
            shift = np.repeat(words.first[:-1], np.diff(flat.offsets.to_numpy()))
            recurs[flat.flatten().to_numpy() + shift] = True
            if len(known):
                key = pair_keys(cut.anchor, cut.window_digests(np.arange(len(cut.start))))
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                recurs[cut.start[known[at] == key]] = True
            out.append(_rows(DONE, docs.num_rows, **_settle(docs, words, recurs, size)))
        return pa.concat_tables(out).select(["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs``: words
    covered by a window of ``size`` words that starts anywhere else too are
    removed, the others joined by single spaces and digested.

    A null text has no words; a text of fewer than ``size`` words keeps them
    all.  Rows that repeat an id, or a whole row, are documents of their own, so
    their windows recur.  A text of any length is one row of one block.  Null
    ids stay null.  An empty table gives no rows."""
    ship_package(docs.sparkSession)
    rows = in_blocks(docs)
    states = materialise(segment_states(segment_counts(rows, size, gram)), "repeats-states")
    first = materialise(packed_blocks(rows).groupBy("blk").cogroup(states.groupBy("blk"))
                        .applyInArrow(settle_or_count(size, gram), _OUT), "repeats-first")
    counts = first.where(F.col("kind") == COUNT).select("blk", "a", "w", "n")
    again = counts.groupBy("a", "w").agg(F.sum("n").alias("n")).where("n > 1").select("a", "w")
    confirmed = counts.join(again, ["a", "w"], "left_semi").select(F.col("blk").alias("of"), "a", "w")
    rest = first.where(F.col("kind") == LATER).select(F.col("blk").alias("part"), "payload")
    located = rest.groupBy("part").cogroup(confirmed.groupBy("of")).applyInArrow(settle_rest(size, gram), SETTLED)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return first.where(F.col("kind") == DONE).select(*names).union(located.select(*names))
