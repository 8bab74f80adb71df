"""Operator 3: language-model scoring by online logistic context mixing.

A text is lower-cased (A-Z), cut into words and coded bit by bit: a word of the
bounded vocabulary (the ``VOCAB`` most frequent training words) by its Huffman
code, any other word by an escape and its share of the training counts outside
the vocabulary.  Every bit is predicted by three context predictors - the code
node alone, the node under the hashed previous word, and the node under the
hashed endings of the two previous words - whose counts are gathered over all
training texts in tables of fixed size.  The predictions are mixed in the
logistic domain by weights gated by bit depth, refined by a learned map, and
weights and a per-gate correction are learned online while a text is read, a
few symbols at a time, starting from weights fitted on all training texts.

The code is complete, so the bits add up to the log probability of the text.
``score`` is in the space of the base score, where all words never seen in
training are one token; ``bits_per_byte`` is the whole text's cost, with the
spelling of never seen words by a complete byte code.

The base score needs the count of every training word.  Counts are a
distributed table; those of vocabulary words are broadcast (bounded), all other
words are joined to the table.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, materialise, slices

VOCAB = 1 << 17
SLOT_BITS = 18
CHUNK = 1 << 12
SLICE = 8 << 20          # bytes of texts cut into words together in a task
WORDS = 150_000          # words whose bits are counted together
DISTINCT = 300_000       # words a task counts before it hands them on
GATHER = 2_000_000       # words (or one text) scored together
LANES = 256              # texts of like length read side by side
SOME = 16_000            # symbols whose bits are looked up at once: they stay in the cache
RATE = 0.06
BLOCK = 16               # symbols of a text read between two weight updates
ROUNDS = 4               # Newton steps for the starting weights
LEVELS, SIDE = 32, 15    # inputs are put in 2 * SIDE + 1 levels to fit their weights, finer towards 0
NEAR = (16.0, 2.0, 2.0)  # how much finer; a Huffman code leaves the node alone little to say
GATES = 8                # bit depths with weights of their own; deeper bits share the last
INPUTS = 3
LN10 = float(np.log(10.0))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def huffman(weights: np.ndarray) -> list[tuple[int, int]]:
    """Parent links of a Huffman tree: for each of 2n - 1 tree nodes (leaves
    first) its (parent, bit); the root's parent is -1."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    link = [(-1, 0)] * max(1, 2 * n - 1)
    at = n
    while len(heap) > 1:
        (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
        link[a], link[b] = (at, 0), (at, 1)
        heapq.heappush(heap, (w0 + w1, at))
        at += 1
    return link


class Code:
    """Huffman codes of the vocabulary (the end is word b"") and the escape."""

    def __init__(self, words: list[bytes], counts: list[int], total: int):
        self.words = words
        self.v = self.escape = len(words)
        rest = max(1, total - sum(counts))
        link = huffman(np.array([*counts, rest]))
        nodes, bits, off = [], [], [0]
        for leaf in range(len(words) + 1):
            path, x = [], leaf
            while link[x][0] >= 0:
                path.append((link[x][0], link[x][1]))
                x = link[x][0]
            for node, bit in reversed(path):
                nodes.append(node)
                bits.append(bit)
            off.append(len(nodes))
        self.n_nodes = len(link)
        self.nodes = np.array(nodes, np.int32)
        self.bits = np.array(bits, np.uint8)
        self.off = np.array(off, np.int64)
        self.lens = np.diff(self.off)
        self.steps = 2 * self.nodes + self.bits                   # node and bit in one number
        self.deep = self.lens.astype(np.uint8 if self.lens.max() < 256 else np.int64)
        depth = np.arange(len(nodes)) - np.repeat(self.off[:-1], self.lens)
        self.sign = np.array([1, -1], np.float32)
        self.gate = np.minimum(depth, GATES - 1).astype(np.uint8)
        self.ending = np.array([int.from_bytes(w[-2:], "little") + (len(w) == 0) * 65536 for w in words] + [65537], np.int64)
        self.known = pa.array(words, pa.binary())
        self.end = words.index(b"") if b"" in words else self.escape
        # lengths of a complete code of bytes and a stop, for unseen words
        spell = np.ones(257, np.int64)
        spell[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)
        spell[256] += len(words)
        tree = huffman(spell)
        self.spelling = np.zeros(257, np.int64)
        for leaf in range(257):
            x = leaf
            while tree[x][0] >= 0:
                self.spelling[leaf] += 1
                x = tree[x][0]

    def spelt(self, words: pa.Array) -> np.ndarray:
        """Bits of each word's bytes and its stop."""
        if not len(words):
            return np.empty(0, np.int64)
        off = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
        cost = self.spelling[np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]]]
        return np.add.reduceat(cost, off[:-1] - off[0]) + self.spelling[256]


def split(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after another, words per text) of a string
    column, lower-cased (Arrow's ASCII functions know the six white space bytes
    and A-Z, which is the definition)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(col))
    words = parts.flatten()
    some = pc.greater(pc.binary_length(words), 0)            # white space at a text's ends leaves empty words
    lens = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lens)), lens)[some.to_numpy(zero_copy_only=False)]
    return words.filter(some).cast(pa.binary()), np.bincount(row, minlength=len(lens))


class Stream:
    """Symbols and contexts of a batch of texts (lists of lower-cased words, or
    all words one after another and their number per text)."""

    def __init__(self, code: Code, texts: list[list[bytes]] | pa.Array, lens: np.ndarray | None = None):
        if lens is None:
            lens = np.array([len(t) for t in texts], np.int64)
            texts = pa.array(chain.from_iterable(texts), pa.binary())
        at = np.arange(len(texts)) + np.repeat(np.arange(len(lens)), lens)      # an end follows each text
        ids = np.full(len(texts) + len(lens), code.end, np.int64)
        ids[at] = pc.fill_null(pc.index_in(texts, value_set=code.known), code.escape).to_numpy()
        self.place(code, ids, lens + 1)
        out = np.flatnonzero(ids[at] == code.escape)
        self.unknown, self.unknown_doc = texts.take(pa.array(out)), self.doc[at[out]]

    @classmethod
    def of(cls, code: Code, ids: np.ndarray, lens: np.ndarray) -> "Stream":
        """Texts given by the vocabulary numbers of their words and their end."""
        out = cls.__new__(cls)
        out.place(code, ids, lens)
        return out

    def place(self, code: Code, ids: np.ndarray, lens: np.ndarray) -> None:
        ends = np.cumsum(lens)
        first = ends - lens
        prev = np.concatenate([[0], ids[:-1]])
        prev[first] = code.v + 1
        t1 = np.concatenate([[0], code.ending[ids[:-1]]])
        t1[first] = -1
        t2 = np.concatenate([[0], t1[:-1]])
        t2[first] = -1
        with np.errstate(over="ignore"):
            self.x1 = prev.astype(np.uint64) * _A
            self.x2 = (t1 * 131072 + t2 + 7).astype(np.uint64) * _A
        self.ids, self.n_docs = ids, len(lens)
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.off = np.concatenate([[0], ends])

    def paths(self, code: Code, at: np.ndarray):
        """Places in the code's paths of the bits of symbols ``at``, and the
        number of bits of each."""
        s = self.ids[at]
        n = code.lens[s]
        ends = np.cumsum(n)
        pos = np.repeat(code.off[s] - ends + n, n)
        pos += np.arange(len(pos))
        return pos, n

    def cells(self, code: Code, at: np.ndarray, pos: np.ndarray, n: np.ndarray):
        """Node and the two contexts' slots of the bits of :meth:`paths`."""
        node = code.nodes[pos]
        return node, slots(np.repeat(self.x1[at], n), node), slots(np.repeat(self.x2[at], n), node)


    def by_depth(self, code: Code, at):
        """Symbols ``at`` by the length of their code, the longest first, so
        that those that reach a depth are the first ones: (their order, how many
        reach each depth, where their paths begin, their two contexts)."""
        s = self.ids[at]
        n = code.deep[s]
        order = np.argsort(n, kind="stable")[::-1]
        many = (len(s) - np.cumsum(np.bincount(n)))[:-1].tolist()
        return order, many, code.off[s[order]], self.x1[at][order], self.x2[at][order]

    def layers(self, code: Code, at):
        """Per depth of the code, (depth, steps of the symbols ``at`` that reach
        so far, their two contexts)."""
        _, many, off, x1, x2 = self.by_depth(code, at)
        for depth, m in enumerate(many):
            yield depth, code.steps.take(off[:m] + depth), x1[:m], x2[:m]


def slots(ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
    return mixed(ctx, node.astype(np.uint64))


def mixed(ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
    h = node + np.uint64(1)
    h ^= ctx
    h *= _B
    h >>= np.uint64(64 - SLOT_BITS)
    return h.view(np.int64)


# ---------------------------------------------------------------------------
# Learning
# ---------------------------------------------------------------------------

def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c) over all training texts; b"" is the end."""
    def run(batches):
        held, rows, size = [], 0, 0
        for b in batches:
            col = b.column("text")
            for lo, hi in slices(col, SLICE):
                found = pc.value_counts(split(col.slice(lo, hi - lo))[0])
                held.append(pa.table([found.field("values"), found.field("counts")], ["word", "c"]))
                held.append(pa.table([pa.array([b""], pa.binary()), pa.array([hi - lo], pa.int64())], ["word", "c"]))
                rows, size = rows + len(found) + 1, size + found.nbytes
                if rows > 2 * DISTINCT or size > 4 * SLICE:
                    held = [added(held)]
                    rows, size = len(held[0]), held[0].nbytes
                    if rows > DISTINCT or size > 2 * SLICE:
                        yield from held[0].to_batches()
                        held, rows, size = [], 0, 0
        if held:
            yield from added(held).to_batches()

    def added(held):
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(
            ["word", "c_sum"]).rename_columns(["word", "c"])
    return map_arrow(train.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, vocab: int) -> tuple[list[bytes], list[int]]:
    """The words with the largest counts, as many as ``vocab`` at most (all
    words of the last count or none), and the end, which comes last."""
    least, room = 1 << 62, vocab
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(vocab).toArrow().to_pylist():
        room -= r["n"]
        if room < 0:
            break
        least = r["c"]
    # at most ``vocab`` rows and the end
    top = counts.where((F.col("c") >= least) | (F.octet_length("word") == 0)).toArrow()
    got = dict(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True))
    end = got.pop(b"", 0)
    ranked = sorted(got.items(), key=lambda x: (-x[1], x[0]))
    return [*(w for w, _ in ranked), b""], [*(c for _, c in ranked), end]


def table_size(code: Code) -> int:
    cells = 2 * (code.n_nodes + 2 * (1 << SLOT_BITS))
    return -(-cells // CHUNK) * CHUNK


def count_bits(code: Code, texts: list[list[bytes]], table: np.ndarray) -> None:
    """Add the bits of texts to a flat (context cell, bit) count table."""
    count_symbols(code, Stream(code, texts), table)


def count_symbols(code: Code, st: Stream, table: np.ndarray) -> None:
    size = 1 << SLOT_BITS
    # of the node alone only how often each symbol comes matters
    often = np.bincount(st.ids, minlength=code.v + 1)
    there = np.flatnonzero(often)
    pos = np.repeat(code.off[there] - (np.cumsum(code.lens[there]) - code.lens[there]), code.lens[there])
    pos += np.arange(len(pos))
    got = np.bincount(code.steps[pos], np.repeat(often[there], code.lens[there]), 2 * code.n_nodes)
    table[:2 * code.n_nodes] += got.astype(table.dtype)
    for lo in range(0, len(st.ids), WORDS):
        hi, k = min(lo + WORDS, len(st.ids)), 0
        keys = np.empty((2, code.lens[st.ids[lo:hi]].sum()), np.int64)
        for i in range(lo, hi, SOME):
            for _, step, *contexts in st.layers(code, slice(i, min(i + SOME, hi))):
                step = step.astype(np.int64)
                node, bit = (step >> 1).view(np.uint64), step & 1
                for key, ctx in zip(keys, contexts, strict=True):
                    cell = mixed(ctx, node)
                    cell <<= 1
                    np.add(cell, bit, out=key[k:k + len(step)])
                k += len(step)
        for key, base in zip(keys, (code.n_nodes, code.n_nodes + size), strict=True):
            table[2 * base:2 * (base + size)] += np.bincount(key, minlength=2 * size).astype(table.dtype)


def summed(train: DataFrame, size: int, add, begin, kind=np.uint32) -> np.ndarray:
    """Whole-number tables of ``size`` cells over all training texts, added up:
    ``add(state, stream, table)`` adds texts to a task's table, then its
    chunks are summed; what moves does not depend on the input's size.
    ``begin()`` gives the code and the state."""
    def local(batches):
        (code, state), table = begin(), np.zeros(size, kind)
        for b in batches:
            col = b.column("text")
            for i, j in slices(col, SLICE):
                add(state, Stream(code, *split(col.slice(i, j - i))), table)
        flat = table.reshape(-1, CHUNK)
        keep = np.flatnonzero(flat.any(1))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array([flat[i].tobytes() for i in keep], pa.binary())],
                                             names=["chunk", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(x, kind).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    parts = map_arrow(train.select("text"), local, "chunk long, counts binary")
    table = np.zeros((size // CHUNK, CHUNK), np.int64)
    for r in map_arrow(parts.repartition("chunk"), total, "chunk long, counts binary").collect():
        table[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return table.ravel()


def bit_counts(train: DataFrame, shared) -> np.ndarray:
    """The count table over all training texts; its size does not depend on the
    input."""
    return summed(train, table_size(shared.value), count_symbols, lambda: (shared.value,) * 2).astype(np.float32)


def inputs(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logistic prediction of a counter, drawn to 0 while it has seen little."""
    n = n0 + n1
    return (np.log((n1 + 0.4) / (n0 + 0.4)) * (n / (n + 1.0))).astype(np.float32)


class Mixer:
    """Context inputs, starting weights and the final map of the mixer."""

    def __init__(self, code: Code, table: np.ndarray):
        size = 1 << SLOT_BITS
        cells = table[:2 * (code.n_nodes + 2 * size)].reshape(-1, 2)
        x = inputs(cells[:, 0], cells[:, 1])
        self.x0, self.xs = x[:code.n_nodes], (x[code.n_nodes:code.n_nodes + size], x[code.n_nodes + size:])
        self.weights = np.full((GATES, INPUTS), 0.4, np.float32)
        self.grid = np.linspace(-8, 8, 33).astype(np.float32)
        self.final = np.repeat(self.grid[None], GATES, 0)

        self.lines()

    def lines(self) -> None:
        """Half of the final map as a line per grid interval: at + by * place."""
        by = np.diff(self.final, axis=1, append=self.final[:, -1:])
        self.by = (by / 2).astype(np.float32).ravel()
        self.at = ((self.final - by * np.arange(33, dtype=np.float32)) / 2).astype(np.float32).ravel()

    def score(self, code: Code, stream: Stream, rate: float = RATE) -> np.ndarray:
        """Cost (natural log units) of each text's bits; weights adapt per
        text and start afresh for the next."""
        # the longest first, so that texts not yet read to the end stay in front
        order = np.argsort(np.diff(stream.off)[:stream.n_docs] * -1, kind="stable")
        left, stop = stream.off[:-1][order], stream.off[1:][order]
        cost = np.zeros(stream.n_docs)
        w = [np.repeat(self.weights[None, :, k], stream.n_docs, 0) for k in range(INPUTS)]
        corr = np.zeros((stream.n_docs, GATES), np.float32)
        one, two, half = np.float32(1), np.float32(2), np.float32(0.5)
        edge, far, mid = np.float32(7.999), np.float32(30), np.float32(16)
        while True:
            m = int(np.count_nonzero(left < stop))
            if not m:
                out = np.empty(stream.n_docs)
                out[order] = cost
                return out
            # all texts advance together, each from its own last update
            n = np.minimum(stop[:m] - left[:m], BLOCK)
            first = np.cumsum(n) - n
            at = np.repeat(left[:m] - first, n) + np.arange(n.sum())
            left[:m] += n
            rank, many, begin, x1, x2 = stream.by_depth(code, at)
            if not many:                # a code of one symbol has no bits
                continue
            # bits stand by depth, those of a text in one order in any batch
            text = np.repeat(np.arange(0, m * GATES, GATES), n)[rank]
            step = code.steps.take(np.concatenate([begin[:k] + d for d, k in enumerate(many)])).astype(np.int64)
            lg = np.concatenate([text[:k] + min(d, GATES - 1) for d, k in enumerate(many)])
            gate = np.repeat(np.minimum(np.arange(len(many)), GATES - 1) * 33, many)
            size, node = m * GATES, step >> 1
            step &= 1
            sign = code.sign.take(step)
            x = [self.x0.take(node)]
            node = node.view(np.uint64)
            x += [self.xs[j].take(mixed(np.concatenate([c[:k] for k in many]), node)) for j, c in enumerate((x1, x2))]
            z = w[0][:m].take(lg)
            z *= x[0]
            for k in range(1, INPUTS):
                y = w[k][:m].take(lg)
                y *= x[k]
                z += y
            # average of the mixed prediction and the learned map of it
            place = np.maximum(z, -edge)
            np.minimum(place, edge, out=place)
            place *= two
            place += mid
            gate += place.astype(np.int64)
            place *= self.by.take(gate)
            place += self.at.take(gate)
            z *= half
            z += place
            z += corr[:m].take(lg)
            z *= sign
            e = np.exp(np.minimum(np.maximum(z, -far), far, out=z), out=z)
            odds = e + one
            err = e / odds
            err *= sign
            np.negative(err, out=err)                         # bit - prediction
            cost[:m] += np.bincount(lg, np.log(odds, out=odds), size).reshape(-1, GATES).sum(1)        # log(1 + e)
            seen = rate / np.sqrt(np.bincount(lg, minlength=size) + 1.0)
            for k in range(INPUTS):
                w[k][:m] += (seen * np.bincount(lg, err * x[k], minlength=size)).astype(np.float32).reshape(-1, GATES)
            corr[:m] += (seen * np.bincount(lg, err, minlength=size)).astype(np.float32).reshape(-1, GATES)


def costs(mixer: Mixer, code: Code, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """:meth:`Mixer.score` of many texts, those of like length together, so
    that few wait for a long one."""
    out, off = np.empty(len(lens)), np.cumsum(lens) - lens
    order = np.argsort(lens, kind="stable")
    for lo in range(0, len(order), LANES):
        some = order[lo:lo + LANES]
        n = lens[some]
        at = np.repeat(off[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[some] = mixer.score(code, Stream.of(code, ids[at], n))
    return out


class Fitter:
    """Counts of training bits by gate, value and the levels of the three
    inputs, from which a mixer's starting weights and final map are fitted.
    Each bit is counted out of its own counters first; a level stands for the
    mean input of its bits.  A table of fixed size holds all bits, so the texts
    are read once for all steps."""

    SIZE = -(-2 * GATES * LEVELS ** INPUTS // CHUNK) * CHUNK

    def __init__(self, code: Code, table: np.ndarray):
        size = 1 << SLOT_BITS
        self.code, self.levels = code, []
        self.means = np.zeros((INPUTS, LEVELS))
        cells = table[:2 * (code.n_nodes + 2 * size)].reshape(-1, 2)
        kinds = np.uint8, np.uint16, np.int32           # the least that hold a level's share of a key
        for k, part in enumerate(np.split(cells, [code.n_nodes, code.n_nodes + size])):
            x = np.empty(part.shape, np.float32)        # of a cell whose own bit is left out
            for bit in (0, 1):
                n = [part[:, 0], part[:, 1]]
                n[bit] = np.maximum(n[bit] - 1, 0)
                x[:, bit] = inputs(*n)
            far = np.arcsinh(12 * NEAR[k])
            level = (np.clip(np.rint(np.arcsinh(x * NEAR[k]) * (SIDE / far)), -SIDE, SIDE) + SIDE).astype(np.int64).ravel()
            n = part.ravel().astype(np.float64)
            self.means[k] = np.bincount(level, n * x.ravel(), LEVELS) / np.maximum(np.bincount(level, n, LEVELS), 1)
            place = INPUTS - 1 - k
            self.levels.append((level * (2 * LEVELS ** place)).astype(kinds[place]))
        self.levels[0][1::2] += 1                       # the bit itself

    def add(self, st: Stream, table: np.ndarray) -> None:
        code = self.code
        near, one, two = self.levels
        for lo in range(0, len(st.ids), WORDS):
            hi, k = min(lo + WORDS, len(st.ids)), 0
            keys = np.empty(code.lens[st.ids[lo:hi]].sum(), np.int64)
            for i in range(lo, hi, SOME):
                for depth, step, x1, x2 in st.layers(code, slice(i, min(i + SOME, hi))):
                    step = step.astype(np.int64)
                    node, bit = (step >> 1).view(np.uint64), step & 1
                    key = near.take(step)
                    key += np.int32(min(depth, GATES - 1) * 2 * LEVELS ** INPUTS)
                    for level, ctx in ((one, x1), (two, x2)):
                        cell = mixed(ctx, node)
                        cell <<= 1
                        cell += bit
                        key += level.take(cell)
                    keys[k:k + len(key)] = key
                    k += len(key)
            table += np.bincount(keys, minlength=len(table)).astype(table.dtype)


def bit_histogram(train: DataFrame, shared, table) -> np.ndarray:
    """A :class:`Fitter`'s counts over all training texts."""
    return summed(train, Fitter.SIZE, Fitter.add, lambda: (shared.value, Fitter(shared.value, table.value)), np.int64)


def sums_at(histogram: np.ndarray, means: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and (prediction, bit) counts of plain logistic
    regression at ``weights`` over a :class:`Fitter`'s counts and means."""
    key = np.flatnonzero(histogram)
    n = histogram[key].astype(np.float64)
    bit, rest = key % 2, key // 2
    x = []
    for mean in means[::-1]:
        x.append(mean[rest % LEVELS])
        rest = rest // LEVELS
    x, gate = np.array(x[::-1]), rest
    z = (weights.astype(np.float64)[gate].T * x).sum(0)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    var = n * (p * (1 - p) + 1e-6)
    total = lambda v: np.bincount(gate, v, minlength=GATES)
    grads = np.array([total(n * x[k] * (bit - p)) for k in range(INPUTS)]).T
    curv = np.array([[total(x[k] * x[m] * var) for m in range(INPUTS)] for k in range(INPUTS)]).transpose(2, 0, 1)
    i = np.rint((np.clip(z, -8, 8) + 8) * 2).astype(np.int64)
    seen = np.bincount((gate * 33 + i) * 2 + bit, n, minlength=GATES * 66).reshape(GATES, 33, 2)
    return grads, curv, seen


def fit_sums(train: DataFrame, shared, table, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`sums_at` over all training texts."""
    return sums_at(bit_histogram(train, shared, table), Fitter(shared.value, table.value).means, weights)


def fit(train: DataFrame, shared, table: np.ndarray, mixer: Mixer) -> None:
    """Starting weights by Newton steps and the final map, over all training
    texts, which are read once."""
    cells = train.sparkSession.sparkContext.broadcast(table)      # of fixed size, as in the mixer
    histogram, means = bit_histogram(train, shared, cells), Fitter(shared.value, table).means
    for _ in range(ROUNDS):
        grads, curv, seen = sums_at(histogram, means, mixer.weights)
        step = [np.linalg.solve(c + np.eye(INPUTS) * 1e-2, g) for c, g in zip(curv, grads, strict=True)]
        mixer.weights = (mixer.weights + np.array(step).clip(-1, 1)).astype(np.float32)
    n0, n1 = seen[..., 0], seen[..., 1]
    prior = 1 / (1 + np.exp(-mixer.grid))[None]
    mixer.final = np.log((n1 + 20 * prior) / (n0 + 20 * (1 - prior))).astype(np.float32)
    mixer.lines()


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------

def score_texts(docs: DataFrame, vocab: int = VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte), one row per input row, over whole texts.

    Learns from rows whose crc32(doc_id as text; null: empty) mod 7 is not 2.
    Null, empty and blank texts are the end token alone.  Repeated rows count
    and are scored each.  With no training rows every count is 0.  bits_per_byte
    is null for an empty text."""
    spark = docs.sparkSession
    docs = docs.select(*id_text(id_col, text_col))
    train = docs.where(~held_out())
    counts = materialise(word_counts(train), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    words, freq = vocabulary(counts, vocab)
    code = Code(words, [max(1, c) for c in freq], n)
    shared = spark.sparkContext.broadcast(code)
    table = bit_counts(train, shared)
    mixer = Mixer(code, table)
    if n:
        fit(train, shared, table, mixer)
    model = spark.sparkContext.broadcast((mixer, np.log10((np.array(freq, float) + 1) / (n + v + 1))))
    rare = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64()), ("bits", pa.int32())]))

    def run(batches):
        code, (mixer, logs) = shared.value, model.value
        logs = np.append(logs, 0.0)      # the escape's own share is joined later
        has_end = n > 0
        held, words = [], 0

        def rare_words(st):
            """Per text its words outside the vocabulary, each once."""
            seen = st.unknown.dictionary_encode()
            kinds = max(1, len(seen.dictionary))
            pairs, tf = np.unique(st.unknown_doc * kinds + seen.indices.to_numpy(), return_counts=True)
            doc, word = pairs // kinds, pairs % kinds
            each = pa.StructArray.from_arrays(
                [seen.dictionary.take(pa.array(word)), pa.array(tf, pa.int64()), pa.array(code.spelt(seen.dictionary)[word], pa.int32())],
                fields=list(rare.value_type))
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(st.n_docs + 1)), pa.int32()), each)

        def finish():
            done = [np.concatenate(x) for x in zip(*(h[1:5] for h in held), strict=True)]
            ids, lens, base, known = done
            rows = pa.concat_batches([h[0] for h in held])
            cost = costs(mixer, code, ids.astype(np.int64), lens)
            return pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(lens), pa.array(known), pa.array(base), pa.array(-cost / LN10),
                 pa.concat_arrays([h[5] for h in held])],
                names=["doc_id", "held_out", "bytes", "n_tokens", "known", "logs", "words", "rare"])

        for b in batches:
            for lo, hi in slices(b.column("text"), SLICE):
                st = Stream(code, *split(b.column("text").slice(lo, hi - lo)))
                k = (st.ids < code.v).astype(float) if has_end else np.zeros(len(st.ids))
                held.append((b.select(["doc_id", "held_out", "bytes"]).slice(lo, hi - lo), st.ids.astype(np.int32), np.diff(st.off),
                             np.bincount(st.doc, logs[st.ids], minlength=hi - lo),
                             np.bincount(st.doc, k, minlength=hi - lo).astype(np.int64), rare_words(st)))
                words += len(st.ids)
                if words >= GATHER:
                    yield finish()
                    held, words = [], 0
        if held:
            yield finish()

    scored = map_arrow(docs.select("doc_id", "text", held_out().alias("held_out"), F.octet_length("text").cast("long").alias("bytes")),
                       run, "doc_id long, held_out boolean, bytes long, n_tokens long, known long, logs double, "
                       "words double, rare array<struct<word:binary,tf:bigint,bits:int>>")
    scored = materialise(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    c = F.coalesce("c", F.lit(0))
    # words outside the vocabulary: their training tokens and types, and one
    # type for all that were never seen
    outside = float(n - sum(freq) + v - sum(1 for c in freq if c) + 1)
    found = (scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.tf", "r.bits")
             .join(counts, "word", "left").groupBy("rid")
             .agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more"),
                  F.sum(F.col("tf") * F.log10((c + F.lit(1.0)) / F.lit(float(n + v + 1)))).alias("add"),
                  F.sum(F.when(c == 0, F.col("tf") * F.col("bits")).otherwise(0)).alias("spelt")))
    zero = F.lit(0.0)
    base = F.col("logs") + F.coalesce("add", zero)
    escaped = F.aggregate("rare", F.lit(0).cast("long"), lambda a, r: a + r["tf"])
    # the same words by their share of the counts outside the vocabulary
    score = F.col("words") + F.coalesce(F.col("add") + F.col("escaped") * F.lit(float(np.log10((n + v + 1) / outside))), zero)
    bits = F.coalesce("spelt", F.lit(0)) - score * F.lit(LN10 / float(np.log(2.0)))
    slim = scored.withColumn("escaped", escaped).drop("rare")
    return slim.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
        F.when(F.col("bytes") > 0, bits / F.col("bytes")).alias("bits_per_byte"))
