"""Operator 6: exact n-gram Jaccard join with set-relation skipping.

Documents become sets of hashed word shingles; equal sets are one class, and
only classes are compared.  All sets follow one global order, rarest first (by
a count-min sketch of fixed size; any order is right, a rare-first one is
fast), so two sets that link share a shingle among their first
floor((1 - t) n) + 1 ones.

1. Index lists of those shingles are read in (size) order.  Each member is
   paired with its list's leader only, and every class keeps the one leader it
   shares most lists with.  These pairs are verified, which gives the exact
   overlap with the leader and the difference to it.
   The leader of a list is its most common member: in a family of copies the
   text that the others were made from.
2. The lists of every class that shares one, with a leader or without, are read
   again with what is known: pairs already connected are skipped, and blocks of a list are skipped by size and by position bounds.  A
   pair under one leader L shares at most min(|a & L|, |z & L|) shingles of L; if
   that is too few it is skipped here, and found by the additions it must share
   (shingles that L lacks), which copies edited apart do not.
3. The remaining pairs are counted over the lists (a pair that links shares
   enough of its first shingles), and verified: under a common leader
   incrementally, |a & z| = |L| - |(L - a) | (L - z)| + |(a - L) & (z - L)|, from
   the small differences alone, else from the full sets.

Links join classes into components.  No step emits all pairs of a group of
copies: they are connected by step 1 and skipped in step 2.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (id_text, map_arrow, materialise, mix64, release, shingle_hashes, slices, text_bytes, word_hashes,
                     word_spans)
from .graph import components

SKETCH_ROWS, SKETCH_BITS, SKETCH_CHUNK = 2, 19, 1 << 14
BLOCK = 2048          # members of an index list read together
STAR = 256            # members of a leader verified under one key
FILTER_BITS = 24


def doc_sets(col: pa.Array, k: int, max_bytes: int = 1 << 20):
    """Sorted distinct shingle hashes of every text of a string column; fewer
    than ``k`` words are one shingle, none an empty set."""
    for i, j in slices(col, max_bytes):
        buf, off = text_bytes(col, i, j)
        s, e, row = word_spans(buf, off)
        words = word_hashes(buf, s, e)
        h, hrow, _ = shingle_hashes(words, row, k)
        cut = np.searchsorted(hrow, np.arange(j - i + 1))
        wcut = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            if cut[r + 1] > cut[r]:
                yield np.unique(h[cut[r]:cut[r + 1]])
            elif wcut[r + 1] > wcut[r]:
                x = np.uint64(wcut[r + 1] - wcut[r])
                with np.errstate(over="ignore"):
                    for w in words[wcut[r]:wcut[r + 1]]:
                        x = x * np.uint64(0xD6E8FEB86659FD93) + w
                yield mix64(np.array([x]))
            else:
                yield np.empty(0, np.uint64)


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    shift = np.uint64(64 - SKETCH_BITS - 20 * row)
    return ((h >> shift) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Count-min sketch (fixed size, 4 MB) of the number of documents per
    shingle, summed over all documents in two distributed steps."""
    def local(batches):
        table = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.uint32)
        for b in batches:
            for s in doc_sets(b.column("text"), k):
                for r in range(SKETCH_ROWS):
                    np.add.at(table[r], _cells(s, r), 1)
        flat = table.reshape(-1, SKETCH_CHUNK)
        keep = np.flatnonzero(flat.any(1))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array([flat[i].tobytes() for i in keep], pa.binary())],
                                             names=["chunk", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(x, np.uint32).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([x.clip(0, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())],
                names=["chunk", "counts"])

    schema = "chunk long, counts binary"
    parts = map_arrow(docs.select("text"), local, schema)
    rows = map_arrow(parts.repartition("chunk"), total, schema).collect()
    table = np.zeros((SKETCH_ROWS << SKETCH_BITS) // SKETCH_CHUNK * SKETCH_CHUNK, np.uint32).reshape(-1, SKETCH_CHUNK)
    for r in rows:
        table[r["chunk"]] = np.frombuffer(r["counts"], np.uint32)
    return table.reshape(SKETCH_ROWS, 1 << SKETCH_BITS)


def prefix_length(n: np.ndarray | int, pct: int):
    return n - (n * pct + 99) // 100 + 1


def overlap_needed(n: np.ndarray, m: np.ndarray, pct: int) -> np.ndarray:
    """Smallest overlap with 100 * i >= pct * (n + m - i)."""
    return (pct * (n + m) + 99 + pct) // (100 + pct)


def signatures(docs: DataFrame, k: int, pct: int) -> DataFrame:
    """(rid, doc_id, n, digest, head, common): set size, digest of the set, its
    first shingles in the global order, and how common those are (mean log of
    their counts): in a family of copies the text that the others were made
    from has no shingle of its own, so its first ones are common."""
    sketch = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, k))

    def run(batches):
        table = sketch.value
        for b in batches:
            n, dig, head, common = [], [], [], []
            for s in doc_sets(b.column("text"), k):
                n.append(len(s))
                dig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    est = np.minimum.reduce([table[r][_cells(s, r)] for r in range(SKETCH_ROWS)])
                    order = np.lexsort((s, est))[:prefix_length(len(s), pct)]
                    head.append(s[order].tobytes())
                    common.append(int(64 * np.log2(est[order].astype(float)).mean()))
                else:
                    head.append(b"")
                    common.append(0)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(dig, pa.binary()),
                 pa.array(head, pa.binary()), pa.array(common, pa.int64())],
                names=["rid", "doc_id", "n", "digest", "head", "common"])
    return map_arrow(docs, run, "rid long, doc_id long, n long, digest binary, head binary, common long")


def postings(classes: DataFrame) -> DataFrame:
    """(token, n, cls, pos, common) one row per first shingle."""
    def run(batches):
        for b in batches:
            heads = b.column("head").to_pylist()
            lens = np.array([len(h) // 8 for h in heads], np.int64)
            tok = np.frombuffer(b"".join(heads), np.int64)
            take = pa.array(np.repeat(np.arange(len(heads)), lens))
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tok), b.column("n").take(take), b.column("cls").take(take), pa.array(pos), b.column("common").take(take)],
                names=["token", "n", "cls", "pos", "common"])
    return map_arrow(classes.select("cls", "n", "head", "common"), run, "token long, n long, cls long, pos long, common long")


def shared_lists(posts: DataFrame) -> DataFrame:
    """Index lists of two members or more.  Most first shingles are one class's
    own; their rows end here, so that later steps move only what can pair."""
    names = ["token", "n", "cls", "pos", "common"]

    def run(batches):
        held, last = None, False       # the row not yet decided, and whether it equals the one before it
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            t = b.column("token").to_numpy()
            same = t[1:] == t[:-1]
            keep = np.zeros(len(t), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= last
            last = bool(same[-1]) if len(same) else last
            held = b.slice(len(t) - 1, 1)
            yield b.slice(0, len(t) - 1).filter(pa.array(keep[:-1]))
        if held is not None and last:
            yield held

    dealt = posts.select(*names).repartition("token").sortWithinPartitions("token")
    return map_arrow(dealt, run, ", ".join(f"{c} long" for c in names))


def _lists(batches, names):
    """Whole index lists from a stream sorted by token, in runs of numpy
    columns; a list longer than what is at hand is carried on."""
    hold = None
    for b in batches:
        cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
        if hold is not None:
            cols = {c: np.concatenate([hold[c], cols[c]]) for c in names}
        t = cols["token"]
        cut = len(t) - int((t == t[-1])[::-1].argmin()) if t[0] != t[-1] else 0
        if cut:
            yield {c: v[:cut] for c, v in cols.items()}
        hold = {c: v[cut:] for c, v in cols.items()}
    if hold is not None and len(hold["token"]):
        yield hold


def leader_pairs(posts: DataFrame, pct: int) -> DataFrame:
    """(cls, leader) candidates: in each list, read from the most common class
    down, a member meets the last leader; one of another size takes its place,
    and both are given with a null leader, so each member of a list of two or
    more is in some row."""
    def run(batches):
        token = leader = None
        size = 0
        for b in batches:
            t, n, c = (b.column(x).to_numpy() for x in ("token", "n", "cls"))
            out_c, out_l = [], []
            same = np.flatnonzero(np.concatenate([[t[0] == token], t[1:] == t[:-1]]))
            prev = -2
            for i in same.tolist():
                if i != prev + 1 and i > 0:      # the member before opened this list
                    leader, size = int(c[i - 1]), int(n[i - 1])
                prev = i
                m = int(n[i])
                if 100 * min(size, m) >= pct * max(size, m):
                    out_c.append(int(c[i]))
                    out_l.append(leader)
                else:
                    out_c += [leader, int(c[i])]
                    out_l += [None, None]
                    leader, size = int(c[i]), m
            if prev != len(t) - 1:
                leader, size = int(c[-1]), int(n[-1])
            token = t[-1]
            if out_c:
                yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_l, pa.int64())],
                                                 names=["cls", "leader"])
    dealt = posts.select("token", "n", "cls", "common").repartition("token").sortWithinPartitions(
        "token", F.desc("common"), "cls")
    return map_arrow(dealt.select("token", "n", "cls"), run, "cls long, leader long")


def shared_additions(known: DataFrame, facts: DataFrame, pct: int) -> DataFrame:
    """(a, b, na, nb, leader) pairs under one leader L that can only link
    through shingles which L lacks.

    |a & z| <= min(|a & L|, |z & L|) + |(a - L) & (z - L)|, so such a pair must
    share the missing ones among its additions: the answers of a set are
    derived from its leader's, and only additions are looked up."""
    def run(batches):
        for b in batches:
            adds = b.column("add").to_pylist()
            lens = np.array([len(x) // 8 for x in adds], np.int64)
            take = pa.array(np.repeat(np.arange(len(adds)), lens))
            yield pa.RecordBatch.from_arrays([b.column("cls").take(take), b.column("leader").take(take),
                                              pa.array(np.frombuffer(b"".join(adds), np.int64))], names=["cls", "leader", "token"])
    lists = map_arrow(known.where("add is not null").select("cls", "leader", "add"), run, "cls long, leader long, token long")
    mine = facts.select("cls", "n", "root", "ov")
    # members that are connected already pair nothing: only additions that
    # classes of different components share are read on
    rooted = lists.join(mine, "cls")
    several = (rooted.groupBy("leader", "token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
               .where("lo <> hi").select("leader", "token"))
    rows = rooted.join(several, ["leader", "token"])
    left = rows.select("leader", "token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("ov").alias("oa"))
    right = rows.select("leader", "token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("ov").alias("ob"))
    need = F.expr(f"({pct} * (na + nb) + 99 + {pct}) div (100 + {pct})")
    pairs = (left.join(right, ["leader", "token"]).where("a < b and ra <> rb")
             .where(f"100 * least(na, nb) >= {pct} * greatest(na, nb)").where(need > F.least("oa", "ob")))
    return (pairs.groupBy("a", "b", "na", "nb", "leader", "oa", "ob").agg(F.count("*").alias("shared"))
            .where(F.col("shared") >= need - F.least("oa", "ob")).select("a", "b", "na", "nb", "leader"))


def cross_pairs(lists: DataFrame, facts: DataFrame, pct: int) -> DataFrame:
    """(a, b, na, nb, oneleader, shared) pairs of different components that
    share first shingles and pass the size, position and leader bounds;
    ``shared`` counts the lists that hold both."""
    names = ["token", "n", "cls", "pos", "root", "leader", "ov", "delta", "side"]
    # lists whose members are all connected hold no open pair; only the others'
    # rows are moved with what is known of them
    hot = (lists.select("token", "cls").join(facts.select("cls", "root"), "cls").groupBy("token")
           .agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")))
    hot = materialise(hot.where("lo <> hi").select("token", "df"), "open-lists")
    parts = F.ceil(F.col("df") / BLOCK).cast("int")
    # a long list is cut into blocks by hash; each pair of blocks is one unit
    live = (lists.select("token", "n", "cls", "pos").join(hot, "token")
            .join(facts.select("cls", "root", "leader", "ov", "delta"), "cls"))
    live = live.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    live = live.select("token", "n", "cls", "pos", "root", "leader", "ov", "delta",
                       F.least("mine", "other").alias("u"), F.greatest("mine", "other").alias("v"),
                       F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).cast("long").alias("side"))
    dealt = (live.repartition("token", "u", "v").sortWithinPartitions("token", "u", "v", "n", "cls")
             .withColumn("token", F.xxhash64("token", "u", "v")))

    def run(batches):
        for cols in _lists(batches, names):
            t, n = cols["token"], cols["n"]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            stop = np.append(start[1:], len(t))
            many = stop - start > 1
            out = []
            for lo, hi in zip(start[many].tolist(), stop[many].tolist(), strict=True):
                size = n[lo:hi]
                two = cols["side"][lo:hi].any()
                # block skip by size: members past this index are too large
                reach = np.searchsorted(size, size * 100 // pct, "right")
                for i in range(hi - lo - 1):
                    j = np.arange(i + 1, reach[i])
                    if not len(j):
                        continue
                    x, y = lo + i, lo + j
                    ok = cols["root"][y] != cols["root"][x]
                    if two:
                        ok &= cols["side"][y] != cols["side"][x]
                    y = y[ok]
                    if not len(y):
                        continue
                    need = overlap_needed(n[x], n[y], pct)
                    # position bound: before, at and after the shared shingle
                    most = (np.minimum(cols["pos"][x], cols["pos"][y]) + 1
                            + np.minimum(n[x] - cols["pos"][x], n[y] - cols["pos"][y]) - 1)
                    # leader bound: beyond their overlaps with a common leader two
                    # sets share additions only, and shared_additions has those
                    one = cols["delta"][x] & cols["delta"][y] & (cols["leader"][y] == cols["leader"][x])
                    y = y[(most >= need) & (~one | (np.minimum(cols["ov"][y], cols["ov"][x]) >= need))]
                    if len(y):
                        out.append((np.full(len(y), x), y))
            if out:
                x, y = (np.concatenate(z) for z in zip(*out, strict=True))
                for at in range(0, len(x), 100_000):
                    p, q = x[at:at + 100_000], y[at:at + 100_000]
                    swap = cols["cls"][p] > cols["cls"][q]
                    p, q = np.where(swap, q, p), np.where(swap, p, q)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols["cls"][p]), pa.array(cols["cls"][q]), pa.array(n[p]), pa.array(n[q]),
                         pa.array(np.where(cols["leader"][p] == cols["leader"][q], cols["leader"][p], -1))],
                        names=["a", "b", "na", "nb", "leader"])

    pairs = map_arrow(dealt.select(*names), run, "a long, b long, na long, nb long, leader long")
    counted = pairs.groupBy("a", "b", "na", "nb", "leader").agg(F.count("*").alias("shared"))
    rest = lambda n: F.expr(f"({n} * {pct} + 99) div 100 - 1")  # noqa: E731  size less the first shingles
    need = F.expr(f"({pct} * (na + nb) + 99 + {pct}) div (100 + {pct})")
    return counted.where(F.col("shared") + F.greatest(rest("na"), rest("nb")) >= need)


def _difference(x: np.ndarray, y: np.ndarray) -> tuple[int, bytes | None, bytes | None]:
    """|x & y|, and x - y and y - x unless they are as large as the sets."""
    both = np.intersect1d(x, y, assume_unique=True)
    if 2 * len(both) < len(y):
        return len(both), None, None
    return (len(both), np.setdiff1d(x, both, assume_unique=True).tobytes(), np.setdiff1d(y, both, assume_unique=True).tobytes())


def _verify(batches, pct):
    """Exact overlap of (set, other) binaries, with the differences."""
    for b in batches:
        ov, add, rem = [], [], []
        for x, y in zip(b.column("set").to_pylist(), b.column("other").to_pylist(), strict=True):
            for col, v in zip((ov, add, rem), _difference(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), strict=True):
                col.append(v)
        keep = [c for c in b.schema.names if c not in ("set", "other")]
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in keep] + [pa.array(ov, pa.int64()), pa.array(add, pa.binary()), pa.array(rem, pa.binary())],
            names=[*keep, "ov", "add", "rem"])


def _incremental(batches):
    """|a & z| from the differences to the common leader."""
    for b in batches:
        got = []
        for ln, a1, r1, a2, r2 in zip(*(b.column(c).to_pylist() for c in ("ln", "add_a", "rem_a", "add_b", "rem_b")), strict=True):
            a1, r1, a2, r2 = (np.frombuffer(x, np.uint64) for x in (a1, r1, a2, r2))
            both_rem = len(np.intersect1d(r1, r2, assume_unique=True))
            both_add = len(np.intersect1d(a1, a2, assume_unique=True))
            got.append(ln - (len(r1) + len(r2) - both_rem) + both_add)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(got, pa.int64())],
                                         names=["a", "b", "na", "nb", "ov"])


def _member_filter(ids: DataFrame) -> np.ndarray:
    """Fixed-size bit filter (2 MB) over one column of numbers, so that only
    rows that may be needed are moved; false positives are dropped by a join."""
    ids = ids.toDF("doc_id")
    def run(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[_filter_bits(b.column("doc_id").to_numpy())] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])
    parts = map_arrow(ids.select("doc_id").where("doc_id is not null").coalesce(8), run, "bits binary").collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for p in parts:
        out |= np.frombuffer(p["bits"], np.uint8)
    return out


def _in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _filter_bits(ids)
    return ((bits[at >> 3] >> (7 - (at & 7))) & 1).astype(bool)


def _filter_bits(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, set binary) of the wanted classes (cls, doc_id, digest), shingled
    again from their texts."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_member_filter(wanted.select("doc_id")))

    def run(batches):
        some = bits.value
        for b in batches:
            ids = b.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(_in_filter(some, ids.fill_null(0).to_numpy()) | null)
            if not len(ok):
                continue
            part = b.take(pa.array(ok))
            sets = list(doc_sets(part.column("text"), k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "set"])
    again = map_arrow(docs.select("doc_id", "text"), run, "digest binary, set binary")
    # one shuffle: the join and the choice of one of equal sets share its key
    found = again.join(wanted, "digest").groupBy("digest")
    rest = [c for c in wanted.columns if c not in ("digest", "doc_id")]
    return found.agg(F.first("set").alias("set"), *[F.first(c).alias(c) for c in rest]).drop("digest")


def star_overlaps(docs: DataFrame, paired: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(cls, leader, ov, add, rem) of every class and its leader (``best``).

    Sets are moved once, to their leader's key: a task reads a leader's set,
    then its members one after another.  The members of a leader with more than
    ``STAR`` are dealt to several keys, each with a copy of the leader's set."""
    salts = best.groupBy("leader").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    seat = lambda key, salt, role: F.struct(key.alias("key"), salt.alias("salt"), F.lit(role).alias("role"))
    members = best.join(salts, "leader").select(
        "cls", seat(F.col("leader"), F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"), 1).alias("seat"))
    leaders = salts.select(F.col("leader").alias("cls"), F.explode(F.transform(
        F.sequence(F.lit(0), F.col("salts") - 1), lambda i: seat(F.col("leader"), i, 0))).alias("seat"))
    seats = members.union(leaders).groupBy("cls").agg(F.collect_list("seat").alias("seats"))
    sets = class_sets(docs, paired.select("cls", "doc_id", "digest").join(seats, "cls"), k)
    dealt = (sets.select("cls", "set", F.inline("seats")).repartition("key", "salt")
             .sortWithinPartitions("key", "salt", "role", "cls"))

    def run(batches):
        own = None
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for cls, raw, key, role in zip(*(b.column(c).to_pylist() for c in ("cls", "set", "key", "role")), strict=True):
                x = np.frombuffer(raw, np.uint64)
                if role == 0:
                    own = x
                    continue
                for col, v in zip(out, (cls, key, *_difference(x, own)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], names=["cls", "leader", "ov", "add", "rem"])

    return map_arrow(dealt, run, "cls long, leader long, ov long, add binary, rem binary")


def jaccard_components(docs: DataFrame, k: int = 4, pct: int = 85, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Two documents link when 100 * intersection >= pct * union of their sets of
    distinct ``k``-word shingles (A-Z lower-cased, words of
    ``[^\\x20\\x09-\\x0D]+``); fewer words are one shingle; null, empty or blank
    texts have the empty set and link with nothing.  component_id is the
    smallest doc_id reachable by links (null only if all are null).  Repeated
    rows and ids are rows of their own; an empty table gives no rows."""
    docs = docs.select(*id_text(id_col, text_col)).withColumn("rid", F.monotonically_increasing_id())
    sigs = materialise(signatures(docs.select("rid", "doc_id", "text"), k, pct), "signatures")
    classes = materialise(
        sigs.where("n > 0").groupBy("digest")
        .agg(F.min("rid").alias("cls"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
             F.first("head").alias("head"), F.first("common").alias("common")), "classes")
    rows = materialise(sigs.select("doc_id", "n", "digest"), "rows")
    release(sigs)
    lists = materialise(shared_lists(postings(classes)), "lists")
    heads, classes = classes, materialise(classes.select("cls", "doc_id", "digest", "n"), "class-list")
    release(heads)

    # 1. leaders
    best = leader_pairs(lists, pct).groupBy("cls", "leader").agg(F.count("*").alias("lists"))
    # a row for each (cls, leader) and list count; per class the leader met most,
    # null if it met none
    met = F.when(F.col("leader").isNotNull(), F.struct("lists", (-F.col("leader")).alias("l")))
    best = best.groupBy("cls").agg(F.max(met).alias("m")).select("cls", (-F.col("m.l")).alias("leader"))
    listed = materialise(best, "leaders")
    best = listed.where("leader is not null")
    # step 1 verifies the classes of a pair; step 2 reads all that share a list
    paired = best.select("cls").union(best.select("leader")).distinct().withColumn("paired", F.lit(True))
    sharing = listed.select("cls").union(best.select("leader")).distinct()
    wanted = (classes.join(sharing, "cls").join(paired, "cls", "left")
              .withColumn("paired", F.coalesce("paired", F.lit(False))))
    wanted = materialise(wanted, "sharing")
    known = materialise(star_overlaps(docs.select("doc_id", "text"), wanted.where("paired"), best, k), "stars")
    size = wanted.select("cls", "n")
    linked = (known.select("cls", "leader", "ov").join(size, "cls")
              .join(size.select(F.col("cls").alias("leader"), F.col("n").alias("ln")), "leader")
              .where(f"100 * ov >= {pct} * (n + ln - ov)")
              .select(F.col("cls").alias("a"), F.col("leader").alias("b")))
    linked = materialise(linked, "links")
    roots = components(linked)

    # 2. open pairs
    facts = (wanted.select("cls", "n")
             .join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
             .join(known.select("cls", "leader", "ov", F.col("add").isNotNull().alias("delta")), "cls", "left")
             # a class without a leader is its own: overlap with itself is its size
             .select("cls", "n", F.coalesce("root", "cls").alias("root"),
                     F.coalesce("leader", "cls").alias("leader"), F.coalesce("ov", "n").alias("ov"),
                     F.coalesce("delta", F.lit(True)).alias("delta")))
    facts = materialise(facts, "facts")
    open_pairs = materialise(cross_pairs(lists, facts, pct).select("a", "b", "na", "nb", "leader")
                             .union(shared_additions(known, facts, pct)).distinct(), "open")

    # 3. verification
    delta = known.select("cls", "leader", "add", "rem").where("add is not null")
    own = size.select(F.col("cls").alias("leader"), F.col("n").alias("ln"))
    pairs = open_pairs.select("a", "b", "na", "nb", "leader")
    sided = (pairs.where("leader >= 0")
             .join(delta.select(F.col("cls").alias("a"), F.col("add").alias("add_a"), F.col("rem").alias("rem_a")), "a", "left")
             .join(delta.select(F.col("cls").alias("b"), F.col("add").alias("add_b"), F.col("rem").alias("rem_b")), "b", "left")
             .join(own, "leader", "left"))
    empty = F.lit(b"")
    sided = sided.select("a", "b", "na", "nb", "ln", *[
        F.when(F.col(s) == F.col("leader"), empty).otherwise(F.col(f"{x}_{s}")).alias(f"{x}_{s}")
        for s in "ab" for x in ("add", "rem")])
    sided = materialise(sided, "sided")
    usable = " and ".join(f"{x}_{s} is not null" for s in "ab" for x in ("add", "rem"))
    quick = map_arrow(sided.where(usable), _incremental, "a long, b long, na long, nb long, ov long")
    slow = (sided.where(f"not ({usable})").select("a", "b", "na", "nb")
            .union(pairs.where("leader < 0").select("a", "b", "na", "nb")))
    # the sets of the few open pairs that have no differences to go by
    late = wanted.select("cls", "doc_id", "digest").join(
        slow.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi")
    sets = materialise(class_sets(docs.select("doc_id", "text"), materialise(late, "late"), k), "late-sets")
    slow = (slow.join(sets.select(F.col("cls").alias("a"), "set"), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("set").alias("other")), "b"))
    slow = map_arrow(slow.select("a", "b", "na", "nb", "set", "other"), lambda it: _verify(it, pct),
                     "a long, b long, na long, nb long, ov long, add binary, rem binary").select("a", "b", "na", "nb", "ov")
    more = quick.union(slow).where(f"100 * ov >= {pct} * (na + nb - ov)").select("a", "b")
    more = materialise(more, "more-links")
    roots = components(linked.union(more)) if more.limit(1).count() else roots

    # classes -> components -> rows
    cls = (classes.select("digest", "cls", F.col("doc_id").alias("first_doc"))
           .join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
           .withColumn("root", F.coalesce("root", "cls")))
    small = cls.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = cls.join(small, "root").select("digest", "component_id")
    return (rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
