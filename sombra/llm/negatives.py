"""Operator 11: hard-negative mining with anchor spanning-tree bounds.

Anchors and candidates are integer vectors in blocks.  Every anchor block gets
a minimum spanning tree over its anchors (Prim, Euclidean edge lengths).  A
task holds one anchor block and one candidate block and walks the tree from
its root: a child's score with a candidate lies within the parent's score plus
or minus edge length times the candidate's norm (Cauchy-Schwarz), and where
the parent's score is itself only known within bounds, within those bounds
widened by the same amount.  Only candidates whose interval overlaps what is
asked for are scored exactly, and their intervals shrink to a point for the
children.

Two walks: the first finds each anchor's positives (interval reaches the k-th
best lower bound among rows of its label), the second the negatives (interval
overlaps the score window of one of its positives).

Bounds are floats widened by more than their rounding; scores are exact.  The
stated anchor set meets all rows in blocks; candidate blocks are much larger
than anchor blocks, so the copies of anchors that are moved stay few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise

ANCHOR_BLOCK = 512
CANDIDATE_BLOCK = 16_384
SLACK = 1.0 + 1e-9
EXACT = float(1 << 53)


def labelled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(rid, vec_id, label, dim, v): floor(256 * x) of each component, x as
    double, one row per row of ``df``.

    Rows with a null id, label or vector or a null or non-finite component take
    no part.  Components beyond 2^23 / 256 in absolute value would let a score
    pass 64 bits and raise an error."""
    x = F.col(vec_col)
    ok = (x.isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
          & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf")))))
    small = F.forall(x, lambda e: F.abs(F.lit(256.0) * e.cast("double")) <= float(1 << 23))
    q = F.transform(x, lambda e: F.floor(F.lit(256.0) * e.cast("double")).cast("int"))
    return (df.where(ok)
            .select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"),
                    F.col(label_col).cast("long").alias("label"), F.size(x).alias("dim"),
                    F.when(small, q).otherwise(F.raise_error(F.lit("vector component beyond 32,768"))).alias("v")))


# ---------------------------------------------------------------------------
# Blocks
# ---------------------------------------------------------------------------

def spanning_tree(X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree over the rows of ``X``: (order, parent,
    edge length); parents come before children, the root's parent is -1."""
    n = len(X)
    X = X.astype(np.float64)
    sq = (X * X).sum(1)
    order, parent = np.zeros(n, np.int32), np.full(n, -1, np.int32)
    edge, near = np.zeros(n), np.full(n, np.inf)
    via = np.zeros(n, np.int32)
    todo = np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], todo[at] = at, False
        if k:
            parent[at], edge[at] = via[at], np.sqrt(near[at]) * SLACK
        d = np.maximum(sq + sq[at] - 2.0 * (X @ X[at]), 0.0)
        # lengths of nearly equal vectors, without cancellation
        close = np.flatnonzero(d <= 1e-6 * (sq + sq[at]))
        d[close] = ((X[close] - X[at]) ** 2).sum(1)
        closer = todo & (d < near)
        near[closer], via[closer] = d[closer], at
        at = int(np.argmin(np.where(todo, near, np.inf)))
    return order, parent, edge


def _blocks(df: DataFrame, block: int, what: str) -> DataFrame:
    """(blk, dim, n, rid, vec_id, label, mat, windows, tree): vectors in blocks
    of up to ``block`` rows of one dimension, dealt evenly whatever ids or
    labels they share."""
    anchors = "scores" in df.columns
    parts = max(1, -(-df.count() // block))
    dealt = df.repartition(parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                rows = held.setdefault(int(d), [])
                rows.append(part)
                while sum(r.num_rows for r in rows) >= block:
                    whole = pa.Table.from_batches(rows).combine_chunks()
                    yield row_out(whole.slice(0, block), int(d))
                    rows[:] = whole.slice(block).to_batches()
        for d, rows in held.items():
            if sum(r.num_rows for r in rows):
                yield row_out(pa.Table.from_batches(rows).combine_chunks(), d)

    def row_out(t: pa.Table, d: int) -> pa.RecordBatch:
        n = t.num_rows
        flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if d else np.empty(0, np.int32)
        X = np.ascontiguousarray(flat.reshape(n, d).astype(np.int32))
        tree = b""
        if anchors:
            order, parent, edge = spanning_tree(X)
            tree = order.tobytes() + parent.tobytes() + edge.tobytes()
        cols = {"dim": d, "n": n, "mat": X.tobytes(), "tree": tree,
                **{c: t[c].to_numpy().astype(np.int64).tobytes() for c in ("rid", "vec_id", "label")}}
        arrays = [pa.array([cols["dim"]], pa.int32()), pa.array([cols["n"]], pa.int32())]
        arrays += [pa.array([cols[c]], pa.binary()) for c in ("rid", "vec_id", "label", "mat", "tree")]
        scores = t["scores"].to_pylist() if anchors else []
        arrays.append(pa.array([[s or [] for s in scores]], pa.list_(pa.list_(pa.int64()))))
        return pa.RecordBatch.from_arrays(arrays, names=["dim", "n", "rid", "vec_id", "label", "mat", "tree", "scores"])

    keep = ["rid", "vec_id", "label", "dim", "v"] + (["scores"] if anchors else [])
    out = map_arrow(dealt.select(*keep), pack,
                    "dim int, n int, rid binary, vec_id binary, label binary, mat binary, tree binary, scores array<array<long>>")
    return materialise(out.withColumn("blk", F.monotonically_increasing_id()), f"blocks-{what}")


class Block:
    """One candidate block, as a task holds it."""

    def __init__(self, row: dict):
        n, d = row["n"], row["dim"]
        self.ids, self.rid, self.label = (np.frombuffer(row[c], np.int64) for c in ("vec_id", "rid", "label"))
        self.X = np.frombuffer(row["mat"], np.int32).reshape(n, d)
        self.F = self.X.astype(np.float64)
        self.norm = np.sqrt((self.F * self.F).sum(1)) * SLACK
        self.top = float(np.abs(self.F).max(initial=0.0))

    def scores(self, a: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Exact integer inner products of an anchor with some rows."""
        af = a.astype(np.float64)
        if float(np.abs(af).sum()) * self.top < EXACT:  # every partial sum is exact
            return ((self.F if rows is None else self.F[rows]) @ af).astype(np.int64)
        return (self.X if rows is None else self.X[rows]).astype(np.int64) @ a.astype(np.int64)


def walk(anchors: dict, cand: Block, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's place, rows scored, their exact scores) for every anchor of a
    block, in tree order.  ``wanted(i, lo, hi)`` names the rows whose interval
    overlaps what anchor ``i`` asks for."""
    n, d = anchors["n"], anchors["dim"]
    A = np.frombuffer(anchors["mat"], np.int32).reshape(n, d)
    order = np.frombuffer(anchors["tree"], np.int32, n)
    parent = np.frombuffer(anchors["tree"], np.int32, n, 4 * n)
    edge = np.frombuffer(anchors["tree"], np.float64, n, 8 * n)
    children = np.bincount(parent[parent >= 0], minlength=n)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in order.tolist():
        p = int(parent[i])
        if p < 0:
            exact = cand.scores(A[i])
            lo = hi = exact.astype(np.float64)
            rows = wanted(i, lo, hi)
            yield i, rows, exact[rows]
        else:
            spread = edge[i] * cand.norm + 1.0
            lo, hi = known[p][0] - spread, known[p][1] + spread
            children[p] -= 1
            if not children[p]:
                del known[p]
            rows = wanted(i, lo, hi)
            exact = cand.scores(A[i], rows)
            lo[rows] = hi[rows] = exact
            yield i, rows, exact
        if children[i]:
            known[i] = (lo, hi)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        sel = np.flatnonzero(scores >= cut)
    else:
        sel = np.arange(len(scores))
    return sel[np.lexsort((ids[sel], -scores[sel]))][:k]


def _meet(anchors: DataFrame, cands: DataFrame, fn, schema: str) -> DataFrame:
    """Every anchor block beside every candidate block of its dimension."""
    a = anchors.select("dim", *[F.col(c).alias(f"a_{c}") for c in ("n", "rid", "vec_id", "label", "mat", "tree", "scores")])
    pairs = (a.join(cands.select("dim", "blk"), "dim")
             .join(cands.select("blk", "n", "rid", "vec_id", "label", "mat"), "blk").drop("blk"))

    def run(batches):
        held, block = None, None
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if block is None or held != row["rid"]:
                    held, block = row["rid"], Block(row)
                anchor = {"dim": row["dim"], **{c[2:]: v for c, v in row.items() if c.startswith("a_")}}
                yield from fn(anchor, block)

    # rows of whole blocks: a few in an Arrow batch
    return map_arrow(pairs, run, schema)


def positives(anchors: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """(anchor_rid, positive_id, positive_score): each anchor's ``k`` best other
    rows of its label."""
    def find(a, cand):
        rid, label = (np.frombuffer(a[c], np.int64) for c in ("rid", "label"))
        groups: dict[int, np.ndarray] = {}

        def wanted(i, lo, hi):
            same = groups.get(int(label[i]))
            if same is None:
                same = groups[int(label[i])] = np.flatnonzero(cand.label == label[i])
            own = same[cand.rid[same] != rid[i]]
            if len(own) <= k:
                return own
            floor = np.partition(lo[own], len(own) - k)[len(own) - k]
            return own[hi[own] >= floor]

        out: list[list] = [[], [], []]
        for i, rows, exact in walk(a, cand, wanted):
            sel = best(cand.ids[rows], exact, k)
            out[0].append(np.full(len(sel), rid[i]))
            out[1].append(cand.ids[rows[sel]])
            out[2].append(exact[sel])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out],
                                         names=["anchor_rid", "positive_id", "positive_score"])

    found = _meet(anchors, cands, find, "anchor_rid long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_rid").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Integer scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def negatives(anchors: DataFrame, cands: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor_rid, positive_score, rank, negative_id, negative_score): for each
    distinct positive score of an anchor, the ``k`` best rows of other labels in
    its window."""
    def find(a, cand):
        rid, label = (np.frombuffer(a[c], np.int64) for c in ("rid", "label"))
        spans = [[(s, *window_of(s, low, high)) for s in sorted(set(scores))] for scores in a["scores"]]
        others: dict[int, np.ndarray] = {}

        def wanted(i, lo, hi):
            other = others.get(int(label[i]))
            if other is None:
                other = others[int(label[i])] = cand.label != label[i]
            hit = np.zeros(len(lo), bool)
            for _, wl, wh in spans[i]:
                if wl > wh:
                    continue
                over = (hi >= wl) & (lo <= wh) & other
                # no row below the k-th best that surely lies in the window
                sure = lo[over & (lo >= wl) & (hi <= wh)]
                if len(sure) > k:
                    over &= hi >= np.partition(sure, len(sure) - k)[len(sure) - k]
                hit |= over
            return np.flatnonzero(hit)

        out: list[list] = [[np.empty(0, np.int64)] for _ in range(4)]
        for i, rows, exact in walk(a, cand, wanted):
            for s, wl, wh in spans[i]:
                fit = np.flatnonzero((exact >= wl) & (exact <= wh))
                sel = fit[best(cand.ids[rows[fit]], exact[fit], k)]
                for col, x in zip(out, (np.full(len(sel), rid[i]), np.full(len(sel), s), cand.ids[rows[sel]], exact[sel]),
                                  strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out],
                                         names=["anchor_rid", "positive_score", "negative_id", "negative_score"])

    found = _meet(anchors, cands, find, "anchor_rid long, positive_score long, negative_id long, negative_score long")
    w = Window.partitionBy("anchor_rid", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor, k_positive: int = 5, k_negative: int = 3, low: int = 50, high: int = 95,
         anchor_block: int = ANCHOR_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor row and each of its ``k_positive`` best
    other rows of the same label, the best ``k_negative`` rows of other labels
    whose score lies between ``low`` and ``high`` per cent of the positive's.

    ``vectors`` comes from :func:`labelled`; ``is_anchor`` is a condition on it.
    Higher scores come first, ties by smaller vec_id.  Rows are told apart by
    row, not by id: a row that repeats an id is a row of its own, as anchor
    (its results repeat then) and as candidate.  Rows meet only rows with as
    many components; vectors without components score 0 with one another.
    A positive with a negative score has an empty window, one with score 0 the
    window 0.  No anchors, positives or negatives: no rows."""
    vectors = materialise(vectors, "mine-vectors")
    chosen = vectors.where(is_anchor)
    cands = _blocks(vectors, candidate_block, "candidates")
    first = _blocks(chosen.withColumn("scores", F.lit(None).cast("array<long>")), anchor_block, "anchors")
    pos = materialise(positives(first, cands, k_positive), "positives")
    scores = pos.groupBy("anchor_rid").agg(F.collect_list("positive_score").alias("scores"))  # at most k_positive each
    second = _blocks(chosen.join(scores, chosen["rid"] == scores["anchor_rid"]), anchor_block, "anchors")
    neg = negatives(second, cands, k_negative, low, high)
    names = chosen.select(F.col("rid").alias("anchor_rid"), F.col("vec_id").alias("anchor_id"))
    return (neg.join(pos.select("anchor_rid", "positive_id", "positive_score"), ["anchor_rid", "positive_score"])
            .join(names, "anchor_rid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
