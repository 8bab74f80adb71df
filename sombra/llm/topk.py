"""Operator 1: exact top-k search over integer vectors.

Columnar branch and bound.  Vectors of one dimension are cut into blocks and
stored vertically (dimension-major int64 matrices, one binary per block).  A
task holds one block of queries and one block of candidates: for each query
the inner products are accumulated dimension block by dimension block (those
with most query mass first), and after each dimension block the candidates
whose partial score plus the Cauchy-Schwarz bound on their remaining mass
cannot reach the k-th best score known are compacted away.  Bounds are integer
and rounded up, so nothing is lost to rounding.  Per-block winners are merged
by a ranked window per query.

The stated query set meets all rows in blocks; every (query block, candidate
block) pair is one row of an equi-join on the candidate block's number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise

DIM_BLOCK = 8


def quantise(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, v array<bigint>): floor(256 * x) of each component, x as
    double.  Rows with a null id, a null vector or a null or non-finite
    component take no part.  Components beyond 2^24 in absolute value (|x| >
    65,536) would let a score pass 64 bits and raise an error."""
    x = F.col(vec_col)
    limit = float(1 << 24)
    q = F.transform(x, lambda e: F.floor(F.lit(256.0) * e.cast("double")))
    ok = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    small = F.forall(x, lambda e: F.abs(F.lit(256.0) * e.cast("double")) <= limit)
    return (df.where(ok)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"),
                    F.when(small, q).otherwise(F.raise_error(F.lit("vector component beyond 65,536"))).alias("v")))


def pack_blocks(df: DataFrame, block: int, salt: str) -> DataFrame:
    """(blk, dim, n, ids binary, mat binary): vectors in vertical blocks of up
    to ``block`` rows, dealt evenly whatever ids they share."""
    parts = max(1, -(-df.count() // block))

    def pack(batches):
        ids, vecs, dims = [], [], []

        def flush():
            order: dict[int, list[int]] = {}
            for i, d in enumerate(dims):
                order.setdefault(d, []).append(i)
            out = []
            for d, rows in order.items():
                for lo in range(0, len(rows), block):
                    sel = rows[lo:lo + block]
                    m = np.array([vecs[i] for i in sel], np.int64).reshape(len(sel), d)
                    out.append((d, len(sel), np.array([ids[i] for i in sel], np.int64).tobytes(),
                                np.ascontiguousarray(m.T).tobytes()))
            ids.clear(), vecs.clear(), dims.clear()
            return out

        def rows_out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                names=["dim", "n", "ids", "mat"])

        for b in batches:
            v = b.column("v")
            off, flat = np.asarray(v.offsets), np.asarray(v.values)
            for i, vid in enumerate(b.column("vec_id").to_pylist()):
                ids.append(vid)
                vecs.append(flat[off[i]:off[i + 1]])
                dims.append(int(off[i + 1] - off[i]))
                if len(ids) >= 4 * block:
                    yield rows_out(flush())
        if ids:
            yield rows_out(flush())

    packed = map_arrow(df.select("vec_id", "v").repartition(parts), pack,
                       "dim int, n int, ids binary, mat binary")
    return materialise(packed.withColumn("blk", F.monotonically_increasing_id()), f"vectors-{salt}")


def _search(q_ids, Q, c_ids, X, k):
    """Top k of candidates X (dims x n) for each query column of Q (dims x m)."""
    d, n = X.shape
    cuts = list(range(0, d, DIM_BLOCK)) or [0]
    sq_x = np.array([(X[c:c + DIM_BLOCK] ** 2).sum(0) for c in cuts]).reshape(len(cuts), n)
    sq_q = np.array([(Q[c:c + DIM_BLOCK] ** 2).sum(0) for c in cuts]).reshape(len(cuts), len(q_ids))
    Xf = X.astype(np.float64)  # exact: |component| <= 2^24 and a block has 8
    out_q, out_v, out_s = [], [], []
    for j, qid in enumerate(q_ids):
        order = np.argsort(-sq_q[:, j], kind="stable")
        q = Q[:, j]
        alive = np.flatnonzero(c_ids != qid)
        if not len(alive):
            continue
        score = np.zeros(len(alive), np.int64)
        rest_x = sq_x[:, alive].sum(0)
        rest_q = int(sq_q[:, j].sum())
        tau = None
        for step, b in enumerate(order):
            lo = cuts[b]
            hi = min(lo + DIM_BLOCK, d)
            block = Xf[lo:hi] if len(alive) == n else Xf[lo:hi][:, alive]
            score = score + (q[lo:hi].astype(np.float64) @ block).astype(np.int64)
            rest_x = rest_x - sq_x[b, alive]
            rest_q -= int(sq_q[b, j])
            if step == len(order) - 1 or len(alive) <= k:
                continue
            # ceil of the Cauchy-Schwarz bound on what the other blocks can add
            mass = np.ceil(np.sqrt(rest_x.astype(np.float64) * float(rest_q)) * (1 + 1e-12)).astype(np.int64) + 1
            floor_k = np.partition(score - mass, len(alive) - k)[len(alive) - k]
            if tau is None:  # whole scores of the most promising candidates
                best = alive[np.argpartition(-score, k - 1)[:k]]
                tau = int((q @ X[:, best]).min())
            tau = max(tau, int(floor_k))
            keep = score + mass >= tau
            if keep.sum() < 0.75 * len(alive):
                alive, score, rest_x = alive[keep], score[keep], rest_x[keep]
        if len(alive) > k:
            cut = -np.partition(-score, k - 1)[k - 1]
            sel = np.flatnonzero(score >= cut)
        else:
            sel = np.arange(len(alive))
        sel = sel[np.lexsort((c_ids[alive[sel]], -score[sel]))][:k]
        out_q.append(np.full(len(sel), qid))
        out_v.append(c_ids[alive[sel]])
        out_s.append(score[sel])
    return out_q, out_v, out_s


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096,
          query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner
    products, ties to the smaller vec_id.

    ``candidates`` and ``queries`` come from :func:`quantise`.  A query meets
    only vectors with as many components as its own, never a row of its own id.
    Rows that repeat an id all count: as candidates each for itself, as queries
    together (their id's ``k`` best scores).  No candidates: no rows.  Empty
    vectors score 0 with one another."""
    cand = pack_blocks(candidates, block, "candidates")
    ques = pack_blocks(queries, query_block, "queries")
    # every query block is dealt to every candidate block of its dimension
    blocks = cand.select("dim", F.col("blk").alias("cblk"))
    pairs = (ques.select("dim", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"))
             .join(blocks, "dim")
             .join(cand.select(F.col("blk").alias("cblk"), "ids", "mat"), "cblk"))

    def search(batches):
        for b in batches:
            for r in range(b.num_rows):
                d = b.column("dim")[r].as_py()
                qi = np.frombuffer(b.column("q_ids")[r].as_py(), np.int64)
                ci = np.frombuffer(b.column("ids")[r].as_py(), np.int64)
                Q = np.frombuffer(b.column("q_mat")[r].as_py(), np.int64).reshape(d, len(qi))
                X = np.frombuffer(b.column("mat")[r].as_py(), np.int64).reshape(d, len(ci))
                oq, ov, os_ = _search(qi, Q, ci, X, k)
                if oq:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x).astype(np.int64)) for x in (oq, ov, os_)],
                        names=["query_id", "vec_id", "score"])

    found = map_arrow(pairs.select("dim", "q_ids", "q_mat", "ids", "mat"), search,
                      "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
