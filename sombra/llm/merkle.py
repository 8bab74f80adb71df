"""Operator 13: Merkle manifest of a dataset, checkpoint and recompute.

A forest has one tree per group (``lang``), with fan-out 8.  Only every
``BAND``-th level is persisted: a stored node and the 8^3 stored descendants
below it form an aligned subtree, and one task holds one such subtree (at most
512 digests, whatever the size of the dataset).

* Building reduces each aligned subtree to its top digest and stores that; the
  levels between are dropped at once.
* Proof extraction goes top-down over the stored levels.  A subtree's missing
  interior nodes are regenerated from its stored descendants, each descendant
  is handed the siblings on its way up plus the path above the subtree, and
  the regenerated nodes are discarded again.

The subroots of the groups are the leaves of one more tree of the same kind,
so any number of groups is fine too.  Positions come from one range sort: row
counts per (range, group) are summed over the ranges, so no group passes
through one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise

FAN = 8
BAND = 3            # levels regenerated between two stored ones
SUBTREE = FAN ** BAND

PATH = "array<struct<place:int,siblings:array<string>>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---------------------------------------------------------------------------
# Leaves and positions
# ---------------------------------------------------------------------------

def field(c: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of a row whose text is ``text``."""
    return F.sha2(F.concat(*[field(text if f == "text" else F.col(f)) for f in fields]), 256)


def tree_key(group: Column) -> Column:
    """A group as a non-null text that sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def positions(df: DataFrame, order: list[str], what: str) -> DataFrame:
    """``df`` with ``pos`` (from 0) within each ``tree`` by ``order``, and
    ``left``, the number of levels between the leaves and the tree's root."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = (df.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order)
              .withColumn("at", F.monotonically_increasing_id()))
    ranged = materialise(ranged, f"{what}-ordered")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    # one row per (range, group); a group's rows number at most the ranges
    before = F.sum("c").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("c").over(Window.partitionBy("tree"))
    shift = counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                          height(total).alias("left"))
    return (ranged.withColumn("part", part).join(shift, ["tree", "part"])
            .withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"))


def height(n: Column) -> Column:
    """Reductions by ``FAN`` until one node remains."""
    out = F.lit(0)
    for h in range(21):
        out = F.when(n > F.lit(FAN ** h), h + 1).otherwise(out)
    return out


# ---------------------------------------------------------------------------
# One aligned subtree, in one task
# ---------------------------------------------------------------------------

def digest_of(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def regenerate(nodes: list[str], steps: int) -> list[list[str]]:
    """The levels of a subtree from its stored descendants upwards."""
    levels = [nodes]
    for _ in range(steps):
        low = levels[-1]
        levels.append([digest_of(low[i:i + FAN]) for i in range(0, len(low), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[dict]:
    """The way from descendant ``at`` to the subtree's top: own place in each
    run and the run's other nodes."""
    out = []
    for low in levels[:-1]:
        start = at - at % FAN
        run = low[start:start + FAN]
        out.append({"place": at - start, "siblings": run[:at - start] + run[at - start + 1:]})
        at //= FAN
    return out


def fold(node: str, path: list[dict]) -> str:
    """The root that a node and its siblings lead to."""
    for step in path:
        sib, k = step["siblings"], step["place"]
        node = digest_of(sib[:k] + [node] + sib[k:])
    return node


# ---------------------------------------------------------------------------
# Build: store every third level
# ---------------------------------------------------------------------------

def _subtrees(nodes: DataFrame) -> DataFrame:
    return (nodes.withColumn("blk", F.floor(F.col("pos") / SUBTREE))
            .withColumn("steps", F.least(F.col("left"), F.lit(BAND))))


def _reduce(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    steps, left = table["steps"][0].as_py(), table["left"][0].as_py()
    top = regenerate(table["digest"].to_pylist(), steps)[-1]
    return pa.table({"tree": table["tree"].slice(0, 1).cast(pa.string()), "pos": table["blk"].slice(0, 1).cast(pa.int64()),
                     "digest": pa.array(top, pa.string()), "left": pa.array([left - steps], pa.int32())})


def build(leaves: DataFrame, what: str) -> list[DataFrame]:
    """Stored levels of a forest, leaves first.  ``leaves`` holds (tree, pos,
    digest, left) and is a stored table; of the last entry, and of it alone,
    all nodes are roots (``left`` = 0)."""
    ship_package(leaves.sparkSession)
    stored, roots = [leaves], None
    while True:
        top = materialise(_subtrees(stored[-1].select("tree", "pos", "digest", "left"))
                          .groupBy("tree", "blk").applyInArrow(_reduce, "tree string, pos long, digest string, left int"),
                          f"{what}-level")
        done = top.where("left = 0")
        roots = done if roots is None else roots.union(done)
        if not top.where("left > 0").limit(1).count():
            return [*stored, roots]
        stored.append(top.where("left > 0"))


# ---------------------------------------------------------------------------
# Proofs: regenerate, emit siblings, discard
# ---------------------------------------------------------------------------

def _descend(low: pa.Table, above: pa.Table) -> pa.Table:
    low = low.sort_by("pos")
    levels = regenerate(low["digest"].to_pylist(), low["steps"][0].as_py())
    up = above["path"][0].as_py()
    paths = [siblings(levels, i) + up for i in range(low.num_rows)]
    return pa.table({"tree": low["tree"].cast(pa.string()), "pos": low["pos"], "left": low["left"],
                     "path": pa.array(paths, PATH_TYPE)})


PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def _meet(nodes: DataFrame, above: DataFrame, fn, schema: str) -> DataFrame:
    """Each aligned subtree of ``nodes`` beside what is known of its top, which
    is named by its tree, its place and the levels left above it."""
    keys = ("tree", "blk", "over")
    low = _subtrees(nodes).withColumn("over", F.col("left") - F.col("steps"))
    tops = (above.withColumnsRenamed({"pos": "blk", "left": "over"})
            .join(low.select(*keys).distinct(), list(keys), "left_semi"))
    return low.groupBy(*keys).cogroup(tops.groupBy(*keys)).applyInArrow(fn, schema)


def paths(stored: list[DataFrame], above: DataFrame, down_to: int = 0) -> DataFrame:
    """(tree, pos, left, path): the way to the top for the nodes of stored level
    ``down_to`` and for the roots; ``above`` holds these columns for the roots,
    with what lies beyond them."""
    rows = above
    for level in reversed(stored[down_to:-1]):
        found = _meet(level.select("tree", "pos", "digest", "left"), rows, _descend,
                      f"tree string, pos long, left int, path {PATH}")
        rows = materialise(found, "merkle-paths").union(above)
    return rows


# ---------------------------------------------------------------------------
# The manifest of a table
# ---------------------------------------------------------------------------

def leaf_table(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered, rid): a row per document."""
    text = F.col("text")
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf(text).alias("digest"), F.when(changed, leaf(lowered)).alias("tampered"),
                       F.monotonically_increasing_id().alias("rid"))


def _prove(low: pa.Table, above: pa.Table) -> pa.Table:
    low = low.sort_by("pos")
    nodes = low["digest"].to_pylist()
    levels = regenerate(nodes, low["steps"][0].as_py())
    up, subroot, root = above["path"][0].as_py(), above["subroot"][0].as_py(), above["root"][0].as_py()
    up_text = "".join(s for step in up for s in step["siblings"])
    proofs, folded = [], []
    for i, (node, bad) in enumerate(zip(nodes, low["tampered"].to_pylist(), strict=True)):
        own = siblings(levels, i)
        proofs.append(hashlib.sha256(("".join(s for step in own for s in step["siblings"]) + up_text).encode()).hexdigest())
        folded.append(fold(node if bad is None else bad, own + up))
    n = low.num_rows
    return pa.table({"doc_id": low["doc_id"], "leaf": low["digest"].cast(pa.string()), "subroot": pa.array([subroot] * n, pa.string()),
                     "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
                     "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of
    every row of ``docs``.

    Null fields hash as `-`; a null lang is a group of its own, before all
    others; a null doc_id sorts first in its group and is never tampered with.
    Rows that repeat a doc_id are leaves of their own, in order of their
    digests.  Texts of any length are one digest.  An empty table gives no
    rows.  Columns beyond the five named ones are ignored."""
    leaves = materialise(leaf_table(docs), "merkle-leaves")
    placed = materialise(positions(leaves, ["doc_id", "digest", "rid"], "merkle").drop("rid"), "merkle-placed")
    stored = build(placed, "merkle")
    subroots = stored[-1].select("tree", F.col("digest").alias("subroot"))
    # the subroots are the leaves of one more tree
    crown_leaves = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest"))
    crown = materialise(positions(crown_leaves, ["name"], "merkle-crown"), "merkle-crown")
    crown_stored = build(crown, "merkle-crown")
    summit = crown_stored[-1].select("tree", "pos", "left", F.expr(f"cast(array() as {PATH})").alias("path"), "digest")
    crown_paths = paths(crown_stored, summit.drop("digest"))
    above = (crown.join(crown_paths.select("pos", "left", "path"), ["pos", "left"])
             .join(summit.select("tree", F.col("digest").alias("root")), "tree")
             .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("left"), "path",
                     F.col("digest").alias("subroot"), "root"))
    above = materialise(above.dropDuplicates(["tree"]), "merkle-above")
    tops = (paths(stored, above.select("tree", "pos", "left", "path"), down_to=1)
            .join(above.select("tree", "subroot", "root"), "tree"))
    return _meet(placed, tops, _prove,
                 "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                 "verified boolean")
