"""Operator 9: document fingerprints by an invertible Bloom lookup sketch.

DataFrame functions only.  A text's paragraphs (lines, cut every ``PIECE``
code points) are hashed to 64-bit keys: 48 bits of digest and 16 bits of
check.  A sketch has 3 x ``WIDTH`` cells; a key is added to one cell of each
third.  A cell holds a count, the exclusive or of its keys, and the exclusive
or of an independent 64-bit hash of each key.  Subtracting two sketches cell by
cell leaves the keys on one side only; peeling finds cells with one key (count
+-1, a valid check, and the second sum equal to the key's hash: several keys
whose sum only looks like a key fail that), records the key and removes it from
its other cells, until nothing is left or no such cell is found.  A result
counts only if the number of keys found agrees with the sizes of the two sets.

The first try subtracts the two fingerprints themselves.  Where it fails, the
sketch is made larger: keys are dealt to as many sub-sketches as the two sets
need, and a sub-sketch that still fails is tried again with twice the width and
another seed, until all are peeled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialise

PIECE = 128
WIDTH = 8                # cells in a third of a fingerprint
PER_SUB = 8              # keys a sub-sketch is made for
ROWS_PER_BUCKET = 2048
MASK48 = (1 << 48) - 1


def paragraph_keys(text: str) -> str:
    """SQL: the distinct keys of a text's paragraphs."""
    pieces = f"regexp_extract_all({text}, '[^\\\\n]{{1,{PIECE}}}\\\\n?|\\\\n', 0)"
    digest = f"transform({pieces}, p -> xxhash64(p) & {MASK48}L)"
    return f"array_distinct(transform({digest}, d -> (shiftleft(xxhash64(d), 48) | d)))"


def valid(x: str) -> str:
    return f"(shiftleft(xxhash64({x} & {MASK48}L), 48) | ({x} & {MASK48}L)) = {x}"


def second(x: str) -> str:
    """SQL: the independent hash of a key, summed beside it."""
    return f"xxhash64({x}, 'second')"


def cell_mask(x: str, width: int, seed: int) -> str:
    """SQL: bit set of the three cells of a key (3 * width <= 62)."""
    h = f"xxhash64({x}, {seed})"
    return " | ".join(f"shiftleft(1L, cast({third * width} + pmod(shiftright({h}, {16 * third}), {width}) as int))"
                      for third in range(3))


def cells(keys: str, width: int, seed: int) -> str:
    """SQL: array of (c count, x and y exclusive ors) cells of signed keys, given
    as an array of struct<x bigint, s int>."""
    masked = (f"transform({keys}, k -> named_struct('x', k.x, 'y', {second('k.x')}, 's', k.s, "
              f"'m', {cell_mask('k.x', width, seed)}))")
    build = ("transform(sequence(0, {last}), i -> aggregate(ks, named_struct('c', 0, 'x', 0L, 'y', 0L), (a, k) -> "
             "if((shiftright(k.m, i) & 1L) = 1L, named_struct('c', a.c + k.s, 'x', a.x ^ k.x, 'y', a.y ^ k.y), a)))"
             ).format(last=3 * width - 1)
    return f"element_at(transform(array({masked}), ks -> {build}), 1)"


def peel(table: str, width: int, seed: int, rounds: int) -> str:
    """SQL: struct<t cells left, d number of keys recovered> of a subtracted
    sketch.  Steps alternate between finding pure cells and removing them."""
    pure = (f"array_distinct(transform(filter(st.t, e -> (e.c = 1 or e.c = -1) and {valid('e.x')} and e.y = {second('e.x')}), "
            f"e -> named_struct('x', e.x, 'y', e.y, 's', e.c, 'm', {cell_mask('e.x', width, seed)})))")
    found = f"named_struct('t', st.t, 'd', st.d, 'p', {pure})"
    cut = ("transform(st.t, (e, i) -> aggregate(st.p, e, (a, k) -> if((shiftright(k.m, i) & 1L) = 1L, "
           "named_struct('c', a.c - k.s, 'x', a.x ^ k.x, 'y', a.y ^ k.y), a)))")
    none = "filter(array(named_struct('x', 0L, 'y', 0L, 's', 0, 'm', 0L)), z -> false)"
    gone = f"if(size(st.p) = 0, st, named_struct('t', {cut}, 'd', st.d + size(st.p), 'p', {none}))"
    return (f"aggregate(sequence(1, {2 * rounds}), named_struct('t', {table}, 'd', 0, 'p', {none}), "
            f"(st, r) -> if(r % 2 = 1, {found}, {gone}))")


def clear(table: str) -> str:
    return f"forall({table}, e -> e.c = 0 and e.x = 0 and e.y = 0)"


def agrees(d: str, a: str, b: str) -> str:
    """SQL: whether two sets of ``a`` and ``b`` keys can differ in ``d`` keys."""
    return f"({d} between abs({a} - {b}) and {a} + {b} and ({d} - {a} - {b}) % 2 = 0)"


def signed(own: str, other: str) -> str:
    return (f"concat(transform({own}, x -> named_struct('x', x, 's', 1)), "
            f"transform({other}, x -> named_struct('x', x, 's', -1)))")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('c', p.c - q.c, 'x', p.x ^ q.x, 'y', p.y ^ q.y))"


def as_text(n: str, table: str) -> Column:
    """A fingerprint as text: set size, then count:key:hash of every cell."""
    return F.expr(f"concat(cast({n} as string), '|', array_join(transform({table}, "
                  "e -> concat(cast(e.c as string), ':', lower(hex(e.x)), ':', lower(hex(e.y)))), '|'))")


# ---------------------------------------------------------------------------
# The next document
# ---------------------------------------------------------------------------

def _bucket(bounds: list[int]) -> Column:
    """Number of bounds <= doc_id, found in two levels so that a row is held
    against about twice the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    lit = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    top = f"size(filter({lit([g[0] for g in groups])}, b -> b <= doc_id))"
    table = "array(" + ", ".join(lit(g) for g in groups) + ")"
    inner = f"size(filter(element_at({table}, greatest({top}, 1)), b -> b <= doc_id))"
    return F.expr(f"if(doc_id is null or {top} = 0, 0, ({top} - 1) * {step} + {inner})")


def successor_texts(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, next_text): rows in order of doc_id (nulls first,
    then by text), the first after the last.  Rows are dealt to ranges of ids,
    one shuffle; a range's last row takes the first text of the next range."""
    # one row: the number of rows and quantiles of the ids, which cut the ranges
    total = docs.count()
    count = max(1, min(65_536, -(-total // ROWS_PER_BUCKET)))
    bounds: list[int] = []
    if count > 1:
        share = "array(" + ", ".join(f"{i / count!r}D" for i in range(1, count)) + ")"
        got = docs.select(F.expr(f"percentile_approx(doc_id, {share}, {max(10_000, 20 * count)}) as q")).first()["q"]
        bounds = sorted(set(got or []))
    dealt = docs.withColumn("bucket", _bucket(bounds))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    lead = dealt.withColumn("later", F.lead("text").over(w)).withColumn("spot", F.lead(F.lit(1)).over(w))
    # first text of each bucket that has rows: one row per bucket
    first = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m"))
    first = (dealt.join(first.select("bucket", F.col("m.doc_id").alias("first_id")), "bucket")
             .where(F.col("doc_id").eqNullSafe(F.col("first_id")))
             .groupBy("bucket").agg(F.min("text").alias("head")))
    order = Window.orderBy("bucket")     # one row per bucket, at most 65,536
    ring = materialise(first, "range-heads")
    names = ring.select("bucket")
    links = names.withColumn("after", F.lead("bucket").over(order))
    origin = names.agg(F.min("bucket").alias("origin"))
    links = (links.join(F.broadcast(origin)).select("bucket", F.coalesce("after", "origin").alias("after"))
             .join(ring.select(F.col("bucket").alias("after"), "head"), "after").select("bucket", "head"))
    return (lead.join(links, "bucket")
            .select("bucket", "doc_id", "text", F.when(F.col("spot").isNull(), F.col("head")).otherwise(F.col("later")).alias("next_text")))


# ---------------------------------------------------------------------------
# Fingerprints and likeness
# ---------------------------------------------------------------------------

def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next), one row per input row.

    Likeness is 1 - (keys on one side only) / (keys of both): 1 for equal sets,
    two empty ones included, 0 for sets with nothing in common.  Null text is
    empty; null ids sort first and stay null; repeated rows follow one another;
    a single row is its own next; an empty table gives no rows."""
    base = successor_texts(docs.select(*id_text(id_col, text_col)))
    base = base.withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    base = base.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - tail),
                                              F.substring("next_text", F.lit(1), tail)))
    keyed = base.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        F.expr(paragraph_keys("text")).alias("own"), F.expr(paragraph_keys("edited")).alias("e"),
                        F.expr(paragraph_keys("next_text")).alias("n"))
    keyed = materialise(keyed.withColumn("rid", F.monotonically_increasing_id()), "paragraph-keys", "uncompressed")

    one = "transform({0}, x -> named_struct('x', x, 's', 1))"
    sk = keyed
    for c in ("own", "e", "n"):
        sk = sk.withColumn(f"t_{c}", F.expr(cells(one.format(c), WIDTH, 0)))
    for c in ("e", "n"):
        sk = sk.withColumn(f"p_{c}", F.expr(peel(subtract("t_own", f"t_{c}"), WIDTH, 0, 6)))
    first = materialise(sk.select(
        "rid", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n_own"), F.size("e").alias("n_e"), F.size("n").alias("n_n"),
        as_text("size(own)", "t_own").alias("fingerprint"), as_text("size(e)", "t_e").alias("edited_fingerprint"),
        *[F.when(F.expr(f"{clear(f'p_{c}.t')} and {agrees(f'p_{c}.d', 'size(own)', f'size({c})')}"), F.col(f"p_{c}.d")).alias(f"d_{c}") for c in ("e", "n")]), "first-try")

    # larger sketches for what did not peel
    failed = keyed.join(first.select("rid", F.col("d_e").isNull().alias("f_e"), F.col("d_n").isNull().alias("f_n")), "rid")
    subs = reduce(DataFrame.union, [
        failed.where(f"f_{c}").select("rid", F.lit(c).alias("side"), F.expr(signed("own", c)).alias("keys"))
        for c in ("e", "n")])
    subs = _split(subs, 1)
    width, seed, done = WIDTH, 1, []
    while True:
        step = subs.withColumn("p", F.expr(peel(cells("keys", width, seed), width, seed, 3 * width)))
        plus, minus = (f"size(filter(keys, k -> k.s = {s}))" for s in (1, -1))
        step = step.withColumn("ok", F.expr(f"{clear('p.t')} and {agrees('p.d', plus, minus)}"))
        step = materialise(step.select("rid", "side", F.when(F.col("ok"), F.col("p.d")).alias("d"),
                                       F.when(~F.col("ok"), F.col("keys")).alias("keys")), "peeled", "uncompressed")
        done.append(step.where("d is not null").select("rid", "side", "d"))
        subs = step.where("d is null").select("rid", "side", "keys")
        if not subs.limit(1).count():
            break
        # twice the width while a bit set holds the cells, then more parts
        seed += 1
        if 3 * width * 2 <= 60:
            width *= 2
        else:
            subs = _split(subs, seed)
    diffs = reduce(DataFrame.union, done).groupBy("rid").pivot("side", ["e", "n"]).agg(F.sum("d"))
    out = first.join(diffs.withColumnsRenamed({"e": "r_e", "n": "r_n"}), "rid", "left")

    def near(c):
        both = F.col("n_own") + F.col(f"n_{c}")
        return F.when(both == 0, 1.0).otherwise(1.0 - F.coalesce(f"d_{c}", f"r_{c}") / both).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      near("e").alias("near_edited"), near("n").alias("near_next"))


def _split(rows: DataFrame, seed: int) -> DataFrame:
    """Deal each row's keys to about size / PER_SUB sub-sketches, by hash, in
    two levels (a key is held against twice the square root of their number)."""
    for level in (1, 2):
        rows = rows.withColumn("h", F.expr(f"greatest(1, cast(ceil(size(keys) / {PER_SUB}) as int))"))
        if level == 1:
            rows = rows.withColumn("h", F.ceil(F.sqrt("h")).cast("int"))
        part = f"pmod(xxhash64(k.x, {1000 * seed + level}), h) = part"
        rows = (rows.withColumn("part", F.explode(F.expr("sequence(0, h - 1)")))
                .select("rid", "side", F.expr(f"filter(keys, k -> {part})").alias("keys")))
    return rows.where("size(keys) > 0")
