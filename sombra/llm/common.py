"""Helpers shared by the operators: tables, shared storage, word hashing.

Null rules used by every operator unless its docstring says otherwise: a null
text is the empty text; a null id is kept as a null id; repeated rows are rows
of their own; columns the operator does not name are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, ship_package

TOKENIZER = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file lies (installed on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def materialise(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table into the cluster's shared checkpoint
    folder and read it back: cuts lineage, survives lost executors, and later
    readers prune its columns.  Removed when the session's JVM ends.  Hashes do
    not compress: ``codec`` "uncompressed" spares them the buffers."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/sombra-llm/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing will read again."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


_CACHES: dict[str, dict] = {}       # module -> what its functions keep in this Python worker


def worker_cache(module: str) -> dict:
    """The cache that ``module`` keeps in a Python worker from task to task."""
    return _CACHES.setdefault(module, {})


def forget_others(module: str) -> None:
    """Empty the caches of all modules but ``module``: a worker outlives the
    operator it worked for, and would hold that one's memos beside the next's."""
    for name, cache in _CACHES.items():
        if name != module:
            cache.clear()


def lean(fn: Callable) -> Callable:
    """``fn`` in a worker without other operators' caches, which gives Arrow's
    unused buffers back when it ends."""
    module = fn.__module__

    def run(batches):
        forget_others(module)
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package made importable on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(lean(fn), schema)


def id_text(id_col: str = "doc_id", text_col: str = "text") -> list:
    """The two columns most operators read, null text as empty."""
    return [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]


def slices(col: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column holding about ``max_bytes`` each (one row
    at least)."""
    off = text_offsets(col)
    n, i = len(col), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of rows i..j and the rows' offsets in them."""
    off = text_offsets(col)[i:j + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return buf, off - off[0]


# ---------------------------------------------------------------------------
# Words [^\x20\x09-\x0D]+ of lower-cased (A-Z) UTF-8 text, as 64-bit hashes
# ---------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.empty(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        m = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.full(m - 1, _BASE)]).cumprod(dtype=np.uint64)
    return _POWERS


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift multiply)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


_powers(64)


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; rows are delimited by ``off``, words by
    the bytes that ``space`` marks."""
    if not len(buf):
        z = np.empty(0, np.int64)
        return z, z, z
    solid = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, space: np.ndarray = _SPACE,
                lower: bool = True) -> np.ndarray:
    """64-bit polynomial hashes of words, lower-cased (A-Z) unless told
    otherwise, in one vector pass."""
    if not len(s):
        return np.empty(0, np.uint64)
    low = buf[s[0]:e[-1]]
    low = LOWER[low] if lower else low
    s, e = s - s[0], e - s[0]
    vals = _BYTE[low]
    vals[space[low]] = 0
    gap = np.diff(s, append=len(low))
    pos = np.arange(len(low)) - np.repeat(s, gap)
    with np.errstate(over="ignore"):
        vals *= _powers(int(gap.max()))[pos]
        return mix64(np.add.reduceat(vals, s) ^ (e - s).astype(np.uint64))


def shingle_hashes(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row: (hash, row, index of
    first word)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i:n + i]
    ok = np.flatnonzero(row[:n] == row[k - 1:])
    return mix64(h[ok]), row[ok], ok


def crc32_text(ids: list, mod: int) -> list[int | None]:
    """crc32 of the id as text, modulo ``mod`` (None for a null id)."""
    import zlib

    return [None if i is None else zlib.crc32(str(i).encode()) % mod for i in ids]
