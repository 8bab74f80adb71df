"""Operator 5: BPE encoding and decoding.

The merges of a public word-end BPE vocabulary are applied to each distinct
white-space-delimited piece by a priority queue of merge ranks over a doubly
linked symbol list: a popped entry whose symbols have changed is stale and
skipped.  Decoding joins the vocabulary strings of the ids with single blanks,
as the vocabulary file (it names no decoder) asks.

Text is cut at white space first: no pre-token of the vocabulary's pattern
crosses it, and neither NFC nor lower-casing joins characters across it.  Each
Python worker keeps the encodings of the pieces met first (a bounded memo,
``MEMO`` entries); it only saves work.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import TOKENIZER, id_text, map_arrow, tokenizer_path

MEMO = 500_000

# The vocabulary file's pre-token pattern (and the same for ASCII);
# white space is Unicode's, without the four separators that Python's \s adds
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# White space of the pattern: Python's str.split() also cuts at these four
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_SPACES = re.compile(r"[^\S\x1c\x1d\x1e\x1f]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: printable Latin-1 bytes stand for themselves, the others get
    the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    keep = set(own)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Bpe:
    """Vocabulary, merge ranks and the encoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        sym = byte_symbols()
        self.inner = [self.vocab[c] for c in sym]
        self.final = [self.vocab[c + self.suffix] for c in sym]
        self.path, self.library = path, None
        self.byte_of = {c: b for b, c in enumerate(sym)}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, tuple[bytes, str]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        heap = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = new, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                m = merges.get((new, ids[k]))
                if m:
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            h = left[i]
            if h >= 0:
                m = merges.get((ids[h], new))
                if m:
                    heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def pre_tokens(self, raw: str) -> list[bytes]:
        """UTF-8 of the pre-tokens of a piece without white space."""
        if raw.isascii():
            return [t.encode() for t in _ASCII.findall(raw.lower())]
        if any(unicodedata.category(c) == "Cn" for c in raw):
            # characters newer than Python's tables: the file's own splitting
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            text = self.library.normalizer.normalize_str(raw)
            return [bytes(self.byte_of[c] for c in t) for t, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        text = unicodedata.normalize("NFC", raw)
        # lower-case each character by itself (a final sigma stays as it is)
        low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return [t.encode() for t in _PATTERN.findall(low)]

    def piece(self, raw: str) -> tuple[bytes, str]:
        """(ids as little-endian uint32, decoded) of a piece without white space."""
        ids = [i for t in self.pre_tokens(raw) for i in self.merge(t)]
        return np.array(ids, "<u4").tobytes(), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def _pieces(self, text: str) -> list[str]:
        if any(c in text for c in _NOT_SPACE):
            return [p for p in _SPACES.split(text) if p]
        return text.split()

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian uint32, decoded text) of a whole text."""
        if self.cut is not None and "<|" in text:
            found = []
            for part in self.cut.split(text):
                if part in self.special:
                    i = self.special[part]
                    found.append((np.array([i], "<u4").tobytes(), self.strings[i]))
                else:
                    found += self._lookup(self._pieces(part))
        else:
            found = self._lookup(self._pieces(text))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])

    def _lookup(self, pieces: list[str]) -> list[tuple[bytes, str]]:
        memo = self.memo
        found = list(map(memo.get, pieces))
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    p = pieces[i]
                    f = memo.get(p) or self.piece(p)
                    found[i] = f
                    if len(memo) < MEMO:
                        memo[p] = f
        return found


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder per file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string): ids as little-endian unsigned
    32-bit integers and the text they decode to.  ``vocabulary`` is the path of
    a vocabulary file on every executor (default: the public word-end one).
    Null or empty text: no ids, empty decoded text.  One row per input row."""
    def run(batches):
        bpe = load(vocabulary or tokenizer_path(TOKENIZER))
        for b in batches:
            ids, texts = [], []
            for t in b.column("text").to_pylist():
                i, d = bpe.encode(t)
                ids.append(i)
                texts.append(d)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "decoded"])
    return map_arrow(docs.select(*id_text(id_col, text_col)), run, "doc_id long, ids binary, decoded string")
