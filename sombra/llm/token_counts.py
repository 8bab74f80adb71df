"""Operator 4: unigram token counts by trie-shared dynamic programming.

A unigram tokenizer cuts a pre-token into the vocabulary pieces with the
largest sum of log probabilities.  The vocabulary is a public one with word-end
pieces; its file holds no probabilities, so a piece has Zipf's law of its id, p
proportional to 1 / (id + 1).  Ties go to fewer tokens.

The distinct pre-tokens of a batch are visited in sorted order, which walks
their trie depth first: the forward scores of a prefix are computed once and
kept on a stack while words share it, and the word's own last step (the piece
that carries the word end) is stored as its terminal count.  Every byte is a
piece, so every pre-token has a segmentation.  Each Python worker keeps the
counts of the first ``MEMO`` white-space-delimited pieces it met.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _NOT_SPACE, _SPACES, Bpe, byte_symbols
from .common import TOKENIZER, id_text, map_arrow, tokenizer_path

MEMO = 500_000


class Unigram:
    def __init__(self, path: str):
        bpe = self.bpe = Bpe(path)
        size = len(bpe.vocab)
        norm = math.log(sum(1 / (i + 1) for i in range(size)))
        end = bpe.suffix
        self.inner, self.final = {}, {}
        for piece, i in bpe.vocab.items():
            p = -math.log(i + 1) - norm
            if piece.endswith(end) and len(piece) > len(end):
                self.final[piece[:-len(end)]] = p
            else:
                self.inner[piece] = p
        self.longest = max(max(map(len, self.inner)), max(map(len, self.final)))
        self.symbols = byte_symbols()
        self.memo: dict[str, tuple[int, int, float]] = {}

    def pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a piece without white space, as byte symbols."""
        sym = self.symbols
        return ["".join([sym[b] for b in t]) for t in self.bpe.pre_tokens(piece)]

    def forward(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """(tokens, log probability) of the best segmentation of each distinct
        word, walking the sorted words' trie."""
        inner, final, longest = self.inner, self.final, self.longest
        best, count = [0.0], [0]         # forward state of the current prefix
        last, out = "", {}
        for w in sorted(words):
            n = len(w)
            keep = 0
            limit = min(len(last), n)
            while keep < limit and last[keep] == w[keep]:
                keep += 1
            del best[keep + 1:], count[keep + 1:]
            for i in range(len(best), n):       # positions 1 .. n - 1 of the prefix
                score, tokens = -math.inf, 0
                for j in range(max(0, i - longest), i):
                    p = inner.get(w[j:i])
                    if p is not None:
                        s, c = best[j] + p, count[j] + 1
                        if s > score or (s == score and c < tokens):
                            score, tokens = s, c
                best.append(score)
                count.append(tokens)
            score, tokens = -math.inf, 0
            for j in range(max(0, n - longest), n):
                p = final.get(w[j:])
                if p is not None:
                    s, c = best[j] + p, count[j] + 1
                    if s > score or (s == score and c < tokens):
                        score, tokens = s, c
            out[w] = (tokens, score)
            last = w[:len(best) - 1]
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, log probability) of each text."""
        memo = self.memo
        split = [[p for p in _SPACES.split(t) if p] if any(c in t for c in _NOT_SPACE) else t.split() for t in texts]
        unseen = {p for ps in split for p in ps if p not in memo}
        late: dict[str, tuple[int, int, float]] = {}
        if unseen:
            parts = {p: self.pre_tokens(p) for p in unseen}
            done = self.forward(list({t for ts in parts.values() for t in ts}))
            for p, ts in parts.items():
                got = (len(ts), sum(done[t][0] for t in ts), sum(done[t][1] for t in ts))
                if len(memo) < MEMO:
                    memo[p] = got
                else:
                    late[p] = got
        out = []
        for ps in split:
            x = [memo.get(p) or late[p] for p in ps]
            out.append((sum(v[0] for v in x), sum(v[1] for v in x), math.fsum(v[2] for v in x)))
        return out


_LOADED: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, log_prob): pre-tokens, tokens of the best
    segmentation and its natural log probability, one row per input row over
    the whole text.  Null or empty text: zeros.  Special token strings in a text
    are ordinary text."""
    def run(batches):
        path = vocabulary or tokenizer_path(TOKENIZER)
        if path not in _LOADED:
            _LOADED[path] = Unigram(path)
        model = _LOADED[path]
        for b in batches:
            col = b.column("text").to_pylist()
            got = [x for lo in range(0, len(col), 2000) for x in model.count(col[lo:lo + 2000])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(np.array([g[k] for g in got], t)) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64))],
                names=["doc_id", "n_words", "n_tokens", "log_prob"])
    return map_arrow(docs.select(*id_text(id_col, text_col)), run, "doc_id long, n_words long, n_tokens long, log_prob double")
