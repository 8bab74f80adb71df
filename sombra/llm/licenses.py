"""Operator 10: license scans.

Templates (notices and the telling paragraphs of licenses) are sets of word
shingles.  A text is read in overlapping windows, for every size class of
template (a power of two of shingles) windows of twice the class at half
overlap, so each occurrence lies whole in a window.  A window retrieves the
templates with which it shares a MinHash band; bands have one row and their
number is set so that a window that contains the template to ``share`` is
missed with a chance of at most ``MISS``.  Retrieved templates are verified by
exact containment of their shingles in the window.

A band can only match through a shingle that is the template's own minimum in
that band.  Windows without any such shingle therefore match nothing, and only
the others get a signature: the same matches, found without hashing every
window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, mix64, shingle_hashes, slices, text_bytes, word_hashes, word_spans

WORDS, SHARE, MISS = 5, 0.8, 1e-4

# Notices of common licenses
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                      "and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}

# Words are runs of ASCII letters and digits and of bytes beyond ASCII
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(buf, off):
    s, e, row = word_spans(buf, off, _BREAK)
    return s, e, row, word_hashes(buf, s, e, _BREAK)


def bands(share: float, ratio: float, miss: float) -> int:
    """One-row bands so that a window at this Jaccard similarity at least
    (the template's shingles by the window's) is missed with chance ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - share * ratio))


class Scanner:
    """Templates grouped by (words per shingle, size class)."""

    def __init__(self, templates: dict[str, str], words: int = WORDS, share: float = SHARE, miss: float = MISS):
        self.share = share
        self.classes: dict[tuple[int, int], list] = {}
        for name, text in sorted(templates.items()):
            buf = np.frombuffer(text.encode(), np.uint8)
            _, _, row, w = _words(buf, np.array([0, len(buf)]))
            if not len(w):
                continue
            k = min(words, len(w))
            own = np.unique(shingle_hashes(w, row, k)[0])
            size = 1 << (len(own) - 1).bit_length()
            self.classes.setdefault((k, size), []).append((name, own))
        # least Jaccard similarity: share * T of the union of 2 * size window
        # shingles and the missing ones of the template, T > size / 2
        self.bands = bands(share, 1 / (4 + 1 - share), miss)
        seeds = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, self.bands, dtype=np.uint64)
        self.seeds = seeds * np.uint64(2) + np.uint64(1)
        self.signs = {c: [self.signature(own) for _, own in t] for c, t in self.classes.items()}
        # the shingle that gives a template its minimum in each band
        self.keys = {}
        for c, t in self.classes.items():
            pick = [own[self._hash(own).argmin(1)] for _, own in t]
            self.keys[c] = np.unique(np.concatenate(pick))

    def _hash(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(h[None] * self.seeds[:, None])

    def signature(self, h: np.ndarray) -> np.ndarray:
        return self._hash(h).min(1)

    def scan(self, col: pa.Array) -> list[tuple[int, str, int, int, float]]:
        """(row, template, start byte, end byte, containment)."""
        out = []
        for i, j in slices(col, 1 << 20):
            buf, off = text_bytes(col, i, j)
            s, e, row, w = _words(buf, off)
            by_k = {}
            for (k, size), temps in self.classes.items():
                if k not in by_k:
                    by_k[k] = shingle_hashes(w, row, k)
                h, hrow, first = by_k[k]
                if len(h):
                    out += [(i + r, name, int(s[a] - off[r]), int(e[b] - off[r]), c)
                            for r, name, a, b, c in self._class(k, size, temps, h, hrow, first)]
        return out

    def _class(self, k, size, temps, h, hrow, first):
        keys = self.keys[k, size]
        # a bit table over the top 16 bits first, then the exact test
        bit = np.zeros(1 << 16, bool)
        bit[(keys >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(bit[(h >> np.uint64(48)).astype(np.int64)])
        at = at[np.isin(h[at], keys)]
        if not len(at):
            return []
        begin = np.searchsorted(hrow, hrow[at])             # first shingle of each hit's row
        stop = np.searchsorted(hrow, hrow[at], "right")
        number = (at - begin) // size                         # windows start at multiples of size
        wins = sorted({(int(r), int(b), int(x), int(n)) for r, b, x, m in zip(hrow[at], begin, stop, number, strict=True)
                       for n in (m - 1, m) if n >= 0})
        found = []
        for r, b, x, n in wins:
            lo, hi = b + n * size, min(x, b + (n + 2) * size)
            sig = self.signature(np.unique(h[lo:hi]))
            for (name, own), sign in zip(temps, self.signs[k, size], strict=True):
                if (sig == sign).any():
                    found += [(r, name, int(first[a]), int(first[z]) + k - 1, c) for a, z, c in self._all(h, lo, hi, own)]
        return self._merge(found)

    def _all(self, h, lo, hi, own):
        """(first shingle, last shingle, containment) of every stretch of
        lo..hi that holds the template: the tightest is cut out, what lies on
        either side of it is verified again."""
        out, todo = [], [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            need = int(np.isin(own, h[lo:hi]).sum())
            if not need or need / len(own) < self.share:
                continue
            # the narrowest stretch from first to last match of the densest run
            a, z = self._tight(h, np.flatnonzero(np.isin(h[lo:hi], own)) + lo, own, need)
            out.append((int(a), int(z), need / len(own)))
            todo += [(lo, int(a)), (int(z) + 1, hi)]
        return out

    @staticmethod
    def _tight(h, pos, own, need):
        """Shortest stretch of positions that holds ``need`` different template
        shingles (two pointers)."""
        best, count, lo = (0, len(pos) - 1), {}, 0
        for hi, p in enumerate(pos):
            count[h[p]] = count.get(h[p], 0) + 1
            while len(count) == need:
                if pos[hi] - pos[lo] < pos[best[1]] - pos[best[0]]:
                    best = (lo, hi)
                x = h[pos[lo]]
                count[x] -= 1
                if not count[x]:
                    del count[x]
                lo += 1
        return pos[best[0]], pos[best[1]]

    @staticmethod
    def _merge(found):
        """Overlapping finds of a template in a row: the fullest, then the
        shortest, then the first."""
        kept = []
        for f in sorted(set(found), key=lambda f: (-f[4], f[3] - f[2], f[0], f[2])):
            if not any(g[0] == f[0] and g[1] == f[1] and g[2] <= f[3] and f[2] <= g[3] for g in kept):
                kept.append(f)
        return kept


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, words: int = WORDS, share: float = SHARE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, end, containment), code points, end exclusive:
    every stretch of a text that holds ``share`` of a template's shingles of
    ``words`` words (a shorter template is one shingle).

    The templates are a parameter of bounded size, sent with the plan.  Null or
    empty text: no rows; null ids stay; repeated rows give their finds each.
    A template found several times gives a row for each stretch that no other
    find of it overlaps (of overlapping ones the fullest, then the shortest)."""
    scanner = Scanner(TEMPLATES if templates is None else templates, words, share)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches):
        for b in batches:
            col = b.column("text")
            found = sorted(shared.value.scan(col))
            if not found:
                continue
            spans = []
            for r, _, s, e, _ in found:
                raw = col[r].as_py().encode()
                a = len(raw[:s].decode())
                spans.append((a, a + len(raw[s:e].decode())))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array([f[0] for f in found])), pa.array([f[1] for f in found]),
                 pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64()),
                 pa.array([f[4] for f in found], pa.float64())],
                names=["doc_id", "license", "start", "end", "containment"])
    return map_arrow(docs.select(*id_text(id_col, text_col)), run,
                     "doc_id long, license string, start long, end long, containment double")
