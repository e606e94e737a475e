"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a block of lines that each have a word, so it ends at a blank line or
with the text; a line feed in it is a space like any other.  Its features are the word 1- to 3-grams (runs of
letters and digits, lower case) that occur in any template.  A multinomial logistic
regression over the licence families and an unknown class is trained on the driver:
licence rows are templates, cut to contiguous parts and set among words of the
corpus; unknown rows are paragraphs of a bounded sample of documents, and templates'
words out of order.  Temperature and the least probability of a family are calibrated
on rows held back.  Template comparison finds the places: the shortest stretches of a
paragraph that have at least ``CONFIRM`` of a notice's 3-grams, filled up to where the
whole notice would stand.  The classifier reads the words of each place, and every
family that it gives the least probability or more there is reported; only a notice
that is partly there yields to one of another family that is there to a larger share
and overlaps it, as the LGPL's does with the GPL's.

Defined cases: null and empty texts have no paragraph and no licence; repeated rows
are scanned each; an empty table gives an empty result; a sample without paragraphs
leaves the shuffled templates as unknown rows; only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bytesops as B
from .ctw import LOWER, Index

#: Public notices by which licence families are named in texts.
NOTICES = {
    "AGPL-3.0": ("licensed under the GNU Affero General Public License version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "released under the CC0 1.0 Universal public domain dedication"),
    "GPL-2.0": ("licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "licensed under the ISC License"),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "MIT": ("Released under the MIT License", "licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License Version 2.0"),
    "Proprietary": ("All rights reserved",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
ORDER, CONFIRM = 3, 0.7
#: Documents, about, whose paragraphs are unknown rows; rows of each family; passes of the training.
SAMPLE_DOCUMENTS, ROWS_A_FAMILY, PASSES = 2000, 120, 150
#: Share of unknown rows held back that may be called a family, before confirmation.
FALSE = 0.002

TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, number of the paragraph of each, and where the paragraphs begin and end."""
    lower = LOWER[data]
    starts, ends = B.runs(TOKEN[lower])
    feeds = np.flatnonzero(data == 10)
    line, doc = np.searchsorted(feeds, starts), np.searchsorted(offsets, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] > line[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    begins = np.append(0, feeds + 1)[line[first]]
    return B.span_hash(B.prefix_hash(lower), starts, ends), np.cumsum(new) - 1, begins, feeds[line[last]]


def grams(words: np.ndarray, block: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within paragraphs, and their paragraphs."""
    h = B.window_hash(words, n) + np.uint64(n)
    at = np.flatnonzero(block[: len(h)] == block[n - 1 :]) if len(h) else np.zeros(0, int)
    return h[at], block[at]


def spell(text: str) -> tuple[np.ndarray, np.ndarray]:
    words, block, _, _ = tokens(*B.closed(pa.array([text.replace("\n", " ")])))
    return words, block


@dataclass
class Scanner:
    families: list[str]
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float
    least: float
    notices: list[tuple[int, np.ndarray]]

    def __post_init__(self):
        self.index = Index(self.keys)
        self.at = self.index.sort(np.arange(len(self.keys)))
        self.trigrams = np.unique(np.concatenate([g for _, g in self.notices]))
        self.trigram_index = Index(self.trigrams)
        self.trigram_at = self.trigram_index.sort(np.arange(len(self.trigrams)))
        # where each 3-gram first stands in each notice, or -1
        self.place = np.full((len(self.notices), len(self.trigrams)), -1)
        for k, (_, g) in enumerate(self.notices):
            self.place[k, np.searchsorted(self.trigrams, g)[::-1]] = np.arange(len(g))[::-1]

    def features(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the distinct features of a paragraph."""
        found = []
        for n in range(1, ORDER + 1):
            h, _ = grams(words, np.zeros(len(words), int), n)
            at = self.index.find(h)
            found.append(self.at[at[at >= 0]])
        return np.unique(np.concatenate(found))

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.weights[r].sum(axis=0) + self.bias for r in rows]).reshape(len(rows), len(self.bias)) / self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def containment(self, words: np.ndarray) -> np.ndarray:
        """For each family, the largest share of a notice's n-grams that the paragraph has."""
        own, _ = grams(words, np.zeros(len(words), int), ORDER)
        out = np.zeros(len(self.families))
        for family, g in self.notices:
            out[family] = max(out[family], np.isin(g, own).mean())
        return out

    def places(self, grams_: np.ndarray, at: np.ndarray, first: int, last: int) -> list[tuple[int, float, int, int]]:
        """Family, share of the notice, first word and end of the places in a paragraph that have CONFIRM of a notice's n-grams.

        ``grams_`` are the numbers of its template n-grams, ``at`` the words where they begin.
        """
        here = np.zeros(len(self.trigrams), bool)
        here[grams_] = True
        of, out = self.place >= 0, []
        for k in np.flatnonzero((of & here).sum(axis=1) >= CONFIRM * of.sum(axis=1)):
            family, size = self.notices[k][0], len(self.notices[k][1])
            hit = np.flatnonzero(of[k, grams_])
            own, word, place = grams_[hit], at[hit], self.place[k, grams_[hit]]
            held: dict[int, int] = {}
            left, distinct, spans = 0, int(of[k].sum()), set()
            for right, g in enumerate(own.tolist()):
                held[g] = held.get(g, 0) + 1
                if len(held) < CONFIRM * distinct:
                    continue
                while held[int(own[left])] > 1 or len(held) - 1 >= CONFIRM * distinct:
                    held[int(own[left])] -= 1
                    if not held[int(own[left])]:
                        del held[int(own[left])]
                    left += 1
                spans.add((max(first, int(word[left] - place[left])), min(last, int(word[right] - place[right]) + size + ORDER - 1)))
            taken: list[tuple[int, int]] = []
            for start, end in sorted(spans, key=lambda x: (x[1] - x[0], x[0])):
                i = bisect_left(taken, (start, end))
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end):
                    taken.insert(i, (start, end))
                    inside = own[np.searchsorted(word, start) : np.searchsorted(word, end - ORDER, "right")]
                    out.append((family, len(np.unique(inside)) / distinct, start, end))
        return out

    def named(self, words: np.ndarray, places: list[tuple[int, float, int, int]]) -> list[tuple[str, float, float]]:
        """Family, probability and share of the surest place of every family of a paragraph."""
        known: dict[bytes, np.ndarray] = {}
        found: list[tuple[int, int, int, float, float]] = []
        for family, share, start, end in places:
            own = words[start:end]
            if own.tobytes() not in known:
                known[own.tobytes()] = self.probabilities([self.features(own)])[0, 1:]
            p = float(known[own.tobytes()][family])
            if p >= self.least:
                found.append((start, end, family, p, share))
        found.sort()
        starts = np.array([x[0] for x in found])
        reach = np.maximum.accumulate(np.array([x[1] for x in found])) if found else starts
        best: dict[int, tuple[float, float]] = {}
        for start, end, family, p, share in found:
            near = found[np.searchsorted(reach, start, "right") : np.searchsorted(starts, end)]
            if not any(f != family and other > share and e > start for _, e, f, _, other in near):
                best[family] = max(best.get(family, (0.0, 0.0)), (p, share))
        return [(self.families[f], p, share) for f, (p, share) in best.items()]

    def scan(self, texts: pa.Array) -> list[list[tuple[str, float, float, int, int]]]:
        """For each text its licences: family, probability, share of the notice, start and end of the paragraph (bytes)."""
        data, offsets = B.closed(texts)
        words, block, begins, stops = tokens(data, offsets)
        h = B.window_hash(words, ORDER) + np.uint64(ORDER)
        found = self.trigram_index.find(h)
        at = np.flatnonzero((found >= 0) & (block[: len(h)] == block[ORDER - 1 :][: len(h)]))
        out: list[list[tuple[str, float, float, int, int]]] = [[] for _ in range(len(texts))]
        if not len(at):
            return out
        blocks, cuts = np.unique(block[at], return_index=True)
        for k, a, b in zip(blocks, cuts, np.append(cuts[1:], len(at)), strict=True):
            first, last = np.searchsorted(block, k), np.searchsorted(block, k, "right")
            d = int(np.searchsorted(offsets, begins[k], "right")) - 1
            for name, p, share in self.named(words, self.places(self.trigram_at[found[at[a:b]]], at[a:b], first, last)):
                out[d].append((name, p, share, int(begins[k] - offsets[d]), int(stops[k] - offsets[d])))
        return out


def train(unknown: list[np.ndarray], filler: np.ndarray, notices: dict[str, tuple[str, ...]] = NOTICES, seed: int = 1) -> Scanner:
    """``unknown``: word hashes of paragraphs that name no licence; ``filler``: words to set licence rows among."""
    rng = np.random.default_rng(seed)
    families = sorted(notices)
    spelled = [(f, spell(t)[0]) for f, k in enumerate(families) for t in notices[k]]
    keys = np.unique(np.concatenate([grams(w, np.zeros(len(w), int), n)[0] for _, w in spelled for n in range(1, ORDER + 1)]))
    short = [(f, grams(w, np.zeros(len(w), int), ORDER)[0]) for f, w in spelled]
    blank = Scanner(families, keys, np.zeros((len(keys), len(families) + 1)), np.zeros(len(families) + 1), 1.0, 0.5, short)
    rows: list[tuple[int, np.ndarray]] = []
    for f in range(len(families)):
        own = [w for g, w in spelled if g == f]
        for k in range(ROWS_A_FAMILY):
            w = own[k % len(own)]
            if k >= len(own) and len(w) > 6:  # a part of at least four fifths
                n = int(rng.integers(-(-len(w) * 4 // 5), len(w) + 1))
                a = int(rng.integers(0, len(w) - n + 1))
                w = w[a : a + n]
            if k % 3 and len(filler):
                w = np.concatenate([rng.choice(filler, int(rng.integers(0, 12))), w, rng.choice(filler, int(rng.integers(0, 12)))])
            rows.append((f + 1, blank.features(w)))
    for w in unknown:
        if blank.containment(w).max() < CONFIRM:
            rows.append((0, blank.features(w)))
    every = np.concatenate([w for _, w in spelled])
    for _ in range(ROWS_A_FAMILY * 4):
        rows.append((0, blank.features(rng.choice(every, int(rng.integers(1, 12))))))
    order = rng.permutation(len(rows))
    held, used = [rows[i] for i in order[::5]], [rows[i] for k, i in enumerate(order) if k % 5]
    y = np.array([c for c, _ in used])
    feats = np.concatenate([f for _, f in used])
    owner = np.repeat(np.arange(len(used)), [len(f) for _, f in used])
    target = np.eye(len(families) + 1)[y]
    weigh = (1 / np.bincount(y, minlength=len(families) + 1).clip(1))[y]
    weigh[y == 0] *= len(families)
    weigh /= weigh.mean()
    w, b = np.zeros((len(keys), len(families) + 1)), np.zeros(len(families) + 1)
    sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(PASSES):
        z = np.column_stack([np.bincount(owner, w[feats, c], len(used)) for c in range(w.shape[1])]) + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - target) * weigh[:, None]
        gw = np.column_stack([np.bincount(feats, error[owner, c], len(keys)) for c in range(w.shape[1])]) / len(used) + 1e-5 * w
        gb = error.mean(axis=0)
        sw += gw**2
        sb += gb**2
        w -= 0.5 * gw / np.sqrt(sw)
        b -= 0.5 * gb / np.sqrt(sb)
    made = Scanner(families, keys, w, b, 1.0, 0.5, short)
    yh = np.array([c for c, _ in held])
    best = np.inf
    for heat in np.geomspace(0.25, 8, 21):
        made.heat, was = float(heat), made.heat
        loss = -np.log(made.probabilities([f for _, f in held])[np.arange(len(held)), yh] + 1e-12).mean()
        if loss < best:
            best = loss
        else:
            made.heat = was
    p = made.probabilities([f for _, f in held])[:, 1:].max(axis=1)[yh == 0]
    made.least = float(np.clip(np.quantile(p, 1 - FALSE) if len(p) else 0.5, 0.5, 0.95))
    return made


#: Words of the sampled paragraphs, drawn at random, that notices are mixed with in training.
FILLER = 20_000


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 17) -> Scanner:
    """Train with unknown paragraphs of about SAMPLE_DOCUMENTS documents, picked by a hash of their id."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(text).alias("_text"))

    def paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, b in B.slices(texts):
                words, block, _, _ = tokens(*B.closed(texts.slice(a, b - a)))
                pick = np.random.default_rng([seed, len(words)]).permutation(np.unique(block))[: 3 * (b - a)]
                lo, hi = np.searchsorted(block, pick), np.searchsorted(block, pick, "right")
                yield pa.record_batch([pa.array([words[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary())], names=["words"])

    rows = sorted(bytes(r["words"]) for r in some.mapInArrow(paragraphs, "words binary").collect())
    unknown = [np.frombuffer(r, np.uint64) for r in rows]
    words = np.concatenate(unknown) if unknown else np.zeros(0, np.uint64)
    return train(unknown, np.random.default_rng(seed).choice(words, min(FILLER, len(words)), replace=False))


FOUND = "array<struct<family:string,score:double,share:double,start:int,end:int>>"


def scan(scanner: Scanner, text: Column) -> Column:
    """All licences of each whole text, with their places."""
    held = SparkSession.active().sparkContext.broadcast(scanner)
    kind = pa.list_(pa.struct([("family", pa.string()), ("score", pa.float64()), ("share", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    @arrow_udf(FOUND)
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for a, b in B.slices(texts):
            out += [[dict(zip(("family", "score", "share", "start", "end"), x, strict=True)) for x in row] for row in held.value.scan(texts.slice(a, b - a))]
        return pa.array(out, kind)

    return of(text)


def report(docs: DataFrame) -> DataFrame:
    """The query's columns: families in order of name, paragraphs that name one, the surest probability."""
    found = docs.select("doc_id", scan(fit(docs), F.col("text")).alias("f"))
    families = F.array_sort(F.array_distinct(F.transform("f", lambda x: x["family"])))
    return found.select("doc_id", F.array_join(families, ",").alias("licenses"), F.size(F.array_distinct(F.transform("f", lambda x: x["start"]))).cast("long").alias("n_paragraphs"), F.coalesce(F.array_max(F.transform("f", lambda x: x["score"])), F.lit(0.0)).alias("score"))
