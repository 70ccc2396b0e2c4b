"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import let, lower_ascii

SHINGLE = 5
CONTAINMENT = 0.8
# Windows of four blocks, one block apart; a block has at least half as many shingles as the template,
# rounded up to a power of two. So a run of up to one and a half template lengths lies whole in some
# window, and a copy with 0.8 of the shingles has a similarity of at least 0.2 to it: a band of one row
# meets with that chance, and none of 48 does with a chance of 2 in 100,000.
BANDS = 48
_SEGMENT = 1 << 12
_NEVER = np.iinfo(np.uint32).max

# Wording of public license notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    # of notices that differ by a word or a number only the part around it, or each would be found in the others
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version"),
    ("LGPL", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def license_words(text: Column) -> Column:
    """Runs of letters and digits, A-Z in lower case; a null text has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: Column) -> Column:
    rows = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(F.concat_ws(" ", *[w[i + k] for k in range(SHINGLE)])))
    return F.when(F.size(w) >= SHINGLE, rows).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def plain_words(text: str) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.split(r"[^\w]+|_+", low) if w]


def shingle_list(words: Sequence[str]) -> list[str]:
    if len(words) < SHINGLE:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


class Bands:
    """Templates by number of distinct shingles, and the sorted (band, value) pairs that lead to them."""

    def __init__(self, templates: Sequence[tuple[str, str]], bands: int = BANDS):
        self.factors = np.random.default_rng(23).integers(0, 1 << 31, bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.names = [name for name, _ in templates]
        self.shingles = [frozenset(shingle_list(plain_words(text))) for _, text in templates]
        self.steps: dict[int, list[int]] = {}
        for t, s in enumerate(self.shingles):
            if s:
                self.steps.setdefault(1 << (-(-len(s) // 2) - 1).bit_length(), []).append(t)
        hashes = [np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64) for s in self.shingles]
        self.minima = [self.hashed(h).min(axis=1) if len(h) else None for h in hashes]

    def hashed(self, shingles: np.ndarray) -> np.ndarray:
        """One value per band and shingle; equal minima of two sets mean a meeting in that band."""
        return (shingles >> np.uint64(32)).astype(np.uint32)[None, :] * self.factors[:, None]

    def windows(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first shingle, end) of each window that meets a template in a band."""
        widest = max(self.steps, default=1)
        for low in range(0, max(1, len(shingles) - 4 * widest), _SEGMENT):
            part = shingles[low : low + _SEGMENT + 4 * widest]
            if not len(part):
                return
            # room for whole blocks of every length and three more behind the last
            blocks, step = np.full((len(self.factors), (-(-len(part) // widest) + 4) * widest), _NEVER, np.uint32), 1
            blocks[:, : len(part)] = self.hashed(part)
            while True:
                if step in self.steps:
                    n = -(-len(part) // step)
                    pairs = np.minimum(blocks[:, : n + 2], blocks[:, 1 : n + 3])
                    least = np.minimum(pairs[:, :n], pairs[:, 2:])
                    for t in self.steps[step]:
                        for at in np.flatnonzero((least == self.minima[t][:, None]).any(axis=0)):
                            yield t, low + int(at) * step, min(len(shingles), low + (int(at) + 4) * step)
                if step >= widest:
                    break
                # blocks twice as long are minima of two
                blocks, step = np.minimum(blocks[:, ::2], blocks[:, 1::2]), 2 * step


def _scan(bands: Bands, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists, words = batch.column("shingles"), batch.column("words")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            for row, (start, end) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                best: dict[int, tuple] = {}
                for t, first, last in bands.windows(flat[start:end]):
                    span = words[row].values.slice(first, last - first + SHINGLE - 1).to_pylist()
                    found = shingle_list(span)
                    hits = [i for i, s in enumerate(found) if s in bands.shingles[t]]
                    share = len({found[i] for i in hits}) / len(bands.shingles[t])
                    if share >= threshold:
                        run = (-share, first + hits[0], first + min(hits[-1] + SHINGLE, len(span)))
                        best[t] = min(best.get(t, run), run)
                by_name: dict[str, tuple] = {}
                for t, run in best.items():
                    by_name[bands.names[t]] = min(by_name.get(bands.names[t], run), run)
                out += [(row, name, -run[0], run[1], run[2]) for name, run in sorted(by_name.items())]
            rows, names, shares, firsts, lasts = zip(*out) if out else ([],) * 5
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            arrays = [ids, pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "license", "containment", "first_word", "end_word"])

    return scan


def license_scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, license, containment, first_word, end_word): the best find of each license in each text.

    ``templates`` are (license, wording) pairs, given by the caller and held by every task; a license
    may have several. A find contains at least ``threshold`` of the distinct five-word shingles of a
    wording within one window; words are runs of letters and digits, A-Z in lower case. The fullest
    window counts, of equal ones the first; positions count words from 0. Wordings of fewer than five
    words are one shingle, found only where a text consists of those words. Texts are scanned whole,
    each alone: no shuffle, whatever repeats. Null, empty and clean texts give no row, repeated rows
    repeat theirs, a null doc_id stays null. Other columns are not read, whatever their names.
    """
    prepared = docs.select(F.col(doc_id).cast("long").alias("doc_id"), let(license_words(F.col(text)), lambda w: F.struct(w.alias("words"), _shingles(w).alias("shingles"))).alias("w"))
    rows = prepared.select("doc_id", "w.words", "w.shingles")
    return rows.mapInArrow(_scan(Bands(templates), threshold), "doc_id long, license string, containment double, first_word long, end_word long")
