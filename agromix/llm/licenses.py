"""Licence notices in texts: MinHash bands over overlapping windows retrieve templates, containment verifies them.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased; shingles are five words. Templates are put in
classes by size: a class holds those with up to S shingles, S a power of two, and its windows hold 2 S shingles and start
every S, so any notice lies whole in one of them. A band is one minimum of a window under one hash order; minima of
windows come from those of blocks, each block's from two of half its size, so every shingle is hashed once a band. A
window that holds the asked part of a template of t shingles has a similarity of at least ceil(0.8 t) / (2 S + t -
ceil(0.8 t)) with it; a class takes as many bands as make a miss less likely than one in a million (20 to 66). What a
band's table retrieves is verified by exact containment of shingles. Notices of a template that was found are counted
over the whole text: one ends where the template's shingles stop coming in its order, so adjacent ones are told apart.

Null and empty texts hold no notice. Rows that repeat, or have a null identifier, are scanned each. Of notices of one
template that hold equal parts of it, the shortest and then the first is returned. Long texts are scanned whole, in
chunks of shingles that overlap by a window. Other columns aren't read, whatever their names. An empty table gives no
rows. Templates of under five words are refused; what is shorter is a phrase, which is matched word for word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agromix.llm.common import mapped, text_of
from agromix.llm.near_dedup import ODD, _mix, shingles

__all__ = ["NOTICES", "PHRASES", "TEXTS", "Index", "bands_for", "phrase_index", "scan_licenses", "scan_phrases", "scan_text", "scan_texts", "template_index"]

#: Short notices as licensors ask for them.
NOTICES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
_BSD = 'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
#: Licence bodies and headers as they stand in files.
TEXTS = {
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "BSD-text": _BSD + _AS_IS,
    "GPL-header": _GNU,
    "LGPL-header": _GNU.replace("GNU General", "GNU Lesser General"),
    "AGPL-header": _GNU.replace("GNU General", "GNU Affero General"),
    "GNU-document": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
SPDX = ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense")
#: Matched word by word, whatever their length.
PHRASES = {"All-rights-reserved": "All rights reserved."} | {f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
#: Chance of missing a notice at the least containment; shingles of a chunk; bits of a band table's places.
MISSED, CHUNK, PLACES = 1e-6, 8192, 14
WORD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def _body(text: str) -> bytes:
    return text.encode().translate(WORD)


def _shingles(text: str) -> np.ndarray:
    return shingles(_body(text), labelled=False)


def phrase_index(phrases: dict[str, str]) -> list[tuple[str, int, int, bytes]]:
    """(name, number of words, the shingle of them all, the longest word) of each phrase."""
    split = {name: _body(text).split() for name, text in phrases.items()}
    return [(name, len(w), int(shingles(b" ".join(w), len(w), labelled=False)[0]), max(w, key=len)) for name, w in split.items()]


def scan_phrases(text: str, index: list[tuple[str, int, int, bytes]]) -> list[tuple[str, float, int, int, int]]:
    """As scan_text, of phrases that stand in the text word for word."""
    body, out = _body(text), []
    present = {word: word in body for word in {x[3] for x in index}}
    found: dict[int, np.ndarray] = {}
    for name, n, whole, word in index:
        if not present[word]:
            continue
        if n not in found:
            found[n] = shingles(body, n, labelled=False)
        if len(places := np.flatnonzero(found[n] == np.uint64(whole))):
            out.append((name, 1.0, int(places[0]), n, len(places)))
    return out


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * ODD)[:, None]


def _ranks(some: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Places of the shingles in each hash order (a row each); no two shingles share one."""
    out = (some[None, :] ^ seeds) * ODD
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def bands_for(sizes: list[int], size: int, containment: float) -> int:
    """Bands that find templates of ``sizes`` shingles in windows of 2 ``size`` but for a chance of MISSED."""
    least = 1.0
    for t in sizes:
        part = ceil(containment * t - 1e-9)
        least = min(least, part / (2 * size + t - part))
    return ceil(log(MISSED) / log(1 - least)) if least < 1 else 1


@dataclass
class _Class:
    """Templates of up to ``size`` shingles: names, their distinct shingles, minima by band, and the bands' tables of places."""

    size: int
    bands: int = 0
    names: list[str] = field(default_factory=list)
    own: list[np.ndarray] = field(default_factory=list)
    minima: list[np.ndarray] = field(default_factory=list)
    table: np.ndarray | None = None


@dataclass
class Index:
    """Templates by size class, and each template's shingles in its own order."""

    classes: dict[int, _Class]
    in_order: dict[str, np.ndarray]
    seeds: np.ndarray
    containment: float


def template_index(templates: dict[str, str], containment: float = 0.8) -> Index:
    classes: dict[int, _Class] = {}
    in_order = {}
    for name, text in templates.items():
        if len(text.encode().translate(WORD).split()) < 5:
            raise ValueError(f"template {name} has fewer than five words")
        in_order[name] = _shingles(text)
        own = np.unique(in_order[name])
        size = 1 << (len(own) - 1).bit_length()
        one = classes.setdefault(size, _Class(size))
        one.names.append(name)
        one.own.append(own)
    for one in classes.values():
        one.bands = bands_for([len(x) for x in one.own], one.size, containment)
    seeds = _seeds(max((x.bands for x in classes.values()), default=1))
    for one in classes.values():
        one.minima = [_ranks(x, seeds[: one.bands]).min(axis=1) for x in one.own]
        one.table = np.zeros(one.bands << PLACES, bool)
        for x in one.minima:
            one.table[(x >> np.uint64(64 - PLACES)).astype(np.int64) + (np.arange(one.bands) << PLACES)] = True
    return Index(classes, in_order, seeds, containment)


def _retrieved(s: np.ndarray, index: Index) -> Iterator[tuple[_Class, int, int]]:
    """(class, the template's place in it, window) where a window and a template share a minimum."""
    most = max(index.classes)
    chunk = max(CHUNK, 4 * most)
    for begin in range(0, len(s), chunk):
        part = s[begin : begin + chunk + most]
        pad = -len(part) % most
        blocks = np.full((len(index.seeds), len(part) + pad), ~np.uint64(0))
        blocks[:, : len(part)] = _ranks(part, index.seeds)
        size = 1
        while True:
            if (one := index.classes.get(size)) is not None:
                own = blocks[: one.bands]
                windows = np.minimum(own[:, :-1], own[:, 1:]) if own.shape[1] > 1 else own
                windows = np.concatenate((windows, own[:, -1:]), axis=1) if own.shape[1] > 1 else windows
                windows = windows[:, : chunk // size]
                places = (windows >> np.uint64(64 - PLACES)).view(np.int64) + (np.arange(one.bands) << PLACES)[:, None]
                some = np.flatnonzero(one.table[places].any(axis=0))
                for k, minima in enumerate(one.minima) if len(some) else ():
                    for w in some[(windows[:, some] == minima[:, None]).any(axis=0)].tolist():
                        yield one, k, begin // size + w
            if size == most:
                break
            size *= 2
            blocks = np.minimum(blocks[:, 0::2], blocks[:, 1::2])


def _notices(s: np.ndarray, template: np.ndarray, most: int, containment: float) -> list[tuple[float, int, int]]:
    """(share, first and last shingle) of notices that lie apart, each within ``most`` shingles, from the left.

    A notice is there once its part of the template's shingles is; it goes on as long as these come in the template's order.
    """
    kinds = np.unique(template)
    places = np.flatnonzero(np.isin(s, kinds))
    at: dict[int, list[int]] = {}
    for i, x in enumerate(template.tolist()):
        at.setdefault(x, []).append(i)
    hits = list(zip(places.tolist(), s[places].tolist(), strict=True))
    out, low, i, held = [], 0, 0, Counter()

    def drop_first() -> None:
        nonlocal low
        held[hits[low][1]] -= 1
        if not held[hits[low][1]]:
            del held[hits[low][1]]
        low += 1

    while i < len(hits):
        place, x = hits[i]
        held[x] += 1
        while place - hits[low][0] >= most:
            drop_first()
        i += 1
        if len(held) / len(kinds) < containment:
            continue
        last = _onward([y for _, y in hits[low:i]], at)
        while i < len(hits) and hits[i][0] - hits[low][0] < most and (more := next((k for k in at[hits[i][1]] if k > last), None)) is not None:
            last = more
            held[hits[i][1]] += 1
            i += 1
        while held[hits[low][1]] > 1 and len(at[hits[low][1]]) < held[hits[low][1]]:
            drop_first()
        out.append((len(held) / len(kinds), hits[low][0], hits[i - 1][0]))
        low = i
        held.clear()
    return out


def _onward(found: list[int], at: dict[int, list[int]]) -> int:
    """The template's place that ``found`` has come to, starting over where the order breaks."""
    last = -1
    for x in found:
        last = next((k for k in at[x] if k > last), at[x][0])
    return last


def scan_texts(found: list[np.ndarray], index: Index) -> list[list[tuple[str, float, int, int, int]]]:
    """For each text, given as its shingles: (template, containment, first word, words, notices) of the best notice of each template.

    The windows run over the shingles of all texts, one after another; what they retrieve is verified within each text.
    """
    at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
    spans: list[dict] = [{} for _ in found]
    if at[-1] and index.classes:
        s = np.concatenate(found)
        for one, k, w in _retrieved(s, index):
            low, high = w * one.size, min((w + 2) * one.size, len(s))
            for t in range(int(np.searchsorted(at, low, side="right")) - 1, int(np.searchsorted(at, high, side="left"))):
                begin, end = max(low, int(at[t])), min(high, int(at[t + 1]))
                places = np.flatnonzero(np.isin(s[begin:end], one.own[k])) + begin
                share = len(np.unique(s[places])) / len(one.own[k])
                if share >= index.containment:
                    spans[t].setdefault(one.names[k], (one.size, []))[1].append((share, int(places[0] - at[t]), int(places[-1] - at[t])))
    out = []
    for own, by_name in zip(found, spans, strict=True):
        rows = []
        for name, (size, windows) in by_name.items():
            apart = _notices(own, index.in_order[name], 2 * size, index.containment)
            best = max(apart + windows, key=lambda x: (x[0], -(x[2] - x[1]), -x[1]))
            rows.append((name, best[0], best[1], best[2] - best[1] + 5, len(apart)))
        out.append(sorted(rows))
    return out


def scan_text(text: str, index: Index) -> list[tuple[str, float, int, int, int]]:
    return scan_texts([_shingles(text)], index)[0]


def _scan(templates: dict[str, str], phrases: dict[str, str], containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, exact = template_index(templates, containment), phrase_index(phrases)
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                texts = [t.as_py() for t in batch.column(1)]
                found = scan_texts([_shingles(t) for t in texts], index)
                rows = [(one, *x) for one, text, some in zip(batch.column(0).to_pylist(), texts, found, strict=True) for x in some + scan_phrases(text, exact)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "license", "containment", "first_word", "n_words", "n_notices"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, phrases: dict[str, str] | None = None) -> DataFrame:
    """A row for each document and template with a notice of at least ``containment``, or phrase. Both are the module's if neither is given."""
    if not templates and not phrases:
        templates, phrases = NOTICES | TEXTS, PHRASES
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return mapped(rows, _scan(templates or NOTICES, phrases or {}, containment), "doc_id long, license string, containment double, first_word long, n_words long, n_notices long")
