"""License scans: MinHash bands over overlapping windows, then exact containment.

Template texts and documents become shingles of five words. A template of n
shingles belongs to the class of the smallest power of two c with n <= c. It is
matched where a run of c shingles has 0.8 of its distinct ones. The windows of a
class are two blocks of c shingles, a block apart, so one window holds all of any
run of c. A window that holds 0.8 of a template has a Jaccard similarity with it
of at least 0.8 n / (2 c + 0.2 n), which is over 0.19 as n > c / 2. With 64 bands
of one minimum each, it collides with the template with a probability of
1 - 0.81 ** 64, more than 0.999998. What collides is verified exactly.

Texts of several licenses differ in a version or a word only. So a match also
needs, against each template of another license, half of the shingles that this
one lacks, and of matches of different licenses that overlap the one with the
most shingles stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .decontaminate import item_words
from .fm_index import expand
from .store import ship_code
from .words import mix, rolling, sliced, text_bytes, whole_windows

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8

#: Share of the shingles that tell a template from one of another license.
TELLING = 0.5

#: Texts that tell a license (fixed values): short notices, and opening paragraphs of license texts.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0BSD": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE',
    ],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
}

RESULT = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("template", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("containment", T.DoubleType()),
    ]
)
_MULTIPLIERS = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


class Templates:
    """Shingles and minima of the templates, by class."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.names = [(name, i, t) for name, ts in texts.items() for i, t in enumerate(ts)]
        w = item_words(*text_bytes(pa.array([t for _, _, t in self.names], pa.large_string())))
        short = [self.names[i][:2] for i in np.flatnonzero(w.counts < SHINGLE)]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        at = whole_windows(w, SHINGLE)
        h, doc = rolling(w.hashes(), SHINGLE)[at], w.doc_of()[at]
        self.shingles = [np.unique(h[doc == i]) for i in range(len(self.names))]
        #: What a template has that one of another license lacks, where they have some in common.
        self.telling = [
            [np.setdiff1d(s, t) for (n, _, _), t in zip(self.names, self.shingles, strict=True) if n != name and np.isin(s, t).any()]
            for (name, _, _), s in zip(self.names, self.shingles, strict=True)
        ]
        self.by_class: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            self.by_class.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        minima = np.array([[(s * m).min() for m in _MULTIPLIERS] for s in self.shingles])
        self.all = np.unique(np.concatenate(self.shingles))
        self.tops = np.zeros(1 << 16, bool)  # of their first 16 bits
        self.tops[self.all >> np.uint64(48)] = True
        #: By class and band the members' minima, sorted, and whose they are.
        self.bands: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for c, members in self.by_class.items():
            own = minima[members]
            order = np.argsort(own, axis=0, kind="stable")
            self.bands[c] = [(own[order[:, b], b], np.array(members)[order[:, b]]) for b in range(BANDS)]

    def known(self, h: np.ndarray) -> np.ndarray:
        """Where shingles stand that some template has."""
        at = np.flatnonzero(self.tops[h >> np.uint64(48)])
        return at[np.isin(h[at], self.all)]


def _collisions(h: np.ndarray, first: np.ndarray, templates: Templates) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: the windows (from, to) that collide with a template in some band, and the template.

    A window whose minimum is a template's holds that shingle of the template, so
    bands are only made for windows that hold a shingle of some template.
    """
    at = templates.known(h)
    doc = np.searchsorted(first, at, "right") - 1
    out = {}
    for c in templates.by_class if len(at) else ():
        block = (at - first[doc]) // c
        windows = np.unique(np.concatenate([np.stack([doc, block], 1), np.stack([doc, block - 1], 1)]), axis=0)
        windows = windows[windows[:, 1] >= 0]
        lo = first[windows[:, 0]] + windows[:, 1] * c
        hi = np.minimum(lo + 2 * c, first[windows[:, 0] + 1])
        places, _ = expand(lo, hi)
        starts, x, found = np.cumsum(hi - lo) - (hi - lo), h[places], []
        for m, (minima, owner) in zip(_MULTIPLIERS, templates.bands[c], strict=True):
            least = np.minimum.reduceat(x * m, starts)
            a, z = np.searchsorted(minima, least, "left"), np.searchsorted(minima, least, "right")
            hit = np.flatnonzero(z > a)
            if len(hit):
                which, of = expand(a[hit], z[hit])
                found.append(np.stack([hit[of], owner[which]], 1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            out[c] = lo[pairs[:, 0]], hi[pairs[:, 0]], pairs[:, 1]
    return out


def _places(h: np.ndarray, i: int, c: int, templates: Templates) -> list[tuple[int, int, int]]:
    """Runs of c shingles, beginning with one of template i, that match it: (first, last of the template's, how many different ones)."""
    own, telling = templates.shingles[i], templates.telling[i]
    at = np.flatnonzero(np.isin(h, own))
    if len(at) < CONTAINMENT * len(own):
        return []
    ends = np.searchsorted(at, at + c)
    out = []
    for k in np.flatnonzero(ends - np.arange(len(at)) >= CONTAINMENT * len(own)):
        run = np.unique(h[at[k : ends[k]]])
        if len(run) >= CONTAINMENT * len(own) and all(np.isin(x, run).sum() >= TELLING * len(x) for x in telling):
            out.append((int(at[k]), int(at[ends[k] - 1]), len(run)))
    return out


def _scan(h: np.ndarray, first: np.ndarray, templates: Templates) -> list[tuple[int, int, int, int, float]]:
    """(text, template, from, to, containment) of the matches; h: shingles in a row, those of text d from first[d] on."""
    if not len(h):
        return []
    found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    for c, windows in _collisions(h, first, templates).items():
        for lo, hi, i in zip(*(x.tolist() for x in windows), strict=True):
            d = int(np.searchsorted(first, lo, "right")) - 1
            base = lo - int(first[d])
            for a, z, n in _places(h[lo:hi], i, c, templates):
                found.setdefault((d, i), set()).add((a + base, z + base + SHINGLE, n))
    spans: dict[int, list[tuple[int, float, int, int, int]]] = {}
    for (d, i), places in found.items():
        joined: list[list[int]] = []
        for a, z, n in sorted(places):
            if joined and a < joined[-1][1]:
                joined[-1][1], joined[-1][2] = max(z, joined[-1][1]), max(n, joined[-1][2])
            else:
                joined.append([a, z, n])
        spans.setdefault(d, []).extend((-n, -n / len(templates.shingles[i]), i, a, z) for a, z, n in joined)
    out = []
    for d, matches in spans.items():
        kept: list[tuple[str, int, int]] = []
        for _, share, i, a, z in sorted(matches):
            name = templates.names[i][0]
            if all(name == other or z <= x or a >= y for other, x, y in kept):
                kept.append((name, a, z))
                out.append((d, i, a, z, -share))
    return sorted(out)


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """The documents with ``matches``: license, number of its template, words from and to, and containment.

    Words are runs of letters and digits, A-Z lower-cased. A match has at least
    0.8 of a template's distinct shingles, and half of those that tell it from
    each other license, in a run of as many shingles as its class has; runs of one template
    that overlap are one match, from the first to the last of its shingles. Of
    overlapping matches of different licenses the one with more shingles stays
    (in a tie, the one with the larger containment, then the first template).
    Null and empty texts, and texts of fewer than five words, have none; an empty
    table gives an empty result. Whole texts are scanned, of any length. Repeated
    rows are scanned each by itself; an input column named ``matches`` is
    replaced. Nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_code(docs.sparkSession)
    docs = docs.drop("matches") if text != "matches" else docs
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", T.ArrayType(RESULT))])
    arrow = to_arrow_schema(schema)
    known = Templates(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sliced(batches, text):
            w = item_words(*text_bytes(t.column(text)))
            at = whole_windows(w, SHINGLE)
            h = rolling(w.hashes(), SHINGLE)[at]
            matches: list[list[dict]] = [[] for _ in range(t.num_rows)]
            for d, i, lo, hi, share in _scan(h, np.searchsorted(at, w.first), known):
                matches[d].append({"license": known.names[i][0], "template": known.names[i][1], "start": lo, "end": hi, "containment": share})
            yield from t.append_column("matches", pa.array(matches, arrow.field("matches").type)).select(arrow.names).cast(arrow).to_batches()

    return docs.mapInArrow(scan, schema)
