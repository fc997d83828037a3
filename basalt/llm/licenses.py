"""License scans: TF-IDF cosine of sentences to templates, then inheritance from the nearest directory that holds a licence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .cut import cut

#: By SPDX identifier, the headers that point to a licence, its first lines, and whole short licence texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "This software is licensed under the Apache License, Version 2.0, see the LICENSE file.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "Creative Commons CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication."),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Released under the ISC License.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
}
#: What SPDX identifiers may carry after the name.
ENDINGS = ("", "-only", "-or-later")
#: A notice has so many terms at least: shorter sentences are words of some language too.
MIN_TERMS = 3
#: Terms are runs of ASCII letters and digits, and all non-ASCII bytes.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Templates:
    """Sparse TF-IDF vectors of the templates; a term that none holds weighs as much as one of a single template.

    Each template stands as a whole and by its paragraphs. Each licence has a line
    with its SPDX identifier too, which only a text with all the identifier's terms matches.
    """

    def __init__(self, templates: Mapping[str, Sequence[str]], threshold: float):
        rows: list[tuple[str, str, str]] = []
        for name, texts in sorted(templates.items()):
            for t in texts:
                parts = t.split("\n\n")
                rows += [(name, p, "") for p in ([t, *parts] if len(parts) > 1 else parts)]
            rows += [(name, f"SPDX-License-Identifier: {name}{e}", name) for e in ENDINGS]
        # A paragraph that several licences share tells none of them: only the whole texts do.
        holders: dict[str, set[str]] = {}
        for name, t, _ in rows:
            holders.setdefault(t, set()).add(name)
        rows = [r for r in rows if len(holders[r[1]]) == 1]
        self.names, self.threshold = [n for n, _, _ in rows], threshold
        terms = [Counter(words_of(t)) for _, t, _ in rows]
        df = Counter(w for t in terms for w in t)
        known = sorted(df)
        joined = b" ".join(known)
        hashes = tx.Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])).hashes
        order = np.argsort(hashes)
        self.hashes, place = hashes[order], {known[k]: i for i, k in enumerate(order.tolist())}
        self.idf = np.array([np.log((1 + len(rows)) / df[known[k]]) for k in order.tolist()])
        self.unknown = float(np.log(1 + len(rows)))
        self.weight = np.zeros((len(known), len(rows)))
        self.needed = np.zeros((len(known), len(rows)), bool)
        self.anchor = np.zeros(len(known), bool)
        for i, t in enumerate(terms):
            for w, n in t.items():
                self.weight[place[w], i] = (1 + np.log(n)) * self.idf[place[w]]
            self.needed[[place[w] for w in words_of(rows[i][2])], i] = True
            squares = self.weight[:, i] ** 2
            norm, left = squares.sum(), squares.sum()
            self.weight[:, i] /= np.sqrt(norm)
            for k in np.argsort(-squares, kind="stable").tolist():
                # Without any anchor, a text's cosine stays below the threshold (Cauchy-Schwarz).
                if left < threshold**2 * norm * (1 - 1e-9) or squares[k] == 0:
                    break
                self.anchor[k] = True
                left -= squares[k]
        self.needs = self.needed.sum(axis=0)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """The template term of each hash, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def score(self, hashes: np.ndarray, terms: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best cosine and template of each of n units, 0 where the cosine surely lies below the threshold."""
        _, first, count = np.unique(hashes ^ tx.mix(unit.astype(np.uint64)), return_index=True, return_counts=True)
        at, term = unit[first], terms[first]
        w = (1 + np.log(count)) * np.where(term >= 0, self.idf[term], self.unknown)
        norm = np.bincount(at, w * w, n)
        shared = np.bincount(at, np.where(term >= 0, w * w, 0), n)
        # A template is a unit vector: no cosine passes the share of known terms.
        live = np.flatnonzero((shared >= self.threshold**2 * norm * (1 - 1e-9)) & (norm > 0))
        best, which = np.zeros(n), np.zeros(n, np.int64)
        place = np.full(n, -1)
        place[live] = np.arange(len(live))
        rows = np.flatnonzero((place[at] >= 0) & (term >= 0))
        rows = rows[np.argsort(place[at[rows]], kind="stable")]
        units, heads = np.unique(place[at[rows]], return_index=True)
        heads = np.append(heads, len(rows))
        a = 0
        while a < len(units):
            # Whole units at a time, about 20,000 terms.
            b = max(a + 1, int(np.searchsorted(heads, heads[a] + 20_000)) - 1)
            b = min(b, len(units))
            group = rows[heads[a] : heads[b]]
            dots = np.add.reduceat(w[group, None] * self.weight[term[group]], heads[a:b] - heads[a])
            has = np.add.reduceat(self.needed[term[group]].astype(np.int32), heads[a:b] - heads[a])
            cosine = np.where(has >= self.needs, dots, 0) / np.sqrt(norm[live[units[a:b]]])[:, None]
            best[live[units[a:b]]], which[live[units[a:b]]] = cosine.max(axis=1), cosine.argmax(axis=1)
            a = b
        return best, which


def words_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    words = tx.Words(data, np.array([0, len(data)]), lower=True, between=BETWEEN)
    raw = words.data.tobytes()
    return [raw[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]


def unit_heads(data: np.ndarray, words: tx.Words) -> list[np.ndarray]:
    """For lines, sentences, paragraphs and whole files: which words begin one.

    A sentence ends at ``. ! ?`` before a blank, a paragraph at a line with no
    term, as comment marks are none; sentences end with their paragraph.
    """
    doc = np.append(True, words.doc[1:] != words.doc[:-1])
    breaks = tx.sums(data == 10, words.ends[:-1], words.starts[1:])
    full = np.zeros(len(data), bool)
    full[:-1] = np.isin(data[:-1], [33, 46, 63]) & tx.SPACE[data[1:]]
    line = doc | np.append(True, breaks > 0)
    paragraph = doc | np.append(True, breaks > 1)
    sentence = paragraph | np.append(True, tx.sums(full, words.ends[:-1], words.starts[1:]) > 0)
    return [line, sentence, paragraph, doc]


def scan_chunk(data: np.ndarray, offsets: np.ndarray, templates: Templates) -> list[tuple[str | None, float, float]]:
    """(licence, cosine, share of the terms that lie in notices) of each document."""
    n = len(offsets) - 1
    words = tx.Words(data, offsets, lower=True, between=BETWEEN)
    out: list[tuple[str | None, float, float]] = [(None, 0.0, 0.0)] * n
    if not len(words.starts):
        return out
    terms = templates.terms(words.hashes)
    anchor = (terms >= 0) & templates.anchor[terms]
    inside = np.zeros(len(terms), bool)
    best: dict[int, tuple[float, str]] = {}
    for head in unit_heads(words.data, words):
        heads = np.flatnonzero(head)
        ends = np.append(heads[1:], len(head))
        units = np.flatnonzero((tx.sums(anchor, heads, ends) > 0) & (ends - heads >= MIN_TERMS))
        sizes = (ends - heads)[units]
        at = tx.gather(heads[units], sizes)
        cosine, which = templates.score(words.hashes[at], terms[at], np.repeat(np.arange(len(units)), sizes), len(units))
        for k in np.flatnonzero(cosine >= templates.threshold).tolist():
            a, b = int(heads[units[k]]), int(ends[units[k]])
            inside[a:b] = True
            d, found = int(words.doc[a]), (-round(float(cosine[k]), 12), templates.names[which[k]])
            best[d] = min(best.get(d, found), found)
    share = tx.sums(inside, words.first[:-1], words.first[1:]) / np.maximum(words.counts, 1)
    for d, (cosine, name) in best.items():
        out[d] = name, -cosine, float(share[d])
    return out


def license_scan(
    files: DataFrame, path: str = "path", text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = 0.7, file_share: float = 0.25,
) -> DataFrame:
    """Every row of files but its text, with license, cosine, is_license_file, license_from.

    A line, sentence, paragraph (a header block, say) or whole file whose TF-IDF
    cosine with a template reaches ``threshold`` and that has MIN_TERMS terms is a
    notice; a file's own licence is that of its best notice (ties: the smaller name). A file is a licence file if notices hold at least ``file_share`` of
    its terms, or if it is named LICENSE, LICENCE, COPYING or NOTICE and has
    one; its licence becomes its directory's (of several, that of most such
    files, ties to the smaller name). A file without its own takes the licence
    of the nearest directory above it that has one: license_from is that
    directory, its own path where the notice is its own, or null.

    Directories are resolved once each, not once a file, and joined by path.
    Null paths inherit nothing; null and empty texts have no notice. Texts of any
    length are scanned whole. Repeated rows stay, and vote once each. Columns of
    files named like a new one are replaced. An empty table gives no rows.
    """
    new = ("license", "cosine", "is_license_file", "license_from", "_dir", "_own")
    kept = [c for c in files.columns if c not in new and c != text]
    known = Templates(templates, threshold)
    found = T.StructType([T.StructField("_own", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("_share", T.DoubleType())])

    def measure(column):
        rows = [r for _, _, data, offsets in tx.chunks(column) for r in scan_chunk(data, offsets, known)]
        return [list(x) for x in zip(*rows, strict=True)] or [[], [], []], None

    scanned = tx.map_columns(files.select(*kept, text), text, found, measure).drop(text)
    named = F.regexp_like(F.col(path), F.lit(r"(^|/)(LICENSE|LICENCE|COPYING|NOTICE)([.][A-Za-z]+)?$"))
    scanned = scanned.withColumns({
        "is_license_file": F.col("_own").isNotNull() & ((F.col("_share") >= file_share) | F.coalesce(named, F.lit(False))),
        "_dir": F.when(F.col(path).isNotNull(), F.regexp_extract(path, "^(.*)/[^/]*$", 1)),
    })
    scanned = cut(scanned)
    votes = scanned.where("is_license_file AND _dir IS NOT NULL").groupBy("_dir", "_own").agg(F.count("*").alias("n"))
    # Most files first, then the smaller name.
    chosen = votes.groupBy("_dir").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("_own").alias("license")))["license"].alias("license"))
    # a/b/c looks in a/b/c, a/b, a and the root, which is "".
    parts = F.split("_dir", "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    above = scanned.where("_dir IS NOT NULL").select("_dir").distinct().select("_dir", F.explode(levels).alias("l")).select("_dir", "l.depth", "l.above")
    resolved = above.join(chosen.withColumnRenamed("_dir", "above"), "above").groupBy("_dir").agg(F.max(F.struct("depth", "above", "license")).alias("best"))
    out = scanned.join(resolved, "_dir", "left")
    own = F.col("_own").isNotNull()
    return out.select(
        *kept,
        F.coalesce("_own", "best.license").alias("license"),
        F.when(own, F.col("cosine")).alias("cosine"),
        "is_license_file",
        F.when(own, F.col(path)).otherwise(F.col("best.above")).alias("license_from"),
    )
