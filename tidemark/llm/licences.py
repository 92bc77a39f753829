r"""Licence scan: Dice coefficient over word bigrams against licence templates.

Units of a text are its lines, its paragraphs of more than one line, and its runs of consecutive paragraphs, so that a
licence of several paragraphs is found in a longer file; runs of more words than the longest template allows match
nothing and are not looked at. Words are runs of ``[0-9A-Za-z]`` and non-ASCII characters, lower-cased. A unit
matches a template when 2 |A & B| / (|A| + |B|) over their sets of bigrams is at least THRESHOLD.

A template of b bigrams can only match a unit of a bigrams if t / (2 - t) <= a / b <= (2 - t) / t: units
outside the bounds of every template are dropped by their number of words, and each of the
others is compared with the templates inside its bounds, by way of the templates' own bigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import LOWER, Words, byte_class, chunks, ngrams, tidy

THRESHOLD = 0.8

# Names and texts of public licence notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: Bytes of all templates that are read from files, at most: they travel with every task.
TEMPLATE_BYTES = 16 << 20

WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


class Matcher:
    """The bigrams of the templates, as an inverted index."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.names, pairs, sizes = [], [], []
        for name, text in sorted(templates.items()):
            raw = np.frombuffer(text.encode(), np.uint8)
            grams = np.unique(ngrams(Words(np.array([0, len(raw)]), raw, WORD, LOWER).hashes(), 2))
            if len(grams):
                pairs.append(np.stack([grams, np.full(len(grams), len(self.names), np.uint64)]))
                self.names.append(name)
                sizes.append(len(grams))
        self.sizes = np.array(sizes, np.int64)
        table = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.uint64)
        order = np.lexsort((table[1], table[0]))
        self.grams, at = np.unique(table[0][order], return_index=True)
        self.of = table[1][order].astype(np.int64)
        self.first = np.concatenate([at, [len(self.of)]])
        bits = np.zeros(1 << 16, bool)
        bits[(self.grams & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.bits = bits
        ratio = threshold / (2 - threshold)
        self.least = np.ceil(ratio * self.sizes - 1e-9).astype(np.int64)
        self.most = np.floor(self.sizes / ratio + 1e-9).astype(np.int64)
        self.longest = int(self.most.max(initial=0)) + 1  # words of a run

    def units(self, offsets: np.ndarray, raw: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and last word + 1 of every unit that has two words at least, lines before paragraphs before runs."""
        n = len(words.start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])  # line breaks before each byte
        line = lines[words.start]
        other_doc = words.doc[1:] != words.doc[:-1]
        cut_line = np.concatenate([[True], other_doc | (line[1:] != line[:-1])])
        cut_part = np.concatenate([[True], other_doc | (line[1:] > line[:-1] + 1)])
        edges = [np.append(np.flatnonzero(c), n) for c in (cut_line, cut_part)]
        several = np.diff(np.searchsorted(edges[0], edges[1])) > 1  # else the paragraph is a line
        first, last = [edges[0][:-1], edges[1][:-1][several]], [edges[0][1:], edges[1][1:][several]]
        part, doc = edges[1], words.doc[edges[1][:-1]]
        for k in range(1, len(doc)):  # runs of k + 1 paragraphs
            run = np.flatnonzero((doc[k:] == doc[:-k]) & (part[k + 1 :] - part[: -k - 1] <= self.longest))
            if not len(run):
                break
            first.append(part[run])
            last.append(part[run + k + 1])
        first, last = np.concatenate(first), np.concatenate(last)
        use = last - first > 1
        return first[use], last[use]

    def match(self, offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, byte of the first word, byte after the last word, template, Dice) of the best template of each matching unit."""
        words = Words(offsets, raw, WORD, LOWER)
        first, last = self.units(offsets, raw, words)
        if not len(first) or not len(self.names):
            return
        grams = ngrams(words.hashes(), 2)
        known = self.bits[(grams & np.uint64(0xFFFF)).astype(np.int64)]
        maybe = np.flatnonzero(known)
        at = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        real = self.grams[at] == grams[maybe]
        hits = np.zeros(len(grams) + 1, np.int64)
        hits[1:][maybe[real]] = 1
        hits = np.cumsum(hits)
        # enough of a template's bigrams, and not fewer words than the shortest template allows
        some = hits[last - 1] - hits[first]
        size = last - first - 1
        for u in np.flatnonzero((size >= self.least.min()) & (some >= self.least.min() / 2)):
            own = np.unique(grams[first[u] : last[u] - 1])
            inside = (len(own) >= self.least) & (len(own) <= self.most)
            if not inside.any():
                continue
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            at = at[self.grams[at] == own]
            common = np.zeros(len(self.names), np.int64)
            for k in at:
                common[self.of[self.first[k] : self.first[k + 1]]] += 1
            dice = np.where(inside, 2.0 * common / (len(own) + self.sizes), 0.0)
            best = int(np.argmax(dice))  # of equal ones the first by name
            if dice[best] >= self.threshold:
                yield int(words.doc[first[u]]), int(words.start[first[u]]), int(words.end[last[u] - 1]), best, float(dice[best])


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from the text files of a folder on any store that Spark reads, such as whole licences; each is named by its file without
    the suffix. More than TEMPLATE_BYTES in all are an error."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    if (files.agg(F.sum("length")).first()[0] or 0) > TEMPLATE_BYTES:
        raise ValueError(f"templates have {TEMPLATE_BYTES} bytes at most")
    rows = spark.read.option("wholetext", True).text(folder).select(F.input_file_name().alias("path"), "value").collect()
    return {unquote(r["path"]).rsplit("/", 1)[-1].rsplit(".", 1)[0]: r["value"] for r in rows}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_units matched, licences (distinct names, sorted, joined by ``|``), best_dice, found.

    `found` has name, dice and the code points [start, end) of each matching unit; units may overlap. A null or empty text
    matches nothing (best_dice 0); one of any length is scanned whole; equal rows give equal rows; other columns are not looked at,
    whatever their names; an empty table gives an empty result. Templates are few and given by the caller (see
    read_templates); they travel with the function. One pass, no shuffle.
    """
    matcher = Matcher(TEMPLATES if templates is None else templates, threshold)
    found_type = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, raw in chunks(batch.column(1)):
                found: list[list[dict]] = [[] for _ in range(last - first)]
                point = None
                for row, a, b, k, dice in matcher.match(offsets, raw):
                    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if point is None else point
                    zero = point[offsets[row]]
                    found[row].append({"name": matcher.names[k], "dice": dice, "start": int(point[a] - zero), "end": int(point[b] - zero)})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array(["|".join(sorted({y["name"] for y in x})) for x in found], pa.string()),
                        pa.array([max((y["dice"] for y in x), default=0.0) for x in found], pa.float64()),
                        pa.array(found, found_type),
                    ],
                    names=[id_col, "n_units", "licences", "best_dice", "found"],
                )

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_units long, licences string, best_dice double, found array<struct<name:string,dice:double,start:long,end:long>>"
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
