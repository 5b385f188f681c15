"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A match of a template of T five-word shingles is a passage of at most L = T / 0.75 shingles that holds three quarters of them. The template belongs to
the class of the least power of two s >= L. Texts are cut into windows of 2 s shingles that begin every s, so every such passage lies in one window whole.
If a window holds three quarters of the template, their Jaccard similarity is at least 0.75 T / (2 s + 0.25 T) > 0.28 / 2.1 = 0.13 (T > 3 s / 8), so that
one of `BANDS` = 64 bands of one minimum each agrees with probability 1 - (1 - 0.13) ** 64 > 0.9998. What is retrieved is verified by the exact share
of the template's shingles in its passages.

A window's minimum can only agree with a template's if the window holds that very shingle; texts that hold none of them (one sorted lookup
for each shingle) have no candidate windows, and their minima aren't computed.

Every passage that holds enough of a template counts. Of matches that overlap, the one that holds the most shingles of its template stays (then
the larger share, then the shorter, then the earlier), so that a header isn't taken for its sibling, nor a whole license for a part of it.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. The templates are a fixed, bounded list and go along with the tasks.

Cases: null and empty texts hold no license; texts of fewer words than a shingle hold none; repetitions of a statement are
found each; repeated rows are scanned each; rows with a null id are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, gram_hashes, load, mix, texts_of

SHINGLE, SHARE, BANDS = 5, 0.75, 64

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
    "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version "
    "{version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."
)

#: Names and wordings of common license statements, short ones and whole texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("MIT", _MIT_GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", _BSD_TERMS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((f"{short}-{version}.0", _GNU_HEADER.format(name=name, version=version)) for short, name, version in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3))),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
)

_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U) * U(0xA24BAED4963EE407))


def _shingles(text: str) -> np.ndarray:
    raw = text.encode()
    return gram_hashes(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), True, ~_SOLID).hashes, SHINGLE)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The shingle that each of the BANDS permutations puts first."""
    return np.array([shingles[mix(shingles ^ s).argmin()] for s in _SEEDS], U)


class Templates:
    def __init__(self, texts=TEMPLATES):
        self.names = [name for name, text in texts if len(_shingles(text))]
        self.sets = [np.unique(_shingles(text)) for _, text in texts if len(_shingles(text))]
        self.lengths = [int(len(s) / SHARE) for s in self.sets]
        self.classes = [1 << max(0, n - 1).bit_length() for n in self.lengths]
        self.of = {c: [t for t, other in enumerate(self.classes) if other == c] for c in self.classes}
        self.minima = [minima(s) for s in self.sets]
        self.first = np.unique(np.concatenate([np.zeros(0, U), *self.minima]))

    def scan(self, grams: np.ndarray, hits: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(name, first word, end word, share) of the licenses of a text with shingle hashes `grams`, `hits` being the places of template minima."""
        found = []
        for s in sorted(set(self.classes)):
            for w in np.unique(np.concatenate((hits // s, np.maximum(hits // s - 1, 0)))).tolist():
                own = minima(grams[w * s : (w + 2) * s])
                for t in self.of[s]:
                    if (own == self.minima[t]).any():
                        found += self.matches(grams, w * s, t)
        return apart(found)

    def matches(self, grams: np.ndarray, start: int, t: int) -> list[tuple[int, float, int, int, str]]:
        """Shingles, share, first word, end word and name of the template for each passage of the window at a place that holds enough of it."""
        at = start + np.flatnonzero(np.isin(grams[start : start + 2 * self.classes[t]], self.sets[t]))
        size, found = len(self.sets[t]), []
        for i, j in enumerate(np.searchsorted(at, at + self.lengths[t]).tolist()):
            if j - i >= SHARE * size:
                first = np.unique(grams[at[i:j]], return_index=True)[1]  # what only repeats shingles at the end isn't of this passage
                if len(first) >= SHARE * size:
                    found.append((len(first), len(first) / size, int(at[i]), int(at[i + first.max()] + SHINGLE), self.names[t]))
        return found


def apart(found: list[tuple[int, float, int, int, str]]) -> list[tuple[str, int, int, float]]:
    """The matches that no better one overlaps, in the order of the text."""
    kept: list[tuple[str, int, int, float]] = []
    for _, share, start, end, name in sorted(set(found), key=lambda x: (-x[0], -x[1], x[3] - x[2], *x[2:])):
        if not any(start < b and a < end for _, a, b, _ in kept):
            kept.append((name, start, end, share))
    return sorted(kept, key=lambda x: x[1:3])


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))


def _scan(templates: Templates):
    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for at, _, data, offsets in texts_of(batch.column(1)):
                words = Words(data, offsets, True, ~_SOLID)
                grams = gram_hashes(words.hashes, SHINGLE)
                place = np.minimum(np.searchsorted(templates.first, grams), max(0, len(templates.first) - 1))
                hits = np.flatnonzero(templates.first[place] == grams) if len(templates.first) and len(grams) else np.zeros(0, np.int64)
                for i in np.unique(np.searchsorted(words.first, hits, "right") - 1).tolist():
                    a, b = words.first[i], words.first[i + 1]
                    own = hits[(hits >= a) & (hits <= b - SHINGLE)] - a
                    if len(own):
                        found = templates.scan(grams[a : b - SHINGLE + 1], own)
                        rows[at + i] = [dict(zip(("license", "start", "end", "share"), f, strict=True)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _FOUND)], ["doc_id", "found"])

    return run


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, found: the licenses in the whole text in its order, their places (words start to end) and the share of the template that is there."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(Templates(templates)), f"doc_id {kind}, found array<struct<license:string,start:bigint,end:bigint,share:double>>")


def op3(spark, sf_dir: str) -> DataFrame:
    found = license_scan(load(spark, sf_dir, "documents"))
    text = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_join(text, ",").alias("spans"))
