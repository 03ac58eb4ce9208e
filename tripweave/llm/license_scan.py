"""Licence scans by Dice coefficient over word bigrams.

Texts and templates are normalised alike: ASCII letters lower-cased, every
other ASCII character but digits a space. A template is compared with windows
of a text. Dice >= ``threshold`` bounds the number of bigrams that a text must
share with a template of m bigrams: a window of n bigrams can reach it only if
m * t / (2 - t) <= n <= m * (2 - t) / t, and then shares at least
t * (m + n) / 2 bigrams. Texts with fewer words than the lower bound, or with
fewer of the template's bigrams in all, are pruned without a comparison. Of all
windows within both bounds the best one is found: it begins and ends with a
shared bigram, so for each such beginning the shared bigrams up to the upper
bound are counted in one pass, repeats as often as the template has them.

Defined results: a null or empty text has no licence; of equal scores the
template listed first, then the leftmost, then the shortest window wins; very
long texts are compared whole, in time that grows with their shared bigrams;
repeated rows and ids give a row each and score alike; a table without rows
gives none; columns other than id and text aren't read, so their names can't
clash.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.textbatch import TextBatch, chunks

THRESHOLD = 0.8

#: Notices and texts by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    FOLD[_c] = _c + 32


class Templates:
    """Bigram counts of all templates and an index from bigrams to templates."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.grams = [TextBatch([text], FOLD).windows(2)[1] for _, text in templates]
        self.counts = [Counter(g.tolist()) for g in self.grams]
        at: dict[int, list[tuple[int, int]]] = {}
        for t, counts in enumerate(self.counts):
            for g, n in counts.items():
                at.setdefault(g, []).append((t, n))
        self.at = at  # of each bigram: the templates that have it, and how often
        self.all = np.sort(np.array(list(at), np.uint64))
        self.low = np.zeros(65536, bool)
        self.low[(self.all & np.uint64(0xFFFF)).astype(np.int64)] = True


def size_bounds(m: int, threshold: float) -> tuple[float, float]:
    """How many bigrams a window may have to reach the threshold against m."""
    return m * threshold / (2 - threshold), m * (2 - threshold) / threshold


def best_match(k: Templates, place: list[int], gram: list[int], n_grams: int, threshold: float) -> tuple[str | None, float, int, int, int]:
    """(licence, score, first word, number of words, licences found) of one text from its hits: bigrams that some template has."""
    have = Counter(gram)
    shared: Counter = Counter()
    for g, n in have.items():
        for t, count in k.at[g]:
            shared[t] += min(n, count)
    best: tuple = (None, 0.0, -1, 0)
    found = set()
    for t in sorted(shared):
        m = len(k.grams[t])
        least, _ = size_bounds(m, threshold)
        if n_grams < least - 1e-9 or 2 * shared[t] < threshold * (m + least) - 1e-9:
            continue
        hits = [(p, g) for p, g in zip(place, gram, strict=True) if g in k.counts[t]]
        score, start, size = best_window(k.counts[t], m, [p for p, _ in hits], [g for _, g in hits], threshold)
        if score >= threshold:
            found.add(k.names[t])
            if score > best[1]:
                best = (k.names[t], score, start, size + 1)
    return (*best, len(found))


def best_window(counts: Counter, m: int, place: list[int], gram: list[int], threshold: float) -> tuple[float, int, int]:
    """(score, first bigram, number of bigrams) of the best window of any length within the size bounds, from the template's hits."""
    least, most = size_bounds(m, threshold)
    need = max(1, math.ceil(threshold * (m + least) / 2 - 1e-9))
    names = {g: i for i, g in enumerate(counts)}
    if len(gram) < need:
        return 0.0, -1, 0
    code = np.array([names[g] for g in gram])
    cap = np.array([counts[g] for g in names])
    at = np.array(place)
    # Of each hit: how many of its bigram came before.
    order = np.argsort(code, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1])
    nth = np.empty(len(code), np.int64)
    nth[order] = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    to = np.searchsorted(at, at + int(most + 1e-9), side="left")
    gone = np.zeros(len(cap), np.int64)  # of each bigram: how many lie before the window
    best = (0.0, -1, 0)
    for i in range(len(code)):
        j = to[i]
        if j - i >= need:
            counted = np.cumsum(nth[i:j] - gone[code[i:j]] < cap[code[i:j]])
            score = 2 * counted / (m + at[i:j] - at[i] + 1)
            top = int(np.argmax(score))
            if score[top] > best[0]:
                best = (float(score[top]), int(at[i]), int(at[i + top] - at[i] + 1))
        gone[code[i]] += 1
    return best


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """Per row: id, license (null if none), score, first_word, n_words, n_licenses."""
    known = Templates(templates)

    def run(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *_columns(known, texts, threshold)], names=["id", "license", "score", "first_word", "n_words", "n_licenses"])

    kind = df.schema[id_col].dataType.simpleString()
    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col))
        .mapInArrow(run, f"id {kind}, license string, score double, first_word long, n_words long, n_licenses int")
        .withColumnRenamed("id", id_col)
    )


def _columns(k: Templates, texts: list[str], threshold: float) -> list[pa.Array]:
    b = TextBatch(texts, FOLD)
    at, gram = b.windows(2)
    hit = np.flatnonzero(k.low[(gram & np.uint64(0xFFFF)).astype(np.int64)])
    hit = hit[np.isin(gram[hit], k.all)]
    doc = b.doc[at]
    bounds = np.searchsorted(doc, np.arange(b.n + 1))
    out = [(None, 0.0, -1, 0, 0)] * b.n
    who, first = np.unique(doc[hit], return_index=True)
    for d, own in zip(who.tolist(), np.split(hit, first[1:]) if len(who) else [], strict=True):
        lo, hi = bounds[d], bounds[d + 1]
        out[d] = best_match(k, (own - lo).tolist(), gram[own].tolist(), int(hi - lo), threshold)
    names, scores, starts, sizes, n = zip(*out, strict=True)
    return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int32())]
