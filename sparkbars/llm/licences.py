"""License scans: normalised passages and windows of words compared to licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8
from .words import BYTE_VALUES, LOWER, PLACES, mix, prefix_hash, word_bounds

LEAST = 0.8  # Dice coefficient of a match

#: Standard licence texts (without their copyright lines) and the short forms by which texts declare them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
processor.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU
Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor,
Boston, MA 02110-1301 USA.""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU
Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU
Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/""",
    "MIT (declared)": "Released under the MIT License.",
    "BSD-3-Clause (declared)": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause (declared)": "Released under the BSD 2-Clause License.",
    "Apache-2.0 (declared)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (declared)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 (declared)": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 (declared)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1 (declared)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0 (declared)": "This work is licensed under the GNU Affero General Public License, version 3.",
} | {f"{name} (declared)": f"Licensed under {name.replace('CC-', 'CC ').replace('-4', ' 4')}." for name in (
    "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")} | {
    f"CC-BY{name}-4.0 (long)": f"This work is licensed under a Creative Commons Attribution{words} 4.0 International License." for name, words in {
        "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike",
        "-NC-ND": "-NonCommercial-NoDerivatives"}.items()} | {
    "CC-BY-4.0 (declared)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
#: Words that tell a licence from its relatives. A passage has those of its template, and no others of them.
MARKS = set("lesser affero library noncommercial sharealike noderivatives noderivs nc sa nd endorse advertising".split())
#: Numbers that have to be in a passage, by the start of the template's name.
VERSIONS = {"Apache-2.0": "2 0", "GPL-3.0": "3", "GPL-2.0": "2", "LGPL-2.1": "2 1", "LGPL-3.0": "3", "AGPL-3.0": "3", "EPL-2.0": "2 0", "MPL-2.0": "2 0",
            "CC-BY": "4 0", "BSD-3-Clause (declared)": "3", "BSD-2-Clause (declared)": "2"}
#: Words that turn a declaration into its opposite where they stand before it.
NEGATIONS = set("not never isn wasn aren weren unlike instead".split())
BEFORE = 4  # words before a declaration that are looked at

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
WORDS = re.compile("[^\\W_]+")
SENTENCE = re.compile("[.!?\r\n]")
BREAKS = np.zeros(256, bool)
BREAKS[[10, 13]] = True


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of neighbouring words (runs of letters and digits, A-Z lower-cased), where the first starts and where the second ends."""
    starts, ends, owner = word_bounds(data, offsets, WORD[data])
    sums, down = prefix_hash(BYTE_VALUES[LOWER[data]])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    same = owner[1:] == owner[:-1]
    return mix(words[:-1] * PLACES[0] + words[1:] * PLACES[1])[same], starts[:-1][same], ends[1:][same]


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        raw = [texts[n].encode() for n in self.names]
        found = [bigrams(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
        self.lengths = [len(f) for f in found]
        self.sets = [np.unique(f) for f in found]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.words = [set(WORDS.findall(texts[n].lower())) for n in self.names]
        self.needed = [set(next((v for start, v in VERSIONS.items() if n.startswith(start)), "").split()) & w for n, w in zip(self.names, self.words, strict=True)]
        self.all = np.unique(np.concatenate([*self.sets, np.empty(0, np.uint64)]))
        self.member = np.array([np.isin(self.all, x) for x in self.sets])

    def told_apart(self, k: int, data: np.ndarray, begin: int, end: int, top: int) -> bool:
        """Whether bytes begin to end of a text that starts at `top` have the numbers and marks of template k and are not negated."""
        own = set(WORDS.findall(data[begin:end].tobytes().decode(errors="replace").lower()))
        if not self.needed[k] <= own or own & MARKS != self.words[k] & MARKS:
            return False
        if "(" not in self.names[k]:
            return True
        ahead = SENTENCE.split(data[max(top, begin - 100):begin].tobytes().decode(errors="replace").lower())[-1]
        return not NEGATIONS & (own | set(WORDS.findall(ahead)[-BEFORE:]))

    def best(self, found: np.ndarray, allowed: Callable) -> tuple[float, str, int] | None:
        """The most similar template of a set of bigrams; only sizes that can reach LEAST, and templates that are `allowed`, are
        compared. Ties: first name."""
        ratio = LEAST / (2 - LEAST)
        fit = np.flatnonzero((self.sizes > 0) & (self.sizes >= ratio * len(found)) & (self.sizes * ratio <= len(found)))
        best = None
        for k in fit.tolist():
            common = len(np.intersect1d(self.sets[k], found, assume_unique=True))
            dice = 2 * common / (len(found) + int(self.sizes[k]))
            if dice >= LEAST and (best is None or dice > best[0]) and allowed(k):
                best = (dice, self.names[k], common)
        return best

    def windows(self, hashes: np.ndarray, number: np.ndarray, owner: np.ndarray, allowed: Callable) -> Iterator[tuple[float, int, int, int, int]]:
        """Dice, common bigrams, template, first and last bigram of the windows of whole texts that are most like a template.

        number: of each bigram its place in `all`, or -1. A window of LEAST holds at least ratio of the template's bigrams, and at most
        1 / ratio times as many bigrams; the best one starts and ends with a bigram of the template. So each of these that has enough
        others close behind is tried as a start, with every end; windows of one template that overlap give way to the best.
        """
        ratio = LEAST / (2 - LEAST)
        known = np.flatnonzero(number >= 0)
        before, last = np.full(len(hashes), -1, np.int64), np.argsort(hashes, kind="stable") if len(known) else known
        same = hashes[last][1:] == hashes[last][:-1]
        before[last[1:][same]] = last[:-1][same]
        for k, size in enumerate(self.sizes.tolist()):
            if not size:
                continue
            at = known[self.member[k][number[known]]]
            need, reach = int(np.ceil(ratio * size - 1e-9)), int(self.lengths[k] / ratio) + 1
            dense = at[:max(0, len(at) - need + 1)][(at[need - 1:] - at[:max(0, len(at) - need + 1)] < reach)]
            tried = []
            for start in dense.tolist():
                end = start + int(np.searchsorted(owner[start:start + reach], owner[start], "right"))
                new = before[start:end] < start
                ours = (number[start:end] >= 0) & self.member[k][number[start:end]]
                common = np.cumsum(ours & new)
                if common[-1] >= need:
                    dices = 2 * common / (size + np.cumsum(new))
                    best = int(np.flatnonzero(ours & (dices == dices.max()))[-1])
                    if dices[best] >= LEAST and allowed(k, start, start + best):
                        tried.append((float(dices[best]), int(common[best]), k, start, start + best))
            yield from _apart(sorted(tried, key=lambda t: (-t[0], t[3])), 3)


def _apart(spans: list[tuple], at: int, always: Callable = lambda span: False) -> list[tuple]:
    """The spans (start and end in the fields from `at` on) that overlap none taken before, and those to take always."""
    starts, ends, kept = [], [], []
    for span in spans:
        if always(span) or bisect_left(starts, span[at + 1]) == bisect_right(ends, span[at]):
            insort(starts, span[at])
            insort(ends, span[at + 1])
            kept.append(span)
    return kept


def _scanner(templates: Templates) -> Callable:
    least_hits = LEAST / (2 - LEAST) * (templates.sizes[templates.sizes > 0].min() if (templates.sizes > 0).any() else 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, offsets = utf8(block.column("text"))
            rows, names, dices, begins, ends = [], [], [], [], []
            starts_text = np.zeros(len(data) + 1, bool)
            starts_text[offsets] = True
            line = BREAKS[data]
            crlf = np.zeros(len(data), bool)
            crlf[1:] = (data[1:] == 10) & (data[:-1] == 13)
            line[:-1] &= ~crlf[1:]
            blank = np.zeros(len(data), bool)
            blank[1:] = line[1:] & line[:-1]
            blank[2:] |= crlf[2:] & line[:-2]
            seen, passages = set(), []

            def add(dice: float, name: str, begin: int, end: int) -> None:
                seen.add((begin, end))
                row = int(np.searchsorted(offsets, begin, "right")) - 1
                rows.append(row)
                dices.append(dice)
                names.append(name)
                begins.append(begin - int(offsets[row]))
                ends.append(end - int(offsets[row]))

            for marks in (line, blank, np.zeros(len(data), bool)):  # lines, paragraphs, whole texts
                edge = starts_text.copy()
                edge[1:] |= marks
                bounds = np.append(np.flatnonzero(edge[:len(data)]), len(data))
                hashes, at, to = bigrams(data, bounds)
                if not len(templates.all) or not len(hashes):
                    continue
                number = np.minimum(np.searchsorted(templates.all, hashes), len(templates.all) - 1)
                known = templates.all[number] == hashes
                passage = np.searchsorted(bounds, at, "right") - 1
                hits = np.bincount(passage[known], minlength=len(bounds))
                first = np.searchsorted(passage, np.arange(len(bounds)))
                for p in np.flatnonzero(hits >= least_hits).tolist():
                    span = int(bounds[p]), int(bounds[p + 1])
                    top = int(offsets[np.searchsorted(offsets, span[0], "right") - 1])
                    best = templates.best(np.unique(hashes[first[p]:first[p + 1]]), lambda k, span=span, top=top: templates.told_apart(k, data, *span, top))
                    if best and span not in seen:
                        passages.append((best[2], 0, *best[:2], *span))
                        add(*best[:2], *span)
            if len(templates.all) and len(hashes):  # the bigrams of whole texts, from the last round
                found = [(common, 1, dice, templates.names[k], int(at[first]), int(to[last])) for dice, common, k, first, last in templates.windows(
                    hashes, np.where(known, number, -1), passage,
                    lambda k, a, b, at=at, to=to, passage=passage, bounds=bounds: templates.told_apart(k, data, int(at[a]), int(to[b]), int(bounds[passage[a]])))]
                for _, is_window, *row in _apart(sorted(passages + found, key=lambda w: (-w[0], w[1], -w[2], *w[3:])), 4, lambda w: w[1] == 0):
                    if is_window:
                        add(*row)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(dices, pa.float64()),
                 pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "licence", "dice", "start", "end"])
    return scan


def licence_passages(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, licence, dice, start, end): passages (bytes start to end) that are a licence.

    Each line, each paragraph (between empty lines; CR LF is one line end) and the whole text is compared as one passage with the
    templates whose number of distinct bigrams allows a Dice coefficient of LEAST; the most similar one is given, the first by name
    of equals. Besides, windows of words anywhere in the text are, whatever its layout: of those that overlap each other or such a
    passage, the one with the most bigrams of its template is given, passages first. A window starts and ends with a bigram of
    the template; of each start the end with the largest coefficient is tried.
    A passage must have the version numbers of its template, the same words of MARKS, and no negation in or before a declaration; the
    most similar template that agrees in these is given.
    Null and empty texts and passages of fewer than two words match nothing. Each row is scanned by itself, repeated or without
    doc_id or not. Other columns are ignored. The templates, a few dozen texts, travel with the task.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, licence string, dice double, start long, end long"
    return docs.mapInArrow(_scanner(Templates(TEMPLATES if templates is None else templates)), schema)


def licences(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, licence, dice, n_passages): each licence found in a document, with its best coefficient."""
    found = licence_passages(docs, templates)
    return found.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count("*").alias("n_passages"))
