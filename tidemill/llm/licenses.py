"""Licence scan: exact set-similarity join between text blocks and licence notices.

A block is a window of consecutive words, over line ends too: a quarter more words than the template has, so that its length is bounded by the template's
whatever the length of lines and texts. A block and a template are sets of words (as in decontam.words_of). A block matches where it holds at least `threshold` of a template's words and, of a
template that has one, the name: what tells its licence from others with nearly the same notice, as a pattern over the block's words. The template words are ordered by their frequency in the
corpus, rarest first. Of a template with n words, c = ceil(threshold * n) must be found, hence one at least of its
n - c + 1 rarest (prefix filter). A text of fewer than c words is passed over (length filter), and so is one in which the
places of the first shared word leave room for fewer than c shared ones (positional filter). What is left is counted exactly, window by window.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, binary, slices, small_batches

# Phrases that name a licence by themselves, and the notices that licences ask for.
PHRASES = {"mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The phrases that op4's contract counts.
CONTRACT_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Between a licence and its version: up to 12 words that are no version, and other versions of which there is a choice.
_TO_VERSION = r"(?:(?!gnu |version |v?\d)[^ ]+ ){0,12}(?:(?:version |v )*v?\d+ (?:[01] )?(?:or |and )+)*(?:version |v )*v?"


def _public(kind: str, version: int) -> str:
    """The name of a GNU licence: kind is a word before "general", or empty."""
    before, name = ("", f"{kind} ") if kind else ("(?<! lesser)(?<! library)(?<! affero)", "")
    return rf"{before} {name}general public licen[cs]e {_TO_VERSION}{version} | v(?:ersion )?v?{version} of the (?:gnu )?{name}general public licen[cs]e "


_FOUNDATION = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License"
# label, notice and, where a notice of another licence may hold enough of its words, the name
TEMPLATES = [
    ("mit", "Released under the MIT License", " mit "),
    ("mit", "Licensed under the MIT License", " mit "),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", " associated "),
    ("apache-2", "Licensed under the Apache License, Version 2.0", " apache (?:software |license |licence |version |v )*v?2 "),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", " apache "),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", _public("", 2)),
    ("gpl-2", _FOUNDATION.format("", 2), _public("", 2)),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", _public("", 3)),
    ("gpl-3", _FOUNDATION.format("", 3), _public("", 3)),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3", _public("lesser", 3)),
    ("lgpl-3", _FOUNDATION.format("Lesser ", 3), _public("lesser", 3)),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3", _public("affero", 3)),
    ("agpl-3", _FOUNDATION.format("Affero ", 3), _public("affero", 3)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", " mozilla public licen[cs]e (?:version |v )*v?2 "),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", " attribution (?!share|non ?comm|no ?deriv)"),
    ("cc-by", "Licensed under CC BY 4.0", " cc by (?!nc |sa |nd )"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", " attribution share ?alike "),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", " cc by sa "),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", " attribution non ?commercial "),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", " cc by nc "),
    ("proprietary", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain", " unencumbered "),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", " with or without fee "),
    ("wtfpl", "Do what the fuck you want to public license", " do what the fuck you want to "),
]
_AS_IS = "IN NO EVENT SHALL THE {0} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {1}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
# whole texts of short licences, and the whole notices of long ones
TEMPLATES += [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", " sublicense "),
    ("bsd", (_CLAUSES + _AS_IS).format("COPYRIGHT HOLDER OR CONTRIBUTORS", "")),
    ("bsd", (_CLAUSES + _AS_IS).format("COPYRIGHT HOLDER OR CONTRIBUTORS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", " with or without fee "),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", " apache "),
    *[(label, f"This program is free software: {_FOUNDATION.format(name, version)}, or (at your option) any later version. {_NO_WARRANTY.format(name)}", _public(kind, version)) for label, name, kind, version in (("gpl-2", "", "", 2), ("gpl-3", "", "", 3), ("lgpl-3", "Lesser ", "lesser", 3), ("agpl-3", "Affero ", "affero", 3))],
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", " mozilla public licen[cs]e (?:version |v )*v?2 "),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", " unencumbered "),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", " misrepresented "),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", " organization "),
]


def _words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class Matcher:
    """Templates indexed by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, ...]], frequency: dict[bytes, int], threshold: float):
        every = {w for t in templates for w in _words(t[1].encode())}
        self.rank = {w: i for i, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = []
        self.windows: list[int] = []  # words of a block
        self.known = frozenset(every)
        self.names: list[re.Pattern | None] = []
        self.index: dict[int, list[tuple[int, int]]] = {}
        for label, text, *name in templates:
            own = sorted({self.rank[w] for w in _words(text.encode())})
            if not own:
                continue
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            k = len(self.templates)
            self.templates.append((label, frozenset(own), len(own), need))
            self.windows.append(math.ceil(1.25 * len(_words(text.encode()))))
            self.names.append(re.compile(name[0].encode()) if name else None)
            for i, r in enumerate(own[: len(own) - need + 1]):
                self.index.setdefault(r, []).append((k, i))
        names = {r: w for w, r in self.rank.items()}
        self.prefix = frozenset(names[r] for r in self.index)

    def _named(self, k: int, words: list[bytes], a: int, b: int) -> bool:
        """Whether words[a:b] hold the k-th template's name; the words beside them tell whether it is a longer one."""
        if not self.names[k]:
            return True
        left, own = words[max(0, a - 3) : a], words[a:b]
        low = sum(map(len, left)) + len(left)
        high = low + sum(map(len, own)) + len(own) + 1
        return any(low <= m.start() and m.end() <= high for m in self.names[k].finditer(b" " + b" ".join(left + own + words[b : b + 3]) + b" "))

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, str, float]]:
        """(place of its first shared word, label, containment) of the windows that reach a template's threshold and have its name.

        Of windows that overlap, the best is given.
        """
        rank = self.rank
        own = sorted({rank[w] for w in self.known.intersection(words)})
        tried = set()
        for j, r in enumerate(own):
            for k, i in self.index.get(r, ()):
                if k in tried:
                    continue
                tried.add(k)  # r is the first word that they share
                label, template, n, need = self.templates[k]
                if len(words) < need or 1 + min(n - i - 1, len(own) - j - 1) < need or len(template.intersection(own)) < need:
                    continue
                span = self.windows[k]
                at = [(p, x) for p, w in enumerate(words) if (x := rank.get(w)) in template]
                count: Counter = Counter()
                tail, best, end = 0, None, -1
                for p, x in at:
                    count[x] += 1
                    while at[tail][0] <= p - span:
                        y = at[tail][1]
                        count[y] -= 1
                        if not count[y]:
                            del count[y]
                        tail += 1
                    a = at[tail][0]
                    if len(count) < need or not self._named(k, words, max(0, p + 1 - span), min(len(words), a + span)):
                        continue
                    if best and a > end:
                        yield best
                        best = None
                    end = p
                    if not best or len(count) / n > best[2]:
                        best = (a, label, len(count) / n)
                if best:
                    yield best


def word_frequency(docs: DataFrame, words: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often the given words occur in all texts. There is one row for each word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in slices(batches):
            for t in binary(b.column(0)):
                total.update(filter(words.__contains__, t.translate(ALNUM).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase stands; joined: all words with one space around each."""
    out, at, seen, n = [], joined.find(phrase), 0, 0
    while at >= 0:
        n += joined.count(b" ", seen, at)
        seen = at
        out.append(n)
        at = joined.find(phrase, at + 1)
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, ...]] | None = None, threshold: float = 0.8, across_lines: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, matches, labels, score.

    n_base: places where a phrase's words stand consecutively; first_word and last_word their smallest and largest start, null
    without any. matches: array of (block: number from 0 of the line in which the window's first shared word stands, label, containment). across_lines: whether
    windows go over line ends. labels: base labels and the matches', distinct,
    sorted. score: 1 with a base label, else the best containment of any match, else 0. Null and empty texts have
    no words, no labels and score 0; equal labels from several templates count once. Repeated rows are scanned each, an empty docs gives an empty result. Columns other than the two are not looked at.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    small_batches(docs.sparkSession)
    frequency = word_frequency(docs, {w for t in templates for w in _words(t[1].encode())}, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(templates, frequency, threshold))
    known = [(b" " + b" ".join(_words(p.encode())) + b" ", max(_words(p.encode()), key=len), label) for p, label in phrases.items()]
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    match_type = pa.list_(pa.struct([("block", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher: Matcher = shared.value
        for b in slices(batches):
            rows: list[tuple] = []
            for t in binary(b.column(1)):
                plain = t.translate(ALNUM)
                words = plain.split()
                have = [(p, label) for p, first, label in known if first in plain]
                starts, base = [], set()
                if have:
                    joined = b" " + b" ".join(words) + b" "
                    for p, label in have:
                        if own := _places(joined, p):
                            starts += own
                            base.add(label)
                matches = []
                if not matcher.prefix.isdisjoint(words):
                    lines = [x.translate(ALNUM).split() for x in t.split(b"\n")]
                    ends = list(accumulate(map(len, lines)))
                    best: dict[tuple[int, str], float] = {}
                    for k, own in [(0, words)] if across_lines else enumerate(lines):
                        for a, x, c in matcher.matches(own):
                            key = bisect_right(ends, a) if across_lines else k, x
                            best[key] = max(best.get(key, 0.0), c)
                    matches = [{"block": k, "label": x, "containment": c} for (k, x), c in sorted(best.items())]
                labels = sorted(base.union(m["label"] for m in matches))
                score = 1.0 if base else max([0.0, *(m["containment"] for m in matches)])
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), matches, ",".join(labels), score))
            cols = list(zip(*rows))
            types = [pa.int64()] * 4 + [pa.string(), match_type, pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, x) for c, x in zip(cols, types)]], names=names)

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, matches array<struct<block:int,label:string,containment:double>>, labels string, score double"
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches", "labels", "score"]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(scan, schema)
