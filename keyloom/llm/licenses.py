"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import table

# How licenses are usually declared, and the short license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES',
    "BSD-3-Clause text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES',
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Released under the ISC License.",
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "Unlicense": "Released under the Unlicense.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-3.0": "Licensed under CC BY 3.0.",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.",
    "CC-BY-NC-3.0": "Licensed under CC BY-NC 3.0.",
    "CC-BY-ND-3.0": "Licensed under CC BY-ND 3.0.",
    "CC-BY-NC-SA-3.0": "Licensed under CC BY-NC-SA 3.0.",
    "CC-BY-NC-ND-3.0": "Licensed under CC BY-NC-ND 3.0.",
}
#: Share of a template's words to be aligned, within a stretch of text of at most so many times its words.
COVERAGE, STRETCH = 0.8, 2
#: Words that tell licenses and versions apart: where a template first has them they must be aligned, whatever the coverage.
#: Of whole numbers only versions count, not those of lists.
TELLING = frozenset("apache mit gnu lesser library affero bsd clause mozilla isc cc cc0 nc sa nd unlicense unencumbered neither 1.0 1.1 2 2.0 2.1 2.5 3 3.0 4.0".split())
#: Such words that, left over in the matched text, make it another license.
OTHER = frozenset("lesser library affero nc sa nd neither".split())

_word = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def split_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words without regard to case and punctuation, and their places in code points."""
    found = [(m.group(), m.span()) for m in _word.finditer(_lower(text))]
    return [w for w, _ in found], [s for _, s in found]


_ascii_lower = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """A-Z as a-z, nothing else: str.lower() may change the length."""
    return text.lower() if text.isascii() else text.translate(_ascii_lower)


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence of distinct values, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both: words unique to both are anchors, gaps are aligned alike."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        n_text, n_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if n_template[w] == 1}
        common = [(i, place[w]) for i, w in enumerate(text[a:b], a) if n_text[w] == 1 and w in place]
        anchors = [common[k] for k in longest_increasing([j for _, j in common])]
        if not anchors:
            continue
        pairs += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(pairs)


class Template:
    def __init__(self, name: str, text: str, coverage: float, stretch: int) -> None:
        self.name, self.words = name, split_words(text)[0]
        if not self.words:
            raise ValueError(f"template {name} has no words")
        self.counts = Counter(self.words)
        self.least = max(1, -int(-coverage * len(self.words) // 1))
        self.telling = {j for j, w in enumerate(self.words) if w in TELLING and w not in self.words[:j] and (not w.isdigit() or self.words[j - 1] in ("version", "bsd"))}
        self.reach = stretch * len(self.words)
        # without any of these words too few are left: the longest ones, as the rarest
        self.signs, n = [], 0
        for w in sorted(self.counts, key=lambda w: (-len(w), w)):
            if n > len(self.words) - self.least:
                break
            self.signs.append(w)
            n += self.counts[w]

    def told(self, stretch: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether the words that tell licenses apart are aligned, and none is left over in the text between."""
        used = {i for i, _ in pairs}
        return self.telling <= {j for _, j in pairs} and not any(w in OTHER and i not in used for i, w in enumerate(stretch[: pairs[-1][0]]))

    def find(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """First and last word and number of aligned words of each place where enough of the template is aligned, without overlap."""
        hits = [i for i, w in enumerate(words) if w in self.counts]
        begin = end = possible = 0
        inside: Counter[str] = Counter()
        while begin < len(hits):
            while end < len(hits) and hits[end] < hits[begin] + self.reach:
                w = words[hits[end]]
                inside[w] += 1
                possible += inside[w] <= self.counts[w]
                end += 1
            step = 1
            if possible >= self.least:
                first = hits[begin]
                pairs = align(words[first : first + self.reach], self.words)
                if len(pairs) >= self.least and pairs[0][0] == 0 and self.told(words[first : first + self.reach], pairs):
                    last = first + pairs[-1][0]
                    yield first, last, len(pairs)
                    step = sum(1 for h in hits[begin:end] if h <= last)
            for h in hits[begin : begin + step]:
                w = words[h]
                possible -= inside[w] <= self.counts[w]
                inside[w] -= 1
            begin += step


def scan(text: str, templates: list[Template]) -> list[tuple[str, int, int, float]]:
    """name, start, end (code points, exclusive) and coverage of each license found, by start."""
    low = _lower(text)
    likely = [t for t in templates if any(s in low for s in t.signs)]
    if not likely:
        return []
    words, places = split_words(text)
    found = [(t.name, places[a][0], places[b][1], n / len(t.words), n) for t in likely for a, b, n in t.find(words)]
    # of licenses at one place the best covered stays, then the one with most words aligned
    found.sort(key=lambda x: (-x[3], -x[4], x[0], x[1]))
    starts: list[int] = []  # of what is kept, in order
    kept: list[tuple[str, int, int, float]] = []
    for *x, _ in found:
        k = bisect_left(starts, x[1])
        if (k == len(kept) or x[2] <= starts[k]) and (k == 0 or kept[k - 1][2] <= x[1]):
            starts.insert(k, x[1])
            kept.insert(k, tuple(x))
    return kept


FOUND = "array<struct<name:string,start:bigint,end:bigint,coverage:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, stretch: int = STRETCH) -> DataFrame:
    """One row per row of docs: doc_id and licenses (name, start and end in code points, coverage), by start.

    A license is found where patience alignment matches at least `coverage` of a template's words, in order, within
    `stretch` times as many words of the text, the TELLING words among them and no OTHER left over; case and punctuation do not count. Every such place of the whole text counts;
    where templates overlap, the best covered stays, then the one with most words aligned, then the first by name. Null and empty texts have
    none; repeated rows are treated alike; other columns are ignored; an empty table gives an empty result.
    """
    compiled = [Template(name, text, coverage, stretch) for name, text in templates.items()]
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[dict(zip(("name", "start", "end", "coverage"), x, strict=True)) for x in scan(t.as_py() or "", compiled)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "licenses"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, licenses {FOUND}")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    written = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(written, ",").alias("licenses"), F.array_max(F.transform("licenses", lambda x: x["coverage"])).alias("coverage"))
