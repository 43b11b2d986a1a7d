"""License scans over a positional index of rare words.

Words of the templates get their inverse document frequency over the whole corpus. Each template is indexed by its
rarest words, with their positions. A file's own positions of such words meet the postings; each meeting votes for a
relative position (file position minus template position). Where enough of a template's weight agrees on a place, the
template's mandatory key phrases must stand there too.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, table

#: Phrases that count wherever their words stand consecutively, and their labels. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, notice, mandatory key phrases). Fixed values.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["compliance with the license", "apache org licenses"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["hereby granted free of charge", "without restriction"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc", "4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ["cc by sa", "4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution", "4 0 international"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered", "public domain"]),
]
#: Whole texts of short licences and the notices of longer ones, as they are published. Fixed values.
_NO_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES += [
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ["hereby granted free of charge", "substantial portions of the software"]),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.', ["with or without fee", "appear in all copies"]),
    ("bsd-2-clause", f"{_BSD} {_NO_WARRANTY}", ["binary form must reproduce", "provided with the distribution this software"]),
    ("bsd-3-clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_NO_WARRANTY}", ["binary form must reproduce", "endorse or promote products"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ["origin of this software must not be misrepresented", "plainly marked as such"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.", ["free and unencumbered", "jurisdictions that recognize copyright laws"]),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ["compliance with the license", "governing permissions and limitations"]),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ["gnu general public license", "version 3 of the license", "any later version"]),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ["gnu general public license", "version 2 of the license", "any later version"]),
    ("lgpl-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["gnu lesser general public license", "version 2 1"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["mozilla public license", "mozilla org mpl 2 0"]),
]
#: A template is indexed by its rarest words: so many, and one in SPREAD of a long one's.
RARE_WORDS, SPREAD = 4, 8
MIN_SHARE = 0.6
_SPLIT = bytes(x + 32 if 65 <= x <= 90 else 32 if x < 48 or 58 <= x <= 96 or 123 <= x <= 127 else x for x in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of letters, digits and anything beyond ASCII."""
    return (text or b"").translate(_SPLIT).split()


def places(words: list[bytes], phrase: list[bytes], a: int = 0, b: int | None = None) -> list[int]:
    """Every start of the phrase that lies wholly in words[a:b]."""
    out, n, b = [], len(phrase), len(words) if b is None else min(b, len(words))
    i = max(0, a)
    try:
        while True:
            i = words.index(phrase[0], i, b)
            if i + n <= b and words[i : i + n] == phrase:
                out.append(i)
            i += 1
    except ValueError:
        return out


def word_frequency(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and for each word of the (bounded) vocabulary the documents that hold it."""

    def run(batches):
        found, n = defaultdict(int), 0
        for b in batches:
            for t in b.column(0):
                n += 1
                for w in vocabulary.intersection(tokens(t.as_py())):
                    found[w] += 1
        found[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most a row a word of the templates
    out = {bytes(r.word): r.n for r in rows}
    return out.pop(b"", 0), out


class Index:
    """Postings of each template's rarest words; small, as the templates are."""

    def __init__(self, templates, n_docs: int, frequency: dict[bytes, int], rare_words: int = RARE_WORDS):
        self.templates = [(label, tokens(text.encode()), [tokens(p.encode()) for p in phrases]) for label, text, phrases in templates]
        idf = lambda w: math.log(1 + n_docs / (1 + frequency.get(w, 0)))
        self.postings: dict[bytes, list[tuple[int, int, float]]] = defaultdict(list)
        self.mass = []
        for k, (_, words, _) in enumerate(self.templates):
            rare = set(sorted(set(words), key=lambda w: (-idf(w), w))[: max(rare_words, len(set(words)) // SPREAD)])
            spots = [(i, w) for i, w in enumerate(words) if w in rare]
            self.mass.append(sum(idf(w) for _, w in spots) or 1.0)
            for i, w in spots:
                self.postings[w].append((k, i, idf(w)))
        self.words = frozenset(self.postings)

    def scan(self, words: list[bytes], present: set[bytes], min_share: float) -> dict[str, float]:
        """Labels found, each with the largest share of a template's rare weight that agrees on one place."""
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for w in present:
            for p in places(words, [w]):
                for k, i, weight in self.postings[w]:
                    votes[k, p - i] += weight
        out: dict[str, float] = {}
        for (k, at), weight in votes.items():
            share = min(1.0, weight / self.mass[k])
            label, text, phrases = self.templates[k]
            if share >= min_share and share > out.get(label, 0.0) and all(places(words, p, at - 2, at + len(text) + 2) for p in phrases):
                out[label] = share
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE, rare_words: int = RARE_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases count at every place, overlaps included. A template's label is found where at least min_share of the
    weight of its rare words stands at one relative position, so up to the first word that a copy adds or leaves out, and
    its key phrases stand there too. score is 1 where a base phrase stands, else the best share found, else 0; several
    places with the same share are the same result. Whole texts are read, of any length. A null or empty text has no words and no labels; repeated rows
    stay repeated; a null doc_id is kept; an empty table gives an empty result; other columns are not read.
    """
    vocabulary = frozenset(w for _, text, _ in templates for w in tokens(text.encode()))
    n_docs, frequency = word_frequency(docs, vocabulary, text_col)
    index = Index(templates, n_docs, frequency, rare_words)
    phrases = [(tokens(p.encode()), label) for p, label in base.items()]

    def run(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for t in b.column(1):
                words = tokens(t.as_py())
                starts, labels = [], set()
                for phrase, label in phrases:
                    if at := places(words, phrase):
                        starts += at
                        labels.add(label)
                present = index.words.intersection(words)
                found = index.scan(words, present, min_share) if present else {}
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), 1.0 if starts else max(found.values(), default=0.0))
                for column, x in zip(out, row):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op4_licenses": op4_licenses}
ORACLES: dict[str, str] = {}
