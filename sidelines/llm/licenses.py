"""Licence scan with a positional rare-token index.

Templates (notices of a licence) are word sequences with a label and a short
mandatory key phrase.

1. One scan counts, over all documents, in how many each template word
   occurs; IDF follows (as many numbers go to the driver as the templates have words).
2. The index holds postings word -> (template, position) of each template's
   rarest words: those of highest weight that together weigh more than a place may miss,
   so every place that reaches the threshold agrees in one of them at least.
3. A file's words are looked up in it, all files of a slice at once.  A
   posting votes for (file, template, start = position in file - position in
   template); intersecting by relative position, votes for one start are
   added up, and starts whose rare words miss more than a place may are dropped.
4. What is left is compared in full: the key phrase must stand word by word,
   and the share of weight that agrees is the score (a third of the weight by IDF, the rest alike); at the
   template's threshold or above the place counts.

The work follows the votes, not the number of templates: a template none of whose
rare words are in a file costs that file nothing.  Base phrases are
templates whose key phrase is the whole template.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower
case, of the whole text.  Defined results: a NULL or text without words has 0
words, no places (first and last NULL), empty labels and score 0.  Where no
template word weighs anything (all in every document), words weigh alike.  Repeated rows get equal
answers; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm import arrays as A
from sidelines.llm.catalog import register
from sidelines.llm.common import table


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]            # the mandatory phrase: words[key[0]:key[1]]
    threshold: float = 0.8
    base: bool = False


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template(label: str, text: str, key: str, threshold: float = 0.8, base: bool = False) -> Template:
    words, phrase = tuple(_WORD.findall(text.lower())), tuple(_WORD.findall(key.lower()))
    at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
    return Template(label, words, (at, at + len(phrase)), threshold, base)


#: Phrases, labels and notices (fixed values).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
BSD_3 = BSD_2 + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software
Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for
more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEMPLATES = (
    template("mit", "mit license", "mit license", 1.0, True),
    template("apache", "apache license", "apache license", 1.0, True),
    template("gpl", "general public license", "general public license", 1.0, True),
    template("mit-notice", "released under the mit license", "mit license"),
    template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted free of charge"),
    template("mit-notice", MIT, "granted free of charge"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    template("apache-2.0", APACHE, "apache license"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "public license version 3"),
    template("gpl-2.0", "gnu general public license version 2", "public license version 2"),
    template("gpl-3.0", _GNU.format("program", "General Public License", "3"), "general public license"),
    template("gpl-2.0", _GNU.format("program", "General Public License", "2"), "either version 2 of"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("lgpl", _GNU.format("library", "Lesser General Public License", "2.1"), "lesser general public"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("agpl", _GNU.format("program", "Affero General Public License", "3"), "affero general public"),
    template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    template("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "use in source and binary"),
    template("bsd-2", BSD_2, "of source code must retain"),
    template("bsd-3", BSD_3, "endorse or promote products"),
    template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("mpl-2.0", MPL, "mozilla public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    template("isc", ISC, "with or without fee"),
    template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    end = np.cumsum([len(w) + 1 for w in raw]) - 1
    return A.word_hashes(data, np.array([e - len(w) for e, w in zip(end, raw)]), end)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def _lookup(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index into the sorted ``known``, -1 where absent."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def _file_words(text: pa.Array, known: np.ndarray):
    """Per slice: number of rows, where each row's words begin (one more at the end), and every word's index into ``known`` or -1."""
    for _, data, off in A.slices(text):
        start, end, doc = A.words(data, off, A.ALNUM)
        yield len(off) - 1, A.doc_bounds(doc, len(off) - 1), _lookup(A.word_hashes(data, start, end), known)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """(documents, template word -> documents that hold it), over all documents."""
    vocab = vocabulary(templates)
    hashes = _hash_words(vocab)
    order = np.argsort(hashes)
    known = hashes[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, np.int64)
        for b in batches:
            for n, bounds, word in _file_words(b.column(0), known):
                total[-1] += n
                hit = np.flatnonzero(word >= 0)
                row = np.searchsorted(bounds, hit, "right") - 1
                once = np.unique(row * len(known) + word[hit])
                total[:-1] += np.bincount(once % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {r["word"]: r["n"] for r in rows}
    return by.get(len(known), 0), {vocab[order[i]]: by.get(i, 0) for i in range(len(known))}


def weights_of(idf: np.ndarray) -> np.ndarray:
    """Weights of a template's words, sum 1: a third by IDF, two thirds alike, so that one altered word of a longer notice decides nothing."""
    even = np.full(len(idf), 1 / len(idf))
    return even if idf.sum() <= 0 else (idf / idf.sum() + 2 * even) / 3


@dataclass(frozen=True)
class Index:
    """Postings of the templates' rare words, and what a full comparison needs."""
    known: np.ndarray                    # sorted hashes of all template words
    first: np.ndarray                    # by word: where its postings begin (one more at the end)
    template: np.ndarray                 # by posting
    place: np.ndarray
    weight: np.ndarray
    needed: np.ndarray                   # by template: weight that the votes for a start must have
    words: tuple[np.ndarray, ...]        # by template: its words as indices into known
    weights: tuple[np.ndarray, ...]      # by template: weights of its words, sum 1

    @classmethod
    def of(cls, templates: tuple[Template, ...], n_docs: int, df: dict[str, int]) -> Index:
        vocab = vocabulary(templates)
        hashes = _hash_words(vocab)
        order = np.argsort(hashes)
        index = {vocab[i]: k for k, i in enumerate(order)}
        words, weights, needed, postings = [], [], [], []
        for k, t in enumerate(templates):
            ids = np.array([index[w] for w in t.words])
            idf = np.array([np.log((n_docs + 1) / (df[w] + 1)) for w in t.words])
            w = weights_of(idf)
            rare = np.argsort(-w, kind="stable")
            rare = rare[:int(np.searchsorted(np.cumsum(w[rare]), 1 - t.threshold + 1e-9, "right")) + 1]     # together more than may be missing
            words.append(ids)
            weights.append(w)
            needed.append(float(w[rare].sum()) - (1 - t.threshold) - 1e-9)
            postings += [(int(ids[p]), k, int(p), float(w[p])) for p in rare]
        postings.sort()
        word, temp, place, weight = (np.array(c) for c in zip(*postings))
        return cls(hashes[order], np.searchsorted(word, np.arange(len(vocab) + 1)), temp, place, weight, np.array(needed), tuple(words), tuple(weights))

    def candidates(self, bounds: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, template, start in the slice) of every start with enough votes."""
        hit = np.flatnonzero((word >= 0) & (np.diff(self.first)[word] > 0))
        times = np.diff(self.first)[word[hit]]
        at = np.repeat(self.first[word[hit]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        spot = np.repeat(hit, times)
        row, temp, start = np.searchsorted(bounds, spot, "right") - 1, self.template[at], spot - self.place[at]
        by = np.lexsort((start, temp, row))
        row, temp, start, vote = row[by], temp[by], start[by], self.weight[at][by]
        new = np.ones(len(by), bool)
        new[1:] = (row[1:] != row[:-1]) | (temp[1:] != temp[:-1]) | (start[1:] != start[:-1])
        head = np.flatnonzero(new)
        votes = np.add.reduceat(vote, head) if len(head) else vote
        enough = head[votes >= self.needed[temp[head]]]
        return row[enough], temp[enough], start[enough]

    def places(self, templates: tuple[Template, ...], bounds: np.ndarray, word: np.ndarray):
        """(row, template, start in the file, score) of the places that count, template by template."""
        row, temp, start = self.candidates(bounds, word)
        for k in np.unique(temp):
            t, ids = templates[k], self.words[k]
            r, s = row[temp == k], start[temp == k]
            step = max(1, (1 << 20) // len(ids))
            for a in range(0, len(r), step):
                low, high = bounds[r[a:a + step]], bounds[r[a:a + step] + 1]
                at = s[a:a + step, None] + np.arange(len(ids))
                inside = (at >= low[:, None]) & (at < high[:, None])
                agree = inside & (word[np.clip(at, 0, len(word) - 1)] == ids)
                score = agree @ self.weights[k]
                good = agree[:, t.key[0]:t.key[1]].all(1) & (score >= t.threshold - 1e-9)
                yield k, r[a:a + step][good], s[a:a + step][good] - low[good], np.minimum(score[good], 1.0)


_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                  ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_places", pa.int64())])
SCHEMA = ("id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          "score double, n_places bigint")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per input row: words, base places, labels, score of the best place."""
    index = Index.of(templates, *document_frequencies(docs, templates, text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for n, bounds, word in _file_words(b.column(1), index.known):
                base, every = [set() for _ in range(n)], [set() for _ in range(n)]
                n_base, places, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                for k, row, start, score in index.places(templates, bounds, word):
                    t = templates[k]
                    np.add.at(places, row, 1)
                    np.maximum.at(best, row, score)
                    for r in np.unique(row).tolist():
                        every[r].add(t.label)
                        if t.base:
                            base[r].add(t.label)
                    if t.base:
                        np.add.at(n_base, row, 1)
                        np.minimum.at(first, row, start)
                        np.maximum.at(last, row, start)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(done, n), pa.array(np.diff(bounds)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x)) for x in every], pa.string()),
                    pa.array(best), pa.array(places)], schema=_OUT)
                done += n

    d = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return d.mapInArrow(scan, SCHEMA)


@register("op4_license_scan")
def op4_license_scan(spark, sf_dir):
    """Licence phrases and notices in every whole text."""
    return license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
