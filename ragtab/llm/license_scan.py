"""Licences of files: TF-IDF cosine of their notices to templates, then inheritance from the
nearest ancestor directory that has a licence file.

Units of a text that are compared with the templates: for a template of at least ``SENTENCE`` words every
window of as many words that begins with one of its words, across line ends and comment marks (a shorter text is one window); for a
shorter template every sentence (lines, cut after ``.``, ``;``, ``!`` or ``?`` and white space); for a licence file also the whole
text. A word weighs its count in the unit times its inverse document frequency, whose documents are all lines of all files.
A template is found where the cosine reaches ``THRESHOLD``, for templates of fewer than ``SHORT`` words ``SHORT_THRESHOLD``.

A first pass counts the lines with each word (stored table). A second one keeps the places of a text whose cosine can reach the
threshold when words that are neither in a template nor in a hundredth of all lines weigh the least they may. Of these places
the remaining words are joined with the counts, and the third pass computes the cosines from them; of other files than licence files
only these places move.

Directories get the licence of their best licence file; every directory that files lie in is joined with its
ancestors' licences and takes the deepest one, and files without a licence of their own take their directory's.
Directories, not files, are exploded into ancestors, so a directory with a third of all files costs what any other does.

Defined cases: a null or empty text has no licence of its own; ``score`` is the best found template's cosine, null where none
is found; a null path has no directory and inherits nothing; ties go to the first template's name, then to the earlier place,
between licence files to the smaller path; a very long text is read in one go, about 100 bytes a word for a moment; rows may
repeat; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored

THRESHOLD = 0.7
#: Templates of fewer words need the higher cosine; of fewer than SENTENCE, a whole sentence.
SHORT, SHORT_THRESHOLD, SENTENCE = 10, 0.9, 4
#: Words in at least one of this many lines are at most as many as this times the mean words a line: their counts go to every task.
FREQUENT = 100
#: Words that a task counts before it hands the counts on.
COUNTED = 300_000
#: Names of licence files.
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)(\.[a-z0-9-]+)?$"

# Wording of public licences.
_WARRANTY = ("The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
             "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for "
             "any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the "
             "software or the use or other dealings in the software.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.")
_BSD_NAME = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
             "software without specific prior written permission.")
_BSD_WARRANTY = (" This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not "
                 "limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the "
                 "copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
                 "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
                 "however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
                 "arising in any way out of the use of this software, even if advised of the possibility of such damage.")
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
              "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
              "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
              "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
              "of the Software.")
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
              "above copyright notice and this permission notice appear in all copies.")
_ISC_WARRANTY = (" The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied "
                 "warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential "
                 "damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other "
                 "tortious action, arising out of or in connection with the use or performance of this software.")
_GNU_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
               "published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This program is "
               "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
               "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.")
_GNU_PREAMBLE = "GNU {kind}GENERAL PUBLIC LICENSE Version {n}, {date} Copyright (C) {year} Free Software Foundation, Inc."
TEMPLATES = {
    "AGPL-3.0": (_GNU_HEADER.format(kind="Affero ", n=3), _GNU_PREAMBLE.format(kind="Affero ", n=3, date="19 November 2007", year=2007)),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
                   "Apache License Version 2.0, January 2004"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License.", _BSD + _BSD_WARRANTY),
    "BSD-3-Clause": ("BSD 3-Clause License", "Licensed under the BSD 3-Clause License.",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     _BSD + _BSD_NAME, _BSD + _BSD_NAME + _BSD_WARRANTY),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("CC0 1.0 Universal", "Released into the public domain under CC0 1.0."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991",
                _GNU_HEADER.format(kind="", n=2), _GNU_PREAMBLE.format(kind="", n=2, date="June 1991", year="1989, 1991")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007",
                _GNU_HEADER.format(kind="", n=3), _GNU_PREAMBLE.format(kind="", n=3, date="29 June 2007", year=2007)),
    "ISC": ("ISC License", _ISC_GRANT, _ISC_GRANT + _ISC_WARRANTY),
    "LGPL-2.1": (_GNU_HEADER.format(kind="Lesser ", n="2.1"), _GNU_PREAMBLE.format(kind="Lesser ", n="2.1", date="February 1999", year="1991, 1999")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",
                 _GNU_HEADER.format(kind="Lesser ", n=3), _GNU_PREAMBLE.format(kind="Lesser ", n=3, date="29 June 2007", year=2007)),
    "MIT": ("Released under the MIT License.", "MIT License", "The MIT License (MIT)", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            _MIT_GRANT, _MIT_GRANT + " " + _WARRANTY),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",
                  "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
                  "means."),
    "proprietary": ("All rights reserved.",),
}
#: Identifier tags of every licence, with the endings that the GNU family has.
TEMPLATES = {name: (*texts, *(() if name == "proprietary" else (f"SPDX-License-Identifier: {name}{end}" for end in (
    ("", "-only", "-or-later") if "GPL" in name else ("",))))) for name, texts in TEMPLATES.items()}
WORDS = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
SENTENCE_END = re.compile(r"(?<=[.;!?])\s+")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()]


class Matcher:
    """Cosine of texts to templates. n_lines: lines of the corpus; n_with: of them, those with a word."""

    def __init__(self, templates: dict[str, tuple[str, ...]], n_lines: int, n_with: dict[str, int]):
        parts = [(name, words(t)) for name in sorted(templates) for t in templates[name]]
        self.n_lines = n_lines
        self.other = self.weight(0)
        self.idf = {w: self.weight(n_with.get(w, 0)) for w in sorted({w for _, ws in parts for w in ws} | n_with.keys())}
        self.names, self.sizes = [name for name, _ in parts], np.array([len(ws) for _, ws in parts])
        self.limits = np.where(self.sizes < SHORT, SHORT_THRESHOLD, THRESHOLD)
        # word numbers: those of the templates, then 0 for all others
        self.number = {w: k for k, w in enumerate(sorted({w for _, ws in parts for w in ws}), 1)}
        self.unit = np.zeros((1 + len(self.number), len(parts)))
        for k, (_, ws) in enumerate(parts):
            for w, c in Counter(ws).items():
                self.unit[self.number[w], k] = c * self.idf[w]
        self.unit /= np.sqrt((self.unit ** 2).sum(0))
        self.squares = self.unit ** 2

    def weight(self, n: int) -> float:
        return log((1 + self.n_lines) / (1 + n)) + 1

    def cosine(self, ws: list[str], idf: dict[str, float], other: float) -> np.ndarray:
        """To every template; a word that has no weight in ``idf`` weighs ``other``."""
        dot, square = np.zeros(len(self.names)), 0.0
        for w, c in Counter(ws).items():
            x = c * idf.get(w, other)
            square += x * x
            if k := self.number.get(w):
                dot += x * self.unit[k]
        return dot / sqrt(square) if square else dot

    def best(self, text: str) -> tuple[float, str | None]:
        """The highest cosine of a text as one unit, and its template's licence."""
        cos = np.round(self.cosine(words(text), self.idf, self.other), 9)
        return (float(cos.max()), self.names[int(cos.argmax())]) if cos.any() else (0.0, None)

    def found(self, text: str, whole: bool, idf: dict[str, float], other: float, n_words: int | None = None) -> Iterator[tuple]:
        """(cosine, template, first line, last line) of the units that reach their template's limit; lines count from 1, and 0
        stands for the whole text. With ``other`` below the weights of all words that ``idf`` lacks, a cosine is a bound from above.
        ``text`` may be a place of a text of ``n_words`` words."""
        by_line = [words(x) for x in lines(text)]
        ws = [w for x in by_line for w in x]
        number = np.fromiter((self.number.get(w, 0) for w in ws), np.int64, len(ws))
        present = np.zeros(len(self.unit), bool)
        present[number] = True
        present[0] = False
        # a cosine is at most the length of the template's part that the text has
        able = np.sqrt(self.squares[present].sum(0)) >= self.limits - 1e-9
        if not able.any():
            return
        if whole:
            cos = self.cosine(ws, idf, other)
            yield from ((cos[k], k, 0, 0) for k in np.flatnonzero(cos >= self.limits - 1e-9))
        if (able & (self.sizes < SENTENCE)).any():
            for at, line in enumerate(lines(text), 1):
                for sentence in SENTENCE_END.split(line):
                    part = words(sentence)
                    if any(w in self.number for w in part):
                        cos = self.cosine(part, idf, other)
                        yield from ((cos[k], k, at, at) for k in np.flatnonzero((cos >= self.limits - 1e-9) & (self.sizes < SENTENCE)))
        weights = np.fromiter((idf.get(w, other) for w in ws), float, len(ws))
        length = np.concatenate([[0.0], np.cumsum(weights ** 2)])
        line_ends = np.cumsum([len(x) for x in by_line])
        line_of = lambda place: int(np.searchsorted(line_ends, place, "right")) + 1
        for k in np.flatnonzero(able & (self.sizes >= SENTENCE)):
            size = min(int(self.sizes[k]), len(ws) if n_words is None else n_words)
            dots = self.unit[number, k] * weights
            starts = np.flatnonzero(dots[:max(0, len(ws) - size + 1)])
            sums = np.concatenate([[0.0], np.cumsum(dots)])
            # counts only lengthen a window: no count is below one
            bound = (sums[starts + size] - sums[starts]) / np.sqrt(length[starts + size] - length[starts])
            top = self.limits[k] - 1e-9
            for s in starts[bound >= top]:
                cos = self.cosine(ws[s:s + size], idf, other)[k]
                if cos >= top:
                    yield cos, k, line_of(s), line_of(s + size - 1)


def word_lines(files: DataFrame) -> DataFrame:
    """word, n: lines of all texts that have the word; the empty word stands for all lines. Counted in the tasks, summed by Spark."""

    def count(batches):
        n, total = Counter(), 0
        for b in batches:
            for t in b.column(0):
                for line in lines(t.as_py()):
                    total += 1
                    n.update(set(words(line)))
                    if len(n) > COUNTED:
                        yield pa.RecordBatch.from_pydict({"word": [*n], "n": [*n.values()]})
                        n.clear()
        yield pa.RecordBatch.from_pydict({"word": ["", *n], "n": [total, *n.values()]})

    return files.filter("text is not null").select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def matcher_of(counts: DataFrame, templates: dict[str, tuple[str, ...]]) -> Matcher:
    """With the counts of the templates' words and of the frequent ones, which are bounded (see FREQUENT)."""
    n_lines = (counts.filter("word = ''").agg(F.max("n")).first()[0]) or 0
    vocabulary = counts.sparkSession.createDataFrame([(w,) for w in sorted({w for ts in templates.values() for t in ts for w in words(t)})], "word string")
    frequent = counts.filter((F.col("n") * FREQUENT >= n_lines) & (F.col("word") != ""))
    rows = frequent.unionByName(counts.join(vocabulary, "word", "left_semi")).distinct().collect()
    return Matcher(templates, n_lines, {r["word"]: r["n"] for r in rows})


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def candidates(files: DataFrame, matcher: Matcher) -> DataFrame:
    """key, path, n_words, places (line, whole, text) that may hold a notice, others (their words that the matcher doesn't know)
    of every file."""
    shared = files.sparkSession.sparkContext.broadcast(matcher)  # the templates and the frequent words
    key_type = files.schema["key"].dataType

    def run(batches):
        m, is_licence = shared.value, re.compile(LICENCE_FILE)
        for b in batches:
            out = []
            for key, path, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = t.as_py() or ""
                spans = sorted({(first, last) for _, _, first, last in m.found(text, bool(path and is_licence.search(path)), m.idf, 1.0)})
                places, own = [], lines(text) if spans else []
                if spans and spans[0][0] == 0:
                    places.append({"line": 0, "whole": True, "text": text})
                else:
                    for first, last in _merged(spans):
                        places.append({"line": first - 1, "whole": False, "text": "\n".join(own[first - 1:last])})
                others = sorted({w for p in places for w in words(p["text"])} - m.idf.keys())
                out.append((key, path, sum(len(words(x)) for x in own), places, others))
            yield _batch(out, names, types)

    names = ["key", "path", "n_words", "places", "others"]
    place = pa.struct([("line", pa.int32()), ("whole", pa.bool_()), ("text", pa.string())])
    types = [to_arrow_type(key_type), pa.string(), pa.int64(), pa.list_(place), pa.list_(pa.string())]
    return files.select("key", "path", "text").mapInArrow(
        run, f"key {key_type.simpleString()}, path string, n_words long, "
             "places array<struct<line: int, whole: boolean, text: string>>, others array<string>")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of lines that share a line are one."""
    out: list[tuple[int, int]] = []
    for first, last in spans:
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def own_licences(files: DataFrame, matcher: Matcher, counts: DataFrame) -> DataFrame:
    """key, path, own_license, score, line (number of the notice's line among those with text, 0 for a whole licence file)."""
    found = stored(candidates(files, matcher).withColumn("row", F.monotonically_increasing_id()), "licence-places")
    # no word here is in a hundredth of all lines, so none is a hot key of the lines
    others = found.filter(F.size("others") > 0).select("row", F.explode("others").alias("word")).join(counts, "word") \
        .groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    rows = found.filter(F.size("places") > 0).join(others, "row", "left")
    shared = files.sparkSession.sparkContext.broadcast(matcher)
    key_type = files.schema["key"].dataType

    def run(batches):
        m = shared.value
        for b in batches:
            out = []
            for key, path, n_words, places, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                idf = m.idf | {x["word"]: m.weight(x["n"]) for x in known or ()}
                best = min(((-round(cos, 9), m.names[k], first and first + p["line"]) for p in places
                            for cos, k, first, _ in m.found(p["text"], p["whole"], idf, m.other, n_words)), default=None)
                out.append((key, path, best and best[1], best and -best[0], best and best[2]))
            yield _batch(out, names, types)

    names = ["key", "path", "own_license", "score", "line"]
    types = [to_arrow_type(key_type), pa.string(), pa.string(), pa.float64(), pa.int32()]
    schema = f"key {key_type.simpleString()}, path string, own_license string, score double, line int"
    none = found.filter(F.size("places") == 0).selectExpr(
        "key", "path", "cast(null as string) own_license", "cast(null as double) score", "cast(null as int) line")
    return rows.select("key", "path", "n_words", "places", "known").mapInArrow(run, schema).unionByName(none)


def _directory(path):
    return F.when(path.isNotNull(), F.regexp_replace(path, r"/?[^/]*$", ""))


def inherited(own: DataFrame) -> DataFrame:
    """``own`` with license, from_path (null, or the licence file it comes from)."""
    own = own.withColumn("dir", _directory(F.col("path")))
    files = own.filter(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    # the highest score, then the smallest path
    given = stored(files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own_license")).alias("x")), "licence-dirs")
    parts = F.split("dir", "/")
    above = own.filter("dir is not null").select("dir").distinct().select(
        "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
            k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("ancestor")))).alias("a")).select("dir", "a.*")
    nearest = stored(above.join(given.select(F.col("dir").alias("ancestor"), "x"), "ancestor")
                     .groupBy("dir").agg(F.max(F.struct("depth", "x")).alias("near"))
                     .select("dir", F.col("near.x.own_license").alias("dir_license"), F.col("near.x.path").alias("dir_path")), "nearest-licence")
    none = F.col("own_license").isNull()
    return own.join(nearest, "dir", "left").select(
        "key", "path", "own_license", "score", "line", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(none, F.col("dir_path")).alias("from_path"))


def license_scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """key, path, own_license, score, line, license, from_path of every row of ``files`` (key, path, text)."""
    counts = stored(word_lines(files), "licence-words")
    return inherited(stored(own_licences(files, matcher_of(counts, templates), counts), "own-licences"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a tree by source and id, where every 64th id is its directory's licence file and every
    1024th the one of the directory above. A null source or id has no path."""
    i = F.col("doc_id")
    top = F.concat(F.col("source"), F.lit("/"), F.expr("doc_id div 1024").cast("string"))
    low = F.concat(top, F.lit("/"), F.expr("doc_id div 64").cast("string"))
    path = F.when(i % 1024 == 0, F.concat(top, F.lit("/LICENSE"))).when(i % 64 == 0, F.concat(low, F.lit("/COPYING"))) \
        .otherwise(F.concat(low, F.lit("/"), i.cast("string"), F.lit(".txt")))
    return docs.select(i.alias("key"), path.alias("path"), "text")
