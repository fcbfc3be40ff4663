"""Operator 5: licences of files by TF-IDF cosine to templates, inherited along directories.

Files are (path, text).  Terms are lower-cased word runs.  Templates are whole short licences, the
standard headers of long ones, and one-line notices.  A term's weight is ln(1 / (share + FLOOR)), where
share is the part of all files that hold it (partial counts per task, then a grouped sum; bounded by
the templates' terms), so weights do not drift with the number of files; terms of no template weigh
``OTHER``.  A whole text is compared with each template by the cosine of sparse TF-IDF vectors over
windows about as long as the template, a quarter of which lies between two windows (one term for short
ones).  Among the templates at or above ``COSINE`` the file's own licence is that of greatest cosine times the fourth root of
the template's terms: a whole licence says more than a line above it ("All rights reserved." over an MIT text), and a
text that holds a shorter one says more than that one.

Not every window is weighed: the heaviest terms of a template are those without which the cosine must
stay under ``COSINE`` (by the Cauchy-Schwarz bound on the lighter rest), so only windows with one of
them can match.  Nothing is lost by it.

A file without one inherits from the licence file (LICENSE, COPYING and the like) of the nearest
directory above it.  The distinct directories are exploded into their ancestors, joined by equality to
the directories that have a licence file, and the deepest match wins by a grouped maximum; nothing
is compared pairwise and the number of ancestors is the path's depth.

Cases: null and empty texts have no own licence; a null path inherits nothing; several licence
files of one directory give the one with the highest score, then the least name; each row of the input
gives one row, repeats included; an empty table gives an empty result; further columns are ignored;
very long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import batch, rows_of, Scratch

COSINE, FLOOR, OTHER, BY_LENGTH = 0.65, 1e-4, 4.0, 0.25
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
#: Texts, standard headers and one-line notices of well-known licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": ("Released under the MIT License.", _MIT + _AS_IS, _MIT, "SPDX-License-Identifier: MIT"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "BSD-2-Clause": (_BSD,),
    "BSD-3-Clause": (_BSD + _BSD_3, "Use of this source code is governed by a BSD-style license.", "Released under the BSD 3-Clause License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _GNU.format("General Public License", "3", "General Public License"), "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL-3.0": (_GNU.format("Lesser General Public License", "3", "Lesser General Public License"),),
    "AGPL-3.0": (_GNU.format("Affero General Public License", "3", "Affero General Public License"),),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "proprietary": ("All rights reserved.",),
}
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)(\.\w+)?$"
_TERM = re.compile(r"[^\W_]+(?:\.\d+)*")
_OWN = pa.schema([("path", pa.string()), ("own", pa.string()), ("score", pa.float64())])


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


VOCABULARY = frozenset(t for notices in TEMPLATES.values() for n in notices for t in terms(n))


def document_shares(files: DataFrame) -> dict[str, float]:
    """The share of all files that hold each template term."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in rows_of(batches):
            total[""] += part.num_rows
            for text in part.column(0).to_pylist():
                total.update(VOCABULARY.intersection(terms(text or "")))
        if total:
            yield batch(schema, list(total), list(total.values()))

    rows = {r["term"]: r["n"] for r in files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    files_n = max(1, rows.pop("", 0))
    return {t: n / files_n for t, n in rows.items()}


def window_size(n: int) -> int:
    """A template's length, for long ones rounded up to a few sizes that templates share."""
    step = 1 if n <= 16 else 8 if n <= 64 else 32
    return -(-n // step) * step


class Matcher:
    """Templates as vectors, by window size, with the heavy terms that a match must have."""

    def __init__(self, shares: dict[str, float]):
        self.weight = {t: math.log(1 / (min(1.0, shares.get(t, 0.0)) + FLOOR)) + 1e-9 for t in VOCABULARY}
        self.sizes: dict[int, list[tuple[str, dict[str, float], frozenset[str], float]]] = {}
        for name, notices in TEMPLATES.items():
            for n in notices:
                vector = self.vector(Counter(terms(n)))
                heavy, rest = set(), 1.0
                for term, x in sorted(vector.items(), key=lambda p: (-abs(p[1]), p[0])):
                    if rest < COSINE**2:  # what is left can't reach the threshold
                        break
                    heavy.add(term)
                    rest -= x * x
                self.sizes.setdefault(window_size(len(terms(n))), []).append((name, vector, frozenset(heavy), len(terms(n)) ** BY_LENGTH))
        self.heavy = frozenset(t for found in self.sizes.values() for _, _, h, _ in found for t in h)
        self.order = {name: i for i, name in enumerate(TEMPLATES)}

    def vector(self, counts: Counter) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.weight.get(t, OTHER) for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / norm for t, x in raw.items()}

    def best(self, text: str | None) -> tuple[str | None, float]:
        """The best template over all windows of a whole text and its cosine; of equal ones the first listed.  Without
        one, the greatest cosine that was met."""
        words = terms(text or "")
        marks = [i for i, w in enumerate(words) if w in self.heavy]
        found: tuple[float, int, str, float] = (0.0, 0, "", 0.0)  # strength, place, name, cosine
        nearest = 0.0
        for size, templates in sorted(self.sizes.items()) if marks else ():
            step = 1 if size <= 16 else size // 4
            heavy = frozenset().union(*(t[2] for t in templates))
            starts = {s * step for i in marks if words[i] in heavy for s in range(max(0, i - size) // step, i // step + 1)}
            seen = set()
            for at in sorted(starts):
                window = words[at : at + size]
                key = tuple(window)
                if key in seen:
                    continue
                seen.add(key)
                counts = Counter(window)
                v = self.vector(counts)
                for name, t, h, by_length in templates:
                    if h.isdisjoint(counts):
                        continue
                    cosine = sum(x * v.get(term, 0.0) for term, x in t.items())
                    nearest = max(nearest, cosine)
                    if cosine >= COSINE:
                        found = max(found, (round(cosine * by_length, 12), -self.order[name], name, cosine))
        return (found[2], found[3]) if found[2] else (None, nearest)


def own_licences(files: DataFrame) -> DataFrame:
    """(path, own, score) of every file."""
    matcher = Matcher(document_shares(files))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            found = [matcher.best(t) for t in part.column(1).to_pylist()]
            yield batch(_OWN, part.column(0), [a for a, _ in found], [b for _, b in found])

    return files.select("path", "text").mapInArrow(match, "path string, own string, score double")


def inherited(own: DataFrame) -> DataFrame:
    """(home, directory, from_directory): the nearest licence above the files of a directory."""
    pieces = F.split("path", "/")
    directory = F.array_join(F.slice(pieces, 1, F.size(pieces) - 1), "/")
    given = own.where(F.col("own").isNotNull() & F.element_at(pieces, -1).rlike(LICENCE_FILE)).groupBy(directory.alias("directory"))
    given = given.agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("best")).select("directory", F.col("best.own").alias("from_directory"))
    bare = own.where("own IS NULL AND path IS NOT NULL").select(directory.alias("home")).distinct()
    steps = F.filter(F.split("home", "/"), lambda x: x != "")
    above = bare.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(steps)))).select("home", "depth", F.array_join(F.slice(steps, 1, F.col("depth")), "/").alias("directory"))
    return above.join(given, "directory").groupBy("home").agg(F.max_by(F.struct("directory", "from_directory"), "depth").alias("near")).select("home", "near.directory", "near.from_directory")


def licences(files: DataFrame) -> DataFrame:
    """One row per file: path, license (own or inherited), origin (own, directory or none), score, and
    the directory it was inherited from."""
    own = Scratch(files.sparkSession, "op5").save(own_licences(files), "own")
    pieces = F.split("path", "/")
    out = own.withColumn("home", F.array_join(F.slice(pieces, 1, F.size(pieces) - 1), "/")).join(inherited(own), "home", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("from_directory").isNotNull(), "directory").otherwise("none")
    return out.select("path", F.coalesce("own", "from_directory").alias("license"), origin.alias("origin"), F.round("score", 9).alias("score"), F.when(F.col("own").isNull(), F.col("directory")).alias("directory"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files, source / thousand / hundred / doc_id.

    A document that holds a licence line stands for a licence file, on the level that doc_id mod 3
    says: the source, the thousand or the hundred."""
    parts = [F.coalesce("source", F.lit("none")), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 1000).cast("string")), F.concat(F.lit("e"), (F.floor(F.col("doc_id") / 100) % 10).cast("string"))]
    licence = F.coalesce(F.col("text").rlike("(?i)licensed under|released under"), F.lit(False))
    name = F.concat(F.when(licence, F.lit("LICENSE.")).otherwise(F.lit("file.")), F.col("doc_id").cast("string"))
    level = F.when(licence, F.pmod(F.col("doc_id"), F.lit(3)) + 1).otherwise(3).cast("int")
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.concat_ws("/", F.array_join(F.slice(F.array(*parts), 1, level), "/"), name).alias("path"), "text")
