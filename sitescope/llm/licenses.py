"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

There are two kinds of templates. *Notices* are looked for in units of a text: its lines, its paragraphs (parted by blank
lines), and the whole text. *Files* are whole licence texts, looked for in whole texts. A unit and a template are sparse
vectors: one plus the logarithm of a term's count, times its inverse document frequency. The frequencies of all template
terms are counted over all documents, and terms outside the templates of a kind weigh like terms of no document. The cosine
of the best unit decides. DataFrame functions only, and no text is shuffled: a document is scored in its own row.

Most texts are passed over exactly (Cauchy-Schwarz): the template terms that a unit holds must make up the threshold's part of
the template's length. A template's *anchors* are its rarest terms; a unit that reaches the threshold holds at least so many of
them that the rest of the template with the heaviest of these is long enough: one or two for a notice, dozens for a file.

Versions decide: a unit that lacks a number of a notice has not that notice, however near it is (GPL 2 is not GPL 3). Whole
texts of neighbouring versions are templates all, and the nearest one names the text.

Files without a licence of their own take that of the nearest ancestor directory that holds a licence file, ``unknown`` where
that file is not recognised: directories, not files, are joined with their ancestors' paths.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from math import log, sqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, table, text_of

THRESHOLD = 0.75
#: Part of a template's squared length that its anchors hold.
ANCHORED = 0.8
UNKNOWN = "unknown"
#: Whole licence texts that come with this package, so that every machine has the same; another folder may be named.
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "texts")

# Usual licence notices by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

# Whole texts of short licences.
_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_NO_LIABILITY = "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
FILES = (
    (
        "MIT",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS {_NO_LIABILITY}",
    ),
    ("BSD-2-Clause", f"BSD 2-Clause License. {_GRANT} {_SOURCE} {_BINARY} {_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License. {_GRANT} {_SOURCE} {_BINARY} {_NAMES} {_AS_IS}"),
    (
        "ISC",
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        f"We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_NO_WARRANTY} IN NO EVENT SHALL THE AUTHORS {_NO_LIABILITY} For more information, please refer to http://unlicense.org",
    ),
)

# SPDX identifiers of the texts in FOLDER by their file names.
KEPT = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "BSD": "BSD-3-Clause",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}


def whole_texts(folder: str = FOLDER) -> tuple[tuple[str, str], ...]:
    """(identifier, text) of the short licences and of the long ones. A text that ``folder`` lacks is an error, not a gap."""
    found = []
    for file, name in KEPT.items():
        with open(os.path.join(folder, f"{file}.txt"), encoding="utf-8", errors="replace") as f:
            found.append((name, f.read()))
    return FILES + tuple(found)


def terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


class Kind(NamedTuple):
    """Templates that are looked for in the same units: identifiers and term counts."""

    names: tuple[str, ...]
    counts: tuple[Counter, ...]

    @property
    def vocabulary(self) -> list[str]:
        return sorted({t for v in self.counts for t in v})


def kinds(folder: str = FOLDER) -> tuple[Kind, Kind]:
    """Notices and files."""
    made = (tuple(zip(*[(name, Counter(terms(text))) for name, text in found], strict=True)) for found in (TEMPLATES, whole_texts(folder)))
    return tuple(Kind(*m) for m in made)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each template term; at most one row per template term is collected."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    held = docs.select(F.explode(F.array_append(F.array_intersect(words_of(text_of()), known), "")).alias("term"))
    found = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


def weights(vocabulary: list[str], n: int, df: dict[str, int]) -> dict[str, float]:
    return {t: log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}


def vector(counts: Counter, idf: dict[str, float]) -> dict[str, float]:
    return {t: (1 + log(c)) * idf[t] for t, c in counts.items()}


def anchors(counts: Counter, idf: dict[str, float], threshold: float = THRESHOLD) -> tuple[list[str], int]:
    """A template's rarest terms, and how many of them a unit must hold at least to reach the threshold."""
    squares = {t: w * w for t, w in vector(counts, idf).items()}
    total = sum(squares.values())
    chosen, held = [], 0.0
    for t in sorted(squares, key=lambda t: (-idf[t], t)):
        if held >= ANCHORED * total:
            break
        chosen.append(t)
        held += squares[t]
    need, least = held - (1 - (threshold * 0.999) ** 2) * total, 0
    for t in sorted(chosen, key=lambda t: -squares[t]):
        if need <= 0:
            break
        need, least = need - squares[t], least + 1
    return chosen, least


def _literal(found: dict[str, float]) -> Column:
    return F.create_map(*[x for t, w in sorted(found.items()) for x in (F.lit(t), F.lit(w))])


def numbers(counts: Counter) -> list[str]:
    """The numbers that a notice states: those of its version."""
    return sorted(t for t in counts if t.isdigit())


def _hit(units: Column, kind: Kind, idf: dict[str, float], other: float, versions: bool) -> Column:
    """The best (score, -template) of units, arrays of sorted terms; null without units. ``versions``: numbers are a must."""
    weigh = _literal(idf)
    vectors = [vector(c, idf) for c in kind.counts]
    lengths = [sqrt(sum(w * w for w in v.values())) for v in vectors]
    times = [_literal({t: w / n for t, w in v.items()}) for v, n in zip(vectors, lengths, strict=True)]

    def counted(ws: Column) -> Column:
        ends = F.filter(F.transform(ws, lambda w, i: F.when(F.coalesce(F.get(ws, i + 1) != w, F.lit(True)), F.struct(w.alias("term"), i.alias("end")))), lambda x: x.isNotNull())
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda x, i: F.struct(x["term"].alias("term"), (x["end"] - F.coalesce(F.get(e, i - 1)["end"], F.lit(-1))).alias("n"))))[0]

    def weighed(ws: Column) -> Column:
        return F.transform(counted(ws), lambda x: F.struct(x["term"].alias("term"), ((1 + F.log(x["n"].cast("double"))) * F.coalesce(F.try_element_at(weigh, x["term"]), F.lit(other))).alias("w")))

    def total(xs: Column, each) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + each(x))

    def dot(xs: Column, k: int) -> Column:
        found = total(xs, lambda x: F.coalesce(F.try_element_at(times[k], x["term"]) * x["w"], F.lit(0.0)))
        must = numbers(kind.counts[k]) if versions else []
        if not must:
            return found
        own = F.array_intersect(F.transform(xs, lambda x: x["term"]), F.array(*map(F.lit, must)))
        return F.when(F.size(own) == len(must), found).otherwise(0.0)

    def cosines(xs: Column) -> Column:
        dots = [F.struct(dot(xs, k).alias("dot"), F.lit(-k).alias("k")) for k in range(len(times))]
        return F.transform(F.array(total(xs, lambda x: x["w"] * x["w"])), lambda q: F.array_max(F.transform(F.array(*dots), lambda d: F.struct(F.round(d["dot"] / F.sqrt(q), 6).alias("score"), d["k"].alias("k")))))[0]

    return F.array_max(F.transform(F.transform(units, weighed), cosines))


def best(docs: DataFrame, threshold: float = THRESHOLD, folder: str = FOLDER) -> DataFrame:
    """Every row as the struct ``doc``, with own_license and own_score (null below the threshold).

    Null and empty texts have no licence. Of equal scores that of a file goes before that of a notice, and then the first
    template. Very long texts are scored whole, repeated rows each for itself; an empty table gives no rows; columns may have
    any names.
    """
    notices, files = kinds(folder)
    n, df = frequencies(docs, sorted({*notices.vocabulary, *files.vocabulary}))
    idf = [weights(k.vocabulary, n, df) for k in (notices, files)]
    other = log(1 + n) + 1
    asked = [[anchors(c, own, threshold) for c in k.counts] for k, own in zip((notices, files), idf, strict=True)]
    all_of = lambda found: F.array(*[F.lit(t) for t in sorted({t for chosen, _ in found for t in chosen})])
    rows = docs.select(F.struct("*").alias("doc"), text_of().alias("t"))

    def holds(ws: Column, found: list[tuple[list[str], int]]) -> Column:
        """Whether a unit has enough anchors of some template: those of all templates are picked out first."""
        each = F.array(*[F.struct(F.array(*map(F.lit, chosen)).alias("terms"), F.lit(m).alias("least")) for chosen, m in found])
        enough = lambda own: F.exists(each, lambda x: F.size(F.array_intersect(own, x["terms"])) >= x["least"])
        return F.exists(F.array(F.array_intersect(ws, all_of(found))), enough)

    rows = rows.select("doc", "t", words_of(F.col("t")).alias("all"))
    parts = F.array_distinct(F.concat(F.split("t", "\n"), F.split("t", r"\n[ \t\r]*\n"), F.array("t")))
    units = F.filter(F.transform(parts, words_of), lambda ws: holds(ws, asked[0]))
    rows = rows.select(
        "doc",
        F.when(holds(F.col("all"), asked[0]), F.transform(units, lambda ws: F.array_sort(ws))).alias("units"),
        F.when(holds(F.col("all"), asked[1]), F.array(F.array_sort("all"))).alias("whole"),
    )
    one = _hit(F.col("units"), notices, idf[0], other, True)
    two = _hit(F.col("whole"), files, idf[1], other, False)
    # files have the higher numbers, and go first
    rows = rows.select("doc", one.alias("one"), two.alias("two"))
    rows = rows.withColumn("file", F.coalesce(F.col("two.score") >= F.coalesce(F.col("one.score"), F.lit(0.0)), F.lit(False)))
    score = F.when(F.col("file"), F.col("two.score")).otherwise(F.col("one.score"))
    name = lambda kind, k: F.element_at(F.array(*[F.lit(x) for x in kind.names]), 1 - F.col(k))
    found = F.when(F.col("file"), name(files, "two.k")).otherwise(name(notices, "one.k"))
    good = score >= threshold
    return rows.select("doc", F.when(good, found).alias("own_license"), F.when(good, score).alias("own_score"))


def inherit(files: DataFrame, is_licence: Column) -> DataFrame:
    """Adds license and inherited_from to rows with ``path`` and own_license.

    ``is_licence`` marks licence files. A file without a licence of its own takes that of the nearest directory on its path
    that holds a licence file (several: the smallest path with a recognised one); UNKNOWN, if it is not recognised. Null paths
    inherit nothing; repeated paths are judged each for itself.
    """
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), ""))
    files = files.withColumn("folder", folder)
    given = files.where(is_licence & F.col("path").isNotNull())
    given = given.groupBy("folder").agg(F.min(F.struct(F.col("own_license").isNull().alias("none"), "path", "own_license")).alias("g"))
    given = table(given.select(F.col("folder").alias("up"), F.coalesce("g.own_license", F.lit(UNKNOWN)).alias("given")), "license-folders")

    steps = F.split("folder", "/")
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")))
    folders = files.where("folder IS NOT NULL").select("folder").distinct().withColumn("up", F.explode(F.array_distinct(ups)))
    nearest = join_small(folders, given, ["up"], "inner", spread="folder").groupBy("folder").agg(F.max_by(F.struct("up", "given"), F.length("up")).alias("n"))
    nearest = table(nearest.select("folder", F.col("n.up").alias("up"), F.col("n.given").alias("given")), "license-nearest")
    out = join_small(files, nearest, ["folder"], spread="path")
    own = F.col("own_license").isNotNull()
    return out.withColumn("license", F.coalesce("own_license", "given")).withColumn("inherited_from", F.when(~own, F.col("up"))).drop("folder", "up", "given")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, own_score, license and inherited_from.

    The documents stand in a virtual tree by their ids: thousands, hundreds, file; the first document of a hundred or of a
    thousand is its directory's LICENSE file. Null ids have no path and inherit nothing; the rest is as in ``best``.
    """
    found = table(best(docs.select("doc_id", "text")).select("doc.doc_id", "own_license", "own_score"), "license-own")
    a, b = (F.floor(F.col("doc_id") / k).cast("string") for k in (1000, 100))
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", a, F.lit("LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat_ws("/", a, b, F.lit("LICENSE"))).otherwise(F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", a, b, file)))
    return inherit(found.withColumn("path", path), F.col("path").rlike("(^|/)(LICENSE|COPYING)$"))
