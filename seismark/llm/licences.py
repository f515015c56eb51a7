"""Licence scan: sparse TF-IDF cosine of headers and whole files to templates, then inheritance from the nearest directory.

Lines, windows of two and three lines, paragraphs and whole files are held against the templates; a file's header is what
of it is nearest to one. A licence file is named like one and has a header, or is near to a template as a whole, and governs
its directory. A file without a header of its own takes the licence of its nearest governed ancestor directory, found by
joins on paths. Term weights come from all lines of the corpus: a term of the templates weighs by the share of lines that
hold it, any other by the largest weight.

By the Cauchy-Schwarz inequality a text reaches a cosine of ``HEADER`` only if it holds one of a template's heavy terms: the
light ones alone make up less than that share of the template's length. Only lines with such a term are looked at; this
leaves nothing out. Cosines are worked out row by row, so no term is shuffled. DataFrame functions only.

Defined cases: a null or empty text has no header but may inherit; a null path inherits nothing; of equally near templates
the first in order counts; rows that share file and path share the nearest header of them, so repeated rows get equal
results; very long lines and texts are compared as a whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# Usual wordings of each licence (names, notices, full short texts, and the heads of long ones).
TEMPLATES = {
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "All rights reserved": ["All rights reserved."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
HEADER, WHOLE = 0.6, 0.75
#: Lines of the longest window.
LINES = 3
#: Governed directories and files with a licence of their own up to this many are broadcast.
MAX_BROADCAST_ROWS = 100_000
_TERM = "[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _template_terms(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for term in re.findall(_TERM, text.lower()):
        found[term] = found.get(term, 0) + 1
    return found


class Weights:
    """Inverse frequencies of the templates' terms, and of each template (in order) its name, weighted terms and length."""

    def __init__(self, templates: dict[str, list[str]], lines: int, counts: dict[str, int]) -> None:
        self.top = log(1 + lines) + 1
        self.templates, self.idf = [], {}
        for name in sorted(templates):
            for text in templates[name]:
                found = _template_terms(text)
                self.idf |= {t: log((1 + lines) / (1 + counts.get(t, 0))) + 1 for t in found}
                weights = {t: (1 + log(n)) * self.idf[t] for t, n in found.items()}
                self.templates.append((name, weights, sqrt(sum(w * w for w in weights.values()))))

    def heavy(self, share: float) -> list[str]:
        """Terms of which a text with that cosine to a template holds at least one."""
        found: set[str] = set()
        for _, weights, length in self.templates:
            left = (share * length) ** 2 * (1 - 1e-9)
            for term in sorted(weights, key=lambda t: (weights[t], t)):
                left -= weights[term] ** 2
                if left <= 0:
                    found.add(term)
        return sorted(found)

    def table(self) -> Column:
        """A constant map of each term to its inverse frequency and its share in each template."""
        return F.from_json(F.lit(json.dumps({t: [idf, *[weights.get(t, 0.0) / length for _, weights, length in self.templates]] for t, idf in self.idf.items()})), "map<string,array<double>>")


def line_counts(texts: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of lines with a term, and of those with each term of the vocabulary."""
    known = F.broadcast(texts.sparkSession.createDataFrame([("",), *[(t,) for t in vocabulary]], "term string"))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).select(terms(F.col("line")).alias("words")).where(F.size("words") > 0)
    held = lines.select(F.explode(F.array_union(F.array(F.lit("")), F.col("words"))).alias("term")).join(known, "term")
    counts = {r["term"]: r["count"] for r in held.groupBy("term").count().collect()}  # one row per term of the templates at most
    return counts.pop("", 0), counts


def _units(files: DataFrame, heavy: list[str]) -> DataFrame:
    """(file, path, whole, start, size, unit): all windows, paragraphs (size 0) and whole texts (size -1) that hold a heavy term."""
    marks = F.array(*[F.lit(t) for t in heavy])
    held = files.where(F.arrays_overlap(terms(F.col("text")), marks)).withColumn("_lines", F.split("text", "\n"))
    hit = F.filter(F.transform("_lines", lambda x, i: F.when(F.arrays_overlap(terms(x), marks), i)), lambda i: i.isNotNull())
    blank = F.concat(F.array(F.lit(-1)), F.filter(F.transform("_lines", lambda x, i: F.when(F.trim(x, F.lit(" \t\r")) == "", i)), lambda i: i.isNotNull()), F.array(F.size("_lines")))
    held = held.withColumn("_hit", hit).withColumn("_blank", blank)
    joined = lambda start, size: F.array_join(F.slice("_lines", start + 1, size), "\n")
    unit = lambda start, size, text: F.struct(start.cast("int").alias("start"), F.lit(size).alias("size"), text.alias("unit"))

    def windows(size: int) -> Column:
        starts = F.array_distinct(F.flatten(F.transform("_hit", lambda i: F.sequence(F.greatest(i - size + 1, F.lit(0)), i))))
        starts = F.filter(starts, lambda s: s + size <= F.size("_lines"))
        return F.transform(starts, lambda s: unit(s, size, joined(s, F.lit(size))))

    parts = [windows(size) for size in range(1, LINES + 1)]
    gaps = F.filter(F.transform("_blank", lambda b, i: F.struct((b + 1).alias("a"), (F.get(F.col("_blank"), i + 1) - b - 1).alias("n"))), lambda p: p["n"] > LINES)
    parts.append(F.transform(gaps, lambda p: unit(p["a"], 0, joined(p["a"], p["n"]))))
    parts.append(F.array(unit(F.lit(0), -1, F.col("text"))))
    return held.select("file", "path", F.explode(F.concat(*parts)).alias("u")).select("file", "path", "u.*")


def _with(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), 0)


def _squares(words: Column) -> Column:
    """The sum of (1 + log n)^2 over distinct terms; sorted ones are counted by the distances of their first places."""
    starts = lambda ts: F.filter(F.transform(ts, lambda _, i: i), lambda i: (i == 0) | (F.get(ts, i) != F.get(ts, i - 1)))
    ends = lambda at, n: F.transform(at, lambda i, j: 1 + F.log((F.coalesce(F.get(at, j + 1), n) - i).cast("double")))
    logs = _with(F.sort_array(words), lambda ts: _with(starts(ts), lambda at: ends(at, F.size(ts))))
    return F.aggregate(logs, F.lit(0.0), lambda a, x: a + x * x)


def nearest(units: DataFrame, weights: Weights) -> DataFrame:
    """(file, path, size, best): the nearest template of each unit, as (similarity, -place, licence); worked out row by row."""
    top, table = weights.top, weights.table()
    rows = units.select("file", "path", "size", terms(F.col("unit")).alias("_terms")).where(F.size("_terms") > 0)
    times = lambda t: 1 + F.log(F.size(F.filter("_terms", lambda x: x == t)).cast("double"))
    mine = F.transform(F.array_intersect("_terms", F.array(*[F.lit(t) for t in sorted(weights.idf)])), lambda t: F.struct(times(t).alias("f"), F.try_element_at(table, t).alias("v")))
    rows = rows.select("file", "path", "size", _squares(F.col("_terms")).alias("_squares"), mine.alias("_mine"))
    length = F.sqrt(F.aggregate("_mine", top * top * F.col("_squares"), lambda a, m: a + m["f"] * m["f"] * (F.get(m["v"], 0) * F.get(m["v"], 0) - top * top)))
    add = lambda total, m: F.zip_with(total, F.slice(m["v"], 2, len(weights.templates)), lambda a, x: a + m["f"] * F.get(m["v"], 0) * x)
    dots = F.aggregate("_mine", F.array_repeat(F.lit(0.0), len(weights.templates)), add)
    rows = rows.select("file", "path", "size", length.alias("_length"), dots.alias("_dots"))
    names = F.array(*[F.lit(name) for name, _, _ in weights.templates])
    scored = F.transform("_dots", lambda d, i: F.struct(F.round(d / F.col("_length"), 6).alias("similarity"), (-i).alias("order"), F.get(names, i).alias("licence")))
    return rows.select("file", "path", "size", F.array_max(scored).alias("best"))


def directories(path: Column) -> Column:
    """All ancestor directories of a directory and itself, the root-most first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def url_path(url: Column) -> Column:
    """host/directories/file of a URL, without scheme, query, fragment and closing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z]+://", ""), "[?#].*$", ""), "/+$", "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def scan_licences(files: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of (file, path, text): file, path, licence, similarity and via (header, file, inherited), null without any.

    ``file`` is any column that tells files apart; ``templates`` holds wordings of each licence.
    """
    templates = TEMPLATES if templates is None else templates
    texts = files.select("file", "path", F.col("text").cast("string").alias("text"))
    vocabulary = sorted({t for wordings in templates.values() for text in wordings for t in _template_terms(text)})
    weights = Weights(templates, *line_counts(texts, vocabulary))
    near = nearest(_units(texts, weights.heavy(min(HEADER, WHOLE))), weights)
    best = near.groupBy("file", "path").agg(F.max(F.when(F.col("size") >= 0, F.col("best"))).alias("_header"), F.max(F.when(F.col("size") < 0, F.col("best"))).alias("_whole"))
    header = F.when(F.col("_header.similarity") >= HEADER, F.col("_header"))
    whole = F.when(F.col("_whole.similarity") >= WHOLE, F.col("_whole"))
    named = F.coalesce(F.col("path").rlike(NAMED), F.lit(False))
    own = best.select("file", "path", header.alias("_header"), F.coalesce(F.greatest(whole, F.when(named, header)), F.when(named & (F.col("_whole.similarity") >= HEADER), F.col("_whole"))).alias("_file"))
    own = written(own.where(F.coalesce("_header", "_file").isNotNull()))
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    governed = own.where(F.col("_file").isNotNull() & F.col("path").contains("/")).groupBy(parent.alias("directory")).agg(F.max("_file").alias("_given"))
    governed = written(governed)
    # directories are few against files: each is looked up once, with all its ancestors
    below = files.select(parent.alias("_parent")).where("_parent IS NOT NULL").distinct().select("_parent", F.posexplode(directories(F.col("_parent"))).alias("depth", "directory"))
    inherited = written(below.join(_small(governed), "directory").groupBy("_parent").agg(F.max_by("_given", "depth").alias("_given")))
    mine = own.select(F.col("file").alias("_f"), F.col("path").alias("_p"), "_header", "_file")
    out = files.select("file", "path", parent.alias("_dir")).join(_small(mine), F.col("file").eqNullSafe(F.col("_f")) & F.col("path").eqNullSafe(F.col("_p")), "left")
    out = out.join(_small(inherited), F.col("_dir") == F.col("_parent"), "left")
    found = F.coalesce("_file", "_header", "_given")
    via = F.when(F.col("_file").isNotNull(), "file").when(F.col("_header").isNotNull(), "header").when(F.col("_given").isNotNull(), "inherited")
    return out.select("file", "path", found["licence"].alias("licence"), found["similarity"].alias("similarity"), via.alias("via"))
