"""License scans: text segments compared to licence templates by Dice coefficient over word bigrams.

A segment is a line, a sentence of a line that speaks of a licence ("licen") and has several, or a paragraph of several
lines (lines between blank lines; a line of comment marks only is blank). Lines end in "\\n", "\\r\\n" or "\\r". It is normalised
(lower case, every run of characters other than a-z and 0-9 one blank), cut into words, and its set
of word bigrams is held against that of each template: 2 |A and B| / (|A| + |B|). Only templates
whose size allows the threshold are compared: |A| between t/(2-t) |B| and (2-t)/t |B|, and only
segments with one of the words that no match can lack (``marking_words``). A segment
matches its best template at or above the threshold, ties to the first in name order. Templates are notices,
SPDX tags, header paragraphs and the paragraphs of short full texts; of a notice inside a longer line
or paragraph the segment is compared, not the notice. ``scan_license_windows`` looks at every place of a text instead, whatever its lines
and sentences are: at all runs of consecutive words from any word on, up to the size that a template allows.

One projection of built-in functions: no shuffle, no join, no Python. Null and empty texts match
nothing (no licences, 0 matches, null score); very long texts are scanned whole, line by line. Repeated rows are
each scanned for themselves; rows with a null doc_id are scanned too. An empty table gives an empty
table. A kept column with the name of an outcome gives way to it.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart_from, table, text_or_empty

THRESHOLD = 0.8

# Public licence names, notices, header paragraphs and paragraphs of full texts.
TITLES: dict[str, str] = {
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "ISC": "ISC License",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "Unlicense": "Unlicense",
    "Zlib": "zlib License",
}
PARAGRAPHS: dict[str, list[str]] = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GNU": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
NOTICES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.")
#: Licences whose paragraphs are their whole text: people also run them together.
WHOLE = ("ISC", "MIT")
#: BSD and GNU name paragraphs that several licences of the family share.
TEMPLATES: dict[str, list[str]] = {
    name: [*(n.format(TITLES[name]) for n in NOTICES if name in TITLES), *([f"SPDX-License-Identifier: {name}"] if name in TITLES else []), *PARAGRAPHS.get(name, []), *([" ".join(PARAGRAPHS[name])] if name in WHOLE else [])] for name in sorted({*TITLES, *PARAGRAPHS})
}


def bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)))


def prepared(threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> list[tuple[str, int, int, list[str]]]:
    """(name, least and most distinct bigrams of a segment that can match, bigrams) in name order."""
    out = []
    for name, variants in sorted((templates or TEMPLATES).items()):
        for text in variants:
            own = bigrams(text)
            n = len(own)
            least = next(a for a in range(1, n + 1) if 2 * a / (a + n) >= threshold)
            most = next(a for a in range(int(2 * n / threshold) + 1, n - 1, -1) if 2 * n / (a + n) >= threshold)
            out.append((name, least, most, own))
    return out


def marking_words(known: list[tuple[str, int, int, list[str]]], threshold: float, shortest: int = 5) -> list[str]:
    """Words of which every matching segment holds at least one. A match at t shares t / (2 - t) of a template's bigrams, so it
    holds one of any set with more bigrams than may be missing. Words are taken greedily until those with one of them
    are so many in each template; short ones only where nothing else is left."""
    grams = [[tuple(g.split()) for g in own] for *_, own in known]
    left = [n - next(i for i in range(n + 1) if i >= threshold * n / (2 - threshold) - 1e-9) + 1 for n in map(len, grams)]
    words: list[str] = []
    while any(n > 0 for n in left):
        gain: dict[str, int] = {}
        for own, n in zip(grams, left, strict=True):
            if n > 0:
                for w in {w for g in own for w in g}:
                    gain[w] = gain.get(w, 0) + min(n, sum(w in g for g in own))
        best = max(gain, key=lambda w: (len(w) >= shortest, gain[w], w))
        words.append(best)
        for k, own in enumerate(grams):
            left[k] -= sum(best in g for g in own)
            grams[k] = [g for g in own if best not in g]
    return words


def least_shared(n: int, threshold: float) -> int:
    """Of a template's n bigrams, so many at least are in any segment that matches (it has these at least itself)."""
    return next(x for x in range(1, n + 1) if 2 * x / (x + n) >= threshold)


#: What ends a sentence within a line, and what parts paragraphs: lines of blanks and comment marks.
SENTENCE, BLANK = "[.!?:] +", r"\n[ \t#*/;%-]*\n"


def _normalised(segment: Column) -> Column:
    return F.trim(F.regexp_replace(segment, "[^a-z0-9]+", " "))


def _matches(segments: Column, templates: list[tuple[str, int, int, list[str]]], threshold: float) -> Column:
    """array<struct<score, name>> of the segments (lower case) that match, each with its best template."""
    least, most = min(t[1] for t in templates), max(t[2] for t in templates)

    def sets(segment: Column) -> Column:
        words = F.split(_normalised(segment), " ")
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))

    # a set of n bigrams takes n + 1 words at least, so 2 n + 1 characters: shorter segments need no look
    marks = marking_words(templates, threshold)
    long_enough = F.filter(segments, lambda s: (F.length(s) >= 2 * least + 1) & reduce(or_, [F.contains(s, F.lit(w)) for w in marks]))
    sized = F.filter(F.transform(long_enough, sets), lambda b: F.size(b).between(least, most))

    def best(b: Column) -> Column:
        scored = [
            F.when(F.size(b).between(lo, hi), F.struct((F.lit(2.0) * F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in own]))) / (F.size(b) + len(own))).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
            for k, (name, lo, hi, own) in enumerate(templates)
        ]
        return F.array_max(F.filter(F.array(*scored), lambda x: x["score"] >= threshold))

    return F.filter(F.transform(sized, best), lambda x: x.isNotNull())


def scan_licenses(documents: DataFrame, keep: list[str], threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``keep`` columns, licenses (distinct names in order, joined by |), n_matches (matching segments), best_score."""
    known = prepared(threshold, templates)
    keep = [c for c in keep if c not in ("licenses", "n_matches", "best_score")]
    found = apart_from(keep, "found")
    lowered = F.lower(text_or_empty())
    plain = F.when(F.contains(lowered, F.lit("\r")), F.regexp_replace(lowered, "\r\n?", "\n")).otherwise(lowered)
    lines = F.split(plain, "\n")
    told = F.filter(lines, lambda s: F.contains(s, F.lit("licen")) & s.rlike(SENTENCE))
    sentences = F.flatten(F.transform(told, lambda s: F.split(s, SENTENCE)))
    paragraphs = F.filter(F.split(plain, BLANK), lambda p: F.contains(F.trim(p), F.lit("\n")))
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], _matches(F.concat(lines, sentences, paragraphs), known, threshold).alias(found))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["name"])))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.array_join(names, "|").alias("licenses"), F.size(found).cast("long").alias("n_matches"), F.array_max(F.transform(found, lambda x: x["score"])).alias("best_score"))


def scan_license_windows(documents: DataFrame, keep: list[str], threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``keep`` columns and ``windows``, an array of struct<start, score, name> by start: the places (bigrams from 0) of a text from which on a
    notice is read, with the best template there (ties to the first in name order).

    The words of a text are one sequence, over the ends of lines and sentences. From a bigram of a template on, all runs of bigrams up to the greatest size that the
    template allows are compared as sets, and the best counts; a run that begins with another bigram is never better than without it.
    So no notice is lost for what stands around it. What is left out cannot match: texts without a marking word, places with fewer bigrams of the
    template in reach than a match shares. A text is one task's work, linear in its length."""
    known = prepared(threshold, templates)
    keep = [c for c in keep if c != "windows"]
    text = apart_from(keep)
    lowered = F.lower(text_or_empty())
    # constants, each parsed as one expression
    literal = lambda s: "'{}'".format(s.replace("\\", "\\\\").replace("'", "\\'"))
    quoted = lambda grams: "array({})".format(", ".join(map(literal, grams)))
    table_of = F.expr("array({})".format(", ".join(f"named_struct('k', {k}, 'name', {literal(name)}, 'most', {most}, 'need', {least_shared(len(own), threshold)}, 'own', {quoted(own)})" for k, (name, _, most, own) in enumerate(known))))
    users: dict[str, list[str]] = {}  # of each bigram, the templates
    for k, (*_, own) in enumerate(known):
        for g in own:
            users.setdefault(g, []).append(str(k))
    users_of = F.expr("map({})".format(", ".join(f"'{g}', array({', '.join(ks)})" for g, ks in users.items())))

    def held(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)  # a variable of a lambda is computed once

    def best(pairs: Column, start: Column, template: Column) -> Column:
        """Best score of the runs from ``start``: shared and distinct bigrams are counted on along the longest."""

        def along(run: Column) -> Column:
            seen = F.transform(run, lambda p, n: F.struct((F.array_position(run, p) == n + 1).alias("new"), F.array_contains(template["own"], p).alias("own")))
            zero = F.struct(F.lit(0).alias("shared"), F.lit(0).alias("all"), F.lit(0.0).alias("score"))

            def step(s: Column, p: Column) -> Column:
                shared, every = s["shared"] + F.when(p["new"] & p["own"], 1).otherwise(0), s["all"] + F.when(p["new"], 1).otherwise(0)
                return F.struct(shared.alias("shared"), every.alias("all"), F.greatest(s["score"], F.lit(2.0) * shared / (every + F.size(template["own"]))).alias("score"))

            return F.aggregate(seen, zero, step)["score"]

        return held(F.slice(pairs, start + 1, template["most"]), along)

    def of_template(pairs: Column, near: Column, template: Column) -> Column:
        def found(hits: Column) -> Column:
            enough = F.filter(hits, lambda h, j: F.coalesce(F.get(hits, j + (template["need"] - 1)) < h + template["most"], F.lit(False)))
            scored = F.transform(enough, lambda h: F.struct(h.alias("start"), (-best(pairs, h, template)).alias("low"), template["k"].alias("order"), template["name"].alias("name")))
            return F.filter(scored, lambda m: m["low"] <= -threshold)

        return held(F.transform(F.filter(near, lambda h: F.array_contains(h["users"], template["k"])), lambda h: h["i"]), found)

    def of_text(words: Column) -> Column:
        pairs = F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
        known_at = lambda p: F.filter(F.transform(p, lambda g, i: F.struct(g.alias("p"), i.alias("i"))), lambda h: h["p"].isin(list(users)))
        near = lambda p: F.transform(known_at(p), lambda h: F.struct(h["i"].alias("i"), F.element_at(users_of, h["p"]).alias("users")))
        return held(pairs, lambda p: held(near(p), lambda near: F.flatten(F.transform(table_of, lambda t: of_template(p, near, t)))))

    def one_a_start(matches: Column) -> Column:
        first = F.filter(matches, lambda m, j: (j == 0) | (F.get(matches, j - 1)["start"] != m["start"]))
        return F.transform(first, lambda m: F.struct(m["start"].alias("start"), (-m["low"]).alias("score"), m["name"].alias("name")))

    marked = reduce(or_, [F.contains(F.col(text), F.lit(w)) for w in marking_words(known, threshold)])
    none = F.array().cast("array<struct<start:int,score:double,name:string>>")
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], lowered.alias(text))
    found = held(F.split(_normalised(F.col(text)), " "), lambda words: held(F.array_sort(of_text(words)), one_a_start))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.when(marked, found).otherwise(none).alias("windows"))


def oracle(threshold: float = THRESHOLD) -> str:
    """Counts the bigrams that a segment and a template share, for all that share any; without size bounds."""
    rows = ",\n".join("({}, '{}', {}, [{}])".format(k, name, len(own), ", ".join(f"'{b}'" for b in own)) for k, (name, _, _, own) in enumerate(prepared(threshold)))
    return f"""
WITH templates(k, name, size, grams) AS (VALUES {rows}),
parts AS (SELECT k, name, size, unnest(grams) AS gram FROM templates),
plain AS (SELECT doc_id, replace(replace(lower(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
segments AS (
  SELECT doc_id, unnest(list_concat(list_concat(string_split(t, chr(10)), flatten(list_transform(list_filter(string_split(t, chr(10)), lambda l: contains(l, 'licen') AND regexp_matches(l, '[.!?:] ')), lambda l: regexp_split_to_array(l, '[.!?:] +')))),
    list_filter(regexp_split_to_array(t, '\\n[ \\t#*/;%-]*\\n'), lambda p: contains(trim(p), chr(10))))) AS s
  FROM plain),
worded AS (SELECT row_number() OVER () AS seg, doc_id, string_split(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM segments),
grams AS (SELECT seg, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded),
each AS (SELECT seg, doc_id, len(g) AS n, unnest(g) AS gram FROM grams),
scored AS (SELECT seg, doc_id, k, name, 2.0::DOUBLE * count(*) / (any_value(n) + any_value(size)) AS score FROM each JOIN parts USING (gram) GROUP BY seg, doc_id, k, name),
best AS (SELECT seg, doc_id, max(score) AS score, arg_max(name, (score, -k)) AS name FROM scored WHERE score >= {threshold} GROUP BY seg, doc_id),
found AS (SELECT doc_id, string_agg(DISTINCT name, '|' ORDER BY name) AS licenses, count(*) AS n_matches, max(score) AS best_score FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0)::BIGINT AS n_matches, best_score
FROM documents d LEFT JOIN found USING (doc_id)"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])


def windows_oracle(threshold: float = THRESHOLD) -> str:
    """Every place of every text: the words as one sequence, runs from each bigram of a template on, of each length up to the greatest."""
    rows = ",\n".join("({}, '{}', {}, {}, {}, [{}])".format(k, name, len(own), most, least_shared(len(own), threshold), ", ".join(f"'{b}'" for b in own)) for k, (name, _, most, own) in enumerate(prepared(threshold)))
    return f"""
WITH templates(k, name, size, most, need, grams) AS (VALUES {rows}),
parts AS (SELECT k, size, most, need, unnest(grams) AS gram FROM templates),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
each AS (SELECT r, unnest(list_transform(range(1, len(w)), lambda i: {{'i': i, 'gram': w[i] || ' ' || w[i + 1]}}), recursive := true) FROM texts),
hits AS (SELECT r, k, i, most, need, size, count(*) OVER (PARTITION BY r, k ORDER BY i RANGE BETWEEN CURRENT ROW AND most - 1 FOLLOWING) AS reach FROM each JOIN parts USING (gram)),
runs AS (SELECT h.r, h.k, h.size, h.i AS start, e.i, row_number() OVER (PARTITION BY h.r, h.k, h.i, e.gram ORDER BY e.i) = 1 AS fresh, p.gram IS NOT NULL AS own
  FROM hits h JOIN each e ON e.r = h.r AND e.i >= h.i AND e.i < h.i + h.most LEFT JOIN parts p ON p.k = h.k AND p.gram = e.gram WHERE h.reach >= h.need),
counts AS (SELECT r, k, size, start, sum((fresh AND own)::INT) OVER v AS shared, sum(fresh::INT) OVER v AS n FROM runs WINDOW v AS (PARTITION BY r, k, start ORDER BY i)),
scored AS (SELECT r, k, start, max(2.0::DOUBLE * shared / (n + size)) AS score FROM counts GROUP BY r, k, start),
best AS (SELECT r, start, max(score) AS score, arg_max(name, (score, -k)) AS name FROM scored JOIN templates USING (k) WHERE score >= {threshold} GROUP BY r, start),
found AS (SELECT r, string_agg(DISTINCT name, '|' ORDER BY name) AS licenses, count(*) AS n_starts, max(score) AS best_score FROM best GROUP BY r)
SELECT doc_id::BIGINT AS doc_id, coalesce(licenses, '') AS licenses, coalesce(n_starts, 0)::BIGINT AS n_starts, best_score FROM texts LEFT JOIN found USING (r)"""


def license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, licenses (names in order, joined by |), n_starts (places from which on a notice is read), best_score."""
    found = scan_license_windows(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    w = F.col("windows")
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct(w["name"])), "|").alias("licenses"), F.size(w).cast("long").alias("n_starts"), F.array_max(w["score"]).alias("best_score"))
