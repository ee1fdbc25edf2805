"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Three units of a text are compared: every line, every paragraph (between empty lines) and the whole.
A unit whose number of bigrams is so far from a template's that the coefficient cannot reach the
threshold is never compared with it, which prunes most units before their bigrams are even built.
All of it are DataFrame functions on the row at hand: the templates are a constant whose size depends
on their list alone, so nothing is shuffled, joined or grouped and no source or text can be hot.
"""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

#: Public licence texts and the usual one-line notices, by SPDX identifier. A parameter of scan().
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
        "of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    ),
)
#: Whole texts too long for this file.
LONG = ("Apache-2.0", "MPL-2.0", "CC0-1.0", "GPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")
TEMPLATES += tuple((name, (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8")) for name in LONG)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: everything but letters, digits and the line feed (which separates lines).
BREAKS = r"[^\p{L}\p{N}\n]+"


#: An empty line.
GAP = r"\n *\n[ \n]*"
KINDS = ("line", "paragraph", "text")


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, UPPER, LOWER), BREAKS, " ")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Distinct pairs of adjacent words; of a single word the word, of none nothing."""
    more = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, more), F.slice(words, 2, more), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def template_bigrams(text: str) -> list[str]:
    """The same of a template, on the driver."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:]))) if len(words) > 1 else words


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, dice, unit, place, licenses and n_matches for every row of docs (doc_id, text).

    A unit (line, paragraph of more than one line, or whole text of more than one paragraph) matches a
    template if twice their common distinct bigrams make up at least `threshold` of the bigrams of both.
    license and dice are those of the best match (ties: line before paragraph before text, then the
    earlier place, then the first template), licenses the matched identifiers in order, joined by commas,
    n_matches the matching pairs of unit and template. Null and empty texts, and texts without a match,
    have nulls, an empty string and 0. Rows that repeat are reported each. Without templates nothing matches.
    """
    table = [{"t": i, "license": name, "grams": template_bigrams(text)} for i, (name, text) in enumerate(templates)]
    table = [{**t, "size": len(t["grams"])} for t in table if t["grams"]]
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<t:int,license:string,grams:array<string>,size:int>>")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min((t["size"] for t in table), default=1) * low, max((t["size"] for t in table), default=0) * high

    def unit(kind: int):
        def of(x: Column, i: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), i.alias("place"), _words(x).alias("words"))

        return of

    body = F.col("body")
    lines = F.transform(F.split(body, r"\n"), unit(0))
    paragraphs = F.transform(F.filter(F.split(body, GAP), lambda x: F.contains(F.trim(x), F.lit("\n"))), unit(1))
    whole = F.transform(F.filter(F.array(body), lambda x: F.regexp_like(x, F.lit(rf"[^ \n] *{GAP}[^ \n]"))), unit(2))
    rows = docs.select("doc_id", _normal(F.coalesce("text", F.lit(""))).alias("body")).select("doc_id", F.concat(lines, paragraphs, whole).alias("units"))
    # distinct bigrams are at most the words less one: units too small fall before their bigrams are built
    rows = rows.select("doc_id", F.filter("units", lambda u: F.size(u["words"]) >= F.greatest(F.lit(1), F.least(F.lit(2), F.ceil(F.lit(least)).cast("int")))).alias("units"))
    sized = F.transform("units", lambda u: F.struct(u["kind"].alias("kind"), u["place"].alias("place"), _bigrams(u["words"]).alias("grams")))
    rows = rows.select("doc_id", F.filter(sized, lambda u: F.size(u["grams"]).between(math.ceil(least), math.floor(most))).alias("units"))

    def against(u: Column) -> Column:
        n = F.size(u["grams"])
        near = F.filter(known, lambda t: (n >= low * t["size"]) & (n <= high * t["size"]))
        return F.transform(
            near,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(u["grams"], t["grams"])) / (n + t["size"])).alias("dice"), (-u["kind"]).alias("kind"), (-u["place"]).alias("place"), (-t["t"]).alias("t"), t["license"].alias("license")
            ),
        )

    matches = F.filter(F.flatten(F.transform("units", against)), lambda m: m["dice"] >= threshold)
    rows = rows.select("doc_id", matches.alias("m")).withColumn("best", F.array_max("m"))
    return rows.select(
        "doc_id",
        F.col("best.license").alias("license"),
        F.round("best.dice", 6).alias("dice"),
        F.when(F.col("best.kind") == 0, KINDS[0]).when(F.col("best.kind") == -1, KINDS[1]).when(F.col("best.kind") == -2, KINDS[2]).alias("unit"),
        (-F.col("best.place")).cast("int").alias("place"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["license"]))), ",").alias("licenses"),
        F.size("m").cast("long").alias("n_matches"),
    )


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same as DuckDB SQL over the table documents."""
    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))

    def normal(text: str) -> str:
        return f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{BREAKS}', ' ', 'g')"

    def words(text: str) -> str:
        return rf"list_filter(string_split_regex({text}, '[ \n]+'), lambda w: w <> '')"

    grams = "list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"
    return f"""
WITH templates AS (SELECT t, license, {grams} AS grams FROM (SELECT t, license, {words(normal('text'))} AS w FROM (VALUES {values}) v(t, license, text))),
body AS (SELECT row_number() OVER () AS r, doc_id, {normal("coalesce(text, '')")} AS body FROM documents),
units AS (
  SELECT r, 0 AS kind, unnest(range(0, len(string_split(body, chr(10))))) AS place, unnest(string_split(body, chr(10))) AS unit FROM body
  UNION ALL SELECT r, 1, unnest(range(0, len(p))), unnest(p) FROM (SELECT r, list_filter(string_split_regex(body, '{GAP}'), lambda x: contains(trim(x), chr(10))) AS p FROM body)
  UNION ALL SELECT r, 2, 0, body FROM body WHERE regexp_matches(body, '[^ \\n] *{GAP}[^ \\n]')),
sized AS (SELECT r, kind, place, {grams} AS grams FROM (SELECT r, kind, place, {words('unit')} AS w FROM units)),
matches AS (
  SELECT r, kind, place, t, license, 2e0 * len(list_intersect(s.grams, t.grams)) / (len(s.grams) + len(t.grams)) AS dice
  FROM sized s JOIN templates t ON len(s.grams) > 0 AND len(s.grams) BETWEEN {threshold / (2 - threshold)} * len(t.grams) AND {(2 - threshold) / threshold} * len(t.grams)),
good AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, kind, place, t) AS rank FROM matches WHERE dice >= {threshold}),
best AS (SELECT * FROM good WHERE rank = 1),
every AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n FROM good GROUP BY r)
SELECT doc_id, license, round(dice, 6) AS dice, CASE kind WHEN 0 THEN 'line' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'text' END AS unit, CAST(place AS INTEGER) AS place,
  coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_matches
FROM body LEFT JOIN best USING (r) LEFT JOIN every USING (r)"""
