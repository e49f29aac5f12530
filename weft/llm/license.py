"""License scans, in DataFrame operations only.

Texts are cut into windows of word shingles for each size of template: a window holds
one and a half times the shingles of the largest template of its size and starts every
half, so that any stretch as long as a template lies whole in one window. A template
whose shingles are contained in a window to at least ``CONTAINED`` then has a Jaccard
similarity with it of at least 4/15; with ``BANDS`` MinHash bands of one row such a
pair shares a band with a probability of at least 1 - (11/15)^48, over 0.9999996.
The bands alone retrieve templates for windows; every template retrieved is then verified
by the exact containment of its shingles, compared as text.

A test that loses nothing comes first: a template needs some of its words, those that
stand in more than the share of its shingles that may be missing. Texts without any such
word, and windows without one of a template of their size, are passed over. For texts the
words are chosen to be few over all templates (over ``MOST_WORDS``, only windows are tested),
for windows to be long.

Rows of windows hold a band's smallest hash and no shingles, so the join with the
templates' bands moves little, and nothing at all while these are few enough to be sent to
every executor (``SENT_BANDS``, counted before). Templates are a relation (license,
template), or a dictionary. What was retrieved goes back to its texts, by id and text hash,
for the verification.

Defined results: NULL text and texts shorter than a shingle match nothing; templates
shorter than a shingle are refused; a text that repeats a license is reported once with
its best containment; rows with the same id are reported together, NULL ids too; repeated
rows change nothing; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
BANDS = 48
MOST_WORDS = 64  # needed words that whole texts are searched for
SENT_BANDS = 200_000  # rows of templates' bands, 32 bytes each, that are sent to every executor
_MULTIPLY = 0x2545F4914F6CDD1D

#: Public license texts and notices that are looked for, by name (fixed values).
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "lgpl-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "bsd-3-clause-notice": "Licensed under the BSD 3-Clause License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
    " copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
    " copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO"
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
    " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
    " except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
    " distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
    " either express or implied. See the License for the specific language governing permissions and limitations under"
    " the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
    " option) any later version.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
    " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
    " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
    " materials provided with the distribution.",
    "bsd-3-clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
    " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
    " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
    " materials provided with the distribution."
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU"
    " Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at"
    " your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at"
    " your option) any later version.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public"
    " License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
    " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for"
    " any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
    " restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original"
    " software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but"
    " is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the"
    " original software. 3. This notice may not be removed or altered from any source distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of"
    " the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORDS = re.compile(r"[a-z0-9]+")


def _shingles(text: str) -> list[str]:
    w = _WORDS.findall(text.lower())
    return [" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]


def needed_words(text: str, shared: set[str] = frozenset()) -> list[str]:
    """Words of which any text that contains enough of the template has at least one: ``shared`` ones first, then long ones."""
    shingles, chosen, covered = set(_shingles(text)), [], set()
    for word in sorted({w for s in shingles for w in s.split()}, key=lambda w: (w not in shared, -len(w), w)):
        more = {s for s in shingles if word in s.split()} - covered
        if more:
            covered |= more
            chosen.append(word)
        if len(covered) > (1 - CONTAINED) * len(shingles) + 1e-9:
            break
    return chosen


def size_class(n: int) -> int:
    """The smallest power of two not below a template's number of shingles, at least 2."""
    return max(2, 1 << (n - 1).bit_length())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def _shingle_texts(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.when(n >= 1, made).otherwise(F.array().cast("array<string>"))


def _bands(shingles: Column) -> Column:
    """One MinHash row a band: the smallest of the shingles' hashes under the band's permutation."""
    multipliers = [((2 * j + 1) * _MULTIPLY) % 2**64 for j in range(BANDS)]

    def lowest(hashes: Column, m: int) -> Column:
        salt = F.lit(m - 2**64 if m >= 2**63 else m)
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h.bitwiseXOR(salt))))

    one = F.array(F.transform(shingles, lambda s: F.xxhash64(s)))  # bound to a name, so that it is computed once
    return F.flatten(F.transform(one, lambda h: F.array(*[lowest(h, m) for m in multipliers])))


def _window(shingles: Column, size: Column, k: Column) -> Column:
    """Shingles of window ``k`` of a size."""
    return F.array_distinct(F.slice(shingles, (k * size / 2).cast("int") + 1, (size * 3 / 2).cast("int")))


def _listed(templates: dict[str, str] | DataFrame | None) -> dict[str, str]:
    """The templates by name. They are read whole: licenses are few, and their texts are checked one by one."""
    if isinstance(templates, DataFrame):
        templates = {r.license: r.template for r in templates.select("license", F.col("template").cast("string")).collect()}
    templates = TEMPLATES if templates is None else templates
    if not templates or min(len(_shingles(t or "")) for t in templates.values()) == 0:
        raise ValueError("templates need at least one shingle each")
    return templates


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None
) -> DataFrame:
    """Rows (id, license, containment): every template that a text contains."""
    templates = _listed(templates)
    spark = docs.sparkSession
    rows = [(name, size_class(len(set(_shingles(t)))), t) for name, t in templates.items()]
    given = spark.createDataFrame(rows, "license string, size int, template string")
    known = given.select("license", "size", F.array_distinct(_shingle_texts(_words(F.col("template")))).alias("shingles"))
    banded = known.select("license", "size", F.posexplode(_bands(F.col("shingles"))).alias("band", "low"))

    by_size, shared = {}, set()
    for _, size, template in rows:
        by_size.setdefault(size, set()).update(needed_words(template))
        shared.update(needed_words(template, shared))
    text = F.col(text_col).cast("string")
    mayhold, every = text.isNotNull(), sorted(shared)
    if len(every) <= MOST_WORDS:
        # lower case is made once: bound to a name
        mayhold = F.exists(F.array(F.lower(text)), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in every]))
    slim = docs.where(mayhold).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("t"))

    def windows_of(size: int, own: set[str]) -> Column:
        """Windows of a size with a needed word: a shingle at p lies in windows 2 p / size and the two before."""
        at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(own)), i)), lambda i: i.isNotNull())
        first = at_least_zero(lambda i: F.floor((i - (SHINGLE - 1)) * 2 / size).cast("int") - 2)
        spans = F.transform(at, lambda i: F.sequence(first(i), F.floor(i * 2 / size).cast("int")))
        return F.transform(F.array_distinct(F.flatten(spans)), lambda k: F.struct(F.lit(size).alias("size"), k.alias("k")))

    def at_least_zero(f):
        return lambda i: F.greatest(F.lit(0), f(i))

    worded = slim.select("id", "key", _words(F.col("t")).alias("words"))
    placed = worded.select("id", "key", "words", F.flatten(F.array(*[windows_of(c, own) for c, own in sorted(by_size.items())])).alias("w"))
    shingled = placed.select("id", "key", _shingle_texts(F.col("words")).alias("s"), "w")
    # Arrays are made below an explode and read above it; explodes are outer ones, since for inner ones Spark
    # infers a filter, which has the arrays made again.
    exploded = shingled.select("id", "key", "s", F.explode_outer("w").alias("w")).where(F.col("w").isNotNull())
    each = exploded.select("id", "key", "w.size", "w.k", _window(F.col("s"), F.col("w.size"), F.col("w.k")).alias("s"))
    probes = each.select("id", "key", "size", "k", F.posexplode_outer(_bands(F.col("s"))).alias("band", "low")).where(F.col("low").isNotNull())
    few = BANDS * len(rows) <= SENT_BANDS
    met = probes.join(F.broadcast(banded) if few else banded, ["size", "band", "low"]).select("id", "key", "size", "k", "license").distinct()
    asked = met.groupBy("id", "key").agg(F.collect_list(F.struct("license", "size", "k")).alias("asked"))

    again = slim.select(F.col("id").alias("i"), F.col("key").alias("h"), "t")
    back = again.join(asked, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")))
    told = back.select("id", _words(F.col("t")).alias("words"), "asked").select("id", _shingle_texts(F.col("words")).alias("s"), "asked")
    windows = told.select("id", "s", F.explode("asked").alias("a")).select("id", "a.license", _window(F.col("s"), F.col("a.size"), F.col("a.k")).alias("s"))
    held = F.size(F.array_intersect("s", "shingles")) / F.size("shingles")
    verified = windows.join(F.broadcast(known) if few else known, "license").select("id", "license", held.alias("containment"))
    return verified.where(F.col("containment") >= CONTAINED).groupBy("id", "license").agg(F.round(F.max("containment"), 6).alias("containment"))


def oracle_sql(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for the rows of a scan of ``documents``: every window against every template."""
    templates = TEMPLATES if templates is None else templates
    rows = ", ".join(
        f"('{name}', {size_class(len(s))}, {len(s)}, '{x}')"
        for name, t in templates.items()
        for s in [sorted(set(_shingles(t)))]
        for x in s
    )
    join = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))
    return f"""
WITH template(license, size, n, shingle) AS (VALUES {rows}),
worded AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS i FROM worded WHERE len(w) >= {SHINGLE}),
shingled AS (SELECT doc_id, i - 1 AS p, {join} AS shingle FROM placed),
hits AS (SELECT doc_id, p, license, size, n, shingle FROM shingled JOIN template USING (shingle)),
windowed AS (
  SELECT doc_id, license, n, shingle, p * 2 // size - unnest([0, 1, 2]) AS k FROM hits
),
held AS (
  SELECT doc_id, license, k, CAST(count(DISTINCT shingle) AS DOUBLE) / any_value(n) AS c
  FROM windowed WHERE k >= 0 GROUP BY doc_id, license, k
)
SELECT doc_id, license, round(max(c), 6) AS containment FROM held WHERE c >= {CONTAINED} GROUP BY doc_id, license
"""
