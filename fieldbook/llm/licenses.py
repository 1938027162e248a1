"""Licence scans: Dice coefficient over word bigrams between normalised text and licence templates.

Units are each line of a text and, where a text has several lines, the whole text. A unit is
normalised to lower-cased words (runs of letters, digits and bytes beyond ASCII; a dot between digits stays) and
becomes the set of its adjacent word pairs; so do the templates. Dice = 2 * common / (size + size).

Size bounds prune first: a Dice of t needs sizes within [t / (2 - t), (2 - t) / t] of each other, so
units outside every template's bounds are dropped before their bigrams are made, and a unit meets
only the templates whose bounds hold its size. Before that, units without any cue are passed
over: a match shares at least t / (2 - t) of a template's bigrams, so once so many of them hold a cue that
fewer are left, every matching unit contains one of the cues. The rest is an equi-join on bigrams and
a count.

Licences inside longer text, wrapped over lines or in the middle of one: a run of words that begins and ends with a
template's bigrams is a unit too, for templates of at least ``MIN_RUN`` bigrams; its size is its number of word
pairs. Only texts that hold t / (2 - t) of a template's bigrams anywhere can have one. Of
overlapping runs the best is given, with the line where it begins; a run that meets a line with a row of its own,
or a text that is the same licence as a whole, gives none.

Defined cases: null and empty texts have no units; a unit of one word has no bigram and matches
nothing; rows that repeat id and text give one result; equal scores go to the first licence
in code-point order. Only the id and the text of the input are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.llm.scratch import quoted, written

THRESHOLD = 0.8
#: templates are broadcast only up to this many bigrams
BROADCAST_BIGRAMS = 1_000_000
#: cues are drawn from templates of up to this many bigrams in all; beyond, units are pruned by size alone
CUE_BIGRAMS = 20_000
#: shorter templates (titles, SPDX lines) are found as lines alone, not inside them
MIN_RUN = 4

#: Notices by which texts declare a licence, written for this scan.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_NO = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_NO = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_SPDX = "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense"
#: Licence texts, usual headers, titles and SPDX lines; the SQL knows the notices alone.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_NO),
    ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_NO),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *[(lic, text.format(name, version)) for lic, name, version in (("AGPL-3.0", "Affero ", 3), ("GPL-2.0", "", 2), ("GPL-3.0", "", 3), ("LGPL-3.0", "Lesser ", 3)) for text in (_GNU, f"{_GNU} {_GNU_NO}")],
    *[(lic, title) for lic, title in (("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("MPL-2.0", "Mozilla Public License Version 2.0"))],
    *[(x.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {x}") for x in _SPDX.split()],
]
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:\.[0-9]+)*"


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD), F.lit(0))


def bigrams(words: Column) -> Column:
    """The distinct adjacent pairs of an array of words, empty for fewer than two."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda x, y: F.concat_ws(" ", x, y)))


def _once(column: Column) -> Column:
    """As a generator: the expression is computed once a row and not copied into later ones."""
    return F.explode(F.array(column))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, license, gram, size), a row for each bigram of each template."""
    rows = [(k, lic, text) for k, (lic, text) in enumerate(templates)]
    base = spark.createDataFrame(rows, "template int, license string, text string").select("template", "license", _once(bigrams(normal_words(F.col("text")))).alias("g"))
    return base.select("template", "license", F.explode("g").alias("gram"), F.size("g").alias("size"))


def cue_words(grams: dict[int, list[str]], threshold: float) -> list[str]:
    """Few strings of which every unit that matches a template holds at least one.

    They are beginnings of words, taken greedily by how far they bring all templates: a template is done once
    fewer bigrams are left without a cue than a match needs.
    """
    left = {(k, g) for k, mine in grams.items() for g in mine}
    need = {k: len(mine) * threshold / (2 - threshold) - 1e-9 for k, mine in grams.items()}
    holds: dict[str, set] = defaultdict(set)
    for k, g in left:
        for w in g.split(" "):
            holds[w[:7]].add((k, g))
            holds[w[:6]].add((k, g))
    # where a beginning stands inside a word, it covers that word too
    stems = [c for c in holds if len(c) >= 6]
    for k, g in left:
        for c in stems:
            if c in g:
                holds[c].add((k, g))
    count, cues = Counter(k for k, _ in left), []
    while todo := {k: count[k] - need[k] for k in count if count[k] >= need[k]}:
        gain = {c: sum(1 / (todo[k] + 1) for k, _ in mine if k in todo) for c, mine in holds.items()}
        # long beginnings first, as they are rare
        best = max(gain, key=lambda c: (gain[c] > 0, min(len(c), 6), gain[c], c))
        cues.append(best)
        gone = holds.pop(best) & left
        left -= gone
        for k, _ in gone:
            count[k] -= 1
        for mine in holds.values():
            mine -= gone
    return sorted(cues)


def has_cue(text: Column, cues: list[str]) -> Column:
    """Whether a lower-cased text contains any cue; true without cues."""
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in cues]) if cues else F.lit(True)


def scan_licenses(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license, dice): the best licence of every unit that reaches the threshold.

    line is the 0-based line, or -1 for the whole text.
    """
    stats = templates.select("template", "size").distinct().agg(F.min("size").alias("low"), F.max("size").alias("high"), F.sum("size").alias("all")).first()
    low, high = (stats.low or 1) * threshold / (2 - threshold), (stats.high or 0) * (2 - threshold) / threshold
    grams: dict[int, list[str]] = defaultdict(list)
    if 0 < (stats["all"] or 0) <= CUE_BIGRAMS:
        for row in templates.select("template", "gram").distinct().collect():
            grams[row.template].append(row.gram)
    cues = cue_words(grams, threshold)
    low_text = _once(F.lower(quoted(text_col))).alias("low")
    read = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("t"), low_text).where(F.col("t").isNotNull() & has_cue(F.col("low"), cues))
    # few texts hold a cue: they are written out, so that all texts are looked through once
    base = written(read.select("doc_id", F.xxhash64("t").alias("th"), "t"))
    # unit 0 is the whole text if it has several lines, unit k its line k - 1
    texts = F.concat(F.array(F.when(F.contains("t", F.lit("\n")), F.col("t"))), F.split("t", "\n"))
    # w words need at least 2w - 1 characters
    words = F.transform(texts, lambda u: F.when((F.length(u) >= 2 * low + 1) & has_cue(F.lower(u), cues), normal_words(u)))
    units = base.select("doc_id", "th", F.posexplode(words).alias("unit", "w")).where(F.size("w") > low)
    sets = units.select("doc_id", "th", (F.col("unit") - 1).alias("line"), _once(bigrams(F.col("w"))).alias("g")).where(F.size("g").between(low, high))
    pairs = sets.select("doc_id", "th", "line", F.size("g").alias("n"), F.explode("g").alias("gram"))
    if (stats["all"] or 0) <= BROADCAST_BIGRAMS:
        templates = F.broadcast(templates)
    met = pairs.join(templates, "gram").where((F.col("n") >= F.col("size") * threshold / (2 - threshold)) & (F.col("n") <= F.col("size") * (2 - threshold) / threshold))
    dice = F.lit(2.0) * F.count_distinct("gram") / (F.max("n") + F.max("size"))
    found = met.groupBy("doc_id", "th", "line", "template", "license").agg(dice.alias("dice")).where(F.col("dice") >= threshold)
    best = F.row_number().over(Window.partitionBy("doc_id", "th", "line").orderBy(F.desc("dice"), "license", "template"))
    rows = written(found.withColumn("k", best).where("k = 1").select("doc_id", "th", "line", "license", "dice"))
    return rows.drop("th").unionByName(_inner_runs(base, templates, rows, threshold))


def _inner_runs(base: DataFrame, templates: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, line, license, dice): the best runs of words inside texts (doc_id, th, t), apart from known rows."""
    share = threshold / (2 - threshold)
    need, most = F.ceil(F.col("size") * share - 1e-9).cast("int"), F.floor(F.col("size") / share + 1e-9).cast("int")
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda x, y: F.concat_ws(" ", x, y))
    grams = base.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", _once(normal_words(F.col("t"))).alias("w")).select("doc_id", "th", F.posexplode(pairs).alias("pos", "gram"))
    met = grams.join(templates.where(F.col("size") >= MIN_RUN), "gram")
    # a text's places of a template's bigrams, ascending, each with the place before of the same bigram
    before = F.lag("pos").over(Window.partitionBy("doc_id", "th", "template", "gram").orderBy("pos"))
    hits = met.withColumn("before", before).groupBy("doc_id", "th", "template", "license", "size").agg(F.array_sort(F.collect_list(F.struct("pos", "before"))).alias("x"), F.count_if(F.col("before").isNull()).alias("distinct"))
    hits = hits.where(F.col("distinct") >= need)
    # from each place that so many others follow closely enough, the best end
    starts = F.filter(F.sequence(F.lit(0), F.size("x") - need), lambda k: F.get("x", k + need - 1)["pos"] - F.get("x", k)["pos"] < most)

    def run(k: Column) -> Column:
        """A run's bigrams are counted as it grows: one is new unless it stood between the start and here before."""
        first = F.get("x", k)["pos"]
        zero = F.struct(F.lit(0).alias("common"), F.lit(0.0).alias("worse"), F.lit(0).alias("last"))

        def step(out: Column, e: Column) -> Column:
            common = out["common"] + F.when(e["before"].isNull() | (e["before"] < first), 1).otherwise(0)
            worse = F.lit(-2.0) * common / (e["pos"] - first + 1 + F.col("size"))
            better = (e["pos"] - first < most) & (worse < out["worse"])
            return F.struct(common.cast("int").alias("common"), F.when(better, worse).otherwise(out["worse"]).alias("worse"), F.when(better, e["pos"] + 1).otherwise(out["last"]).cast("int").alias("last"))

        r = F.aggregate(F.slice("x", k + 1, most), zero, step)
        return F.struct(first.alias("first"), r.alias("r"))

    runs = F.filter(F.transform(starts, run), lambda y: y["r"]["worse"] <= -threshold + 1e-12)
    found = hits.select("doc_id", "th", "template", "license", F.explode(runs).alias("y")).select("doc_id", "th", "template", "license", "y.first", "y.r")
    best = found.groupBy("doc_id", "th", "first").agg(F.min(F.struct("r.worse", "license", "template", "r.last")).alias("x"))
    order = F.array_sort(F.collect_list(F.struct("x.worse", "x.license", "x.template", "first", "x.last"))).alias("all")
    kept = F.aggregate(
        "all", F.slice("all", 1, 0), lambda out, x: F.when(F.exists(out, lambda y: (x["first"] <= y["last"]) & (y["first"] <= x["last"])), out).otherwise(F.concat(out, F.array(x)))
    )
    chosen = best.groupBy("doc_id", "th").agg(order).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), kept.alias("kept"))
    # the lines of a run: how many lines end before its first and its last word
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))
    texts = base.dropDuplicates(["doc_id", "th"]).join(chosen, same).drop("d", "h")
    counts = texts.select("doc_id", "th", "kept", _once(F.transform(F.split("t", "\n"), lambda u: F.size(normal_words(u)))).alias("words"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("line"))

    def line_of(place: Column) -> Column:
        return F.aggregate("words", zero, lambda out, c: F.struct((out["sum"] + c).alias("sum"), (out["line"] + F.when(out["sum"] + c <= place, 1).otherwise(0)).alias("line")), lambda out: out["line"])

    out = counts.select("doc_id", "th", "words", F.explode("kept").alias("x")).select("doc_id", "th", line_of(F.col("x.first")).alias("line"), line_of(F.col("x.last")).alias("line_end"), "x.license", (-F.col("x.worse")).alias("dice"))
    # runs that a line or the whole text already accounts for
    known = rows.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("line").alias("at"), F.col("license").alias("lic"))
    out = out.join(known, same & (F.col("at").between(F.col("line"), F.col("line_end")) | ((F.col("at") == -1) & (F.col("lic") == F.col("license")))), "left_anti")
    return out.groupBy("doc_id", "th", "line", "license").agg(F.max("dice").alias("dice")).drop("th")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """A row for each licence found in any document; null and empty texts give none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs, template_table(spark, TEMPLATES + TEXTS))


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({k}, {quote(lic)}, {quote(text)})" for k, (lic, text) in enumerate(TEMPLATES))


OP6_SQL = rf"""
WITH t AS (SELECT template, license, text FROM (VALUES {_values()}) AS v(template, license, text)),
u AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS u FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
x AS (
  SELECT doc_id, line, regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:\.[0-9]+)*') AS w FROM u),
y AS (SELECT template, license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:\.[0-9]+)*') AS w FROM t),
xg AS (SELECT DISTINCT doc_id, line, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, line, w, unnest(range(1, len(w))) AS i FROM x WHERE len(w) > 1)),
yg AS (SELECT DISTINCT template, license, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT template, license, w, unnest(range(1, len(w))) AS i FROM y)),
xn AS (SELECT doc_id, line, count(*) AS n FROM xg GROUP BY ALL),
yn AS (SELECT template, count(*) AS m FROM yg GROUP BY ALL),
c AS (SELECT doc_id, line, template, license, count(*) AS c FROM xg JOIN yg USING (gram) GROUP BY ALL),
s AS (SELECT doc_id, line, template, license, 2.0::DOUBLE * c / (n + m) AS dice FROM c JOIN xn USING (doc_id, line) JOIN yn USING (template)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license, template) AS k FROM s WHERE dice >= 0.8)
SELECT doc_id, CAST(line AS INTEGER) AS line, license, dice FROM r WHERE k = 1
"""
