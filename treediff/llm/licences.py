"""Licence notices in texts, by Dice coefficient over word bigrams; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.common import column, read, stash
from treediff.llm.quality import let

THRESHOLD = 0.8
#: Bytes of all templates at most: they are broadcast, which is checked before anything else runs. The notices here take 8 KB.
BROADCAST_BYTES = 4 << 20
#: Notices as their licences word them.
NOTICES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), "")


def bigrams(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))


def numbered(g: Column) -> Column:
    """The sorted bigrams, each with how often it has come: the intersection of two such arrays is that of the bags."""
    return let(F.sort_array(g), lambda xs: F.transform(xs, lambda x, i: F.concat_ws("#", x, (i + 2 - F.array_position(xs, x)).cast("string"))))


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(v).alias("text")) for k, v in NOTICES.items()])
    return spark.range(1).select(F.inline(rows))


def size_class(n: Column) -> Column:
    """Classes of sizes, each half as large again as the one before."""
    return F.floor(F.log(n.cast("double")) / math.log(1.5)).cast("int")


def by_size(templates: DataFrame, threshold: float) -> DataFrame:
    """For each class of sizes, the templates that a text of such a number of bigrams may match, with their bounds low and high.

    A Dice coefficient of t needs min / max >= t / (2 - t) of the two sizes, so
    a template is in a few classes, however long it is.
    """
    t = with_bounds(templates, threshold)
    rows = t.select(F.explode(F.sequence(size_class(F.col("low")), size_class(F.col("high")))).alias("class"), F.struct("licence", "g", "bag", "b", "low", "high").alias("t"))
    return rows.groupBy("class").agg(F.sort_array(F.collect_list("t")).alias("ts"))


def with_bounds(templates: DataFrame, threshold: float) -> DataFrame:
    """Templates of two words or more: bigrams g, as a bag, how many (b), and how many a text must and may have (low, high)."""
    t = templates.where("licence is not null").withColumn("w", normal_words(F.coalesce("text", F.lit("")))).where(F.size("w") >= 2)
    t = t.withColumn("g", bigrams(F.col("w"))).withColumn("bag", numbered(F.col("g"))).withColumn("b", F.size("g"))
    t = t.withColumn("low", F.greatest(F.ceil(F.col("b") * (threshold / (2 - threshold)) - 1e-9).cast("int"), F.lit(1)))
    return t.withColumn("high", F.floor(F.col("b") * ((2 - threshold) / threshold) + 1e-9).cast("int"))


def in_one_row(templates: DataFrame, threshold: float) -> DataFrame:
    """All templates that have bigrams, and all their words.

    A window that matches shares `low` of a template's b bigrams at least. So it
    has one of any b - low + 1 of them, the anchors: those with the longest words.
    And as words that are absent spoil at least as many bigrams, it has `need` of
    the template's distinct words: all but b - low.
    """
    t = with_bounds(templates, threshold)
    longest = lambda g: F.array_max(F.transform(F.split(g, " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    by_length = F.sort_array(F.transform("g", lambda g: F.struct(longest(g).alias("l"), g.alias("g"))), asc=False)
    t = t.withColumn("a", F.slice(by_length, F.lit(1), F.col("b") - F.col("low") + 1))
    t = t.withColumn("words", F.array_distinct("w")).withColumn("need", F.greatest(F.size("words") - F.col("b") + F.col("low"), F.lit(1)))
    t = t.select(F.struct("licence", "g", "bag", "b", "low", "high", F.col("a.g").alias("anchors"), "words", "need").alias("t"), "words", "need")
    return t.agg(F.sort_array(F.collect_list("t")).alias("ts"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("all_words"), F.min("need").alias("least"))


def apart(found: Column) -> Column:
    """Windows in turn, without those that share a word with one before."""
    meets = lambda x, y: (x["s"] <= y["e"] + 1) & (y["s"] <= x["e"] + 1)
    none = F.slice(found, 1, 0)
    return F.aggregate(found, none, lambda have, x: F.when(F.exists(have, lambda y: meets(x, y)), have).otherwise(F.concat(have, F.array(x))))


def windows_of(g: Column, t: Column, threshold: float) -> Column:
    """Windows of the bigrams g that match t, none overlapping: the best of each start, best first.

    A best window starts and ends with a bigram of t, so only such hits are tried. A hit
    counts in a window unless the window has as many earlier ones of its kind as t has.
    """

    def found(h: Column, back: Column) -> Column:
        at = lambda k: F.element_at(h, k)

        def best(x: Column) -> Column:
            def step(acc: Column, y: Column) -> Column:
                def judge(n: Column) -> Column:
                    d = 2.0 * n / (at(y) - at(x) + 1 + t["b"])
                    return let(d, lambda d: F.when(d > acc["d"], state(n, d, n, at(y))).otherwise(state(n, acc["d"], acc["shared"], acc["e"])))

                return let(acc["n"] + (F.element_at(back, y) < x).cast("int"), judge)

            state = lambda n, d, shared, e: F.struct(n.alias("n"), d.alias("d"), shared.alias("shared"), e.alias("e"))
            zero = F.lit(0)
            last = F.least(F.size(h), x + t["high"] - 1)
            return F.aggregate(F.sequence(x, last), state(zero, F.lit(0.0), zero, zero), step)

        near = F.filter(F.sequence(F.lit(1), F.size(h) - t["low"] + 1), lambda x: at(x + t["low"] - 1) - at(x) < t["high"])
        each = F.transform(near, lambda x: let(best(x), lambda b: F.struct((-b["d"]).alias("d"), at(x).alias("s"), b["e"].alias("e"), (-b["shared"]).alias("shared"), t["licence"].alias("licence"))))
        return let(F.sort_array(F.filter(each, lambda x: x["d"] <= -threshold)), apart)

    def kinds(h: Column) -> Column:
        """Of each hit, the one that must lie before the window for it to count; 0 for none."""

        def before(i: Column, k: Column) -> Column:
            x = F.element_at(g, i)
            cap = F.size(F.filter(t["g"], lambda y: y == x))
            same = F.filter(F.sequence(F.lit(1), k + 1), lambda j: F.element_at(g, F.element_at(h, j)) == x)  # itself too
            return let(same, lambda q: let(cap, lambda c: F.when(F.size(q) > c, F.element_at(q, F.size(q) - c)).otherwise(0)))

        return F.transform(h, before)

    hits = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains(t["g"], F.element_at(g, i)))
    none = F.array().cast("array<struct<d:double,s:int,e:int,shared:int,licence:string>>")
    return let(hits, lambda h: F.when(F.size(h) >= t["low"], let(kinds(h), lambda back: found(h, back))).otherwise(none))


def candidates(docs: DataFrame, one: DataFrame) -> DataFrame:
    """doc_id, text and hits (words that some template has) of the texts that have enough distinct words of a template for any unit or window to match it."""
    hits = F.array_intersect(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), F.col("all_words"))
    words = F.transform("ts", lambda t: F.struct(t["words"].alias("words"), t["need"].alias("need"))).alias("ts")
    near = docs.join(F.broadcast(one.select(words, "all_words", "least"))).select("doc_id", "text", hits.alias("hits"), "ts", "least")
    near = near.where((F.size("hits") >= F.col("least")) & F.exists("ts", lambda t: F.size(F.array_intersect(t["words"], F.col("hits"))) >= t["need"]))
    return stash(near.select("doc_id", "text", "hits"), "licence-candidates")


def scan_windows(docs: DataFrame, one: DataFrame, threshold: float) -> DataFrame:
    """doc_id, line (of the first word), licence, dice: windows of consecutive words, across lines, that match a template.

    docs: what `candidates` gives; one: all templates. Windows don't overlap: those that share the most bigrams come first. Those
    inside a line or text that itself matches are left out, as that has its row.
    """

    def matches(w: Column, ts: Column) -> Column:
        alike = lambda t: let(let(bigrams(w), numbered), lambda bag: 2.0 * F.size(F.array_intersect(t["bag"], bag)) / (t["b"] + F.size(bag))) >= threshold
        return F.exists(F.filter(ts, lambda t: (F.size(w) > t["low"]) & (F.size(w) <= t["high"] + 1)), alike)

    def rows(lines: Column, w: Column, g: Column, ts: Column) -> Column:
        near = F.filter(F.filter(ts, lambda t: F.size(F.array_intersect(t["words"], F.col("hits"))) >= t["need"]), lambda t: F.arrays_overlap(t["anchors"], g))
        found = F.flatten(F.transform(near, lambda t: windows_of(g, t, threshold)))
        ranked = F.sort_array(F.transform(found, lambda x: F.struct(x["shared"].alias("shared"), x["d"].alias("d"), x["licence"].alias("licence"), x["s"].alias("s"), x["e"].alias("e"))))

        def place(picked: Column) -> Column:
            of = F.flatten(F.transform(lines, lambda ws, i: F.array_repeat(i, F.size(ws))))
            put = let(of, lambda of: F.transform(picked, lambda x: F.struct(F.element_at(of, x["s"]).alias("line"), F.element_at(of, x["e"] + 1).alias("last"), x["licence"].alias("licence"), (-x["d"]).alias("dice"))))
            outside = lambda x: (x["line"] != x["last"]) | ~matches(F.element_at(lines, x["line"] + 1), ts)
            return F.when((F.size(picked) > 0) & ~((F.size(lines) > 1) & matches(w, ts)), F.filter(put, outside))

        return let(let(ranked, apart), place)

    near = docs.join(F.broadcast(one.select("ts")))
    lines = F.transform(F.split("text", "\n", -1), lambda x: normal_words(x))
    all_of = let(lines, lambda ls: let(F.flatten(ls), lambda w: F.when(F.size(w) >= 2, let(bigrams(w), lambda g: rows(ls, w, g, F.col("ts"))))))
    return near.select("doc_id", F.explode(all_of).alias("x")).select("doc_id", "x.line", "x.licence", "x.dice")


def scan(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 0; -1: the whole text), licence, dice: the best template of each unit with dice >= threshold.

    Units are a text's lines and, where it has several, the text itself; then
    windows of words within or across lines (scan_windows). Bags of bigrams are
    compared; ties go to the licence whose name comes first. Units
    of fewer than two words (null and empty texts too) match nothing. Repeated
    rows give repeated rows; an empty table gives none; extra columns aren't
    read. Texts that lack the words that every match with some template needs are
    left out first; the rest, usually few, are written once and read for units
    and for windows. Only the templates are joined: texts aren't shuffled, and
    texts of any length are scanned whole. ValueError, before anything is read of
    docs, for templates of more than BROADCAST_BYTES.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    low, high, n = with_bounds(templates, threshold).agg(F.min("low"), F.max("high"), F.sum(F.octet_length("text"))).first()
    if (n or 0) > BROADCAST_BYTES:
        raise ValueError(f"templates of {n} bytes, at most {BROADCAST_BYTES} can be searched for")
    sizes = F.broadcast(by_size(templates, threshold))
    fits = lambda w: (F.size(w) > (low or 0)) & (F.size(w) <= (high or 0) + 1)
    one = in_one_row(templates, threshold)
    near = candidates(docs.select(column(docs, key).alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("text")), one)
    body = near.select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: normal_words(x)).alias("lines"))

    def units(ls: Column) -> Column:
        total = F.aggregate(ls, F.lit(0), lambda n, x: n + F.size(x))
        each = F.filter(F.transform(ls, lambda w, i: F.struct(i.alias("line"), w.alias("w"))), lambda u: fits(u["w"]))
        whole = F.when((F.size(ls) > 1) & (total > (low or 0)) & (total <= (high or 0) + 1), F.array(F.struct(F.lit(-1).alias("line"), F.flatten(ls).alias("w"))))
        return F.concat(each, F.coalesce(whole, F.array().cast("array<struct<line:int,w:array<string>>>")))

    u = body.select("doc_id", F.explode(let(F.col("lines"), units)).alias("u")).select("doc_id", "u.line", F.col("u.w").alias("w"))
    u = u.withColumn("g", bigrams(F.col("w"))).withColumn("a", F.size("g")).drop("w")
    u = u.join(sizes, size_class(F.col("a")) == F.col("class")).drop("class")
    u = u.withColumn("ts", F.filter("ts", lambda t: (F.col("a") >= t["low"]) & (F.col("a") <= t["high"]) & F.arrays_overlap(t["g"], F.col("g")))).where(F.size("ts") > 0)
    u = u.withColumn("bag", numbered(F.col("g")))
    dice = lambda t: 2.0 * F.size(F.array_intersect(t["bag"], F.col("bag"))) / (t["b"] + F.col("a"))
    u = u.withColumn("found", F.filter(F.transform("ts", lambda t: F.struct((-dice(t)).alias("d"), t["licence"].alias("licence"))), lambda x: x["d"] <= -threshold)).where(F.size("found") > 0)
    u = u.select("doc_id", "line", F.array_min("found").alias("m")).select("doc_id", "line", "m.licence", (-F.col("m.d")).alias("dice"))
    return u.unionByName(scan_windows(near, one, threshold))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
WITH t0 AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in NOTICES.items())}) v(licence, text)),
t AS (SELECT licence, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM t0),
tg AS (SELECT licence, len(w) - 1 AS b, w[i] || ' ' || w[i + 1] AS g, count(*) AS c FROM (SELECT licence, w, unnest(range(1, len(w))) AS i FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS u, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, text FROM documents),
l AS (SELECT u, doc_id, unnest(range(len(lines)))::INT AS line, unnest(lines) AS x FROM d UNION ALL SELECT u, doc_id, -1, text FROM d WHERE len(lines) > 1),
n AS (SELECT u, doc_id, line, list_filter(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM l),
f AS (SELECT * FROM n WHERE len(w) >= 2 AND len(w) - 1 <= (SELECT max(len(w)) FROM t) * 1.5),
ug AS (SELECT u, doc_id, line, len(w) - 1 AS a, w[i] || ' ' || w[i + 1] AS g, count(*) AS c FROM (SELECT u, doc_id, line, w, unnest(range(1, len(w))) AS i FROM f) GROUP BY ALL),
s AS (SELECT u, doc_id, line, licence, 2.0::DOUBLE * sum(least(ug.c, tg.c))::DOUBLE / (any_value(a) + any_value(b))::DOUBLE AS dice FROM ug JOIN tg USING (g) GROUP BY u, doc_id, line, licence)
SELECT doc_id, line, licence, dice FROM s WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY u, line ORDER BY dice DESC, licence) = 1
"""
