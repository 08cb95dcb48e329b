"""License scans (operator 10) by diagonal voting, with DataFrame operations only.

All rolling word k-grams of a text are hashed and joined with the positions of the same hashes in license templates. A
match of text position i with template position j votes for the diagonal i - j: a copied passage puts its votes on one
diagonal, an insertion or deletion moves the rest to a neighbouring one. Votes are counted by diagonal. Each diagonal is
merged with those at most GAP away, as far as their matches continue it, before or behind it in text and template alike; so a
notice that stands many times is as many spans, and none grows beyond its template. A span counts when enough of the
template's grams stand in it. Hash matches are verified by the words. Phrases must stand whole on one diagonal.

The template table is a fixed list, so it is broadcast. Texts are read once and never shuffled: what leaves the scan is a
row for each text and one for each match. Cost is linear in a text's words and its matches.

Defined results: a null or empty text has no words; rows are told apart by their place, so repeated rows come back as often
as they occur; a template that stands several times counts at each place; an empty table gives an empty result; only
doc_id and text are read. Only A-Z are lower-cased.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import table, with_types

# Phrases that name a license, and the label of each.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Public license texts and notices, and the label of each.
TEMPLATES = (
    ("This work is licensed under the GNU General Public License version 3", "gpl-3.0"),
    ("GNU Lesser General Public License", "lgpl"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Released under the MIT License", "mit-notice"),
    ("All rights reserved", "all-rights-reserved"),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
        "gpl-text",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
        "apache-text",
    ),
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
        "mit-text",
    ),
    (
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit-warranty",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
        "bsd-text",
    ),
    (
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd-warranty",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
        "isc-text",
    ),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mpl-2.0",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        "zlib-text",
    ),
    (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
        "unlicense",
    ),
)

# Words that carry a sentence; a gram of nothing else is no sign of a template.
COMMON = ("a", "an", "and", "any", "are", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with")

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN, OTHER = "\u212a", "\u0138"  # the one sign beyond ASCII that lower() turns into a letter of A-Z, and another word character in its place
K, LEAST, GAP = 2, 0.75, 6


def words_of(text):
    """Words of a text. Beside A-Z lower() changes letters that no phrase or template has, and no word boundary."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER))), F.lit(WORDS), F.lit(0))


def _grams(k: int) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, exact, total, j, gram): the grams of all templates that count, by position."""
    out = []
    for n, (text, label, exact) in enumerate([(t, label, True) for t, label in PHRASES] + [(t, label, False) for t, label in TEMPLATES]):
        words = re.findall(WORDS, text.lower())
        at = [j for j in range(len(words) - k + 1) if exact or not set(words[j : j + k]) <= set(COMMON)]
        out += [(n, label, exact, len(at), j, " ".join(words[j : j + k])) for j in at]
    return out


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    x = spark.createDataFrame(_grams(k), "template int, label string, exact boolean, total int, j int, gram string")
    return x.withColumn("h", F.xxhash64("gram"))


def places(docs: DataFrame, k: int = K, least: float = LEAST, gap: int = GAP) -> DataFrame:
    """(row, doc_id, n_words, spans, good, found): for each row the spans (template, label, exact, first, last, coverage, best) of merged
    diagonals, those that count, and of these the best where several diagonals cross one place."""
    texts = with_types(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    grams = F.expr(f"transform(sequence(0, size(words) - {k}), i -> concat_ws(' ', {', '.join(f'get(words, i + {d})' for d in range(k))}))")
    each = texts.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("words") >= k, grams).alias("grams"))
    each = each.select("row", "doc_id", "n_words", F.posexplode_outer("grams").alias("i", "word_gram")).withColumn("h", F.xxhash64("word_gram"))
    true = F.col("word_gram") == F.col("gram")
    hits = each.join(F.broadcast(template_grams(docs.sparkSession, k)), "h", "left").where(F.coalesce(true, F.lit(False)) | F.coalesce("i", F.lit(0)).eqNullSafe(0))
    hits = hits.select("row", "doc_id", "n_words", *[F.when(true, F.col(c)).alias(c) for c in ("template", "label", "exact", "total", "i", "j")])
    by_row = hits.repartition("row")
    diagonals = by_row.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "total", (F.col("i") - F.col("j")).alias("d")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.sort_array(F.collect_set("j")).alias("js"))
    near = Window.partitionBy("row", "template").orderBy("d").rangeBetween(-gap, gap)
    x = diagonals.withColumn("near", F.when(~F.col("exact"), F.collect_list(F.struct("d", "js")).over(near)))
    hit = F.flatten(F.transform("near", lambda t: F.transform(t["js"], lambda j: F.struct((t["d"] + j).alias("i"), j.alias("j")))))
    before = lambda h: (h["i"] < F.col("first")) & (h["j"] < F.array_min("js"))
    behind = lambda h: (h["i"] > F.col("last")) & (h["j"] > F.array_max("js"))
    x = x.withColumn("more", F.coalesce(F.filter(hit, lambda h: before(h) | behind(h)), F.expr("cast(array() as array<struct<i: int, j: int>>)")))
    coverage = F.size(F.array_union("js", F.col("more.j"))) / F.col("total")
    first, last = F.array_min(F.concat(F.array("first"), F.col("more.i"))), F.array_max(F.concat(F.array("last"), F.col("more.i"))) + (k - 1)
    stronger = lambda t: (F.size(t["js"]) > F.size("js")) | (F.size(t["js"]) == F.size("js")) & (t["d"] < F.col("d"))
    beside = lambda t: (t["d"] + F.array_min(t["js"]) <= F.col("last")) & (t["d"] + F.array_max(t["js"]) >= F.col("first"))
    best = F.col("exact") | ~F.exists("near", lambda t: (t["d"] != F.col("d")) & stronger(t) & beside(t))
    span = F.struct("template", "label", "exact", first.alias("first"), last.alias("last"), coverage.alias("coverage"), best.alias("best"))
    merged = x.groupBy("row", "doc_id", "n_words").agg(F.collect_set(F.when(F.col("template").isNotNull(), span)).alias("spans"))
    good = merged.withColumn("good", F.filter("spans", lambda s: F.when(s["exact"], s["coverage"] == 1.0).otherwise(s["coverage"] >= least)))
    return good.withColumn("found", F.filter("good", lambda s: s["best"]))


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = places(table(spark, sf_dir, "documents"))
    base = x.withColumn("base", F.filter("found", lambda s: s["exact"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    return base.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["first"])).cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("good").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def _oracle(k: int = K, least: float = LEAST, gap: int = GAP) -> str:
    rows = [f"({n}, '{label}', {exact}, {total}, {j}, '{gram}')" for n, label, exact, total, j, gram in _grams(k)]
    gram = " || ' ' || ".join(["word", *[f"lead(word, {d}) OVER (PARTITION BY doc_id ORDER BY i)" for d in range(1, k)]])
    hits = "flatten(list_transform(near, lambda t: list_transform(t.js, lambda j: {'i': t.d + j, 'j': j})))"
    more = f"list_transform(list_filter({hits}, lambda h: (h.i < a AND h.j < list_min(js)) OR (h.i > z AND h.j > list_max(js))), lambda h: h.j)"
    return f"""WITH t(template, label, exact, total, j, gram) AS (VALUES {", ".join(rows)}),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr({ord(KELVIN)}), chr({ord(OTHER)}))), '{WORDS}') AS words FROM documents),
tok AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(0, len(words) - 1)) AS i FROM w WHERE len(words) > 0),
g AS (SELECT doc_id, i, {gram} AS gram FROM tok),
d AS (SELECT doc_id, template, label, exact, total, i - j AS d, min(i) AS a, max(i) AS z, list(DISTINCT j) AS js FROM g JOIN t USING (gram) GROUP BY 1, 2, 3, 4, 5, 6),
n AS (SELECT *, list({{'d': d, 'js': js}}) OVER (PARTITION BY doc_id, template ORDER BY d RANGE BETWEEN {gap} PRECEDING AND {gap} FOLLOWING) AS near FROM d),
m AS (SELECT doc_id, label, exact, a, CASE WHEN exact THEN len(js) ELSE len(list_distinct(list_concat(js, {more}))) END::DOUBLE / total AS coverage FROM n),
s AS (SELECT *, CASE WHEN exact THEN coverage = 1 ELSE coverage >= {least} END AS good FROM m),
f AS (SELECT doc_id, count(*) FILTER (good AND exact) AS n_base, min(a) FILTER (good AND exact) AS first_word, max(a) FILTER (good AND exact) AS last_word,
string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good AND exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good) AS labels, max(coverage) AS score FROM s GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN f ON w.doc_id = f.doc_id"""


ORACLE_SQL = {"op10_license_diagonals": _oracle()}
