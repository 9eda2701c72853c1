"""Licence scans by sparse TF-IDF cosine and directory inheritance (operator 3), with DataFrame operations only."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import documents, stored

# Notices and whole texts by which licences are usually declared, in the order that ties follow.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("proprietary", "All rights reserved."),
)

TERM = r"[A-Za-z0-9]+([.+-][A-Za-z0-9]+)*"


def terms_of(text: str) -> Counter[str]:
    return Counter(m[0].lower() for m in re.finditer(TERM, text))


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower)


def _strong(vectors: list[dict[str, float]], idf: dict[str, float], least: float) -> list[str]:
    """Terms of which a text must have one to reach a cosine of `least` with any of these unit vectors.

    A cosine is at most the length of the vector's part that the text has. So of each vector, terms are taken
    from the rarest on until what is left is too short.
    """
    out = set()
    for vector in vectors:
        left = 1.0
        for term, part in sorted(vector.items(), key=lambda x: (-idf[x[0]], x[0])):
            if left < 0.999 * least * least:
                break
            out.add(term)
            left -= part * part
    return sorted(out)


def licence_blocks(docs: DataFrame, id_col: str, text_col: str, templates=TEMPLATES, least: float = 0.6) -> DataFrame:
    """(id, first, last, words, cosine, template): parts of texts whose best template has a cosine of `least`.

    A vector has tf * idf for each term: its count in the part, and ln((1 + n) / (1 + df)) + 1 with document
    frequencies over all docs; terms that no template has get the largest idf. Parts are sentences (a line feed ends
    one, as does a stop with white space after it), and blocks: neighbouring sentences at least half of whose distinct
    terms some template has, so that notices over many lines and whole licence texts meet their templates as a whole.
    Sentences and texts that cannot reach the cosine (see _strong) are not weighed; nothing else is left out. Only
    frequencies of the templates' terms reach the driver. Rows equal in id and text count once.
    """
    counts = [terms_of(text) for _, text in templates]
    known = sorted(set().union(*counts))
    vocabulary = F.array(*map(F.lit, known))
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.count()
    held = docs.select(F.explode(F.array_intersect(_terms(text), vocabulary)).alias("term"))
    df = {r.term: r["count"] for r in held.groupBy("term").count().collect()}  # as many rows as templates have terms
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in known}
    unknown = math.log(1 + n) + 1
    spark = docs.sparkSession
    weights = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    norms = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in own.items())) for own in counts]
    parts = [{t: c * idf[t] / norms[i] for t, c in own.items()} for i, own in enumerate(counts)]
    vectors = spark.createDataFrame([(i, t, x) for i, own in enumerate(parts) for t, x in sorted(own.items())], "template int, term string, part double")
    strong = F.array(*map(F.lit, _strong(parts, idf, least)))

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).where(F.arrays_overlap(_terms(F.col("text")), strong))
    lines = rows.select("id", "h", F.posexplode(F.split(F.regexp_replace("text", r"([.!?])[ \t]+", "$1\n"), "\n")).alias("line", "text")).select("id", "h", "line", _terms(F.col("text")).alias("terms"))
    met = F.size(F.array_intersect("terms", vocabulary))
    lines = lines.withColumns({"alone": F.arrays_overlap("terms", strong), "half": (met > 0) & (2 * met >= F.size(F.array_distinct("terms")))})
    lines = stored(lines.where("alone or half").dropDuplicates(["id", "h", "line"]))
    runs = lines.where("half").withColumn("block", F.col("line") - F.row_number().over(Window.partitionBy("id", "h").orderBy("line")))
    block = Window.partitionBy("id", "h", "block")
    runs = runs.withColumns({"first": F.min("line").over(block), "last": F.max("line").over(block)}).where("first < last").select("id", "h", "first", "last", "terms")
    units = runs.unionByName(lines.where("alone").select("id", "h", F.col("line").alias("first"), F.col("line").alias("last"), "terms"))
    terms = units.select("id", "h", "first", "last", F.explode("terms").alias("term"))
    keys = ["id", "h", "first", "last"]
    tf = terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    tf = tf.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))  # a row for each term of the templates
    size = tf.groupBy(*keys).agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.sum("tf").alias("words"))
    dots = tf.join(F.broadcast(vectors), "term").groupBy(*keys, "template").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    cosine = F.round(F.col("dot") / F.sqrt("square"), 6)
    on = [dots[k].eqNullSafe(size[k]) for k in keys]
    found = dots.join(size, on).select(*(dots[k] for k in keys), "words", F.struct(cosine.alias("cosine"), (-F.col("template")).alias("minus")).alias("best"))
    found = found.groupBy(*keys).agg(F.max("best").alias("best"), F.max("words").alias("words")).where(F.col("best.cosine") >= least)
    return found.select("id", "first", "last", "words", F.col("best.cosine").alias("cosine"), (-F.col("best.minus")).alias("template"))


def license_scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = 0.6, file_share: float = 0.2) -> DataFrame:
    """(id, directory, license, origin, cosine, from_directory) for every row of docs.

    path is the row's directory, its parts joined by "/". A document with licence blocks (see licence_blocks)
    declares the licence of the one with the highest cosine (of equals the first). If its largest block holds
    `file_share` of its words or more, it is a licence file and declares for its directory too; of several in
    one directory the one with the largest share counts, then the smallest id. All others inherit from their
    nearest directory upwards that has a licence file, or have none: origin is own, inherited or none.

    Inheritance joins each distinct directory's ancestors with the licence directories and keeps the deepest;
    documents join their own directory's answer.

    Edge cases: null and empty texts declare nothing; null parts of a path must be replaced before; rows that
    repeat an id share what any of them declares (repeated rows change nothing but document frequencies); a null id declares nothing for itself; an empty table gives
    no rows; other columns are left alone. Every line of every text is looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), path.alias("directory"), text.alias("text"))
    blocks = stored(licence_blocks(docs, id_col, text_col, templates, least))
    own = blocks.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("first")).alias("minus"), "last", (-F.col("template")).alias("t"))).alias("best"), F.max("words").alias("licence_words"))
    own = own.where("id is not null").select("id", F.col("best.cosine").alias("cosine"), (-F.col("best.t")).alias("template"), "licence_words")

    words = F.size(F.regexp_extract_all("text", F.lit(TERM), 0))
    files = rows.join(own, "id").withColumn("share", F.col("licence_words") / words).where(F.col("share") >= file_share)
    files = files.groupBy("directory").agg(F.max(F.struct(F.round("share", 9).alias("share"), (-F.col("id")).alias("minus"), "template")).alias("top"))
    files = files.select(F.col("directory").alias("from_directory"), F.col("top.template").alias("inherited"))

    parts = F.split("directory", "/")
    upwards = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    nearest = rows.select("directory").distinct().select("directory", upwards.alias("from_directory")).join(files, "from_directory")
    nearest = nearest.groupBy("directory").agg(F.max(F.struct(F.length("from_directory").alias("depth"), "from_directory", "inherited")).alias("near"))

    out = rows.select("id", "directory").join(own.select("id", "cosine", "template"), "id", "left").join(nearest, "directory", "left")
    names = F.array(*(F.lit(name) for name, _ in templates))
    mine = F.col("template").isNotNull()
    number = F.coalesce("template", "near.inherited")
    return out.select(
        F.col("id").alias(id_col), "directory", F.when(number.isNotNull(), F.element_at(names, (number + 1).cast("int"))).alias("license"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"), "cosine",
        F.when(~mine, F.col("near.from_directory")).alias("from_directory"),
    )


def document_directory() -> Column:
    """A directory for rows of `documents`: source, language, and a folder of a thousand ids."""
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("_")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir), document_directory())


def _template_rows() -> str:
    return ", ".join(f"({i}, '{name}', '{term}', {count})" for i, (name, text) in enumerate(TEMPLATES) for term, count in sorted(terms_of(text).items()))


OP3_SQL = f"""
WITH t(template, license, term, c) AS (VALUES {_template_rows()}),
d AS (SELECT doc_id, coalesce(text, '') AS text,
             concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), '_')) AS directory FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM d),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM p),
w AS (SELECT doc_id, nth, list_transform(regexp_extract_all(line, '{TERM}', 0), lambda x: lower(x)) AS terms FROM l),
e AS (SELECT doc_id, nth, unnest(terms) AS term FROM w),
n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM e WHERE term IN (SELECT term FROM t) GROUP BY term),
i AS (SELECT DISTINCT t.term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM t CROSS JOIN n LEFT JOIN f ON f.term = t.term),
tn AS (SELECT template, sqrt(sum(c * c * idf * idf)) AS size FROM t JOIN i USING (term) GROUP BY template),
k AS (SELECT doc_id, nth, 2 * count(DISTINCT i.term) >= count(DISTINCT e.term) AS half FROM e LEFT JOIN i ON i.term = e.term GROUP BY doc_id, nth HAVING count(DISTINCT i.term) > 0),
b AS (SELECT doc_id, nth, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS block FROM k WHERE half),
r AS (SELECT doc_id, nth, min(nth) OVER (PARTITION BY doc_id, block) AS lo, max(nth) OVER (PARTITION BY doc_id, block) AS hi FROM b),
un AS (SELECT doc_id, nth, lo, hi FROM r WHERE lo < hi UNION ALL SELECT doc_id, nth, nth, nth FROM k),
tf AS (SELECT un.doc_id, lo, hi, e.term, count(*) AS tf FROM un JOIN e ON e.doc_id = un.doc_id AND e.nth = un.nth GROUP BY un.doc_id, lo, hi, e.term),
v AS (SELECT doc_id, lo, hi, tf.term, tf, tf * coalesce(idf, ln(1 + n) + 1) AS x FROM tf CROSS JOIN n LEFT JOIN i ON i.term = tf.term),
z AS (SELECT doc_id, lo, hi, sum(x * x) AS square, sum(tf) AS words FROM v GROUP BY doc_id, lo, hi),
s AS (SELECT v.doc_id, v.lo, v.hi, t.template, t.license, any_value(words) AS words, round(sum(x * c * idf) / any_value(sqrt(square) * size), 6) AS cosine
      FROM v JOIN t ON t.term = v.term JOIN i ON i.term = v.term JOIN tn ON tn.template = t.template JOIN z ON z.doc_id = v.doc_id AND z.lo = v.lo AND z.hi = v.hi
      GROUP BY v.doc_id, v.lo, v.hi, t.template, t.license),
q AS (SELECT * FROM s WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, lo, hi ORDER BY cosine DESC, template) = 1),
o AS (SELECT doc_id, arg_max(license, (cosine, -lo, hi, -template)) AS license, max(cosine) AS cosine, max(words) AS words FROM q GROUP BY doc_id),
a AS (SELECT doc_id, sum(len(terms)) AS words FROM w GROUP BY doc_id),
lf AS (SELECT directory, license FROM o JOIN a USING (doc_id) JOIN d USING (doc_id) WHERE o.words / a.words >= 0.2
       QUALIFY row_number() OVER (PARTITION BY directory ORDER BY round(o.words / a.words, 9) DESC, doc_id) = 1),
nd AS (SELECT g.directory, lf.directory AS from_directory, license FROM (SELECT DISTINCT directory FROM d) g JOIN lf
       ON g.directory = lf.directory OR starts_with(g.directory, lf.directory || '/')
       QUALIFY row_number() OVER (PARTITION BY g.directory ORDER BY length(lf.directory) DESC) = 1)
SELECT d.doc_id, d.directory, coalesce(o.license, nd.license) AS license,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN nd.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       o.cosine, CASE WHEN o.license IS NULL THEN nd.from_directory END AS from_directory
FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN nd ON nd.directory = d.directory
"""
