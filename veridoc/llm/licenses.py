"""License scans against templates (operator 9), in DataFrame expressions only.

Texts and templates are cut in words (as in `decontaminate`) and hashed in shingles of five words. A text is cut
in windows of WINDOW shingles that overlap by half, and each window gives a code for each of BANDS bands: the
band and the least hash of the window's shingles in it (a band is one MinHash row). A template gives the codes of
its windows at every place, so a text window that lies in a copy of a template meets it in all bands, and one that
shares 0.6 of a template's window meets it in some band with probability 1 - 0.4 ** BANDS, over 0.999. Templates of
fewer than SHORT shingles may lie across windows; they are cut in windows of one shingle, whose MinHash it is.

The codes of all texts are joined by hash with those of the templates, so the cost hardly depends on the number
of templates; their codes are broadcast up to MOST_BROADCAST of them. The few pairs of text and template that meet
are verified by the exact share of the template's shingles that the whole text holds, CONTAINED at least. Equal
texts are verified once, by their 128-bit digest, which also leads the result back to the rows.

Defined results: null, empty and short texts have no licenses; repeated rows each get a result; names are in
order; extra columns are ignored; a template of fewer than five words is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, settle

SHINGLE, CONTAINED, BANDS, WINDOW, SHORT = 5, 0.8, 8, 8, 24
MOST_BROADCAST = 1_000_000  # codes, of 8 bytes and a name

# Phrases, notices and texts by which works are put under public licenses. Where notices differ in a
# few words only, the template is the phrase in which they do.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "agpl-3.0": "terms of the GNU Affero General Public License",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-notice": "Free Software Foundation; either version 2 of the License",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl": "terms of the GNU Lesser General Public License",
    "mit": "Released under the MIT License",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    others = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
    spaced = F.translate(lowered, others, " " * len(others))
    return F.array_remove(F.split(spaced, " "), "")


def shingles(hashed: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order, from the hashes of words."""
    n = F.size(hashed) - SHINGLE
    each = lambda i: F.xxhash64(*(F.get(hashed, i + j) for j in range(SHINGLE)))
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), each)).otherwise(F.array().cast("array<bigint>"))


def codes(run: Column, minima: Column) -> Column:
    """Of a text: its shingles, which are the windows of one, and the codes of its windows; minima: of `half_minima`."""
    last = lambda m: F.greatest(F.size(m) - 2, F.lit(0))
    # Beyond the last half get is null, which least passes over.
    windows = F.transform(minima, lambda m, band: F.transform(F.sequence(F.lit(0), last(m)), lambda i: F.xxhash64(band, F.least(F.get(m, i), F.get(m, i + 1)))))
    return F.concat(run, F.flatten(windows))


def half_minima(run: Column) -> Column:
    """For each band the least hashes of the halves of windows: a shingle is hashed once a band, as windows overlap by half."""
    half = WINDOW // 2
    halves = F.ceil(F.size(run) / half).cast("int")
    least = lambda band: F.transform(F.sequence(F.lit(0), halves - 1), lambda i: F.array_min(F.transform(F.slice(run, i * half + 1, half), lambda h: F.xxhash64(h, F.lit(band)))))
    return F.array(*(least(band) for band in range(BANDS)))


def template_codes(run: Column) -> Column:
    """Of a template: its shingles if they are few, else the codes of its windows at every place."""
    starts = F.sequence(F.lit(1), F.size(run) - WINDOW + 1)
    window = lambda band: lambda i: F.xxhash64(F.lit(band), F.array_min(F.transform(F.slice(run, i, WINDOW), lambda h: F.xxhash64(h, F.lit(band)))))
    windows = F.flatten(F.array(*(F.transform(starts, window(band)) for band in range(BANDS))))
    return F.array_distinct(F.when(F.size(run) < SHORT, run).otherwise(windows))


def prepare_templates(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """(name, run, shingles): the shingles in order, and the distinct ones. Settled. templates: name to text, or (name, text)."""
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame(sorted(templates.items()), "name string, text string")
    run = shingles(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    rows = settle(rows.select("name", run.alias("run")).withColumn("shingles", F.array_distinct("run")), "templates")
    short = [r["name"] for r in rows.where("size(run) = 0").select("name").limit(5).collect()]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words can't be found: {', '.join(map(str, short))}")
    return rows


def _fixed(rows: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """(key, name), computed once a row: a generator keeps projections apart, which would else put the
    expression itself in place of each of its uses, also inside of lambdas."""
    return rows.select(F.col(key), F.explode(F.array(value)).alias(name))


def _runs(texts: DataFrame) -> DataFrame:
    """(same, run) of (same, text), without texts that have no shingle."""
    hashed = _fixed(texts, "same", "words", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return _fixed(hashed.where(F.size("words") >= SHINGLE), "same", "run", shingles(F.col("words")))


def find_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, licenses array<struct<name,contained>>) of every row."""
    known = prepare_templates(docs.sparkSession, TEMPLATES if templates is None else templates)
    listed = known.select("name", F.explode(template_codes(F.col("run"))).alias("code"))
    small = listed.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    texts = docs.select(F.md5(text).alias("same"), F.col(text).alias("text"))
    signed = _runs(texts).select("same", "run", F.explode(F.array(half_minima(F.col("run")))).alias("minima"))
    asked = signed.select("same", F.explode(codes(F.col("run"), F.col("minima"))).alias("code"))
    met = settle(asked.join(F.broadcast(listed) if small else listed, "code").select("same", "name").distinct(), "met")

    # Texts that met a template, each once.
    few = texts.join(met.select("same"), "same", "left_semi").groupBy("same").agg(F.first("text").alias("text"))
    held = F.size(F.array_intersect("shingles", "run")) / F.size("shingles")
    pairs = _runs(few).join(met, "same").join(known.select("name", "shingles"), "name").select("same", "name", held.alias("contained"))
    found = pairs.where(F.col("contained") >= CONTAINED).groupBy("same").agg(F.array_sort(F.collect_list(F.struct("name", "contained"))).alias("licenses"))
    found = settle(found, "licenses")
    none = F.array().cast("array<struct<name:string,contained:double>>")
    return docs.select(F.col(key), F.md5(text).alias("__same")).join(found.withColumnRenamed("same", "__same"), "__same", "left").select(key, F.coalesce("licenses", none).alias("licenses"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(read_table(spark, sf_dir, "documents"))
    names = F.transform("licenses", lambda x: x["name"])
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(names), ",").alias("licenses"))


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    cut = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)))"
    return f"""
WITH t AS (SELECT name, {runs} AS s FROM (SELECT name, {cut} AS w FROM (VALUES {rows}) v(name, text))),
d AS (SELECT doc_id, {runs} AS s FROM (SELECT doc_id, {cut} AS w FROM documents)),
runs AS (SELECT doc_id, unnest(s) AS x FROM d),
held AS (SELECT doc_id, name, count(*) AS n FROM runs JOIN (SELECT name, unnest(s) AS x FROM t) USING (x) GROUP BY ALL),
good AS (SELECT doc_id, name FROM held JOIN t USING (name) WHERE n >= {CONTAINED} * len(s))
SELECT doc_id, count(name)::BIGINT AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses
FROM d LEFT JOIN good USING (doc_id) GROUP BY doc_id
"""


SQL = _sql()
