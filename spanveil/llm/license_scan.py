"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance.

The header of a file is its lines that speak of licences or copyright; of a licence
file all lines count. Header terms are weighted by their frequency in the header
and their rarity among the headers of all files, templates by the same rarity, and
the template with the highest cosine gives the file's licence if it reaches the
threshold. A file without one takes that of the nearest directory above it (its
own first) with a licence file: each file's ancestor directories are joined with
the directories' licences and the deepest match stays. DataFrame functions only.

Defined cases: a null or empty text, or one without such lines, has no licence of
its own; a text of any length is read whole; a null path has no directory and
inherits nothing; of equal cosines the licence that sorts first wins; of several
licence files in a directory the licence that most of them have wins, then the
one that sorts first; repeated rows are decided each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.repeats import look_up
from spanveil.storage import cut

# Paragraphs of public licence texts.
_FREE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
_MIT_CONDITION = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
_MIT_LIABILITY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_CONDITIONS = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
# Statements by which licences are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Proprietary", "All rights reserved"),
    # whole licence texts and notices, for licence files
    ("MIT", _FREE + _MIT_CONDITION + _AS_IS + _MIT_LIABILITY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD + _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + _BSD_CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", _GPL.format("General", "3") + " See the GNU General Public License for more details."),
    ("GPL-2.0", _GPL.format("General", "2") + " See the GNU General Public License for more details."),
    ("LGPL-3.0", _GPL.format("Lesser General", "3") + " See the GNU Lesser General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
HEADER = r"(?i)licen[cs]e|copyright|all rights reserved|permission is hereby|redistribution and use"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.\-_][^/]*)?$"
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
THRESHOLD = 0.5
#: Directories with a licence above them that may be sent to every task; beyond, files are salted.
SMALL, SALTS = 20_000, 32


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def header_of(text: Column, whole: Column) -> Column:
    """The lines that count, joined by line feeds; empty if there are none."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.array_join(F.when(whole, lines).otherwise(F.filter(lines, lambda x: x.rlike(HEADER))), "\n")


def match_templates(headers: DataFrame) -> DataFrame:
    """(row, licence, score) of the best template of each (row, header, copies).

    A header that several files have is given once; ``copies`` is how many, and each
    of them counts in the frequencies of terms among files.
    """
    spark = headers.sparkSession
    counts = headers.select("row", "copies", F.explode(_terms(F.col("header"))).alias("term")).groupBy("row", "copies", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = cut(counts)
    files = counts.select("row", "copies").distinct().agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    idf = counts.groupBy("term").agg((F.log((F.lit(1.0) + files) / (F.sum("copies") + 1)) + 1).alias("idf"))
    weighed = counts.join(idf, "term").select("row", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighed.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(rows, "template int, licence string, text string")
    terms = templates.select("template", "licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    unseen = F.log(F.lit(1.0) + files) + 1
    terms = terms.join(idf, "term", "left").select("template", "licence", "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("tw"))
    terms = cut(terms)  # a row for each term of the templates: a fixed number
    lengths = terms.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("template_norm"))
    dots = weighed.join(F.broadcast(terms), "term").groupBy("row", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(F.broadcast(lengths), "template").join(norms, "row")
    scored = scored.select("row", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6).alias("score"))
    # the greatest score, then the smallest name
    best = scored.groupBy("row", "licence").agg(F.max("score").alias("score")).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("low"), "licence")).alias("b"))
    return best.select("row", "b.licence", (-F.col("b.low")).alias("score"))


def _ancestors(path: Column) -> Column:
    """Directories above a path, the deepest first; the root is the empty string."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts) - 1
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan_licences(files: DataFrame, id_col: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(id, path, licence, score, origin, licence_dir): origin is own, inherited or none."""
    is_file = F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False))
    rows = files.select(F.col(id_col).alias("_id"), F.col(path).alias("_path"), is_file.alias("is_file"), header_of(F.col(text), is_file).alias("header"))
    rows = cut(rows.withColumn("row", F.sha2("header", 256)))
    # a header may be that of a third of all files: it is matched once, and its files find it without meeting in one task
    some = rows.where("header <> ''")
    headers = cut(some.groupBy("row").agg(F.first("header").alias("header"), F.count(F.lit(1)).alias("copies")))
    found = match_templates(headers).where(F.col("score") >= THRESHOLD).join(headers.select("row", "copies"), "row")
    own = look_up(some.select("row", "_id", "_path", "is_file"), cut(found), "row", "copies", rows.count())
    nothing = rows.where("header = ''").select("_id", "_path", "is_file", F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("score"))
    own = cut(own.select("_id", "_path", "is_file", "licence", "score").unionByName(nothing))
    declared = own.where("is_file and licence is not null").select(F.element_at(_ancestors(F.col("_path")), 1).alias("dir"), "licence")
    ranked = declared.groupBy("dir", "licence").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("low"), "licence")).alias("b")).select("dir", F.col("b.licence").alias("dir_licence"))
    dirs = own.where("licence is null and _path is not null").select(F.element_at(_ancestors(F.col("_path")), 1).alias("own_dir")).distinct()
    above = dirs.select("own_dir", F.posexplode(F.filter(F.concat(F.array("own_dir"), _ancestors(F.col("own_dir"))), lambda x: x.isNotNull())).alias("up", "dir")).distinct()
    nearest = above.join(ranked, "dir").groupBy("own_dir").agg(F.min(F.struct("up", "dir", "dir_licence")).alias("b")).select("own_dir", "b.dir", "b.dir_licence")
    out = own.withColumn("own_dir", F.when(F.col("licence").isNull() & F.col("_path").isNotNull(), F.element_at(_ancestors(F.col("_path")), 1)))
    nearest = cut(nearest)
    if nearest.count() <= SMALL:
        out = out.join(F.broadcast(nearest), "own_dir", "left")
    else:  # a directory may hold a third of all files: its rows are salted
        spread = nearest.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        out = out.withColumn("_salt", F.pmod(F.xxhash64("_id", "_path"), F.lit(SALTS)).cast("int")).join(spread, ["own_dir", "_salt"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_path").alias(path),
        F.coalesce("licence", "dir_licence").alias("licence"),
        "score",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.col("dir").alias("licence_dir"),
    )
