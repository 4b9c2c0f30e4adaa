"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Texts with a cue word are compared with every template in three ways: by their lines and sentences, by their paragraphs with the lines
joined (paragraphs end at lines without letters or digits, so comment marks don't matter), and by all paragraphs that hold a
cue taken together. Terms are lower-case alphanumeric runs, weighted by their count and by ln((1 + T) / (1 + df)) + 1 over the T templates (terms of
no template have df 0), and the cosine of the sparse vectors must reach COSINE. A file's own license is its best passage's; Proprietary
counts only where nothing else matches. A file is a licence file if its first paragraph matches a TITLE, or if FILE_SHARE of
its words lie in matched passages: it holds for its directory and all below, unless a nearer directory has its own.

Templates are fixed, so their vectors are the only side that is broadcast. Directories are reduced to distinct ones before
they are joined with their ancestors.

Cases: null and empty texts have no license of their own and may inherit one; null paths lie in no directory; equal scores
go to the template first by name, several licence files of a directory to the best score and then the first name; rows that
repeat a path are judged one by one; an empty table gives no rows. Files of any length are read whole; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table, word_count

COSINE = 0.6
FILE_SHARE = 0.5

# Notices and licence texts as files carry them. A license may have several.
_AS_IS_MIT = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so, subject to the following conditions:"
)
_MIT = f"Copyright (c) {_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS_MIT}"
_BSD_2 = (
    "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_AS_IS_ISC = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_GRANT = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
_APACHE_TERMS = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
    "or implied. See the License for the specific language governing permissions and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def _fsf(what: str, name: str, version: str) -> list[str]:
    later = f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    return [later, f"{what} is free software; you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the Free Software Foundation."]


TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", *_fsf("This program", "GNU Affero General Public License", "3")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE_GRANT, _APACHE_TERMS, f"{_APACHE_GRANT} http://www.apache.org/licenses/LICENSE-2.0 {_APACHE_TERMS}"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.", _BSD_2 + _AS_IS_BSD],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", _BSD_2 + _BSD_3 + _AS_IS_BSD, _BSD_3],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *_fsf("This program", "GNU General Public License", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *_fsf("This program", "GNU General Public License", "3")],
    "ISC": [_ISC_GRANT, f"Copyright (c) {_ISC_GRANT} {_AS_IS_ISC}"],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", *_fsf("This library", "GNU Lesser General Public License", "2.1")],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", *_fsf("This library", "GNU Lesser General Public License", "3")],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", _MIT_GRANT, _MIT, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", _MPL],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", _UNLICENSE],
}
# The names that SPDX lines give, and the titles that licence texts start with.
SPDX = {
    "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC0-1.0": ["CC0-1.0"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"], "LGPL-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"], "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"], "Unlicense": ["Unlicense"],
}
TITLES = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "Unlicense": ["The Unlicense"],
}
CUE = r"(?i)licen[sc]e|copyright|rights reserved|public domain|permission|redistribut|warrant|creative commons|spdx|free software|\bcc[ 0-]|\bgpl|(?-i:\bMIT\b)"
#: What a text with a cue holds: these in lower case, or "MIT". Cheaper to look for than CUE, which then decides passage by passage.
HINTS = ("licen", "copyright", "rights reserved", "public domain", "permission", "redistribut", "warrant", "creative commons", "spdx", "free software", "cc ", "cc0", "cc-", "gpl")
PASSAGE = r"\n|(?<=[.!?])[\x20\x09-\x0D]+(?=\p{Lu})"
PARAGRAPH = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
TERM = "[a-z0-9]+"
LINES, PARAGRAPHS, TOGETHER = 0, 1, 2


def notices() -> list[tuple[str, bool, str]]:
    """(license, whether it is a title, text) of every template."""
    spdx = [(name, False, f"SPDX-License-Identifier: {x}") for name, ids in SPDX.items() for x in ids]
    titles = [(name, True, x) for name, texts in TITLES.items() for x in texts]
    return [(name, False, x) for name, texts in TEMPLATES.items() for x in texts] + spdx + titles


def template_vectors() -> tuple[list[tuple[str, bool, int, str, float]], dict[str, float], float]:
    """(license, title, notice, term, weight divided by the notice's norm), idf of the templates' terms, idf of other terms."""
    made = [(name, title, i, Counter(re.findall(TERM, text.lower()))) for i, (name, title, text) in enumerate(notices())]
    df = Counter(term for *_, terms in made for term in terms)
    idf = {t: math.log((1 + len(made)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, title, i, terms in made:
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in terms.items()))
        rows += [(name, title, i, t, c * idf[t] / norm) for t, c in sorted(terms.items())]
    return rows, idf, math.log(1 + len(made)) + 1


def passages(files: DataFrame) -> DataFrame:
    """key, at, kind, lead (it is the text's first paragraph) and passage: what holds a cue word."""
    text = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    hinted = F.exists(F.array(F.lower("text")), lambda t: reduce(or_, [t.contains(x) for x in HINTS])) | F.col("text").contains("MIT")
    cued = files.where(hinted).select("key", F.filter(F.split(text, PASSAGE), lambda x: x.rlike(CUE)).alias("lines"), F.transform(F.split(text, PARAGRAPH), lambda x, i: F.struct(x.alias("p"), (i == 0).alias("lead"))).alias("all"))
    cued = cued.withColumn("some", F.filter("all", lambda x: x["p"].rlike(CUE)))
    one = lambda kind, lead, x: F.struct(F.lit(kind).alias("kind"), lead.alias("lead"), x.alias("passage"))
    no = F.lit(False)
    together = F.when(F.size("some") > 1, F.array(one(TOGETHER, no, F.array_join(F.transform("some", lambda x: x["p"]), "\n")))).otherwise(F.array().cast("array<struct<kind:int,lead:boolean,passage:string>>"))
    every = F.concat(F.transform("lines", lambda x: one(LINES, no, x)), F.transform("some", lambda x: one(PARAGRAPHS, x["lead"], x["p"])), together)
    return cued.select("key", F.posexplode(every).alias("at", "x")).select("key", "at", "x.*")


def matches(files: DataFrame) -> DataFrame:
    """key, license, score, kind, words, titled: the best template of each matching passage."""
    rows, idf, other = template_vectors()
    spark = files.sparkSession
    vectors = F.broadcast(spark.createDataFrame(rows, "license string, title boolean, notice int, term string, weight double"))  # a few thousand fixed rows
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    # Counted before the terms are exploded, so once a passage.
    found = passages(files).withColumn("words", word_count(F.col("passage")))
    by = ["key", "at", "kind", "lead", "words"]
    terms = found.select(*by, F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(f"({TERM})"))).alias("term"))
    counts = stored(terms.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n")), "terms").join(known, "term", "left")
    counts = counts.withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    norms = counts.groupBy("key", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = counts.join(vectors, "term").groupBy(*by, "license", "title", "notice").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, ["key", "at"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= COSINE)
    best = scores.groupBy(*by).agg(F.max_by(F.struct("license", "score"), _order(F.col("license"), F.col("score"))).alias("b"), F.bool_or(F.col("title") & F.col("lead")).alias("titled"))
    return best.select("key", "kind", "words", "titled", "b.license", "b.score")


def _order(license_: Column, score: Column) -> Column:
    """What the best match has most of: 'Proprietary' only where nothing else matches, then score, then the first name."""
    return F.struct(license_ != "Proprietary", score, -_rank(license_))


def _rank(license_: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in sorted(TEMPLATES)]), license_)


def ancestors(path: Column) -> Column:
    """The directories of a path, the root "" first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scanned(files: DataFrame, *keep: str) -> DataFrame:
    """key, keep, license, score, how ('own', 'inherited' or 'none'), directory (of the licence file) for each row of files (key, path, text, keep).

    key identifies a row.
    """
    found = matches(files)
    inside = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("words"))), F.lit(0)) for k in (LINES, PARAGRAPHS, TOGETHER)]
    own = found.groupBy("key").agg(F.max_by(F.struct("license", "score"), F.struct("titled", _order(F.col("license"), F.col("score")))).alias("own"), F.greatest(*inside).alias("matched"), F.bool_or("titled").alias("titled"))
    own = stored(own, "licenses")
    parent = F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", ""))
    placed = files.select("key", *keep, parent.alias("directory"), word_count(F.col("text")).alias("words"))
    rows = stored(placed.join(own, "key", "left"), "placed")
    notices = rows.where((F.col("titled") | (F.col("matched") >= FILE_SHARE * F.col("words"))) & F.col("directory").isNotNull())
    held = notices.groupBy("directory").agg(F.max_by("own", _order(F.col("own.license"), F.col("own.score"))).alias("held")).withColumnRenamed("directory", "above")
    directories = rows.where("directory is not null").select("directory").distinct()
    up = directories.select("directory", F.explode(F.array_distinct(F.concat(ancestors(F.col("directory")), F.array(F.col("directory"))))).alias("above"))
    nearest = up.join(held, "above").groupBy("directory").agg(F.max_by(F.struct("held", "above"), F.length("above")).alias("near"))
    out = rows.join(nearest, "directory", "left")
    got = F.coalesce(F.col("own"), F.col("near.held"))
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    where = F.when(F.col("own").isNotNull(), F.col("directory")).otherwise(F.col("near.above"))
    return out.select("key", *keep, got["license"].alias("license"), got["score"].alias("score"), how.alias("how"), where.alias("directory"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document, as the file source/lang/doc_id, with its license."""
    docs = table(spark, sf_dir, "documents")
    # A row is known by its file and its place in it, which every scan finds again; doc_ids may repeat or be null.
    row = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return scanned(docs.select(row.alias("key"), "doc_id", path.alias("path"), "text"), "doc_id").drop("key")
