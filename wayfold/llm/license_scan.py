"""License scans by MinHash bands over overlapping text windows, with Spark expressions only.

Templates fall into classes by their number of shingles (five words), up to L = 1, 2, 4, ... A text's windows for
a class have 2 L shingles and start every L / 2, so that some window has every run of L whole. A window that has
80 % of a template's shingles has a Jaccard similarity of at least 0.4 / 2.1 with it; other shares by the same rule.
There are as many bands of one row as make a pair at that similarity miss all of them with a probability of MISSED at
most: 48 at 80 %. Candidates are then verified by exact containment of the template's shingles, as words, in the window.

Only windows with an anchor word are hashed. A template's anchors are words such that more than a fifth of its
shingles have one: a text with 80 % of the shingles has at least one of them, so nothing is lost.

Words are runs of letters and digits of the lower-cased text. Shorter texts are one shingle. Null and empty texts
match nothing. Windows that match a template and overlap in the words they match are one occurrence; each has its
own row, so a notice that comes three times is found three times. Each row of the table is a document of its own,
whatever its id: null ids and repeated ids give rows like any others. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.llm.shared import whole

SHINGLE, LEAST, MISSED = 5, 0.8, 4e-5
#: Templates whose shingles (about 10 KB for a whole licence) are broadcast; of more they are joined by a shuffle.
BROADCAST_TEMPLATES = 2_000
FOUND = "doc_id, template, containment, shared, shingles, first_word, last_word"

#: Notices to look for.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "mit-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}


def words_of(text: str) -> list[str]:
    """Words of a template, as Spark takes them from a text."""
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(words: list[str], size: int = SHINGLE) -> list[str]:
    return sorted({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}) if words else []


def anchors_of(words: list[str], least: float = LEAST, size: int = SHINGLE) -> set[str]:
    """Words, the longest first, until more than 1 - least of the shingles have one of them."""
    shingles = [set(s.split(" ")) for s in shingles_of(words, size)]
    chosen: set[str] = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(not s & chosen for s in shingles) < least * len(shingles):
            break
        chosen.add(w)
    return chosen


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _shingles(words: Column, size: int = SHINGLE) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))


def bands_for(least: float) -> int:
    """Bands of one row that a window with `least` of a template's shingles, in 2 L, misses with a probability of MISSED at most."""
    if not 0 < least <= 1:
        raise ValueError("least is a share of a template's shingles, above 0 and at most 1")
    similarity = least / (5 - least)  # a template has more than L / 2
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-similarity)))


def _minima(shingles: Column, bands: int) -> Column:
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def lowest(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*[lowest(k) for k in range(bands)])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """A row for each template that has words: template, class, wanted (its shingles)."""
    parsed = {k: shingles_of(words_of(t)) for k, t in sorted(templates.items()) if words_of(t)}
    return spark.createDataFrame([(k, class_of(w), w) for k, w in parsed.items()], "template string, class int, wanted array<string>")


def class_of(shingles: list[str]) -> int:
    return 1 << (len(shingles) - 1).bit_length()


def scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """A row for each occurrence of a template: doc_id, template, containment, shared, shingles, first_word, last_word.

    Words are numbered from 0; first and last are those of the occurrence's matching shingles.
    """
    templates = TEMPLATES if templates is None else templates
    classes: dict[int, set[str]] = {}
    for w in map(words_of, templates.values()):
        if w:
            classes.setdefault(class_of(shingles_of(w)), set()).update(anchors_of(w, least))
    if not classes:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("shared"), F.lit(0).alias("shingles"), F.lit(0).cast("bigint").alias("first_word"), F.lit(0).cast("bigint").alias("last_word")).limit(0)
    # a template's shingles go to the tasks once, beside its bands
    n = bands_for(least)
    table = template_table(spark, templates)
    bands = table.select("template", "class", F.posexplode(_minima(F.col("wanted"), n)).alias("band", "low"))
    laid = lambda d: F.broadcast(d) if len(templates) <= BROADCAST_TEMPLATES else d.hint("merge")

    every = sorted(set().union(*classes.values()))
    body = whole(F.col(text))
    gated = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body.alias("text")).where(F.lower("text").rlike("|".join(map(re.escape, every)))).select("row", "doc_id", _words(F.col("text")).alias("words"))

    def windows(size: int, anchors: set[str]) -> Column:
        step = max(1, size // 2)
        known = F.array(*[F.lit(a) for a in sorted(anchors)])
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)), F.lit(step))
        made = F.transform(starts, lambda s: F.struct(F.lit(size).alias("class"), s.alias("start"), F.slice("words", s + 1, 2 * size + SHINGLE - 1).alias("words")))
        return F.filter(made, lambda w: F.arrays_overlap(w["words"], known))

    cut = gated.select("row", "doc_id", F.explode(F.flatten(F.array(*[windows(n, a) for n, a in sorted(classes.items())]))).alias("w")).select("row", "doc_id", "w.class", "w.start", "w.words")
    shingled = cut.withColumn("shingles", _shingles(F.col("words"))).drop("words")
    hashed = shingled.withColumn("minima", _minima(F.col("shingles"), n)).select("row", "doc_id", "class", "start", "shingles", F.posexplode("minima").alias("band", "low"))
    met = hashed.join(laid(bands), ["class", "band", "low"]).select("row", "doc_id", "start", "template", "shingles").join(laid(table.select("template", "wanted")), "template")
    shared = F.size(F.array_intersect("shingles", "wanted"))
    fits = met.withColumn("shared", shared).where(F.col("shared") >= least * F.size("wanted"))
    # A window meets a template in several bands; only one is placed.
    once = fits.groupBy("row", "template", "start").agg(F.first("doc_id").alias("doc_id"), F.first("shared").alias("shared"), F.first("shingles").alias("own"), F.first("wanted").alias("wanted"))
    places = F.filter(F.transform("own", lambda x, i: F.when(F.array_contains("wanted", x), i)), lambda i: i.isNotNull())
    placed = once.select("row", "doc_id", "template", "shared", F.size("wanted").alias("shingles"), (F.col("start") + F.array_min(places)).alias("first"), (F.col("start") + F.array_max(places) + SHINGLE - 1).alias("last"))
    order = W.partitionBy("row", "template").orderBy("first", "last")
    new = F.coalesce(F.col("first") > F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = placed.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("row", "template", "run").agg(F.first("doc_id").alias("doc_id"), F.max("shared").alias("shared"), F.max("shingles").alias("shingles"), F.min("first").cast("bigint").alias("first_word"), F.max("last").cast("bigint").alias("last_word"))
    return out.withColumn("containment", F.col("shared") / F.col("shingles")).select(*FOUND.split(", "))
