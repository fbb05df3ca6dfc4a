"""License notices inside documents, by MinHash bands over overlapping windows of words.

Templates fall into classes of like length. A class with templates of up to L words cuts every
document into windows of L + s - 1 words, one each s words (s is a quarter of L, 1 at least), so
that any L words in a row lie whole in some window. A window's shingles (five words in a row, or all
words of a shorter template) have a least Jaccard similarity J with a template that they contain to ``containment``; the number of
bands of one MinHash value each is the least for which a pair of similarity J meets in a band with
a probability of ``certainty`` or more. Windows and templates that meet are verified by the exact
share of the template's shingles that the window holds.

A band can only be shared by way of a shared shingle. So windows in which no shingle of the class's
templates stands are skipped before any MinHash is taken, which loses nothing; what is known of
the templates is a fixed number of literals in the plan. Everything is DataFrame functions: one
scan, a join with the templates' bands (some hundreds of rows), and an aggregate by document and
license that is partial on the map side.

Words are runs of a-z and 0-9 in the lower-case text. A template of fewer than five words has one
shingle, so it is found where its words stand in a row.

Defined results: null and empty texts have no notice; a null id is one document; rows that repeat
an id are taken together, one result per id and license; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("CC-BY-NC-SA-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]

#: Notices of fewer than five words. The first also stands in copyright lines of public licenses, so it has a name of its own.
SHORT_TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
]

#: Words that stand in most texts, which make poor anchors.
EVERYDAY = {"a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may", "no", "not", "of", "on", "or", "that", "the", "these", "this", "to", "use", "was", "with", "you"}

#: Lengths in words up to which templates share a class; templates of one shingle are a class of their own.
CLASSES = (5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 80, 96, 128, 160, 192, 256, 384, 512, 768, 1024)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, even where ``then`` uses it inside lambdas."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words; none of fewer words."""
    last = F.size(words) - size + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(size))))


def window_shape(length: int) -> tuple[int, int]:
    """Words of a window, and from one window to the next, for templates of up to ``length`` words."""
    step = max(1, length // 4)
    return length + step - 1, step


def bands_needed(length: int, shortest: int, size: int, containment: float, certainty: float) -> int:
    """Bands of one value for a window and the shortest template of a class that it just contains."""
    width, _ = window_shape(length)
    own, shared = shortest - size + 1, math.ceil(containment * (shortest - size + 1))
    similarity = shared / (width - size + 1 + own - shared)
    return 1 if similarity >= 1 else math.ceil(math.log(1 - certainty) / math.log(1 - similarity))


def band_keys(shingles: Column, bands: int) -> Column:
    """One MinHash value for each band, as keys that also tell bands apart."""

    def key(band: int) -> Column:
        return F.xxhash64(F.lit(band), F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band)))))

    return F.array(*map(key, range(bands)))


def anchors(templates: list[tuple[str, str]], size: int) -> list[str]:
    """Words of which every shingle of every template has one: the longest that cover most, greedily."""
    import re

    left = {tuple(w[i : i + size]) for _, text in templates for w in [re.findall("[a-z0-9]+", text.lower())] for i in range(len(w) - size + 1)}
    chosen = []
    while left:
        count: dict[str, int] = {}
        for gram in left:
            for word in set(gram):
                count[word] = count.get(word, 0) + 1
        chosen.append(max(count, key=lambda w: (w not in EVERYDAY, min(len(w), 7), count[w], w)))
        left = {g for g in left if chosen[-1] not in g}
    return sorted(chosen)


def _classes(templates: list[tuple[str, str]], size: int, containment: float, certainty: float) -> list[tuple[int, int, list[tuple[int, str, str]]]]:
    """Class length, bands, and (number, license, text) of its templates."""
    import re

    groups: dict[int, list[tuple[int, int, str, str]]] = {}
    for k, (name, text) in enumerate(templates):
        n = len(re.findall("[a-z0-9]+", text.lower()))
        if n < size:
            raise ValueError(f"template {k} has {n} words; {size} are needed")
        groups.setdefault(n if n == size else next((c for c in CLASSES if c >= n), n), []).append((n, k, name, text))
    return [(length, bands_needed(length, min(g)[0], size, containment, certainty), [x[1:] for x in g]) for length, g in sorted(groups.items())]


def _by_size(templates: list[tuple[str, str]], size: int) -> dict[int, list[tuple[str, str]]]:
    """Templates by their shingle: ``size`` words, or all words of a shorter one."""
    import re

    out: dict[int, list[tuple[str, str]]] = {}
    for name, text in templates:
        out.setdefault(min(size, len(re.findall("[a-z0-9]+", text.lower()))), []).append((name, text))
    if 0 in out:
        raise ValueError("a template has no words")
    return dict(sorted(out.items()))


def _shapes(templates: list[tuple[str, str]], size: int, containment: float, certainty: float) -> tuple[dict, list[int], list]:
    """Templates by their shingle; the shingles' sizes; and of each class: length, bands, templates, place of its shingle's size."""
    by_size = _by_size(templates, size)
    sizes = list(by_size)
    # shorter templates have a class for each length
    return by_size, sizes, [(length, bands, group, k) for k, n in enumerate(sizes) for length, bands, group in _classes(by_size[n], n, containment, certainty)]


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + SHORT_TEMPLATES, id_col: str = "doc_id", text_col: str = "text", size: int = 5, containment: float = 0.8, certainty: float = 0.99999) -> DataFrame:
    """doc_id, license, containment (the best), first_word and n_words of the window where it is, n_windows."""
    spark = docs.sparkSession
    by_size, sizes, classes = _shapes(templates, size, containment, certainty)
    told = [F.struct(F.lit(length).alias("class"), F.lit(k).alias("own"), F.lit(number).alias("template"), F.lit(license_).alias("license"), F.lit(notice).alias("notice")) for length, _, group, k in classes for number, license_, notice in group]
    given = spark.range(0, 1, 1, 1).select(F.inline(F.array(*told)))
    given = given.withColumn("grams", F.coalesce(*(F.when(F.col("own") == k, F.array_distinct(shingle_hashes(words_of(F.col("notice")), n))) for k, n in enumerate(sizes))))
    known: dict[int, list[int]] = {length: [] for length, *_ in classes}
    for r in given.select("class", "grams").collect():  # a row for each of the fixed templates
        known[r["class"]] = sorted({*known[r["class"]], *r["grams"]})
    keys = F.coalesce(*(F.when(F.col("class") == length, band_keys(F.col("grams"), bands)) for length, bands, _, _ in classes))
    bands_of = given.select("class", "template", "license", "grams", F.explode(keys).alias("key"))

    def of_class_windows(grams: Column, length: int, own: int) -> Column:
        width, step = window_shape(length)
        at = F.filter(F.transform(grams, lambda x, i: F.when(x.isin(known[length]), i)), lambda i: i.isNotNull())
        # the shingle at word i lies in the windows that begin from i + own - width on and up to i
        first = lambda i: F.greatest(F.lit(0), F.ceil((i + own - width) / step).cast("int"))
        starts = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(first(i), F.floor(i / step).cast("int")), lambda k: k * step)))
        return F.transform(F.array_distinct(starts), lambda b: F.struct(F.lit(length).alias("class"), b.cast("int").alias("start")))

    def windows(grams: Column) -> Column:
        """Of one document: (class, first word from 0) of all windows with a template's shingle."""
        return F.concat(*(of_class_windows(grams[k], length, sizes[k]) for length, _, _, k in classes))

    def some_known(words: Column) -> Column:
        found = F.lit(False)
        for k, n in enumerate(sizes):
            every = sorted({x for length, _, _, own in classes if own == k for x in known[length]})
            found = found | F.exists(shingle_hashes(words, n), lambda x: x.isin(every))  # noqa: B023
        return found

    grams = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # every shingle that counts has an anchor word: texts without one go before anything is hashed
    anchor_words = sorted({w for n in sizes for w in anchors(by_size[n], n)})
    anchored = F.arrays_overlap(words_of(F.col("text")), F.array(*map(F.lit, anchor_words)))
    held = anchored & let(words_of(F.col("text")), some_known)
    rows = grams.filter(held).withColumn("grams", let(words_of(F.col("text")), lambda w: F.array(*(shingle_hashes(w, n) for n in sizes))))
    rows = rows.select("doc_id", "grams", F.explode(let(F.col("grams"), windows)).alias("w"))
    of_class = lambda f: F.coalesce(*(F.when(F.col("w.class") == c, f(c, b)) for c, b, _, _ in classes))
    cut = F.coalesce(*(F.when(F.col("w.class") == c, F.slice(F.col("grams")[k], F.col("w.start") + 1, window_shape(c)[0] - sizes[k] + 1)) for c, _, _, k in classes))
    rows = rows.select("doc_id", F.col("w.class").alias("class"), F.col("w.start").alias("start"), F.array_distinct(cut).alias("held"))
    keyed = rows.withColumn("w", F.struct("class")).withColumn("keys", F.array_distinct(of_class(lambda _, b: let(F.col("held"), lambda h: band_keys(h, b)))))
    met = keyed.select("doc_id", "class", "start", "held", F.explode("keys").alias("key")).join(F.broadcast(bands_of), ["class", "key"])
    exact = F.size(F.array_intersect("grams", "held")) / F.size("grams")
    hits = met.withColumn("containment", exact).filter(F.col("containment") >= containment)
    width = F.coalesce(*(F.when(F.col("class") == c, F.lit(window_shape(c)[0])) for c, *_ in classes))
    best = F.max(F.struct(F.round("containment", 12).alias("containment"), (-F.col("start")).alias("back"), width.alias("width")))
    # a window may meet one template in several bands, so windows are told apart before they are counted
    once = hits.groupBy("doc_id", "license", "class", "start").agg(F.max("containment").alias("containment"))
    out = once.groupBy("doc_id", "license").agg(best.alias("best"), F.count("*").alias("n_windows"))
    out = out.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("long").alias("first_word"), F.col("best.width").cast("long").alias("n_words"), "n_windows")
    # where notices differ in a word or two, the one that is held more fully stands; at most a row per license meets here.
    # A short notice may stand inside a longer one that is altered, and leaves it alone
    of_doc = out.groupBy("doc_id").agg(F.collect_list(F.struct("license", "containment", "first_word", "n_words", "n_windows")).alias("all"))

    def outdone(x: Column, y: Column) -> Column:
        return (y["n_words"] >= size) & (y["containment"] > x["containment"]) & (y["first_word"] < x["first_word"] + x["n_words"]) & (x["first_word"] < y["first_word"] + y["n_words"])

    stands = F.filter("all", lambda x: ~F.exists("all", lambda y: outdone(x, y)))
    return of_doc.select("doc_id", F.inline(stands))


def oracle(docs: str, templates: list[tuple[str, str]] = TEMPLATES + SHORT_TEMPLATES, size: int = 5, containment: float = 0.8) -> str:
    """DuckDB SQL for license_scan(docs): the exact containment of every window that holds a shingle of a template; ``docs`` is a table."""
    _, sizes, classes = _shapes(templates, size, containment, 0.5)
    rows = [(length, *window_shape(length), sizes[k], length * 1000 + number, license_, notice.replace("'", "''")) for length, _, group, k in classes for number, license_, notice in group]
    values = ", ".join("({}, {}, {}, {}, {}, '{}', '{}')".format(*r) for r in rows)
    words = lambda text: f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = lambda own: f"list_transform(range(1, len(w) - {own} + 2), lambda i: array_to_string(w[i:i + {own} - 1], ' '))"
    of_docs = " UNION ALL ".join(f"SELECT doc_id, r, {n} AS own, unnest({grams(n)}) AS gram, unnest(range(len(w) - {n - 1})) AS i FROM d WHERE len(w) >= {n}" for n in sizes)
    return f"""
WITH tw AS (SELECT class, width, step, own, template, license, {words("notice")} AS w FROM (VALUES {values}) v(class, width, step, own, template, license, notice)),
tg AS MATERIALIZED (SELECT DISTINCT class, width, step, own, template, license, gram FROM (SELECT *, unnest({grams("own")}) AS gram FROM tw)),
tn AS (SELECT template, count(*) AS n FROM tg GROUP BY 1),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM {docs}),
h AS (SELECT doc_id, r, class, width, step, template, license, gram, unnest(range(greatest(0, ceil((i + own - width) / step))::BIGINT, i // step + 1)) * step AS start FROM ({of_docs}) JOIN tg USING (own, gram)),
c AS (SELECT doc_id, license, class, width, start, max(share) AS share FROM (SELECT doc_id, r, license, class, width, template, start, count(DISTINCT gram) / any_value(n) AS share FROM h JOIN tn USING (template) GROUP BY ALL) WHERE share >= {containment} GROUP BY ALL),
o AS (SELECT doc_id, license, max({{'c': round(share, 12), 'b': -start, 'w': width}}) AS best, count(*) AS n_windows FROM c GROUP BY ALL),
a AS MATERIALIZED (SELECT doc_id, license, best.c AS containment, -best.b AS first_word, best.w::BIGINT AS n_words, n_windows FROM o)
SELECT * FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.doc_id IS NOT DISTINCT FROM x.doc_id AND y.n_words >= {size} AND y.containment > x.containment AND y.first_word < x.first_word + x.n_words AND x.first_word < y.first_word + y.n_words)"""
