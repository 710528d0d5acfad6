"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

DataFrame functions only. A text is compared as a whole, by paragraph and by line, so that a
notice inside a longer document counts; the templates hold headers whole and by paragraph, so that one wrapped as a
comment above code is found by its paragraphs. Sets hold distinct bigrams; a template is compared
only with units whose set size lets the coefficient reach the threshold, and units with too many distinct words for any
template have no bigrams built. A unit matches the templates of the greatest coefficient, if that reaches the threshold. Nothing is shuffled:
each row is judged by itself, so repeated rows repeat and long texts stay whole.

Null and empty texts match nothing: licences is the empty string and best_dice 0. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwell.llm.common import table

# Notices and headers in the words of their licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "agpl-3.0-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-binary-clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-name-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-source-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 80  # per cent


def normalised(text: Column) -> Column:
    """Lower case; runs of anything but letters, digits and line breaks become one space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")


def bigrams(unit: Column, most: int) -> Column:
    """Distinct pairs of neighbouring words; empty below two words, and where more than ``most`` distinct words leave no template near."""
    words = F.filter(F.split(unit, "[ \n]"), lambda w: w != "")
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.transform(F.array(words), lambda w: F.when((F.size(w) < 2) | (F.size(F.array_distinct(w)) > most), F.array().cast("array<string>")).otherwise(pairs(w)))[0]


def _pairs(templates: dict[str, str]) -> dict[str, list[str]]:
    """The distinct bigrams of each template."""
    made = {}
    for name, text in sorted(templates.items()):
        words = re.findall(r"[^\W_]+", text.lower())
        if len(words) > 1:
            made[name] = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
    if not made:
        raise ValueError("a template needs two words at least")
    return made


def _template_literal(templates: dict[str, str]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, pairs)).alias("pairs"), F.lit(len(pairs)).alias("n")) for name, pairs in _pairs(templates).items()))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_matches (units and templates that match), licences (names, sorted), best_dice."""
    if not 0 < threshold <= 100:
        raise ValueError("the threshold is a percentage above 0")
    chosen = templates or TEMPLATES
    known = _template_literal(chosen)
    most = max(len(p) for p in _pairs(chosen).values()) * (200 - threshold) // threshold + 1  # distinct words are one more than distinct bigrams at most
    text = normalised(F.col("text"))
    split_lines = F.split(text, "\n")
    paragraphs = F.split(text, "\n *\n[ \n]*")
    units = F.array_distinct(F.concat(F.array(text), paragraphs, split_lines))

    def found(pairs: Column) -> Column:
        near = F.filter(known, lambda t: (F.size(pairs) * (200 - threshold) >= t["n"] * threshold) & (F.size(pairs) * threshold <= t["n"] * (200 - threshold)))
        scored = F.transform(near, lambda t: F.struct(t["name"].alias("name"), (F.size(F.array_intersect(pairs, t["pairs"])) * 2.0 / (F.size(pairs) + t["n"])).alias("dice")))
        passed = F.filter(scored, lambda s: s["dice"] * 100 >= threshold)
        return F.transform(F.array(passed), lambda own: F.filter(own, lambda s: s["dice"] == F.array_max(F.transform(own, lambda x: x["dice"]))))[0]

    hits = F.flatten(F.transform(F.transform(units, lambda u: bigrams(u, most)), found))
    return docs.select("doc_id", hits.alias("hits")).select(
        "doc_id", F.size("hits").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))), ",").alias("licences"),
        F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    words = "list_filter(string_split_regex({0}, '[ \\n]'), lambda w: w <> '')"
    return f"""
    WITH t0(name, body) AS (VALUES {quoted}),
    t1 AS (SELECT name, {words.format("regexp_replace(lower(body), '[^\\p{L}\\p{N}\\n]+', ' ', 'g')")} AS w FROM t0),
    t AS (SELECT name, {pairs.format("w")} AS pairs FROM t1),
    d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS body FROM documents),
    u0 AS (SELECT doc_id, unnest(list_distinct([body] || string_split_regex(body, '\\n *\\n[ \\n]*') || string_split(body, chr(10)))) AS unit FROM d),
    u1 AS (SELECT doc_id, row_number() OVER () AS unit, {words.format("unit")} AS w FROM u0),
    u AS (SELECT doc_id, unit, {pairs.format("w")} AS pairs FROM u1 WHERE len(w) > 1),
    h1 AS (SELECT * FROM (SELECT doc_id, unit, name, 2.0::DOUBLE * len(list_intersect(u.pairs, t.pairs)) / (len(u.pairs) + len(t.pairs)) AS dice
          FROM u JOIN t ON len(u.pairs) * {200 - THRESHOLD} >= len(t.pairs) * {THRESHOLD} AND len(u.pairs) * {THRESHOLD} <= len(t.pairs) * {200 - THRESHOLD}) WHERE dice * 100 >= {THRESHOLD}),
    h AS (SELECT * FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, unit) AS most FROM h1) WHERE dice = most),
    g AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, max(dice) AS best FROM h GROUP BY doc_id)
    SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences, round(coalesce(best, 0.0)::DOUBLE, 6) AS best_dice
    FROM documents LEFT JOIN g USING (doc_id)"""


SQL = _sql()
