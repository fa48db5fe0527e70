"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Everything is a column expression.  A text is compared whole, by paragraphs and by lines; of each, only its
number of distinct bigrams decides at first which templates could reach the threshold at all.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Well-known licence notices and short licences, each with its identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,"
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
        " PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR"
        " ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
        " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
        " INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE"
        " FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS"
        " OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING"
        " OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
        " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must"
        " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT"
        " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
        " See the GNU General Public License for more details.",
    ),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, Version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("proprietary", "All rights reserved."),
)


def template_pairs(text: str) -> list[str]:
    """The distinct word bigrams of a normalised text, in order; a single word is a pair with nothing."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    if len(words) == 1:
        return [f"{words[0]} "]
    return list(dict.fromkeys(f"{a} {b}" for a, b in itertools.pairwise(words)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _units(body: Column) -> Column:
    """The distinct normalised parts of a text: the whole, its paragraphs and its lines."""

    def parts(plain: Column) -> Column:
        return F.array_distinct(F.concat(F.array(plain), F.split(plain, "\n ?\n"), F.split(plain, "\n")))

    return _let(F.regexp_replace(F.lower(body), "[^a-z0-9\n]+", " "), parts)


def _bigrams(unit: Column) -> Column:
    """As ``template_pairs``, of a normalised part."""

    def pairs(words: Column) -> Column:
        every = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))),
            lambda i: F.concat_ws(" ", F.get(words, i), F.coalesce(F.get(words, i + 1), F.lit(""))),
        )
        return F.when(F.get(words, F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    return _let(F.split(F.btrim(F.translate(unit, "\n", " ")), " +"), pairs)


def scan_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``license``, ``template``, ``dice`` and ``licenses``.

    The text, its paragraphs (cut at empty lines) and its lines are normalised to lower-case words of ASCII
    letters and digits and compared with each template that their number of bigrams allows: the Dice
    coefficient 2 * shared / (a + b) reaches t only if the smaller number is t / (2 - t) of the larger at least.
    ``license`` and ``template`` (its place in the list) have the highest Dice of ``threshold`` or more, the first
    template of equal ones; ``licenses`` are all that reached it, sorted.  Without one, or for a NULL or empty
    text, they are NULL, ``dice`` 0.0 and ``licenses`` empty.  Each row is judged by itself, so ids may repeat or
    be NULL; other columns are not carried.  The templates are a constant of some kilobytes in the plan.
    """
    known = F.array(
        *[
            F.struct(
                F.lit(i).alias("template"),
                F.lit(name).alias("license"),
                F.array(*[F.lit(p) for p in template_pairs(body)]).alias("pairs"),
            )
            for i, (name, body) in enumerate(templates)
        ]
    )

    def fits(pairs: Column, template: Column) -> Column:
        a, b = F.size(pairs), F.size(template["pairs"])
        return F.least(a, b) * (2 - threshold) >= threshold * F.greatest(a, b)

    def compared(pairs: Column) -> Column:
        """(dice, minus the template, licence) for the templates that fit."""
        return F.transform(
            F.filter(known, lambda t: fits(pairs, t)),
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(pairs, t["pairs"])) / (F.size(pairs) + F.size(t["pairs"]))).alias("dice"),
                (-t["template"]).alias("order"),
                t["license"].alias("license"),
            ),
        )

    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    every = F.flatten(F.transform(_units(body), lambda u: _let(_bigrams(u), compared)))
    reached = F.filter(every, lambda m: m["dice"] >= threshold)
    found = docs.select(docs[doc_id].alias("doc_id"), reached.alias("reached")).withColumn("best", F.array_max("reached"))
    return found.select(
        "doc_id",
        F.col("best.license").alias("license"),
        (-F.col("best.order")).alias("template"),
        F.coalesce("best.dice", F.lit(0.0)).alias("dice"),
        F.array_sort(F.array_distinct(F.transform("reached", lambda m: m["license"]))).alias("licenses"),
    )


def scan_licenses_sql(documents: str = "documents", threshold: float = THRESHOLD) -> str:
    """DuckDB: what ``scan_licenses`` returns, with -1 for no template and the licences joined by commas."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    rows = ", ".join(
        f"({i}, {quoted(name)}, [{', '.join(quoted(p) for p in template_pairs(body))}])"
        for i, (name, body) in enumerate(TEMPLATES)
    )
    return f"""
    WITH templates(template, license, pairs) AS (VALUES {rows}),
    texts AS (
        SELECT row_number() OVER () AS r, doc_id,
            regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS plain FROM {documents}),
    units AS (
        SELECT DISTINCT r, unnest(list_concat(list_concat([plain], regexp_split_to_array(plain, '\n ?\n')),
            string_split(plain, chr(10)))) AS unit FROM texts),
    words AS (
        SELECT row_number() OVER () AS u, r, regexp_split_to_array(trim(replace(unit, chr(10), ' ')), ' +') AS w FROM units),
    pairs AS (
        SELECT DISTINCT u, r, CASE WHEN len(w) = 1 THEN w[1] || ' ' ELSE w[i] || ' ' || w[i + 1] END AS p
        FROM (SELECT u, r, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE w[1] <> '')),
    sizes AS (SELECT u, r, count(*) AS n FROM pairs GROUP BY u, r),
    wanted AS (SELECT template, license, len(pairs) AS m, unnest(pairs) AS p FROM templates),
    shared AS (
        SELECT u, template, license, m, count(*) AS joint FROM pairs JOIN wanted USING (p) GROUP BY u, template, license, m),
    reached AS (
        SELECT r, template, license, 2.0::DOUBLE * joint / (n + m) AS dice FROM shared JOIN sizes USING (u)
        WHERE 2.0::DOUBLE * joint / (n + m) >= {threshold}),
    best AS (
        SELECT r, arg_max(license, (dice, -template)) AS license, arg_max(template, (dice, -template)) AS template,
            max(dice) AS dice, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses
        FROM reached GROUP BY r)
    SELECT doc_id, license, coalesce(template, -1)::INTEGER AS template, coalesce(dice, 0.0::DOUBLE) AS dice,
        coalesce(licenses, '') AS licenses
    FROM texts t LEFT JOIN best b ON t.r = b.r"""
