"""License scans by sentence rules, in DataFrame functions only.

A text is lower-cased (A-Z) and cut into sentences at ``. ! ?`` before white space (not
after ``v.`` before a number).  Line ends cut nothing, since licence texts are wrapped, and
comment marks go with everything else that is no word of a-z and 0-9.  Sentences
known from licence texts (a fixed table of a few dozen, longer ones first) become identifiers
wherever their words follow one another within a sentence; the document's sequence of identifiers
is then matched against ordered rules, longest and most specific first.  A rule consumes what
it matches, so a full licence text isn't reported again through its parts.
``SPDX-License-Identifier:`` expressions are parsed: every licence that ``AND`` and
``OR`` join, without the exceptions after ``WITH``.

The whole scan is one narrow projection: no shuffle, no explode, one output
row per input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table

# Normalised licence sentences.
SENTENCES = {
    "apache-under": "licensed under the apache license version 2 0",
    "apache-under-the": "licensed under the apache license version 2 0 the license",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is "
                    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-released": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-name": "the mit license mit",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                      "associated documentation files the software to deal in the software without restriction including "
                      "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                      "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                      "the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to "
             "the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-under": "licensed under the gnu general public license version 3",
    "gpl2-under": "licensed under the gnu general public license version 2",
    "gpl-redistribute-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                          "general public license as published by the free software foundation either version 3 of the "
                          "license or at your option any later version",
    "gpl-redistribute-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                          "general public license as published by the free software foundation either version 2 of the "
                          "license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the "
                "implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "bsd-under": "licensed under the bsd 3 clause license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted "
                          "provided that the following conditions are met",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "proprietary": "all rights reserved",
}

# Ordered rules, a licence and the sentence sequence that shows it.
RULES = [
    ("Apache-2.0", ["apache-under-the", "apache-may-not", "apache-obtain", "apache-basis"]),
    ("MIT", ["mit-name", "mit-permission", "mit-notice", "as-is"]),
    ("MIT", ["mit-permission", "mit-notice", "as-is"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2", "gpl-hope", "gpl-see"]),
    ("Apache-2.0", ["apache-under-the", "apache-may-not"]),
    ("MIT", ["mit-permission", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2"]),
    ("Apache-2.0", ["apache-under-the"]),
    ("Apache-2.0", ["apache-under"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-under"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-permission"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-only", ["gpl3-under"]),
    ("GPL-2.0-only", ["gpl2-under"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
    ("BSD-3-Clause", ["bsd-under"]),
    ("BSD", ["bsd-redistribution"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["proprietary"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERSION = r"v\.[\x20\x09-\x0D]+([0-9])"
BREAK = r"[.!?]+[\x20\x09-\x0D]+"
OTHER = r"[^a-z0-9\n]+"


def _pattern(rule: list[str]) -> str:
    return "".join(f"<{x}>" for x in rule)


# Words stand between single spaces of their own, so that neighbouring matches share none.
KNOWN = {f" {t} ".replace(" ", "  ")[1:-1]: s for s, t in SENTENCES.items()}
CLAUSE = "|".join(sorted(KNOWN, key=lambda t: (-len(t), t)))
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = rf"SPDX-License-Identifier:[\x20\x09]*(\(*{_ID}\)*(?:[\x20\x09]+(?:AND|OR|WITH)[\x20\x09]+\(*{_ID}\)*)*)"
EXCEPTION = rf"[\x20\x09]+WITH[\x20\x09]+\(*{_ID}"


def words_by_sentence(text: Column) -> Column:
    """The normalised words of a text, one sentence a line (null text: empty)."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(lower, VERSION, "v $1"), r"[\x0A-\x0D]+", " "), BREAK, "\n")
    return F.regexp_replace(flat, OTHER, " ")


def spdx(text: Column) -> Column:
    """The licences named by a text's SPDX expressions, in order, each once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPDX), F.lit(1))
    each = F.flatten(F.transform(found, lambda x: F.regexp_extract_all(
        F.regexp_replace(x, EXCEPTION, ""), F.lit(_ID), F.lit(0))))
    return F.array_distinct(F.filter(each, lambda x: ~x.isin("AND", "OR")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_sentences, sentence_ids, spdx, licenses``.

    ``sentence_ids`` are the recognised sentences in text order, ``spdx`` the
    licences of SPDX expressions, and ``licenses`` those of the rules that matched, in
    rule order, then of the expressions, each once (all comma-joined, empty when there are none).
    Null and empty texts have no sentence; null ids are passed on; repeated rows are
    scanned alike; very long texts are scanned whole; an empty table gives an empty result; other
    columns are ignored.
    """
    known = F.create_map(*[F.lit(x) for t, s in KNOWN.items() for x in (t, s)])
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_pattern(r)).alias("pattern")) for n, r in RULES])
    found = docs.select(F.col(id_col).alias("doc_id"), words_by_sentence(F.col(text_col)).alias("w"), spdx(F.col(text_col)).alias("x"))
    spaced = F.concat(F.lit(" "), F.replace(F.replace("w", F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    ids = found.select("doc_id", F.size(F.filter(F.split("w", "\n"), lambda s: F.trim(s) != "")).cast("long").alias("n_sentences"), "x",
                       F.transform(F.regexp_extract_all(spaced, F.lit(CLAUSE), F.lit(0)), lambda s: F.element_at(known, s)).alias("ids"))
    marked = ids.withColumn("sequence", F.concat(F.lit(""), *[F.array_join(F.transform(
        "ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")]))
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("names"))
    walked = F.aggregate(rules, start, lambda a, r: F.struct(
        F.replace(a["rest"], r["pattern"], F.lit("|")).alias("rest"),
        F.when(F.contains(a["rest"], r["pattern"]), F.array_union(a["names"], F.array(r["name"])))
        .otherwise(a["names"]).alias("names")))
    names = F.when(F.size("ids") == 0, F.array().cast("array<string>")).otherwise(walked["names"])
    return marked.select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"),
                         F.array_join("x", ",").alias("spdx"), F.array_join(F.array_union(names, F.col("x")), ",").alias("licenses"))


def _sql() -> str:
    known = ", ".join(f"'{t}': '{s}'" for t, s in KNOWN.items())
    w = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for pattern, to in ((VERSION, r"'v \1'"), (r"[\x0A-\x0D]+", "' '"), (BREAK, "chr(10)"), (OTHER, "' '")):
        w = f"regexp_replace({w}, '{pattern}', {to}, 'g')"
    x = f"regexp_extract_all(coalesce(text, ''), '{SPDX}', 1)"
    x = f"flatten(list_transform({x}, lambda e: regexp_extract_all(regexp_replace(e, '{EXCEPTION}', '', 'g'), '{_ID}')))"
    q = f"SELECT doc_id, {w} AS w, list_filter({x}, lambda e: e NOT IN ('AND', 'OR')) AS every FROM documents"
    q = f"""SELECT *, list_filter(every, lambda e, i: list_position(every, e) = i) AS x,
      ' ' || replace(replace(w, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' ' AS spaced FROM ({q})"""
    q = f"""SELECT doc_id, CAST(len(list_filter(string_split(w, chr(10)), lambda s: trim(s) <> '')) AS BIGINT) AS n_sentences, x,
      list_transform(regexp_extract_all(spaced, '{CLAUSE}'), lambda s: MAP {{{known}}}[s]) AS ids FROM ({q})"""
    q = f"""SELECT *, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest,
      CAST([] AS VARCHAR[]) AS names FROM ({q})"""
    for name, rule in RULES:
        q = f"""SELECT doc_id, n_sentences, ids, x, replace(rest, '{_pattern(rule)}', '|') AS rest,
          CASE WHEN contains(rest, '{_pattern(rule)}') AND NOT list_contains(names, '{name}')
          THEN list_append(names, '{name}') ELSE names END AS names FROM ({q})"""
    return f"""SELECT doc_id, n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
      coalesce(array_to_string(x, ','), '') AS spdx, coalesce(array_to_string(
        list_concat(names, list_filter(x, lambda e: NOT list_contains(names, e))), ','), '') AS licenses FROM ({q})"""


@query("op7_sentence_rule_licenses", _sql())
def op7(spark, sf_dir):
    """Licence sentences and licences of every document."""
    return scan(table(spark, sf_dir, "documents"))
