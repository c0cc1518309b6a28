"""Licences recognised by the sentences of their texts, in order.

Comment marks before lines are dropped and the holder named by the BSD texts is
cut to a placeholder.  A text is cut into sentences, also after a copyright line; every sentence, and every line of a sentence that
spans several, is normalised (letters and digits in lower case, single spaces)
and mapped to the identifier of a known licence sentence by a hash join.  A rule
is an ordered list of identifiers; it matches if they occur in this order, with
anything between them.  Of the rules of one licence the longest that matches is
reported.  DataFrame functions only.

Results for odd input: null and empty texts have no licence; rows that repeat
are reported each; null ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and usual notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",  # noqa: E501
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",  # noqa: E501
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",  # noqa: E501
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-project": "This project is licensed under the MIT License",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-compliance": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",  # noqa: E501
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "gpl-free": "This program is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",  # noqa: E501
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",  # noqa: E501
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",  # noqa: E501
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",  # noqa: E501
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",  # noqa: E501
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "reserved": "All rights reserved",
    "spdx": "SPDX-License-Identifier",
    "name-mit": "MIT",
    "name-apache": "Apache-2.0",
    "name-gpl3": "GPL-3.0-or-later",
    "name-bsd3": "BSD-3-Clause",
}
#: Fixed values: (licence, identifiers in order).
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-as-is")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("spdx", "name-mit")),
    ("Apache-2.0", ("apache-header", "apache-compliance", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-compliance")),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("spdx", "name-apache")),
    ("GPL-3.0", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-fitness", "gpl-see")),
    ("GPL-3.0", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-licensed",)),
    ("GPL-3.0", ("spdx", "name-gpl3")),
    ("GPL-2.0", ("gpl-free", "gpl2-terms", "gpl-hope", "gpl-fitness", "gpl-see")),
    ("GPL-2.0", ("gpl-free", "gpl2-terms")),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("spdx", "name-bsd3")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-form",)),
    ("Unlicense", ("unlicense-free",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("all rights reserved", ("reserved",)),
)
#: Names on SPDX lines besides those above, by the licence of their rule; the SQL does not know them.
SPDX_NAMES = (
    ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0"),
    ("BSD-2-Clause", "BSD-2-Clause"), ("ISC", "ISC"), ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense"),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-4.0", "CC-BY-4.0"),
)
#: Every rule starts with a sentence that has one of these words; other texts need no cutting.
HINTS = ("licen", "permi", "rights", "redistribution", "free", "public domain")
#: A sentence ends with one of these before white space, or with an empty line.
SENTENCE_END = r"([.!?:;])[ \t\n\r\f]+|\n[ \t\r]*\n[ \t\n\r\f]*"
BETWEEN = "\x01"
#: Marks of comments before a line.
COMMENT_MARK = r"(?m)^[ \t]*(?:/[*]+|[*]+/?|//+!?|#+|;+|--|<!--|%+)(?=[ \t\r\n]|$)[ \t]*"
#: A line that names the holder of a copyright; the word alone may also begin a wrapped line of a sentence.
COPYRIGHT_LINE = r"(?im)^([ \t]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*)\n"
HOLDER = r"(?i)(neither\s+the\s+names?\s+of\s)(?s:.{1,200}?)\snor\s+the\s+names\s+of\s+(?:its|their|any|other)\s+contributors"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_values(rules: tuple = RULES) -> str:
    return ", ".join(f"({i}, {_quoted(n)}, {len(ids)}, {_quoted(ids[0])}, {_quoted(like(ids))})" for i, (n, ids) in enumerate(rules))


def normalised(text: Column) -> Column:
    """Letters a-z and digits of the lower-cased text, single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def catalogue(docs: DataFrame) -> DataFrame:
    """(sentence_id, known): the fixed sentences, normalised."""
    known = [*SENTENCES.items(), *((f"spdx-{name}", name) for _, name in SPDX_NAMES)]
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known)
    rows = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS v(sentence_id, raw)")
    return rows.select("sentence_id", normalised(F.col("raw")).alias("known"))


def rules(docs: DataFrame) -> DataFrame:
    """(rule_id, license, n_sentences, first_id, pattern): the fixed rules; the pattern is for LIKE."""
    all_rules = (*RULES, *((licence, ("spdx", f"spdx-{name}")) for licence, name in SPDX_NAMES))
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {_rule_values(all_rules)} AS v(rule_id, license, n_sentences, first_id, pattern)")


def like(ids: tuple[str, ...]) -> str:
    return "%" + "%".join(f"<{i}>" for i in ids) + "%"


def known_sentences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, sentence, line, sentence_id) of every known sentence; ``line`` is -1 for a whole sentence."""
    low = F.lower("text")
    hinted = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    for k, hint in enumerate(HINTS):
        found = F.contains(low, F.lit(hint))
        condition = found if k == 0 else condition | found
    bare = F.regexp_replace(F.regexp_replace("text", COMMENT_MARK, ""), COPYRIGHT_LINE, "$1" + BETWEEN)
    bare = F.regexp_replace(bare, HOLDER, "$1the copyright holder nor the names of its contributors")
    cut = F.split(F.regexp_replace(bare, SENTENCE_END, "$1" + BETWEEN), BETWEEN)
    parts = hinted.where(condition).select("row", "doc_id", F.posexplode(cut).alias("sentence", "part"))
    lines = F.split("part", "\n")
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.col("part").alias("raw")))
    single = F.when(F.size(lines) > 1, F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("raw"))))
    pieces = parts.select("row", "doc_id", "sentence", F.explode(F.concat(whole, F.coalesce(single, F.slice(whole, 1, 0)))).alias("p"))
    named = pieces.select("row", "doc_id", "sentence", "p.line", normalised(F.col("p.raw")).alias("known"))
    return named.join(F.broadcast(catalogue(docs)), "known").drop("known")  # a fixed list


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, license, rule_id, n_sentences, first_sentence): per document and licence its longest matching rule.

    ``first_sentence`` is the number, from 0, of the first sentence that the rule names.
    """
    known = known_sentences(docs)
    entry = F.struct("sentence", "line", "sentence_id")
    texts = known.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(entry)).alias("found"))  # of one document
    sequence = F.concat_ws("", F.transform("found", lambda x: F.concat(F.lit("<"), x["sentence_id"], F.lit(">"))))
    texts = texts.withColumn("sequence", sequence).select("row", "doc_id", "found", "sequence", F.explode(F.array_distinct("found.sentence_id")).alias("first_id"))
    hits = texts.join(F.broadcast(rules(docs)), "first_id").where(F.expr("sequence like pattern"))
    first = F.array_min(F.transform(F.filter("found", lambda x: x["sentence_id"] == F.col("first_id")), lambda x: x["sentence"]))
    hits = hits.select("row", "doc_id", "license", "rule_id", "n_sentences", first.alias("first_sentence"))
    best = hits.groupBy("row", "doc_id", "license").agg(F.max(F.struct("n_sentences", (-F.col("rule_id")).alias("order"), "rule_id", "first_sentence")).alias("b"))
    return best.select("doc_id", "license", "b.rule_id", "b.n_sentences", "b.first_sentence")


def oracle() -> str:
    """The same in SQL for DuckDB, for texts without comment marks, copyright lines, named holders and SPDX_NAMES."""
    normal = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    sentences = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in SENTENCES.items())
    return f"""
WITH cat AS (SELECT sid, {normal.format('raw')} AS known FROM (VALUES {sentences}) AS v(sid, raw)),
rules AS (SELECT * FROM (VALUES {_rule_values()}) AS v(rule_id, license, n_sentences, first_id, pattern)),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace(text, '{SENTENCE_END}', '\\1' || chr(1), 'g'), chr(1)) AS parts
      FROM documents WHERE text IS NOT NULL),
p AS (SELECT rid, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS sentence FROM d),
l AS (SELECT rid, doc_id, sentence, -1 AS line, part AS raw FROM p
      UNION ALL
      SELECT rid, doc_id, sentence, generate_subscripts(string_split(part, chr(10)), 1) - 1, unnest(string_split(part, chr(10))) FROM p WHERE contains(part, chr(10))),
k AS (SELECT rid, doc_id, sentence, line, sid FROM (SELECT *, {normal.format('raw')} AS known FROM l) JOIN cat USING (known)),
s AS (SELECT rid, doc_id, string_agg('<' || sid || '>', '' ORDER BY sentence, line, sid) AS seq FROM k GROUP BY rid, doc_id),
h AS (SELECT s.rid, s.doc_id, r.*, (SELECT min(sentence) FROM k WHERE k.rid = s.rid AND k.sid = r.first_id) AS first_sentence
      FROM s JOIN rules r ON s.seq LIKE r.pattern)
SELECT doc_id, license, rule_id::INTEGER AS rule_id, n_sentences::INTEGER AS n_sentences, first_sentence::INTEGER AS first_sentence
FROM (SELECT *, row_number() OVER (PARTITION BY rid, license ORDER BY n_sentences DESC, rule_id) AS n FROM h) WHERE n = 1
"""
