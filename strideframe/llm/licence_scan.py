"""Licences in documents, from known sentences and the order in which they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import same, text_key

#: Sentences of public licence texts and notices, by identifier. A sentence also
#: ends at a semicolon, as ``sentences_of`` has it.
SENTENCES = {
    "mit-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-3": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "mit-4": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "mit-title": "MIT License",
    "mit-title-2": "The MIT License (MIT)",
    "mit-ref": "Released under the MIT License.",
    "mit-ref-2": "Licensed under the MIT License.",
    "mit-ref-3": "This project is licensed under the MIT License.",
    "mit-ref-4": "Distributed under the MIT License.",
    "mit-ref-5": "This software is released under the MIT License.",
    "apache-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-1": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-1-asf": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\");",
    "apache-2": "you may not use this file except in compliance with the License.",
    "apache-3": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-4": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-5": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-ref-2": "This project is licensed under the Apache License, Version 2.0.",
    "apache-ref-3": "This project is licensed under the Apache License 2.0.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gnu-copies": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-1-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-3": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-4": "See the GNU General Public License for more details.",
    "gpl-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-0": "This program is free software;",
    "gpl2-1": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-2": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-v2": "version 2 of the License.",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-0": "This library is free software;",
    "lgpl21-1": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-2": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-5": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "bsd-6": "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services;",
    "bsd3-ref": "Licensed under the BSD 3-Clause License.",
    "bsd3-ref-2": "This project is licensed under the BSD 3-Clause License.",
    "bsd2-ref": "Licensed under the BSD 2-Clause License.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-2": "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-title": "Eclipse Public License - v 2.0",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-2": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-ref": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
}

#: Rules in order; each names a licence by the identifiers that follow one another.
#: A rule's sentences are used up, so that a shorter rule later doesn't see them.
RULES = [
    ("MIT", ["mit-1", "mit-2", "mit-3", "mit-4"]),
    ("MIT", ["mit-1", "mit-2", "mit-3"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("Apache-2.0", ["apache-1", "apache-2", "apache-3", "apache-4", "apache-5"]),
    ("Apache-2.0", ["apache-1-asf", "apache-2", "apache-3", "apache-4", "apache-5"]),
    ("Apache-2.0", ["apache-1", "apache-2", "apache-3", "apache-4"]),
    ("Apache-2.0", ["apache-1", "apache-2"]),
    ("Apache-2.0", ["apache-1-asf", "apache-2"]),
    ("GPL-3.0-or-later", ["gpl-1", "gpl-2", "gpl-3", "gpl-4"]),
    ("GPL-3.0-or-later", ["gpl-1", "gpl-2", "gpl-3"]),
    ("GPL-3.0-or-later", ["gpl-1"]),
    ("GPL-3.0-only", ["gpl-1-only", "gpl-2", "gpl-3", "gpl-4"]),
    ("GPL-3.0-only", ["gpl-1-only"]),
    ("GPL-2.0-or-later", ["gpl2-0", "gpl2-1", "gpl2-2", "gpl-2", "gpl-3", "gpl-4"]),
    ("GPL-2.0-or-later", ["gpl2-1", "gpl2-2"]),
    ("GPL-2.0-only", ["gpl2-1", "gpl2-v2"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-1", "lgpl21-2"]),
    ("LGPL-3.0-or-later", ["lgpl3-1"]),
    ("AGPL-3.0-or-later", ["agpl3-1"]),
    ("AGPL-3.0-only", ["agpl3-title", "gnu-copies"]),
    ("LGPL-3.0-only", ["lgpl3-title", "gnu-copies"]),
    ("LGPL-2.1-only", ["lgpl21-title", "gnu-copies"]),
    ("GPL-3.0-only", ["gpl3-title", "gnu-copies"]),
    ("GPL-2.0-only", ["gpl2-title", "gnu-copies"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4", "bsd-5", "bsd-6"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-5", "bsd-6"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3"]),
    ("ISC", ["isc-1", "isc-2"]),
    ("ISC", ["isc-1"]),
    ("0BSD", ["0bsd-1", "isc-2"]),
    ("MPL-2.0", ["mpl-1", "mpl-2"]),
    ("MPL-2.0", ["mpl-1", "mpl-2-s"]),
    ("MPL-2.0", ["mpl-title"]),
    ("EPL-2.0", ["epl-1"]),
    ("EPL-2.0", ["epl-title"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-ref"]),
    ("Unlicense", ["unlicense-1", "unlicense-2"]),
    ("Unlicense", ["unlicense-1"]),
    ("Zlib", ["zlib-1", "zlib-2", "zlib-3"]),
    ("MIT", ["mit-1", "mit-2"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-title-2"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("BSD-3-Clause", ["bsd3-ref-2"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref-2"]),
    ("MIT", ["mit-ref-3"]),
    ("MIT", ["mit-ref-4"]),
    ("MIT", ["mit-ref-5"]),
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-ref-2"]),
    ("Apache-2.0", ["apache-ref-3"]),
    ("GPL-3.0-only", ["gpl-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("CC0-1.0", ["cc0-title"]),
]

#: Older identifiers, and what they are called now.
_OLDER = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}

#: The clauses of Creative Commons licences, and how long names spell them.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _by_rule() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences that follow a pattern: Creative Commons notices, and identifier lines of every licence."""
    sentences, rules = {}, []
    for short, long in _CC.items():
        spelled = {"ref": f"Licensed under CC {short} 4.0.", "long": f"This work is licensed under a Creative Commons {long} 4.0 International License.", "the": f"This work is licensed under the Creative Commons {long} 4.0 International License."}
        for kind, said in spelled.items():
            sentences[f"cc-{short.lower()}-{kind}"] = said
            rules.append((f"CC-{short}-4.0", [f"cc-{short.lower()}-{kind}"]))
    for name in dict.fromkeys([n for n, _ in RULES] + [n for n, _ in rules]):
        sentences[f"spdx-{name.lower()}"] = f"SPDX-License-Identifier: {name}"
        rules.append((name, [f"spdx-{name.lower()}"]))
    for older, name in _OLDER.items():
        sentences[f"spdx-{older.lower()}"] = f"SPDX-License-Identifier: {older}"
        rules.append((name, [f"spdx-{older.lower()}"]))
    return sentences, rules


SENTENCES |= _by_rule()[0]
RULES += _by_rule()[1]

#: Names stand in this slot of a sentence, full stops included; it is filled alike for all of them.
_SLOT = "(?i)(neither the names? of)[ \\t\\n\\r][^;]{1,200}?[ \\t\\n\\r](nor[ \\t\\n\\r]+the[ \\t\\n\\r]+names)"
_FILLED = "neither the name of the copyright holder nor the names"
#: The plus sign of an identifier line, in words.
_PLUS = "(?i)(spdx-license-identifier:[ ]*[a-z0-9.-]+)[+]"
_END = "([.!?;])[ \\t\\n\\r]+"
_BLANK = "\\n[ \\t\\r]*\\n"
_MARK = "\x01"


def normalised(text: Column) -> Column:
    """ASCII letters and digits in lower case, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, line, said): sentences by place, and the lines of those of several.

    A sentence ends at punctuation before white space, or at a blank line. ``line`` is 0 for
    the sentence, and counts its lines from 1 if it has more: a notice may follow on a line
    without punctuation.
    """
    text = F.coalesce("text", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, _SLOT, _FILLED), _PLUS, "$1-or-later")
    parts = F.split(F.regexp_replace(F.regexp_replace(text, _END, "$1" + _MARK), _BLANK, _MARK), _MARK)
    each = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(parts).alias("at", "sentence"))
    lines = F.when(F.col("sentence").contains("\n"), F.concat(F.array("sentence"), F.split("sentence", "\n"))).otherwise(F.array("sentence"))
    return each.select("doc_id", "text_key", "at", F.posexplode(lines).alias("line", "raw")).select("doc_id", "text_key", "at", "line", normalised(F.col("raw")).alias("said"))


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Known licence sentences of every document, in order, and the licences they spell.

    Every sentence is looked up among the known ones (a table of fixed size), and a document's
    identifiers, in order, are matched against the rules in turn. Other sentences between
    identifiers don't part them. Only known sentences are shuffled.

    Where the same sentence is known by line and as a whole, both count. Very long texts are
    scanned whole. Null and empty texts have none. Rows equal in doc_id and text get equal results, one each. Columns
    other than doc_id and text are not looked at. An empty table gives none.
    Returns doc_id, n_known, sentence_ids and licences (comma-joined, without repeats).
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list(sentences.items()), "sid string, raw string").select("sid", normalised(F.col("raw")).alias("said"))
    met = sentences_of(docs).join(F.broadcast(known), "said").select("doc_id", "text_key", "at", "line", "sid").distinct()
    ordered = met.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("at", "line", "sid"))).alias("found"))
    ids = F.transform("found", lambda x: x["sid"])
    every = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(sequence) + " ").alias("rule")) for name, sequence in rules])
    zero = F.struct(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("names"))
    step = lambda a, r: F.struct(F.replace(a["rest"], r["rule"], F.lit(" | ")).alias("rest"), F.when(a["rest"].contains(r["rule"]), F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names"))
    spelled = ordered.select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key"), ids.alias("ids"))
    spelled = spelled.select("o_id", "o_key", "ids", F.array_join(F.array_distinct(F.aggregate(every, zero, step, lambda a: a["names"])), ",").alias("licences"))
    out = docs.select("doc_id", text_key().alias("text_key")).join(spelled, same(F.col("doc_id"), F.col("o_id")) & (F.col("text_key") == F.col("o_key")), "left")
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_known"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("sentence_ids"), F.coalesce("licences", F.lit("")).alias("licences"))


def oracle(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The same in DuckDB SQL over the view ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    known = ", ".join(f"({quote(i)}, {quote(s)})" for i, s in sentences.items())
    rest, hits = "rest0", []
    steps = []
    for k, (name, sequence) in enumerate(rules):
        rule = quote(" " + "  ".join(sequence) + " ")
        hits.append(f"CASE WHEN contains(rest{k}, {rule}) THEN {quote(name)} END")
        steps.append(f"s{k + 1} AS (SELECT *, replace(rest{k}, {rule}, ' | ') AS rest{k + 1} FROM s{k})")
        rest = f"s{k + 1}"
    seen = [f"({h})" for h in hits]
    names = ", ".join(seen)
    return f"""
WITH known AS (SELECT sid, {norm("raw")} AS said FROM (VALUES {known}) v(sid, raw)),
d AS (SELECT DISTINCT doc_id, text FROM documents),
parts AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), {quote(_SLOT)}, {quote(_FILLED)}, 'g'), {quote(_PLUS)}, '\\1-or-later', 'g'), '([.!?;])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), '\\n[ \\t\\r]*\\n', chr(1), 'g'), chr(1)) AS p FROM d),
sents AS (SELECT doc_id, text, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM parts),
cands AS (SELECT doc_id, text, pos, CASE WHEN contains(sentence, chr(10)) THEN list_concat([sentence], string_split(sentence, chr(10))) ELSE [sentence] END AS c FROM sents),
lines AS (SELECT doc_id, text, pos, unnest(c) AS raw, generate_subscripts(c, 1) AS line FROM cands),
met AS (SELECT doc_id, text, pos, line, sid FROM (SELECT *, {norm("raw")} AS said FROM lines) JOIN known USING (said)),
s0 AS (SELECT doc_id, text, count(*) AS n, string_agg(sid, ',' ORDER BY pos, line) AS ids, ' ' || string_agg(sid, '  ' ORDER BY pos, line) || ' ' AS rest0 FROM met GROUP BY doc_id, text),
{", ".join(steps)},
named AS (SELECT doc_id, text, n, ids, list_filter([{names}], lambda x: x IS NOT NULL) AS l FROM {rest})
SELECT d.doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS licences
FROM documents d LEFT JOIN named q ON d.doc_id IS NOT DISTINCT FROM q.doc_id AND d.text IS NOT DISTINCT FROM q.text
"""
