"""Licence scans by sentence rules; DataFrame functions only.

A text is cut into sentences, sentences are normalised (lower case, letters,
digits and dots only, single blanks) and looked up in a table of known licence
sentences.  The identifiers found, in order, are matched against ordered rules:
a rule that matches a run of identifiers consumes it, so a full licence is not
also reported by its short notice.  Identifiers of a run may have at most ``GAP``
other sentences between them, so sentences of unrelated places make no licence.

Texts are cut into sentences with single line ends as blanks (for wrapped
notices), and each sentence a second time at its line ends; for each sentence the
cut that knows more counts, its lines if both know as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences (any spelling) by identifier.
SENTENCES: dict[int, list[str]] = {
    1: ["Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT License."],
    2: ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    3: ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    4: ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    10: ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This work is licensed under the Apache License, Version 2.0."],
    11: ["you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    20: ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    21: ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    22: ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    23: ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    24: ["See the GNU General Public License for more details."],
    30: ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    31: ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    32: ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    33: ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    40: ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    41: ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    42: ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    12: ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    13: ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    14: ["See the License for the specific language governing permissions and limitations under the License."],
    15: ["\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."],
    16: ["\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."],
    25: ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    26: ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    27: ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    28: ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    29: ["See the GNU Lesser General Public License for more details."],
    34: ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    35: ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    36: ["See the GNU Affero General Public License for more details."],
    37: ["Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3."],
    38: ["Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3."],
    39: ["Licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2."],
    43: ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    44: ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    45: ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    51: ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    60: ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    61: ["Licensed under the ISC License.", "This project is licensed under the ISC License."],
    62: ["This is free and unencumbered software released into the public domain."],
    63: ["Licensed under the Unlicense.", "This project is licensed under the Unlicense."],
    64: ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License, version 2.0."],
    65: ["Licensed under the BSD 3-Clause License.", "This project is licensed under the BSD 3-Clause License."],
    66: ["Licensed under the BSD 2-Clause License.", "This project is licensed under the BSD 2-Clause License."],
    67: ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    68: ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    50: ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: (licence, run of identifiers), in the order in which they are tried.
RULES: list[tuple[str, tuple[int, ...]]] = [
    ("BSD-3-Clause", (30, 31, 32, 33)),
    ("BSD-2-Clause", (30, 31, 32)),
    ("MIT", (2, 3, 4)),
    ("MIT", (2, 3)),
    ("GPL-3.0-or-later", (21, 23, 24)),
    ("GPL-2.0-or-later", (22, 23, 24)),
    ("GPL-3.0-or-later", (21,)),
    ("GPL-2.0-or-later", (22,)),
    ("LGPL-2.1-or-later", (27, 28, 29)),
    ("LGPL-3.0-or-later", (34, 23, 29)),
    ("AGPL-3.0-or-later", (35, 23, 36)),
    ("LGPL-2.1-or-later", (27,)),
    ("LGPL-3.0-or-later", (34,)),
    ("AGPL-3.0-or-later", (35,)),
    ("GPL-3.0-only", (25, 26)),
    ("Apache-2.0", (15, 16)),
    ("Apache-2.0", (10, 11, 12, 13, 14)),
    ("Apache-2.0", (11, 12, 13, 14)),
    ("Apache-2.0", (10, 11)),
    ("Apache-2.0", (11,)),
    ("Apache-2.0", (10,)),
    ("MIT", (1,)),
    ("GPL-3.0-only", (20,)),
    ("CC-BY-NC-4.0", (40,)),
    ("CC-BY-4.0", (41,)),
    ("CC-BY-SA-4.0", (42,)),
    ("GPL-2.0-only", (39,)),
    ("LGPL-3.0-only", (37,)),
    ("AGPL-3.0-only", (38,)),
    ("CC0-1.0", (43,)),
    ("CC-BY-NC-SA-4.0", (44,)),
    ("CC-BY-ND-4.0", (45,)),
    ("MPL-2.0", (50, 51)),
    ("MPL-2.0", (50,)),
    ("MPL-2.0", (51,)),
    ("ISC", (60, 4)),
    ("ISC", (60,)),
    ("ISC", (61,)),
    ("Unlicense", (62,)),
    ("Unlicense", (63,)),
    ("EPL-2.0", (64,)),
    ("BSD-3-Clause", (65,)),
    ("BSD-2-Clause", (66,)),
    ("Zlib", (67,)),
    ("BSL-1.0", (68,)),
]
#: Sentences of no licence that may stand between two identifiers of a rule.
GAP = 8
#: A single line end, while sentences are cut.
LINE = "\ue000"
#: A sentence ends at a stop after two characters at least ("v. 2.0" goes on).
STOP = rf"([^ \n{LINE}][^ \n{LINE}][.!?])[\s{LINE}]+"
#: Every known sentence holds one of these, so a text with none is not cut at all.
MARKS = "licen[sc]e|licensed|permission|warrant|redistribut|free software|public domain|mpl|cc0"


def normalised_text(s: str) -> str:
    import re

    return re.sub(r" +", " ", re.sub(r"[^a-z0-9.]", " ", s.lower())).strip(" .")


def known() -> dict[str, int]:
    return {normalised_text(s): i for i, all_ in SENTENCES.items() for s in all_}


def _normalised(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9.]", " "), " +", " "), F.lit(" ."))


def _sequence(text: Column) -> Column:
    """Known sentences in the order of the text, wrapped ones and those on lines of their own; null: another sentence."""
    table = F.create_map(*[F.lit(x) for kv in known().items() for x in kv])
    text = F.translate(text, LINE, "\ue001")
    text = F.regexp_replace(F.regexp_replace(text, r"\n\s*\n", ".\n\n"), r"([^\n.])\n(?=[^\n])", f"$1{LINE}")
    cut = F.filter(F.split(F.regexp_replace(text, STOP, "$1\n"), "\n"), lambda s: s.rlike("[A-Za-z0-9]"))
    # a sentence first, then its lines if it has several
    forms = F.transform(cut, lambda s: F.concat(F.array(s), F.when(F.contains(s, F.lit(LINE)), F.split(s, LINE)).otherwise(F.expr("array()").cast("array<string>"))))
    ids = F.transform(forms, lambda f: F.transform(f, lambda s: F.try_element_at(table, _normalised(s))))
    lines = lambda i: F.slice(i, 2, F.size(i))
    return F.flatten(F.transform(ids, lambda i: F.when(F.exists(lines(i), lambda x: x.isNotNull()), lines(i)).otherwise(F.slice(i, 1, 1))))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), licenses (names joined by commas, in the order of the rules) of every row.

    No known sentence, no text or null: 0 and ''.  Known sentences that no rule
    covers give 'unknown'.  Repeated rows stay repeated; an empty table gives an
    empty one; further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    marked = F.lower(text).rlike(MARKS)
    ids = F.coalesce(F.when(marked, _sequence(text)), F.expr("array()").cast("array<int>"))
    d = docs.select("doc_id", ids.alias("ids"))
    # identifiers are written ",1,,2,": each has commas of its own; another sentence is a dot, and many dots a slash
    left = F.array_join(F.transform("ids", lambda i: F.coalesce(F.concat(F.lit(","), i.cast("string"), F.lit(",")), F.lit("."))), "")
    left = F.replace(F.regexp_replace(left, rf"\.{{{GAP + 1},}}", "/"), F.lit("."), F.lit(""))
    d = d.select("doc_id", F.size(F.filter("ids", lambda x: x.isNotNull())).alias("n_sentences"), left.alias("left"))
    hits = []
    for k, (name, run) in enumerate(RULES):
        want = "".join(f",{i}," for i in run)
        d = d.withColumn(f"hit{k}", F.contains("left", F.lit(want))).withColumn("left", F.replace("left", F.lit(want), F.lit("|")))
        hits.append(F.when(F.col(f"hit{k}"), F.lit(name)))
    names = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    out = F.when(F.size(names) > 0, F.array_join(names, ",")).when(F.col("n_sentences") > 0, F.lit("unknown")).otherwise(F.lit(""))
    return d.select("doc_id", "n_sentences", out.alias("licenses"))


def oracle() -> str:
    """The same in SQL, with tables of sentences and rules."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    sentences = ", ".join(f"({q(s)}, {i})" for s, i in known().items())
    norm = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9.]', ' ', 'g'), ' +', ' ', 'g'), ' .')"
    line = "chr(57344)"
    wrapped = f"regexp_replace(regexp_replace(replace(text, {line}, chr(57345)), '\\n\\s*\\n', '.' || chr(10) || chr(10), 'g'), '([^\\n.])\\n([^\\n])', '\\1' || {line} || '\\2', 'g')"
    # two line ends with one character between them need a second pass
    wrapped = f"regexp_replace({wrapped}, '([^\\n.])\\n([^\\n])', '\\1' || {line} || '\\2', 'g')"
    cuts = f"string_split(regexp_replace({wrapped}, '([^ \\n' || {line} || '][^ \\n' || {line} || '][.!?])[\\s' || {line} || ']+', '\\1' || chr(10), 'g'), chr(10))"
    steps, prev = [], "base"
    for k, (name, run) in enumerate(RULES):
        want = "".join(f",{i}," for i in run)
        steps.append(f"r{k} AS (SELECT doc_id, n_sentences, replace(rest, '{want}', '|') AS rest, CASE WHEN contains(rest, '{want}') THEN list_append(names, '{name}') ELSE names END AS names FROM {prev})")
        prev = f"r{k}"
    return f"""
WITH known AS (SELECT * FROM (VALUES {sentences}) AS k(sentence, id)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, {cuts} AS c FROM d WHERE regexp_matches(lower(text), '{MARKS}')),
pieces AS (SELECT * FROM (SELECT r, unnest(c) AS s, generate_subscripts(c, 1) AS i FROM cut) WHERE regexp_matches(s, '[A-Za-z0-9]')),
lines AS (SELECT r, i, unnest(string_split(s, {line})) AS s, generate_subscripts(string_split(s, {line}), 1) AS j FROM pieces WHERE contains(s, {line})),
of_lines AS (SELECT r, i, string_agg(coalesce(',' || id || ',', '.'), '' ORDER BY j) AS seq, count(id) AS n
  FROM (SELECT r, i, j, {norm.format('s')} AS sentence FROM lines) LEFT JOIN known USING (sentence) GROUP BY r, i HAVING count(id) > 0),
of_whole AS (SELECT r, i, coalesce(',' || id || ',', '.') AS seq, CASE WHEN id IS NULL THEN 0 ELSE 1 END AS n
  FROM (SELECT r, i, {norm.format('s')} AS sentence FROM pieces) LEFT JOIN known USING (sentence)),
found AS (SELECT w.r, sum(coalesce(l.n, w.n)) AS n, string_agg(coalesce(l.seq, w.seq), '' ORDER BY w.i) AS seq FROM of_whole w LEFT JOIN of_lines l ON l.r = w.r AND l.i = w.i GROUP BY w.r),
base AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, replace(regexp_replace(coalesce(seq, ''), '\\.{{{GAP + 1},}}', '/', 'g'), '.', '') AS rest, CAST([] AS VARCHAR[]) AS names FROM d LEFT JOIN found USING (r)),
{', '.join(steps)}
SELECT doc_id, CAST(n_sentences AS INTEGER) AS n_sentences,
  CASE WHEN len(names) > 0 THEN (SELECT string_agg(x, ',' ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(names) AS x, generate_subscripts(names, 1) AS p) GROUP BY x)) WHEN n_sentences > 0 THEN 'unknown' ELSE '' END AS licenses
FROM {prev}
"""
