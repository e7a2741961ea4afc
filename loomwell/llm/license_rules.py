"""Licence scans: known licence sentences, then ordered rules over their identifiers.

A text is split at stops and line ends, each piece is normalised, and the runs of
pieces that are known licence sentences are mapped to their identifiers. The identifiers of one text, in order, are
then matched against the licence rules in their order: a rule whose sequence
occurs names its licences and uses its identifiers up, so that later, more
general rules only see what is left. Identifiers that no rule uses are reported.

Defined cases: a null or empty text has no sentences; texts are scanned whole;
repeated rows give repeated results; an empty table gives an empty result; other
columns of the table are never looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and their notices as published, and their identifiers.
PUBLISHED = [
    ("MITref", "Released under the MIT License"),
    ("MITref", "Licensed under the MIT License"),
    ("MITref", "Distributed under the MIT License"),
    ("MITref", "This project is licensed under the MIT License"),
    ("MITref", "This software is licensed under the MIT License"),
    ("MITgrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MITnotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ASIS", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MITliable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISCgrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISCgrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSDgrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISCasis", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("ISCliable", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSDredist", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSDsource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSDbinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSDendorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSDasis", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSDliable", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("APACHE2ref", "Licensed under the Apache License, Version 2.0"),
    ("APACHE2ref", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("APACHE2comply", "you may not use this file except in compliance with the License."),
    ("APACHE2obtain", "You may obtain a copy of the License at"),
    ("APACHE2asis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("APACHE2limits", "See the License for the specific language governing permissions and limitations under the License."),
    ("APACHE2title", "Apache License Version 2.0, January 2004"),
    ("APACHE2terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL3ref", "This work is licensed under the GNU General Public License version 3"),
    ("GPL3ref", "Licensed under the GNU General Public License version 3"),
    ("GPL2ref", "Licensed under the GNU General Public License version 2"),
    ("LGPL3ref", "Licensed under the GNU Lesser General Public License version 3"),
    ("AGPL3ref", "Licensed under the GNU Affero General Public License version 3"),
    ("GPLfree", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL2free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL2only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("AGPL3free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL21free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL3free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("GPLhope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("LGPLhope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL3title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL2title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL3title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL21title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL3title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPLcopies", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL2ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL2obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL2title", "Mozilla Public License Version 2.0"),
    ("EPL1title", "Eclipse Public License - v 1.0"),
    ("EPL2title", "Eclipse Public License - v 2.0"),
    ("EPLaccept", "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("EPL2ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL1ref", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("UNLfree", "This is free and unencumbered software released into the public domain."),
    ("UNLanyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSLref", "Distributed under the Boost Software License, Version 1.0."),
    ("BSLtitle", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("ZLIBasis", "This software is provided 'as-is', without any express or implied warranty."),
    ("ZLIBliable", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("ZLIBgrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("CC0ref", "Dedicated to the public domain under CC0 1.0"),
    ("CC0title", "CC0 1.0 Universal"),
    ("CC0legal", "CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
    ("RESERVED", "All rights reserved"),
]

# Licence rules in order, each with the sentence identifiers that it needs in sequence.
RULES = [
    ("GPL-3.0-or-later", ("GPLfree", "GPLhope")),
    ("GPL-3.0-or-later", ("GPLfree",)),
    ("AGPL-3.0-or-later", ("AGPL3free", "GPLhope")),
    ("AGPL-3.0-or-later", ("AGPL3free",)),
    ("GPL-2.0-or-later", ("GPL2free", "GPLhope")),
    ("GPL-2.0-or-later", ("GPL2free",)),
    ("GPL-2.0-only", ("GPL2only", "GPLhope")),
    ("GPL-2.0-only", ("GPL2only",)),
    ("LGPL-2.1-or-later", ("LGPL21free", "LGPLhope")),
    ("LGPL-2.1-or-later", ("LGPL21free",)),
    ("LGPL-3.0-or-later", ("LGPL3free", "LGPLhope")),
    ("LGPL-3.0-or-later", ("LGPL3free",)),
    ("GPL-3.0-only", ("GPL3title", "GPLcopies")),
    ("GPL-2.0-only", ("GPL2title", "GPLcopies")),
    ("LGPL-3.0-only", ("LGPL3title", "GPLcopies")),
    ("LGPL-2.1-only", ("LGPL21title", "GPLcopies")),
    ("AGPL-3.0-only", ("AGPL3title", "GPLcopies")),
    ("MIT", ("MITref", "MITgrant", "MITnotice", "ASIS", "MITliable")),
    ("MIT", ("MITgrant", "MITnotice", "ASIS", "MITliable")),
    ("MIT", ("MITref", "MITgrant", "MITnotice", "ASIS")),
    ("MIT", ("MITgrant", "MITnotice", "ASIS")),
    ("MIT", ("MITgrant",)),
    ("ISC", ("ISCgrant", "ISCasis", "ISCliable")),
    ("ISC", ("ISCgrant", "ISCasis")),
    ("ISC", ("ISCgrant",)),
    ("0BSD", ("0BSDgrant", "ISCasis", "ISCliable")),
    ("0BSD", ("0BSDgrant",)),
    ("Apache-2.0", ("APACHE2title", "APACHE2terms")),
    ("Apache-2.0", ("APACHE2ref", "APACHE2comply", "APACHE2obtain", "APACHE2asis", "APACHE2limits")),
    ("Apache-2.0", ("APACHE2ref", "APACHE2comply", "APACHE2obtain")),
    ("Apache-2.0", ("APACHE2ref", "APACHE2comply")),
    ("BSD-3-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis", "BSDliable")),
    ("BSD-3-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDendorse")),
    ("BSD-3-Clause", ("BSDredist", "BSDendorse")),
    ("BSD-2-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDasis", "BSDliable")),
    ("BSD-2-Clause", ("BSDredist", "BSDsource", "BSDbinary")),
    ("BSD-2-Clause", ("BSDredist",)),
    ("Zlib", ("ZLIBasis", "ZLIBliable", "ZLIBgrant")),
    ("Unlicense", ("UNLfree", "UNLanyone")),
    ("Unlicense", ("UNLfree",)),
    ("MPL-2.0", ("MPL2ref", "MPL2obtain")),
    ("MPL-2.0", ("MPL2ref",)),
    ("MPL-2.0", ("MPL2title",)),
    ("EPL-2.0", ("EPL2title", "EPLaccept")),
    ("EPL-2.0", ("EPL2ref",)),
    ("EPL-1.0", ("EPL1title", "EPLaccept")),
    ("EPL-1.0", ("EPL1ref",)),
    ("BSL-1.0", ("BSLref",)),
    ("BSL-1.0", ("BSLtitle",)),
    ("CC0-1.0", ("CC0title", "CC0legal")),
    ("CC0-1.0", ("CC0ref",)),
    ("LGPL-3.0-only", ("LGPL3ref",)),
    ("AGPL-3.0-only", ("AGPL3ref",)),
    ("GPL-3.0-only", ("GPL3ref",)),
    ("GPL-2.0-only", ("GPL2ref",)),
    ("Apache-2.0", ("APACHE2ref",)),
    ("MIT", ("MITref",)),
]

# The parts of the attribution licences' names, and the versions with their jurisdictions.
CC_PARTS = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}

# Names by which projects refer to a licence, and the sentences that they do it in.
NAMES = {
    "MIT": ("MIT", "MIT (MIT)"), "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-Clause BSD", "New BSD"), "BSD-2-Clause": ("BSD 2-Clause", "2-Clause BSD", "Simplified BSD"),
    "GPL-3.0-only": ("GPL-3.0", "GPLv3", "GNU GPLv3", "GNU General Public License v3.0"), "GPL-2.0-only": ("GPL-2.0", "GPLv2", "GNU GPLv2", "GNU General Public License v2.0"),
    "LGPL-3.0-only": ("LGPL-3.0", "LGPLv3"), "AGPL-3.0-only": ("AGPL-3.0", "AGPLv3"), "MPL-2.0": ("MPL-2.0", "Mozilla Public License 2.0"), "ISC": ("ISC",), "BSL-1.0": ("Boost Software", "BSL-1.0"), "Unlicense": ("Unlicense",), "Zlib": ("zlib",),
}
FRAMES = (
    "This project is licensed under the {} License", "This project is licensed under the {} License - see the LICENSE file for details", "This project is licensed under the {} License - see the LICENSE.md file for details",
    "This project is licensed under the {} License - see the [LICENSE](LICENSE) file for details", "This software is licensed under the {} License", "This software is released under the {} License",
    "Licensed under the {} License", "Released under the {} License", "Distributed under the {} License", "Available under the {} License", "License: {}", "The {} License",
)
#: The same without the last word, for names that have it in them.
BARE_FRAMES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the {}")
#: Deprecated identifiers of the SPDX list, and the two licences that projects offer as a choice most.
OLD_TAGS = {"GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only"}
CHOICES = (("MIT", "Apache-2.0"), ("Apache-2.0", "MIT"), ("MIT", "GPL-2.0-only"), ("GPL-2.0-only", "MIT"), ("BSD-3-Clause", "GPL-2.0-only"), ("MIT", "Unlicense"), ("Unlicense", "MIT"))


def _spelled(sentence: str) -> str:
    """A published sentence as texts are normalised: lower case, a plus sign as a word, runs of other characters than letters and digits as one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower().replace("+", " plus ")).strip()


def _generated() -> tuple[list[tuple[str, str]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules by pattern: attribution licences by name and sign, and every rule's licence by its SPDX tag."""
    sentences, rules = [], []
    for sign, name in CC_PARTS.items():
        for version, where in CC_VERSIONS.items():
            sid = f"CC{sign.replace('-', '')}{version[0]}ref"
            full = f"Creative Commons {name} {version} {where}"
            sentences += [(sid, f"Licensed under CC {sign} {version}"), *[(sid, f"{who} licensed under {a} {full} License") for who in ("This work is", "") for a in ("a", "the")]]
            rules.append((f"CC-{sign}-{version}", (sid,)))
    for licence in dict.fromkeys(name for name, _ in [*RULES, *rules]):
        sid = f"SPDX{_spelled(licence).replace(' ', '')}"
        sentences.append((sid, f"SPDX-License-Identifier: {licence}"))
        rules.append((licence, (sid,)))
    for licence, names in NAMES.items():
        sid = f"NAME{_spelled(licence).replace(' ', '')}"
        for name in names:
            plain = name.removesuffix(" (MIT)")
            named = [f.replace("{} License", "{} License (MIT)").format(plain) if plain != name else f.format(name) for f in FRAMES]
            sentences += [(sid, x) for x in [*named, *(f.format(name) for f in BARE_FRAMES)]]
        rules.append((licence, (sid,)))
    for old, licence in OLD_TAGS.items():
        sid = f"SPDXOLD{_spelled(old).replace(' ', '')}"
        sentences.append((sid, f"SPDX-License-Identifier: {old}"))
        rules.append((licence, (sid,)))
    for one, other in CHOICES:
        for word in ("OR", "AND"):
            sid = f"SPDX{_spelled(f'{one} {word} {other}').replace(' ', '')}"
            sentences.append((sid, f"SPDX-License-Identifier: {one} {word} {other}"))
            rules.append((f"{one} {word} {other}", (sid,)))
    return sentences, rules


#: Of sentences that are spelled alike the first counts.
SENTENCES = [(sid, text) for text, sid in reversed({_spelled(text): sid for sid, text in reversed(PUBLISHED + _generated()[0])}.items())]
RULES += _generated()[1]

#: A sentence ends at a line's end, or at . ! ? ; before white space or the text's end.
BREAK = r"[.!?;]+(?:[ \t\r\f\x0B]+|\n|$)|\n"


def normalised(sentence: Column) -> Column:
    """A lower-cased sentence's letters and digits, a plus sign as a word, anything between as one space."""
    return F.trim(F.regexp_replace(F.replace(sentence, F.lit("+"), F.lit(" plus ")), "[^a-z0-9]+", " "))


def sentence_ids(sentences: Column) -> Column:
    """Identifiers of the known sentences, in order, from the normalised pieces of a text.

    A notice's sentence may be wrapped over lines or hold a stop or semicolon of
    its own, so a known sentence is a run of whole pieces; of several that begin
    at one piece the longest counts, and the next begins after it.
    """
    known = {text: sid for sid, text in SENTENCES}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    any_of = "|".join(x.replace(" ", "[ \\n]") for x in sorted(known, key=len, reverse=True))
    runs = F.regexp_extract_all(F.concat(F.lit("\n"), F.array_join(sentences, "\n"), F.lit("\n")), F.lit(f"(?<=\n)(?:{any_of})(?=\n)"), F.lit(0))
    return F.transform(runs, lambda s: F.try_element_at(table, F.replace(s, F.lit("\n"), F.lit(" "))))


def match_rules(ids: Column) -> Column:
    """From ';A;;B;' (identifiers in order): struct of ``found``, the licences in rule order, and ``rest``."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f";{x};" for x in need)).alias("need")) for name, need in RULES])
    start = F.struct(ids.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        found = F.when(F.contains(state["rest"], rule["need"]), F.array_append(state["found"], rule["name"])).otherwise(state["found"])
        return F.struct(F.replace(state["rest"], rule["need"], F.lit("|")).alias("rest"), found.alias("found"))

    return F.aggregate(rules, start, step)


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_sentences, n_known, sentence_ids, licenses, unmatched for each row.

    Lists are joined: ``sentence_ids`` as ;A;;B; in the text's order, ``licenses``
    by commas in alphabetical order, empty where there are none. The sentence
    table is a fixed list, so that each row is scanned where it is read: no
    shuffle, however many texts share a notice.
    """
    sentences = F.filter(F.transform(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), BREAK), normalised), lambda s: s != "")
    rows = docs.select(F.col(key).alias("__key"), sentences.alias("__sentences"))
    rows = rows.select("__key", F.size("__sentences").cast("long").alias("n_sentences"), sentence_ids(F.col("__sentences")).alias("__ids"))
    rows = rows.select("__key", "n_sentences", F.size("__ids").cast("long").alias("n_known"), F.array_join(F.transform("__ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "").alias("sentence_ids"))
    # only the few rows with known sentences go through the rules
    rows = rows.withColumn("__m", F.when(F.col("n_known") > 0, match_rules(F.col("sentence_ids"))))
    return rows.select(
        F.col("__key").alias(key), "n_sentences", "n_known", "sentence_ids",
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("__m.found")), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.regexp_replace("__m.rest", "[|]+", ""), F.lit("")).alias("unmatched"),
    )


def oracle_sql() -> str:
    """The same scan of ``documents`` as DuckDB SQL, from the same tables of values.

    Known sentences are found as runs of up to 24 neighbouring pieces; from the
    first on, the longest at each place is taken and the next looked for behind it.
    """
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(t)}, {quote(sid)})" for t, sid in {t: sid for sid, t in SENTENCES}.items())
    levels, found = "SELECT doc_id, rn, n_sentences, n_known, sentence_ids, sentence_ids AS r0 FROM joined", []
    for i, (name, need) in enumerate(RULES):
        sequence = quote("".join(f";{x};" for x in need))
        levels = f"SELECT *, replace(r{i}, {sequence}, '|') AS r{i + 1}, CASE WHEN contains(r{i}, {sequence}) THEN {quote(name)} END AS f{i} FROM ({levels})"
        found.append(f"f{i}")
    licenses = f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH RECURSIVE known(sentence, sid) AS (VALUES {values}),
rows AS (SELECT doc_id, row_number() OVER () AS rn, string_split_regex(lower(coalesce(text, '')), {quote(BREAK.replace(chr(92) + 'x0B', chr(92) + 'v'))}) AS parts FROM documents),
pieces AS (SELECT doc_id, rn, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(x, '+', ' plus '), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS p FROM rows),
-- only texts that have a known sentence, wherever it is broken
likely AS (SELECT rn, p FROM pieces WHERE EXISTS (SELECT 1 FROM known WHERE contains(array_to_string(p, ' '), sentence))),
starts AS (SELECT rn, p, unnest(range(1, len(p) + 1)) AS start FROM likely),
spans AS (SELECT rn, start, k, array_to_string(p[start:start + k - 1], ' ') AS sentence FROM starts, range(1, 25) AS r(k) WHERE start + k - 1 <= len(p)),
best AS (SELECT rn, start, max(k) AS k, arg_max(sid, k) AS sid FROM spans JOIN known USING (sentence) GROUP BY 1, 2),
nexts AS (SELECT a.rn, a.start, min(b.start) AS next FROM best a JOIN best b ON a.rn = b.rn AND b.start >= a.start + a.k GROUP BY 1, 2),
walk AS (SELECT rn, min(start) AS start FROM best GROUP BY 1 UNION ALL SELECT rn, next FROM walk JOIN nexts USING (rn, start)),
counted AS (SELECT rn, count(*) AS n_known, string_agg(';' || sid || ';', '' ORDER BY start) AS sentence_ids FROM walk JOIN best USING (rn, start) GROUP BY 1),
joined AS (SELECT doc_id, rn, len(p) AS n_sentences, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids FROM pieces LEFT JOIN counted USING (rn)),
ruled AS ({levels})
SELECT doc_id, n_sentences, n_known, sentence_ids, {licenses} AS licenses, regexp_replace(r{len(RULES)}, '[|]+', '', 'g') AS unmatched FROM ruled
"""
