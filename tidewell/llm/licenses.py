"""License scans by sentence rules, in DataFrame functions only.

A text is normalised, with a mark where a sentence or a line ends, known licence sentences are
looked for between the marks, and the sequence of their identifiers is matched against ordered
rules. A known sentence may run over any number of marks, so texts wrapped at any width and
sentences with colons, semicolons and abbreviations are found whole. Everything
happens within the row: no shuffle, and no text leaves its task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised as :func:`normalised` does, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheNotice",
    "licensed under the apache license version 2 0 the license": "ApacheNotice",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopy",
    "released under the mit license": "MitNotice",
    "licensed under the mit license": "MitNotice",
    "this project is licensed under the terms of the mit license": "MitNotice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNoticeKept",
    "the software is provided as is without warranty of any kind": "AsIs",
    "this work is licensed under the gnu general public license version 3": "Gpl3Notice",
    "licensed under the gnu general public license version 3": "Gpl3Notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplNoWarranty",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "licensed under cc by 4 0": "CcByNotice",
    "licensed under cc by sa 4 0": "CcBySaNotice",
    "licensed under cc by nc 4 0": "CcByNcNotice",
    "licensed under cc by nd 4 0": "CcByNdNotice",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcByNotice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySaNotice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNcNotice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Notice",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "AllRights",
}

#: Sentences of the published texts, as they are printed. Fixed values.
CANONICAL = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""": "MitGrant",
    """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""": "AsIs",
    """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""": "MitLiability",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.""": "BsdNames",
    """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED.""": "BsdAsIs",
    """IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "BsdLiability",
    """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""": "ApacheAsIs",
    "See the License for the specific language governing permissions and limitations under the License.": "ApacheSee",
    "Apache License Version 2.0, January 2004": "ApacheTitle",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "Gpl2Title",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "Gpl3Title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "Lgpl21Title",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "Lgpl3Title",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "Agpl3Title",
    "See the GNU General Public License for more details.": "GplSee",
    "See the GNU Lesser General Public License for more details.": "LgplSee",
    "See the GNU Affero General Public License for more details.": "AgplSee",
    """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version.""": "Lgpl21Grant",
    """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your
option) any later version.""": "Lgpl3Grant",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""": "Lgpl3Grant",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""": "Agpl3Grant",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "GplNoWarranty",
    "You should have received a copy of the GNU Lesser General Public License along with this library": "LgplCopy",
    "You should have received a copy of the GNU Lesser General Public License along with this program.": "LgplCopy",
    "You should have received a copy of the GNU Affero General Public License along with this program.": "AgplCopy",
    "Mozilla Public License Version 2.0": "Mpl2Title",
    """If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/.""": "MplCopy",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""": "IscGrant",
    """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""": "IscGrant",
    """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""": "IscAsIs",
    """IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""": "IscLiability",
    "This software is provided 'as-is', without any express or implied warranty.": "ZlibAsIs",
    "In no event will the authors be held liable for any damages arising from the use of this software.": "ZlibLiability",
    """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:""": "ZlibGrant",
    """The origin of this software must not be misrepresented; you must not claim that you wrote the original
software.""": "ZlibOrigin",
    """Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.""": "ZlibAltered",
    "This notice may not be removed or altered from any source distribution.": "ZlibNotice",
    """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""": "UnlicenseGrant",
    """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following:""": "BslGrant",
    "Boost Software License - Version 1.0 - August 17th, 2003": "BslTitle",
    """Distributed under the Boost Software License, Version 1.0.""": "BslNotice",
    "CC0 1.0 Universal": "Cc0Title",
    """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and
related or neighboring rights to this work.""": "Cc0Waiver",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CcByNdNotice",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CcByNcSaNotice",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CcByNcNdNotice",
    "Licensed under CC BY-NC-SA 4.0": "CcByNcSaNotice",
    "Licensed under CC BY-NC-ND 4.0": "CcByNcNdNotice",
    "Eclipse Public License - v 2.0": "Epl2Title",
    """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""": "Epl2Notice",
    """THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").""": "EplTerms",
}

#: Ordered rules: the first whose identifiers stand in the sequence one after the other takes them
#: away; later rules see what is left. Longer rules come first.
RULES = (
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs", "BsdLiability")),
    ("Zlib", ("ZlibAsIs", "ZlibLiability", "ZlibGrant", "ZlibOrigin", "ZlibAltered", "ZlibNotice")),
    ("Apache-2.0", ("ApacheNotice", "ApacheCompliance", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("MIT", ("MitGrant", "MitNoticeKept", "AsIs", "MitLiability")),
    ("GPL-3.0-or-later", ("Gpl3Grant", "GplNoWarranty", "GplSee", "GplCopy")),
    ("GPL-2.0-or-later", ("Gpl2Grant", "GplNoWarranty", "GplSee", "GplCopy")),
    ("LGPL-2.1-or-later", ("Lgpl21Grant", "GplNoWarranty", "LgplSee", "LgplCopy")),
    ("LGPL-3.0-or-later", ("Lgpl3Grant", "GplNoWarranty", "LgplSee", "LgplCopy")),
    ("AGPL-3.0-or-later", ("Agpl3Grant", "GplNoWarranty", "AgplSee", "AgplCopy")),
    ("Apache-2.0", ("ApacheNotice", "ApacheCompliance", "ApacheCopy")),
    ("MIT", ("MitGrant", "MitNoticeKept", "AsIs")),
    ("ISC", ("IscGrant", "IscAsIs", "IscLiability")),
    ("GPL-3.0-or-later", ("Gpl3Grant", "GplNoWarranty", "GplCopy")),
    ("GPL-2.0-or-later", ("Gpl2Grant", "GplNoWarranty", "GplCopy")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("BSL-1.0", ("BslTitle", "BslGrant")),
    ("MPL-2.0", ("Mpl2Notice", "MplCopy")),
    ("Unlicense", ("Unlicense", "UnlicenseGrant")),
    ("EPL-2.0", ("Epl2Title", "EplTerms")),
    ("MIT", ("MitGrant", "MitNoticeKept")),
    ("GPL-3.0-or-later", ("Gpl3Grant",)),
    ("GPL-2.0-or-later", ("Gpl2Grant",)),
    ("LGPL-2.1-or-later", ("Lgpl21Grant",)),
    ("LGPL-3.0-or-later", ("Lgpl3Grant",)),
    ("AGPL-3.0-or-later", ("Agpl3Grant",)),
    ("Apache-2.0", ("ApacheNotice",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("MIT", ("MitNotice",)),
    ("GPL-3.0", ("Gpl3Notice",)),
    ("GPL-3.0", ("Gpl3Title",)),
    ("GPL-2.0", ("Gpl2Title",)),
    ("LGPL-2.1", ("Lgpl21Title",)),
    ("LGPL-3.0", ("Lgpl3Title",)),
    ("AGPL-3.0", ("Agpl3Title",)),
    ("CC-BY-4.0", ("CcByNotice",)),
    ("CC-BY-SA-4.0", ("CcBySaNotice",)),
    ("CC-BY-NC-4.0", ("CcByNcNotice",)),
    ("CC-BY-ND-4.0", ("CcByNdNotice",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSaNotice",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNdNotice",)),
    ("CC0-1.0", ("Cc0Title",)),
    ("CC0-1.0", ("Cc0Waiver",)),
    ("MPL-2.0", ("Mpl2Notice",)),
    ("MPL-2.0", ("Mpl2Title",)),
    ("ISC", ("IscGrant",)),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BslGrant",)),
    ("BSL-1.0", ("BslNotice",)),
    ("EPL-2.0", ("Epl2Notice",)),
    ("EPL-2.0", ("Epl2Title",)),
    ("Unlicense", ("Unlicense",)),
)

#: A sentence ends at a full stop, semicolon or colon before a blank or the text's end, or at a line end.
SENTENCE_END = r"[.;:!?]+[\"')]*(?:\s+|$)|\n+"
#: Texts without any of these words hold no known sentence and are not cut at all.
HINT = r"(?i)licen[cs]|redistribut|permission|warrant|rights reserved|public domain|copyright|software|notice|cc0|mpl"


def normalised(sentence: Column) -> Column:
    """Lower case, every run of characters other than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _plain(sentence: str) -> str:
    """What :func:`normalised` makes of a sentence of this module."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Every known sentence, normalised: those of one line and the canonical ones.
KNOWN = SENTENCES | {_plain(s): i for s, i in CANONICAL.items()}


def marked(text: Column) -> Column:
    """Lower case, letters and digits between single spaces, and a line feed wherever a sentence or line ends."""
    t = F.regexp_replace(text, SENTENCE_END, "\n")
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9\n]+", " "), " *\n[ \n]*", "\n")


def _ids(text: Column, sentences: dict[str, str]) -> Column:
    known = F.array(*map(F.lit, sentences))
    names = F.array(*map(F.lit, sentences.values()))
    # from mark to mark, with or without marks between the words; the longest first, after a list's number or none
    words = "|".join(s.replace(" ", "[ \n]") for s in sorted(sentences, key=len, reverse=True))
    found = F.regexp_extract_all(F.trim(marked(text)), F.lit(rf"(?m)^(?:[0-9]{{1,2}} )?({words})$"), F.lit(1))
    return F.transform(found, lambda s: F.get(names, F.array_position(known, F.replace(s, F.lit("\n"), F.lit(" "))).cast("int") - 1))


def scan_licenses(documents: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """Every column of ``documents`` plus license_sentences (identifiers in order of the text),
    licenses (those the rules recognise, in rule order, distinct) and unmatched (identifiers that no
    rule took, in order).

    Rules look at the sequence of known sentences: other sentences between them do not matter. A
    null or empty text gives empty arrays.
    """
    sentences = sentences or KNOWN
    body = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<string>")
    out = documents.withColumn("license_sentences", F.when(body.rlike(HINT), _ids(body, sentences)).otherwise(empty))
    # the sequence as text, each identifier between bars of its own, so that rules match whole identifiers
    out = out.withColumn("_left", F.array_join(F.transform("license_sentences", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), ""))
    hits = []
    for i, (_, ids) in enumerate(rules):
        pattern = "".join(f"|{x}|" for x in ids)
        out = out.withColumn(f"_hit{i}", F.contains(F.col("_left"), F.lit(pattern))).withColumn("_left", F.replace(F.col("_left"), F.lit(pattern), F.lit("")))
        hits.append(F.when(F.col(f"_hit{i}"), F.lit(rules[i][0])))
    out = out.withColumn("licenses", F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    out = out.withColumn("unmatched", F.filter(F.split(F.col("_left"), r"\|+"), lambda x: x != ""))
    return out.drop("_left", *(f"_hit{i}" for i in range(len(rules))))


def document_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known licence sentences), sentence_ids, licenses, unmatched: lists
    joined by commas, empty where there are none. Null and empty texts hold none, repeated rows each give a
    row, null ids are kept, an empty table gives none; other columns are not read."""
    scanned = scan_licenses(documents.select("doc_id", "text"))
    return scanned.select(
        "doc_id",
        F.size("license_sentences").cast("bigint").alias("n_sentences"),
        *(F.array_join(c, ",").alias(n) for c, n in (("license_sentences", "sentence_ids"), ("licenses", "licenses"), ("unmatched", "unmatched"))),
    )


def oracle() -> str:
    """The scan of one-line sentences for DuckDB, from SENTENCES and the same rules: sentences that
    are wrapped, or cut by their own colons, are beyond it."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    left, hits = "seq", []
    for name, ids in RULES:
        pattern = "".join(f"|{x}|" for x in ids)
        hits.append(f"CASE WHEN contains({left}, '{pattern}') THEN '{name}' END")
        left = f"replace({left}, '{pattern}', '')"
    end = SENTENCE_END.replace("'", "''")
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos
        FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{end}') AS s FROM documents WHERE regexp_matches(coalesce(text, ''), '{HINT}'))),
hit AS (SELECT doc_id, pos, id FROM cut JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
seqs AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(id, ',' ORDER BY pos) AS ids, string_agg('|' || id || '|', '' ORDER BY pos) AS seq FROM hit GROUP BY doc_id),
ruled AS (SELECT *, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS found, {left} AS rest FROM seqs)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids,
  coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses,
  coalesce(trim(regexp_replace(rest, '[|]+', ',', 'g'), ','), '') AS unmatched
FROM documents d LEFT JOIN ruled USING (doc_id)
"""
