"""Licence scans by sentence rules, with DataFrame functions alone.

A text is cut into sentences twice: by lines, and by paragraphs whose lines are joined (for wrapped notices). Each
sentence, reduced to its lower-case words, is looked up among known licence sentences; the others vanish. The sequence of
identifiers is then held against ordered rules: a rule that finds its identifiers side by side names its licence and
takes them out, so longer notices come before their parts; rules of one identifier come last. Sentences that name a holder
are known for any. A licence counts once however it was found.

Texts without any anchor word are not cut at all; each known sentence has an anchor, which is asserted.

Edge cases: null and empty texts have no sentences and no licences; repeated notices count as sentences each time and as
one licence; other columns of the table play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketlane.llm.runtime import free

# Published licence sentences, by identifier.
SENTENCES = {
    "GNU-PROGRAM": "This program is free software:",
    "MIT-GRANT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-ASIS": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MIT-LIABLE": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-HEAD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-NAMES": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-ASIS": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "ISC-GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-ASIS": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "APACHE-USE": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "APACHE-FILE": "you may not use this file except in compliance with the License.",
    "APACHE-COPY": "You may obtain a copy of the License at",
    "APACHE-ASIS": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "APACHE-SEE": "See the License for the specific language governing permissions and limitations under the License.",
    "APACHE-LINE": "Licensed under the Apache License, Version 2.0.",
    "MIT-LINE": "Released under the MIT License.",
    "MIT-LINE-2": "Licensed under the MIT License.",
    "BSD-LINE": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-FORM": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-COPY": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "UNLICENSE": "This is free and unencumbered software released into the public domain.",
    "CC0-LINE": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "GPL-HOPE": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-SEE": "See the GNU General Public License for more details.",
    "EPL-TERMS": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "ARR-LINE": "Copyright holders reserve all rights; no license is granted.",
    "ARR-LINE-2": "All rights reserved; no license is granted.",
    "MIT-TITLE": "The MIT License (MIT)",
    "MIT-LINE-3": "This project is licensed under the terms of the MIT license.",
    "MIT-LINE-4": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "APACHE-TITLE": "Apache License Version 2.0, January 2004",
    "APACHE-LINE-2": "Released under the Apache License, Version 2.0.",
    "APACHE-LINE-3": "This project is licensed under the Apache License 2.0.",
    "BSD-NAMES-2": "Neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ZLIB-ASIS": "This software is provided 'as-is', without any express or implied warranty.",
    "ZLIB-LIABLE": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "ZLIB-GRANT": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-LINE": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-GRANT": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "ARTISTIC-LINE": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "ARTISTIC-PERL": "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    "WTFPL-TITLE": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "EUPL-LINE": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
    "EUPL-LINE-2": "Licensed under the European Union Public Licence, version 1.2.",
    "0BSD-GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "EPL-TERMS-1": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-TERMS-3": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "CDDL-TERMS": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "OFL-LINE": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "CC0-LINE-2": "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal license.",
    "MS-PL-LINE": "This source code is licensed under the Microsoft Public License (Ms-PL).",
    "POSTGRES-GRANT": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "PSF-LINE": "Licensed to PSF under a Contributor Agreement with a copyright license.",
    "UNLICENSE-LINE": "Released under the Unlicense license.",
    "BSD-2-LINE": "Licensed under the 2-Clause BSD License.",
    "BSD-3-LINE": "Licensed under the 3-Clause BSD License.",
    "BSD-3-LINE-2": "Use of this source code is governed by a BSD 3-Clause license that can be found in the LICENSE file.",
    "ISC-LINE": "Licensed under the ISC License.",
    "MPL-LINE": "Licensed under the Mozilla Public License, version 2.0.",
    "LGPL-SEE": "See the GNU Lesser General Public License for more details.",
    "AGPL-SEE": "See the GNU Affero General Public License for more details.",
}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_CC = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
_CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Unlicense", "EPL-1.0", "EPL-2.0", "Zlib", "BSL-1.0", "Artistic-2.0", "WTFPL", "EUPL-1.2", "0BSD", "CDDL-1.0", "OFL-1.1",
    "MS-PL", "PostgreSQL", "PSF-2.0", "MIT-0", "Apache-1.1", "BSD-4-Clause", "MPL-1.1", "AFL-3.0", "NCSA", "UPL-1.0", "CECILL-2.1", "Ruby", "Vim", "X11", "curl", "libpng-2.0", "BlueOak-1.0.0",
]
#: Sentences that name their holder, by what stands before and after the name, in normal form, and the holder of the known one.
HOLDERS = [
    ("neither the name of", "nor the names of its contributors may", "the copyright holder"),
    ("neither the name of", "nor the names of contributors may", "the copyright holder"),
    ("this software is provided by", "as is and any express or implied warranties", "the copyright holders and contributors"),
]

#: Ordered: (licence, identifiers that stand side by side).
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "MIT-ASIS", "MIT-LIABLE")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "MIT-ASIS")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE")),
    ("BSD-3-Clause", ("BSD-HEAD", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES", "BSD-ASIS")),
    ("BSD-3-Clause", ("BSD-HEAD", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES")),
    ("BSD-3-Clause", ("BSD-HEAD", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES-2")),
    ("Zlib", ("ZLIB-ASIS", "ZLIB-LIABLE", "ZLIB-GRANT")),
    ("Zlib", ("ZLIB-GRANT",)),
    ("0BSD", ("0BSD-GRANT", "ISC-ASIS")),
    ("0BSD", ("0BSD-GRANT",)),
    ("BSL-1.0", ("BSL-GRANT",)),
    ("PostgreSQL", ("POSTGRES-GRANT",)),
    ("EPL-1.0", ("EPL-TERMS-1",)),
    ("BSD-2-Clause", ("BSD-HEAD", "BSD-SOURCE", "BSD-BINARY", "BSD-ASIS")),
    ("BSD-2-Clause", ("BSD-HEAD", "BSD-SOURCE", "BSD-BINARY")),
    ("ISC", ("ISC-GRANT", "ISC-ASIS")),
    ("ISC", ("ISC-GRANT",)),
    ("Apache-2.0", ("APACHE-USE", "APACHE-FILE", "APACHE-COPY", "APACHE-ASIS", "APACHE-SEE")),
    ("Apache-2.0", ("APACHE-USE", "APACHE-FILE", "APACHE-COPY")),
    ("Apache-2.0", ("APACHE-USE", "APACHE-FILE")),
    ("MPL-2.0", ("MPL-FORM", "MPL-COPY")),
    ("MPL-2.0", ("MPL-FORM",)),
    ("Apache-2.0", ("APACHE-LINE",)),
    ("MIT", ("MIT-LINE",)),
    ("MIT", ("MIT-LINE-2",)),
    ("BSD", ("BSD-LINE",)),
    ("Unlicense", ("UNLICENSE",)),
    ("CC0-1.0", ("CC0-LINE",)),
    ("EPL-2.0", ("EPL-TERMS",)),
    ("All-rights-reserved", ("ARR-LINE",)),
    ("All-rights-reserved", ("ARR-LINE-2",)),
    *[(n, (i,)) for n, i in (
        ("MIT", "MIT-TITLE"), ("MIT", "MIT-LINE-3"), ("MIT", "MIT-LINE-4"), ("Apache-2.0", "APACHE-TITLE"), ("Apache-2.0", "APACHE-LINE-2"), ("Apache-2.0", "APACHE-LINE-3"), ("BSL-1.0", "BSL-LINE"),
        ("Artistic-2.0", "ARTISTIC-LINE"), ("Artistic-1.0-Perl", "ARTISTIC-PERL"), ("WTFPL", "WTFPL-TITLE"), ("EUPL-1.2", "EUPL-LINE"), ("EUPL-1.2", "EUPL-LINE-2"), ("EPL-2.0", "EPL-TERMS-3"),
        ("CDDL-1.0", "CDDL-TERMS"), ("OFL-1.1", "OFL-LINE"), ("CC0-1.0", "CC0-LINE-2"), ("MS-PL", "MS-PL-LINE"), ("PSF-2.0", "PSF-LINE"), ("Unlicense", "UNLICENSE-LINE"), ("BSD-2-Clause", "BSD-2-LINE"),
        ("BSD-3-Clause", "BSD-3-LINE"), ("BSD-3-Clause", "BSD-3-LINE-2"), ("ISC", "ISC-LINE"), ("MPL-2.0", "MPL-LINE"),
    )],
]


def _by_rule() -> None:
    """Sentences and rules that follow a pattern: GNU licences by version, Creative Commons by kind and version, SPDX tags."""
    for name, title in _GNU.items():
        for v in ("2", "2.1", "3"):
            tag = f"{name}-{v if '.' in v else v + '.0'}"
            said = {
                f"{tag}-LINE": f"This work is licensed under the {title}, version {v}.",
                f"{tag}-LINE-2": f"Licensed under the {title}, version {v}.",
                f"{tag}-LINE-3": f"Released under the {title}, version {v}.",
                f"{tag}-ONLY": f"This program is free software; you can redistribute it and/or modify it under the terms of the {title} version {v} as published by the Free Software Foundation.",
                f"{tag}-LATER-2": f"This library is free software; you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.",
                f"{tag}-LATER": f"This program is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
            }
            SENTENCES.update(said)
            RULES.append((f"{tag}-or-later", (f"{tag}-LATER", "GPL-HOPE", "GPL-SEE")))
            RULES.extend((f"{tag}-or-later" if "-LATER" in k else f"{tag}-only" if k.endswith("ONLY") else tag, (k,)) for k in said)
            for which in ("", "-only", "-or-later"):
                SENTENCES[f"SPDX-{tag}{which}"] = f"SPDX-License-Identifier: {tag}{which}"
                RULES.append((f"{tag}{which}", (f"SPDX-{tag}{which}",)))
    for kind in _CC:
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            tag = f"CC-{kind}-{v}"
            long = f"Creative Commons {_CC_NAMES[kind]} {v}"
            texts = (f"Licensed under CC {kind} {v}.", f"This work is licensed under CC {kind} {v}.", f"This work is licensed under a {long} International License.", f"Licensed under the {long} International License.", f"{long} International License", f"SPDX-License-Identifier: CC-{kind}-{v}")
            for i, said in enumerate(texts):
                SENTENCES[f"{tag}-LINE-{i}"] = said
                RULES.append((tag, (f"{tag}-LINE-{i}",)))
    for tag in _SPDX:
        SENTENCES[f"SPDX-{tag}"] = f"SPDX-License-Identifier: {tag}"
        RULES.append((tag, (f"SPDX-{tag}",)))


_by_rule()


def normal(sentence: str) -> str:
    out = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    for before, after, holder in HOLDERS:
        out = re.sub(f"^{before} .+ {after}", f"{before} {holder} {after}", out)
    return out


#: What never ends a sentence, though a blank follows; the end of a sentence.
_KEEP, _BREAK = r"(?i)(spdx-license-identifier:|license, v\.)[ \t]+", r"([.!?;:])[ \t\n\f\r]+"


def _words_of(sentence: str) -> list[str]:
    return [normal(x) for x in re.sub(_BREAK, "\\1\n", re.sub(_KEEP, "\\1", sentence)).split("\n")]


#: Holders whose short form ends with a dot: it doesn't end the sentence on names.
_HOLDER = r"(?i)\b(inc|ltd|corp|co|llc)\.[ \t\n\f\r]+nor "


#: Known sentences by their words, cut as texts are: after a mark that white space follows.
KNOWN: dict[str, str] = {}
for _id, _said in SENTENCES.items():
    for _n, _words in enumerate(_words_of(_said)):
        KNOWN.setdefault(_words, f"{_id}/{_n + 1}" if _n else _id)
ANCHORS = "licen[cs]e|permission|redistribut|copyright|warrant|public domain|copy of the mpl|software|eupl|all rights reserved|perl itself"
assert all(re.search(ANCHORS, w) for w in KNOWN), [w for w in KNOWN if not re.search(ANCHORS, w)]
#: Anchors as they stand in texts: blanks may be line breaks there.
_ANCHOR_TEXT = "(?i)" + ANCHORS.replace(" ", r"[^a-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def patterns() -> list[tuple[str, str]]:
    """Rules of several identifiers as (licence, text to find among `<id><id>...`), in order."""
    every = [(name, "".join(f"<{KNOWN[w]}>" for i in ids for w in _words_of(SENTENCES[i]))) for name, ids in RULES]
    return [(n, p) for n, p in every if p.count("<") > 1]


def singles() -> dict[str, str]:
    """Licences of rules of one identifier; they apply to what longer rules have left."""
    out: dict[str, str] = {}
    for name, ids in RULES:
        words = [w for i in ids for w in _words_of(SENTENCES[i])]
        if len(words) == 1:
            out.setdefault(KNOWN[words[0]], name)
    return out


def _ids(text: F.Column) -> F.Column:
    known = F.create_map(*(F.lit(x) for kv in KNOWN.items() for x in kv))
    kept = F.regexp_replace(F.regexp_replace(text, _KEEP, "$1"), _HOLDER, "$1 nor ")
    cut = F.split(F.regexp_replace(kept, _BREAK, "$1\n"), "\n")
    words = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " ")))
    words = F.filter(words, lambda w: w.rlike(ANCHORS))  # sentences without an anchor aren't known ones

    def held(w):
        for before, after, holder in HOLDERS:
            w = F.regexp_replace(w, f"^{before} .+ {after}", f"{before} {holder} {after}")
        return w

    words = F.transform(words, held)
    return F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda i: i.isNotNull())


def _licences(ids: F.Column) -> F.Column:
    """Licences of the rules that fire: long ones in their order, then those of one identifier."""
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("find")) for n, p in patterns()))
    start = F.struct(F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("left"), F.array().cast("array<string>").alias("found"))
    one = F.create_map(*(F.lit(x) for kv in singles().items() for x in kv))

    def step(state, rule):
        hit = F.contains(state["left"], rule["find"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["find"], F.lit("<>"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    def close(state):
        rest = F.transform(F.regexp_extract_all(state["left"], F.lit("<([^<>]+)>"), F.lit(1)), lambda i: F.try_element_at(one, i))
        return F.concat(state["found"], F.filter(rest, lambda n: n.isNotNull()))

    return F.aggregate(rules, start, step, close)


def scan(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of df plus n_sentences, sentence_ids, licences (sorted, comma-joined) and n_licences; `prefix` stands
    before these names, and columns that have them are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    maybe = t.rlike(_ANCHOR_TEXT)
    none = F.array().cast("array<string>")
    # lines of a paragraph joined: a break that is not doubled becomes a blank
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\n[ \t\r]*\n[ \t\r\n]*", ".\f"), r"[\r\n]+", " "), r"\f", "\n")
    lines, paras, names = free(df, "lines", "paras", "names")
    out = df.withColumn(lines, F.when(maybe, _ids(t)).otherwise(none)).withColumn(paras, F.when(maybe, _ids(joined)).otherwise(none))
    found = F.when(F.size(lines) + F.size(paras) > 0, F.array_sort(F.array_distinct(F.concat(_licences(F.col(lines)), _licences(F.col(paras)))))).otherwise(none)
    out = out.withColumn(names, found)
    ids = F.when(F.size(lines) >= F.size(paras), F.col(lines)).otherwise(F.col(paras))
    made = {"n_sentences": F.size(ids).cast("long"), "sentence_ids": F.array_join(ids, ","), "licences": F.array_join(names, ","), "n_licences": F.size(names).cast("long")}
    return out.withColumns({prefix + k: v for k, v in made.items()}).drop(lines, paras, names)


def oracle() -> str:
    """The same rows as DuckDB SQL over `documents`."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(w)}, {quote(i)})" for w, i in KNOWN.items())
    chain = lambda c: ", ".join(f"replace({c}{k}, {quote(p)}, '<>') AS {c}{k + 1}" for k, (_, p) in enumerate(patterns()))

    def held(w: str) -> str:
        for before, after, holder in HOLDERS:
            w = f"regexp_replace({w}, '^{before} .+ {after}', '{before} {holder} {after}')"
        return w

    found = lambda c: ", ".join(f"CASE WHEN contains({c}{k}, {quote(p)}) THEN {quote(n)} END" for k, (n, p) in enumerate(patterns()))
    return rf"""
WITH known(words, id) AS (VALUES {known}),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
way AS (
  SELECT r, doc_id, 'l' AS kind, text FROM t
  UNION ALL SELECT r, doc_id, 'p', replace(regexp_replace(regexp_replace(text, '\n[ \t\r]*\n[ \t\r\n]*', '.' || chr(12), 'g'), '[\r\n]+', ' ', 'g'), chr(12), chr(10)) FROM t),
cut AS (SELECT r, kind, string_split(regexp_replace(regexp_replace(regexp_replace(text, '{_KEEP}', '\1', 'g'), '{_HOLDER}', '\1 nor ', 'g'), '{_BREAK}', '\1' || chr(10), 'g'), chr(10)) AS parts FROM way),
s AS (SELECT r, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
hit AS (SELECT r, kind, pos, id FROM s JOIN known ON {held(f"trim(regexp_replace(translate(part, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))")} = words),
seq AS (SELECT r, kind, string_agg('<' || id || '>', '' ORDER BY pos) AS s0, string_agg(id, ',' ORDER BY pos) AS ids, count(*) AS n FROM hit GROUP BY r, kind),
run AS (SELECT *, {chain("s")} FROM seq),
one(id, name) AS (VALUES {", ".join(f"({quote(i)}, {quote(n)})" for i, n in singles().items())}),
rest AS (SELECT r, kind, list(name) AS more FROM (SELECT r, kind, unnest(regexp_extract_all(s{len(patterns())}, '<([^<>]+)>', 1)) AS id FROM run) JOIN one USING (id) GROUP BY r, kind),
named AS (SELECT run.r, run.kind, ids, n, list_concat(list_filter([{found("s")}], lambda x: x IS NOT NULL), coalesce(more, CAST([] AS VARCHAR[]))) AS names FROM run LEFT JOIN rest ON rest.r = run.r AND rest.kind = run.kind),
both_ AS (SELECT t.doc_id, coalesce(l.n, 0) AS ln, coalesce(p.n, 0) AS pn, l.ids AS lids, p.ids AS pids,
  list_sort(list_distinct(list_concat(coalesce(l.names, CAST([] AS VARCHAR[])), coalesce(p.names, CAST([] AS VARCHAR[]))))) AS f
  FROM t LEFT JOIN named l ON l.r = t.r AND l.kind = 'l' LEFT JOIN named p ON p.r = t.r AND p.kind = 'p')
SELECT doc_id, CAST(greatest(ln, pn) AS BIGINT) AS n_sentences, coalesce(CASE WHEN ln >= pn THEN lids ELSE pids END, '') AS sentence_ids,
  array_to_string(f, ',') AS licences, CAST(len(f) AS BIGINT) AS n_licences FROM both_
"""
