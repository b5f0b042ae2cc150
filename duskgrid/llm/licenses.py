"""Licence scans by sentence rules: known sentences become identifiers, sequences of identifiers meet ordered rules.

A text is parted into sentences two ways, as lines and as running paragraphs (so that wrapped licence texts are read
too); each sentence is normalised (lower case, letters and digits only, single spaces) and looked up. The identifiers
found, in order of place, are matched against rules: a rule fires where its identifiers follow one another with no more
than GAP sentences between two of them. Longer rules go first and use up what they match. A search ends where the gap is
exceeded, so the work grows with the length of the text alone.

Only texts with one of the words that every known sentence holds are parted; the choice is exact.

Defined results: one row a document row, `licenses` being empty where nothing is known, also for null and empty texts;
repeated rows and null doc_ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskgrid.llm.common import slices, texts_of

#: Unknown sentences allowed between two sentences of a rule (titles, copyright lines and the like).
GAP = 3

# Sentences of public licences and of customary notices, with the identifiers used here.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-terms": "See the License for the specific language governing permissions and limitations under the License",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit-release": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "reserved": "Copyright, all rights reserved",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-see": "See the GNU General Public License for more details",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/ under that license",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-short": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc0-dedicated": "This work is dedicated to the public domain under CC0 1.0",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "psf-agreement": "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software (\"Python\") in source or binary form and its associated documentation",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "artistic-title": "The Artistic License 2.0",
    "ms-pl": "This source is subject to the Microsoft Public License",
    "cddl-terms": "The contents of this file are subject to the terms of the Common Development and Distribution License",
}
#: SPDX identifiers in wide use; `SPDX-License-Identifier: <id>` is a sentence of each.
SPDX = (
    "MIT MIT-0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib BSL-1.0 Unlicense CC0-1.0 PSF-2.0 Python-2.0 WTFPL OFL-1.1 Artistic-2.0 MS-PL NCSA PostgreSQL X11 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 EUPL-1.2 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0"
).split()
SENTENCES |= {f"spdx-{k}": f"SPDX-License-Identifier: {k}" for k in SPDX}
#: Names by which notices call a licence: `Licensed under <name>`, with or without `the` before and `License` behind.
NAMES = {
    "BSD 2-Clause": "BSD-2-Clause", "BSD 3-Clause": "BSD-3-Clause", "ISC": "ISC", "MPL 2.0": "MPL-2.0", "EPL 2.0": "EPL-2.0", "GPLv2": "GPL-2.0-only", "GPLv3": "GPL-3.0-only", "LGPLv3": "LGPL-3.0-only", "AGPLv3": "AGPL-3.0-only",
    "zlib": "Zlib", "CC0 1.0": "CC0-1.0", "CC BY-ND 4.0": "CC-BY-ND-4.0", "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "Creative Commons Attribution 4.0": "CC-BY-4.0", "Creative Commons Attribution-ShareAlike 4.0": "CC-BY-SA-4.0",
}
_NOTICES = {f"notice-{i}-{j}": (f"Licensed under {lead}{name}{end}", k) for i, (name, k) in enumerate(NAMES.items()) for j, (lead, end) in enumerate((("", ""), ("the ", ""), ("the ", " License")))}
SENTENCES |= {k: said for k, (said, _) in _NOTICES.items()}
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-terms")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl-notice",)),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-only", ("gpl3-only", "gpl-hope", "gpl-see")),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-see")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("MPL-2.0", ("mpl-form",)),
    ("EPL-2.0", ("epl-terms",)),
    ("EPL-2.0", ("epl-short",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("BSL-1.0", ("bsl-title", "bsl-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("Zlib", ("zlib-asis", "zlib-grant", "zlib-origin")),
    ("Zlib", ("zlib-grant",)),
    ("PSF-2.0", ("psf-agreement",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    ("LicenseRef-BSD-style", ("bsd-style",)),
    ("WTFPL", ("wtfpl-title",)),
    ("OFL-1.1", ("ofl-notice",)),
    ("Artistic-2.0", ("artistic-title",)),
    ("MS-PL", ("ms-pl",)),
    ("CDDL-1.0", ("cddl-terms",)),
    *((k, (f"spdx-{k}",)) for k in SPDX),
    *((k, (name,)) for name, (_, k) in _NOTICES.items()),
]
#: Rules by their first sentence, the longer first.
STARTS: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _name, _rule in sorted(RULES, key=lambda r: -len(r[1])):
    STARTS.setdefault(_rule[0], []).append((_name, _rule))
#: Every known sentence holds one of these.
WORDS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "free to copy", "origin of this software", "acknowledgement")
#: Place of each rule among those of its length.
RULE_ORDER = {r: i for i, r in enumerate(RULES)}
_ENDS = re.compile(r"(?<=[.!?;:])\s+")


def normal(s: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", s.lower()))


KNOWN = {normal(s): k for k, s in SENTENCES.items()}
if not all(any(w in s.lower() for w in WORDS) for s in SENTENCES.values()):
    raise AssertionError("a sentence holds none of WORDS")


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of what lies between runs of white space with two line feeds or more; each such run is read once."""
    start = 0
    for m in re.finditer(r"\s+", text):
        if m[0].count("\n") > 1:
            if m.start() > start:
                yield start, text[start : m.start()]
            start = m.end()
    if start < len(text):
        yield start, text[start:]


def sentences(text: str) -> list[tuple[int, str]]:
    """Start and normal form of every sentence, of lines and of paragraphs; a sentence found both ways is there once."""
    found = {}
    for parts in (((m.start(), m[0]) for m in re.finditer(r"[^\n]+", text)), paragraphs(text)):
        for at, part in parts:
            cuts = [0, *(e.end() for e in _ENDS.finditer(part)), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                body = part[a:b]
                if form := normal(body):
                    found.setdefault((at + a + len(body) - len(body.lstrip()), form), None)
            # a sentence may hold a full stop or a colon: runs of up to three pieces are sentences too
            for width in (2, 3):
                for i in range(len(cuts) - width):
                    body = part[cuts[i] : cuts[i + width]]
                    if (form := normal(body)) in KNOWN:
                        found.setdefault((at + cuts[i] + len(body) - len(body.lstrip()), form), None)
    return sorted(found)


def scan(text: str) -> list[tuple[str, int, int]]:
    """Licence, first and last place (starts of sentences, in characters) of every rule that fires, in order of place."""
    rows = sentences(text)
    places = sorted({a for a, _ in rows})
    number = {a: i for i, a in enumerate(places)}
    ids: list[tuple[int, str, int]] = []  # sentence number, identifier, place
    for a, form in rows:
        if form in KNOWN and not (ids and ids[-1][1] == KNOWN[form] and ids[-1][2] == a):
            ids.append((number[a], KNOWN[form], a))
    return sorted(((name, ids[took[0]][2], ids[took[-1]][2]) for name, took in matched([(n, k) for n, k, _ in ids])), key=lambda x: (x[1], x[2], x[0]))


def matched(ids: list[tuple[int, str]]) -> list[tuple[str, list[int]]]:
    """Licence and places in ids (sentence number, identifier) of every rule that fires, the longest rules first."""
    used: set[int] = set()
    out = []
    tries = sorted(((-len(rule), i, name, rule) for i, (_, k) in enumerate(ids) for name, rule in STARTS.get(k, ())), key=lambda x: (x[0], RULE_ORDER[x[2], x[3]], x[1]))
    for _, i, name, rule in tries:
        if i in used:
            continue
        took = [i]
        for want in rule[1:]:
            at = took[-1]
            for j in range(at + 1, len(ids)):
                if ids[j][0] - ids[at][0] > GAP + 1:
                    break
                if j not in used and ids[j][1] == want:
                    took.append(j)
                    break
            if took[-1] == at:
                break
        if len(took) == len(rule):
            used.update(took)
            out.append((name, took))
    return out


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (distinct, sorted, joined by commas), matches (licence, first, last) of docs (doc_id, text)."""
    pattern = "(?i)" + "|".join(WORDS)

    def task(batches):
        kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
        for b in slices(batches, "text"):
            texts = texts_of(b, "text")
            some = pc.match_substring_regex(texts, pattern).to_pylist()
            found = [scan(t.as_py()) if s else [] for t, s in zip(texts, some, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([",".join(sorted({m[0] for m in f})) for f in found], pa.string()), pa.array([[dict(zip(("license", "first", "last"), m, strict=True)) for m in f] for f in found], kind)], names=["doc_id", "licenses", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, licenses string, matches array<struct<license:string,first:int,last:int>>")
