"""License scans by sentence rules (operator 7).

Texts are cut into pieces (at line ends, after ``. ! ?`` before white space, and after list numbers that begin a line);
a piece is normalised to its lower-case runs of letters and digits joined by one space, which drops comment markers.
A sentence is a piece, or several in a row that only single line ends part: a blank line or a stop ends it. So a notice
on a line of its own and one that is wrapped, commented or numbered are both read. Known licence sentences have
identifiers. Rules are ordered: each is a licence with a sequence of identifiers, and matches where these stand in a
row, list numbers before them left out. Rules are tried in order at every place; a matched stretch is not matched again;
rule order is longest first, so that the full text of a licence wins over a notice inside it. Full texts are MIT, BSD and
those in ``license_texts`` (from their first section to the end of terms); a text with changed wording is not the full
text, and of the CC BY licences only notices are known. Beside them there are tag lines, the one-line notices of 15 licences, and
the notices that files begin with (of equally long rules the one that is listed first wins).

Defined results: a null or empty text has no sentence and no licence; texts are scanned whole; repeated rows get equal
results; a document with several licences lists all, by place; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import text_column

# Published licence notices, by licence, each rule a sequence of sentences.
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE {} AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_NO_EVENT = "IN NO EVENT SHALL THE {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_NEITHER = "Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    )),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    )),
    ("GPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    )),
    ("BSD", (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    )),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at",
        "http://www.apache.org/licenses/LICENSE-2.0",
    )),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at",
        "https://www.apache.org/licenses/LICENSE-2.0",
    )),
    ("MIT", ("Released under the MIT License.",)),
    ("MIT", ("This project is licensed under the MIT License.",)),
    ("MIT", ("Licensed under the MIT License.",)),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("Apache-2.0", ("Released under the Apache License, Version 2.0.",)),
    ("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3.",)),
    ("GPL-2.0", ("This work is licensed under the GNU General Public License, version 2.",)),
    ("LGPL-3.0", ("This work is licensed under the GNU Lesser General Public License, version 3.",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.",)),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0.",)),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0.",)),
    ("CC0-1.0", ("Released under CC0 1.0.",)),
    ("proprietary", ("All rights reserved.",)),
)
# Licences that tag lines name; titles of licences in one-line notices; notices of the GNU licences and of others.
TAGS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
TITLES = (
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License 2.0"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("Unlicense", "Unlicense"), ("Zlib", "zlib License"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License v3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License v2.1"), ("LGPL-3.0", "GNU Lesser General Public License v3.0"), ("AGPL-3.0", "GNU Affero General Public License v3.0"),
)
GNU = (
    ("GPL-2.0-or-later", "General", "2"), ("GPL-3.0-or-later", "General", "3"), ("LGPL-2.0-or-later", "Library General", "2"), ("LGPL-2.1-or-later", "Lesser General", "2.1"), ("LGPL-3.0-or-later", "Lesser General", "3"), ("AGPL-3.0-or-later", "Affero General", "3"),
)
NOTICES = (
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    )),
    ("0BSD", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    )),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
    )),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",)),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)),
    ("GPL-2.0-only", ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",)),
)
#: Full texts: licence, file in ``license_texts``, and the words at which its terms begin and end.
TEXTS = (
    ("Apache-2.0", "Apache-2.0", "1. Definitions.", "END OF TERMS AND CONDITIONS"),
    ("GPL-2.0", "GPL-2", "Preamble", "END OF TERMS AND CONDITIONS"),
    ("GPL-3.0", "GPL-3", "Preamble", "END OF TERMS AND CONDITIONS"),
    ("LGPL-2.1", "LGPL-2.1", "Preamble", "END OF TERMS AND CONDITIONS"),
    ("LGPL-3.0", "LGPL-3", "This version of the GNU Lesser", None),
    ("MPL-2.0", "MPL-2.0", "1. Definitions", "Exhibit A - Source Code Form"),
    ("CC0-1.0", "CC0-1.0", "Statement of Purpose", None),
)
_LINE = re.compile(r"\r\n?|[\n\x0b\x0c\x85\u2028\u2029]")
_STOP = re.compile(r"(?<=[.!?])\s+")
_MARK = re.compile(r"[\W_]*(?:dnl|rem)\s+", re.IGNORECASE)
_NUMBER = re.compile(r"[\W_]*((?:\d{1,3}(?:\.\d{1,3})*|[a-z]|[ivx]{1,5})[.)])\s+", re.IGNORECASE)
_ALONE = re.compile(r"[\W_]*(?:\d{1,3}|[a-z]|[ivx]{1,5})\.", re.IGNORECASE)
_PLAIN = re.compile(r"[^\W_]+")


def normalise(sentence: str) -> str:
    return " ".join(_PLAIN.findall(sentence.lower()))


def pieces(text: str) -> list[tuple[str, bool, bool]]:
    """Normalised pieces without empty ones; whether a blank line or a stop parts it from the one before; whether it is a
    list number."""
    out, ended = [], True
    for line in _LINE.split(text):
        if m := _MARK.match(line):
            line = line[m.end() :]
        if m := _NUMBER.match(line):
            if number := normalise(m[1]):
                out.append((number, ended, True))
                ended = m[1][-1] == "."
                line = line[m.end() :]
        blank = True
        for part in _STOP.split(line):
            if words := normalise(part):
                out.append((words, ended, ended and _ALONE.fullmatch(part) is not None))
                blank, ended = False, part[-1] in ".!?"
        ended |= blank and not m
    return out


def sentences(text: str) -> list[str]:
    """The sentences of a licence's own text: lines are joined, list numbers that begin a sentence are left out."""
    out: list[str] = []
    joins = False
    for words, ended, number in pieces(text):
        if number and ended:
            joins = False
        elif joins and not ended:
            out[-1] += " " + words
        else:
            out.append(words)
            joins = True
    return out


def full_texts() -> list[tuple[str, tuple[str, ...]]]:
    """The licences of ``TEXTS`` as rules."""
    out = []
    for name, file, begin, end in TEXTS:
        text = (Path(__file__).parent / "license_texts" / file).read_text(encoding="utf-8")
        text = text[text.index(begin) :]
        out.append((name, (text[: text.rindex(end)] if end else text,)))
    return out


def long_rules() -> list[tuple[str, tuple[str, ...]]]:
    """MIT and BSD as a whole, with the holders that their texts name."""
    mit = next(parts for name, parts in RULES if name == "MIT")
    bsd = next(parts for name, parts in RULES if name == "BSD")
    given = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    out = [("MIT", (
        *mit,
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ))]
    for by, liable in (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("REGENTS", "REGENTS")):
        end = (_AS_IS.format(by), _NO_EVENT.format(liable))
        out.append(("BSD-2-Clause", (given, *bsd, *end)))
        out += [("BSD-3-Clause", (given, *bsd, _NEITHER.format(whose), *end)) for whose in ("copyright holder", "copyright owner", "University")]
    return out


def notice_rules() -> list[tuple[str, tuple[str, ...]]]:
    """Tag lines, one-line notices, and the notices of files, each licence in the forms in which it is printed."""
    out = [(tag, (f"SPDX-License-Identifier: {tag}",)) for tag in TAGS] + list(NOTICES)
    out += [(name, (f"{begin} the {title}.",)) for name, title in TITLES for begin in ("Licensed under", "Released under", "Distributed under", "This project is licensed under", "This software is licensed under")]
    grant = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    out += [(name, (grant.format(what, title, version),)) for name, title, version in GNU for what in ("program", "library", "software")]
    return out


class Rules:
    """Sentence identifiers and ordered rules over them."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...] | None = None):
        self.ids: dict[str, int] = {}
        self.rules: dict[int, list[tuple[int, str, tuple[int, ...]]]] = {}
        #: Known sentences by their first two words (by one, if there is one only).
        self.begins: dict[tuple[str, ...], list[str]] = {}
        ordered = [(name, tuple(x for part in parts for x in sentences(part))) for name, parts in (rules or (*full_texts(), *long_rules(), *RULES, *notice_rules()))]
        for order, (name, parts) in enumerate(sorted(ordered, key=lambda r: -len(r[1]))):
            seq = tuple(self.ids.setdefault(p, len(self.ids) + 1) for p in parts)
            self.rules.setdefault(seq[0], []).append((order, name, seq))
        for known in self.ids:
            self.begins.setdefault(tuple(known.split(" ", 2)[:2]), []).append(known)

    def known(self, got: list[tuple[str, bool, bool]]) -> list[dict[int, int]]:
        """For each piece: the known sentences that begin in it, and the piece after each."""
        out: list[dict[int, int]] = []
        low = 0
        while low < len(got):
            high = low + 1
            while high < len(got) and not got[high][1]:
                high += 1
            run = " ".join(p[0] for p in got[low:high])
            ends, at = {}, -1
            for i in range(low, high):
                at += len(got[i][0]) + 1
                ends[at] = i + 1
            at = 0
            for i in range(low, high):
                first, _, rest = run[at : at + 80].partition(" ")
                found = {}
                for key in ((first,), (first, rest.split(" ", 1)[0])):
                    for sentence in self.begins.get(key, ()):
                        if (end := ends.get(at + len(sentence))) is not None and run.startswith(sentence, at):
                            found[self.ids[sentence]] = end
                out.append(found)
                at += len(got[i][0]) + 1
            low = high
        return out

    def scan(self, text: str) -> tuple[int, int, list[tuple[str, int, int]]]:
        """Number of pieces, of those in which a known sentence begins, and (licence, first, end) of each match."""
        got = pieces(text)
        known = self.known(got)
        out, at = [], 0
        while at < len(got):
            for _, name, rule in sorted(r for k in known[at] for r in self.rules.get(k, ())):
                end = known[at][rule[0]]
                for k in rule[1:]:
                    while end < len(got) and got[end][2] and k not in known[end]:
                        end += 1
                    if end == len(got) or k not in known[end]:
                        break
                    end = known[end][k]
                else:
                    out.append((name, at, end))
                    at = end
                    break
            else:
                at += 1
        return len(got), sum(map(bool, known)), out


def scan_licenses(docs: DataFrame, rules: Rules | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_known (pieces in which a known sentence begins), n_matches, licenses (distinct, by first place, comma-joined), matches
    (licence:first:end piece numbers, comma-joined). Narrow: no shuffle; one row in, one row out."""
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [rules.scan(x) for x in text_column(part).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([len(g[2]) for g in got], pa.int64()),
                    pa.array([",".join(dict.fromkeys(m[0] for m in g[2])) for g in got]), pa.array([",".join(f"{a}:{b}:{c}" for a, b, c in g[2]) for g in got]),
                ], names=["id", "n_known", "n_matches", "licenses", "matches"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_known long, n_matches long, licenses string, matches string").withColumnRenamed("id", id_col)
