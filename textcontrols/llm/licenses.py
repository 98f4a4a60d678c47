"""License scans by conditional compression.

Paragraphs that speak of licences, copyright, permission or warranty make
candidate blocks, neighbouring ones one block.  A template is a licence with
all its wordings, held as one zstandard raw dictionary.  Every block, and the
place of every cue in it, is compressed by itself and with every template.  A
template's reduction is the larger of the block's and of its best place's (in a long
block a naming of some letters is lost in the noise).  Templates that reduce
by MIN_SAVING bytes or more are the candidates, ranked by the reduction.  The exact wording confirms them at each place: the words of a wording that the block
holds in order, and the words that it adds or lacks.  Words that name a licence
or its version must not differ, and a naming that is negated is none.  Where
confirmed ones overlap, the text that they share in is compressed with each: the
one of the largest reduction, less DIFFERENCE bytes for each differing word,
stays.  An SPDX tag names each licence of its expression, as it is written there.

Defined results: a null or empty text has no block; texts of any length are
scanned whole; ties in the reduction go to the template that comes first;
repeated rows get equal results; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.llm.work import require, text_udf

# Wordings by which public licences are granted or noticed.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so")
MIT_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD_OPENING = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
               "that the following conditions are met:")
BSD_CLAUSES = (
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.")
BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.")
BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted")
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")


def _gnu(kind: str, version: str, short: str) -> tuple[str, ...]:
    """The notice of a GNU licence, and how its name is written."""
    full = f"GNU {kind} Public License"
    notice = (f"is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the "
              f"Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
    return (f"This work is licensed under the {full}, version {version}.", "This program " + notice,
            f"{full}, version {version}", f"{full} v{version}", f"version {version} of the {full}",
            f"{full} as published by the Free Software Foundation; version {version}",
            f"{full} as published by the Free Software Foundation, version {version}", *short.split("|"))


#: Paragraphs by which the texts of these licences begin, or grant.
BODIES = {
    "Apache-2.0": ("\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 "
                   "through 9 of this document.",
                   "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
                   "worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
                   "Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such "
                   "Derivative Works in Source or Object form."),
    "GPL-3.0": ("The licenses for most software and other practical works are designed to take away your freedom to share and "
                "change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and "
                "change all versions of a program--to make sure it remains free software for all its users.",),
    "GPL-2.0": ("The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU "
                "General Public License is intended to guarantee your freedom to share and change free software--to make sure the "
                "software is free for all its users. This General Public License applies to most of the Free Software "
                "Foundation's software and to any other program whose authors commit to using it.",),
    "LGPL-3.0": ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the "
                 "GNU General Public License, supplemented by the additional permissions listed below.",),
    "LGPL-2.1": ("This license, the Lesser General Public License, applies to some specially designated software packages--typically "
                 "libraries--of the Free Software Foundation and other authors who decide to use it.",),
    "AGPL-3.0": ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
                 "specifically designed to ensure cooperation with the community in the case of network server software.",),
}
#: The Creative Commons licences: code and name; versions, and what stands behind a version.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
            "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
            "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CREATIVE_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def _creative(code: str, version: str) -> tuple[str, ...]:
    kind, named = CREATIVE[code], f"CC {code} {version}"
    return (f"Licensed under {named}.", named,
            f"This work is licensed under a Creative Commons {kind} {version} {CREATIVE_VERSIONS[version]} License.",
            f"Creative Commons {kind} {version}", f"creativecommons.org/licenses/{code.lower()}/{version}")


def _documentation(version: str) -> tuple[str, ...]:
    full = f"GNU Free Documentation License, Version {version}"
    return ("Permission is granted to copy, distribute and/or modify this document under the terms of the "
            f"{full} or any later version published by the Free Software Foundation", full, f"GFDL {version}")


TEMPLATES = {
    "MIT": ("Released under the MIT License.", MIT_GRANT + ", subject to the following conditions:",
            MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software." + MIT_WARRANTY, "MIT License", "MIT Licence"),
    "MIT-0": (MIT_GRANT + ".", MIT_GRANT + "." + MIT_WARRANTY, "MIT No Attribution License", "MIT-0 License"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License.",
                   "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "GPL-3.0": _gnu("General", "3", "GPLv3|GPL v3|GPL version 3|GPL-3.0"),
    "GPL-2.0": _gnu("General", "2", "GPLv2|GPL v2|GPL version 2|GPL-2.0"),
    "LGPL-3.0": _gnu("Lesser General", "3", "LGPLv3|LGPL v3|LGPL version 3|LGPL-3.0"),
    "LGPL-2.1": _gnu("Lesser General", "2.1", "LGPLv2.1|LGPL v2.1|LGPL version 2.1|LGPL-2.1"),
    "LGPL-2.0": _gnu("Library General", "2", "LGPLv2|LGPL v2|LGPL version 2|LGPL-2.0"),
    "AGPL-3.0": _gnu("Affero General", "3", "AGPLv3|AGPL v3|AGPL version 3|AGPL-3.0"),
    # The opening is common to all BSD licences and without the clauses it names none of them.
    "BSD": (BSD_OPENING,),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", BSD_OPENING + BSD_CLAUSES,
                     BSD_OPENING + BSD_CLAUSES + BSD_WARRANTY, "BSD 2-Clause", "2-Clause BSD", "Simplified BSD License"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", BSD_OPENING + BSD_CLAUSES + BSD_NAMES,
                     BSD_OPENING + BSD_CLAUSES + BSD_NAMES + BSD_WARRANTY, "BSD 3-Clause", "3-Clause BSD",
                     "New BSD License", "Modified BSD License"),
    "ISC": ("Released under the ISC License.", ISC_GRANT + ISC_NOTICE, ISC_GRANT + ISC_NOTICE + ISC_WARRANTY, "ISC License"),
    "0BSD": (ISC_GRANT + ".", ISC_GRANT + "." + ISC_WARRANTY, "Zero-Clause BSD", "BSD Zero Clause License", "0BSD License"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at", "Mozilla Public License, v. 2.0",
                "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "2.0 which is available at", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0",
                "Eclipse Public License v. 2.0", "EPL 2.0"),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "v1.0 which accompanies this distribution, and is available at", "Eclipse Public License 1.0",
                "Eclipse Public License, version 1.0", "Eclipse Public License v. 1.0", "EPL 1.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",
                "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
                "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
                "to whom the Software is furnished to do so, all subject to the following:",
                "Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",
                  "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                  "for any purpose, commercial or non-commercial, and by any means.",
                  "Released under the Unlicense.", "The Unlicense"),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
             "alter it and redistribute it freely, subject to the following restrictions:",
             "Released under the zlib License.", "zlib License"),
    **{f"CC-{code}-{version}": _creative(code, version) for version in CREATIVE_VERSIONS for code in CREATIVE},
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights.",
                "has waived all copyright and related or neighboring rights to", "CC0 1.0"),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.", "Apache License, Version 1.1",
                   "Apache Software License, Version 1.1", "Apache License 1.1"),
    "Artistic-2.0": ("Released under the Artistic License 2.0.", "Artistic License 2.0", "Artistic License, Version 2.0"),
    "Artistic-1.0": ("Released under the Artistic License 1.0.", "Artistic License 1.0", "Artistic License, Version 1.0"),
    **{f"EUPL-{v}": (f"Licensed under the EUPL, Version {v}", f"European Union Public Licence v. {v}",
                     f"European Union Public License, Version {v}", f"EUPL v{v}") for v in ("1.2", "1.1")},
    **{f"CDDL-{v}": (f"Common Development and Distribution License, Version {v}", f"CDDL, Version {v}", f"CDDL v{v}")
       for v in ("1.0", "1.1")},
    **{f"GFDL-{v}": _documentation(v) for v in ("1.3", "1.2", "1.1")},
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, "
                   "and without a written agreement is hereby granted, provided that the above copyright notice and this "
                   "paragraph and the following two paragraphs appear in all copies.",
                   "Released under the PostgreSQL License.", "PostgreSQL License", "PostgreSQL Licence"),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is "
              "allowed as long as the name is changed.", "Do What The Fuck You Want To Public License", "WTFPL"),
    "all-rights-reserved": ("All rights reserved.",),
}
TEMPLATES = {name: (*texts, *BODIES.get(name, ()), *([] if name in ("BSD", "all-rights-reserved") else [f"SPDX-License-Identifier: {name}"]))
             for name, texts in TEMPLATES.items()}
#: Words that tell licences apart, besides those with a digit: none may be lacking, and none be added
#: but those that other text holds too.
NAME_WORDS = frozenset("""mit apache gnu gpl lgpl agpl lesser affero library bsd zero new modified simplified isc mozilla mpl eclipse epl
boost unlicense zlib cc cc0 by sa nc nd attribution sharealike noncommercial noderivatives noderivs neither
artistic eupl cddl gfdl postgresql wtfpl""".split())
COMMON = frozenset("library new modified by artistic".split())

CUE = (r"licen[sc]e|licensing|copyright|\(c\)|©|rights\W+reserved|public\W+domain|hereby\W+granted|redistribut|warrant|spdx"
       r"|creative\W+commons|\bcc[ -]by|\bcc0|permission\W+(?:is|to)\b|\b[al]?gpl|\b[em]pl\b|\b0?bsd\b|\b(?:eu|wtf)pl\b|\bcddl\b|\bgfdl\b")
#: A template that reduces a block by fewer bytes is no candidate for it: a naming of five letters may save no whole byte.
MIN_SAVING = 0
#: Compressed before every piece, with and without a dictionary: without it zstandard leaves short texts as they are.
LEAD = "the quick brown fox jumps over the lazy dog while five boxing wizards watch, 0123456789 times: "
#: Bytes that a word added or lacked weighs against the bytes saved, where confirmed templates overlap.
DIFFERENCE = 4
#: Characters of a block that are compressed at once, so that the dictionary stays in reach.
PIECE = 1 << 15
#: Words before a naming of at most NAMING words that may negate it.
NEGATED_WITHIN, NAMING = 4, 8
#: Words of the template that the block must hold in order, in hundredths.
MIN_WORDING_PCT = 90
#: Characters before and after a cue that its block takes from long paragraphs: twice the longest template.
REACH = 2 * max(len(text) for texts in TEMPLATES.values() for text in texts)
_SAID = re.compile(r"[^\W_]")
_CUE = re.compile(CUE, re.I)
#: Letters of lower case that every cue holds, and how far before them it may begin.
ANCHORS = (("licen", 0), ("copyright", 0), ("(c)", 0), ("©", 0), ("rights", 0), ("public", 0), ("hereby", 0), ("redistribut", 0),
           ("warrant", 0), ("spdx", 0), ("creative", 0), ("cc by", 0), ("cc-by", 0), ("cc0", 0), ("permission", 0), ("gpl", 1),
           ("epl", 0), ("mpl", 0), ("bsd", 1), ("eupl", 0), ("wtfpl", 0), ("cddl", 0), ("gfdl", 0))
#: Characters around a cue that make its place.
NEAR = 16

SCHEMA = "n_blocks long, licenses array<string>, findings array<struct<license:string,start:long,end:long,saving_pct:int,wording_pct:int,differences:string>>"


#: Words as they count in a comparison: without marks at their ends, parted by hyphens unless these are often left out.
_WORD = re.compile(r"(?:non|no|share)-(?:commercial|derivatives|derivs|alike)\b|[^\W_]+(?:[.'’/][^\W_]+)*", re.I)
_VERSION = re.compile(r"(a?gpl|lgpl|mpl|epl|)v?(\d+(?:\.\d+)*?)(?:\.0)*")


def _parameters():
    """Level 12 with matches of three bytes or more: at lower levels short namings save nothing."""
    import zstandard as zstd

    return zstd.ZstdCompressionParameters.from_level(12, source_size=1024, min_match=3, write_content_size=False, write_dict_id=False)


class Wording:
    """One wording of a template: its words, those that must not be lacked, and how many may be lacked and added."""

    def __init__(self, text: str):
        self.words = wording(text)
        self.counts = Counter(self.words)
        self.keys = {w for w in self.words if w in NAME_WORDS or any(map(str.isdigit, w))}
        self.lacks = len(self.words) - -(-MIN_WORDING_PCT * len(self.words) // 100)
        self.adds = max(2, len(self.words) // 5) if len(self.words) > 4 else 0

    def confirmed(self, words: list[str], ids: np.ndarray, number: dict[str, int], have: Counter) -> Iterator[tuple]:
        """(first, last, words held, words lacked, words added) of each place that holds the wording."""
        if not self.keys <= have.keys():
            return
        if sum(min(n, have[w]) for w, n in self.counts.items()) < len(self.words) - self.lacks:
            return
        for pairs in matches(ids, [number.get(w, -1) for w in self.words], self.lacks + self.adds):
            first, last = pairs[0][0], pairs[-1][0] + 1
            kept, inside = {b for _, b in pairs}, {a for a, _ in pairs}
            lacks = [w for i, w in enumerate(self.words) if i not in kept]
            adds = [words[i] for i in range(first, last) if i not in inside]
            if not (len(lacks) > self.lacks or len(adds) > self.adds or self.keys & set(lacks) or (NAME_WORDS - COMMON) & set(adds)):
                yield first, last, len(pairs), lacks, adds


class Template:
    """A licence: its wordings, and a compressor whose dictionary they are."""

    def __init__(self, name: str, texts: Iterable[str]):
        import zstandard as zstd

        self.name, self.wordings = name, [Wording(text) for text in texts]
        short_last = "\n".join(sorted(texts, key=len, reverse=True))  # what is near costs least to point at
        known = zstd.ZstdCompressionDict(short_last.lower().encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=_parameters())
        self.compress = zstd.ZstdCompressor(dict_data=known, compression_params=_parameters()).compress


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text and where each lies: lower case, 'v2.0' and '2.0' as '2', 'gplv3' as 'gpl' and '3'."""
    words, seats = [], []
    for m in _WORD.finditer(text):
        word = m[0].lower()
        version = _VERSION.fullmatch(word) if word[-1].isdigit() else None
        words += [x for x in version.groups() if x] if version else [word.replace("-", "")]
        seats += [m.span()] * (len(words) - len(seats))
    return words, seats


def wording(text: str) -> list[str]:
    return words_at(text)[0]


@lru_cache(maxsize=1)
def templates() -> tuple[Template, ...]:
    return tuple(Template(name, texts) for name, texts in TEMPLATES.items())


@lru_cache(maxsize=1)
def _plain():
    import zstandard as zstd

    return zstd.ZstdCompressor(compression_params=_parameters()).compress


def reductions(text: str, among: Iterable[Template]) -> tuple[int, list[int]]:
    """Compressed bytes of a text, and how many of them each template's dictionary saves, piece by piece."""
    pieces = [(LEAD + text[at:at + PIECE].lower()).encode("utf-8", "surrogatepass") for at in range(0, len(text), PIECE)]
    plain = [len(_plain()(raw)) for raw in pieces]
    return sum(plain), [sum(n - len(t.compress(raw)) for n, raw in zip(plain, pieces)) for t in among]


def cues(text: str) -> Iterator[re.Match]:
    """The matches of CUE, tried only where the letters of one stand: a search at every character takes ten times as long."""
    low = text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()  # as the pattern takes them; no length changes
    starts = set()
    for letters, before in ANCHORS:
        at = low.find(letters)
        while at >= 0:
            starts.update(range(max(0, at - before), at + 1))
            at = low.find(letters, at + 1)
    end = 0
    for at in sorted(starts):
        if at >= end and (m := _CUE.match(text, at)):
            yield m
            end = m.end()


def blocks(text: str, cue) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks: the paragraph of each cue, neighbouring paragraphs with cues joined.

    A paragraph ends at a line without letters and digits, so comment marks do
    not hold it together.  Of a longer one, REACH characters before and after
    each cue are taken, cut at white space; what overlaps is one block.
    """
    found: list[list[int]] = []
    low = high = -1  # the paragraph of the cue before
    for m in cue(text):
        first, last = m.span()
        if not low <= first < high:
            low, high = _paragraph(text, first)
        start, end = max(low, first - REACH), max(last, min(high, last + REACH))
        while start > low and not text[start - 1].isspace():
            start -= 1
        while end < high and not text[end].isspace():
            end += 1
        if found and (start <= found[-1][1] or not _SAID.search(text, found[-1][1], start)):
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def _paragraph(text: str, at: int) -> tuple[int, int]:
    """The lines around a place up to the next ones without letters and digits."""
    start = text.rfind("\n", 0, at) + 1
    while start:
        before = text.rfind("\n", 0, start - 1) + 1
        if not _SAID.search(text, before, start):
            break
        start = before
    end = text.find("\n", at)
    while end >= 0:
        after = text.find("\n", end + 1)
        if not _SAID.search(text, end, len(text) if after < 0 else after):
            break
        end = after
    return start, len(text) if end < 0 else end


def _row(row: np.ndarray, same: np.ndarray, i: int) -> np.ndarray:
    """Next row of the least numbers of words lacked and added, a match being free; a match may start anywhere."""
    new = row + 1
    np.minimum(new[1:], np.where(same, row[:-1], row[:-1] + 2), out=new[1:])
    new[0] = i
    steps = np.arange(len(new), dtype=np.int32)
    return np.minimum.accumulate(new - steps) + steps


def matches(ids: np.ndarray, wanted: list[int], cost: int) -> Iterator[list[tuple[int, int]]]:
    """Alignments of ``wanted`` with parts of ``ids`` that lack and add ``cost`` words or fewer, apart from each other, best first.

    An alignment is its pairs (place in ids, place in wanted), both rising.
    """
    row = np.zeros(len(ids) + 1, np.int32)
    for i, w in enumerate(wanted, 1):
        row = _row(row, ids == w, i)
    ends = np.flatnonzero((row[1:] <= cost) & np.isin(ids, wanted)) + 1
    taken = np.zeros(len(ids) + 1, bool)
    for end in ends[np.argsort(row[ends], kind="stable")].tolist():
        low = max(0, end - len(wanted) - cost)
        used = np.flatnonzero(taken[low:end])
        low += int(used[-1]) + 1 if len(used) else 0
        if low >= end:
            continue
        part = ids[low:end]
        rows = [np.zeros(len(part) + 1, np.int32)]
        for i, w in enumerate(wanted, 1):
            rows.append(_row(rows[-1], part == w, i))
        i, j, pairs = len(wanted), len(part), []
        while i and j:
            if part[j - 1] == wanted[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
                i, j = i - 1, j - 1
                pairs.append((low + j, i))
            elif rows[i][j] == rows[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        if pairs and pairs[0][0] == end - 1:
            yield pairs[::-1]
            taken[pairs[-1][0]:end] = True


#: An SPDX tag and its expression; what follows WITH is an exception, no licence.
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*((?:\([ \t]*)*[\w.+-]+(?:[ \t)]+(?:AND|OR|WITH)[ \t]+(?:\([ \t]*)*[\w.+-]+)*)", re.I)
_IDENTIFIER = re.compile(r"(?:\b(WITH)[ \t]+)?([\w.+-]+)", re.I)
_SUFFIX = re.compile(r"(.+?)(-only|-or-later|\+)?\.?", re.I)


def tagged(block: str) -> tuple[list[tuple[int, int]], list[tuple[str, str, int, int]]]:
    """The spans of the SPDX tags, and (template, licence as written, start, end) of each identifier; a tag's first one begins with it."""
    tags, found = [], []
    known = {name.lower(): name for name in TEMPLATES}
    for tag in _TAG.finditer(block):
        tags.append(tag.span())
        start = tag.start()
        for m in _IDENTIFIER.finditer(block, *tag.span(1)):
            if m[1] or m[2].upper() in ("AND", "OR"):
                continue
            stem, suffix = _SUFFIX.fullmatch(m[2]).groups()
            if name := known.get(stem.lower()):
                suffix = (suffix or "").lower().replace("+", "-or-later")
                found.append((name, name + suffix, start, m.end(2) - m[2].endswith(".")))
            start = m.end()
    return tags, found


def negated(block: str, words: list[str], seats: list[tuple[int, int]], first: int) -> bool:
    """Whether the same sentence says not, never, nor or no longer just before a word; 'not only' negates nothing."""
    for i in range(first - 1, max(-1, first - 1 - NEGATED_WITHIN), -1):
        if re.search(r"[.!?;](?:\s|$)|\n\W*\n", block[seats[i][1]:seats[i + 1][0]]):
            return False
        word, after = words[i], words[i + 1]
        if word in ("not", "never", "nor") or word.endswith(("n't", "n’t")):
            return after != "only"
        if word == "no" and after == "longer":
            return True
    return False


@lru_cache(maxsize=4096)
def _place(text: str) -> list[int]:
    return reductions(text, templates())[1]


def rank(block: str) -> tuple[int, list[tuple[int, Template]]]:
    """Compressed bytes of a block, and (bytes saved, template) of the candidates, the largest reduction first."""
    plain, saved = reductions(block, templates())
    for m in _CUE.finditer(block):
        saved = list(map(max, saved, _place(block[max(0, m.start() - NEAR):m.end() + NEAR])))
    found = sorted((-n, i) for i, n in enumerate(saved) if n >= MIN_SAVING)
    return plain, [(-n, templates()[i]) for n, i in found]


def judge(block: str) -> list[tuple]:
    """(name, start, end, saving_pct, wording_pct, differences) of the confirmed templates that do not overlap, in order."""
    plain, ranked = rank(block)
    if not ranked:
        return []
    share = {t.name: min(100, 100 * n // plain) for n, t in ranked}
    tags, said = tagged(block)
    kept = [(licence, start, end, share[name], 100, "") for name, licence, start, end in said if name in share]
    words, seats = words_at(block)
    have = Counter(words)
    number = {w: i for i, w in enumerate(have)}
    ids = np.array([number[w] for w in words], np.int32)
    for i, (start, end) in enumerate(seats):  # words of a tag are no wording
        while tags and tags[0][1] <= start:
            tags.pop(0)
        if tags and tags[0][0] < end:
            ids[i] = -2
    found = []
    for at, (_, t) in enumerate(ranked):
        for w in t.wordings:
            for first, last, held, lacks, adds in w.confirmed(words, ids, number, have):
                if len(w.words) > NAMING or not negated(block, words, seats, first):
                    found.append((first, last, at, held, 100 * held // len(w.words), lacks, adds))
    for group in _overlapping(sorted(found, key=lambda x: x[:3])):
        kept += _winners(block, seats, [t for _, t in ranked], group, share)
    return sorted(kept, key=lambda x: x[1])


def _overlapping(found: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of matches that overlap, of matches in the order of their first words."""
    group, high = [], 0
    for match in found:
        if group and match[0] >= high:
            yield group
            group = []
        group.append(match)
        high = max(high, match[1]) if len(group) > 1 else match[1]
    if group:
        yield group


def _winners(block: str, seats: list[tuple[int, int]], ranked: list[Template], group: list[tuple], share: dict) -> Iterator[tuple]:
    """The matches of a group that stay: by reduction of the group's text less the weight of differing words, then by words held."""
    names = sorted({match[2] for match in group})
    weight = dict.fromkeys(names, 0)
    if len(names) > 1:
        text = block[seats[group[0][0]][0]:seats[max(match[1] for match in group) - 1][1]]
        saved = dict(zip(names, reductions(text, [ranked[i] for i in names])[1]))
        for i in names:
            weight[i] = max(saved[i] - DIFFERENCE * (len(m[5]) + len(m[6])) for m in group if m[2] == i)
    taken: list[tuple[int, int]] = []
    for first, last, rank, _, wording_pct, lacks, adds in sorted(group, key=lambda m: (-weight[m[2]], m[2], -m[3], m[0])):
        if any(first < b and a < last for a, b in taken):
            continue
        taken.append((first, last))
        start, end = seats[first][0], seats[last - 1][1]
        while end < len(block) and not block[end].isspace() and not _SAID.match(block[end]):
            end += 1
        name = ranked[rank].name
        yield name, start, end, share[name], wording_pct, " ".join([*("-" + w for w in lacks), *("+" + w for w in adds)])


def _start():
    known: dict[str, list[tuple]] = {}

    def step(text: str) -> tuple:
        found, spans = [], blocks(text, cues)
        for start, end in spans:
            block = text[start:end]
            if block not in known:
                known[block] = judge(block)
            for name, a, b, *rest in known[block]:
                found.append({"license": name, "start": start + a, "end": start + b, "saving_pct": rest[0],
                              "wording_pct": rest[1], "differences": rest[2]})
        return len(spans), sorted({x["license"] for x in found}), found

    return step


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep`` and those of SCHEMA."""
    require(docs, text, *keep)
    return (docs.select(F.struct(*keep).alias("k"), text_udf(_start, SCHEMA)(F.col(text)).alias("r")).select("k.*", "r.*"))
