"""License scans by conditional compression.

Around each word that names a license, candidate blocks start at the sentence, at the template's own first word, and where the
template's word for the sign falls on the sign. For each template, a block is taken as many words long as the template (and an
eighth more), across lines; one with too few of the template's words cannot be confirmed and is left. The others are compressed
twice with zstandard: alone, and with the template as raw dictionary. The bytes that a template saves rank the candidates; the wording only confirms: going down the ranks,
the first one stays whose block with the fewest differences confirms it: the exact differences (words of the template that the block lacks, words that it adds) must be few and leave the words alone that tell licences apart. These are the version
in the licence's name, qualifiers such as Lesser, Affero or NonCommercial, and the words that a template has over those of licences with nearly the same text (and these over it).

Short licences are compared to the end of their full text, so ``exact`` says that all their clauses agree; of long ones
(Apache, GPL, MPL, Creative Commons) the notices are compared. An opening without its clauses is reported, never as exact.

Defined results: null and blank texts have no blocks; several blocks of a document are all reported, and none
shares words with another; equal savings go to the template with fewer differences, then to the first by name; a licence that is in no template is
not reported under the name of another;
repeated rows are scanned alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.common import chunks, worker_state

# Openings and conditions of full licence texts.
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
MIT_OPENING = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
ISC_OPENING = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
UNLICENSE_OPENING = "This is free and unencumbered software released into the public domain."
# The wording of common license notices, and the full texts of the short licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
                   'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", f"{BSD_OPENING} 1. {BSD_SOURCE} 2. {BSD_BINARY} {BSD_DISCLAIMER}"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", f"{BSD_OPENING} 1. {BSD_SOURCE} 2. {BSD_BINARY} 3. {BSD_NAMES} {BSD_DISCLAIMER}"],
    **{f"CC-BY{short}-4.0": [f"Licensed under CC BY{short} 4.0.", f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License."]
       for short, long in (("", ""), ("-NC", "-NonCommercial"), ("-NC-ND", "-NonCommercial-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-ND", "-NoDerivatives"), ("-SA", "-ShareAlike"))},
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    **{name: [f"This work is licensed under the GNU {kind} General Public License, version {version}.",
              f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version."]
       for name, kind, version, what, mark, stop in (("AGPL-3.0", "Affero", "3", "program", ":", ","), ("LGPL-2.1", "Lesser", "2.1", "library", ";", ";"), ("LGPL-3.0", "Lesser", "3", "library", ":", ","))},
    "ISC": [ISC_OPENING + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "MIT": ["Released under the MIT License.",
            MIT_OPENING + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": [UNLICENSE_OPENING + ' Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
}
# How licences are named in identifiers and in short.
for _name in TEMPLATES:
    _gnu = re.match(r"([AL]?GPL)-(\d)(?:\.0)?(\.\d)?$", _name)
    TEMPLATES[_name] += [f"SPDX-License-Identifier: {_name}{end}" for end in (("", "-only", "-or-later") if _gnu else ("",))] + ([f"under the {_gnu[1]}v{_gnu[2]}{_gnu[3] or ''}"] if _gnu else [])
#: Words that make another licence of one, wherever they are added.
QUALIFIERS = frozenset("affero lesser library documentation noncommercial noderivatives noderivs sharealike nc nd sa clear patent".split())
#: Openings whose later clauses are missing or other than in any full text: never exact. The BSD licences share theirs.
OPENINGS = {"BSD": [BSD_OPENING], "ISC": [ISC_OPENING], "MIT": [MIT_OPENING], "Unlicense": [UNLICENSE_OPENING]}
SIGNS = r"(?i)licen[sc]e|licensed|copyright|permission (?:is hereby granted|to use)|redistribution and use|public domain|free software|applicable law or agreed|\bunder the [al]?gplv\d"
#: A winner saves at least this share of a block's bytes and differs in at most this share of the template's words.
LEAST_GAIN, MOST_CHANGED, LEVEL = 0.3, 0.2, 3
WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
FOUND = "array<struct<line:long,license:string,gain:double,missing:long,added:long,exact:boolean>>"


def normal(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def compressors() -> list[tuple]:
    """license, words of a template, whether it is all of the licence or notice, its compressor; the words that tell it from others; and the
    compressor without dictionary. Made once a worker."""
    import zstandard as z

    state = worker_state()
    if "licenses" not in state:
        how = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False) if hasattr(z, "ZstdCompressionParameters") else {}
        params = z.ZstdCompressionParameters.from_level(how.pop("level"), **how)
        rows = []
        for whole, texts in ((True, TEMPLATES), (False, OPENINGS)):
            for name, t in ((name, t) for name in sorted(texts) for t in texts[name]):
                w = normal(t)
                rows.append((name, w, whole, z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(" ".join(w).encode(), dict_type=z.DICT_TYPE_RAWCONTENT))))
        state["licenses"] = (rows, telling(rows), z.ZstdCompressor(compression_params=params))
    return state["licenses"]


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that are missing, words added between its first and last word, and the part of the block used."""
    same = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return template, [], 0, 0
    missing, added, a, b = [], [], 0, same[0].b
    for m in same:
        missing += template[a: m.a]
        added += block[b: m.b]
        a, b = m.a + m.size, m.b + m.size
    return missing + template[a:], added, same[0].b, b


def telling(rows: list[tuple]) -> list[tuple[set[str], list[tuple[set[str], set[str]]]]]:
    """For each template the words for its licence's version, and for each other licence of nearly the same text the words
    that only the one or only the other has."""
    out = []
    for name, w, whole, _ in rows:
        version = re.search(r"-(\d+)\.(\d+)$", name)
        words = {f"{version[1]}.{version[2]}", *([version[1]] if version[2] == "0" else [])} & set(w) if version else set()
        near = []
        for other, v, full, _ in rows:
            common = sum((Counter(w) & Counter(v)).values())
            if other != name and whole and full and common >= 0.6 * max(len(w), len(v)):
                near.append((set(w) - set(v), set(v) - set(w)))
        out.append((words, near))
    return out


def agrees(template: list[str], missing: list[str], added: list[str], version: set[str], near: list[tuple[set[str], set[str]]]) -> bool:
    """Do the words that tell a licence from others agree?"""
    parts = {p for w in template for p in w.split("-")}
    if any(p in QUALIFIERS and p not in parts for w in added for p in w.split("-")) or any(p in QUALIFIERS for w in missing for p in w.split("-")):
        return False
    if version and version <= set(missing):
        return False
    return all(2 * len(own & set(missing)) < max(1, len(own)) + (not own) and 2 * len(theirs & set(added)) < max(1, len(theirs)) + (not theirs) for own, theirs in near)


def find_licenses(text: str, every_start: bool = False) -> list[dict]:
    """All confirmed blocks of one text; with ``every_start`` blocks from every word are tried (for tests)."""
    rows, marks, plain = compressors()
    words, begins, ends, same = [], array("q"), array("q"), {}
    places: dict[str, list[int]] = {template[0]: [] for _, template, _, _ in rows}
    for i, m in enumerate(WORDS.finditer(text)):
        w = m.group().lower()
        words.append(same.setdefault(w, w))
        begins.append(m.start()), ends.append(m.end())
        if w in places:
            places[w].append(i)
    bags = [Counter(template) for _, template, _, _ in rows]
    stops = array("q", (m.end() for m in re.finditer(r"[.!?]\s+|\n", text)))
    found, done, failed = [], 0, set()

    def judge(r: int, start: int):
        name, template, whole, packer = rows[r]
        n = len(template)
        block = words[start: start + n + n // 8]
        have = Counter(block)
        if sum(min(v, have[w]) for w, v in bags[r].items()) < n - MOST_CHANGED * n:
            return None
        raw = " ".join(block).encode()
        alone = len(plain.compress(raw))
        saved = alone - len(packer.compress(raw))
        if saved < LEAST_GAIN * alone:
            return None
        lost, more, first, used = differences(template, block)
        missing, added = len(lost), len(more)
        if missing + added > MOST_CHANGED * n or not agrees(template, lost, more, *marks[r]):
            return None
        row = {"line": text.count("\n", 0, begins[start + first]), "license": name, "gain": round(saved / alone, 6), "missing": missing, "added": added, "exact": whole and missing + added == 0}
        return (missing + added, -saved, -start), row, start + used, (-saved, missing + added, name)

    for sign in re.finditer(SIGNS, text):
        k = bisect_right(ends, sign.start())
        before = bisect_right(stops, sign.start())
        sentence = bisect_left(begins, stops[before - 1]) if before else 0
        while done <= k < len(words):
            best = None
            for r, (_, template, _, _) in enumerate(rows):
                own = None  # the template's block with the fewest differences
                at, least = places[template[0]], max(done, k - len(template) - len(template) // 8 + 1)
                starts = {sentence, *at[bisect_left(at, least): bisect_right(at, k)], *(k - j for j, w in enumerate(template) if w == words[k])}
                for start in range(least, k + 1) if every_start else starts:
                    if done <= start <= k and (r, start) not in failed:
                        got = judge(r, start)
                        if got is None:
                            failed.add((r, start))
                        elif own is None or got[0] < own[0]:
                            own = got
                if own is not None and (best is None or own[3] < best[3]):
                    best = own
            if best is None:
                break
            found.append(best[1])
            done = best[2]
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found (the confirmed blocks in order) for every row; only texts that name a license leave the JVM."""

    def apply(batches):
        kind = pa.list_(pa.struct([("line", pa.int64()), ("license", pa.string()), ("gain", pa.float64()), ("missing", pa.int64()), ("added", pa.int64()), ("exact", pa.bool_())]))
        for t in chunks(batches):
            found = [find_licenses(x) if x else [] for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(SIGNS), F.col("text")).alias("text")).mapInArrow(apply, f"doc_id long, found {FOUND}")


def blocks(docs: DataFrame) -> DataFrame:
    """One row for each confirmed block."""
    return scan(docs).select("doc_id", F.inline("found"))


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, licenses (names, ascending, joined by commas), best_gain, all_exact; one row for each document."""
    return scan(docs).select("doc_id", F.size("found").cast("long").alias("n_blocks"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
                             F.coalesce(F.array_max("found.gain"), F.lit(0.0)).alias("best_gain"), F.forall("found", lambda x: x["exact"]).alias("all_exact"))
