"""License scans by conditional compression.

The words of a paragraph, a run of lines between those without letters and digits,
are cut to blocks around the words that licenses speak of, over line ends. Each block
is compressed with zstandard alone and with the template of every license as raw
dictionary, and the licenses are ranked by the bytes that their templates save. In
that order they are tried by the exact wording: every word of a template sentence must
stand there in its order, but for a bounded number of differences, none of them in the
telling words. Where several licenses share what tells them, as those of one family
do, the first in rank that the wording confirms is taken. No bound on the saving drops
any.

Spellings that differ by custom alone count as one word: licence, version and v, and
the short names of the public licenses.

Defined results: a null or empty text has no blocks; a notice over several lines
counts for the line where it starts; a line has one row, the best fit, for each
license, and as many licenses as it has notices; equal savings are ranked by license
name; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import pieces

#: Public notices by license, each with the words that must match exactly.
TEMPLATES: dict[str, list[tuple[str, str]]] = {
    "0BSD": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided \"as is\" and the author disclaims all warranties with regard to this software", "permission to use copy modify and or distribute this software"), ("SPDX-License-Identifier: 0BSD", "license identifier 0bsd")],
    "AGPL-3.0": [("GNU AGPL version 3", "gnu agpl version 3"), ("License: AGPL-3.0", "license agpl 3 0"), ("GNU Affero General Public License version 3", "affero general public license version 3"), ("SPDX-License-Identifier: AGPL-3.0", "identifier agpl 3 0"), ("GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", "gnu affero general public license as published by the free software foundation either version 3 of"), ("GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License", "gnu affero general public license as published by the free software foundation version 3")],
    "Apache-2.0": [("Apache License, Version 2.0", "apache license version 2 0"), ("Apache-2.0", "apache 2 0"), ("Licensed under the Apache License, Version 2.0.", "apache license version 2 0"), ("SPDX-License-Identifier: Apache-2.0", "apache 2 0"), ("Apache License 2.0", "apache license 2 0")],
    "BSD-2-Clause": [("Licensed under the BSD 2-Clause License.", "bsd 2 clause"), ("SPDX-License-Identifier: BSD-2-Clause", "bsd 2 clause"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties", "redistribution and use in source and binary forms")],
    "BSD-3-Clause": [("Licensed under the BSD 3-Clause License.", "bsd 3 clause"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution and use in source and binary forms"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd 3 clause"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistribution and use in source and binary forms")],
    "BSL-1.0": [("Boost Software License, Version 1.0", "boost software license version 1 0"), ("Boost Software License 1.0", "boost software license 1 0"), ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby granted free of charge to any person or organization obtaining"), ("SPDX-License-Identifier: BSL-1.0", "license identifier bsl 1 0")],
    "CC-BY-4.0": [("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0"), ("Licensed under CC BY 4.0", "cc by 4 0"), ("SPDX-License-Identifier: CC-BY-4.0", "license identifier cc by 4 0")],
    "CC-BY-NC-4.0": [("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "attribution noncommercial 4 0"), ("Licensed under CC BY-NC 4.0", "cc by nc 4 0"), ("SPDX-License-Identifier: CC-BY-NC-4.0", "license identifier cc by nc 4 0")],
    "CC-BY-SA-4.0": [("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "attribution sharealike 4 0"), ("Licensed under CC BY-SA 4.0", "cc by sa 4 0"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "license identifier cc by sa 4 0")],
    "CC0-1.0": [("To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal", "cc0 1 0"), ("SPDX-License-Identifier: CC0-1.0", "license identifier cc0 1 0")],
    "EPL-2.0": [("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public license 2 0"), ("SPDX-License-Identifier: EPL-2.0", "license identifier epl 2 0")],
    "GPL-2.0": [("GNU General Public License version 2", "gnu general public license version 2"), ("License: GPL-2.0", "license gpl 2 0"), ("Licensed under the GNU General Public License version 2.", "gnu general public license version 2"), ("SPDX-License-Identifier: GPL-2.0", "identifier gpl 2 0"), ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gnu general public license as published by the free software foundation either version 2 of"), ("GNU General Public License as published by the Free Software Foundation, version 2 of the License", "gnu general public license as published by the free software foundation version 2")],
    "GPL-3.0": [("GNU General Public License version 3", "gnu general public license version 3"), ("License: GPL-3.0", "license gpl 3 0"), ("Licensed under the GNU General Public License version 3.", "gnu general public license version 3"), ("SPDX-License-Identifier: GPL-3.0", "identifier gpl 3 0"), ("GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", "gnu general public license as published by the free software foundation either version 3 of"), ("GNU General Public License as published by the Free Software Foundation, version 3 of the License", "gnu general public license as published by the free software foundation version 3")],
    "ISC": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"), ("Licensed under the ISC License.", "isc license"), ("SPDX-License-Identifier: ISC", "license identifier isc"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software")],
    "LGPL-2.1": [("GNU Lesser General Public License version 2.1", "lesser general public license version 2 1"), ("SPDX-License-Identifier: LGPL-2.1", "identifier lgpl 2 1"), ("License: LGPL-2.1", "license lgpl 2 1"), ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "gnu lesser general public license as published by the free software foundation either version 2 1 of"), ("GNU Lesser General Public License as published by the Free Software Foundation, version 2.1 of the License", "gnu lesser general public license as published by the free software foundation version 2 1")],
    "LGPL-3.0": [("GNU Lesser General Public License version 3", "lesser general public license version 3"), ("SPDX-License-Identifier: LGPL-3.0", "identifier lgpl 3 0"), ("License: LGPL-3.0", "license lgpl 3 0"), ("GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", "gnu lesser general public license as published by the free software foundation either version 3 of"), ("GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License", "gnu lesser general public license as published by the free software foundation version 3")],
    "MIT": [("Released under the MIT License.", "mit license"), ("Licensed under the MIT License.", "mit license"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"), ("SPDX-License-Identifier: MIT", "spdx license identifier mit"), ("or the MIT License", "or the mit license"), ("and the MIT License", "and the mit license"), ("MIT License or", "mit license or"), ("MIT OR Apache", "mit or apache"), ("Apache-2.0 OR MIT", "2 0 or mit"), ("License: MIT", "license mit")],
    "MPL-2.0": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license v 2 0"), ("Mozilla Public License 2.0", "mozilla public license 2 0"), ("Mozilla Public License, version 2.0", "mozilla public license version 2 0"), ("SPDX-License-Identifier: MPL-2.0", "license identifier mpl 2 0")],
    "Unlicense": [("This is free and unencumbered software released into the public domain.", "unencumbered software released into the public domain"), ("SPDX-License-Identifier: Unlicense", "license identifier unlicense")],
    "Zlib": [("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "permission is granted to anyone to use this software for any purpose"), ("Licensed under the zlib License.", "zlib license"), ("SPDX-License-Identifier: Zlib", "license identifier zlib")],
    "all-rights-reserved": [("Copyright. All rights reserved.", "all rights reserved")],
}
#: Every telling phrase holds one of these, or words that _OTHERS finds.
_MENTIONS = ("license", "licence", "gpl", "apache", "clause", "redistribution", "attribution", "permission", "unencumbered", "reserved")
_OTHERS = re.compile(r"(?<![a-z])(?:cc[^a-z0-9]+by|cc[^a-z0-9]*0|or[^a-z0-9]+mit)")
#: The same as words: blocks are cut around them.
_ANCHORS = frozenset({"license", "apache", "clause", "redistribution", "attribution", "cc", "permission", "unencumbered", "reserved", "mit"})
#: A block serves the anchors of so many words, and holds so many before and behind these; a longer template is ranked by a part of it.
SERVED, BEFORE, BEHIND = 16, 30, 130
#: Share of a template sentence's words that may differ.
MAX_DIFFERENT = 0.3
_WORD = re.compile(r"[a-z]+|[0-9]+")
#: Words that stand for others.
_SAME = {"licence": "license", "version": "v", "gpl": "general public license", "lgpl": "lesser general public license", "agpl": "affero general public license"}
_SAME |= {f"{k}v": f"{_SAME[k]} v" for k in ("gpl", "lgpl", "agpl")}


def _words(text: str) -> list[str]:
    return [w for x in _WORD.findall(text.lower()) for w in _SAME.get(x, x).split()]


@cache
def _dictionaries() -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for name, notices in TEMPLATES.items():
        raw = "\n".join(text for text, _ in notices).lower().encode()
        out[name] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
    return out


@cache
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False)


def saving(block: str, name: str) -> tuple[int, float]:
    """Bytes by which a license's template reduces the block's compressed size, and their share of it."""
    raw = block.encode("utf-8", "surrogatepass")
    alone = len(_alone().compress(raw))
    saved = alone - len(_dictionaries()[name].compress(raw))
    return saved, saved / alone


@lru_cache(4096)
def ranking(block: str) -> dict[str, int]:
    """Bytes by which each license's template reduces the block's compressed size, most first, then by name."""
    raw = block.encode("utf-8", "surrogatepass")
    alone = len(_alone().compress(raw))
    saved = {name: alone - len(given.compress(raw)) for name, given in _dictionaries().items()}
    return dict(sorted(saved.items(), key=lambda x: (-x[1], x[0])))


@cache
def _notices() -> list[tuple[str, list[str], str, int]]:
    """License, words, telling words between blanks, and the place of these in the words, of every notice."""
    out = []
    for name, notices in sorted(TEMPLATES.items()):
        for text, telling in notices:
            words, told = _words(text), f" {' '.join(_words(telling))} "
            out.append((name, words, told, f" {' '.join(words)} ".index(told)))
    return [(name, words, told, f" {' '.join(words)} ".count(" ", 0, at)) for name, words, told, at in out]


@cache
def _by_license() -> dict[str, list[tuple[list[str], str, int, int]]]:
    """Words, telling words, their place and that of the first anchor in them, of every license's notices."""
    out: dict[str, list[tuple[list[str], str, int, int]]] = {}
    for name, wanted, telling, place in _notices():
        anchor = next(i for i, w in enumerate(telling.split()) if w in _ANCHORS)
        out.setdefault(name, []).append((wanted, telling, place, anchor))
    return out


@cache
def _longest() -> int:
    return max(len(telling.split()) for _, _, telling, _ in _notices())


def paragraphs(low: str) -> Iterator[list[tuple[str, int, int]]]:
    """The words of each run of lines that hold any, each with its start and end."""
    held: list[tuple[str, int, int]] = []
    for m in _WORD.finditer(low):
        # Two line ends without a word between: marks of comments alone don't join.
        if held and low.count("\n", held[-1][2], m.start()) > 1:
            yield held
            held = []
        held += [(w, m.start(), m.end()) for w in _SAME.get(m[0], m[0]).split()]
    if held:
        yield held


def confirm(words: list[str], wanted: list[str], at: int, place: int) -> tuple[int, int, int] | None:
    """Words missing, first and last word taken by the notice whose telling words, number ``place`` in it, stand at ``at``."""
    slack = len(wanted) // 2 + 2
    start = max(0, at - place - slack)
    block = words[start : at - place + len(wanted) + slack]
    same = [m for m in difflib.SequenceMatcher(None, wanted, block, autojunk=False).get_matching_blocks() if m.size]
    missing = len(wanted) - sum(m.size for m in same)
    if missing > MAX_DIFFERENT * len(wanted):
        return None
    return missing, start + same[0].b, start + same[-1].b + same[-1].size - 1


def blocks(words: list[str]) -> Iterator[tuple[int, int]]:
    """First word and end of the stretches whose anchors have a block of their own."""
    end = 0
    for i, word in enumerate(words):
        if i >= end and word in _ANCHORS:
            end = min(i + SERVED, len(words))
            yield i, end


def candidates(low: str, paragraph: list[tuple[str, int, int]], words: list[str]) -> Iterator[tuple[int, int, str, int, list[str], int]]:
    """First and last telling word, license, bytes saved, words and place, of every license in a block's ranking whose telling words stand there."""
    for begin, end in blocks(words):
        ranked = ranking(low[paragraph[max(0, begin - BEFORE)][1] : paragraph[min(len(words), end + BEHIND) - 1][2]])
        start = max(0, begin - _longest())
        spelled = f" {' '.join(words[start : end + _longest()])} "
        for name, saved in ranked.items():
            for wanted, telling, place, anchor in _by_license()[name]:
                at = spelled.find(telling)
                while at >= 0:
                    first = start + spelled.count(" ", 0, at)
                    if begin <= first + anchor < end:
                        yield first, first + telling.count(" ") - 2, name, saved, wanted, place
                    at = spelled.find(telling, at + 1)


def _overlapping(hits: Iterator[tuple[int, int, str, int, list[str], int]]) -> Iterator[list[tuple[int, int, str, int, list[str], int]]]:
    """Hits (first and last telling word, …) in groups whose telling words overlap."""
    group, last = [], -1
    for hit in sorted(hits, key=lambda h: h[:2]):
        if group and hit[0] > last:
            yield group
            group = []
        group.append(hit)
        last = max(last, hit[1]) if len(group) > 1 else hit[1]
    if group:
        yield group


def scan_text(text: str | None) -> list[tuple[int, str, float, int, int]]:
    """(line, license, reduction, words missing, words of the notice) of every confirmed notice."""
    low = (text or "").lower()
    if not any(m in low for m in _MENTIONS) and not _OTHERS.search(low):
        return []
    best: dict[tuple[int, str], tuple[int, int, float, int]] = {}
    for paragraph in paragraphs(low):
        words = [w for w, _, _ in paragraph]
        for group in _overlapping(candidates(low, paragraph, words)):
            taken: list[tuple[int, int, str]] = []
            for first, last, name, _, wanted, place in sorted(group, key=lambda h: (-h[3], h[2], *h[:2])):
                # Words that tell one license aren't another's, unless each has words of its own.
                if any(not (last < a or first > b) and other != name and not (first < a or last > b) for a, b, other in taken):
                    continue
                fit = confirm(words, wanted, first, place)
                if not fit:
                    continue
                taken.append((first, last, name))
                missing, start, stop = fit
                at = paragraph[start][1]
                key = (low.count("\n", 0, at), name)
                saved, share = saving(low[at : paragraph[stop][2]], name)
                if key not in best or (missing, -saved) < best[key][:2]:
                    best[key] = (missing, -saved, round(share, 6), len(wanted))
    found = sorted((line, less, name, share, missing, n) for (line, name), (missing, less, share, n) in best.items())
    return [(line, name, share, missing, n) for line, _, name, share, missing, n in found]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch, "text"):
            found = [(i, *hit) for i, t in enumerate(texts) for hit in scan_text(t)]
            cols = [[f[k] for f in found] for k in range(6)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32())],
                ["doc_id", "line", "license", "reduction", "n_missing", "n_notice"],
            )


def scan(df: DataFrame) -> DataFrame:
    """(doc_id, line, license, reduction, n_missing, n_notice): a row for each notice found."""
    return df.select("doc_id", "text").mapInArrow(_run, "doc_id long, line int, license string, reduction double, n_missing int, n_notice int")
