"""Licence scan: MinHash bands over overlapping windows retrieve templates, containment verifies.

Texts and templates are lower-cased words (runs of ASCII letters and digits and of any character
beyond ASCII); a shingle is five consecutive words. Templates fall into classes by their number of
shingles, rounded up to a power of two, L. A text is covered by windows of 2 L shingles that begin
every L, so a copy of a template of the class lies whole in one of them. A window that contains at
least CONTAINED of a template's shingles has a Jaccard similarity to it of at least

    CONTAINED * s / (2 L + (1 - CONTAINED) * s)     for s shingles, L / 2 < s <= L,

and with one MinHash value to a band, B bands miss it with probability (1 - similarity) ** B. Each
class takes as many bands as bring that below MISSED. Retrieved pairs are then verified on the
shingles themselves.

Templates are few and fixed; they go to every task, and their size is checked.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE, CONTAINED, MISSED, SEED = 5, 0.8, 1e-6, 1
#: Largest size of all templates together, in characters.
TEMPLATE_CHARS = 4 << 20
DOCS_AT_ONCE = 256

# Public licences, as short mentions, as the notices that files carry, and whole where a
# licence is short. Longer licences are known by their notices and by passages of their own.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "MIT-text": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-text": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "BSD-3-Clause-clause": """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "ISC-text": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to
use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-dedication": """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.""",
    "BSL-1.0-grant": """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce,
display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,
and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
part, and all derivative works of the Software, unless such copies or derivative works are solely in the
form of machine-executable object code generated by a source language processor.""",
    "0BSD-text": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "GPL-2.0-notice": """
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU General Public License for more details.""",
    "LGPL-2.1-notice": """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
(at your option) any later version. This library is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0-notice": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "AGPL-3.0-notice": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0-notice": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "EPL-2.0-notice": """
This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0-notice": """
To the extent possible under law, the author has waived all copyright and related or neighboring rights to
this work. This work is published under the CC0 1.0 Universal Public Domain Dedication.""",
    "CC-BY-4.0-notice": """
This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "CC-BY-SA-4.0-notice": """
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
    "CC-BY-NC-4.0-notice": """
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.""",
    **{
        f"SPDX-{name}": f"SPDX-License-Identifier: {name}"
        for name in (
            "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause",
            "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only",
            "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
            "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0",
        )
    },
}

# --- words and shingles ---------------------------------------------------------------------------

#: Each byte in lower case, 0 where it is no part of a word.
_BYTES = np.zeros(256, dtype=np.uint8)
_BYTES[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _BYTES[_c] = _c
    _BYTES[bytes([_c]).upper()[0]] = _c
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_POWERS = np.ones(64, dtype=np.uint64)
with np.errstate(over="ignore"):
    for _n in range(1, 64):
        _POWERS[_n] = _POWERS[_n - 1] * np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def shingle_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of all texts, one after another, and each text's number."""
    joined = b" ".join(x or b"" for x in texts) + b" "
    code = _BYTES[np.frombuffer(joined, dtype=np.uint8)]
    inside = code != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    none = np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
    if len(begin) < SHINGLE:
        return none
    # a word's hash is a polynomial of its bytes; positions beyond 63 take the powers again
    at = np.flatnonzero(inside)
    sizes = end - begin
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        value = (code[at].astype(np.uint64) + (place >> 6).astype(np.uint64)) * _POWERS[place & 63]
        word = mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64))
        n = len(word) - SHINGLE + 1
        shingle = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            shingle = shingle * np.uint64(0xC2B2AE3D27D4EB4F) + word[k : k + n]
        shingle = (mixed(shingle) >> np.uint64(32)).astype(np.uint32)
    lengths = np.array([len(x or b"") + 1 for x in texts])
    owner = np.searchsorted(np.cumsum(lengths), begin, side="right")
    whole = owner[:n] == owner[SHINGLE - 1 :]
    return shingle[whole], np.bincount(owner[:n][whole], minlength=len(texts))


def shingles(parts: list[bytes]) -> list[bytes]:
    return [b" ".join(parts[n : n + SHINGLE]) for n in range(len(parts) - SHINGLE + 1)]


# --- templates ------------------------------------------------------------------------------------


def bands(size: int, length: int) -> int:
    """Bands that miss a window with CONTAINED of ``size`` shingles with probability MISSED at most."""
    need = int(np.ceil(CONTAINED * size - 1e-9))
    window = 1 if length == 1 else 2 * length
    similar = need / (window + size - need)
    return 1 if similar >= 1 else int(np.ceil(np.log(MISSED) / np.log1p(-similar)))


@dataclass
class Class:
    """Templates of up to ``length`` shingles."""

    length: int
    bands: int = 1
    names: list[str] = field(default_factory=list)
    sets: list[frozenset] = field(default_factory=list)
    marks: list[np.ndarray] = field(default_factory=list)  # MinHash values of each template


class Templates:
    """Templates by class, with the MinHash values of their bands."""

    def __init__(self, texts: Mapping[str, str]):
        if sum(map(len, texts.values())) > TEMPLATE_CHARS:
            raise ValueError(f"templates are larger than {TEMPLATE_CHARS} characters")
        self.classes: dict[int, Class] = {}
        found = []
        for name, text in sorted(texts.items()):
            data = text.encode()
            parts = words(data)
            if len(parts) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            distinct = frozenset(shingles(parts))
            length = 1 << (len(parts) - SHINGLE).bit_length()
            found.append((name, data, distinct, length))
            c = self.classes.setdefault(length, Class(length))
            c.bands = max(c.bands, bands(len(distinct), length))
        most = max((c.bands for c in self.classes.values()), default=0)
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(1, 1 << 31, most, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.terms = rng.integers(0, 1 << 32, most, dtype=np.uint32)
        for name, data, distinct, length in found:
            c = self.classes[length]
            hashes = shingle_hashes([data])[0]
            c.names.append(name)
            c.sets.append(distinct)
            c.marks.append(
                np.array([self.permuted(hashes, band).min() for band in range(c.bands)], np.uint32)
            )

    def permuted(self, hashes: np.ndarray, band: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = hashes * self.factors[band] + self.terms[band]
            return x ^ (x >> np.uint32(15))

    def retrieved(self, hashes: np.ndarray, counts: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text, class, template, window) of all windows that share a band with a template."""
        pairs: set[tuple[int, int, int, int]] = set()
        if not len(hashes):
            return pairs
        begin = np.cumsum(counts) - counts
        cuts = {}
        for length in self.classes:
            blocks = -(-counts // length)
            text = np.repeat(np.arange(len(counts)), blocks)
            number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            cuts[length] = (begin[text] + number * length, text, number)
        for band in range(len(self.factors)):
            open_classes = [c for c in self.classes.values() if band < c.bands]
            values = self.permuted(hashes, band)
            for c in open_classes:
                at, text, number = cuts[c.length]
                low = values if c.length == 1 else np.minimum.reduceat(values, at)
                if c.length > 1:  # a window is two blocks of one text
                    pair = low.copy()
                    pair[:-1] = np.where(text[:-1] == text[1:], np.minimum(low[:-1], low[1:]), low[:-1])
                    low = pair
                for n, marks in enumerate(c.marks):
                    hit = np.flatnonzero(low == marks[band])
                    pairs.update(
                        (t, c.length, n, w)
                        for t, w in zip(text[hit].tolist(), number[hit].tolist(), strict=True)
                    )
        return pairs

    def matches(self, texts: list[bytes | None]) -> list[dict[str, tuple[float, int, int]]]:
        """For each text: licence to (containment, first word, words of the matching passage)."""
        result: list[dict[str, tuple[float, int, int]]] = [{} for _ in texts]
        by_text = defaultdict(list)
        for t, length, n, w in self.retrieved(*shingle_hashes(texts)):
            by_text[t].append((length, n, w))
        for t, wanted in by_text.items():
            parts = words(texts[t])
            for length, n, w in sorted(wanted):
                c = self.classes[length]
                first = w * length
                window = shingles(parts[first : first + (1 if length == 1 else 2 * length) + SHINGLE - 1])
                hits = [k for k, x in enumerate(window) if x in c.sets[n]]
                share = len({window[k] for k in hits}) / len(c.sets[n])
                if share >= CONTAINED:
                    span = (share, first + hits[0], hits[-1] - hits[0] + SHINGLE)
                    old = result[t].get(c.names[n])
                    if old is None or (-span[0], span[1]) < (-old[0], old[1]):
                        result[t][c.names[n]] = span
        return result


# --- scan -----------------------------------------------------------------------------------------


def scan(
    docs: DataFrame, templates: Mapping[str, str] | None = None, text: str = "text"
) -> DataFrame:
    """One row for each row of ``docs`` and licence that its text contains.

    Columns: ``_doc`` (the columns of ``docs`` but the text, as a struct), ``licence``,
    ``containment`` (largest share of the template's distinct shingles in one window, at least
    CONTAINED), ``first_word`` and ``words`` (the passage, in words of the text; the first of equals).
    NULL, empty and shorter texts match nothing; rows that repeat are scanned one by one. An empty
    table gives an empty result.
    """
    known = Templates(TEMPLATES if templates is None else templates)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_doc")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                rows = [
                    (n, name, *span)
                    for n, found in enumerate(known.matches(part.column(1).to_pylist()))
                    for name, span in sorted(found.items())
                ]
                if rows:
                    n, *columns = zip(*rows, strict=True)
                    kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(n)),
                         *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                        ["_doc", "licence", "containment", "first_word", "words"],
                    )

    slim = docs.select(rest, F.col(text).cast("binary").alias("_text"))
    schema = T.StructType(
        [
            slim.schema["_doc"],
            T.StructField("licence", T.StringType()),
            T.StructField("containment", T.DoubleType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("words", T.LongType()),
        ]
    )
    return slim.mapInArrow(take, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select(
        F.col("_doc")["doc_id"].alias("doc_id"), "licence", "containment", "first_word", "words"
    )
