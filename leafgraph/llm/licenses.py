"""License scans: MinHash bands of overlapping text windows retrieve templates, exact shingle containment verifies them.

A template is its set of word shingles.  Templates are grouped by length into
classes, each 1.41 times the one before; a class's windows are as long as its
longest template and start at every eighth of that.  A window's MinHash
signature has ``ROWS`` numbers for each of ``BANDS`` bands, and an index from
the numbers of a band to templates gives the window's candidates.  With 1 and 24
a window of Jaccard similarity s meets its template with probability
1 - (1 - s)^24.  Where the threshold's share of a template stands in one place,
some window has s of 0.39 or more, so the probability is over 0.99999.  A candidate
counts if the window, widened by a quarter on both sides, holds at least the
threshold's share of the template's shingles.

Windows without any shingle of any template can't hold one and get no signature;
that test is one lookup a shingle.

Edge cases: null and empty texts match nothing; a text or template of fewer words
than a shingle is one shingle, templates without words match nothing; texts of any
length are scanned as a whole; templates with equal shingles all match; repeated
rows give repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafgraph.llm.blocks import arrow_batches, mixed, text_and_offsets, text_blocks, trim, word_hashes

BANDS, ROWS, WIDTH, THRESHOLD = 24, 1, 3, 0.8
STEP, GROWTH = 8, 2**0.5

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. You should have received a copy of the GNU {0} General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_CC = "Licensed under CC {}."
#: Whole texts of short licenses (without their copyright lines), the whole notices of long ones, and one-line forms.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org>",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-2.0-notice": _GNU.format("", "2").replace("GNU  ", "GNU "), "gpl-3.0-notice": _GNU.format("", "3").replace("GNU  ", "GNU "), "lgpl-3.0-notice": _GNU.format("Lesser", "3"), "agpl-3.0-notice": _GNU.format("Affero", "3"),
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.", "mit-line": "Released under the MIT License.", "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-line": _CC.format("BY 4.0"), "cc-by-sa-4.0-line": _CC.format("BY-SA 4.0"), "cc-by-nc-4.0-line": _CC.format("BY-NC 4.0"), "all-rights-reserved": "All rights reserved.",
}

_SEEDS = np.random.default_rng(7).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_ODD = np.random.default_rng(8).integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_MORE = np.random.default_rng(9).integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(tokens: np.ndarray, width: int) -> np.ndarray:
    """The shingle hashes of one token sequence in their order."""
    n = len(tokens) - width + 1
    if n < 1:
        return mixed((tokens * _ODD[: len(tokens)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(tokens))) if len(tokens) else tokens
    return mixed(sum((tokens[j : j + n] * _ODD[j] for j in range(width)), np.zeros(n, np.uint64)))


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One number for each band of each signature; equal ones agree in the whole band."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    return mixed((rows * _MORE).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[0])


class Windows:
    """The templates of one class: the index from bands to them, for windows of one size."""

    def __init__(self, size: int, templates: list[tuple[str, np.ndarray]]):
        self.size, self.step, self.templates = size, max(1, size // STEP), templates
        keys = band_keys(np.stack([mixed(t[:, None] ^ _SEEDS).min(0) for _, t in templates]))
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.of = keys.ravel()[order], np.repeat(np.arange(len(templates)), BANDS)[order]

    def starts(self, n: int) -> np.ndarray:
        """Where windows over n shingles begin: every step, and one that ends with them."""
        last = max(0, n - self.size)
        return np.unique(np.append(np.arange(0, last + 1, self.step), last))

    def candidates(self, own: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of a window's start and a template that a band leads to."""
        at = self.starts(len(own))
        before = np.concatenate([[0], np.cumsum(known)])
        at = at[before[np.minimum(at + self.size, len(own))] > before[at]]
        out = []
        for low in range(0, len(at), 64):
            part = at[low : low + 64]
            keys = band_keys(np.stack([mixed(own[a : a + self.size, None] ^ _SEEDS).min(0) for a in part.tolist()]))
            first, last = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
            for w, b in zip(*np.nonzero(last > first), strict=True):
                out += [(int(part[w]), int(t)) for t in self.of[first[w, b] : last[w, b]]]
        return sorted(set(out))


class Scanner:
    def __init__(self, templates: dict[str, str], width: int, threshold: float):
        names = list(templates)
        data, offsets = text_and_offsets(pa.array([templates[n] for n in names], pa.string()))
        tokens, owner = word_hashes(data, offsets)
        self.width, self.threshold = width, threshold
        classes: dict[int, list] = {}
        for i, name in enumerate(names):
            if len(s := shingles(tokens[owner == i], width)):
                classes.setdefault(int(np.ceil(np.log(len(s)) / np.log(GROWTH) - 1e-9)), []).append((name, len(s), np.unique(s)))
        self.classes = [Windows(max(n for _, n, _ in found), [(name, own) for name, _, own in found]) for _, found in sorted(classes.items())]
        self.any = np.unique(np.concatenate([t for c in self.classes for _, t in c.templates])) if self.classes else np.zeros(0, np.uint64)

    def scan(self, tokens: np.ndarray) -> list[tuple[str, float]]:
        """Names and best containments of the templates in one token sequence."""
        own = shingles(tokens, self.width)
        known = np.isin(own, self.any)
        if not known.any():
            return []
        best: dict[str, float] = {}
        for c in self.classes:
            for at, t in c.candidates(own, known):
                name, template = c.templates[t]
                wide = own[max(0, at - c.size // 4) : at + c.size + c.size // 4]
                share = float(np.isin(template, wide).sum()) / len(template)
                if share >= self.threshold - 1e-9:
                    best[name] = max(best.get(name, 0.0), share)
        return sorted(best.items())


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licenses, licenses (names joined by commas, in order) and best_containment (0 without a match) of every row."""
    templates = TEMPLATES if templates is None else templates
    docs = docs.select("doc_id", "text")
    arrow_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner(templates, width, threshold)
        for rows, data, offsets in text_blocks(batches):
            tokens, owner = word_hashes(data, offsets)
            cut = np.searchsorted(owner, np.arange(rows.num_rows + 1))
            got = [scanner.scan(tokens[cut[i] : cut[i + 1]]) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([len(g) for g in got], pa.int32()), pa.array([",".join(n for n, _ in g) for g in got]), pa.array([max((c for _, c in g), default=0.0) for g in got], pa.float64())], names=["doc_id", "n_licenses", "licenses", "best_containment"])
            trim()

    return docs.mapInArrow(run, "doc_id long, n_licenses int, licenses string, best_containment double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_license_scan": op8_license_scan}
