"""License scans by conditional compression (operator 10).

Licence cues open candidate blocks: the words around, on both sides as many as
the longest template has and may gain, blocks that meet being one (every
template holds a cue). A block is compressed alone and with each template as
zstandard's raw dictionary, and the templates are ranked by how much smaller
they make it. In that order each is confirmed by exact wording, wherever in the
block and however often it occurs: its words must be found in order, with no
word different for a template of up to ``SHORT`` words and at most one in
twenty for a longer one. A low rank doesn't prove a wording's absence (the
gain of a true one may be two bytes), so no template is left out for its rank;
of wordings confirmed at overlapping places the longest stays, then the one
with the fewest words different, then the one that gains most.

Blocks are read in pieces of a bounded number of words that overlap by the
longest wording, so each wording lies whole in one.

Defined results: null text counts as empty and has no licences; offsets are in
code points, ends exclusive; repeated rows are read alike; an empty table gives
no rows; a null doc_id is carried along.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

#: Templates of up to so many words must match word for word.
SHORT, LEVEL = 40, 3
#: Words of a block that are read at a time, besides the overlap.
PIECE = 2048
CUES = r"(?i)licen[sc]e|copyright|rights[\W_]+reserved|spdx|permission[\W_]+is|permission[\W_]+to[\W_]+use|redistribution[\W_]+and[\W_]+use|public[\W_]+domain|creative[\W_]+commons|\bcc0|\bcc[\W_]+by"
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: Licence, start, end and rank (words different, bytes gained, negative) of a wording.
Hit = tuple[str, int, int, tuple[int, int]]

#: Wordings of public licences and of their usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "released under the MIT License",
        "licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "licensed under the Apache License, Version 2.0",
        "released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD-3-Clause": (
        "licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-2-Clause": (
        "licensed under the BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0", "licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "Zlib": ("licensed under the zlib License", "SPDX-License-Identifier: Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    "Unlicense": ("SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "Proprietary": ("all rights reserved",),
}


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        import zstandard

        self.entries = []
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self._alone = zstandard.ZstdCompressor(**options)
        for name, texts in templates.items():
            for t in texts:
                words = [w for w, _, _ in words_of(t)]
                known = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=LEVEL)
                self.entries.append((name, words, zstandard.ZstdCompressor(dict_data=known, **options)))
        longest = max(len(words) for _, words, _ in self.entries)
        self.reach = longest + longest // 20 + 1
        self._cue = re.compile(CUES)
        self._memo: dict[str, list] = {}

    @staticmethod
    def confirm(words: list[str], block: list[str], places: dict[str, list[int]]) -> list[tuple[int, int, int]]:
        """First and last block word of each occurrence of the template's
        wording, none overlapping, and how many words differ. ``places`` has
        where each word is in the block."""
        n, out = len(words), []
        if n <= SHORT:
            for i in places.get(words[0], ()):
                if (not out or i > out[-1][1]) and block[i : i + n] == words:
                    out.append((i, i + n - 1, 0))
            return out
        # at most ``off`` words are missing and as many are between: of 2 * off + 1 parts one is there unbroken
        off = n // 20
        cuts = [n * k // (2 * off + 1) for k in range(2 * off + 2)]
        begins = {i - lo for lo, hi in zip(cuts, cuts[1:]) for i in places.get(words[lo], ()) if block[i : i + hi - lo] == words[lo:hi]}
        tried = set()
        for begin in begins:
            at = max(0, begin - off)
            match = SequenceMatcher(None, words, block[at : begin + n + off], autojunk=False)
            parts = [m for m in match.get_matching_blocks() if m.size]
            same = sum(m.size for m in parts)
            if not parts or n - same > off:
                continue
            first, last = parts[0].b, parts[-1].b + parts[-1].size - 1
            more = last - first + 1 - same
            if more <= off:
                tried.add((n - same + more, first + at, last + at))
        for different, first, last in sorted(tried):
            if all(last < a or b < first for a, b, _ in out):
                out.append((first, last, different))
        return out

    def block(self, block: list[str]) -> list[Hit]:
        """What is confirmed of a piece, places as word numbers."""
        joined = " ".join(block)
        if (known := self._memo.get(joined)) is not None:
            return known
        data = joined.encode()
        alone = len(self._alone.compress(data))
        ranked = sorted(((len(c.compress(data)) - alone, name, words) for name, words, c in self.entries), key=lambda r: r[:2])
        places: dict[str, list[int]] = {}
        for i, w in enumerate(block):
            places.setdefault(w, []).append(i)
        out = [(name, a, b, (different, less)) for less, name, words in ranked for a, b, different in self.confirm(words, block, places)]
        if len(self._memo) > 5_000:
            self._memo.clear()
        self._memo[joined] = out
        return out

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        cues = [m.start() for m in self._cue.finditer(text)]
        if not cues:
            return []
        found: set[Hit] = set()
        begins = np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64)
        for lo, hi in self._around(begins, cues):
            while True:
                to = min(hi, lo + PIECE + self.reach)
                at = int(begins[lo])
                piece = words_of(text[at : int(begins[to]) if to < len(begins) else len(text)])
                found |= {(n, piece[a][1] + at, piece[b][2] + at, rank) for n, a, b, rank in self.block([w for w, _, _ in piece])}
                if to == hi:
                    break
                lo += PIECE
        kept: list[tuple[str, int, int]] = []
        ends: list[int] = []  # of what is kept, by start
        starts: list[int] = []
        for hit in sorted(found, key=lambda h: (h[1] - h[2], h[3], h[1], h[0])):
            i = bisect_left(starts, hit[1])
            if (i == 0 or ends[i - 1] <= hit[1]) and (i == len(starts) or hit[2] <= starts[i]):
                starts.insert(i, hit[1])
                ends.insert(i, hit[2])
                kept.append(hit[:3])
        return sorted(kept, key=lambda h: h[1:] + h[:1])

    def _around(self, begins: np.ndarray, cues: list[int]) -> Iterator[tuple[int, int]]:
        """Ranges of words about the cues, joined where they meet."""
        lo = hi = -1
        for at in (np.searchsorted(begins, cues, "right") - 1).tolist():  # the word that holds the cue
            if hi < 0 or at - self.reach > hi:
                if hi >= 0:
                    yield lo, hi
                lo = max(0, at - self.reach)
            hi = min(len(begins), at + self.reach + 2)
        yield lo, hi


_OPEN: list[Scanner] = []


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_licenses, licenses`` (distinct, sorted, comma-joined)``,
    spans`` (``licence:start:end`` by start, comma-joined)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        scanner = _OPEN[0] if _OPEN else _OPEN.append(Scanner()) or _OPEN[0]
        for batch in batches:
            cued = pc.fill_null(pc.match_substring_regex(batch.column(1), CUES), False)
            hits = [[]] * batch.num_rows
            for i in pc.indices_nonzero(cued).to_pylist():
                hits[i] = scanner.scan(batch.column(1)[i].as_py())
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(h) for h in hits], pa.int64()),
                pa.array([",".join(sorted({n for n, _, _ in h})) for h in hits], pa.string()),
                pa.array([",".join(f"{n}:{a}:{b}" for n, a, b in h) for h in hits], pa.string()),
            ], names=["doc_id", "n_licenses", "licenses", "spans"])

    rows = columns(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_licenses long, licenses string, spans string")
