"""License scans: sparse TF-IDF cosine of text to notice templates, then inheritance from the nearest directory.

1. The words of the templates are the vocabulary. One pass counts in how many files each occurs; the smoothed idf
   of a word is at least 1, even if all files have it. A caller may give ``common``: words of more than that share
   of all files then carry no weight. The counts, one for each vocabulary word, are summed in executors.
2. Every line with two different weighted words is compared with the templates by the cosine of TF-IDF vectors.
   Words outside the vocabulary weigh as much as a word of no file, but no word weighs more than ``MOST_WEIGHT``,
   so the score of a line does not fall as the files grow in number. The whole line is compared, and each of its
   stretches of a template's length. A match has two different words of its template. A file's licence is its
   best match of at least ``least_cosine``; the match is a header if it lies in the first ``header_lines`` lines.
3. A whole file is compared with whole licence texts in the same way; at ``whole_cosine`` it is that licence, and
   that is its match whatever notices it has.
4. A licence file stands for its directory: one named like LICENSE or COPYING, one that is a licence text, or one of
   which notices make up at least half of the words. Each directory without one takes that of its nearest ancestor, by joins of
   directories with their ancestors; each file without a licence of its own takes its directory's.

Null and empty texts have no licence of their own. Of equal scores, the template first in the alphabet counts,
and of several licence files of a directory the best score, then the smallest path. Very long texts are read
whole. Repeated rows are told each on its own. A null path has no directory and inherits nothing. An empty table gives
an empty one. Only id, text and what the path is made of are read, so extra columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import buffer_of, lowered, slices, small_batches, staged, word_hashes

LEAST_COSINE, WHOLE_COSINE, HEADER_LINES, FILE_SHARE = 0.6, 0.8, 20, 0.5
#: No word weighs more than one that none of a hundred files has, however many files there are.
MOST_WEIGHT = float(np.log(101) + 1)
#: Directories are broadcast if they are no more than these.
BROADCAST_DIRECTORIES = 1 << 17
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

#: Notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0 ": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
    "MIT ": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-3-Clause ": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "GPL-3.0 ": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 ": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 ": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 ": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 ": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0 ": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 ": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 ": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal public domain dedication.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_AS_IS = "IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Whole licence texts by SPDX identifier.
TEXTS = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE {_AS_IS} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution.""",
    "Unlicense": f"""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE {_AS_IS} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

PART = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Separators of the parts above, as bytes; a dot counts as one unless digits follow and precede it.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(97, 123)]] = True


def parts_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lower-case words and dotted numbers in the bytes of all rows."""
    digit = (raw >= 48) & (raw <= 57)
    inside = INSIDE[raw]
    if len(raw) > 2:
        dot = np.zeros(len(raw), bool)
        dot[1:-1] = (raw[1:-1] == 46) & digit[:-2] & digit[2:]
        inside |= dot
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = True
    after[edges - 1] = True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


class Vocabulary:
    def __init__(self, templates: dict[str, str] = TEMPLATES, texts: dict[str, str] = TEXTS):
        self.templates = [(name.strip(), PART.findall(text.lower())) for name, text in sorted(templates.items())]
        self.texts = [(name, PART.findall(text.lower())) for name, text in sorted(texts.items())]
        notices = {w for _, parts in self.templates for w in parts}
        # words of notices come first: on lines, others are words of no template
        self.words = [*sorted(notices), *sorted({w for _, parts in self.texts for w in parts} - notices)]
        self.notices = len(notices)
        raw, offsets = buffer_of(pa.array(self.words))
        hashes = word_hashes(raw, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.hashes, self.index = hashes[order], order

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.index[at], -1)


class Weights:
    """idf of the vocabulary (above 0; 0 by the stop rule only) and of other words, and unit vectors of the templates."""

    def __init__(self, vocabulary: Vocabulary, files: int, counts: np.ndarray, common: float | None = None):
        self.vocabulary = vocabulary
        self.idf = np.minimum(np.log((1 + files) / (1 + np.minimum(counts, files))) + 1, MOST_WEIGHT)
        if common is not None:
            self.idf[counts > common * max(files, 1)] = 0.0
        self.other = float(min(np.log(1.0 + files) + 1, MOST_WEIGHT))
        self.place = {w: i for i, w in enumerate(vocabulary.words)}
        #: Squared weights by index; the last, at index -1, is that of other words.
        self.squares = np.append(self.idf**2, self.other**2)
        self.units = []
        for name, parts in vocabulary.templates:
            vector = np.zeros(len(self.idf))
            for w in parts:
                vector[self.place[w]] += self.idf[self.place[w]]
            norm = np.sqrt((vector * vector).sum())
            if norm:
                # the share of each word in the dot product
                self.units.append((name, len(parts), np.append(vector / norm * self.idf, 0.0)))
        self.wholes = []
        for name, parts in vocabulary.texts:
            vector = np.zeros(len(self.idf))
            for w in parts:
                vector[self.place[w]] += self.idf[self.place[w]]
            if norm := np.sqrt((vector * vector).sum()):
                self.wholes.append((name, vector / norm * self.idf))

    def whole(self, found: np.ndarray, row: np.ndarray, rows: int) -> list[tuple[float, str]]:
        """For each row the largest cosine of all its words with a licence text, and that text's name."""
        best = [(0.0, "")] * rows
        if not self.wholes or not len(found):
            return best
        v, known = len(self.idf), found >= 0
        pairs, times = np.unique(row[known] * v + found[known], return_counts=True)
        of, word = pairs // v, pairs % v
        norm = np.bincount(of, (times * self.idf[word]) ** 2, rows) + np.bincount(row[~known], minlength=rows) * self.other**2
        norm = np.sqrt(np.maximum(norm, 1e-300))
        for name, pull in self.wholes:
            cosine = np.bincount(of, times * pull[word], rows) / norm
            for i in np.flatnonzero(cosine >= WHOLE_COSINE):
                if cosine[i] > best[i][0] + 1e-12:
                    best[i] = (float(cosine[i]), name)
        return best

    def _exact(self, stretches: np.ndarray, pull: np.ndarray) -> np.ndarray:
        """Cosine of each row of words' indexes, 0 if fewer than two different words of the template are in it."""
        out = np.zeros(len(stretches))
        step = max(1, (1 << 21) // stretches.shape[1] ** 2)
        for a in range(0, len(stretches), step):
            w = stretches[a : a + step]
            same = w[:, :, None] == w[:, None, :]
            times = np.where(w >= 0, same.sum(2), 1)
            different = ((pull[w] > 0) / times).sum(1)
            norm = np.sqrt((self.squares[w] * times).sum(1))
            out[a : a + step] = np.where(different > 1.5, pull[w].sum(1) / np.where(norm > 0, norm, 1.0), 0.0)
        return out

    def best(self, found: np.ndarray, bounds: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines of which a stretch reaches ``least``: line, cosine, template and words of the best stretch.

        found: the words' indexes of all lines, -1 for others. bounds: where the lines begin, and the end. Whole
        lines are scored by their word counts. Of a stretch, the dot product and the norm as if no word repeated
        are differences of running sums; as repeats only add to the norm, that bounds the cosine, and what may
        reach ``least`` is scored again exactly.
        """
        sizes, v = np.diff(bounds), len(self.idf)
        line = np.repeat(np.arange(len(sizes)), sizes)
        known = found >= 0
        pairs, times = np.unique(line[known] * v + found[known], return_counts=True)
        kept = np.bincount(pairs[self.idf[pairs % v] > 0] // v, minlength=len(sizes)) >= 2
        names = np.flatnonzero(kept)
        if not len(names):
            return names, np.zeros(0), names, names
        ours = kept[pairs // v]
        pairs, times = pairs[ours], times[ours]
        line_of, word_of = (np.cumsum(kept) - 1)[pairs // v], pairs % v
        found, sizes = found[kept[line]], sizes[kept]
        line, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
        starts = ends - sizes
        norms = np.bincount(line_of, (times * self.idf[word_of]) ** 2, len(sizes)) + np.bincount(line[found < 0], minlength=len(sizes)) * self.other**2
        norms = np.sqrt(np.maximum(norms, 1e-300))
        squares = np.append(0.0, np.cumsum(self.squares[found]))
        parts = []
        for t, (_, length, pull) in enumerate(self.units):
            mine = pull[word_of] > 0
            cosine = np.bincount(line_of, times * pull[word_of], len(sizes)) / norms
            hit = np.flatnonzero((cosine >= least) & (np.bincount(line_of[mine], minlength=len(sizes)) >= 2))
            parts.append((hit, cosine[hit], np.full(len(hit), t), starts[hit], sizes[hit]))
            if len(found) < length:
                continue
            sums = np.append(0.0, np.cumsum(pull[found]))
            dot = sums[length:] - sums[:-length]
            at = np.flatnonzero((dot * dot >= (least * least - 1e-6) * (squares[length:] - squares[:-length])) & (dot > 0) & (line[: len(dot)] == line[length - 1 :]))
            cosine = self._exact(found[at[:, None] + np.arange(length)], pull)
            at, cosine = at[cosine >= least], cosine[cosine >= least]
            parts.append((line[at], cosine, np.full(len(at), t), at, np.full(len(at), length)))
        where, cosine, template, start, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, template, -np.round(cosine, 12), where))
        order = order[np.unique(where[order], return_index=True)[1]]
        return names[where[order]], cosine[order], template[order], words[order]


def _counts(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """A row for each vocabulary word that a task has seen: the number of its files with it. Word -1: all files."""
    counts = np.zeros(len(vocabulary.words) + 1, np.int64)
    for batch in batches:
        raw, offsets = buffer_of(batch.column(0))
        counts[-1] += batch.num_rows
        for _, _, part, own in slices(raw, offsets):
            low = lowered(part)
            start, end = parts_of(low, own)
            found = vocabulary.lookup(word_hashes(low, start, end)) if len(start) else np.zeros(0, np.int64)
            row = np.searchsorted(own, start, "right") - 1
            pairs = np.unique(row[found >= 0] * len(counts) + found[found >= 0]) % len(counts)
            counts += np.bincount(pairs, minlength=len(counts))
    yield pa.RecordBatch.from_arrays([pa.array([*range(len(counts) - 1), -1], pa.int32()), pa.array(counts)], names=["word", "n"])


def _scanned(batches: Iterator[pa.RecordBatch], weights: Weights, least_cosine: float, header_lines: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffer_of(batch.column(1))
        names, scores, lines_at, shares = [], [], [], []
        for low_row, high_row, part, own in slices(raw, offsets):
            low = lowered(part)
            start, end = parts_of(low, own)
            found = weights.vocabulary.lookup(word_hashes(low, start, end)) if len(start) else np.zeros(0, np.int64)
            first = np.searchsorted(start, own)
            breaks = np.flatnonzero(low == 10)
            rows = high_row - low_row
            best, covered, wholes = [(0.0, "", -1)] * rows, np.zeros(rows), [(0.0, "")] * rows
            if len(start):
                # a line is told by its row and the line breaks before it
                row, broken = np.repeat(np.arange(rows), np.diff(first)), np.searchsorted(breaks, start)
                wholes = weights.whole(found, row, rows)
                found = np.where(found < weights.vocabulary.notices, found, -1)
                begins = np.flatnonzero(np.append(True, (np.diff(row) > 0) | (np.diff(broken) > 0)))
                for number, cosine, template, length in zip(*(x.tolist() for x in weights.best(found, np.append(begins, len(start)), least_cosine)), strict=True):
                    i = int(row[begins[number]])
                    covered[i] += length
                    if cosine > best[i][0] + 1e-12:
                        best[i] = (cosine, weights.units[template][0], int(broken[begins[number]] - np.searchsorted(breaks, own[i])))
            for (score, name, at), (whole, text), part_of, size in zip(best, wholes, covered, np.diff(first), strict=True):
                names.append(text or name or None)
                scores.append(round(whole if text else score, 9))  # equal scores are equal, whatever the order of sums
                lines_at.append(0 if text else at)
                shares.append(1.0 if text else part_of / max(1, size))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([0 <= x < header_lines for x in lines_at], pa.bool_()), pa.array(shares, pa.float64())], names=["row", "license", "score", "in_header", "share"])


def directory_of(path: Column) -> Column:
    """What stands before the last slash; the root is the empty text."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(frame: DataFrame, path: Column, id_column: str = "doc_id", text_column: str = "text", templates: dict[str, str] = TEMPLATES, texts: dict[str, str] = TEXTS, least_cosine: float = LEAST_COSINE, common: float | None = None, header_lines: int = HEADER_LINES) -> DataFrame:
    """Per row: the id, path, license, score, in_header, origin (own, inherited or none) and license_path."""
    spark = frame.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary(templates, texts)
    read = frame.select(F.struct(F.col(id_column).alias("id"), path.cast("string").alias("path")).alias("row"), F.col(text_column).cast("string").alias("text"))
    counted = read.select("text").mapInArrow(lambda b: _counts(b, vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    totals = {r["word"]: r["n"] for r in counted.collect()}  # one row for each word of the templates
    weights = Weights(vocabulary, totals.get(-1, 0), np.array([totals.get(i, 0) for i in range(len(vocabulary.words))], float), common)
    kind = read.schema["row"].dataType.simpleString()
    scanned = read.mapInArrow(lambda b: _scanned(b, weights, least_cosine, header_lines), f"row {kind}, license string, score double, in_header boolean, share double")
    files = staged(scanned.select("row.id", "row.path", "license", "score", "in_header", "share", directory_of(F.col("row.path")).alias("dir")), "licenses")

    named = F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENSE_FILE)
    stands = files.filter(F.col("license").isNotNull() & F.col("dir").isNotNull() & (named | (F.col("share") >= FILE_SHARE)))
    best = stands.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b"))
    best = best.select(F.col("dir").alias("above"), F.col("b.license").alias("dir_license"), F.col("b.path").alias("dir_path"))
    # every directory with itself and all its ancestors
    dirs = files.filter("dir is not null").select("dir").distinct()
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(F.split("dir", "/")))
    steps = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    lines = steps.select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = lines.join(best, "above").groupBy("dir").agg(F.max(F.struct("depth", "dir_license", "dir_path")).alias("n"))
    nearest = staged(nearest.select("dir", "n.dir_license", "n.dir_path"), "directories")
    small = nearest.count() <= BROADCAST_DIRECTORIES
    out = files.join(F.broadcast(nearest) if small else nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(F.col("id").alias(id_column), "path", F.coalesce("license", "dir_license").alias("license"), "score", "in_header", F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(own, F.col("path")).otherwise(F.col("dir_path")).alias("license_path"))
