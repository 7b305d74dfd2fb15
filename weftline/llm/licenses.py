"""Operator 10: licence scans by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import lean, stash
from .textvec import LOWER, Words, slices, utf8

_FREE = "is free software{sep} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your option) any later version."
#: Wordings of licence notices and files, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program " + _FREE.format(sep=":", name="GNU General Public License", sep2=",", version="3"),
    ],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only", "This program " + _FREE.format(sep=";", name="GNU General Public License", sep2=";", version="2")],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library " + _FREE.format(sep=";", name="GNU Lesser General Public License", sep2=";", version="2.1")],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "LicenseRef-All-Rights-Reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}
#: Least cosine to a template, and that of a whole file that makes it a licence file whatever its name.
LEAST, WHOLE = 0.7, 0.9
#: What says nothing if another licence is found.
WEAK = "LicenseRef-All-Rights-Reserved"
#: Names of licence files, and words that a notice has one of.
FILES = r"(?i)^(un)?(licen[cs]e|copying|copyright)([._-].*)?$"
TELLING = "licensed license licence licenses copyright copies rights reserved permission redistribution redistribute mit apache gnu lesser bsd mozilla creative commons unencumbered spdx isc endorse"
#: Lines before and after one with such a word that are compared together with it.
BEFORE, AFTER = 3, 7

_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _tokens(lines: list[str]) -> Words:
    column = pa.array(lines, pa.string())
    data, offsets = utf8(column)
    return Words(data, offsets, _GAP, LOWER)


def vocabulary() -> np.ndarray:
    """Sorted hashes of the words that templates have."""
    return np.unique(_tokens([t for own in TEMPLATES.values() for t in own]).hash)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of some texts, the line of each (numbered over all the texts), and the text of each line.

    A line ends at a line feed and after a full stop before a space, as notices also stand within longer lines.
    """
    w = Words(data, offsets, _GAP, LOWER)
    b = w.bytes
    stop = b == 10
    stop[1:] |= (b[1:] == 32) & (b[:-1] == 46)
    start = np.union1d(w.offsets[:-1], np.flatnonzero(stop) + 1)
    line = np.searchsorted(start, w.start, "right") - 1
    return w, line, np.searchsorted(w.offsets, start, "right") - 1


def _frequencies(vocab: np.ndarray):
    """(term, lines): in how many lines each word of the vocabulary is; term -1: all lines with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab) + 1, np.int64)
        for b in batches:
            data, offsets = utf8(b.column(0))
            for lo, hi in slices(offsets):
                w, line, _ = _lines(data, offsets[lo : hi + 1])
                if not len(line):
                    continue
                at = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
                hit = vocab[at] == w.hash
                key = np.unique(line[hit] * len(vocab) + at[hit])
                total[:-1] += np.bincount(key % len(vocab), minlength=len(vocab))
                total[-1] += 1 + np.count_nonzero(np.diff(line))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(vocab)), -1)), pa.array(total)], names=["term", "lines"])

    return run


def _spans(w: Words, line: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """What is compared besides single lines, as runs of words (from, to), each once: around each line with a telling word the runs of neighbouring lines
    within its paragraph, up to BEFORE lines above and AFTER below, the paragraph, and the whole text."""
    feed = np.concatenate(([0], np.cumsum(w.bytes == 10)))
    row = feed[w.start]  # the physical line of each word
    n = len(row)
    new_row = np.append(True, (np.diff(row) != 0) | (np.diff(w.doc) != 0))
    new_part = np.append(True, (np.diff(row) > 1) | (np.diff(w.doc) != 0))
    first = np.append(np.flatnonzero(new_row), n)  # words at which lines begin
    of_row = np.cumsum(new_row) - 1
    begins = np.append(np.flatnonzero(new_part), n)
    of_part = np.cumsum(new_part) - 1
    hit = np.flatnonzero(telling)
    rows, one = np.unique(of_row[hit], return_index=True)
    part = of_part[hit[one]]
    low, high = of_row[begins[part]], of_row[begins[part + 1] - 1]
    out = [np.stack((begins[part], begins[part + 1]), 1)]
    for up in range(BEFORE + 1):
        for down in range(AFTER + 1):
            ok = (rows - up >= low) & (rows + down <= high)
            out.append(np.stack((first[rows[ok] - up], first[rows[ok] + down + 1]), 1))
    doc = np.unique(w.doc[hit])
    out.append(np.stack((w.first_word[doc], w.first_word[doc + 1]), 1))
    return np.unique(np.concatenate(out), axis=0)


def _cosines(vocab: np.ndarray, idf: np.ndarray, idf_other: float, least: float):
    """The best template of each text: (license, cosine, line_no, whole)."""
    names = [k for k, own in TEMPLATES.items() for _ in own]
    t = _tokens([x for own in TEMPLATES.values() for x in own])
    matrix = np.zeros((len(vocab), len(names)))
    np.add.at(matrix, (np.searchsorted(vocab, t.hash), t.doc), 1)
    matrix *= idf[:, None]
    matrix /= np.sqrt((matrix * matrix).sum(0))
    strong = np.isin(vocab, _tokens([TELLING]).hash)

    def compare(at: np.ndarray, hit: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of n runs of words the best template and its cosine, -1 if none can reach ``least``; ``owner`` says whose a word is."""
        key, count = np.unique(owner[hit] * len(vocab) + at[hit], return_counts=True)
        row, term = key // len(vocab), key % len(vocab)
        weight = count * idf[term]
        inside = np.bincount(row, weight * weight, n)
        square = inside + np.bincount(owner[~hit], minlength=n) * idf_other**2
        # Only runs whose part within the vocabulary can reach the least cosine are compared with the templates.
        able = np.flatnonzero((inside > 0) & (inside >= least**2 * square))
        place = np.full(n, -1)
        place[able] = np.arange(len(able))
        ok = np.flatnonzero(place[row] >= 0)
        best, top = np.zeros(n, np.int64), np.full(n, -1.0)
        bounds = np.searchsorted(place[row[ok]], np.arange(len(able) + 1))
        for lo in range(0, len(able), 1024):
            hi = min(lo + 1024, len(able))
            own = ok[bounds[lo] : bounds[hi]]
            dot = np.add.reduceat(weight[own, None] * matrix[term[own]], bounds[lo:hi] - bounds[lo], axis=0) / np.sqrt(square[able[lo:hi]])[:, None]
            best[able[lo:hi]], top[able[lo:hi]] = dot.argmax(1), dot.max(1)
        return best, top

    def describe(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        w, line, text_of = _lines(data, offsets)
        out: list[tuple] = [(None, None, None, False)] * w.n_docs
        if not len(line):
            return out
        at = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
        hit = vocab[at] == w.hash
        best, top = compare(at, hit, line, len(text_of))
        begin = np.searchsorted(line, np.arange(len(text_of)))
        good = np.flatnonzero(top >= least)
        found = [(best[good], top[good], begin[good], np.searchsorted(line, good, "right"))]
        spans = _spans(w, line, hit & strong[at])
        # Some spans at a time, about as many words as a slice has.
        size = spans[:, 1] - spans[:, 0]
        step, lo = np.cumsum(size), 0
        while lo < len(spans):
            hi = max(lo + 1, int(np.searchsorted(step, (step[lo - 1] if lo else 0) + (1 << 18), "right")))
            own = size[lo:hi]
            word = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(spans[lo:hi, 0], own)
            best, top = compare(at[word], hit[word], np.repeat(np.arange(hi - lo), own), hi - lo)
            good = np.flatnonzero(top >= least)
            found.append((best[good], top[good], spans[lo + good, 0], spans[lo + good, 1]))
            lo = hi
        best, top, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = w.doc[start]
        whole = np.zeros(w.n_docs, bool)
        whole[doc[(start == w.first_word[doc]) & (stop == w.first_word[doc + 1]) & (top >= WHOLE)]] = True
        feed = np.concatenate(([0], np.cumsum(w.bytes == 10)))
        # The largest cosine; of equal ones the first run, and the shorter.
        weak = np.array([n == WEAK for n in names])[best]
        order = np.lexsort((stop, start, -np.round(top, 12), weak, doc))
        for k in order[np.unique(doc[order], return_index=True)[1]]:
            d = doc[k]
            out[d] = (names[best[k]], float(top[k]), int(feed[w.start[start[k]]] - feed[w.offsets[d]]), bool(whole[d]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            rows = [r for lo, hi in slices(offsets) for r in describe(data, offsets[lo : hi + 1])]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["file_id", "path", "license", "cosine", "line_no", "whole"])

    return run


def idf_weights(texts: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse line frequencies over all ``texts`` (one string column): of the vocabulary, and of any other word.

    Another word's is that of a word in one line of a hundred thousand, so that what a line says besides a notice counts against it.
    """
    counts = {r["term"]: r["lines"] for r in texts.mapInArrow(_frequencies(vocab), "term long, lines long").groupBy("term").agg(F.sum("lines").alias("lines")).collect()}
    n = counts.get(-1, 0)
    idf = np.array([np.log((n + 1) / (counts.get(i, 0) + 1)) + 1 for i in range(len(vocab))])
    return idf, float(np.log(max(min(n, 100_000), 1)) / 2 + 1)


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, least: float = LEAST) -> DataFrame:
    """(file_id, path, license, cosine, line_no, effective_license, origin): a file's own licence, or that of the nearest directory above.

    Every line of the whole text is compared with every template, and so are, around each line with a telling word, runs of lines of its
    paragraph (a wrapped header), the paragraph, and the whole text. The run of the largest cosine, ``least`` or more, gives the
    file's own licence (ties: the first run; WEAK counts only if there is no other). line_no is the line that it begins in, from 0. A file with a licence that is named as a licence file (FILES), or that as a
    whole is like a template, is a licence file and governs its directory; of several in one directory the one of the largest cosine does, then
    of the smallest path. A file without a licence takes that of the nearest governed directory on its path. origin: header,
    file (a licence file), the directory's path, or null.

    Null and empty texts have no licence of their own. A null path has no directory. Repeated rows are files like others. Extra columns are
    ignored. An empty table gives an empty one. Directories are joined once each, however many files they have.
    """
    vocab = vocabulary()
    rows = lean(files).select(F.col(id_col).cast("long").alias("file_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    idf, other = idf_weights(rows.select("text"), vocab)
    found = rows.mapInArrow(_cosines(vocab, idf, other, least), "file_id long, path string, license string, cosine double, line_no long, whole boolean")
    found = stash(found.withColumn("dir", _parent(F.col("path"))), "licences")
    governs = F.col("license").isNotNull() & (F.col("whole") | F.coalesce(F.regexp_replace("path", "^.*/", "").rlike(FILES), F.lit(False)))
    best = F.max_by("license", F.struct("cosine", "path"))
    governed = found.where(governs & F.col("dir").isNotNull()).groupBy("dir").agg(best.alias("dir_license"))
    dirs = found.where("license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("above"))
    nearest = above.join(governed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("dir_license", "above"), F.length("above")).alias("from_dir"))
    out = found.join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    origin = F.when(governs, F.lit("file")).when(own, F.lit("header")).otherwise(F.col("from_dir.above"))
    return out.select("file_id", "path", "license", "cosine", "line_no", F.when(own, F.col("license")).otherwise(F.col("from_dir.dir_license")).alias("effective_license"), origin.alias("origin"))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))
