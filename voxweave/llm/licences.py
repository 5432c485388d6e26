"""License scans by conditional compression.

1. Candidate blocks: words within REACH words of a cue ("license", "copyright", ...),
   wherever in the whole text it is; overlapping reaches are one block.
2. Blocks are cut into pieces of PIECE words that overlap by the longest notice, so a notice lies
   whole in some piece however long its block is. A piece's candidates are the templates with
   enough words in common with it, the words that tell licenses apart among them; no other
   can be confirmed.
3. A piece's words, in lower case, are compressed alone and with each candidate as zstandard raw
   dictionary, with the same parameters. The bytes saved, as a share of the template's own
   compressed size, only rank the candidates.
4. All candidates are confirmed by exact wording: the template is aligned within the
   piece, words that differ are listed, and it counts only if few differ and none of the words
   that tell licenses apart. Of confirmed places that overlap, the closest wording stays; of
   equally close ones, the larger saving.

Cues are found by Catalyst before any text goes to Python, so nearly all documents stay in the
JVM; nothing is shuffled.

Defined cases: a null or blank text has no licenses; repeated rows give repeated results; a null
doc_id stays null; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REACH = 48
#: Words of a piece; several times the longest notice.
PIECE = 512
#: One word in so many may differ.
ONE_IN = 5
#: With and without dictionary the same parameters, as savings compare the two.
PARAMETERS = zstandard.ZstdCompressionParameters.from_level(9, source_size=1 << 13, write_content_size=False, write_checksum=False)

CUE = r"(?i)licen[cs]|copyright|copyleft|spdx|warrant|permission|public domain|creative commons|all rights reserved|\bCC[ -]?(?:BY|0)\b"

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_CC = "This work is licensed under a Creative Commons {} {} International License."
# The usual wording of license notices, each with the words that must not differ.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "sublicense"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser 2.1"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("GPL-3.0", _GPL.format("General Public License", "3"), "general 3"),
    ("GPL-2.0", _GPL.format("General Public License", "2"), "general 2"),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", "3"), "lesser 3"),
    ("AGPL-3.0", _GPL.format("Affero General Public License", "3"), "affero 3"),
    ("BSD-2-Clause", _BSD, "redistribution"),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither endorse"),
    ("BSD", "Licensed under the BSD License.", "bsd"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "by-nc 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "by-nd 4.0"),
    ("CC-BY-4.0", _CC.format("Attribution", "4.0"), "attribution 4.0"),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike", "4.0"), "attribution-sharealike 4.0"),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial", "4.0"), "attribution-noncommercial 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
)

#: A word as it is compared, in lower case: a version number, or letters with inner hyphens.
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+(?:-[^\W\d_]+)*")
_CUE = re.compile(CUE)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) in characters of the candidate blocks."""
    cues = [m.start() for m in _CUE.finditer(text)]
    if not cues:
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spans]
    lo = hi = -1
    for c in cues:
        w = bisect_right(starts, c) - 1
        if lo >= 0 and w - REACH <= hi:
            hi = min(w + REACH, len(spans) - 1)
            continue
        if lo >= 0:
            yield spans[lo][0], spans[hi][1]
        lo, hi = max(0, w - REACH), min(w + REACH, len(spans) - 1)
    yield spans[lo][0], spans[hi][1]


def align(template: list[str], block: list[str], fixed: tuple[str, ...] = ()) -> tuple[int, int, list[tuple[str, str]]]:
    """Where in the block the template fits best: (start, end, differing words).

    Least edit distance of words, with the block's words before and after for free; a change of
    a `fixed` word costs more than all others together. A
    difference is (template word, block word); either may be "" for an extra or missing word.
    """
    n = len(block)
    ids: dict[str, int] = {}
    t = np.array([ids.setdefault(w, len(ids)) for w in template])
    b = np.array([ids.setdefault(w, len(ids)) for w in block])
    at = np.arange(n + 1)
    cost = [2 * len(template) if w in fixed else 1 for w in template]
    table = np.zeros((len(t) + 1, n + 1), dtype=np.int32)
    for i in range(1, len(t) + 1):
        row = table[i - 1] + cost[i - 1]
        row[1:] = np.minimum(row[1:], table[i - 1, :-1] + (b != t[i - 1]) * cost[i - 1])
        table[i] = np.minimum.accumulate(row - at) + at
    i, j = len(t), int(np.argmin(table[-1]))
    end, differ = j, []
    while i:
        if j and table[i, j] == table[i - 1, j - 1] + (t[i - 1] != b[j - 1]) * cost[i - 1]:
            if t[i - 1] != b[j - 1]:
                differ.append((template[i - 1], block[j - 1]))
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + cost[i - 1]:
            i -= 1
            differ.append((template[i], ""))
        else:
            j -= 1
            differ.append(("", block[j]))
    return j, end, differ[::-1]


class Template:
    def __init__(self, name: str, text: str, fixed: str) -> None:
        self.name, self.words, self.fixed = name, words_of(text), tuple(fixed.split())
        self.counts = Counter(self.words)
        self.least = len(self.words) - len(self.words) // ONE_IN
        raw = " ".join(self.words).encode()
        self.own = len(_alone().compress(raw))
        primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = zstandard.ZstdCompressor(compression_params=PARAMETERS, dict_data=primed)

    def possible(self, counts: Counter[str]) -> bool:
        """Whether a piece has the fixed words and as many others as a confirmed place must have."""
        return all(w in counts for w in self.fixed) and sum(min(n, counts[w]) for w, n in self.counts.items()) >= self.least

    def confirm(self, block: list[str]) -> tuple[int, int, list[tuple[str, str]]] | None:
        start, end, differ = align(self.words, block, self.fixed)
        lost = [w for w, _ in differ]
        wrong = len(differ) * ONE_IN > len(self.words) or any(w in lost for w in self.fixed)
        return None if wrong else (start, end, differ)


@lru_cache(maxsize=1)
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=PARAMETERS)


@lru_cache(maxsize=1)
def templates() -> tuple[Template, ...]:
    return tuple(Template(*t) for t in TEMPLATES)


@lru_cache(maxsize=1)
def overlap() -> int:
    """Words of the longest place that can be confirmed."""
    return max(len(t.words) + len(t.words) // ONE_IN for t in templates())


def cuts(n: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a block of n words."""
    step = PIECE - overlap()
    for a in range(0, max(1, n - overlap()), step):
        yield a, min(a + PIECE, n)


def finds_in(said: list[str]) -> Iterator[tuple[float, float, int, int, int, list[tuple[str, str]]]]:
    """(share of words that differ, -saving, template, start, end, differences) in a piece."""
    counts = Counter(said)
    able = [(i, t) for i, t in enumerate(templates()) if t.possible(counts)]
    if not able:
        return
    raw = " ".join(said).encode()
    alone = len(_alone().compress(raw))
    for i, t in able:
        saving = (alone - len(t.given.compress(raw))) / t.own
        # a template can occur again in what is left of the piece
        todo = [(0, len(said))]
        while todo:
            a, b = todo.pop()
            found = t.confirm(said[a:b]) if b - a else None
            if found:
                start, end, differ = found[0] + a, found[1] + a, found[2]
                todo += [(a, start), (end, b)]
                yield len(differ) / len(t.words), -saving, i, start, end, differ


def scan(text: str) -> Iterator[tuple[str, int, int, float, int, str]]:
    """(license, start, end, saving, differing words, what differs) of each find in a text."""
    for lo, hi in blocks(text):
        spans = [m.span() for m in _WORD.finditer(text, lo, hi)]
        said = [text[a:b].lower() for a, b in spans]
        finds = [(*rank, start + a, end + a, differ) for a, b in cuts(len(said)) for *rank, start, end, differ in finds_in(said[a:b])]
        # of confirmed finds that overlap, that with the closest wording stays
        taken: list[tuple[int, int]] = []
        for _, saving, i, start, end, differ in sorted(finds):
            at = bisect_right(taken, (start, end))
            if (not at or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end))
                changes = "; ".join(f"{x or '+'} > {y or '-'}" for x, y in differ)
                yield templates()[i].name, spans[start][0], spans[end - 1][1], round(-saving, 4), len(differ), changes


def license_notices(docs: DataFrame) -> DataFrame:
    """(doc_id, license, start_char, end_char, saving, n_differ, differences) of all finds."""
    schema = "doc_id long, license string, start_char long, end_char long, saving double, n_differ long, differences string"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
    names = ["doc_id", "license", "start_char", "end_char", "saving", "n_differ", "differences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *found) for i, text in enumerate(batch.column(1)) for found in scan(text.as_py())]
            cols = [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *cols], names=names)

    rows = docs.where(F.col("text").rlike(CUE)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license notices of all documents."""
    return license_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
