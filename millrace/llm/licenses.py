"""License scans: MinHash bands over overlapping windows retrieve templates, and exact
shingle containment verifies them.

Templates and texts become runs of word shingles. For templates of about one length the text
is cut into windows that overlap, so that any occurrence lies within one of them whole. Each
window and template is put into one band per hash function, by its smallest hash. A window
that shares a band with a template is compared with it shingle by shingle. There are as many
bands as make it sure enough that a window with just enough of a template shares one.

Shingles of templates are marked in a text first, and only windows that hold a marked one of
their own templates are put into bands. A window without any cannot hold a part of a template,
so this leaves nothing out, at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textscan

#: Notices by which licenses are known. ``license_texts`` has the longer list of the query.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: What a template's name has after the license that it stands for, and templates
#: that stand for one under another name.
PARTS = (" text", " header", " line", " warranty")
STANDS_FOR = {"BSD third condition": "BSD-3-Clause", "GPL-3.0 header": "GPL-3.0", "EPL line": "EPL"}
#: Licenses that share most of their words, beyond those that share a name up to the first hyphen.
RELATED = {"GPL": "GNU", "LGPL": "GNU", "AGPL": "GNU"}

WIDTH = 5
CONTAINMENT = 0.8
#: How surely a window with just enough of a template shares a band with it.
SURE = 0.9999

#: Words are runs of ASCII letters, digits and other scripts' letters, in lower case.
_SEPARATORS = np.array([not (i >= 128 or chr(i).isalnum()) for i in range(256)])
_PIECE = 2 << 20
#: Shingles of windows that are hashed together.
_WINDOW_SHINGLES = 1 << 20


@dataclass(frozen=True)
class _Length:
    """Templates of about one length, and the windows to look for them in. Lengths are in
    shingles; a window is three blocks, and the next one starts a block later."""

    block: int
    names: tuple[str, ...]
    sets: tuple[np.ndarray, ...]
    factors: np.ndarray  # a hash function per band
    bands: np.ndarray  # the smallest hash of each template, by band


@dataclass(frozen=True)
class _Short:
    """Templates of ``width`` words, fewer than a shingle has: each is one shingle of all its words."""

    width: int
    names: tuple[str, ...]
    hashes: np.ndarray


def bands_for(shortest: int, block: int, containment: Fraction, sure: float) -> int:
    """Bands of one hash each that a window needs. It holds at least ``containment`` of the
    template's shingles, so a hash function agrees on both with the probability of that
    share in their union, or a greater one."""
    held = math.ceil(shortest * containment)
    agree = held / (3 * block + shortest - held)
    return max(1, math.ceil(math.log(1 - sure) / math.log(1 - agree))) if agree < 1 else 1


def identity(name: str) -> tuple[str, str]:
    """The license that a template stands for, and its family."""
    for part in PARTS:
        name = STANDS_FOR.get(name, name).removesuffix(part)
    head = name.split("-")[0]
    return name, RELATED.get(head, head)


def merged(*lists: Mapping[str, str | Sequence[str]]) -> dict[str, str | Sequence[str]]:
    """Lists of templates as one; a name may be in one of them only."""
    out: dict[str, str | Sequence[str]] = {}
    for own in lists:
        if both := out.keys() & own.keys():
            raise ValueError(f"templates of two lists share the names {sorted(both)}")
        out |= own
    return out


def _each(templates: Mapping[str, str | Sequence[str]]) -> list[tuple[str, str]]:
    return [(name, text) for name, given in sorted(templates.items()) for text in ([given] if isinstance(given, str) else given)]


def prepare(templates: Mapping[str, str | Sequence[str]], width: int, containment: Fraction, sure: float, short: bool = False) -> list[_Length]:
    """Templates by length. Those with fewer than ``width`` words are left to ``prepare_short``
    if ``short`` is set, and refused otherwise."""
    by_block: dict[int, list[tuple[str, np.ndarray]]] = {}
    for name, text in _each(templates):
        shingles = np.unique(_shingles(pa.array([text]), width)[0])
        if not len(shingles) and short:
            continue
        if not len(shingles):
            raise ValueError(f"template {name!r} has fewer than {width} words")
        # An occurrence may be longer than its template by what was put in between.
        span = 1 << math.ceil(math.log2(max(2, len(shingles) / containment)))
        by_block.setdefault(span // 2, []).append((name, shingles))
    lengths = []
    for block, own in sorted(by_block.items()):
        count = max(bands_for(len(s), block, containment, sure) for _, s in own)
        factors = np.random.default_rng([4, block]).integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        bands = np.stack([(factors[:, None] * s[None, :]).min(axis=1) for _, s in own], axis=1)
        lengths.append(_Length(block, tuple(n for n, _ in own), tuple(s for _, s in own), factors, bands))
    return lengths


@dataclass(frozen=True)
class _Marks:
    """All shingles of the templates, sorted, and for each a bit of every length that has it."""

    shingles: np.ndarray
    bits: np.ndarray


def marks(lengths: Sequence[_Length]) -> _Marks:
    """The shingles by which texts are looked through before they are put into bands."""
    own = [(np.unique(np.concatenate(x.sets)), np.uint64(1) << np.uint64(k)) for k, x in enumerate(lengths)]
    shingles = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in own)]))
    bits = np.zeros(len(shingles), np.uint64)
    for some, bit in own:
        bits[np.searchsorted(shingles, some)] |= bit
    return _Marks(shingles, bits)


def prepare_short(templates: Mapping[str, str | Sequence[str]], width: int) -> list[_Short]:
    by_width: dict[int, list[tuple[str, np.uint64]]] = {}
    for name, text in _each(templates):
        count = int(_shingles(pa.array([text]), 1)[2][-1])
        if not count:
            raise ValueError(f"template {name!r} has no words")
        if count < width:
            by_width.setdefault(count, []).append((name, _shingles(pa.array([text]), count)[0][0]))
    return [_Short(n, tuple(x for x, _ in own), np.array([h for _, h in own], np.uint64)) for n, own in sorted(by_width.items())]


def scan(
    docs: DataFrame,
    templates: Mapping[str, str | Sequence[str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    containment: float = CONTAINMENT,
    sure: float = SURE,
    short: bool = False,
) -> DataFrame:
    """One row per match: ``id_col, license, start_word, n_words, containment, license_id, best``.

    A template matches where a window of the text holds at least ``containment`` of its
    distinct shingles of ``width`` words; case and punctuation do not count. The match runs
    from the first to the last word of those shingles; matches of one template that overlap
    or touch are one, with the best containment. Words count from 0.

    ``license_id`` names the license that the template stands for. Licenses of one family
    have much of their text in common, so that one text matches several of them. Among
    matches of a family that overlap, ``best`` marks the one with the highest containment,
    then the longest, then the first by name; all of them are returned.

    * Whole texts are scanned, however long, each within one task. A null text, and one
      with fewer words than ``width``, has no match. Without matches there is no row.
    * ``templates`` is a fixed list, shipped to every task; a name may have several texts, and
      matches with any of them are its matches. Each text must have ``width`` words, unless
      ``short`` is set: then one with fewer words matches where all of them stand in a row.
    * Rows that repeat an id are scanned one by one, and null ids are kept as null. Other
      columns are not looked at.
    """
    share = Fraction(str(containment))
    known = TEMPLATES if templates is None else templates
    lengths = prepare(known, width, share, sure, short)
    prepared = lengths, prepare_short(known, width) if short else [], marks(lengths)
    shipped = docs.sparkSession.sparkContext.broadcast(prepared)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in textscan.pieces(whole, "text", _PIECE):
                lengths, few, marked = shipped.value
                found = matches(batch.column("text"), lengths, width, share, few, marked)
                columns = list(zip(*found)) or [(), (), (), (), ()]
                license_ids = [identity(name)[0] for name in columns[1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], pa.string()),
                        pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.int64()),
                        pa.array(columns[4], pa.float64()),
                        pa.array(license_ids, pa.string()),
                        pa.array(best_of_families(found), pa.bool_()),
                    ],
                    [id_col, "license", "start_word", "n_words", "containment", "license_id", "best"],
                )

    return rows.mapInArrow(run, f"`{id_col}` long, license string, start_word long, n_words long, containment double, license_id string, best boolean")


def best_of_families(found: Sequence[tuple[int, str, int, int, float]]) -> list[bool]:
    """Which matches no other one of their text and family that overlaps them surpasses."""
    out = [True] * len(found)
    groups: dict[tuple[int, str], list[int]] = {}
    for i, match in enumerate(found):
        groups.setdefault((match[0], identity(match[1])[1]), []).append(i)
    for own in groups.values():
        own.sort(key=lambda i: found[i][2])
        open_matches: list[int] = []
        for i in own:  # by start: what has ended before cannot overlap what follows
            _, name, start, words, share = found[i]
            open_matches = [j for j in open_matches if found[j][2] + found[j][3] > start]
            for j in open_matches:
                _, other, _, other_words, other_share = found[j]
                first = (-share, -words, name) < (-other_share, -other_words, other)
                out[j if first else i] = False
            open_matches.append(i)
    return out


def _shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts in order, the first shingle of each text, and its first word."""
    words, first = _words(texts)
    runs, at = textscan.windows(words, first, width)
    return runs, np.searchsorted(at, first), first


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = textscan.utf8(pc.utf8_lower(texts))
    starts, lengths, first = textscan.spans(data, bounds, _SEPARATORS)
    return textscan.hashes(data, starts, lengths), first


def matches(
    texts: pa.Array, lengths: list[_Length], width: int, share: Fraction, short: Sequence[_Short] = (), marked: _Marks | None = None
) -> list[tuple[int, str, int, int, float]]:
    """``(text, license, start word, words, containment)`` for every match, in order."""
    marked = marked or marks(lengths)
    words, heads = _words(texts)
    shingles, at = textscan.windows(words, heads, width)
    first = np.searchsorted(at, heads)
    found: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
    for few in short:
        runs, at = textscan.windows(words, heads, few.width)
        for hit in np.flatnonzero(np.isin(runs, few.hashes)).tolist():
            text = int(np.searchsorted(heads, at[hit], "right")) - 1
            place = int(at[hit] - heads[text])
            for template in np.flatnonzero(few.hashes == runs[hit]).tolist():
                found.setdefault((text, few.names[template]), []).append((place, place + few.width, 1.0))
    at_marks = np.minimum(np.searchsorted(marked.shingles, shingles), max(len(marked.shingles) - 1, 0))
    places = np.flatnonzero(marked.shingles[at_marks] == shingles) if len(marked.shingles) else np.zeros(0, np.int64)
    bits = marked.bits[at_marks[places]]
    for k, length in enumerate(lengths):
        held = places[(bits >> np.uint64(k)) & np.uint64(1) == 1]
        starts, ends, owner = _windows(first, length.block, held)
        for window, template in _retrieved(shingles, starts, ends, length):
            s, e = int(starts[window]), int(ends[window])
            known = length.sets[template]
            inside = np.flatnonzero(np.isin(shingles[s:e], known))
            held = len(np.unique(shingles[s:e][inside]))
            if held * share.denominator >= len(known) * share.numerator:
                text = int(owner[window])
                at = s - int(first[text])
                place = at + int(inside[0]), at + int(inside[-1]) + width, held / len(known)
                found.setdefault((text, length.names[template]), []).append(place)
    out = []
    for (text, name), places in found.items():
        merged: list[list] = []
        for start, end, best in sorted(places):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
                merged[-1][2] = max(merged[-1][2], best)
            else:
                merged.append([start, end, best])
        out += [(text, name, start, end - start, best) for start, end, best in merged]
    return sorted(out)


def _windows(first: np.ndarray, block: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the windows that hold one of the shingles at ``held``: those that
    begin with its block or with one of the two before it, within its text."""
    owner = np.searchsorted(first, held, "right") - 1
    own = (held - first[owner]) // block
    begins = (first[owner] + np.maximum(own - back, 0) * block for back in range(3))
    starts = np.unique(np.concatenate([*begins]))
    owner = np.searchsorted(first, starts, "right") - 1
    return starts, np.minimum(starts + 3 * block, first[owner + 1]), owner


def _retrieved(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: _Length) -> list[tuple[int, int]]:
    """Windows and templates that share a band."""
    met: set[tuple[int, int]] = set()
    step = max(1, _WINDOW_SHINGLES // (3 * length.block))
    for head in range(0, len(starts), step):
        sizes = (ends - starts)[head : head + step]
        before = np.cumsum(sizes) - sizes
        own = shingles[np.arange(int(sizes.sum())) + np.repeat(starts[head : head + step] - before, sizes)]
        for factor, least in zip(length.factors, length.bands):
            smallest = np.minimum.reduceat(own * factor, before)
            for at in np.flatnonzero(np.isin(smallest, least)).tolist():
                met.update((head + at, int(t)) for t in np.flatnonzero(least == smallest[at]))
    return sorted(met)
