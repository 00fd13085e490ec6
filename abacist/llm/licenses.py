"""Licence notices in texts, by Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib import resources
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.batches import pieces

THRESHOLD = 0.8

# Notices as licensors write them, by licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    "GPL-1.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 1, or (at your option) any later "
        "version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "LGPL-2.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
        "your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def full_texts() -> dict[str, str]:
    """Whole licence texts, by licence; under 300 kB together, so they travel with the job."""
    found = resources.files("abacist.llm").joinpath("license_texts").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in found if f.name.endswith(".txt")}


_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.;:!?])\s+")


def normal_words(text: str) -> list[str]:
    """Lowered words of letters and digits; punctuation and blanks go."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """Dice coefficient of two bags; 0 when both are empty."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Hit(NamedTuple):
    """A place in a text, from word ``start`` to before ``end``, that resembles a template of ``size`` bigrams."""

    score: float
    size: int
    start: int
    end: int
    name: str

    def covers(self, other: Hit) -> bool:
        """Whether more than half of the shorter place is in both."""
        both = min(self.end, other.end) - max(self.start, other.start)
        return 2 * both > min(self.end - self.start, other.end - other.start)


class Matcher:
    """Templates by size and by bigram; whole licence texts are compared with whole texts and windows only."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float, texts: dict[str, str]):
        self.threshold = threshold
        self.bags = [(name, bigrams(normal_words(t))) for name, texts in templates.items() for t in texts]
        self.having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, bag) in enumerate(self.bags):
            for pair in bag:
                self.having[pair].append(i)
        self.all_bags = self.bags + [(name, bigrams(normal_words(t))) for name, t in texts.items()]
        self.all_having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, bag) in enumerate(self.all_bags):
            for pair in bag:
                self.all_having[pair].append(i)
        # Bags of sizes a and b reach the threshold only if the smaller is at least this share of the larger.
        self.ratio = threshold / (2 - threshold)
        sizes = [bag.total() for _, bag in self.bags]
        self.least, self.most = min(sizes) * self.ratio, max(sizes) / self.ratio

    def best(self, words: list[str], start: int) -> Iterator[Hit]:
        """Templates that ``words``, which begin at ``start``, resemble to the threshold."""
        size = len(words) - 1
        if not self.least <= size <= self.most:
            return
        bag = bigrams(words)
        for i in {i for pair in bag for i in self.having.get(pair, ())}:
            name, other = self.bags[i]
            n = other.total()
            if min(n, size) < self.ratio * max(n, size):
                continue
            score = dice(bag, other)
            if score >= self.threshold:
                yield Hit(score, n, start, start + len(words), name)

    def windows(self, words: list[str]) -> Iterator[Hit]:
        """Templates and texts that stand anywhere in ``words``, or fill them.

        A window of a template's length slides over its bigrams. Only where all
        of the text has enough of them, which no window can exceed.
        """
        pairs = list(zip(words, words[1:]))
        hits = [(at, pair) for at, pair in enumerate(pairs) if pair in self.all_having]
        common: Counter = Counter()
        for pair, n in Counter(pair for _, pair in hits).items():
            for i in self.all_having[pair]:
                common[i] += min(n, self.all_bags[i][1][pair])
        for i, most in common.items():
            name, bag = self.all_bags[i]
            size = bag.total()
            whole = 2 * most / (size + len(pairs))
            if whole >= self.threshold:
                yield Hit(whole, size, 0, len(words), name)
            if most / size >= self.threshold and size <= len(pairs):
                score, last = self._slide([h for h in hits if h[1] in bag], bag, size)
                if score / size >= self.threshold:
                    yield Hit(score / size, size, max(0, last - size + 1), last + 2, name)

    @staticmethod
    def _slide(hits: list[tuple[int, tuple[str, str]]], bag: Counter, size: int) -> tuple[int, int]:
        """The most bigrams that any ``size`` neighbouring ones have in common with ``bag``, and the last of the first such."""
        held: Counter = Counter()
        most = now = first = last = 0
        for at, pair in hits:
            while hits[first][0] <= at - size:
                gone = hits[first][1]
                now -= held[gone] <= bag[gone]
                held[gone] -= 1
                first += 1
            held[pair] += 1
            now += held[pair] <= bag[pair]
            if now > most:
                most, last = now, at
        return most, last

    def hits(self, text: str) -> list[Hit]:
        """All places that resemble a template: lines, their sentences, paragraphs, the whole, and windows.

        Longer units are looked at only where a line of theirs has a bigram of a
        template, or a template's bigram may stand across a line break.
        """
        found: list[Hit] = []
        touched, paragraph, every, begin = False, [], [], 0
        having = self.having
        for line in [*text.split("\n"), ""]:
            words = normal_words(line)
            if not words:
                if len(paragraph) > 1 and touched:
                    found += self.best([w for part in paragraph for w in part], begin)
                paragraph = []
                continue
            if not paragraph:
                begin = len(every)
            paragraph.append(words)
            at = len(every)
            every += words
            edge = len(paragraph) > 1 and (paragraph[-2][-1], words[0]) in having
            if edge or any(pair in having for pair in zip(words, words[1:])):
                touched = True
                found += self.best(words, at)
                sentences = _SENTENCE.split(line)
                if len(sentences) > 1:
                    for sentence in sentences:
                        part = normal_words(sentence)
                        found += self.best(part, at)
                        at += len(part)
        if touched and len(every) <= self.most + 1:
            found += self.best(every, 0)
        return found + list(self.windows(every))

    def scan(self, text: str) -> dict[str, float]:
        """Licences of a text with their highest coefficients.

        Of places that overlap by more than half of the shorter one, the best alone
        counts: notices of one family differ in few words, and the name or number that
        differs is what lowers the coefficient of the others.
        """
        kept: list[Hit] = []
        for hit in sorted(self.hits(text), key=lambda h: (-h.score, -h.size, h.name, h.start)):
            if not any(h.name != hit.name and h.covers(hit) for h in kept):
                kept.append(hit)
        found: dict[str, float] = {}
        for hit in kept:
            found.setdefault(hit.name, hit.score)
        return found


def scan_licenses(
    docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, licenses, license, dice`` for every row of ``docs (doc_id, text)``.

    ``licenses`` are the names found, in order; ``license`` and ``dice`` the one
    with the highest coefficient, of equal ones the first name. Empty and NULL for
    a text without notice, a NULL text among them. Units of a text that are
    compared: lines, sentences of lines, paragraphs, the whole, and windows of
    each template's length over all words, so a notice inside prose is found
    however its lines break. Of overlapping notices the best one counts. Rows without ``doc_id`` and rows that repeat one are
    scanned like any other.
    """

    texts = full_texts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold, texts)
        for batch in batches:
            for at, held in pieces(batch["text"]):
                found = [sorted(matcher.scan(t.decode()).items()) for t in held]
                best = [max(f, key=lambda x: x[1]) if f else (None, None) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"][at : at + len(held)],
                        pa.array([[name for name, _ in f] for f in found], pa.list_(pa.string())),
                        pa.array([b[0] for b in best], pa.string()),
                        pa.array([b[1] for b in best], pa.float64()),
                    ],
                    ["doc_id", "licenses", "license", "dice"],
                )

    schema = "doc_id long, licenses array<string>, license string, dice double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
