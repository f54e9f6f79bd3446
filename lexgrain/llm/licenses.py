"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+(?:[.\-]\w+)*")

# Notices of common licenses, as their publishers state them.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "Apache-1.1 line": "Licensed under the Apache License, Version 1.1.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


for _name, _of, _versions in (("GPL", "General", ("1", "2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",))):
    TEMPLATES |= {f"{_name}-{v if '.' in v else v + '.0'} line": f"This work is licensed under the GNU {_of} Public License, version {v}." for v in _versions}
for _short, _long in (("", ""), ("-NC", "-NonCommercial"), ("-NC-ND", "-NonCommercial-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-ND", "-NoDerivatives"), ("-SA", "-ShareAlike")):
    for _version, _where in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-BY{_short}-{_version} line"] = f"This work is licensed under a Creative Commons Attribution{_long} {_version} {_where} License."
        TEMPLATES[f"CC-BY{_short}-{_version} short line"] = f"Licensed under CC BY{_short} {_version}."

# Names that a place must have if its template has them; conditions that it must not have if the template
# hasn't; what follows the names of a short form; words that a version number follows.
NAMES = frozenset("agpl apache attribution bsd cc commons creative eclipse gnu gpl isc lgpl mit mozilla mpl unlicense".split())
CONDITIONS = frozenset("affero agpl lesser lgpl noderivatives noderivs noncommercial sharealike".split())
SHORT = frozenset("nc nd sa".split())
BEFORE_VERSION = NAMES | CONDITIONS | SHORT | frozenset("license licence version v public".split())
#: Phrases that tell, wherever they stand in a place.
PHRASES = {("later", "version"): "or later", ("or", "later"): "or later", ("neither", "the", "name"): "no endorsement"}
VERSION = re.compile(r"v?\d\d?(?:\.\d+)*")


@dataclass(frozen=True)
class Scan:
    """Fingerprints are the least of each `window` neighbouring word n-grams; at most edit_rate of a template's words may differ.

    A place counts if min_coverage of the template's words match and the words that don't, in the longer of place and
    template, are edit_rate of the template's at most; and if it agrees with it (see agrees()).
    """

    n: int = 3
    window: int = 4
    edit_rate: float = 0.25
    min_coverage: float = 0.75

    def fingerprint(self, size: int) -> tuple[int, int]:
        """Words of a gram and grams of a window for a template of so many words.

        A short template keeps all grams, no longer than the run of words that the edits leave in any case.
        """
        if size >= 4 * self.window:
            return min(self.n, size), self.window
        edits = int((1 - self.min_coverage) * size)
        return max(1, min(self.n, -(-(size - edits) // (edits + 1)))), 1


def winnow(grams: list[tuple], window: int) -> list[tuple[int, tuple]]:
    """(place, gram) of the least gram, by hash, of each run of `window` grams; the last on ties, each place once."""
    keyed = [(hash_of(g), -i) for i, g in enumerate(grams)]
    chosen = {-min(keyed[i : i + window])[1] for i in range(max(1, len(keyed) - window + 1))} if keyed else set()
    return [(i, grams[i]) for i in sorted(chosen)]


def hash_of(gram: tuple) -> int:
    """The same in every process, as hash() is not."""
    value = 0
    for word in gram:
        for byte in word.encode("utf-8", "surrogatepass"):
            value = (value * 1_000_003 + byte) & 0xFFFFFFFFFFFFFFFF
        value = (value * 31 + 7) & 0xFFFFFFFFFFFFFFFF
    return value


def told(words: list[str]) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Names, conditions and versions in words; parts of a hyphenated word count one by one.

    "by" and the letters of conditions, which are everyday words too, count only in a row behind "cc"; phrases as a whole.
    """
    parts = [p for w in words for p in w.split("-")]
    names, conditions, versions, row = set(), set(), set(), False
    for k, p in enumerate(parts):
        before = parts[k - 1] if k else ""
        if VERSION.fullmatch(p) and (before in BEFORE_VERSION - SHORT or row):
            versions.add(p.lstrip("v").removesuffix(".0"))
        row = p == "cc" or row and (p == "by" or p in SHORT)
        if p in NAMES:
            names.add(p)
        if p in CONDITIONS or row and p in SHORT:
            conditions.add(p)
    conditions |= {name for phrase, name in PHRASES.items() if any(tuple(parts[k : k + len(phrase)]) == phrase for k in range(len(parts)))}
    return frozenset(names), frozenset(conditions), frozenset(versions)


def agrees(place: list[str], template: tuple[frozenset[str], frozenset[str], frozenset[str]]) -> bool:
    """Whether a place tells of its template: it has its names, just its conditions and, if it has any, just its versions.

    Other names in the place are edits like other words, and so are versions in a place of a template without one.
    """
    names, conditions, versions = told(place)
    return names >= template[0] and conditions == template[1] and (not template[2] or versions == template[2])


def banded_match(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(words matched, first, end) of the template aligned to words on diagonals low to high; words at the ends of either are free.

    Longest common subsequence in the band, row by row, on numbers for words; of equal ones that which starts last,
    then ends first. A cell is its length and, below it, where its first match is.
    """
    n, one = len(words), np.int64(1) << 32
    cells = np.zeros(n + 1, np.int64)  # cells[j + 1]: the best that ends at word j or before
    best, end = 0, 0
    for i, word in enumerate(template):
        a, b = max(0, i + low), min(n, i + high + 1)
        if a >= b:
            continue
        corner = cells[a:b]
        grown = np.where(words[a:b] == word, np.where(corner > 0, corner + one, one + np.arange(a, b)), 0)
        row = np.maximum(grown, cells[a + 1 : b + 1])
        at = int(np.argmax(grown))
        if grown[at] and (grown[at] > best or (grown[at] == best and at + a + 1 < end)):
            best, end = int(grown[at]), at + a + 1
        cells[a + 1 : b + 1] = np.maximum.accumulate(row)
    return (best >> 32, best & (one - 1), end) if best else None


class Templates:
    """The inverted index: fingerprint to the templates and places that have it."""

    def __init__(self, templates: dict[str, str], scan: Scan):
        self.scan, self.words, self.codes, self.told, self.numbers, self.index = scan, {}, {}, {}, {}, defaultdict(list)
        for name, text in sorted(templates.items()):
            words = WORD.findall(text.lower())
            if not words:
                continue
            n, window = scan.fingerprint(len(words))
            self.words[name] = words
            self.codes[name] = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words])
            self.told[name] = told(words)
            for place, gram in winnow(list(zip(*(words[k:] for k in range(n)), strict=False)), window):
                self.index[gram].append((name, place))
        self.sizes = {len(g) for g in self.index}

    def accepts(self, name: str, matched: int, place: list[str]) -> bool:
        """Whether a place with so many words matched is one of the template."""
        size = len(self.words[name])
        return matched >= self.scan.min_coverage * size and max(size, len(place)) - matched <= self.scan.edit_rate * size and agrees(place, self.told[name])

    def find(self, text: str | None) -> list[tuple[str, int, int, float, int, int]]:
        """(license, words matched, words of the template, coverage, start, end) of each place, in order of start.

        Candidates are clusters of shared fingerprints whose diagonals lie within the edit budget of each other. Long
        clusters, of repeated phrases, are aligned in overlapping stretches, and behind and before a place that is found
        the rest is aligned too. Where places of several templates overlap, the one with most matched words counts.
        """
        if not text:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        hits: dict[str, set[int]] = defaultdict(set)
        for n in self.sizes:
            for at, gram in enumerate(zip(*(words[k:] for k in range(n)), strict=False)):
                if gram in self.index:
                    for name, place in self.index[gram]:
                        hits[name].add(at - place)
        numbers = np.array([self.numbers.get(w, -1) for w in words]) if hits else None
        found = set()
        for name, diagonals in hits.items():
            template = self.words[name]
            size, band = len(template), max(1, int(self.scan.edit_rate * len(template)))
            clusters: list[list[int]] = []
            for d in sorted(diagonals):
                if clusters and d - clusters[-1][-1] <= band and d - clusters[-1][0] < 2 * size:
                    clusters[-1].append(d)
                else:
                    clusters.append([d])
            for cluster in clusters:
                todo = [(max(0, cluster[0] - band), min(len(words), cluster[-1] + size + band))]
                while todo:
                    start, end = todo.pop()
                    match = banded_match(self.codes[name], numbers[start:end], cluster[0] - band - start, cluster[-1] + band - start)
                    if not match or match[0] < self.scan.min_coverage * size:
                        continue
                    first, last = start + match[1], start + match[2]
                    if self.accepts(name, match[0], words[first:last]):
                        found.add((name, match[0], size, match[0] / size, places[first][0], places[last - 1][1]))
                    todo += [(start, first), (last, end)]
        kept: list[tuple] = []
        for x in sorted(found, key=lambda x: (-x[1], -x[3], x[4], x[0])):
            k = bisect_left(kept, x[4], key=lambda y: y[4])
            if (k == 0 or kept[k - 1][5] <= x[4]) and (k == len(kept) or x[5] <= kept[k][4]):
                kept.insert(k, x)
        return kept


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, scan: Scan = Scan()) -> DataFrame:
    """(id, license, matched, words, coverage, start, end) for each place of a template in a text.

    matched and words count words, of the place and of the template; start and end are character offsets. A place that
    doesn't agree with the template in names, conditions and versions is none of it, however much of it is covered. Case,
    punctuation and white space don't count. Null and empty texts and templates match nothing, null ids stay null,
    repeated rows give repeated rows, an empty table gives an empty one. Other columns are ignored.

    The index of the templates goes to every task: they are a parameter, and not read from the corpus. The whole
    text is looked up gram by gram in it; there is no shuffle.
    """
    chosen = TEMPLATES if templates is None else templates

    @F.pandas_udf("array<struct<license:string,matched:int,words:int,coverage:double,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Templates(chosen, scan)
        for batch in batches:
            yield pd.Series([index.find(t) for t in batch], dtype=object)

    return docs.select(F.col(id_col).alias("id"), F.explode(find(F.col(text_col))).alias("hit")).select("id", "hit.*")
