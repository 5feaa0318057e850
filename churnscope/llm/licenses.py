"""License scans by winnowed fingerprints and banded alignment.

Templates are cut into words; hashes of word k-grams are winnowed and put into an
inverted index (hash -> template, place). Templates too short for winnowing to promise a
hit keep all grams, of as few words as it takes. A text's own k-grams look the index up;
hits on nearby diagonals make a candidate, and a banded alignment of the template
with the words around the hits reports how much of it is there, and where.

Templates are fixed and few, so the index goes to every task; texts are scanned
whole in one map. A text may hold several licenses and one license several times.
Null texts and texts without a match give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from churnscope.llm.common import UPPER, bound_batches

#: Notices as they stand at the head of files and texts (fixed values).
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT/notice": "Released under the MIT License.",
    "MIT/permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."),
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "BSD/redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
}


@dataclass(frozen=True)
class LicenseOptions:
    """k-grams of ``gram`` words, the least of each ``window`` kept; a match needs
    ``coverage`` of a template's words; alignments stray up to ``band`` words."""

    gram: int = 3
    window: int = 3
    coverage: float = 0.8
    band: int = 8


_WORD = re.compile(rb"[a-z0-9]+")
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def gram_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def winnow(hashes: list[int], window: int) -> list[tuple[int, int]]:
    """(hash, place) of each window's least hash, the rightmost at ties, places once."""
    kept: dict[int, int] = {}
    for at in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[at : at + window]
        best = min(range(len(part)), key=lambda i: (part[i], -i))
        kept[at + best] = part[best]
    return [(h, i) for i, h in sorted(kept.items())]


def align(template: list[bytes], words: list[bytes], shift: int, band: int) -> tuple[int, int, int]:
    """(matched, first, last + 1): most template words matched in order within the band.

    Local in ``words``: leading and trailing words are free; among equal matches the
    shortest span wins. Row i of the band holds words shift + i - band ... + band.
    """
    width = 2 * band + 1
    row: list[tuple[int, int, int]] = [(0, -1, -1)] * width  # matched, first, last
    for i, t in enumerate(template):
        new: list[tuple[int, int, int]] = []
        for j in range(width):
            at = shift + i - band + j
            best = row[j + 1] if j + 1 < width else (0, -1, -1)  # skip a template word
            if j and _better(new[j - 1], best):
                best = new[j - 1]  # skip a word of the text
            if 0 <= at < len(words) and words[at] == t:
                n, first, _ = row[j]
                through = (n + 1, first if n else at, at)
                if _better(through, best):
                    best = through
            new.append(best)
        row = new
    n, first, last = max(row, key=lambda x: (x[0], x[1] - x[2]))
    return n, first, last + 1


def _better(x: tuple[int, int, int], y: tuple[int, int, int]) -> bool:
    return (x[0], x[1] - x[2]) > (y[0], y[1] - y[2])


class LicenseIndex:
    def __init__(self, templates: dict[str, str], options: LicenseOptions):
        self.o, self.names = options, sorted(templates)
        self.words = [_WORD.findall(lowered(templates[n])) for n in self.names]
        if any(len(w) < options.gram for w in self.words):
            raise ValueError("a template is shorter than a gram")
        self.index: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (words of the gram, hash)
        self.vocabulary = {w for words in self.words for w in words}
        for k, words in enumerate(self.words):
            # words that a match may lack cut the rest into runs, the longest of ``whole`` words at least
            lacking = sum(n >= options.coverage * len(words) for n in range(len(words)))
            whole = -(-(len(words) - lacking) // (lacking + 1))
            long = len(words) >= 2 * options.window * options.gram
            gram = options.gram if long else max(1, min(options.gram, whole))
            hashes = [gram_hash(words[i : i + gram]) for i in range(len(words) - gram + 1)]
            for h, at in winnow(hashes, options.window if long else 1):
                self.index.setdefault((gram, h), []).append((k, at))
        self.grams = sorted({gram for gram, _ in self.index})

    def matches(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) in code points, by place."""
        data, o = lowered(text), self.o
        words = _WORD.findall(data)
        found: dict[tuple[int, int], int] = {}
        # only grams of template words can be in the index
        known = bytes(map(self.vocabulary.__contains__, words))
        for gram in self.grams:
            full = b"\x01" * gram
            i = known.find(full)
            while i >= 0:
                for k, at in self.index.get((gram, gram_hash(words[i : i + gram])), ()):
                    found.setdefault((k, (i - at) // o.band), i - at)
                i = known.find(full, i + 1)
        if not found:
            return []
        places = [m.span() for m in _WORD.finditer(data)]
        point = lambda at: len(data[:at].decode("utf-8", "surrogatepass"))
        out, seen = [], set()
        for (k, _), shift in sorted(found.items()):
            n, first, last = align(self.words[k], words, shift, o.band)
            if n >= o.coverage * len(self.words[k]) and (k, first) not in seen:
                seen.add((k, first))
                out.append((self.names[k], n / len(self.words[k]), n, point(places[first][0]), point(places[last - 1][1])))
        return self._undisputed(out)

    def _undisputed(self, found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
        """Of matches that overlap, the one with more matched words, then coverage, name."""
        kept: list[tuple[str, float, int, int, int]] = []
        for m in sorted(found, key=lambda m: (-m[2], -m[1], m[0], m[3])):
            if all(m[4] <= x[3] or x[4] <= m[3] for x in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: (m[3], m[0]))


SCHEMA = "doc_id long, license string, coverage double, matched_words int, start int, end int"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, options: LicenseOptions = LicenseOptions()) -> DataFrame:
    """(doc_id, license, coverage, matched_words, start, end), a row per license passage."""
    bound_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = LicenseIndex(templates, options)
        for batch in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"].array) if text for m in index.matches(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "matched_words", "start", "end"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(scan, SCHEMA)
