"""License texts and notices by winnowed fingerprints and banded alignment.

Templates are whole license texts (``licenses/``) and short notices.  Each is
cut into word k-grams whose winnowed hashes make an inverted index
``hash -> (template, word)``.  The k-grams of a document that are in the
index propose a template and a diagonal; enough hits near one diagonal make a
candidate, and a banded alignment of the template against the document's
words around it decides, giving the matched coverage and span.

A template of n words matches with at most ``(1 - least) * n`` edits.  So many
edits leave a number of its grams whole, which is the number of hits asked
for; no alignment within the edits is missed.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rivulet.llm.common import byte_blocks, fresh, read_table, shipped
from rivulet.llm.wordindex import WordHasher, alnum_table, lower_table

GRAM, WINNOW, LEAST = 3, 2, 0.8
#: Templates of fewer words are notices; of a longer one only so many words are its title.
NOTICE, TITLE = 60, 12
#: Words that tell one license, variant or version from another.
NAMES = frozenset(
    "apache mit bsd isc gnu lesser library affero general public gpl lgpl agpl mpl epl mozilla eclipse boost zlib unlicense cc by nc sa nd attribution noncommercial"
    " sharealike noderivatives noderivs clause v1 v2 v3 v4 0 1 2 3 4 5".split()
)

# Fixed texts: short notices and the opening passages of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "AGPL-notice": "Released under the AGPL License",
    "Apache-notice": "Released under the Apache License",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License",
    "BSD-notice": "Released under the BSD License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "EPL-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "GPL-notice": "Released under the GPL License",
    "ISC-notice": "Released under the ISC License",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.0-header": "is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "LGPL-header": "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-notice": "Released under the LGPL License",
    "MPL-notice": "Released under the Mozilla Public License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-notice": "Released under the zlib License",
}
for _kind, _long in {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}.items():
    TEMPLATES[f"{_kind}-notice-long"] = f"Released under the GNU {_long} Public License"
    for _version in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}[_kind]:
        TEMPLATES[f"{_kind}-{_version}-notice"] = f"under the GNU {_long} Public License version {_version}"
        TEMPLATES[f"{_kind}-{_version}-notice-v"] = f"under the GNU {_kind} v{_version}"
_KINDS = {"": "Attribution", "-NC": "Attribution-NonCommercial", "-SA": "Attribution-ShareAlike", "-ND": "Attribution-NoDerivatives", "-NC-SA": "Attribution-NonCommercial-ShareAlike", "-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _long in _KINDS.items():
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        _name = f"CC-BY{_kind}" + ("" if _version == "4.0" else f"-{_version}")
        TEMPLATES.setdefault(_name if _kind in ("-NC", "-SA") else f"{_name}-short", f"Licensed under CC BY{_kind} {_version}")
        TEMPLATES.setdefault(f"{_name}-long" if _kind in ("-NC", "-SA") else _name, f"This work is licensed under a Creative Commons {_long} {_version} " + ("International License" if _version == "4.0" else "License"))


@cache
def license_texts() -> dict[str, str]:
    """The whole license texts that come with the package, by name (``MIT-full``)."""
    return {f"{p.stem}-full": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _words(data: bytes):
    data = lower_table()[np.frombuffer(data, np.uint8)]
    starts, ends, _, hashes = WordHasher().words(data, np.array([0, len(data)]), alnum_table())
    return [data[s:e].tobytes() for s, e in zip(starts, ends)], hashes


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of word hashes."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return out ^ out >> np.uint64(31)


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Positions of the least hash (the rightmost of equal ones) of every window."""
    n = max(1, len(hashes) - window + 1)
    return sorted({i + len(part) - 1 - int(np.argmin(part[::-1])) for i in range(n) if len(part := hashes[i : i + window])})


class Index:
    """Templates and their inverted indexes of winnowed grams, one for each gram length."""

    def __init__(self, templates: dict[str, str], k: int = GRAM, window: int = WINNOW, least: float = LEAST) -> None:
        self.names, self.words, self.hashed, self.named, self.edits, self.need = sorted(templates), [], [], [], [], []
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for t, name in enumerate(self.names):
            words, hashes = _words(templates[name].encode("utf-8"))
            n = len(words)
            self.words.append(words)
            self.hashed.append(hashes)
            self.named.append([i for i, w in enumerate(words[: n if n < NOTICE else TITLE]) if w.decode("utf-8") in NAMES])
            e = int((1 - least) * n + 1e-9)
            self.edits.append(e)
            # An edit breaks at most as many grams as a gram has words; long texts have enough left to be winnowed.
            size, w = min(k, 2 if n < 7 else 3, max(1, -(-(n - e) // (e + 1)))), window if n >= NOTICE else 1
            self.need.append(max(1, -(-(n - size + 1 - size * e - (e + 1) * (w - 1)) // w)))
            g = grams(hashes, size)
            entries.setdefault(size, []).extend((int(g[i]), t, i) for i in (winnow(g, w) if len(g) else ()))
        self.need = np.array(self.need, np.int64)
        self.tables = {}
        for size, found in entries.items():
            found.sort()
            maybe, keys = np.zeros(1 << 20, bool), np.array([x[0] for x in found], np.uint64)
            maybe[keys >> np.uint64(44)] = True
            self.tables[size] = keys, np.array([x[1:] for x in found], np.int64).reshape(-1, 2), maybe
        self.name_hashes = _words(" ".join(sorted(NAMES)).encode())[1]

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """``row, template, diagonal, template word`` of the hits of (row, template) pairs with enough of them, in this order."""
        out = [np.zeros((0, 4), np.int64)]
        for size, (keys, at, maybe) in self.tables.items():
            g = grams(hashes, size)
            i = np.flatnonzero(maybe[g >> np.uint64(44)])
            i = i[rows[i] == rows[i + size - 1]]
            low = np.searchsorted(keys, g[i], "left")
            n = np.searchsorted(keys, g[i], "right") - low
            i, low, n = i[n > 0], low[n > 0], n[n > 0]
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            i = np.repeat(i, n)
            pair = rows[i] * len(self.names) + at[entry, 0]
            _, group, count = np.unique(pair, return_inverse=True, return_counts=True)
            keep = count[group] >= self.need[at[entry, 0]]
            i, entry = i[keep], entry[keep]
            out.append(np.column_stack([rows[i], at[entry, 0], i - at[entry, 1], at[entry, 1]]))
        hits = np.concatenate(out)
        return hits[np.lexsort(hits.T[::-1])]


def diagonals(offsets: np.ndarray, at: np.ndarray, edits: int, need: int):
    """Diagonals to align on: the first of windows of ``edits`` with ``need`` distinct template words, the fullest first."""
    while len(offsets):
        # Hits of one alignment are at most that far apart; clusters have nothing to do with each other.
        cuts = np.flatnonzero(np.diff(offsets) > 2 * edits + 1) + 1
        if len(cuts):
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(offsets)]):
                if y - x >= need:
                    yield from diagonals(offsets[x:y], at[x:y], edits, need)
            return
        upto = np.searchsorted(offsets, offsets + edits, "right")
        count = upto - np.arange(len(offsets))
        best = int(np.argmax(count))
        if count[best] < need:
            return
        first = int(offsets[best])
        if len(np.unique(at[best : upto[best]])) >= need:
            yield first
        keep = (offsets < first - edits // 2) | (offsets > first + edits + edits // 2)
        offsets, at = offsets[keep], at[keep]


def path(template: np.ndarray, words: np.ndarray, offset: int, band: int) -> list[tuple[int, int]]:
    """Matched pairs ``(template word, word)`` of the best alignment around the diagonal ``offset``.

    Match 2, mismatch -1, gap -1; the ends of ``words`` are free.  Only cells
    within ``band`` of the diagonal are filled.
    """
    n, width = len(template), 2 * band + 1
    # Column d stands for word t + offset - band + d; before and after the words nothing matches.
    low, high = offset - band, offset + band + n
    inside = words[max(0, low) : max(0, high)]
    padded, there = np.zeros(high - low, words.dtype), np.zeros(high - low, bool)
    start = max(0, -low)
    padded[start : start + len(inside)], there[start : start + len(inside)] = inside, True
    score, slope, moves = np.zeros(width, np.int64), np.arange(width), np.zeros((n, width), np.int8)
    for t in range(n):
        diagonal = score + np.where((padded[t : t + width] == template[t]) & there[t : t + width], 2, -1)
        skipped = np.append(score[1:] - 1, -(10**9))
        best = np.maximum(diagonal, skipped)
        score = np.maximum.accumulate(best + slope) - slope
        moves[t] = np.where(score > best, 2, skipped > diagonal)
    t, d, pairs = n - 1, int(np.argmax(score)), []
    while t >= 0:
        if moves[t, d] == 2:
            d -= 1
        elif moves[t, d] == 1:
            t, d = t - 1, d + 1
        else:
            if there[t + d] and padded[t + d] == template[t]:
                pairs.append((t, t + d + low))
            t -= 1
    return pairs[::-1]


def align(template: list[bytes], words: list[bytes], offset: int, band: int) -> tuple[int, int, int]:
    """Matched template words of ``path`` and the span of the matched words, end exclusive (0, 0, 0: none)."""
    number = {w: i for i, w in enumerate({*template, *words})}
    pairs = path(np.array([number[w] for w in template], np.int64), np.array([number[w] for w in words], np.int64), offset, band)
    return (len(pairs), pairs[0][1], pairs[-1][1] + 1) if pairs else (0, 0, 0)


def edits_of(pairs: list[tuple[int, int]], n: int) -> int:
    """Template words changed or left out, and words put in between the matched ones."""
    between = sum(max(0, (j - y) - (i - x)) for (x, y), (i, j) in zip(pairs, pairs[1:]))
    return n - len(pairs) + between


def scan_row(hashes: np.ndarray, hits: np.ndarray, index: Index):
    """Matches ``(template, coverage, first word, end word)`` of one document, in order; ``hits``: template, diagonal, template word."""
    found = []
    for t in np.unique(hits[:, 0]).tolist():
        mine, template, most = hits[hits[:, 0] == t], index.hashed[t], index.edits[t]
        if not np.isin(template[index.named[t]], hashes).all():
            continue
        names = set(template[index.named[t]].tolist())
        for offset in diagonals(mine[:, 1], mine[:, 2], most, int(index.need[t])):
            middle, band = offset + most // 2, most + (most + 1) // 2
            if not names.issubset(hashes[max(0, middle - band) : max(0, middle + band + len(template))].tolist()):
                continue
            pairs = path(template, hashes, middle, band)
            if not pairs or (edits := edits_of(pairs, len(template))) > most:
                continue
            # Every name matches, and no other name stands among the words of a notice or title.
            matched = {i for i, _ in pairs}
            title = [j for i, j in pairs if len(template) < NOTICE or i < TITLE]
            other = set(range(title[0], title[-1] + 1)).difference(title) if title else set()
            if matched.issuperset(index.named[t]) and not np.isin(hashes[sorted(other)], index.name_hashes).any():
                found.append((len(pairs), edits, t, pairs[0][1], pairs[-1][1] + 1))
    # Of overlapping matches the one with most words stays, then the one with fewest edits, then the first name.
    out: list[tuple[int, float, int, int]] = []
    for n, _, t, first, last in sorted(found, key=lambda x: (-x[0], x[1], x[2], x[3])):
        if not any(first < hi and lo < last for _, _, lo, hi in out):
            out.append((t, n / len(index.words[t]), first, last))
    return [(index.names[t], c, lo, hi) for t, c, lo, hi in sorted(out, key=lambda x: (x[2], x[3], x[0]))]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with ``n_matches, licenses, coverage, matches`` (underscores before a name that is taken).

    ``matches`` lists ``template, coverage, first_byte, end_byte`` in text
    order, spans in bytes of the UTF-8 text; ``coverage`` is the best one,
    ``licenses`` the distinct templates, comma-joined.  A null or wordless
    text has no match.  Rows are scanned one by one: repeated rows get equal
    results, and an empty table an empty result.
    """
    index_of = shipped(docs.sparkSession, Index(TEMPLATES | license_texts() if templates is None else templates, least=least))
    kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))

    @arrow_udf("array<struct<template:string,coverage:double,first_byte:bigint,end_byte:bigint>>")
    def scanned(texts: pa.Array) -> pa.Array:
        index, lower, is_word, hasher = index_of(), lower_table(), alnum_table(), WordHasher()
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for first, offsets, data in byte_blocks(texts):
            data = lower[data]
            starts, ends, rows, hashes = hasher.words(data, offsets, is_word)
            hits = index.hits(hashes, rows)
            found, firsts = np.unique(hits[:, 0], return_index=True)
            for row, mine in zip(found.tolist(), np.split(hits[:, 1:], firsts[1:])):
                lo, hi = np.searchsorted(rows, [row, row + 1])
                mine[:, 1] -= lo
                for name, coverage, a, b in scan_row(hashes[lo:hi], mine, index):
                    out[first + row].append({"template": name, "coverage": coverage, "first_byte": int(starts[lo + a] - offsets[row]), "end_byte": int(ends[lo + b - 1] - offsets[row])})
        return pa.array(out, kind)

    got = fresh(docs, "_scanned")
    out = docs.withColumn(got, scanned(F.col(text_col)))
    return out.select(
        *docs.columns, F.size(got).cast("long").alias(fresh(docs, "n_matches")),
        F.array_join(F.array_sort(F.array_distinct(F.col(got)["template"])), ",").alias(fresh(docs, "licenses")),
        F.coalesce(F.array_max(F.col(got)["coverage"]), F.lit(0.0)).alias(fresh(docs, "coverage")), F.col(got).alias(fresh(docs, "matches")),
    )


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
