"""License scan: an exact set-similarity join of text blocks with license
templates.

Templates are taken in classes of like length. A block is a window of twice the
class's longest template, and windows start every such template's length, so any
stretch as long as a template lies whole in a block, and a short notice is not
made of words that are strewn far apart. A block matches a template when it
contains at least ``THRESHOLD`` of the template's distinct words. The join finds
every such pair, and all pairs are returned:

* words are ordered by the number of blocks in the whole corpus that have
  them, rare words first (one pass counts the words of the templates);
* prefix filter: with an overlap of o wanted, the first |T| - o + 1 words of
  the template and the first |B| - o + 1 of the block's template words share
  one;
* length filter: a block with fewer than o template words is left out;
* positional filter: the words that may still come after the shared one must
  be enough to reach o.

Templates of one family differ by a word or two, fewer than the threshold lets
be absent. So of a family's matches a label is given to those whose marks
(``MARKS``: ShareAlike, Lesser and so on) stand in the block, and not where a
template with these and more marks matches there too: the most specific one
names the notice.

Beside the templates, the base phrases are found word for word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import batches, text_bytes, words

THRESHOLD = 0.8

# Phrases of the contract and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices as the licenses' publishers word them, and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                 "in compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
             "License, or (at your option) any later version"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
             "License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
              "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                    "International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                    "International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software"),
]

# The words that mark a license within its family, as the
# licenses' versions word them.
MARKS = {
    "sa": re.compile(rb"(?<![^ ])(?:share ?alike|by (?:nc )?sa)(?![^ ])"),
    "nc": re.compile(rb"(?<![^ ])(?:non ?commercial|by nc)(?![^ ])"),
    "nd": re.compile(rb"(?<![^ ])(?:no ?deriv(?:ative)?s?|by (?:nc )?nd)(?![^ ])"),
    "lesser": re.compile(rb"(?<![^ ])(?:lesser|lgpl)(?![^ ])"),
    "affero": re.compile(rb"(?<![^ ])(?:affero|agpl)(?![^ ])"),
}
#: Family and marks of a template, by label; others are families of their own.
FAMILIES = {
    "cc-by": ("cc", ()), "cc-by-sa": ("cc", ("sa",)), "cc-by-nc": ("cc", ("nc",)), "cc-by-nd": ("cc", ("nd",)),
    "cc-by-nc-sa": ("cc", ("nc", "sa")), "cc-by-nc-nd": ("cc", ("nc", "nd")),
    "gpl": ("gpl", ()), "gpl-3": ("gpl", ()), "lgpl": ("gpl", ("lesser",)), "lgpl-3": ("gpl", ("lesser",)),
    "agpl": ("gpl", ("affero",)), "agpl-3": ("gpl", ("affero",)),
}
#: A class's longest template has at most so many times the words of its shortest.
CLASS_RATIO = 1.5


class Templates:
    """Templates with their words in the global order, and the prefix index."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        tokens = [words(text.encode()) for _, text in templates]
        self.labels = [label for label, _ in templates]
        self.sets = [frozenset(t) for t in tokens]
        self.longest = max(map(len, tokens))
        self.vocabulary = frozenset().union(*self.sets)
        self.needed = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.least = min(self.needed)
        self.order_by(Counter())

    def order_by(self, blocks_with: dict[bytes, int]) -> "Templates":
        """Set the global order: words of fewer blocks first."""
        ordered = sorted(self.vocabulary, key=lambda w: (blocks_with.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(ordered)}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, (s, o) in enumerate(zip(self.sets, self.needed)):
            for i, w in enumerate(sorted(s, key=self.rank.__getitem__)[:len(s) - o + 1]):
                self.prefix.setdefault(w, []).append((t, i))
        return self

    def blocks_at(self, places: list[tuple[int, bytes]], n: int) -> dict[int, set[bytes]]:
        """The template words of each block that has any, by its first word, of
        a text of ``n`` words; ``places`` are its words with their numbers."""
        step, out = self.longest, {}
        last = (max(1, n - step) - 1) // step * step
        for i, w in places:
            if w in self.vocabulary:
                at = i // step * step
                if at <= last:
                    out.setdefault(at, set()).add(w)
                if at:
                    out.setdefault(at - step, set()).add(w)
        return out

    def blocks(self, tokens: list[bytes]) -> Iterator[frozenset[bytes]]:
        """The template words of each block that has any."""
        return map(frozenset, self.blocks_at(list(enumerate(tokens)), len(tokens)).values())

    def matches(self, block: frozenset[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) of every template that reaches the threshold."""
        if len(block) < self.least:  # length filter for all templates at once
            return
        size, shared, out = len(block), Counter(), set()
        for j, w in enumerate(sorted(block, key=self.rank.__getitem__)[:size - self.least + 1]):
            for t, i in self.prefix.get(w, ()):
                o = self.needed[t]
                if size < o or j > size - o or t in out:
                    continue
                if shared[t] + 1 + min(len(self.sets[t]) - i - 1, size - j - 1) < o:
                    out.add(t)
                else:
                    shared[t] += 1
        for t in shared.keys() - out:
            overlap = len(self.sets[t] & block)
            if overlap >= self.needed[t]:
                yield t, overlap / len(self.sets[t])


def length_classes(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[Templates]:
    """The templates in classes of like length."""
    classes: list[list[tuple[str, str]]] = []
    for item in sorted(templates, key=lambda item: (len(words(item[1].encode())), item)):
        if classes and len(words(item[1].encode())) <= CLASS_RATIO * len(words(classes[-1][0][1].encode())):
            classes[-1].append(item)
        else:
            classes.append([item])
    return [Templates(c, threshold) for c in classes]


def template_places(tokens: list[bytes], classes: list[Templates]) -> list[tuple[int, bytes]]:
    every = frozenset().union(*(c.vocabulary for c in classes))
    return [(i, w) for i, w in enumerate(tokens) if w in every]


def block_frequencies(docs: DataFrame, classes: list[Templates], text_col: str = "text") -> list[dict[bytes, int]]:
    """For each class and word of its templates the blocks of all documents
    that have it. Each task returns one row a class and word, so the result is
    bounded by the templates."""
    schema = pa.schema([("class", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        seen = [Counter() for _ in classes]
        for b in it:
            for data in b.column(0).to_pylist():
                tokens = words(data)
                places = template_places(tokens, classes)
                for cut, counter in zip(classes, seen):
                    for block in cut.blocks_at(places, len(tokens)).values():
                        counter.update(block)
        rows = [(k, w, n) for k, counter in enumerate(seen) for w, n in counter.items()]
        yield from batches(schema, [list(map(list, zip(*rows))) or [[], [], []]])

    rows = (docs.select(text_bytes(text_col).alias("data")).mapInArrow(run, "class int, word binary, n long")
            .groupBy("class", "word").agg(F.sum("n").alias("n")).collect())
    out: list[dict[bytes, int]] = [{} for _ in classes]
    for r in rows:
        out[r["class"]][bytes(r["word"])] = r["n"]
    return out


def matched_pairs(tokens: list[bytes], classes: list[Templates]) -> list[tuple[int, int, str, float, frozenset[str]]]:
    """(first word, end, label, containment, marks) of every pair of a block and
    a template that reaches the threshold, by first word; the marks are those in
    the block's text."""
    places, out = template_places(tokens, classes), []
    for cut in classes:
        for at, block in cut.blocks_at(places, len(tokens)).items():
            found = list(cut.matches(frozenset(block))) if len(block) >= cut.least else []
            if found:
                text = b" ".join(tokens[at:at + 2 * cut.longest])
                marks = frozenset(m for m, p in MARKS.items() if p.search(text))
                out += [(at, at + 2 * cut.longest, cut.labels[t], share, marks) for t, share in found]
    return sorted(out, key=lambda x: (*x[:3], x[3]))


def named_pairs(pairs: list[tuple]) -> list[tuple[str, float]]:
    """(label, containment) of the pairs that name a notice: all their marks
    are there, and no overlapping pair of the family has these and more."""
    fit = []
    for at, end, label, share, marks in pairs:
        family, own = FAMILIES.get(label, (label, ()))
        if marks.issuperset(own):
            fit.append((at, end, label, share, family, frozenset(own)))
    out, longest = [], max((end - at for at, end, *_ in fit), default=0)
    first = 0
    for at, end, label, share, family, own in fit:
        while fit[first][0] <= at - longest:
            first += 1
        beaten, k = False, first
        while k < len(fit) and fit[k][0] < end and not beaten:
            beaten = fit[k][4] == family and fit[k][1] > at and own < fit[k][5]
            k += 1
        if not beaten:
            out.append((label, share))
    return out


def base_places(tokens: list[bytes], phrases: list[tuple[bytes, int, str]]) -> list[tuple[int, str]]:
    """(word, label) of every place of a base phrase."""
    joined, out = b" ".join(tokens), []
    for phrase, _, label in phrases:
        word = at = 0
        for m in re.finditer(rb"(?<![^ ])" + re.escape(phrase) + rb"(?![^ ])", joined):
            word += joined.count(b" ", at, m.start())
            at = m.start()
            out.append((word, label))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id long, n_words long, n_base long,
    first_word and last_word long (null without a base place), base_labels
    string, labels string (of the base places and of the notices' most specific
    templates), score double (1 with a base place, else the largest containment of
    a labelled notice, else 0), pairs array of (label, first_word, containment):
    every block and template that reach the threshold, by the block's first word.

    Null, empty and wordless texts have no words, labels or places. A null
    doc_id stays; repeated rows give repeated results; an empty table gives no
    rows; other columns are ignored."""
    classes = length_classes(templates, threshold)
    for cut, counts in zip(classes, block_frequencies(docs, classes, text_col)):
        cut.order_by(counts)
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    base = [(p.encode(), len(p.split()), label) for p, label in phrases.items()]
    fields = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, pairs array<struct<label:string,first_word:long,containment:double>>")
    pair = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                        ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                        ("labels", pa.string()), ("score", pa.float64()), ("pairs", pa.list_(pair))])

    def row(data: bytes | None, classes: list[Templates]) -> tuple:
        tokens = words(data)
        places = base_places(tokens, base)
        starts = [k for k, _ in places]
        labels = {label for _, label in places}
        pairs = matched_pairs(tokens, classes)
        named = named_pairs(pairs)
        score = 1.0 if places else max((share for _, share in named), default=0.0)
        return (len(tokens), len(places), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(labels)), ",".join(sorted(labels | {label for label, _ in named})), score,
                [{"label": label, "first_word": at, "containment": share} for at, _, label, share, _ in pairs])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        yield from batches(schema, (
            [b.column(0), *map(list, zip(*(row(t, classes) for t in b.column(1).to_pylist())))]
            for b in it if b.num_rows))

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
            .mapInArrow(run, fields))
