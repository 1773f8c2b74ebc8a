"""License scans: an exact set-similarity join of text blocks and notice templates.

A block is a line, or a paragraph of several lines (paragraphs end at blank
lines). It meets a template when one of its windows, ``SPAN`` times as many
consecutive words as the template has (all of a shorter block), holds at least
``THRESHOLD`` of the template's distinct words, all words that the template
requires, which set its license apart, and none that it excludes. Words stand in
one global order, rarest first by the number of documents that have them,
counted over all documents. With ``need = ceil(threshold * |template|)`` common
words required:

* prefix: block and template must share one of the template's first
  ``|T| - need + 1`` words and that word must be among the block's first
  ``|B| - need + 1`` (words in no template are left out of blocks beforehand);
* length: a block needs at least ``need`` such words;
* position: at the first shared prefix word, what can still match on both sides
  must reach ``need``.

Blocks that pass are verified window by window, so the result is that of
comparing everything with everything. The templates are a small stated set that
every worker holds; what the first pass returns is one count for each template
word. No text is shuffled.

Rules beside it report where stated phrases stand, by word number.

Defined cases: a null text counts as empty; an empty table or an empty text has
no labels and score 0; repeated rows give repeated results; a block of any
length is read whole; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.words import split_words

THRESHOLD = 0.8
#: Phrases that are a license statement as they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of a window for each word of its template.
SPAN = 2


class Template(NamedTuple):
    label: str
    text: str
    required: str = ""
    excluded: str = ""


_MORE = "nc noncommercial nd noderivatives noderivs sa sharealike"
#: Wording of public license notices, whole and by their usual sentence; the words that set a license apart, and those of its neighbours.
TEMPLATES = [
    Template("apache-2.0", "licensed under the apache license version 2.0", "apache license"),
    Template("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license"),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero public license"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary permitted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution binary retain reproduce disclaimer"),
    Template("cc-by", "licensed under cc by 4.0", "licensed cc by", _MORE),
    Template("cc-by", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution", _MORE),
    Template("cc-by-nc", "licensed under cc by-nc 4.0", "cc by nc", "nd noderivatives noderivs sa sharealike"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "creative commons attribution noncommercial", "nd noderivatives noderivs sa sharealike"),
    Template("cc-by-sa", "licensed under cc by-sa 4.0", "cc by sa", "nc noncommercial"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "creative commons attribution sharealike", "nc noncommercial"),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated public domain waiving"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu public license", "lesser affero"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software gnu public license", "lesser affero"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gnu public license foundation", "lesser affero"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission fee granted notice"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", "gnu lesser public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted charge copy software"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission granted charge sublicense furnished"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla public license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0", "mozilla public license mpl"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
]
_BLANK = re.compile(rb"\n[\t\x0b-\r ]*(?:\n[\t\x0b-\r ]*)+")


class _Known:
    """A template as sets of words, with what a window needs."""

    def __init__(self, template: Template, threshold: float):
        own = split_words(template.text.encode())
        self.label, self.words, self.width = template.label, frozenset(own), SPAN * len(own)
        self.required, self.excluded = frozenset(split_words(template.required.encode())), frozenset(split_words(template.excluded.encode()))
        self.need = max(1, ceil(threshold * len(self.words) - 1e-9))

    def held(self, block: list[bytes]) -> int:
        """The most of the template's words that a window of the block holds, or 0 if none meets the template."""
        count: Counter = Counter()
        have = missing = bad = best = 0
        missing = len(self.required)
        for i, w in enumerate(block):
            if w in self.words or w in self.required or w in self.excluded:
                count[w] += 1
                if count[w] == 1:
                    have, missing, bad = have + (w in self.words), missing - (w in self.required), bad + (w in self.excluded)
            if i >= self.width and (old := block[i - self.width]) in count:
                count[old] -= 1
                if not count[old]:
                    del count[old]
                    have, missing, bad = have - (old in self.words), missing + (old in self.required), bad - (old in self.excluded)
            if (i >= self.width - 1 or i == len(block) - 1) and have > best and have >= self.need and not missing and not bad:
                best = have
        return best


class TemplateIndex:
    """Templates as sorted rank lists, and which of them a prefix word points to."""

    def __init__(self, templates: list[Template | tuple], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        known = [_Known(Template(*t), threshold) for t in templates]
        vocabulary = sorted(frozenset().union(*[t.words for t in known]), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = frozenset(vocabulary)
        self.templates = [t for t in known if t.words]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            ranks = sorted(self.rank[w] for w in t.words)
            for i, r in enumerate(ranks[: len(ranks) - t.need + 1]):
                self.prefix.setdefault(r, []).append((k, i))
        self.prefix_words = frozenset(w for w in vocabulary if self.rank[w] in self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Label and containment of every template that a window of the block meets."""
        own = self.vocabulary.intersection(words)
        block = sorted(self.rank[w] for w in own)
        out, seen = [], set()
        for j, r in enumerate(block):
            for k, i in self.prefix.get(r, ()):
                t = self.templates[k]
                if k in seen or j > len(block) - t.need:
                    continue
                seen.add(k)
                if 1 + min(len(t.words) - i - 1, len(block) - j - 1) >= t.need and len(own & t.words) >= t.need and (held := t.held(words)):
                    out.append((t.label, held / len(t.words)))
        return out


def blocks(raw: bytes) -> list[bytes]:
    """Lines with something in them, and paragraphs of several lines."""
    lines = raw.split(b"\n")
    return lines + [p for p in _BLANK.split(raw) if b"\n" in p.strip()] if len(lines) > 1 else lines


def _document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    def count(batches):
        seen = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for w in vocabulary.intersection(split_words(raw)):
                    seen[w] += 1
        words = sorted(w for w in seen if seen[w])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}  # one row for each template word at most


def _phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    text = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        at = spaces = 0
        while (found := text.find(phrase, at)) >= 0:
            spaces += text.count(b" ", at, found)
            out.append((spaces, label))
            at = found
            spaces += 1
            at += 1
    return out


def scan_licenses(docs: DataFrame, *, templates: list[Template | tuple] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document row."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    vocabulary = frozenset(w for t in templates for w in split_words(t[1].encode()))
    frequency = _document_frequency(docs, vocabulary)
    spaced = {b" " + b" ".join(split_words(p.encode())) + b" ": label for p, label in phrases.items()}
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def scan(batches):
        index = TemplateIndex(templates, frequency, threshold)
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split_words(raw)
                places = _phrase_places(words, spaced)
                found: list[tuple[str, float]] = []
                if not index.prefix_words.isdisjoint(words):  # else no block can hold a template
                    for b in blocks(raw):
                        own = split_words(b)
                        if not index.prefix_words.isdisjoint(own):
                            found += index.matches(own)
                base = {label for _, label in places}
                starts = [p for p, _ in places]
                rows.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {label for label, _ in found})), max([s for _, s in found], default=0.0)))
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(scan, schema)
