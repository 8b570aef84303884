"""Licence scans with a positional index of rare words.

A template is a licence notice as words, with the phrases that must stand in a text for
its label. Every phrase is a posting: its words with their relative positions. How rare a
licence word is comes from the corpus: one pass counts, for the words of the templates
only, the documents that have them. A text's licence words are looked up from the rarest
on. The postings of a word give the places where a phrase would have to start; the start
stays if all its words stand at their relative positions. A phrase is posted under its own
rarest word, so a text without that word costs one look per word and no place is missed.

A template's label is given if its mandatory phrases were found; its score is the share of
the template's words that stand at the relative positions of the best start. The base
phrases are templates of one phrase each.

Defined results: a null text is empty and has no label; a repeated row gives a row of its
own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Label, the notice, and the phrases of it that are mandatory.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files the software to deal in the software without restriction",
     ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except "
                 "in compliance with the license",
     ["you may not use this file except in compliance with the license"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3",
     ["gnu affero general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted",
     ["permission to use copy modify and or distribute this software for any purpose"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license v 2 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "to the extent possible under law the author has waived all copyright cc0 1 0", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software released into the public domain"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def licence_words(text: str | None) -> list[bytes]:
    """The words in ASCII lower case, as UTF-8; other scripts' letters count as word characters."""
    return _WORD.findall((text or "").encode().lower())


class Phrases:
    """The templates' phrases, posted under their rarest words."""

    def __init__(self, base: dict[str, str], templates, rarity: dict[bytes, float]):
        self.base = [(tuple(p.encode().split()), label) for p, label in base.items()]
        self.templates = [(label, tuple(whole.encode().split()), [tuple(p.encode().split()) for p in needed])
                          for label, whole, needed in templates]
        self.rarity = rarity
        self.postings: dict[bytes, list[tuple[tuple[bytes, ...], int]]] = defaultdict(list)
        for phrase in {p for p, _ in self.base} | {p for *_, ps in self.templates for p in ps}:
            at = max(range(len(phrase)), key=lambda i: (rarity.get(phrase[i], 0.0), phrase[i], -i))
            self.postings[phrase[at]].append((phrase, at))
        self.posted = frozenset(self.postings)

    def starts(self, words: list[bytes]) -> dict[tuple[bytes, ...], list[int]]:
        """Where each phrase stands."""
        places = defaultdict(list)
        if self.posted.isdisjoint(words):
            return places
        seen = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.posted:
                seen[w].append(i)
        for word in sorted(seen, key=lambda w: (-self.rarity.get(w, 0.0), w)):
            for phrase, at in self.postings[word]:
                n = len(phrase)
                places[phrase] += [i - at for i in seen[word]
                                   if i >= at and tuple(words[i - at:i - at + n]) == phrase]
        return {p: s for p, s in places.items() if s}

    def scan(self, text: str | None):
        """(n_words, n_base, first, last, base labels, all labels, score)."""
        words = licence_words(text)
        places = self.starts(words)
        if not places:
            return len(words), 0, None, None, "", "", 0.0
        found = [(s, label) for phrase, label in self.base for s in places.get(phrase, ())]
        labels, score = {label for _, label in found}, float(bool(found))
        for label, whole, needed in self.templates:
            if all(p in places for p in needed):
                votes = Counter(s - _offset(whole, p) for p in needed for s in places[p])
                share = max(sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(whole))
                            for s in votes) / len(whole)
                labels.add(label)
                score = max(score, share)
        at = [s for s, _ in found]
        return (len(words), len(at), min(at, default=None), max(at, default=None),
                ",".join(sorted({label for _, label in found})), ",".join(sorted(labels)), score)


def _offset(whole, phrase) -> int:
    return next(i for i in range(len(whole)) if whole[i:i + len(phrase)] == phrase)


def word_rarity(docs: DataFrame, text: str, vocabulary: list[bytes]) -> dict[bytes, float]:
    """IDF over the whole corpus of the templates' words (as many rows as there are words)."""
    import math
    known = frozenset(vocabulary)

    def count(batches):
        n, having = 0, Counter()
        for batch in batches:
            for value in batch.column(0):
                n += 1
                having.update(known.intersection(licence_words(value.as_py())))
        words = [b"", *having]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([n, *having.values()], pa.int64())],
                                         names=["word", "n"])

    rows = (docs.select(F.col(text).alias("t")).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    have = {bytes(r["word"]): r["n"] for r in rows}
    total = have.get(b"", 0)
    return {w: math.log((total + 1) / (have.get(w, 0) + 1)) for w in vocabulary}


def scan_licences(docs: DataFrame, text: str = "text", base=None, templates=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w.encode() for p in [*base, *(t[1] for t in templates)] for w in p.split()})
    phrases = Phrases(base, templates, word_rarity(docs, text, vocabulary))

    def scan(batches):
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            cols = list(zip(*[phrases.scan(t.as_py()) for t in batch.column("_text")])) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")
