"""Licence scan with a generalised suffix automaton over the words of licence texts.

Only runs of words that contain template trigrams reach the automaton. It
gives, at every word, the longest stretch that ends there and stands in some
template (matching statistics). Long stretches are chained into spans in which
a template's words appear in order, and a span counts by the share covered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm import blocks

# Phrases that name a licence, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening and operative sentences of public licence texts, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited"),
]

SHORTEST = 4
WIDEST_GAP = 12
LEAST_COVERED = 0.7


class Span(NamedTuple):
    label: str
    phrase: bool
    start: int
    end: int
    covered: float


class Automaton:
    """Suffix automaton of several word sequences, with where each state ends."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.places[last].append((number, at))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[state]].extend(self.places[state])

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.places.append([])
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state reached from ``state`` by ``word``, no longer than one word more."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def stream(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest match that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            yield state, length


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]) -> None:
        texts = [text.split() for text in phrases] + [text.split() for _, text in templates]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.phrases = len(phrases)
        vocabulary = sorted({word for text in texts for word in text})
        number = {word: i for i, word in enumerate(vocabulary)}
        raw = [np.frombuffer(word.encode(), np.uint8) for word in vocabulary]
        ends = np.cumsum([len(r) for r in raw])
        starts = ends - [len(r) for r in raw]
        hashes = blocks.span_hashes(blocks.running_bytes(np.concatenate(raw)), starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.likely = np.zeros(1 << 16, bool)
        self.likely[self.hashes & np.uint64(0xFFFF)] = True
        sequences = [[number[word] for word in text] for text in texts]
        self.sizes = [len(s) for s in sequences]
        self.base = len(vocabulary) + 1
        self.shortest = min([SHORTEST, *self.sizes])
        grams = {self._gram(s[i : i + 3]) for s in sequences for i in range(len(s) - 2)}
        self.grams = np.array(sorted(grams), np.int64)
        self.automaton = Automaton(sequences)

    def _gram(self, words: list[int]) -> int:
        return (words[0] * self.base + words[1]) * self.base + words[2]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.likely[hashes & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out

    def runs(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words (in a slab) made of template trigrams; ``first``
        marks the first word of each text."""
        if len(words) < 3:
            return []
        a, b, c = words[:-2], words[1:-1], words[2:]
        maybe = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0) & ~first[1:-1] & ~first[2:])
        gram = (a[maybe] * self.base + b[maybe]) * self.base + c[maybe]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        hits = maybe[self.grams[at] == gram]
        if not len(hits):
            return []
        breaks = np.flatnonzero(np.diff(hits) != 1) + 1
        return [(int(g[0]), int(g[-1]) + 3) for g in np.split(hits, breaks)]

    def matches(self, words: list[int], base: int) -> Iterator[tuple[int, int, int, int]]:
        """Long matches of a stretch that can't be extended: (template, its end, end, length)."""
        trace = list(self.automaton.stream(words))
        for i, (state, length) in enumerate(trace):
            grows = i + 1 < len(trace) and trace[i + 1][1] == length + 1
            if not grows and length >= SHORTEST:
                for number, at in self.automaton.places[state]:
                    if number >= self.phrases:
                        yield number, at, base + i, length
            walk = state
            while walk:  # whole phrases that end here
                if self.automaton.length[walk] <= length:
                    for number, at in self.automaton.places[walk]:
                        if number < self.phrases and at + 1 == self.sizes[number] == self.automaton.length[walk]:
                            yield number, at, base + i, self.sizes[number]
                walk = self.automaton.link[walk]

    def spans(self, found: list[tuple[int, int, int, int]]) -> list[Span]:
        """Chains of matches in text order whose template positions also rise."""
        out = []
        chains: dict[int, list[int]] = {}

        def close(number: int) -> None:
            start, end, _, covered = chains.pop(number)
            share = min(1.0, covered / self.sizes[number])
            if share >= LEAST_COVERED:
                out.append(Span(self.labels[number], False, start, end, share))

        for number, at, end, length in sorted(set(found), key=lambda m: (m[2], -m[3], m[0], m[1])):
            if number < self.phrases:
                out.append(Span(self.labels[number], True, end - length + 1, end + 1, 1.0))
                continue
            chain = chains.get(number)
            start = end - length + 1
            if chain and (at <= chain[2] or start - chain[1] > WIDEST_GAP):
                if at <= chain[2] and start < chain[1]:
                    continue  # the same words at another place of the template
                close(number)
                chain = None
            if chain is None:
                chains[number] = [start, end + 1, at, length]
            else:
                chain[3] += min(length, at - chain[2])
                chain[1:3] = [end + 1, at]
        for number in list(chains):
            close(number)
        return sorted(out, key=lambda s: (s.start, s.end, s.label))


SPAN_TYPE = "label string, phrase boolean, start bigint, end bigint, covered double"
_ARROW_SPAN = pa.struct(
    [("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]
)


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence phrases and covered template spans of every whole text: (id, n_words, spans).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case; positions count words from 0, ends exclusive. Phrases (of three
    words or more) are found at every place they stand; a template counts where
    a chain of long matches covers enough of it. NULL and empty texts have no
    words and no spans. Rows come back one for one, NULL and repeated ids
    included; other columns play no part, and an empty table gives no rows.
    """
    if any(len(text.split()) < 3 for text in [*phrases, *(text for _, text in templates)]):
        raise ValueError("phrases and templates need three words or more")
    spans = T.ArrayType(T.StructType.fromDDL(SPAN_TYPE))
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", spans)]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for slab in blocks.slabs(batch, "text"):
                data = blocks.lowered(slab.data)
                word = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
                starts, ends = blocks.word_spans(word, slab.offsets)
                bounds = np.searchsorted(starts, slab.offsets)
                first = np.zeros(len(starts) + 1, bool)
                first[bounds] = True
                words = scanner.known(blocks.span_hashes(blocks.running_bytes(data), starts, ends))
                found: dict[int, list[tuple[int, int, int, int]]] = {}
                for low, high in scanner.runs(words, first[:-1]):
                    row = int(np.searchsorted(bounds, low, "right")) - 1
                    stretch = scanner.matches(words[low:high].tolist(), low - int(bounds[row]))
                    found.setdefault(row, []).extend(stretch)
                lists = [[s._asdict() for s in scanner.spans(found[i])] if i in found else [] for i in range(slab.last - slab.first)]
                yield pa.RecordBatch.from_arrays(
                    [blocks.column(batch, "id", slab), pa.array(np.diff(bounds)), pa.array(lists, pa.list_(_ARROW_SPAN))],
                    ["id", "n_words", "spans"],
                )

    named = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    return named.mapInArrow(blocks.tidy(run), schema)
