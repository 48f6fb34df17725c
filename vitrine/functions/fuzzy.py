"""Indel similarity of words: ``200 * LCS / (len(a) + len(b))``.

The longest common subsequence is found with one bit mask per character of a
term, one step per character of the word: as a native expression against a
short list of terms, or by ``lcs_length`` for pairs of words of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK_BITS = 62


def _mask_map(term: str) -> Column:
    masks: dict[str, int] = {}
    for position, char in enumerate(term):
        masks[char] = masks.get(char, 0) | (1 << position)
    entries = [item for char, mask in masks.items() for item in (F.lit(char), F.lit(mask).cast("bigint"))]
    return F.create_map(*entries)


def vocabulary_literal(terms: list[str]) -> Column:
    """The vocabulary as an array of ``struct<term, len, masks>``."""
    if any(len(t) > MASK_BITS for t in terms):
        raise ValueError(f"terms over {MASK_BITS} characters need the joined form")
    return F.array(
        *[
            F.struct(F.lit(t).alias("term"), F.lit(len(t)).alias("len"), _mask_map(t).alias("masks"))
            for t in terms
        ]
    )


def _lcs_with_masks(chars: Column, masks: Column, term_length: Column) -> Column:
    full = F.expr("CAST(1 AS BIGINT)")
    all_ones = F.call_function("shiftleft", full, term_length) - F.lit(1)
    steps = F.transform(chars, lambda c: F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("bigint")))
    rest = F.aggregate(
        steps,
        all_ones,
        lambda v, m: ((v + v.bitwiseAND(m)).bitwiseOR(v - v.bitwiseAND(m))).bitwiseAND(all_ones),
    )
    return term_length - F.bit_count(rest)


def best_term(word: Column, vocabulary: Column, threshold: int) -> Column:
    """Best vocabulary term scoring at least ``threshold``, else NULL.

    Scores are compared as integers (``200 * LCS >= threshold * lengths``);
    equal scores are settled by the smaller term.
    """
    chars = F.split(word, "")
    size = F.length(word)
    limit = F.lit(int(threshold))
    reachable = F.filter(vocabulary, lambda d: F.least(d["len"], size) * 200 >= limit * (d["len"] + size))
    scored = F.transform(
        reachable,
        lambda d: F.struct(
            (_lcs_with_masks(chars, d["masks"], d["len"]) * 200).alias("hits"),
            (d["len"] + size).alias("total"),
            d["term"].alias("term"),
        ),
    )
    passing = F.filter(scored, lambda s: s["hits"] >= limit * s["total"])
    ranked = F.transform(passing, lambda s: F.struct((-(s["hits"] / s["total"])).alias("rank"), s["term"].alias("term")))
    return F.array_min(ranked)["term"]


def bigrams(word: Column) -> Column:
    """Distinct character pairs of a word, with markers before and after it."""
    padded = F.concat(F.lit("\u0002"), word, F.lit("\u0003"))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(..))"), 1))


def numbered_characters(word: Column) -> Column:
    """Each character of a word with its number among its equals."""
    chars = F.split(word, "")
    return F.transform(
        chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda other: other == c)).cast("string"))
    )


# Pairs are handled so many at a time, side by side up to words of so many characters.
_AT_ONCE, _WORD_BITS = 1 << 14, (16, 64)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters as code points, and where each word's begin."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(words.to_pylist())
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _square(codes: np.ndarray, starts: np.ndarray, which: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Words as rows of ``width`` characters, filled up."""
    columns = np.arange(width)
    begin, end = starts[which][:, None], starts[which + 1][:, None]
    at = np.minimum(begin + columns, max(0, len(codes) - 1))
    return np.where(begin + columns < end, codes[at], np.uint32(fill)) if len(codes) else np.full((len(which), width), fill, np.uint32)


def _lcs_side_by_side(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """LCS lengths of rows of up to 64 characters: a bit per character of the left word, one
    step of all pairs per character of the right one. Fillers of both sides differ."""
    bits = 8 * -(-left.shape[1] // 8)
    kind = {8: np.uint8, 16: np.uint16}.get(bits, np.uint64)
    rest = np.full(len(left), np.iinfo(kind).max, kind)
    for step in range(right.shape[1]):
        equal = np.zeros((len(left), 8 * np.dtype(kind).itemsize), bool)
        equal[:, : left.shape[1]] = left == right[:, step : step + 1]
        hit = rest & np.packbits(equal, axis=1, bitorder="little").view(kind)[:, 0]
        rest = (rest + hit) | (rest - hit)
    return (np.dtype(kind).itemsize * 8 - np.bitwise_count(rest)).astype(np.int32)


def _lcs_long(a: str, b: str) -> int:
    """The same for one pair, with an integer as wide as the word."""
    masks: dict[str, int] = {}
    for position, char in enumerate(a):
        masks[char] = masks.get(char, 0) | (1 << position)
    ones = rest = (1 << len(a)) - 1
    for char in b:
        hit = rest & masks.get(char, 0)
        rest = ((rest + hit) | (rest - hit)) & ones
    return len(a) - rest.bit_count()


@F.arrow_udf(T.IntegerType())
def lcs_length(left: pa.Array, right: pa.Array) -> pa.Array:
    """Longest common subsequence of two words of any length, many pairs at a time."""
    out = np.zeros(len(left), np.int32)
    for begin in range(0, len(left), _AT_ONCE):
        a, b = left.slice(begin, _AT_ONCE), right.slice(begin, _AT_ONCE)
        (a_codes, a_starts), (b_codes, b_starts) = _codes(a), _codes(b)
        longest = np.maximum(np.diff(a_starts), np.diff(b_starts))
        low = -1
        for high in _WORD_BITS:
            which = np.flatnonzero((longest > low) & (longest <= high))
            low = high
            if len(which):
                widths = [max(1, int(np.diff(s)[which].max())) for s in (a_starts, b_starts)]
                square = _square(a_codes, a_starts, which, widths[0], 0x110000), _square(b_codes, b_starts, which, widths[1], 0x110001)
                out[begin + which] = _lcs_side_by_side(*square)
        for i in np.flatnonzero(longest > low).tolist():
            out[begin + i] = _lcs_long(a[i].as_py(), b[i].as_py())
    return pa.array(out, pa.int32())


def _best_of(words: pa.Array, terms: list[str], threshold: int) -> np.ndarray:
    """Of each word the number of the best of the sorted ``terms``, or -1. A character's places in
    all words are found once; then every term takes one step of all words per character."""
    codes, starts = _codes(words)
    sizes = np.diff(starts)
    best, ratio = np.full(len(sizes), -1, np.int32), np.full(len(sizes), -1.0)
    places: dict[str, np.ndarray] = {}
    short = np.flatnonzero(sizes <= 64)
    square = _square(codes, starts, short, max(1, int(sizes[short].max(initial=1))), 0x110000)
    for char in sorted(set("".join(terms))):
        equal = np.zeros((len(short), 64), bool)
        equal[:, : square.shape[1]] = square == ord(char)
        places[char] = np.packbits(equal, axis=1, bitorder="little").view(np.uint64)[:, 0]
    for number, term in enumerate(terms):
        total = sizes + len(term)
        able = 200 * np.minimum(sizes, len(term)) >= threshold * total
        which = np.flatnonzero(able[short])
        rest = np.full(len(which), np.iinfo(np.uint64).max, np.uint64)
        for char in term:
            hit = rest & places[char][which]
            rest = (rest + hit) | (rest - hit)
        hits = np.zeros(len(sizes), np.int64)
        hits[short[which]] = 200 * (64 - np.bitwise_count(rest).astype(np.int64))
        for i in np.flatnonzero(able & (sizes > 64)).tolist():
            hits[i] = 200 * _lcs_long(words[i].as_py(), term)
        own = np.where(able, hits / np.maximum(total, 1), -1.0)
        better = able & (hits >= threshold * total) & (own > ratio)
        best[better], ratio[better] = number, own[better]
    return best


def best_of(terms: list[str], threshold: int):
    """A function of a word column: the best term scoring at least ``threshold``, else NULL; equal
    scores go to the smaller term. For vocabularies of a few hundred terms."""
    ordered = sorted(set(terms))

    @F.arrow_udf(T.StringType())
    def find(words: pa.Array) -> pa.Array:
        names = pa.array(ordered, pa.string())
        parts = [_best_of(words.slice(at, _AT_ONCE), ordered, threshold) for at in range(0, len(words), _AT_ONCE)]
        found = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return names.take(pa.array(found, mask=found < 0))

    return find
