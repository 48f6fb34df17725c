"""Benchmark decontamination by q-gram counting and banded alignment.

A benchmark item is cut into windows. A text region within the edit budget of a
window shares at least ``length + 1 - q - q * budget`` of its q-grams with it, on
diagonals no further apart than the budget (the q-gram lemma). So shared q-grams
are counted in overlapping bands of diagonals, bands that reach the bound are
kept, and only those are aligned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import sizing
from vitrine.llm import blocks

Q = 8  # a q-gram is one 64-bit word
BUDGET = 0.1
#: Windows stand no further apart than a window's budget, so a copied passage that is
#: within the budget of a window at any place has one that holds all of it.
WINDOW_BYTES, STRIDE_BYTES = 120, 10
#: Shorter items are held only as they are and as whole words; those shorter than a q-gram are no passages.
EXACT_BYTES = 32
#: Items are compared in blocks of so many bytes at most, one pass over the documents each;
#: a byte stands in some ``WINDOW_BYTES / STRIDE_BYTES`` windows.
BLOCK_BYTES = 2 << 20
_FILTER_BITS, _FAR = 22, 1 << 62
_SLOTS, _BATCH, _MANY, _POSTINGS = 1 << 18, 2048, 1 << 20, 1 << 20
#: Texts are searched in smaller slabs than elsewhere, as each place may have several postings.
_SLAB_BYTES = 1 << 19


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, with each run of bytes that are neither ASCII letters and digits
    nor non-ASCII as one space; where each byte came from; the new offsets."""
    low = blocks.lowered(data)
    word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    keep = word.copy()
    keep[1:] |= word[:-1]
    came = np.flatnonzero(keep)
    return np.where(word, low, 32).astype(np.uint8)[came], came, np.searchsorted(came, offsets)


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray(len(data) - Q + 1, np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


class Index:
    """The windows of a block of items, and where each q-gram stands in them."""

    def __init__(self, texts: list[str], budget: float = BUDGET) -> None:
        owners, windows = [], []
        stride = min(STRIDE_BYTES, max(1, int(WINDOW_BYTES * budget)))
        for owner, text in enumerate(texts):
            raw = np.frombuffer(text.encode(), np.uint8)
            data = plain(raw, np.array([0, len(raw)]))[0].tobytes().rstrip()
            if len(data) < Q:
                continue
            starts = [*range(0, len(data) - WINDOW_BYTES, stride), max(0, len(data) - WINDOW_BYTES)]
            cuts = [(s, min(len(data), s + WINDOW_BYTES)) for s in starts]
            owners += [owner] * len(cuts)
            windows += [np.frombuffer(data[a:b], np.uint8) for a, b in cuts]
        self.owners, self.windows = np.array(owners, np.int64), windows
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.budgets = np.minimum((self.sizes * budget).astype(np.int64), (self.sizes - Q) // Q)
        self.budgets[self.sizes < EXACT_BYTES] = 0
        self.least = self.sizes + 1 - Q - Q * self.budgets
        self.width = int(self.budgets.max(initial=0)) + 1
        grams = [_grams(w) for w in windows]
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        which = np.repeat(np.arange(len(windows)), [len(g) for g in grams])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(flat, kind="stable")
        self.window_of, self.place_of = which[order], at[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.likely = np.zeros(1 << _FILTER_BITS, bool)
        self.likely[_slot(self.grams)] = True

    def bands(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, lowest diagonal) of the bands of twice ``width`` diagonals
        whose shared q-grams reach the window's bound."""
        grams = _grams(data)
        maybe = np.flatnonzero(self.likely[_slot(grams)])
        at = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        hit = self.grams[at] == grams[maybe]
        place, at = maybe[hit], at[hit]
        span = (len(data) + WINDOW_BYTES) // self.width + 2
        # A repetitive item has many places per q-gram: they are counted a bounded number at a time.
        parts = np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(self.count[at]) // _POSTINGS)) + 1)

        def keys_of(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts = self.count[at[part]]
            posting = blocks.ragged(self.first[at[part]], counts)
            window = self.window_of[posting]
            band = (np.repeat(place[part], counts) - self.place_of[posting] + WINDOW_BYTES) // self.width
            return window * span + band, self.least[window]

        filled = np.zeros(_SLOTS + 1, np.int64)
        single = len(parts) == 1
        first = keys_of(parts[0])
        for part in parts:
            keys, _ = first if single else keys_of(part)
            filled[:_SLOTS] += np.bincount(keys & (_SLOTS - 1), minlength=_SLOTS)  # neighbours stay neighbours
        filled[_SLOTS] = filled[0]
        two = filled[:-1] + filled[1:]
        found = []
        for part in parts:
            keys, least = first if single else keys_of(part)
            slot = keys & (_SLOTS - 1)
            found.append(np.unique(keys[np.maximum(two[slot], two[slot - 1]) >= least], return_counts=True))
        keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        shared = np.bincount(which, np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
        both = keys[1:] == keys[:-1] + 1  # two neighbours make a band
        pairs = shared.copy()
        pairs[:-1] += np.where(both, shared[1:], 0)
        lone = np.ones(len(keys), bool)
        lone[1:] = ~both
        low = np.concatenate([keys, keys[lone] - 1])
        total = np.concatenate([pairs, shared[lone]])
        enough = total >= self.least[low // span]
        return low[enough] // span, (low[enough] % span) * self.width - WINDOW_BYTES

    def align(
        self, windows: np.ndarray, lows: np.ndarray, begins: np.ndarray, stops: np.ndarray, data: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window against ``data[begin:stop]`` on its band, and the
        end there. The edits never fall along the window, so a band that has used
        up its budget is dropped (its edits stay too many)."""
        sizes, budgets = self.sizes[windows], self.budgets[windows]
        longest = int(sizes.max(initial=0))
        patterns = np.zeros((len(windows), longest), np.uint8)
        for window in np.unique(windows).tolist():
            patterns[windows == window, : self.sizes[window]] = self.windows[window]
        wide = 4 * self.width
        steps = np.arange(wide, dtype=np.int32)
        base = lows - self.width
        edits, ends = np.full(len(windows), _MANY, np.int64), np.zeros(len(windows), np.int64)
        live, cost = np.arange(len(windows)), np.zeros((len(windows), wide + 1), np.int32)
        cost[:, wide] = _MANY
        padded = np.concatenate([data, np.zeros(longest + wide, np.uint8)])
        for i in range(longest):
            at = (base[live] + i)[:, None] + steps
            other = padded[np.maximum(at, 0)] != patterns[live, i][:, None]
            other |= (at < begins[live][:, None]) | (at >= stops[live][:, None])
            now = np.minimum(cost[:, :-1] + other, cost[:, 1:] + 1) - steps
            cost[:, :-1] = np.minimum.accumulate(now, axis=1) + steps
            ended = sizes[live] == i + 1
            if ended.any():
                best = cost[ended, :-1].argmin(1)
                edits[live[ended]] = cost[np.flatnonzero(ended), best]
                ends[live[ended]] = base[live[ended]] + best + i + 1
            if i % 8 == 7 or ended.any():
                going = ~ended & (cost[:, :-1].min(1) <= budgets[live])
                live, cost = live[going], cost[going]
                if not len(live):
                    break
        return edits, ends

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of all matching windows; the start is that
        of an alignment without gaps. ``data`` is already plain."""
        if not self.windows or len(data) < Q:
            return
        windows, lows = self.bands(data)
        ends = lows + 2 * self.width + self.sizes[windows]
        first = np.maximum(np.searchsorted(offsets, np.maximum(lows, 0), "right") - 1, 0)
        last = np.minimum(np.searchsorted(offsets, np.minimum(ends, len(data)), "left"), len(offsets) - 1)
        counts = np.maximum(last - first, 0)  # a band may touch several short texts
        rows = blocks.ragged(first, counts)
        windows, lows = np.repeat(windows, counts), np.repeat(lows, counts)
        begins, stops = offsets[rows], offsets[rows + 1]
        # Where a row holds an item unchanged, later places of that item cannot be better.
        exact: dict[tuple[int, int], int] = {}
        order = np.argsort(lows, kind="stable")
        rows, windows, lows, begins, stops = (a[order] for a in (rows, windows, lows, begins, stops))
        owners = self.owners[windows]
        for low in range(0, len(rows), _BATCH):
            part = np.arange(low, min(len(rows), low + _BATCH))
            if exact:
                ahead = (lows[part] - 2 * self.width - begins[part]).tolist()
                pairs = zip(rows[part].tolist(), owners[part].tolist(), ahead, strict=True)
                part = part[[exact.get((row, owner), _FAR) >= at for row, owner, at in pairs]]
            edits, ends = self.align(windows[part], lows[part], begins[part], stops[part], data)
            for i in np.flatnonzero(edits <= self.budgets[windows[part]]).tolist():
                row, window, begin, stop = (int(a[part[i]]) for a in (rows, windows, begins, stops))
                size, item = int(self.sizes[window]), int(self.owners[window])
                end = min(int(ends[i]), stop) - begin
                start = max(0, end - size)
                if size < EXACT_BYTES and not (begin + start == begin or data[begin + start - 1] == 32) & (begin + end == stop or data[begin + end] == 32):
                    continue
                if edits[i] == 0:
                    exact[row, item] = min(exact.get((row, item), _FAR), start)
                yield row, item, start, end, int(edits[i])


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of bounded size: their ids and texts."""
    size = F.octet_length("text")
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    count = -(-total // BLOCK_BYTES)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(count, 1) * 2 if count > 1 else 1)))
    for block in range(count * 2 if count > 1 else count):
        rows = dealt.filter(F.col("block") == block).orderBy("item", "text").collect()
        yield [r["item"] for r in rows], [r["text"] for r in rows]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    budget: float = BUDGET,
) -> DataFrame:
    """Documents that hold a passage of a benchmark item: (id, item, start, end, edits).

    Texts and items are compared in lower case, other than letters and digits
    as single spaces. The windows of an item are its passages: ``WINDOW_BYTES`` long,
    ``STRIDE_BYTES`` apart or nearer for a small budget, and the last; a shorter item is one
    itself. A passage is held if some region differs by at most ``budget`` edits per
    byte, so an exact copy of ``1 - budget`` of a window is found wherever it starts. An item
    shorter than ``EXACT_BYTES`` is held only unchanged and as whole words, and one shorter than
    ``Q`` bytes (a word or two) is no passage. One row for each document and
    item: its fewest edits, and of those the first place, as byte positions of
    the compared form. NULL
    texts hold nothing, NULL items are left out, rows without an id take no
    part, repeated rows are reported once; empty tables give no rows.
    """
    named = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).filter("id IS NOT NULL")
    items = benchmark.select(benchmark[f"`{item_col}`"].alias("item"), benchmark[f"`{item_text_col}`"].alias("text"))
    schema = T.StructType(
        [T.StructField("id", named.schema["id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("number", "start", "end", "edits")]
    )

    def search(texts: list[str]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(texts, budget)
            for batch in batches:
                for slab in blocks.slabs(batch, "text", _SLAB_BYTES):
                    data, _, offsets = plain(slab.data, slab.offsets)
                    best: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for row, item, start, end, edits in index.find(data, offsets):
                        best[row, item] = min(best.get((row, item), (edits, start, end)), (edits, start, end))
                    ids = blocks.column(batch, "id", slab).take(pa.array([row for row, _ in best], pa.int64()))
                    rest = [[i for _, i in best], [v[1] for v in best.values()], [v[2] for v in best.values()], [v[0] for v in best.values()]]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in rest)], ["id", "number", "start", "end", "edits"])

        return named.mapInArrow(blocks.tidy(run), schema)

    spark, parts = docs.sparkSession, []
    for names, texts in _blocks(items.filter("text IS NOT NULL")):
        numbers = T.StructType([T.StructField("number", T.LongType()), T.StructField("item", items.schema["item"].dataType)])
        listed = spark.createDataFrame(list(enumerate(names)), numbers)
        parts.append(search(texts).join(F.broadcast(listed), "number").drop("number"))
    if not parts:
        return named.select("id").join(items.select("item"), F.lit(False)).select(
            "id", "item", *(F.lit(0).cast("bigint").alias(c) for c in ("start", "end", "edits"))
        )
    best = F.min(F.struct("edits", "start", "end")).alias("best")
    found = reduce(DataFrame.unionByName, parts).groupBy("id", "item").agg(best)
    return found.select("id", "item", "best.start", "best.end", "best.edits")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no passage, with all their columns; rows without an id stay."""
    found = sizing.small_side(contaminated(docs, benchmark, id_col, text_col).select(F.col("id").alias("_held")).distinct())
    return docs.join(found, F.col(f"`{id_col}`") == F.col("_held"), "left_anti")
