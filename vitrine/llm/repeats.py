"""Removal of repeated byte strings by content-defined fingerprints and hash grouping.

This replaces external induced sorting: there is no suffix order, no common-prefix
value, no queue and no recursion. Every string of ``SPAN`` bytes holds a sampled
place, the same in all its occurrences (the smallest hash of the ``GRAM`` bytes at
each place), which stands for the strings around it. Tuples (name, context, document,
place) are dealt by a hash of the name in Spark's shuffle and grouped by their hashes
in a task's memory; equal contexts settle all their strings at once, and only where
one name has several contexts are their strings told apart one by one, by hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import blocks
from vitrine.session import cut_lineage

SPAN, GRAM = 100, 24
REACH = SPAN - GRAM + 1
#: Longer texts are sampled in pieces; a piece's places fit the low bits of a hash.
PIECE_BYTES = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)
#: A name with more contexts than this in one batch, or in all, goes the way of single strings.
HOT_CONTEXTS, HOT_IN_ALL = 64, 512
#: A bucket of tuples of 30 bytes, or of half as many strings of 20 bytes; sorting holds it some
#: five times over. Each bucket is a task that writes a file.
BUCKET_TUPLES = 1 << 19
_FACTORS = blocks.mixed(np.arange(101, 104, dtype=np.uint64)) | np.uint64(1)

_TUPLE = np.dtype([("name", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("count", "u1"), ("hot", "u1")])
#: Suffixes alike in these cover the same bytes: two independent 64-bit hashes and the length.
_ALIKE = ("name", "context", "count")
_STRING = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4")])


class Sample(NamedTuple):
    """Sampled suffixes: text row, start of the first string they stand for (within
    the text), number of strings, name, hash of the bytes that these strings cover."""

    row: np.ndarray
    at: np.ndarray
    count: np.ndarray
    name: np.ndarray
    context: np.ndarray


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by running minima of blocks."""
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def _sample_piece(data: np.ndarray, offsets: np.ndarray) -> Sample | None:
    sizes = np.diff(offsets)
    strings = np.maximum(sizes - SPAN + 1, 0)
    if not strings.any():
        return None
    words = np.ndarray(len(data) - 7, np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,))
    last = len(data) - GRAM + 1
    grams = sum((words[8 * i : 8 * i + last] * _FACTORS[i] for i in range(3)), np.zeros(last, np.uint64))
    grams = blocks.mixed(grams)
    least = _smallest((grams & ~_PLACE) | np.arange(last, dtype=np.uint64), REACH)
    starts = blocks.ragged(offsets[:-1], strings)
    row = np.repeat(np.arange(len(sizes)), strings)
    place = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    at = starts[first]
    hashes = blocks.span_hashes(blocks.running_bytes(data), at, at + count - 1 + SPAN)
    row = row[first]
    return Sample(row, at - offsets[row], count, grams[place[first]], hashes)


def sample(slab: blocks.Slab) -> Iterator[Sample]:
    if len(slab.data) <= PIECE_BYTES:
        found = _sample_piece(slab.data, slab.offsets)
        if found is not None:
            yield found
        return
    for row, (begin, end) in enumerate(zip(slab.offsets[:-1].tolist(), slab.offsets[1:].tolist(), strict=True)):
        for low in range(begin, max(begin, end - SPAN + 1), PIECE_BYTES):
            piece = slab.data[low : min(end, low + PIECE_BYTES + SPAN - 1)]
            found = _sample_piece(piece, np.array([0, len(piece)]))
            if found is not None:
                yield found._replace(at=found.at + (low - begin), row=found.row + row)


def _first_of_each(rows: np.ndarray, *columns: str) -> np.ndarray:
    first = np.ones(len(rows), bool)
    if len(rows):
        first[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in columns])
    return first


def _settle(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tuples sorted by name, context and order in the corpus; which of them repeat an
    earlier one in full; and the number of contexts of each tuple's name."""
    tuples = tuples[np.lexsort((tuples["at"], tuples["doc"], tuples["count"], tuples["context"], tuples["name"]))]
    lead = _first_of_each(tuples, *_ALIKE)
    leads = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    same = (tuples["doc"][leads] == tuples["doc"]) & (tuples["at"][leads] == tuples["at"])  # a repeated row is no repeat of itself
    name = np.cumsum(_first_of_each(tuples, "name")) - 1
    contexts = np.bincount(name, lead, minlength=1).astype(np.int64)[name] if len(tuples) else name
    return tuples, ~same, contexts


_OUT = ["kind", "bucket", "doc", "at", "count", "name", "packed"]
_OUT_SCHEMA = "kind int, bucket int, doc bigint, at bigint, count bigint, name bigint, packed binary"
_REPEATED, _OPEN, _OPEN_HOT, _PACKED = range(4)


def _rows(kind: int, tuples: np.ndarray) -> pa.RecordBatch:
    size = len(tuples)
    numbers = [pa.array(tuples[c].astype(np.int64)) for c in ("doc", "at", "count")]
    names = pa.array(np.ascontiguousarray(tuples["name"]).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int32)), pa.nulls(size, pa.int32()), *numbers, names, pa.nulls(size, pa.binary())], _OUT
    )


def _packed(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    filled, first = np.unique(bucket[order], return_index=True)
    parts = [p.tobytes() for p in np.split(rows[order], first[1:]) if len(p)]
    size = len(parts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(size, _PACKED, np.int32)),
            pa.array(filled, pa.int32()),
            *(pa.nulls(size, pa.int64()) for _ in range(4)),
            blocks.binaries(parts),
        ],
        _OUT,
    )


def _names(named: DataFrame, buckets: int) -> DataFrame:
    """Tuples that repeat an earlier one in full, and those whose name has other contexts.

    A batch settles its own tuples first and sends on one of each name and
    context; of a name that has very many, it sends a mark only. All contexts and marks of
    a name meet in one task, which decides whether it is hot in the whole corpus."""

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for slab in blocks.slabs(batch, "text"):
                ids = blocks.column(batch, "id", slab).to_numpy(zero_copy_only=False)
                for found in sample(slab):
                    tuples = np.zeros(len(found.at), _TUPLE)
                    tuples["doc"] = ids[found.row]
                    tuples["name"], tuples["context"] = found.name, found.context
                    tuples["at"], tuples["count"] = found.at, found.count
                    parts.append(tuples)
            if not parts:
                continue
            tuples, repeated, contexts = _settle(np.concatenate(parts))
            yield _rows(_REPEATED, tuples[repeated])
            lead = _first_of_each(tuples, *_ALIKE)
            hot = contexts > HOT_CONTEXTS
            yield _rows(_OPEN_HOT, tuples[lead & hot])
            send = tuples[lead & (~hot | _first_of_each(tuples, "name"))]
            send["hot"] = hot[lead & (~hot | _first_of_each(tuples, "name"))]
            yield _packed((send["name"] % np.uint64(buckets)).astype(np.int64), send)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(kinds != _PACKED))
            packed = batch.column(6).filter(pa.array(kinds == _PACKED))
            parts += [np.frombuffer(raw.as_buffer(), _TUPLE).copy() for raw in packed]
        if not parts:
            return
        tuples = np.concatenate(parts)
        parts.clear()
        marked = np.unique(tuples["name"][tuples["hot"] > 0])
        tuples, repeated, contexts = _settle(tuples[tuples["hot"] == 0])
        yield _rows(_REPEATED, tuples[repeated])
        hot = np.isin(tuples["name"], marked) | (contexts > HOT_IN_ALL)
        lead = _first_of_each(tuples, *_ALIKE)
        yield _rows(_OPEN_HOT, tuples[lead & hot])
        yield _rows(_OPEN, tuples[lead & ~hot & (contexts > 1)])

    dealt = named.mapInArrow(blocks.tidy(local), _OUT_SCHEMA).repartition(buckets, F.coalesce("bucket", F.pmod(F.xxhash64("doc", "at"), F.lit(buckets)).cast("int")))
    return cut_lineage(dealt.mapInArrow(blocks.tidy(join), _OUT_SCHEMA).select("kind", "doc", "at", "count", "name"))


def _first_strings(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings sorted by content and order, and which of them occur earlier too."""
    strings = strings[np.lexsort((strings["at"], strings["doc"], strings["key"]))]
    lead = _first_of_each(strings, "key")
    leads = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    return strings, (strings["doc"][leads] != strings["doc"]) | (strings["at"][leads] != strings["at"])


def _runs(strings: np.ndarray) -> np.ndarray:
    """Neighbouring strings of a document as tuples of start and count."""
    strings = strings[np.lexsort((strings["at"], strings["doc"]))]
    step = np.ones(len(strings), bool)
    if len(strings):
        step[1:] = (strings["doc"][1:] != strings["doc"][:-1]) | (strings["at"][1:] - strings["at"][:-1] > 1)
    out = np.zeros(int(step.sum()), np.dtype([("name", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("count", "<i8")]))
    first = np.flatnonzero(step)
    out["doc"], out["at"] = strings["doc"][first], strings["at"][first]
    ends = np.append(first[1:], len(strings)) - 1
    out["count"] = strings["at"][ends].astype(np.int64) - out["at"] + 1 if len(first) else 0
    return out


def _strings(data: np.ndarray, doc: np.ndarray, begin: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Every string of the given tuples, with the hash of its bytes."""
    place = blocks.ragged(begin + at, count)
    out = np.zeros(len(place), _STRING)
    out["key"] = blocks.span_hashes(blocks.running_bytes(data), place, place + SPAN)
    out["doc"], out["at"] = np.repeat(doc, count), blocks.ragged(at, count)
    return out


def _string_repeats(named: DataFrame, open_: DataFrame, buckets: int) -> DataFrame:
    """(doc, at, count) of strings that occur earlier, among the open tuples.

    The tuples meet their texts again. An ordinary tuple travels as the bytes that its strings
    cover, dealt by name; the strings of a hot name travel one by one, dealt by their own
    hash, each at most once per batch."""
    wanted = open_.groupBy("doc").agg(
        F.collect_list(F.struct("at", "count", "name", (F.col("kind") == _OPEN_HOT).alias("hot"))).alias("tuples")
    )
    texts = named.join(wanted, named["id"] == F.col("doc")).select("id", "text", "tuples")
    head = np.dtype([("name", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("count", "<u4")])

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            singles = []
            for slab in blocks.slabs(batch, "text"):
                ids = blocks.column(batch, "id", slab).to_numpy(zero_copy_only=False)
                lists = blocks.column(batch, "tuples", slab)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), sizes)
                at, count, name, hot = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
                begin, name = slab.offsets[row], np.ascontiguousarray(name).view(np.uint64)
                inside = at + count - 1 + SPAN <= (slab.offsets[1:] - slab.offsets[:-1])[row]  # of ids with several texts
                chosen = np.flatnonzero(hot & inside)
                singles.append(_strings(slab.data, ids[row][chosen], begin[chosen], at[chosen], count[chosen]))
                chosen = np.flatnonzero(~hot & inside)
                if len(chosen):
                    heads = np.zeros(len(chosen), head)
                    heads["name"], heads["doc"] = name[chosen], ids[row][chosen]
                    heads["at"], heads["count"] = at[chosen], count[chosen]
                    bucket = (heads["name"] % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    filled, first = np.unique(bucket[order], return_index=True)
                    parts = []
                    for part in np.split(order, first[1:]):
                        start = (begin + at)[chosen[part]]
                        size = count[chosen[part]] - 1 + SPAN
                        parts.append(len(part).to_bytes(4, "little") + heads[part].tobytes() + slab.data[blocks.ragged(start, size)].tobytes())
                    size = len(parts)
                    fill = [pa.array(np.full(size, _OPEN, np.int32)), pa.array(filled, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*fill, *(pa.nulls(size, pa.int64()) for _ in range(4)), blocks.binaries(parts)], _OUT)
            strings, repeated = _first_strings(np.concatenate(singles)) if singles else (np.zeros(0, _STRING), np.zeros(0, bool))
            if len(strings):
                yield _rows(_REPEATED, _runs(strings[repeated]))
                lead = strings[_first_of_each(strings, "key")]
                yield _packed((lead["key"] % np.uint64(buckets)).astype(np.int64), lead)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for kind, raw in zip(batch.column(0).to_pylist(), batch.column(6), strict=True):
                if kind == _PACKED:
                    parts.append(np.frombuffer(raw.as_buffer(), _STRING).copy())
                elif kind == _OPEN:
                    data = np.frombuffer(raw.as_buffer(), np.uint8)
                    size = int.from_bytes(data[:4].tobytes(), "little")
                    heads = np.frombuffer(data[4 : 4 + size * head.itemsize].tobytes(), head)
                    data, count = data[4 + size * head.itemsize :], heads["count"].astype(np.int64)
                    ends = np.cumsum(count - 1 + SPAN)
                    strings = _strings(data, heads["doc"], ends - (count - 1 + SPAN) - heads["at"], heads["at"].astype(np.int64), count)
                    strings["key"] = blocks.mixed(strings["key"] ^ np.repeat(heads["name"], count))
                    parts.append(strings)
            yield batch.filter(pa.array(batch.column(0).to_numpy(zero_copy_only=False) == _REPEATED))
        if parts:
            strings, repeated = _first_strings(np.concatenate(parts))
            yield _rows(_REPEATED, _runs(strings[repeated]))

    dealt = texts.mapInArrow(blocks.tidy(local), _OUT_SCHEMA).repartition(buckets, F.coalesce("bucket", F.pmod(F.xxhash64("doc", "at"), F.lit(buckets)).cast("int")))
    return cut_lineage(dealt.mapInArrow(blocks.tidy(join), _OUT_SCHEMA).select("doc", "at", "count"))


def _removed(slab: blocks.Slab, row: int, at: np.ndarray, count: np.ndarray) -> tuple[list[dict[str, int]], bytes]:
    text = slab.data[slab.offsets[row] : slab.offsets[row + 1]]
    depth = np.zeros(len(text) + 1, np.int64)
    np.add.at(depth, np.minimum(at, len(text)), 1)
    np.add.at(depth, np.minimum(at + count - 1 + SPAN, len(text)), -1)
    gone = np.cumsum(depth[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans = [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return spans, text[~gone].tobytes()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text without the bytes that occur earlier: (id, n_bytes, removed, kept).

    Texts are UTF-8 bytes. Removed is each byte covered by ``SPAN`` bytes that also
    start earlier, in a document of smaller id or before in the same; overlaps
    count, and all is judged on the input. ``removed`` lists the maximal runs
    (start, end), ``kept`` has the remaining bytes. Texts shorter than ``SPAN``,
    empty or NULL lose nothing. Rows without an id (an integer) take no part
    and stay whole; an id is taken to name one text, so repeated rows come back
    alike. An empty table gives no rows; other columns play no part.
    """
    named = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("id"), docs[f"`{text_col}`"].alias("text"))
    long = named.filter(F.col("id").isNotNull() & (F.octet_length("text") >= SPAN))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = long.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = max(least, -(-2 * total // (REACH * BUCKET_TUPLES)))
    found = _names(long, buckets)
    open_ = found.filter(F.col("kind") != _REPEATED)
    buckets = max(least, -(-open_.count() * REACH // (2 * BUCKET_TUPLES)))
    repeats = found.filter(F.col("kind") == _REPEATED).select("doc", "at", "count")
    repeats = repeats.union(_string_repeats(long, open_, buckets))
    runs = repeats.groupBy("doc").agg(F.collect_set(F.struct("at", "count")).alias("runs"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for slab in blocks.slabs(batch, "text"):
                lists, spans, kept = blocks.column(batch, "runs", slab), [], []
                for row in range(slab.last - slab.first):
                    if lists[row].is_valid:
                        at, count = (c.to_numpy(zero_copy_only=False) for c in lists[row].values.flatten())
                        own, rest = _removed(slab, row, at, count)
                    else:
                        own, rest = [], slab.data[slab.offsets[row] : slab.offsets[row + 1]].tobytes()
                    spans.append(own)
                    kept.append(rest)
                columns = [blocks.column(batch, "id", slab), pa.array(np.diff(slab.offsets)), pa.array(spans, spans_type), blocks.binaries(kept)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "removed", "kept"])

    schema = T.StructType.fromDDL("id bigint, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary")
    joined = named.join(runs, named["id"] == F.col("doc"), "left").select("id", "text", "runs")
    return joined.mapInArrow(blocks.tidy(cut), schema)
