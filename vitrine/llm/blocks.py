"""Texts as flat byte arrays, for functions that run inside tasks.

A batch of rows is taken in slabs of whole texts; every array of a slab is as
long as its bytes, so a task holds a bounded number of them at a time (a text
longer than a slab is a slab of its own).
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLAB_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
Task = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Slab(NamedTuple):
    """Rows ``first`` to ``last`` (exclusive) of a batch; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slabs(batch: pa.RecordBatch, column: str, most: int = SLAB_BYTES) -> Iterator[Slab]:
    """The texts of a column as UTF-8 bytes; NULL is an empty text."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(texts.type):
        texts = pa.nulls(len(texts), pa.string())
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    count = len(texts)
    if not count:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Slab(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit values."""
    out = values + _STEP
    out = (out ^ (out >> np.uint64(30))) * _MIX_1
    out = (out ^ (out >> np.uint64(27))) * _MIX_2
    return out ^ (out >> np.uint64(31))


# Two polynomial hashes modulo primes below 2^31: products fit 64 bits, and no text is known
# whose value is the same for every base, as there is modulo a power of two.
_PRIMES = (np.uint64((1 << 31) - 1), np.uint64((1 << 31) - 19))
_BASES = (0x3C6EF372, 0x1BD11BDA)
_BYTE_WORDS = [mixed(np.arange(256, dtype=np.uint64) + np.uint64(256 * i)) % p for i, p in enumerate(_PRIMES)]
_POWERS: list[list[np.ndarray]] = []


def _powers(count: int) -> list[list[np.ndarray]]:
    """Of each base and its inverse, as many powers as a slab has bytes."""
    if not _POWERS or len(_POWERS[0][0]) < count:
        size = max(count, SLAB_BYTES + 1024)
        made = []
        for base, prime in zip(_BASES, _PRIMES, strict=True):
            both = []
            for factor in (base, pow(base, -1, int(prime))):
                out = np.ones(size, np.uint32)
                done = 1
                while done < size:
                    step = np.uint64(pow(factor, done, int(prime)))
                    out[done : 2 * done] = out[: min(done, size - done)] * step % prime
                    done *= 2
                both.append(out)
            made.append(both)
        _POWERS[:] = made
    return _POWERS


def running_bytes(data: np.ndarray) -> list[np.ndarray]:
    """Prefix sums from which ``span_hashes`` takes the hash of any span."""
    sums = []
    for words, prime, (forward, _) in zip(_BYTE_WORDS, _PRIMES, _powers(len(data) + 1), strict=True):
        out = np.zeros(len(data) + 1, np.uint32)
        out[1:] = np.cumsum(words[data] * forward[: len(data)] % prime) % prime
        sums.append(out)
    return sums


def span_hashes(sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal content gives equal hashes wherever it stands."""
    parts = [
        (own[ends] + prime - own[starts]) % prime * backward[starts] % prime
        for own, prime, (_, backward) in zip(sums, _PRIMES, _powers(len(sums[0])), strict=True)
    ]
    return mixed(parts[0] << np.uint64(32) | parts[1])


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; no run crosses a text's end."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``start .. start + count``."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.repeat(starts - begin, counts) + np.arange(total)


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, its session set to hand texts to Python a few megabytes at a time."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def tidy(run: Task) -> Task:
    """``run``, after which the worker hands unused memory back to the system, as the
    same process serves other tasks and stages."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

    return wrapped


def column(batch: pa.RecordBatch, name: str, slab: Slab) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).slice(slab.first, slab.last - slab.first)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
