"""Byte-level BPE encoding and decoding without regular expressions.

Each code point has a class; a class is a function on the states of a small
automaton, and functions compose associatively, so the state before every
character of a slab comes from one scan over rows of characters. Boundaries cut
the bytes into slices, equal slices are merged once, and token ids are gathered.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm import blocks

CACHE_PIECES = 1 << 17
ROW_CHARS = 256
# Pieces of up to so many bytes are merged side by side; longer ones each on a heap.
LANES = (8, 16, 40)
_NO_PAIR = 1 << 40

# States: what the token that holds the previous character may still take.
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _SPACE, _BLANKS, _ONE_MORE, _TWO_MORE = range(8)
# Classes of characters, after a look at the next two.
_LETTER, _NUMBER, _OTHER, _SHORT, _LONG, _LAST_SPACE, _LAST_BLANK, _BLANK = range(8)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at the character."""
    if state >= _ONE_MORE:
        return (_ONE_MORE if state == _TWO_MORE else _FRESH), False
    if kind in (_LETTER, _NUMBER, _OTHER):
        own = (_LETTERS, _NUMBERS, _OTHERS)[kind]
        return own, state not in (own, _SPACE)
    if kind in (_SHORT, _LONG):
        if state in (_OTHERS, _SPACE):
            return _OTHERS, False
        return (_ONE_MORE if kind == _SHORT else _TWO_MORE), True
    if kind == _BLANK:
        return _BLANKS, state != _BLANKS
    return (_SPACE if kind == _LAST_SPACE else _FRESH), True


def _scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Products of all reachable functions, what each makes of the fresh state,
    the function of each class, and boundaries by state and class.

    Classes 8 to 15 are 0 to 7 at the start of a text."""
    functions = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
    functions += [(f[_FRESH],) * 8 for f in functions]
    number: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    for f in functions:
        number.setdefault(f, len(number))
    known = list(number)
    for f in known:  # grows while it is read
        for g in functions:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(number)
                known.append(h)
    products = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.uint16)
    from_fresh = np.array([f[_FRESH] for f in known], np.uint8)
    of_class = np.array([number[f] for f in functions], np.uint16)
    cuts = np.array([[_step(s, k)[1] for k in range(8)] + [True] * 8 for s in range(8)])
    return products, from_fresh, of_class, cuts


def character_classes() -> bytes:
    """Letter, number, other or white space for every code point, compressed."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = _LETTER if kind == "L" else _NUMBER
    table[_WHITE] = _BLANK
    return zlib.compress(table.tobytes())


class Splitter:
    """Token boundaries of the texts of a slab."""

    def __init__(self, classes: bytes) -> None:
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.products, self.from_fresh, self.of_class, self.cuts = _scan_tables()

    def _kinds(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Classes with the look-ahead folded in; ``first`` marks text starts."""
        kinds = self.classes[codes]
        last = np.append(first[1:], True)
        blank = kinds == _BLANK
        ends_run = blank & ~last & ~np.append(blank[1:], True)
        kinds = np.where(ends_run, np.where(codes == 0x20, _LAST_SPACE, _LAST_BLANK), kinds).astype(np.uint8)
        quotes = np.flatnonzero((codes == 0x27) & ~last)
        if len(quotes):
            one = codes[quotes + 1]
            two = codes[np.minimum(quotes + 2, len(codes) - 1)]
            two = np.where(last[quotes + 1], 0, two)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            kinds[quotes[short]] = _SHORT
            kinds[quotes[long]] = _LONG
        kinds[first] += 8
        return kinds

    def boundaries(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Indexes of the characters at which a token starts."""
        count = len(codes)
        if not count:
            return np.zeros(0, np.int64)
        kinds = self._kinds(codes, first)
        rows = -(-count // ROW_CHARS)
        steps = np.zeros(rows * ROW_CHARS, np.uint16)
        steps[:count] = self.of_class[kinds]
        steps = np.ascontiguousarray(steps.reshape(rows, ROW_CHARS).T)
        size, flat = len(self.products), self.products.ravel()
        within = np.zeros((ROW_CHARS + 1, rows), np.uint16)  # product of the row's characters before each one
        for i in range(ROW_CHARS):
            within[i + 1] = flat[within[i].astype(np.int32) * size + steps[i]]
        carry, reach = within[ROW_CHARS].copy(), 1
        while reach < rows:  # inclusive scan over the rows' products
            carry[reach:] = flat[carry[:-reach].astype(np.int32) * size + carry[reach:]]
            reach *= 2
        before = np.concatenate([np.zeros(1, np.uint16), carry[:-1]]).astype(np.int32) * size
        states = self.from_fresh[flat[before[None, :] + within[:ROW_CHARS]]].T.reshape(-1)[:count]
        return np.flatnonzero(self.cuts[states, kinds])


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the adjacent pair of lowest rank merges first,
    the leftmost among equals. A heap keeps long pieces in n log n."""
    if piece in ranks:
        return [ranks[piece]]
    size = len(piece)
    ends = list(range(1, size + 1))  # of the part that starts here; 0 once merged away
    previous = list(range(-1, size - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        middle = ends[at]
        if middle < size and (rank := ranks.get(piece[at : ends[middle]])) is not None:
            heapq.heappush(heap, (rank, at, ends[middle]))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = ends[at]
        if not middle or middle >= size or ends[middle] != end:
            continue
        ends[at], ends[middle] = end, 0
        if end < size:
            previous[end] = at
        offer(at)
        if previous[at] >= 0:
            offer(previous[at])
    return [ranks[piece[i : ends[i]]] for i in range(size) if ends[i]]


def load_ranks(path: str) -> bytes:
    """The vocabulary file, read on the driver and shipped with the plan."""
    return zlib.compress(Path(path).read_bytes())


def _ranks(packed: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in zlib.decompress(packed).splitlines())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class Merger:
    """Merges many short pieces side by side, one merge of each per step."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted(
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        )
        self.pairs = np.array([p for p, _ in pairs], np.int64)
        self.merged = np.array([r for _, r in pairs], np.int64)
        self.first = self._ranks_of(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that a pair becomes, or a number above all ranks."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == wanted), self.merged[at], _NO_PAIR)

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Token ids of each piece as 32-bit numbers."""
        if not len(starts):
            return []
        width = int(sizes.max())
        columns = np.arange(width)
        inside = columns < sizes[:, None]
        raw = data[np.minimum(starts[:, None] + columns, len(data) - 1)].astype(np.int64)
        symbols = np.where(inside, self.of_byte[raw], -1)
        pair_ranks = np.full(symbols.shape, _NO_PAIR)
        pair_ranks[:, :-1] = np.where(inside[:, 1:], self.first[raw[:, :-1] * 256 + raw[:, 1:]], _NO_PAIR)
        rows = np.arange(len(starts))
        active, now, ranks = rows, symbols, pair_ranks
        while len(active):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            going = best < _NO_PAIR
            symbols[active[~going]] = now[~going]
            active, now, ranks, at, best = active[going], now[going], ranks[going], at[going], best[going]
            line, after = np.arange(len(at)), columns > at[:, None]
            now = np.where(after, np.pad(now, ((0, 0), (0, 1)), constant_values=-1)[:, 1:], now)
            ranks = np.where(after, np.pad(ranks, ((0, 0), (0, 1)), constant_values=_NO_PAIR)[:, 1:], ranks)
            now[line, at] = best
            following = now[line, np.minimum(at + 1, width - 1)]
            ranks[line, at] = self._ranks_of(best, np.where(at + 1 < width, following, -1))
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self._ranks_of(now[back, at[back] - 1], best[back])
        counts = (symbols >= 0).sum(axis=1)
        flat = symbols[symbols >= 0].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct slice, and which of these every slice equals. Slices meet by
    hash; their bytes are then compared, and should a hash have deceived, meet by content."""
    hashes = blocks.span_hashes(blocks.running_bytes(data), starts, ends)
    _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    first, sizes = starts[example][which], ends - starts
    alike = np.array_equal(sizes, (ends - starts)[example][which])
    if alike and np.array_equal(data[blocks.ragged(first, sizes)], data[starts[0] : ends[-1]]):
        return example, which
    number: dict[bytes, int] = {}
    slices = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    which = np.array([number.setdefault(piece, len(number)) for piece in slices], np.int64)
    return np.unique(which, return_index=True)[1], which


class Encoder:
    """Ids and byte offsets for slabs, with a cache of merged pieces."""

    def __init__(self, packed: bytes, classes: bytes) -> None:
        self.ranks, self.splitter = _ranks(packed), Splitter(classes)
        self.merger = Merger(self.ranks)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(token) for token in tokens], np.int64)
        self.bytes, self.begins = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.cache: dict[bytes, bytes] = {}

    def _merge(self, data: np.ndarray, keys: list[bytes], starts: np.ndarray, sizes: np.ndarray) -> None:
        for low, high in zip((0, *LANES), (*LANES, None), strict=True):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high if high else True))
            if high:
                done = self.merger.merge(data, starts[chosen], sizes[chosen])
            else:
                done = [np.array(merge_piece(keys[i], self.ranks), "<u4").tobytes() for i in chosen.tolist()]
            self.cache.update((keys[i], ids) for i, ids in zip(chosen.tolist(), done, strict=True))

    def encode(self, slab: blocks.Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their starts as bytes of the slab, and each text's first id."""
        data = slab.data
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(slab.offsets), np.int64)
        char_starts = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(data) + 1, bool)
        first[slab.offsets] = True
        starts = char_starts[self.splitter.boundaries(codes, first[char_starts])]
        ends = np.append(starts[1:], len(data))
        example, which = _distinct(data, starts, ends)
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        new = np.array([i for i, key in enumerate(keys) if key not in self.cache], np.int64)
        begin = starts[example[new]]
        self._merge(data, [keys[i] for i in new.tolist()], begin, ends[example[new]] - begin)
        pieces = [self.cache[key] for key in keys]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        counts = lengths[which]
        ids = np.frombuffer(b"".join(pieces), "<u4")[blocks.ragged((np.cumsum(lengths) - lengths)[which], counts)]
        widths = self.sizes[ids]
        at = np.cumsum(widths) - widths
        return ids, at, np.searchsorted(at, slab.offsets)


    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return self.bytes[blocks.ragged(self.begins[ids], self.sizes[ids])]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: (id, ids, offsets), and with ``decoded`` the bytes that
    these ids stand for, as ``decode`` gives them, in the same pass.

    ``ids`` are little-endian 32-bit token ids as one binary, ``offsets`` the
    byte at which each token starts in the UTF-8 text, in the same form.
    ``vocabulary`` is a file of ranks, read on the driver. NULL and empty
    texts have no ids. Rows come back one for one, NULL and repeated ids
    included; other columns play no part, and an empty table gives no rows.
    """
    packed, classes = load_ranks(vocabulary), character_classes()
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("ids", T.BinaryType()),
            T.StructField("offsets", T.BinaryType()),
        ]
    )
    if decoded:
        schema = schema.add("decoded", T.BinaryType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for slab in blocks.slabs(batch, "text"):
                encoder = encoder or Encoder(packed, classes)
                ids, at, first = encoder.encode(slab)
                bounds, begins = first.tolist(), slab.offsets.tolist()
                spans = list(zip(bounds, bounds[1:], begins, strict=False))
                columns = [
                    blocks.column(batch, "id", slab),
                    blocks.binaries([ids[a:b].tobytes() for a, b, _ in spans]),
                    blocks.binaries([(at[a:b] - base).astype("<u4").tobytes() for a, b, base in spans]),
                ]
                if decoded:
                    columns.append(blocks.binaries([encoder.decode(ids[a:b]).tobytes() for a, b, _ in spans]))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    named = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    return named.mapInArrow(blocks.tidy(run), schema)


def decode(encoded: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """The bytes that ``ids`` stand for: the columns ``keep`` and ``decoded``.
    NULL ids decode to no bytes; an id outside the vocabulary is an error."""
    packed, keep = load_ranks(vocabulary), keep or ["id"]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            if tokens is None:
                tokens = {rank: token for token, rank in _ranks(packed).items()}.__getitem__
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [
                    b"".join(map(tokens, np.frombuffer(v.as_buffer(), "<u4").tolist())) if v.is_valid else b""
                    for v in part.column(part.schema.get_field_index("ids"))
                ]
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, blocks.binaries(texts)], [*keep, "decoded"])

    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(blocks.tidy(run), schema)
