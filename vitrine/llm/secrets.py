"""Secret scan: three fixed patterns, and a linear-chain conditional random field.

The field tags tokens as begin, inside or outside of a secret from their own
shape, the shapes of their neighbours and a file feature. It learns from what
the patterns find in bounded samples of the documents with and without such finds,
and is decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import blocks
from vitrine.session import cut_lineage

# The patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ["assign", "access", "hex", "crf"]

#: The training sample: so many documents in which a pattern finds something and so many
#: others, and so many windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 4000, 4, 32
ROUNDS, DECAY = 60, 1e-4
#: Training steps: a token's own shape is to decide more than its neighbours, and those more
#: than how rare secrets are in the sample.
OWN_RATE, NEAR_RATE, OTHER_RATE = 0.3, 0.08, 0.05

OUTSIDE, BEGIN, INSIDE = range(3)
_KEY_WORDS = [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey", b"key", b"auth", b"bearer", b"credential"]
_ASSIGN_WORDS = [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"]
_SIZES = np.array([4, 8, 12, 20, 32])
_NONE, _EQUALS, _COLON, _QUOTE, _STOP, _MARK, _KEY, _SHAPES = range(8)
OBSERVATIONS = _SHAPES + 64 * (len(_SIZES) + 1)
_FILES = 3


def _coarser() -> tuple[np.ndarray, np.ndarray]:
    """Observations of words by length alone, and by whether they mix digits and letters."""
    every = np.arange(OBSERVATIONS, dtype=np.int32)
    sizes, bits = np.divmod(np.maximum(every - _SHAPES, 0), 64)
    mixes = (bits & 1) + 2 * ((bits & 14) > 0) + 4 * ((bits & 48) > 0)
    word = every >= _SHAPES
    return np.where(word, _SHAPES + sizes, every).astype(np.int32), np.where(word, _SHAPES + mixes, every).astype(np.int32)


#: What the emissions look at: how many tokens away, and how finely (None: the whole shape).
_SIZE_ONLY, _MIX_ONLY = _coarser()
_REACH = ((-3, None), (-2, None), (-1, None), (0, None), (1, None), (2, None), (0, _SIZE_ONLY), (0, _MIX_ONLY))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Shape bits of word bytes, and the observations of single marks."""
    bits, marks = np.zeros(256, np.uint8), np.full(256, _MARK, np.int32)
    bits[48:58] = 1
    bits[65:91] = 2
    bits[97:103] = 4
    bits[103:123] = 8
    bits[[ord(c) for c in "+/_-"]] = 16
    bits[128:] = 32
    marks[ord("=")], marks[ord(":")], marks[ord(".")] = _EQUALS, _COLON, _STOP
    marks[[ord(c) for c in "\"'`"]] = _QUOTE
    return bits, marks


_BITS, _MARKS = _byte_tables()


class Tokens:
    """Tokens of a slab: runs of word bytes, and every other visible byte."""

    def __init__(self, slab: blocks.Slab) -> None:
        data = slab.data
        bits = _BITS[data]
        word = bits > 0
        starts, ends = blocks.word_spans(word, slab.offsets)
        marks = np.flatnonzero(~word & (data > 32) & (data != 127))
        order = np.argsort(np.concatenate([starts, marks]), kind="stable")
        self.starts = np.concatenate([starts, marks])[order]
        self.ends = np.concatenate([ends, marks + 1])[order]
        self.bounds = np.searchsorted(self.starts, slab.offsets)
        self.seen = np.zeros(len(self.starts), np.int32)
        if len(self.starts):
            shapes = np.bitwise_or.reduceat(bits, self.starts).astype(np.int32)
            sizes = np.searchsorted(_SIZES, self.ends - self.starts, "right")
            is_word = word[self.starts]
            self.seen = np.where(is_word, _SHAPES + sizes * 64 + shapes, _MARKS[data[self.starts]]).astype(np.int32)
            self._mark_keys(blocks.lowered(data), is_word)
        counts = np.diff(self.bounds)
        sums = np.concatenate([[0], np.cumsum(self.seen < _SHAPES)])
        share = (sums[self.bounds[1:]] - sums[self.bounds[:-1]]) / np.maximum(counts, 1)
        self.files = np.searchsorted([0.2, 0.4], share, "right")

    def _mark_keys(self, data: np.ndarray, is_word: np.ndarray) -> None:
        sizes = self.ends - self.starts
        raw = np.frombuffer(b"".join(_KEY_WORDS), np.uint8)
        ends = np.cumsum([len(w) for w in _KEY_WORDS])
        keys = blocks.span_hashes(blocks.running_bytes(raw), ends - [len(w) for w in _KEY_WORDS], ends)
        maybe = np.flatnonzero(is_word & (sizes >= 3) & (sizes <= 10) & np.isin(data[self.starts], list(b"pstakbc")))
        hashes = blocks.span_hashes(blocks.running_bytes(data), self.starts[maybe], self.ends[maybe])
        self.seen[maybe[np.isin(hashes, keys)]] = _KEY

    def view(self, reach: tuple[int, np.ndarray | None]) -> np.ndarray:
        offset, coarser = reach
        seen = self.context(offset)
        return seen if coarser is None else coarser[seen]

    def context(self, offset: int) -> np.ndarray:
        """The observation ``offset`` tokens away in the same text, or none."""
        out = np.zeros_like(self.seen)
        if offset == 0 or not len(out):
            return self.seen if len(out) else out
        if offset < 0:
            out[-offset:] = self.seen[:offset]
            edges = self.bounds[:-1][:, None] + np.arange(-offset)
            out[edges[edges < self.bounds[1:][:, None]]] = _NONE
        else:
            out[:-offset] = self.seen[offset:]
            edges = self.bounds[1:][:, None] - 1 - np.arange(offset)
            out[edges[edges >= self.bounds[:-1][:, None]]] = _NONE
        return out


def base_spans(slab: blocks.Slab) -> dict[int, list[tuple[str, int, int, int]]]:
    """By row: (kind, start, end, start of the secret itself), in code points."""
    data = slab.data
    raw, low = data.tobytes(), blocks.lowered(data).tobytes()
    begins = slab.offsets.tolist()
    rows = lambda at: int(np.searchsorted(slab.offsets, at, "right")) - 1

    def holding(text: bytes, words: list[bytes]) -> set[int]:
        found = set()
        for word in words:
            at = text.find(word)
            while at >= 0:
                row = rows(at)
                if at + len(word) <= begins[row + 1]:
                    found.add(row)
                    at = text.find(word, begins[row + 1])
                else:
                    at = text.find(word, at + 1)
        return found

    out: dict[int, list[tuple[str, int, int, int]]] = {}
    for row in holding(low, _ASSIGN_WORDS):
        text = raw[begins[row] : begins[row + 1]].decode("utf-8")
        hits = [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        out.setdefault(row, []).extend(hits)
    for row in holding(raw, [b"AKIA"]):
        text = raw[begins[row] : begins[row + 1]].decode("utf-8")
        hits = [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
        out.setdefault(row, []).extend(hits)
    starts, ends = blocks.word_spans(_HEX[data], slab.offsets)
    long = np.flatnonzero(ends - starts >= HEX_LEAST)
    chars = _characters(data)
    row_of = np.searchsorted(slab.offsets, starts[long], "right") - 1
    at_of = chars[starts[long]] - chars[slab.offsets[row_of]]
    for row, at, size in zip(row_of.tolist(), at_of.tolist(), (ends - starts)[long].tolist(), strict=True):
        out.setdefault(row, []).append(("hex", at, at + size, at))
    return out


def _characters(data: np.ndarray) -> np.ndarray:
    """Before each byte, and after the last, how many code points have begun."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


class Field:
    """Weights of the field: emissions by position and observation, by file, and transitions."""

    def __init__(self) -> None:
        self.seen = np.zeros((len(_REACH), OBSERVATIONS, 3))
        self.file = np.zeros((_FILES, 3))
        self.moves = np.zeros((3, 3))

    def parts(self) -> list[np.ndarray]:
        return [self.seen, self.file, self.moves]

    def train(self, seen: np.ndarray, files: np.ndarray, tags: np.ndarray, used: np.ndarray) -> None:
        """Maximum likelihood by forward-backward and Adam over windows: ``seen``
        (window, token, reach), ``files`` (window), ``tags`` and ``used`` (window, token)."""
        wanted = np.eye(3)[tags] * used[..., None]
        pairs = used[:, 1:] & used[:, :-1]
        moved = np.bincount((tags[:, :-1] * 3 + tags[:, 1:])[pairs], minlength=9).reshape(3, 3)
        means = [np.zeros_like(p) for p in self.parts()]
        squares = [np.zeros_like(p) for p in self.parts()]
        near = np.array([OWN_RATE if offset == 0 else NEAR_RATE for offset, _ in _REACH])[:, None, None]
        count = max(1, int(used.sum()))
        for step in range(1, ROUNDS + 1):
            scores = self.file[files][:, None] + sum(self.seen[k][seen[..., k]] for k in range(len(_REACH)))
            alike, moves = self._expected(scores, used, pairs)
            rest = alike - wanted
            slopes = [np.zeros_like(self.seen), np.zeros_like(self.file), moves - moved]
            for tag in range(3):
                flat = rest[..., tag].ravel()
                for k in range(len(_REACH)):
                    slopes[0][k, :, tag] = np.bincount(seen[..., k].ravel(), flat, OBSERVATIONS)
                slopes[1][:, tag] = np.bincount(files, rest[..., tag].sum(1), _FILES)
            for part, slope, mean, square, rate in zip(self.parts(), slopes, means, squares, (near, OTHER_RATE, OTHER_RATE), strict=True):
                slope = slope / count + DECAY * part
                mean += 0.1 * (slope - mean)
                square += 0.01 * (slope**2 - square)
                part -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)

    def _expected(self, scores: np.ndarray, used: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities of every token and expected counts of the moves."""
        move = np.exp(self.moves)
        width = scores.shape[1]
        local = np.exp(scores - scores.max(-1, keepdims=True))
        ahead, back = np.zeros_like(local), np.ones_like(local)
        ahead[:, 0] = local[:, 0] / local[:, 0].sum(-1, keepdims=True)
        for t in range(1, width):
            now = (ahead[:, t - 1] @ move) * local[:, t]
            ahead[:, t] = np.where(used[:, t, None], now / now.sum(-1, keepdims=True), ahead[:, t - 1])
        moves = np.zeros((3, 3))
        for t in range(width - 2, -1, -1):
            into = local[:, t + 1] * back[:, t + 1]
            now = into @ move.T
            back[:, t] = np.where(pairs[:, t, None], now / now.sum(-1, keepdims=True), 1.0)
            joint = ahead[:, t, :, None] * move * into[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            moves += joint[pairs[:, t]].sum(0)
        alike = ahead * back
        return alike / alike.sum(-1, keepdims=True) * used[..., None], moves

    def emissions(self, tokens: Tokens) -> np.ndarray:
        weights = self.seen.astype(np.float32)
        out = np.repeat(self.file.astype(np.float32)[tokens.files], np.diff(tokens.bounds), axis=0)
        for k, reach in enumerate(_REACH):
            out += weights[k][tokens.view(reach)]
        return out

    def tags(self, tokens: Tokens) -> np.ndarray:
        """The best tags. A token whose lead for outside exceeds what any two moves
        could win back is outside on the best path, so the path falls into the short
        stretches between such tokens, which are decoded side by side."""
        scores, moves = self.emissions(tokens), self.moves.astype(np.float32)
        tags = np.zeros(len(scores), np.int8)
        if not len(scores):
            return tags
        gain = (moves - moves[:, [0]]).max(0) + (moves - moves[[0], :]).max(1)
        gain = np.maximum(gain, (moves - moves[[0], :]).max(1))  # at a text's start or end a move is missing
        gain = np.maximum(np.maximum(gain, (moves - moves[:, [0]]).max(0)), 0) + 1e-3
        open_ = ((scores[:, [0]] - scores[:, 1:]) <= gain[1:]).any(1)
        starts, ends = blocks.word_spans(open_, tokens.bounds[tokens.bounds <= len(open_)])
        first = np.zeros(len(open_) + 1, bool)
        first[tokens.bounds] = True
        sizes = ends - starts
        for size in np.unique(sizes).tolist():
            chosen = starts[sizes == size]
            at = chosen[:, None] + np.arange(size)
            lead = np.where(first[chosen], 0, 1)[:, None] * moves[0]
            tail = np.where(first[chosen + size], 0, 1)[:, None] * moves[:, 0]
            tags[at] = _viterbi(scores[at], moves, lead, tail)
        return tags


def _viterbi(scores: np.ndarray, moves: np.ndarray, lead: np.ndarray, tail: np.ndarray) -> np.ndarray:
    best = scores[:, 0] + lead
    came = []
    for t in range(1, scores.shape[1]):
        options = best[:, :, None] + moves
        came.append(options.argmax(1))
        best = options.max(1) + scores[:, t]
    path = [(best + tail).argmax(1)]
    for previous in reversed(came):
        path.append(previous[np.arange(len(previous)), path[-1]])
    return np.stack(path[::-1], 1)


def _windows(slab: blocks.Slab) -> Iterator[tuple[bytes, bytes, int]]:
    """Training windows of a slab: observations, tags and file class; those with
    secrets first, then evenly spread ones. Those with a long token of letters and
    digits that no pattern covers are left out, as it may be a secret or not."""
    tokens, found = Tokens(slab), base_spans(slab)
    tags = np.zeros(len(tokens.starts), np.int8)
    for row, spans in found.items():
        text = slab.data[slab.offsets[row] : slab.offsets[row + 1]]
        chars = np.flatnonzero((text & 0xC0) != 0x80) + slab.offsets[row]
        chars = np.append(chars, slab.offsets[row + 1])
        for _, _, end, value in spans:
            inside = np.flatnonzero((tokens.ends > chars[value]) & (tokens.starts < chars[end]))
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
    seen = np.stack([tokens.view(reach) for reach in _REACH], 1).astype(np.int16)
    sizes, bits = np.divmod(np.maximum(tokens.seen - _SHAPES, 0), 64)
    unclear = (tags == OUTSIDE) & (sizes >= 3) & ((bits & 1) > 0) & ((bits & 14) > 0)
    for row in range(slab.last - slab.first):
        low, high = int(tokens.bounds[row]), int(tokens.bounds[row + 1])
        hits = (low + np.flatnonzero(tags[low:high] == BEGIN) - WINDOW // 2).tolist()
        spread = np.linspace(low, max(low, high - WINDOW), SAMPLE_WINDOWS).astype(int).tolist()
        for start in list(dict.fromkeys(hits[:SAMPLE_WINDOWS] + spread))[: 2 * SAMPLE_WINDOWS]:
            a, b = max(low, start), min(high, start + WINDOW)
            if b > a and not unclear[a:b].any():
                yield seen[a:b].tobytes(), tags[a:b].tobytes(), int(tokens.files[row])


def _sample(texts: DataFrame) -> DataFrame:
    """Ids to learn from. All rows are searched; of the documents with a find, and of the
    others, the ``SAMPLE_DOCS`` of the smallest id hashes are taken."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in blocks.slabs(batch, "text"):
                hit = np.zeros(slab.last - slab.first, bool)
                hit[[row for row, spans in base_spans(slab).items() if spans]] = True
                yield pa.RecordBatch.from_arrays([blocks.column(batch, "id", slab), pa.array(hit)], ["id", "hit"])

    schema = T.StructType([texts.schema["id"], T.StructField("hit", T.BooleanType())])
    marked = cut_lineage(texts.mapInArrow(blocks.tidy(run), schema).groupBy("id").agg(F.max("hit").alias("hit")))
    parts = [marked.filter(F.col("hit") == hit).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS) for hit in (True, False)]
    return parts[0].union(parts[1]).select("id")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted to the patterns' spans in up to ``SAMPLE_DOCS`` documents that have
    some and as many that have none. The ratio of the two is not set back to that of
    all documents, as rare secrets would then silence the field; at most
    ``2 * SAMPLE_WINDOWS`` windows of ``WINDOW`` tokens of each reach the driver.
    Without any, the field tags nothing."""
    named = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).filter("id IS NOT NULL")
    texts = named.join(F.broadcast(_sample(named)), "id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in blocks.slabs(batch, "text"):
                rows = list(_windows(slab))
                yield pa.RecordBatch.from_arrays(
                    [blocks.binaries([r[0] for r in rows]), blocks.binaries([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32())],
                    ["seen", "tags", "file"],
                )

    field = Field()
    rows = texts.select("text").mapInArrow(blocks.tidy(run), "seen binary, tags binary, file int").toPandas()
    if len(rows):
        rows = rows.sort_values(["seen", "tags", "file"])  # no order of tasks shows in the weights
        seen = np.zeros((len(rows), WINDOW, len(_REACH)), np.int16)
        tags = np.zeros((len(rows), WINDOW), np.int64)
        used = np.zeros((len(rows), WINDOW), bool)
        for i, (a, b) in enumerate(zip(rows["seen"], rows["tags"], strict=True)):
            size = len(b)
            seen[i, :size] = np.frombuffer(a, np.int16).reshape(size, -1)
            tags[i, :size] = np.frombuffer(b, np.int8)
            used[i, :size] = True
        field.train(seen, rows["file"].to_numpy(), tags, used)
    return field


_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _tagged(slab: blocks.Slab, field: Field) -> dict[int, list[tuple[str, int, int]]]:
    """By row, the spans that the field finds, in code points."""
    tokens = Tokens(slab)
    tags = field.tags(tokens)
    out: dict[int, list[tuple[str, int, int]]] = {}
    chars, begins = _characters(slab.data), slab.offsets.tolist()
    starts, ends = blocks.word_spans(tags > OUTSIDE, tokens.bounds[tokens.bounds <= len(tags)])
    for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
        row = int(np.searchsorted(tokens.bounds, low, "right")) - 1
        cuts = [low, *(low + 1 + np.flatnonzero(tags[low + 1 : high] == BEGIN)).tolist(), high]
        for a, b in zip(cuts, cuts[1:], strict=False):
            start, end = (int(chars[at] - chars[begins[row]]) for at in (tokens.starts[a], tokens.ends[b - 1]))
            out.setdefault(row, []).append(("crf", start, end))
    return out


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: (id, spans of kind, start, end), in code points.

    The patterns' spans all stay; of the field's (kind ``crf``) those that touch
    none of them are added. Spans are ordered by start, then by kind as listed.
    NULL and empty texts have no spans. Rows come back one for one, NULL and
    repeated ids included; other columns play no part, and an empty table gives
    no rows. ``field`` is trained on ``docs`` unless given.
    """
    field = field or train(docs, id_col, text_col)
    spans = T.ArrayType(T.StructType.fromDDL("kind string, start bigint, end bigint"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", spans)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in blocks.slabs(batch, "text"):
                found, tagged = base_spans(slab), _tagged(slab, field)
                lists = []
                for row in range(slab.last - slab.first):
                    base = [(kind, start, end) for kind, start, end, _ in found.get(row, [])]
                    more = tagged.get(row, [])
                    if base and more:
                        order = sorted((s, e) for _, s, e in base)
                        begins = [s for s, _ in order]
                        reach = np.maximum.accumulate([e for _, e in order])
                        at = [int(np.searchsorted(begins, e)) - 1 for _, _, e in more]
                        more = [m for m, i in zip(more, at, strict=True) if i < 0 or reach[i] <= m[1]]
                    lists.append(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))))
                values = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in lists]
                yield pa.RecordBatch.from_arrays([blocks.column(batch, "id", slab), pa.array(values, pa.list_(_ARROW_SPAN))], ["id", "spans"])

    return docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).mapInArrow(blocks.tidy(run), schema)
