"""Repair of conversations by weighted interval parsing.

A well-formed conversation's role initials are ``(s?(ua)+)?``. The grammar of
its repairs is in Chomsky normal form: a nonterminal (p, q) derives rows that,
once edited, lead from what may follow p to what may follow q. A terminal rule
edits one row, with insertions closed over on both sides; a binary rule is
(p, q) -> (p, r) (r, q). A span of rows has one cell per nonterminal, holding
the least (cost, audit); cells of adjacent spans combine bottom-up by span length.

* Least audits combine to least audits: of two audits of one span and equal cost
  neither begins the other, as the rest could only be insertions, which cost.
* Every split of a span gives the same cell, since a path from p to q passes some
  state r at every row. So only spans of 1, 2, 4, ... rows are combined, and a
  conversation costs its length times the logarithm of it; the tests compare with
  the table of all spans and splits.

Rows are sorted by range, so a long conversation is cut into segments that lie
in several tasks; the segments' cells combine like any other spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import skew
from vitrine.llm import blocks
from vitrine.session import cut_lineage

SEGMENT_BYTES = 4 << 20
# Spans of up to so many rows are kept for other conversations, so many of them.
KEPT_ROWS, KEPT_SPANS = 16, 1 << 15
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

Cell = tuple[int, str] | None
Cells = tuple[Cell, ...]

# States: nothing written yet, or the initial written last.
_START, _S, _U, _A = range(4)
_STATES = range(4)
_OTHER = 3  # initials are numbered s, u, a, other
_MUST_GO = 8  # symbol of a row that has to be deleted; others are 2 * initial + truncated
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_NEXT = {_START: _U, _S: _U, _U: _A, _A: _U}  # what a rerole or an insertion writes


def joined(left: Cells, right: Cells) -> Cells:
    """The binary rules: cells of two adjacent spans make those of both."""
    out = []
    for p in _STATES:
        for q in _STATES:
            best = None
            for r in _STATES:
                a, b = left[4 * p + r], right[4 * r + q]
                if a is not None and b is not None:
                    made = (a[0] + b[0], a[1] + b[1])
                    if best is None or made < best:
                        best = made
            out.append(best)
    return tuple(out)


def _insertions() -> Cells:
    """The closure: what insertions alone lead to."""
    cells: list[Cell] = [None] * 16
    for p in _STATES:
        at, cost, audit = p, 0, ""
        while cells[4 * p + at] is None:
            cells[4 * p + at] = (cost, audit)
            at, cost, audit = _NEXT[at], cost + INSERT, audit + "I"
    return tuple(cells)


_CLOSURE = _insertions()


def _terminal(symbol: int) -> Cells:
    cells: list[Cell] = [None] * 16
    for p in _STATES:
        cells[4 * p + p] = (DELETE, "D")
    if symbol != _MUST_GO:
        initial, truncated = divmod(symbol, 2)
        for p in _STATES:
            kept = {0: _S if p == _START else None, 1: _U if p != _U else None, 2: _A if p == _U else None}.get(initial)
            for q, cost, letter in ((_NEXT[p], REROLE, "R"), (kept, KEEP, "K")):
                if q is not None:
                    made = (cost + TRUNCATED * truncated, letter)
                    cells[4 * p + q] = min(filter(None, (cells[4 * p + q], made)))
    return joined(joined(_CLOSURE, tuple(cells)), _CLOSURE)


class Parser:
    """Cells of spans, shared between the conversations of a task."""

    def __init__(self) -> None:
        self.rows = [_terminal(symbol) for symbol in range(_MUST_GO + 1)]
        self.kept: dict[bytes, Cells] = {}

    def cells(self, symbols: bytes) -> Cells:
        """The cells of all rows, from spans of one row upwards."""
        if len(self.kept) > KEPT_SPANS:
            self.kept.clear()
        spans = [(symbols[i : i + 1], self.rows[s]) for i, s in enumerate(symbols)]
        while len(spans) > 1:
            longer = [self._joined(*pair) for pair in zip(spans[::2], spans[1::2], strict=False)]
            spans = longer + spans[len(spans) & ~1 :]
        return spans[0][1] if spans else _CLOSURE

    def _joined(self, left: tuple[bytes, Cells], right: tuple[bytes, Cells]) -> tuple[bytes, Cells]:
        span = left[0] + right[0]
        cells = self.kept.get(span)
        if cells is None:
            cells = joined(left[1], right[1])
            if len(span) <= KEPT_ROWS:
                self.kept[span] = cells
        return span, cells


def repair_cost(cells: Cells) -> tuple[int, str]:
    """The cheapest repair of a whole conversation: nothing is left, or an assistant has the last word."""
    return min(c for c in (cells[4 * _START + _START], cells[4 * _START + _A]) if c is not None)


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """The (role, text) rows that an audit makes of given ones, from a state on."""
    given = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(given)
        if edit == "D":
            continue
        state = "sua".index(role[0]) + 1 if edit == "K" else _NEXT[state]
        yield (role if edit == "K" else ("user" if state == _U else "assistant")), text


def _state_after(audit: str, symbols: bytes, state: int) -> int:
    at = 0
    for edit in audit:
        if edit in "IR":
            state = _NEXT[state]
        elif edit == "K":
            state = symbols[at] // 2 + 1
        at += edit != "I"
    return state


def turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The rows as ``repair`` takes them: id, turn, role, text, dropped. A NULL role or text reads as one space."""
    return conversations.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
        F.lit(False).alias("dropped"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Deterministic faults for trials: by the CRC-32 of ``id:turn`` (NULL: one space) modulo
    20 a row is dropped (0), emptied (1), robbed of its ``.!?`` (2), repeated (3) or given to
    the user (4). Dropped rows stay, marked, so that their conversation is still reported."""
    name, number = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("id", "turn"))
    fault = F.crc32(F.concat(name, F.lit(":"), number).cast("binary")) % 20
    marked = rows.withColumn("fault", fault)
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return marked.select(
        "id",
        "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("dropped") | (F.col("fault") == 0)).alias("dropped"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("fault") == 3, 1).otherwise(0))).alias("copy"),
    ).drop("copy")


def _symbols(initial: Column, must_go: Column, truncated: Column) -> Column:
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(_OTHER)
    return F.when(must_go, F.lit(_MUST_GO)).otherwise(2 * code + truncated.cast("int"))


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with their faults. A row is a duplicate if its role and text stand earlier in the
    conversation; only the keys that are repeated travel to the rows."""
    bare = F.rtrim("text", F.lit(BLANKS))
    known = F.concat_ws("\x00", F.col("id").isNotNull().cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    key = F.unhex(F.sha2(F.concat(known, F.lit("\x00"), F.length("role").cast("string"), F.lit("\x00"), "role", "text"), 256))
    kept = cut_lineage(
        rows.select(
            "id", "turn", "role", "text", "dropped",
            F.monotonically_increasing_id().alias("row"),
            key.alias("key"),
            (bare == "").alias("blank"),
            (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        )
    )
    order = F.struct(F.col("turn").isNotNull(), "turn", "row")
    live = kept.filter(~F.col("dropped") & ~F.col("blank"))
    repeats = live.groupBy("key").agg(F.min_by("row", order).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    marked = skew.join(kept, repeats, ["key"], "left", spread=["row"], check_small=True)
    duplicate = ~F.col("blank") & F.col("first").isNotNull() & (F.col("row") != F.col("first"))
    return marked.withColumn("duplicate", duplicate).withColumn("truncated", F.col("truncated") & ~duplicate & ~F.col("blank")).drop("first")


class _Counts(NamedTuple):
    """What is added up over the segments of a conversation, and what stands at a segment's ends."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_initial: int | None = None
    last_initial: int | None = None

    def then(self, other: _Counts) -> _Counts:
        """Both, the other's rows being later."""
        if not self.rows or not other.rows:
            return self if self.rows else other
        sums = [a + b for a, b in zip(self[:6], other[:6], strict=True)]
        sums[4] += (self.last_initial, other.first_initial) not in _LEGAL
        sums[5] -= self.last_turn is not None and self.last_turn == other.first_turn
        first = other.first_turn if self.first_turn is None else self.first_turn
        last = self.last_turn if other.last_turn is None else other.last_turn
        return _Counts(*sums, first, last, self.first_initial, other.last_initial)

    def shown(self) -> dict[str, int]:
        span = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        names = ("blank", "duplicate", "truncated", "illegal")
        return {"gaps": span} | {name: getattr(self, name) for name in names}


class _Segment:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, name: object) -> None:
        self.name, self.symbols, self.rows, self.size, self.counts = name, bytearray(), [], 0, _Counts()

    def add(self, turn, role, text, dropped, blank, duplicate, truncated, symbol) -> None:
        if dropped:
            return
        initial = "sua".find(role[:1]) if role else -1
        initial = _OTHER if initial < 0 else initial
        own = _Counts(1, int(blank), int(duplicate), int(truncated), 0, int(turn is not None), turn, turn, initial, initial)
        self.counts = self.counts.then(own)
        self.symbols.append(symbol)
        self.rows.append((role, text))
        self.size += len(role) + len(text) + 16


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode()


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PIECE = (
    "part int, piece int, symbols binary, roles array<string>, texts array<string>, "
    "counts array<bigint>, costs array<int>, audits array<string>"
)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    simple |= {"smallint": pa.int16(), "tinyint": pa.int8(), "boolean": pa.bool_(), "date": pa.date32(), "float": pa.float32()}
    return pa.list_(_arrow_type(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[kind.simpleString()]


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])


def _segments(rows: DataFrame, segment_bytes: int) -> DataFrame:
    """Conversations that lie within one task, repaired, and the pieces of the others."""
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(f"{_RESULT}, {_PIECE}")])
    arrow = _arrow(schema)
    columns = ["id", "turn", "role", "text", "dropped", "blank", "duplicate", "truncated", "symbol"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, part, piece, now, whole = Parser(), TaskContext.get().partitionId(), 0, None, False
        out: list[dict] = []

        def closed(segment: _Segment, whole: bool) -> dict:
            cells = parser.cells(bytes(segment.symbols))
            if whole:
                cost, audit = repair_cost(cells)
                lines = b"\n".join(_line(*row) for row in repaired(segment.rows, audit, _START))
                made = {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines).hexdigest()}
                return {"id": segment.name} | segment.counts.shown() | made
            return {
                "id": segment.name, "part": part, "piece": piece, "symbols": bytes(segment.symbols),
                "roles": [r for r, _ in segment.rows], "texts": [t for _, t in segment.rows], "counts": list(segment.counts),
                "costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells],
            }

        for batch in batches:
            for name, *row in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if now is None or name != now.name or now.size >= segment_bytes:
                    if now is not None:
                        out.append(closed(now, whole and name != now.name))
                        piece += 1
                    # Whole: neither the task's first conversation, nor one cut for its size, nor (below) the last.
                    whole = now is not None and name != now.name
                    now = _Segment(name)
                now.add(*row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed(now, False)], arrow)

    return rows.select(*columns).mapInArrow(blocks.tidy(run), schema)


def _paths(pieces: DataFrame) -> DataFrame:
    """For conversations in pieces: their repair, and per piece its part of the audit and the state before it."""
    schema = T.StructType([*T._parse_datatype_string("part int, piece int, state int, own string, last boolean"), *T._parse_datatype_string(_RESULT)])
    arrow = _arrow(schema)

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["piece"]))
        each = [tuple(c if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in rows]
        counts, before = _Counts(), _CLOSURE
        for row, cells in zip(rows, each, strict=True):
            counts, before = counts.then(_Counts(*row["counts"])), joined(before, cells)
        cost, audit = repair_cost(before)
        whole = counts.shown() | {"cost": cost, "audit": audit}
        out, at, state = [], 0, _START
        for row in rows:
            begin, left = at, len(row["symbols"])
            while at < len(audit) and (left or audit[at] == "I"):
                left -= audit[at] != "I"
                at += 1
            own = audit[begin:at]
            out.append({"part": row["part"], "piece": row["piece"], "state": state, "own": own, "last": row is rows[-1]})
            state = _state_after(own, row["symbols"], state)
        out[-1] |= whole
        return pa.Table.from_pylist(out, arrow)

    chosen = pieces.select("id", "part", "piece", "symbols", "counts", "costs", "audits")
    return chosen.groupBy("id").applyInArrow(combine, schema)


def _digests(pieces: DataFrame) -> DataFrame:
    """Hashes of the repaired rows of conversations in pieces, streamed piece after piece."""
    schema = T.StructType([pieces.schema["id"], *T._parse_datatype_string(_RESULT)])
    arrow, names = _arrow(schema), [f.name for f in T._parse_datatype_string(_RESULT)][:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, begun = hashlib.sha256(), False
        for batch in batches:
            for row in batch.to_pylist():
                for line in repaired(zip(row["roles"], row["texts"], strict=True), row["own"], row["state"]):
                    digest.update(b"\n" * begun + _line(*line))
                    begun = True
                if row["last"]:
                    made = {name: row[name] for name in ["id", *names]} | {"repaired_sha256": digest.hexdigest()}
                    yield pa.RecordBatch.from_pylist([made], arrow)
                    digest, begun = hashlib.sha256(), False

    ordered = pieces.repartition("id").sortWithinPartitions("id", "part", "piece")
    return ordered.mapInArrow(blocks.tidy(run), schema)


def repair(rows: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Per conversation its faults and its cheapest repair.

    ``rows`` come from ``turns``, perhaps ``damaged``. Rows stand in the order of turn (NULL
    first), then role, the text's first 64 characters and its hash, so that equal ones are
    neighbours. Per ``id`` (a NULL id is a conversation too): ``gaps`` in the turns,
    rows that are ``blank``, ``duplicate`` or ``truncated`` (the first that holds),
    ``illegal`` neighbours, ``cost`` and ``audit`` of the repair, and the SHA-256 of the
    repaired ``role:text`` lines. A conversation whose rows were all dropped has zeros,
    an empty audit and the hash of nothing; an empty table gives no rows.
    """
    judged = _judged(rows)
    symbol = _symbols(F.substring("role", 1, 1), F.col("blank") | F.col("duplicate"), F.col("truncated"))
    order = [F.col("id"), F.col("turn"), F.col("role"), F.substring("text", 1, 64), F.col("key"), F.col("row")]
    placed = blocks.bounded(judged.withColumn("symbol", symbol)).repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut_lineage(_segments(placed, segment_bytes))
    results = [f.name for f in T._parse_datatype_string(_RESULT)]
    pieces = found.filter("part IS NOT NULL").select("id", "part", "piece", "symbols", "roles", "texts", "counts", "costs", "audits")
    paths = cut_lineage(_paths(pieces))
    torn = pieces.select("id", "part", "piece", "roles", "texts").join(paths, ["part", "piece"])
    return found.filter("part IS NULL").select("id", *results).unionByName(_digests(torn).select("id", *results))
