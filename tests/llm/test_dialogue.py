"""Repair of conversations against the table of all spans and splits, and against a search over edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from vitrine.llm import dialogue, registered

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, row long, key string, part int, cost int, audit int"
FORM = re.compile("(s?(ua)+)?")


def by_search(rows):
    """Cheapest audits by searching edits in the order (cost, audit); ``rows`` are (initial, fault)."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, last = heapq.heappop(queue)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        steps = [(2, "I", 0, "ua")]
        if at < len(rows):
            initial, fault = rows[at]
            extra = fault == "truncated"
            steps.append((3, "D", 1, ""))
            if fault not in ("blank", "duplicate"):
                steps += [(extra, "K", 1, initial or "?"), (2 + extra, "R", 1, "ua")]
        for price, letter, used, written in steps:
            for new in written or [None]:
                if new is not None and not (new == "s" and last == "" or new == "u" and last != "u" or new == "a" and last == "u"):
                    continue
                heapq.heappush(queue, (cost + price, audit + letter, at + used, last if new is None else new))
    return None


def by_all_spans(symbols):
    """The whole table of spans, each from all its splits."""
    parser = dialogue.Parser()
    best = {(i, i + 1): parser.rows[s] for i, s in enumerate(symbols)}
    for length in range(2, len(symbols) + 1):
        for i in range(len(symbols) - length + 1):
            each = [dialogue.joined(best[i, k], best[k, i + length]) for k in range(i + 1, i + length)]
            best[i, i + length] = tuple(min((c for c in cells if c is not None), default=None) for cells in zip(*each, strict=True))
    return best[0, len(symbols)]


def symbol(initial, fault):
    code = "sua".find(initial) if initial in list("sua") else 3
    return 8 if fault in ("blank", "duplicate") else 2 * code + (fault == "truncated")


def test_cells_equal_the_full_table_and_the_search():
    rnd = random.Random(1)
    parser = dialogue.Parser()
    kinds = list(itertools.product("suax", ["", "truncated", "blank"]))
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 12] * 12:
        rows = rnd.choices(kinds, k=size)
        symbols = bytes(symbol(*r) for r in rows)
        cells = parser.cells(symbols)
        assert cells == by_all_spans(symbols)
        assert dialogue.repair_cost(cells) == by_search(rows)


def expected(rows, damage=True):
    """What the contract says of plain (conv, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fault == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        mine += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashed(conv, r[1], r[2])))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [t for t, _, _ in mine if t is not None]
        initials = [role[:1] for _, role, _ in mine]
        cost, audit = by_search(list(zip(initials, faults, strict=True)))
        given, last, lines = iter(mine), "", []
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(given)
            if edit == "D":
                continue
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        assert FORM.fullmatch("".join(line[0] for line in lines))
        out[conv] = {
            "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


def hashed(conv, role, text):
    known = "true\0" + str(conv) if conv is not None else "false\0"
    return hashlib.sha256(f"{known}\0{len(role)}\0{role}{text}".encode()).digest()


def made(seed, conversations, most):
    rnd = random.Random(seed)
    words = ["Yes.", "no", "Why?", "ok!", "", " ", "\t\n", "a b", "déjà vu.", None, "and then\x0b"]
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn, None]), role, rnd.choice(words)))
    return rows + rows[:5]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "k", 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def found(frame_):
    return {r["id"]: {k: v for k, v in r.asDict().items() if k != "id"} for r in frame_.collect()}


def test_damaged_conversations_are_repaired(spark):
    rows = made(2, 60, 9)
    got = dialogue.repair(dialogue.damaged(dialogue.turns(frame(spark, rows))))
    assert found(got) == expected(rows)


@pytest.mark.parametrize("segment", [1, 200])
def test_conversations_cut_into_segments(spark, segment):
    """One conversation holds most rows; segments end after a row, or after some."""
    rows = made(3, 8, 12) + [(77, t, ("user", "assistant")[t * 7 % 3 % 2], f"word {t % 40}" + "." * (t % 5 > 0)) for t in range(150)]
    rows += [(78, 5, "user", "same.")] * 40
    got = dialogue.repair(dialogue.damaged(dialogue.turns(frame(spark, rows))), segment_bytes=segment)
    assert found(got) == expected(rows)


def test_undamaged_and_empty(spark):
    rows = [(1, 0, "system", "Hi."), (1, 1, "user", "Go on!"), (1, 2, "assistant", "x" * 300000 + "."), (2, 4, "user", "cut")]
    assert found(dialogue.repair(dialogue.turns(frame(spark, rows)))) == expected(rows, damage=False)
    assert dialogue.repair(dialogue.turns(frame(spark, []))).count() == 0


def test_query_on_the_given_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registered.op11_dialogue_repair(spark, sf_dir)
    assert found(got.withColumnRenamed("conv_id", "id")) == expected(given)
