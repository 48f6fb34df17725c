"""A trial of external induced sorting, held against the operator that removes repeated bytes.

Suffixes are sorted by induction from the leftmost S-type ones (recursively, from their
names), with priority queues whose runs lie on disk. It gives the same result as the
fingerprints, and is where the README's figures for the method come from.
"""

from __future__ import annotations

import heapq
import random
import struct

import numpy as np

from vitrine.llm import repeats

SPAN = 100


class DiskQueue:
    """A priority queue of (key, order, place): a heap of bounded size, and sorted runs on disk."""

    entry = struct.Struct("<qqq")

    def __init__(self, folder, held=1 << 12):
        self.folder, self.held, self.heap, self.runs, self.written = folder, held, [], [], 0

    def push(self, item):
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            path = self.folder / f"run-{id(self)}-{len(self.runs)}"
            path.write_bytes(b"".join(self.entry.pack(*x) for x in sorted(self.heap)))
            self.written += path.stat().st_size
            self.heap = []
            reader = (self.entry.unpack(raw) for raw in iter(lambda f=path.open("rb"): f.read(self.entry.size), b""))
            heapq.heappush(self.runs, (next(reader), len(self.runs), reader))

    def top(self):
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self):
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, reader = self.runs[0]
            following = next(reader, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, reader))
            return item
        return heapq.heappop(self.heap)


def induced(text, folder, held=1 << 12, spilled=None):
    """The suffixes of a sequence in order; its last value is smaller than all others."""
    size = len(text)
    smaller = [False] * (size - 1) + [True]  # S-type: smaller than the next suffix
    for i in range(size - 2, -1, -1):
        smaller[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and smaller[i + 1])
    leftmost = [i for i in range(1, size) if smaller[i] and not smaller[i - 1]]
    ends = {a: b for a, b in zip(leftmost, [*leftmost[1:], size - 1], strict=True)}
    pieces = sorted(([(text[i], smaller[i]) for i in range(a, ends[a] + 1)], a) for a in leftmost)
    names, name, last = {}, -1, None
    for piece, a in pieces:
        name += piece != last
        names[a], last = name, piece
    if name + 1 < len(leftmost):  # names repeat: sort the shorter sequence of names first
        seeds = [leftmost[i] for i in induced([names[a] for a in leftmost], folder, held, spilled)]
    else:
        seeds = [a for _, a in pieces]

    def sweep(given, sign, wanted):
        """Suffixes of one type, induced from given ones by their first value and the order of what follows."""
        queue, out, order, at = DiskQueue(folder, held), [], 0, 0
        while at < len(given) or queue.top() is not None:
            first = queue.top()
            if first is not None and (at == len(given) or first[0] <= sign * text[given[at]]):
                place = queue.pop()[2]
                out.append(place)
            else:
                place, at = given[at], at + 1
            if place and smaller[place - 1] == wanted:
                queue.push((sign * text[place - 1], order, place - 1))
            order += 1
        if spilled is not None:
            spilled.append(queue.written)
        return out

    larger = sweep(seeds, 1, False)
    rest = sweep(larger[::-1], -1, True)[::-1]
    found = heapq.merge(((text[i], 0, n, i) for n, i in enumerate(larger)), ((text[i], 1, n, i) for n, i in enumerate(rest)))
    order = [i for *_, i in found]
    return order if len(order) == size else [size - 1, *order]


def common_prefixes(text, order):
    """Of each suffix and the one before it in order: how much they share."""
    rank, shared, out = {place: i for i, place in enumerate(order)}, 0, [0] * len(order)
    for place in range(len(text)):
        at = rank[place]
        if at:
            other = order[at - 1]
            while max(place, other) + shared < len(text) and text[place + shared] == text[other + shared]:
                shared += 1
            out[at], shared = shared, max(0, shared - 1)
        else:
            shared = 0
    return out


def remaining(texts, folder, held):
    """What is left of each text, by groups of suffixes that share ``SPAN`` bytes or more."""
    flat, starts = [], []
    for number, text in enumerate(texts):
        starts.append(len(flat))
        flat += [byte + len(texts) + 1 for byte in text] + [number + 1]  # separators differ, so nothing crosses them
    flat.append(0)
    order = induced(flat, folder, held)
    shared = common_prefixes(flat, order)
    gone, group = np.zeros(len(flat), bool), [order[0]]
    for place, common in [*zip(order[1:], shared[1:], strict=True), (None, 0)]:
        if common >= SPAN:
            group.append(place)
            continue
        for later in sorted(group)[1:]:
            gone[later : later + SPAN] = True
        group = [place]
    return [bytes(b for b, g in zip(t, gone[s : s + len(t)], strict=True) if not g) for s, t in zip(starts, texts, strict=True)]


def test_induced_order_is_that_of_the_suffixes(tmp_path):
    rnd = random.Random(1)
    for size in (1, 2, 3, 10, 60, 300):
        for letters in (1, 2, 3, 20):
            text = [rnd.randint(1, letters) for _ in range(size)] + [0]
            assert induced(text, tmp_path, held=7) == sorted(range(size + 1), key=lambda i: text[i:]), text


def test_trial_and_fingerprints_agree(spark, tmp_path):
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(60)]
    passages = [" ".join(rnd.choices(words, k=40)) for _ in range(3)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(5, 60))) + rnd.choice(["", *passages]) + " ".join(rnd.choices(words, k=9)) for _ in range(25)]
    texts += [texts[3], "ab" * 150, "", passages[0][:99], passages[0][5:150]]
    raw = [t.encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    kept = {r["id"]: bytes(r["kept"]) for r in repeats.without_repeats(docs).collect()}
    assert [kept[i] for i in range(len(raw))] == remaining(raw, tmp_path, held=500)
