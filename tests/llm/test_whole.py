"""Inputs of which the operators once did less than the whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest

from vitrine.llm import decontaminate, repeats, secrets


def test_contexts_alike_in_half_a_hash_are_told_apart(spark):
    """One 24-byte name, and contexts whose hashes have the same upper 32 bits."""
    texts = [
        "k01l1c60kfeuhttpj45is1pac0wvo05c4gwvpo05i5rz9dgl439pz6wo7nff2qq1irkxlj8f43voyymqvzz4hr3x36332fdfmkpp",
        "x9xio5jlxqi6c36eszfappdhxh7tenjn8wuogt05i5rz9dgl439pz6wo7nff2qanzrovigvo4uhsyo7qe4jkeez78bmr49cum5fb",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[1]])], "doc_id bigint, text string")
    kept = {r["id"]: bytes(r["kept"]).decode() for r in repeats.without_repeats(docs).collect()}
    assert kept == {0: texts[0], 1: texts[1], 2: ""}


@pytest.mark.parametrize("size", [155, 400])
def test_exact_passages_are_found_wherever_they_start(size):
    """As with windows at every byte: what fills a window up to its budget is found."""
    rnd = random.Random(size)
    words = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 8))) for _ in range(100))
    item = words[:size].strip() + "x" * (size - len(words[:size].strip()))
    index = decontaminate.Index([item])
    for length in (108, 112, 120, 125, 134):
        for at in range(size - length + 1):
            data = np.frombuffer(b"#" * 40 + item[at : at + length].encode() + b"#" * 40, np.uint8)
            assert list(index.find(data, np.array([0, len(data)]))), (length, at)


def test_field_learns_from_rare_secrets(spark, monkeypatch):
    """Few documents hold secrets, and none of those is among the smallest id hashes."""
    monkeypatch.setattr(secrets, "SAMPLE_DOCS", 50)
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7))) for _ in range(300)]
    around = [[" ".join(rnd.choices(words, k=30)) for _ in range(2)] for _ in range(4000)]
    ids = spark.range(4000).selectExpr("id", "xxhash64(id) AS hash").orderBy("hash").collect()
    hexes = ["".join(rnd.choices("0123456789abcdef", k=40)) for _ in range(31)]
    rows = [[r["id"], f"{a} {b}"] for r, (a, b) in zip(ids, around, strict=True)]
    for row, (a, b), own in zip(rows[-30:], around[-30:], hexes, strict=False):
        row[1] = f'{a} token = "{own}" {b}'
    other = f'{around[0][0]} pin = "{hexes[30].upper()}" {around[0][1]}'
    rows.append([5000, other])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r["id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert [other[s["start"] : s["end"]] for s in spans[5000]] == [hexes[30].upper()]
    assert not any(spans[r[0]] for r in rows[:-31])


def test_a_hub_with_many_pairs_is_split_and_loses_none(spark, monkeypatch):
    """One text and many variants of it, compared a few pairs to a task."""
    from vitrine.llm import jaccard

    monkeypatch.setattr(jaccard, "HUB_PAIRS", 4)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 80):
        words = list(base)
        words[rnd.randrange(100)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(rnd.choices(base, k=60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["id"]: r["component"] for r in jaccard.near_duplicates(docs).collect()}
    assert all(found[i] == 0 for i in range(80)) and all(found[i] == i for i in range(100, 120))
