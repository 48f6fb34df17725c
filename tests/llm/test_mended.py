"""Long, repetitive and many-valued inputs, and samples that cover all rows."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import blocks, decontaminate, language, quality, secrets


def found_in(index, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    plain, _, at = decontaminate.plain(data, offsets)
    best = {}
    for row, item, start, end, edits in index.find(plain, at):
        best[row, item] = min(best.get((row, item), (edits, start, end)), (edits, start, end))
    return best


def test_counting_in_parts_changes_nothing(monkeypatch):
    rnd = random.Random(2)
    words = ["ha", "ho", "hello", "x" * 9, "abc"]
    items = ["ha " * 60, " ".join(rnd.choices(words, k=60)), " ".join(rnd.choices(words, k=25))]
    texts = ["ha " * 200 + "\n", " ".join(rnd.choices(words, k=300)) + items[1][20:150] + "\n", items[2] + " end\n", "ho " * 90 + "\n"]
    index = decontaminate.Index(items)
    whole = found_in(index, texts)
    monkeypatch.setattr(decontaminate, "_POSTINGS", 500)
    assert found_in(index, texts) == whole and {(0, 0), (1, 1), (2, 2)} <= set(whole)


def test_repetitive_text_takes_bounded_memory():
    """Every place of the text is a place of the item."""
    import tracemalloc

    index = decontaminate.Index(["ha " * 50])
    tracemalloc.start()
    found = found_in(index, ["ha " * 40_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(0, 0): (0, 0, decontaminate.WINDOW_BYTES)} and peak < 600 << 20


def test_short_items_are_held_as_whole_words_only():
    index = decontaminate.Index(["The Answer", "forty two is it", "tiny", ""])
    texts = ["It is the answer.\n", "the answers\n", "breathe answer\n", "forty  two, IS it", " forty two is its\n", "tiny\n", "the answer"]
    assert set(found_in(index, texts)) == {(0, 0), (3, 1), (6, 0)}


def test_spans_in_long_texts_are_right_and_fast():
    rnd = random.Random(4)
    unit = "é東 " + "".join(rnd.choices("0123456789abcdef", k=30)) + " 𝄞word "
    text = unit * 30_000
    raw = np.frombuffer(text.encode(), np.uint8)
    begun = time.perf_counter()
    found = secrets.base_spans(blocks.Slab(0, 1, raw, np.array([0, len(raw)])))[0]
    assert time.perf_counter() - begun < 10
    assert [(k, a, b) for k, a, b, _ in found] == [("hex", *m.span()) for m in re.finditer("[0-9a-f]{24,}", text)]


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "ALL_TEXTS", 400)
    monkeypatch.setattr(language, "ALL_LANDMARKS", 160)
    rnd = random.Random(6)
    rows = []
    for lang in range(80):
        letters = [chr(0x4E00 + 12 * lang + i) for i in range(12)]
        rows += [(len(rows) + i, "".join(rnd.choices(letters, k=40)), f"l{lang}") for i in range(30 if lang else 900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.train(docs)
    assert len(model.languages) == 80 and len(model.landmarks) == 160
    right = language.predict(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").filter("lang = lang_pred").count()
    assert right > 0.97 * len(rows)


def test_scores_equal_a_dense_kernel_solve(spark):
    """The same regression from sets of n-grams, without hashing, slabs or single precision."""
    rnd = random.Random(7)
    words = {"en": "the of and to in that was his with".split(), "de": "der die und den von zu mit sich des".split(), "fr": "le la les de et un une dans que".split()}
    rows = [(i, " ".join(rnd.choices(words[lang], k=12)), lang) for i, lang in enumerate(rnd.choices(list(words), k=150))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs)
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (hashes[r[0]], r[0]))
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i] != " " or t[i + n - 1] != " "}
    sets, names = [grams(t) for _, t, _ in ordered], sorted(words)
    tags = np.array([names.index(lang) for *_, lang in ordered])
    marks = [i for k in range(3) for i in np.flatnonzero(tags == k)[: language.LANDMARKS].tolist()]
    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    k, inner = kernel(sets, [sets[i] for i in marks]), kernel([sets[i] for i in marks], [sets[i] for i in marks])
    weight = (1 / np.bincount(tags))[tags][:, None]
    solved = np.linalg.solve(k.T @ (k * weight) + language.RIDGE * inner + 1e-8 * np.eye(len(marks)), k.T @ (np.where(tags[:, None] == np.arange(3), 1, -1) * weight))
    margins = k @ solved
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    for (i, *_), own in zip(ordered, margins, strict=True):
        assert found[i][0] == names[own.argmax()]
        assert found[i][1] == pytest.approx(np.clip((own.max() + 1) / 2, 0, 1), abs=0.03)


def test_the_surest_are_picked_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "TAKEN", 7)
    rnd = random.Random(8)
    words = ["good", "page", "spam", "buy", "now", "text", "clean", "!!!"]
    texts = [" ".join(rnd.choices(words[:4] if i % 2 else words[4:], k=30)) for i in range(700)]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", "en") for i, t in enumerate(texts)], "id bigint, text string, source string, lang string").repartition(5)
    features = quality._views(docs)
    rows = sorted(features.collect(), key=lambda r: r["id"])
    pools = quality._unpacked([r["text"] for r in rows], [r["meta"] for r in rows])
    wanted = np.array([i % 2 for i in range(700)], float)
    fitted = [quality._fit(p[:40], wanted[:40]) for p in pools]
    given = [{1: (1.0, None), 3: (1.0, None)}, {2: (0.0, None)}]
    hashes = {r["id"]: r["h"] for r in docs.select("id", F.xxhash64("id").alias("h")).collect()}
    picked = quality._surest_in(features)(fitted, given)
    for view, (pool, other) in enumerate(zip(pools, reversed(given), strict=True)):
        scores = np.round(quality._sigmoid(fitted[view].odds(pool)).astype(float), 6)
        expected = set()
        for label, sure in ((1.0, scores), (0.0, 1 - scores)):
            able = [i for i in range(700) if sure[i] >= quality.SURE and i not in other]
            expected |= {(i, label) for i in sorted(able, key=lambda i: (-sure[i], hashes[i], i))[:7]}
        assert {(key, label) for key, label, *_ in picked[view]} == expected and len(picked[view]) == len(expected)
        for key, _, text, meta in picked[view]:
            assert np.array_equal(text, pools[0][key]) and np.array_equal(meta, pools[1][key])


def test_the_field_finds_a_kind_of_secret_that_no_pattern_covers(spark):
    """Tokens after words that the patterns don't know: recall and false alarms."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvw", k=rnd.randint(2, 9))) for _ in range(400)]

    def token(size):
        while True:
            made = "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=size))
            if all(re.search(kind, made) for kind in ("[0-9]", "[a-z]", "[A-Z]")):
                return made

    rows, planted = [], {}
    for i in range(2000):
        sides = [rnd.choices(words, k=30) for _ in range(2)]
        if i % 2:
            sides[0][3], sides[0][7], sides[0][9] = str(rnd.randrange(10**5)), rnd.choice(words).capitalize() + ".", "(see 12)"
        made = {
            0: rnd.choice(["password = ", "token: ", 'secret="', "api_key="]) + token(rnd.randint(20, 40)),
            1: "sum " + "".join(rnd.choices("0123456789abcdef", k=40)),
            2: "AKIA" + "".join(rnd.choices("ABCDEFGHIJKLMNOP0123456789", k=16)),
        }.get(i % 10, rnd.choice(words) + " = " + rnd.choice(words))
        if i % 10 == 3:
            key = token(rnd.randint(24, 40))
            made = rnd.choice(["credential = ", "auth: ", 'bearer "', "private key = "]) + key
        text = " ".join([*sides[0], made, *sides[1]])
        if i % 10 == 3:
            planted[i] = (text.find(key), text.find(key) + len(key))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    spans = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    found = sum(any(kind == "crf" and a <= at and b >= end for kind, a, b in spans[i]) for i, (at, end) in planted.items())
    alarms = sum(bool(spans[i]) for i in range(2000) if i % 10 > 3)
    assert found >= 0.9 * len(planted) and alarms <= 0.01 * 1200
