"""The registered queries and the pipeline against plain Python, column by column."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from vitrine.llm import bpe, decontaminate, language, registered

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def rows(frame):
    out = {}
    for r in frame.collect():
        assert r[0] not in out
        out[r[0]] = tuple(r)[1:]
    return out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_op1_base_columns(spark, sf_dir, given):
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    found = rows(registered.op1_licences(spark, sf_dir))
    assert set(found) == set(given)
    for i, text in given.items():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        hits = [(at, label) for phrase, label in phrases.items() for at in range(len(words)) if tuple(words[at : at + len(phrase)]) == phrase]
        starts, labels = [at for at, _ in hits], {label for _, label in hits}
        wanted = (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert found[i][:5] == wanted
        assert labels <= set(found[i][5].split(",")) | {""} and 0 <= found[i][6] <= 1


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(sets):
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {i: top(i) for i in sets}


def test_op2_columns(spark, sf_dir, given):
    sets = {i: shingles(t) for i, t in given.items()}
    linked = components(sets)
    assert rows(registered.op2_jaccard_join(spark, sf_dir)) == {i: (len(s), linked[i]) for i, s in sets.items()}


def test_op3_and_op5_shapes(spark, sf_dir, given):
    leaks = registered.op3_decontaminate(spark, sf_dir).collect()
    assert leaks and len({(r["doc_id"], r["item_id"]) for r in leaks}) == len(leaks) and {r["doc_id"] for r in leaks} <= set(given)
    scored = rows(registered.op5_quality(spark, sf_dir))
    assert set(scored) == set(given) and all(0 <= v <= 1 for r in scored.values() for v in r[:3])


def test_op8_columns(spark, sf_dir, given):
    span, seen, wanted = 100, set(), {}
    for i in sorted(given):
        data = (given[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - span + 1):
            piece = data[at : at + span]
            if piece in seen:
                gone[at : at + span] = True
            seen.add(piece)
        edges = np.diff(np.concatenate([[0], gone, [0]]))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        wanted[i] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert rows(registered.op8_repeated_bytes(spark, sf_dir)) == wanted


def test_op9_base_columns(spark, sf_dir, given):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = rows(registered.op9_secrets(spark, sf_dir))
    assert set(found) == set(given)
    for i, text in given.items():
        spans = [("assign", *m.span()) for m in assign.finditer(text or "") if len(m[1]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        counts = tuple(sum(s[0] == kind for s in spans) for kind in ("assign", "access", "hex"))
        listed = [":".join(map(str, s)) for s in spans]
        assert found[i][:4] == (*counts, hashlib.sha256(",".join(listed).encode()).hexdigest())
        assert set(listed) <= set(found[i][4].split(",")) | {""}


def test_op10_columns(spark, sf_dir):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = rows(registered.op10_url_filter(spark, sf_dir))
    for i, url in urls.items():
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host) :])[0], lowered(host)
        fits = [(len(h) + len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        wanted = (host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None)
        assert found[i][:3] == wanted[:3] and (wanted[3] is None or found[i][3] == wanted[3])


def alike(window, text, budget):
    """Whether some region of the text is within so many edits of the window."""
    last = list(range(len(window) + 1))
    best = last[-1]
    for char in text:
        now = [0]
        for i, own in enumerate(window):
            now.append(min(last[i] + (own != char), last[i + 1] + 1, now[i] + 1))
        last, best = now, min(best, now[-1])
    return best <= budget


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_against_plain_stages(spark, tmp_path, empty):
    """NULL and empty texts, repeated rows, texts without letters, copies, near copies, leaks."""
    rnd = random.Random(11)
    words = {"en": "the of and to in that was his with for".split(), "de": "der die und den von zu mit sich des auf".split()}
    made = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        extra = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(25)]
        made.append((i, " ".join(rnd.choices(words[lang], k=15) + extra), lang if i % 5 else None, f"s{i % 3}", 0))
    item = " ".join("".join(rnd.choices("klmnopqrst", k=6)) for _ in range(40))
    made += [(100 + i, made[i][1].replace(" ", " \n ", 3), "en", "s", 0) for i in range(6)]
    made += [(200 + i, made[i][1] + " more", "en", "s", 0) for i in range(8, 14)]
    made += [(300, made[20][1] + " " + item[10:200], "en", "s", 0), (301, item, "en", "s", 0)]
    made += [(400, None, "en", "s", 0), (401, "", "de", "s", 0), (402, "123 !?", "en", "s", 0), (403, "42", None, None, None)]
    made = [] if empty else made
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(made, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: text for i, text, *_ in made if text and re.search(r"[^\W\d_]", text)}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    linked = components({i: shingles(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if linked[i] == i}
    index = decontaminate.Index([item])
    plain = lambda t: decontaminate.plain(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tobytes()
    windows = list(zip(index.windows, index.budgets.tolist(), strict=True))[::6] + [(index.windows[-1], int(index.budgets[-1]))]
    kept = {i: t for i, t in kept.items() if not any(alike(w.tobytes(), plain(t), b) for w, b in windows)}
    ranks = bpe._ranks(bpe.load_ranks(public_tokenizers.path(registered.VOCABULARY)))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {}
    for i, text in kept.items():
        ids = encoding.encode_ordinary(text)
        wanted[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == wanted
    assert empty or 30 < len(wanted) < len(made) - 15
    if not empty:
        stage = dict(corpus_pipeline.STAGES)["language_id"]
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("id", F.lit("clash"))
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, t, *_ in made if t and re.search(r"[^\W\d_]", t)}
        assert language.held_out("doc_id") is not None


def test_token_digests_keep_repeated_rows_and_ignore_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, "c", "z"), (2, None, None)], "doc_id bigint, text string, ids string")
    found = [tuple(r)[:2] for r in registered.token_digests(docs).collect()]
    assert sorted(found, key=str) == [(1, 2), (1, 2), (2, 0), (None, 1)]
    assert registered.token_digests(docs.limit(0)).count() == 0
