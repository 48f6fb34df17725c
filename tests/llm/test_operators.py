"""The training-data operators against brute force, with awkward rows throughout."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm import (
    blocks,
    bpe,
    decontaminate,
    exact,
    graph,
    jaccard,
    language,
    licences,
    quality,
    registered,
    repeats,
    secrets,
    urls,
)

SCHEMA = "doc_id bigint, text string, lang string, id long, own string, key string, size long, count int, a int, kind string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark, rows, parts=3):
    """Documents with columns that clash with the operators' own names."""
    full = [(i, text, lang, 7, "x", "k", 1, 2, 3, "z") for i, text, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def texts(seed, count, low=1, high=80):
    rnd = random.Random(seed)
    words = ["the", "of", "and", "Alpha", "beta", "gamma", "delta", "naïve", "東京", "x1", "mit", "license", "under", "don't", "42"]
    words += ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    gap = [" ", " ", " ", "  ", "\n", "\t", ", ", ". "]
    return ["".join(w + rnd.choice(gap) for w in rnd.choices(words, k=rnd.randint(low, high))) for _ in range(count)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    made = texts(1, 60)
    long = " ".join(texts(2, 60, 100, 200))
    passage = " ".join(texts(3, 1, 60, 60))
    out = [(i, t, "en") for i, t in enumerate(made)]
    out += [(100 + i, made[i], None) for i in range(10)]  # copies
    out += [(200 + i, re.sub(r"\s+", "\n ", made[i]), "fr") for i in range(5)]  # other white space
    for i in range(25):  # near copies, some of copies
        words = (made[i % 7] + " " + passage).split(" ")
        words[rnd.randrange(len(words))] = "changed" + str(i % 4)
        out.append((300 + i, " ".join(words), "en"))
    out += [(400, None, "en"), (401, "", "en"), (402, " \n\t ", None), (403, "?! 123", "de"), (404, long, "en")]
    out += [(405, long[: len(long) // 2] + passage, "en"), (406, "a b c", "en"), (407, "a b c", "en"), (408, "A b\tc", "en")]
    out += [(3, made[3], "en"), (3, made[3], "en")]  # repeated rows
    out += [(None, made[0], "en"), (None, None, None)]  # rows without an id
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [], 1)


def by_id(frame, *columns):
    found = {}
    for row in frame.select("id", *columns).collect():
        found.setdefault(row[0], []).append(tuple(row[1:]))
    return found


def test_slabs_take_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "漢字", "x" * 50])], ["text"]).slice(1)
    seen = [s.data[a:b].tobytes().decode() for s in blocks.slabs(batch, "text", 4) for a, b in itertools.pairwise(s.offsets)]
    assert seen == ["", "", "漢字", "x" * 50]


def test_licences_match_brute_force(docs, rows, empty):
    extra = "Und CC BY-NC 4.0 under the  MIT-license; Apache License, version 2. under THE mit\nlicense"
    more = docs.union(docs.limit(1).withColumns({"doc_id": F.lit(900).cast("bigint"), "text": F.lit(extra)}))
    found = by_id(licences.scan(more), "n_words", "spans")
    for i, text in [(900, extra), *((i, t) for i, t, _ in rows if i is not None)]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = sorted(
            (at, label)
            for phrase, label in licences.PHRASES.items()
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        )
        for n_words, spans in found[i]:
            assert n_words == len(words)
            assert sorted((s["start"], s["label"]) for s in spans if s["phrase"]) == places
    assert {s["label"] for s in found[900][0][1]} == {"mit", "cc-by-nc", "apache-2"}
    assert licences.scan(empty).count() == 0


def test_licence_template_with_gaps(spark, docs):
    text = licences.TEMPLATES[0][1].replace("merge publish", "merge quietly publish") + " and more words"
    found = licences.scan(table(spark, [(1, "before it " + text.title(), None), (2, text[: len(text) // 3], None)]))
    labels = by_id(found.select("id", F.transform("spans", lambda s: s["label"]).alias("labels")), "labels")
    assert labels == {1: [(["mit"],)], 2: [([],)]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=30))
def test_automaton_gives_longest_matches(sequences, stream):
    held = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for at, (_, length) in enumerate(licences.Automaton(sequences).stream(stream)):
        assert length == max((n for n in range(at + 2) if n == 0 or tuple(stream[at + 1 - n : at + 1]) in held), default=0)


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(rows):
    sets = {i: plain_set(t) for i, t, _ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in itertools.combinations(sorted(sets), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 80 * len(sets[x] | sets[y]):
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("cell_rows", [1024, 2])
def test_jaccard_join_matches_brute_force(docs, rows, empty, monkeypatch, cell_rows):
    monkeypatch.setattr(jaccard, "CELL_ROWS", cell_rows)
    wanted = plain_components(rows)
    found = by_id(jaccard.near_duplicates(docs), "size", "component")
    assert {i: set(v) for i, v in found.items() if i is not None} == {i: {v} for i, v in wanted.items()}
    assert sum(map(len, found.values())) == len(rows)
    assert all(component is None for _, component in found[None])
    if cell_rows > 2:
        assert jaccard.near_duplicates(empty).count() == 0
        kept = [r["doc_id"] for r in jaccard.without_near_duplicates(docs).select("doc_id").collect()]
        assert set(kept) == {c for _, c in wanted.values()} | {None}


def test_jaccard_join_of_many_variants(spark):
    """Copies of one original that mostly don't link to each other."""
    rnd = random.Random(11)
    original = [f"w{i}" for i in range(120)]
    made = [(0, " ".join(original), None)]
    for i in range(1, 150):
        words = list(original)
        for at in rnd.sample(range(120), rnd.randint(1, 4)):
            words[at] = f"v{i}_{at}"
        made.append((i * 7 % 151 + 1, " ".join(words), None))
    wanted = plain_components(made)
    found = by_id(jaccard.near_duplicates(table(spark, made, 6)), "size", "component")
    assert {i: v[0] for i, v in found.items()} == wanted


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.floats(0, 1))
def test_similar_sets_share_a_key(size, seed, part):
    rnd = np.random.default_rng(seed)
    one = np.unique(rnd.integers(0, 1 << 52, size, dtype=np.uint64))
    gone = int(part * 0.2 * len(one))
    two = one[gone:]
    more = int((len(two) / 0.8 - len(one)) * rnd.random())
    two = np.unique(np.concatenate([two, rnd.integers(0, 1 << 52, max(0, more), dtype=np.uint64)]))
    shared = len(np.intersect1d(one, two))
    ranks = rnd.integers(0, 3, 1 << 12).astype(np.uint8)
    if 100 * shared >= 80 * (len(one) + len(two) - shared):
        assert len(np.intersect1d(jaccard.sketch_keys(one, ranks), jaccard.sketch_keys(two, ranks)))
    differ = np.bitwise_count(jaccard.bit_sketch(one) ^ jaccard.bit_sketch(two)).sum()
    assert differ <= len(np.setxor1d(one, two))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(5, i) for i in range(100, 130)] + [(130, 129), (7, 7), (131, 132), (132, 131)]
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 20 for i in range(20, 61)} | {i: 5 for i in [5, *range(100, 131)]} | {131: 131, 132: 131}


def test_exact_dedup_matches_brute_force(docs, rows, empty):
    groups = {}
    for i, text, _ in rows:
        if i is not None:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    wanted = {i: [(min(g), len(g))] for g in groups.values() if len(g) > 1 for i in g}
    assert by_id(exact.copies(docs), "keep_id", "group_size") == wanted
    assert exact.copies(empty).count() == 0 and exact.without_copies(empty).count() == 0
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([min(g) for g in groups.values()] + [None, None], key=str)


def alike(one, two, budget):
    """Whether some part of ``two`` is within ``budget`` edits of ``one``."""
    last = list(range(len(one) + 1))
    best = last[-1]
    for char in two:
        now = [0]
        for i, own in enumerate(one):
            now.append(min(last[i] + (own != char), last[i + 1] + 1, now[i] + 1))
        last, best = now, min(best, now[-1])
    return best <= budget


def test_decontamination_matches_brute_force(spark, empty):
    rnd = random.Random(3)
    items = [(i, t) for i, t in enumerate(texts(21, 6, 8, 45))] + [(90, None), (91, ""), (92, "short"), (93, texts(21, 1, 8, 45)[0])]
    made = []
    for i, (_, text) in enumerate(items[:6]):
        for edits in (0, 4, 9, 14, 25, 60):
            chars = list(text.upper() if edits == 4 else text)
            for _ in range(edits):
                at = rnd.randrange(len(chars))
                chars[at : at + 1] = rnd.choice([[], ["q"], [chars[at], "z"]])
            around = texts(100 + i, 2)
            made.append((len(made), around[0] + "".join(chars) + around[1], None))
    made += [(500, None, None), (501, "", None), (502, items[0][1], None), (502, items[0][1], None), (None, items[0][1], None)]
    benchmark = spark.createDataFrame(items, "item_id int, text string").withColumn("id", F.lit(1))
    index = decontaminate.Index([t or "" for _, t in items])
    plain = lambda t: decontaminate.plain(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].tobytes()
    wanted = set()
    for i, text, _ in made:
        for owner, window, budget in zip(index.owners.tolist(), index.windows, index.budgets.tolist(), strict=True):
            if i is not None and alike(window.tobytes(), plain(text), budget):
                wanted.add((i, items[owner][0]))
    found = decontaminate.contaminated(table(spark, made), benchmark)
    pairs = [(r["id"], r["item"]) for r in found.collect()]
    assert set(pairs) == wanted and len(pairs) == len(wanted)
    kept = {r["doc_id"] for r in decontaminate.without_contaminated(table(spark, made), benchmark).collect()}
    assert kept == {i for i, _, _ in made} - {i for i, _ in wanted}
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(table(spark, made), benchmark.filter("item_id < 0")).count() == 0


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs, rows, empty, encoding):
    encoded = bpe.encode(docs, VOCABULARY)
    found = by_id(encoded, "ids", "offsets")
    decoded = by_id(bpe.decode(encoded, VOCABULARY), "decoded")
    for i, text, _ in rows:
        if i is None:
            continue
        ids, offsets = (np.frombuffer(v, "<u4").tolist() for v in found[i][0])
        assert ids == encoding.encode_ordinary(text or "")
        sizes = [len(encoding.decode_single_token_bytes(t)) for t in ids]
        assert offsets == [sum(sizes[:k]) for k in range(len(sizes))]
        assert decoded[i][0][0] == (text or "").encode()
    assert len(found[None]) == 2 and bpe.encode(empty, VOCABULARY).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" '\n\t\u00a0\x85\x1csdtrevlmabZ09.,-é漢!?")), max_size=60))
def test_bpe_boundaries(encoding, text):
    slab = next(blocks.slabs(pa.RecordBatch.from_arrays([pa.array([text, "x", text])], ["text"]), "text"))
    ids, _, first = ENCODER().encode(slab)
    for i in (0, 2):
        assert ids[first[i] : first[i + 1]].tolist() == encoding.encode_ordinary(text)


_MADE = []


def ENCODER():
    if not _MADE:
        _MADE.append(bpe.Encoder(bpe.load_ranks(VOCABULARY), bpe.character_classes()))
    return _MADE[0]


def test_bpe_long_piece(encoding):
    piece = "ab" * 4000 + "x" * 3000
    assert bpe.merge_piece(piece.encode(), ENCODER().ranks) == encoding.encode_ordinary(piece)


def test_language_on_held_out(spark, sf_dir, empty, docs):
    given_ = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    found = registered.op7_language(spark, sf_dir.replace("0.001", "0.01")).join(given_.select("doc_id", "lang"), "doc_id")
    judged = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert judged[0] > 0.98 and 0 <= judged[1] <= judged[2] <= 1
    model = language.train(docs)
    predicted = by_id(language.predict(docs, model), "lang_pred", "score")
    assert {i for i, v in predicted.items() if v[0][0] == "und"} >= {400, 401, 402, 403}
    assert len(predicted[None]) == 2 and set(model.languages) == {"en", "fr"}
    kept = language.in_a_language(docs, model)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id IN (400, 401, 402, 403)").count() == 0
    assert kept.count() == sum(v[0] != "und" for rows in predicted.values() for v in rows)
    assert language.train(empty) is None
    assert {v[0] for v in language.predict(docs, None).select("lang_pred").collect()} == {"und"}


def test_language_takes_only_training_rows(spark):
    rows = [(i, "the of and", "en") for i in range(40)] + [(i, "der die das", "de") for i in range(100, 140)]
    docs = table(spark, rows)
    changed = docs.withColumn("lang", F.when(language.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    for frame in (docs, changed):
        model = language.train(frame.filter(~language.held_out("doc_id")))
        assert model.languages == ["de", "en"]


@pytest.mark.parametrize("hot", [64, 1])
def test_repeated_bytes_match_brute_force(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 5000)
    found = by_id(repeats.without_repeats(docs), "n_bytes", "removed", "kept")
    seen = {}
    for i, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 99):
            if seen.setdefault(raw[at : at + 100], (i, at)) != (i, at):
                gone[at : at + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        for n_bytes, removed, rest in found[i]:
            assert (n_bytes, [tuple(s) for s in removed], bytes(rest)) == (len(raw), spans, kept)
    assert all(not removed for _, removed, _ in found[None])
    if hot > 1:
        assert repeats.without_repeats(empty).count() == 0


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets_keep_the_patterns_spans(spark, docs, rows, empty):
    rnd = random.Random(9)
    hexes = ["".join(rnd.choices("0123456789abcdef", k=40)) for _ in range(80)]
    words = texts(31, 80, 20, 60)
    made = [(i, f'{w}é token = "{h}" {w}', None) for i, (w, h) in enumerate(zip(words, hexes, strict=True))]
    made += [(200, f"Passwd:abcdef AKIA{'Z9' * 8} api_key=x TOKEN='ab.cd/e' {'f' * 24} {'0' * 23} ſecret=abcdefgh", None)]
    made += [(201, f'{words[0]} pin = "{hexes[0].upper()}" {words[1]}', None), (202, words[2], None)]
    made += [(i, t, None) for i, t, _ in rows if i is None or i >= 400]
    found = by_id(secrets.scan(table(spark, made)), "spans")
    for i, text, _ in made:
        if i is not None:
            spans = [tuple(s) for s in found[i][0][0]]
            assert [s for s in spans if s[0] != "crf"] == base_spans(text or "")
            assert spans == sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    extra = [s for s in found[201][0][0] if s["kind"] == "crf"]
    assert [made[81][1][s["start"] : s["end"]] for s in extra] == [hexes[0].upper()]
    assert found[202] == [([],)]
    assert secrets.scan(empty).count() == 0


def test_field_decoding_is_exact():
    """The stretches between sure tokens give the best path of the whole sequence."""
    rnd = np.random.default_rng(4)
    field = secrets.Field()
    field.moves[:] = rnd.normal(0, 1, (3, 3))
    field.seen[3] = rnd.normal(0, 3, field.seen[3].shape) + [3, 0, 0]
    words = [" ".join(texts(s, 1, 1, 6)) for s in range(60)]
    slab = next(blocks.slabs(pa.RecordBatch.from_arrays([pa.array(words)], ["text"]), "text"))
    tokens = secrets.Tokens(slab)
    tags, scores = field.tags(tokens), field.emissions(tokens)
    for a, b in itertools.pairwise(tokens.bounds.tolist()):
        if not 0 < b - a <= 8:
            continue
        value = lambda path, a=a: sum(scores[a + i, t] for i, t in enumerate(path)) + sum(field.moves[p] for p in itertools.pairwise(path))
        best = max(value(path) for path in itertools.product(range(3), repeat=b - a))
        assert value(tags[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def plain_verdict(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_urls_match_brute_force(spark):
    hosts = ["example.com", "WWW.example.com", "a.b.net", "net", "notnet", "x.org:80", "com", "", "a..com", "m.example.com"]
    paths = ["", "/", "/en", "/en/", "/en/x?y=/fr/", "/fr/z#q", "/es/", "?/es/", "#", "//es/"]
    made = [f"{s}{h}{p}" for s in ("http://", "ftp+x://", "http:/") for h in hosts for p in paths] + [None, "", "a://b.com/://c.net/es/"]
    rows = [(i, u) for i, u in enumerate(made)] + [(0, made[0]), (None, made[3])]
    pages = spark.createDataFrame(rows, "page_id int, url string").withColumns({"host": F.lit("h"), "key": F.lit(1)})
    more = [*urls.RULES, ("block", "b.com", ""), ("allow", "x.org:80", "/fr/z"), ("block", "x.org:80", "/fr/z")]
    for listed in (urls.RULES, more, []):
        found = urls.judge(pages, urls.rules(spark, listed)).collect()
        wanted = [(i, *plain_verdict(u, listed)) for i, u in rows]
        assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert urls.judge(pages.limit(0), urls.rules(spark)).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = urls.bloom(keys)
    assert urls.possible(keys, words).count() == 3000
    other = spark.range(3000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert urls.possible(other, words).count() < 300


def test_digest_columns(spark, sf_dir):
    got = registered.op4_byte_bpe(spark, sf_dir)
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha"))
    assert got.join(text, "doc_id").filter("sha <> decoded_sha256").count() == 0
    empty_hash = hashlib.sha256(b"").hexdigest()
    none = registered.token_digests(table(spark, [(1, None, None)])).first()
    assert (none["n_tokens"], none["ids_sha256"], none["decoded_sha256"]) == (0, empty_hash, empty_hash)


def test_quality_on_labels_not_trained_on(spark, sf_dir, docs, empty):
    folder = sf_dir.replace("0.001", "0.01")
    given_, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    aside = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = quality.train(given_, labels.filter(~aside))
    found = quality.score(given_, model).withColumnRenamed("id", "doc_id").join(labels.filter(aside), "doc_id")
    right = lambda c: F.avg(((F.col(c) >= 0.5) == (F.col("quality") == 1)).cast("int"))
    combined, clean = found.agg(right("score"), F.avg(F.when(F.col("quality") == 1, (F.col("score") >= 0.5).cast("int")))).first()
    assert combined > 0.9 and clean > 0.95
    awkward = docs.withColumn("source", F.lit(None).cast("string"))
    scores = by_id(quality.score(awkward, model), "text_score", "meta_score", "score")
    assert sum(map(len, scores.values())) == docs.count()
    assert all(0 <= x <= 1 for rows in scores.values() for row in rows for x in row)
    both = labels.limit(0).unionByName(labels.filter("quality = 1").limit(3))
    assert quality.train(given_, both) is None and quality.train(awkward.limit(0), labels) is None
    assert {tuple(r) for r in quality.score(awkward, None).select("score").collect()} == {(0.5,)}
    assert quality.score(empty.withColumn("source", F.lit("s")), model).count() == 0


def test_views_teach_each_other():
    """A view that the few labels say nothing about learns from the other one."""
    rnd = np.random.default_rng(3)
    truth = rnd.random(600) < 0.5
    text = np.where(truth[:, None], 1.0, -1.0) + rnd.normal(0, 0.4, (600, 4))
    meta = np.where(truth[:, None], 1.0, -1.0) * np.array([[1, 0, 0]]) + rnd.normal(0, 0.6, (600, 3))
    known, pool = slice(0, 20), slice(20, 400)
    model = quality.co_train((text[known], meta[known]), truth[known].astype(float), (text[pool], meta[pool]))
    for view, features in ((model.text, text), (model.meta, meta)):
        assert ((view.odds(features[400:]) > 0) == truth[400:]).mean() > 0.9
