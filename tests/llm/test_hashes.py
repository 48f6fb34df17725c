"""Texts made to deceive hashes: equal for any base modulo a power of two, or under a weak hash."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from vitrine.llm import blocks, bpe, jaccard, registered


def thue_morse(size, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


def pair(spark):
    texts = [thue_morse(2048, "ab"), thue_morse(2048, "ba")]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)


def test_spans_of_equal_content_alone_have_equal_hashes():
    data = np.frombuffer((thue_morse(2048, "ab") + thue_morse(2048, "ba") + thue_morse(2048, "ab")).encode(), np.uint8)
    starts = np.array([0, 2048, 4096])
    one, two, three = blocks.span_hashes(blocks.running_bytes(data), starts, starts + 2048)
    assert one == three != two
    spans = np.array([(a, a + n) for n in range(1, 40) for a in range(200)])
    hashes = blocks.span_hashes(blocks.running_bytes(data), spans[:, 0], spans[:, 1])
    content = [data[a:b].tobytes() for a, b in spans]
    assert len(set(zip(hashes.tolist(), content, strict=True))) == len(set(hashes.tolist())) == len(set(content))


def test_tokens_of_complementary_texts(spark):
    texts, docs = pair(spark)
    path = public_tokenizers.path(registered.VOCABULARY)
    ranks = bpe._ranks(bpe.load_ranks(path))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in registered.token_digests(docs).collect()}
    for i, text in enumerate(texts):
        ids = np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert found[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_slices_are_told_apart_when_their_hashes_are_not(monkeypatch):
    monkeypatch.setattr(blocks, "span_hashes", lambda sums, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    data = np.frombuffer(b"one two six one tenfour four", np.uint8)
    starts = np.array([0, 4, 8, 12, 16, 19, 23])
    ends = np.append(starts[1:], len(data))
    example, which = bpe._distinct(data, starts, ends)
    pieces = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert [pieces[example[w]] for w in which] == pieces
    assert len(example) == len(set(pieces))


def test_disjoint_texts_are_not_linked(spark):
    _, docs = pair(spark)
    found = {r["id"]: r["component"] for r in jaccard.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 1}


def test_decoding_in_the_same_pass_is_decoding(spark):
    rows = [(1, "naïve 東京 don't\n  x"), (2, None), (3, ""), (None, "𝄞" * 50), (4, "a" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    path = public_tokenizers.path(registered.VOCABULARY)
    both = bpe.encode(docs, path, decoded=True)
    again = bpe.decode(both.select("id", "ids"), path)
    plain = {i: (t or "").encode() for i, t in rows}
    assert {r["id"]: bytes(r["decoded"]) for r in both.collect()} == plain
    assert {r["id"]: bytes(r["decoded"]) for r in again.collect()} == plain
