"""Archives written, read back by the library and by plain Zstandard, and held against the pages."""

from __future__ import annotations

import base64
import glob
import hashlib
import io
import random
import tempfile
from datetime import datetime, timezone

import pytest
import zstandard

from vitrine.llm import registered, warc

MOMENT = datetime(2024, 1, 31, tzinfo=timezone.utc)
SCHEMA = "page_id bigint, url string, html string, id string, digest string, largest long, payload string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "i", "d", 1, "p") for r in rows], SCHEMA).repartition(parts)


def pages(seed, count):
    rnd = random.Random(seed)
    words = ["<p>", "</p>", "naïve", "東京", "<a href='x'>", "alpha", "beta", "\r\n\r\n", "gamma", "delta"]
    return [(i, f"http://e.org/{i}?q=a b", "".join(rnd.choices(words, k=rnd.randint(0, 200)))) for i in range(count)]


def awkward():
    rows = pages(1, 300)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)] + [(2000 + i, None, rows[0][2]) for i in range(50)]
    rows += [(400, "a\r\nWARC-Type: x", None), (401, None, ""), (402, "http://é.fr", "x" * 300000), (403, "u", "\0P*M\x18\0\0\0\0")]
    rows += [(5, *rows[5][1:]), (1005, *rows[5][1:]), (None, "u", rows[7][2]), (None, "u", "alone")]
    return rows


def expected(rows, least=0):
    payloads = [(i, (html or "").encode()) for i, _, html in rows]
    largest = {}
    for i, body in payloads:
        largest[body] = max(largest.get(body, -1), -1 if i is None else i)
    out = []
    for i, body in payloads:
        keep = largest[body] if len(body) >= least and largest[body] >= 0 else i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "response" if keep == i else "revisit", None if keep == i else keep))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "size"), [(0, 1 << 20), (0, 5000), (100, 1)])
def test_round_trip(spark, least, size):
    rows = awkward()
    got = warc.archived(frame(spark, rows), MOMENT, least_bytes=least, archive_bytes=size)
    back = got.select("id", "payload_bytes", "payload_digest", "type", "refers_to").collect()
    assert sorted(map(tuple, back), key=str) == expected(rows, least)


def test_files_are_plain_zstandard_with_a_dictionary_ahead(spark):
    path = tempfile.mkdtemp() + "/archives"
    rows = pages(3, 500)
    warc.write(frame(spark, rows, 2), path, MOMENT, archive_bytes=60000)
    files = glob.glob(f"{path}/*/part-*")
    assert len(files) > 2
    bodies, packed, raw = set(), 0, 0
    for name in files:
        content = open(name, "rb").read()
        assert content[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
        size = int.from_bytes(content[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
        assert dictionary.dict_id()
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content), read_across_frames=True)
        plain = reader.readall()
        packed, raw = packed + len(content) - size, raw + len(plain)
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        records = list(warc.archive_records(content))
        assert b"".join(records) == plain
        bodies |= {warc.parsed(r)["payload"] for r in records[1:]}
    assert bodies >= {(h or "").encode() for _, _, h in rows if h}
    assert packed < raw / 3
    read = warc.read(spark, path)
    assert {bytes(r["payload"]).decode() for r in read.filter("type = 'response'").collect()} == {h for _, _, h in rows}
    assert {r["url"] for r in read.collect()} == {u.replace(" ", "%20") for _, u, _ in rows}


def test_damage_is_noticed():
    frames = warc.archive_frames([warc._page_record("1", "u", b"body", "x", None, "2024")], None)
    with pytest.raises(ValueError, match="damaged payload"):
        warc.parsed(next(warc.archive_records(b"".join(frames))))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.archive_records(b"".join(frames)[:-3]))


def test_empty_table(spark):
    assert warc.archived(frame(spark, []), MOMENT).count() == 0


def test_query_on_the_given_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = registered.op12_warc(spark, sf_dir)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == expected(given)
