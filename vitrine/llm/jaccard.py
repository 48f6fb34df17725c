"""N-gram Jaccard join on parity sketches.

A text is its set of word shingles. Within a band of set sizes, shingles are
dealt to blocks by hash and the hashes in a block are XORed, so a block shows the
parities of its shingles and two sketches differ in at most as many blocks as
the sets differ in shingles. Sets similar enough differ in no more than a known
number of blocks, so (pigeonhole) each needs only that many blocks and one more
as join keys, chosen in one order for all, to share one with every partner. The
order puts blocks with an uncommon shingle first, then the fuller ones.
Candidates that share a key are verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import sizing, skew
from vitrine.llm import blocks, graph
from vitrine.session import cut_lineage

WORDS, PERCENT = 5, 80
ROWS = 4096  # a row number and a shingle's hash share 64 bits
BAND = 4  # sizes of a band differ by less than this factor
BUCKET_BYTES, PACKED_ROWS = 8 << 20, 2048
MOST_SLOT_BITS, SLOT_PARTS = 22, 16
SKETCH_BITS, CELL_ROWS = 2048, 1024
#: Pairs of one set that are compared in one task.
HUB_PAIRS = 512
_ROW_SHIFT = np.uint64(52)
_STEPS = blocks.mixed(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(slab: blocks.Slab, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, as 52-bit hashes, and where each text's begin."""
    data = blocks.lowered(slab.data)
    starts, ends = blocks.word_spans((data != 32) & ((data < 9) | (data > 13)), slab.offsets)
    each = blocks.span_hashes(blocks.running_bytes(data), starts, ends)
    bounds = np.searchsorted(starts, slab.offsets)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    full = max(0, len(each) - words + 1)
    sums = np.zeros(full, np.uint64)
    for i in range(words):
        sums += each[i : full + i] * _STEPS[i]
    whole = row[:full] == row[words - 1 :]
    rows, hashes = row[:full][whole], blocks.mixed(sums[whole])
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        at = [each[bounds[i] : bounds[i + 1]] for i in short.tolist()]
        lone = np.array([(w * _STEPS[: len(w)]).sum() + np.uint64(len(w)) for w in at], np.uint64)
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, blocks.mixed(lone)])
    keys = np.unique((rows.astype(np.uint64) << _ROW_SHIFT) | (hashes >> np.uint64(12)))
    begins = np.searchsorted(keys, np.arange(len(counts) + 1).astype(np.uint64) << _ROW_SHIFT)
    return keys & np.uint64((1 << 52) - 1), begins


def _most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """Shingles in which sets of these sizes may differ at the least similarity:
    of ``a + b``, twice ``percent / (100 + percent)`` are shared."""
    return (a + b) * (100 - percent) // (100 + percent)


def _groups(size: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """The groups of sketches a set takes part in: (group, blocks, keys). A set meets
    those of its own band, and across a band's border those on the other side."""
    low = 1
    number = 0
    while low * BAND <= size:
        low, number = low * BAND, number + 1
    high, widest = low * BAND, lambda n: n * 100 // percent

    def dealt(group: int, most: int, own: int) -> tuple[int, int, int]:
        return group, -(-most * 135 // 100) + 2, own + 1

    yield dealt(2 * number, _most_different(high - 1, high - 1, percent), _most_different(size, min(widest(size), high - 1), percent))
    for border, group in ((low, 2 * number - 1), (high, 2 * number + 1)):
        if size < border <= widest(size) or border <= size <= widest(border - 1):
            other = border - 1 if size >= border else widest(size)
            yield dealt(group, _most_different(border - 1, widest(border - 1), percent), _most_different(size, other, percent))


def sketch_keys(hashes: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The join keys of one set; ``ranks`` has the commonness of shingles by hash."""
    out = []
    common = ranks[(hashes & np.uint64(len(ranks) - 1)).astype(np.int64)]
    for group, count, wanted in _groups(len(hashes), percent):
        salt = blocks.mixed(np.array([group], np.uint64))
        token = blocks.mixed(hashes ^ salt)
        block = (token % np.uint64(count)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        filled, first = np.unique(block[order], return_index=True)
        parity = np.bitwise_xor.reduceat(blocks.mixed(token)[order], first)
        key = blocks.mixed(parity ^ blocks.mixed(filled.astype(np.uint64) + salt))
        rarest = np.minimum.reduceat(common[order], first).astype(np.int64)
        sizes = np.diff(np.append(first, len(order)))
        if len(filled) < wanted:  # empty blocks come last
            empty = np.setdiff1d(np.arange(count), filled).astype(np.uint64)
            key = np.concatenate([key, blocks.mixed(blocks.mixed(empty + salt))])
            rarest = np.concatenate([rarest, np.full(len(empty), 256)])
            sizes = np.concatenate([sizes, np.zeros(len(empty), np.int64)])
        out.append(key[np.lexsort((key, -sizes, rarest))[:wanted]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def commonness(named: DataFrame, words: int = WORDS) -> np.ndarray:
    """How common shingles are, over all documents: by hash slot 0 for an ordinary
    count and one more for each doubling. There are about as many slots as
    documents, within bounds, so the table's size is bounded; counts of a task
    are one array, and arrays are summed in two steps. A shingle that shares
    its slot may rank too common, which costs time and loses nothing."""
    slots = 1 << min(MOST_SLOT_BITS, max(12, (named.count() - 1).bit_length()))
    part = slots // SLOT_PARTS

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salt = np.zeros(slots, np.int64), 0
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                for slab in blocks.slabs(batch.slice(low, ROWS), "text"):
                    hashes, _ = shingle_sets(slab, words)
                    counts += np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
                    salt = (salt * 31 + len(hashes)) % SLOT_PARTS
        yield arrays({(i, salt): counts[i * part : (i + 1) * part] for i in range(SLOT_PARTS)})

    def arrays(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = [pa.array([k[i] for k in sums], pa.int32()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, blocks.binaries([v.tobytes() for v in sums.values()])], ["part", "salt", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[number, 0] = sums.get((number, 0), 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield arrays(sums)

    schema = "part int, salt int, counts binary"
    tallied = named.select("text").mapInArrow(blocks.tidy(tally), schema).repartition("part", "salt").mapInArrow(blocks.tidy(add), schema)
    rows = tallied.repartition("part").mapInArrow(blocks.tidy(add), schema).toPandas()
    counts = np.zeros(slots, np.int64)
    for number, raw in zip(rows["part"], rows["counts"], strict=True):
        counts[number * part : (number + 1) * part] += np.frombuffer(raw, np.int64)
    ordinary = counts.mean() + 8 * np.sqrt(counts.mean()) + 8
    return np.maximum(np.ceil(np.log2(np.maximum(counts, 1) / ordinary)), 0).astype(np.uint8)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[f"`{id_col}`"].cast("bigint").alias("id"), docs[f"`{text_col}`"].alias("text"))


def profiles(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, size, one, two, keys): set size, two sums that identify the set, join keys."""
    named = _named(docs, id_col, text_col)
    ranks = commonness(named, words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                for slab in blocks.slabs(part, "text"):
                    hashes, begins = shingle_sets(slab, words)
                    sets = [hashes[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                    keys = [sketch_keys(s, ranks, percent) if len(s) else s for s in sets]
                    ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                    flat = pa.array(np.concatenate(keys).view(np.int64))
                    one = np.array([blocks.mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                    two = np.array([blocks.mixed(s + np.uint64(1 << 60)).sum(dtype=np.uint64) for s in sets], np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            blocks.column(part, "id", slab),
                            pa.array(np.diff(begins)),
                            pa.array(one.view(np.int64)),
                            pa.array(two.view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(ends), flat),
                        ],
                        ["id", "size", "one", "two", "keys"],
                    )

    schema = "id bigint, size bigint, one bigint, two bigint, keys array<bigint>"
    return cut_lineage(named.mapInArrow(blocks.tidy(run), schema))


_ENTRY = np.dtype([("key", "<u8"), ("leader", "<i8"), ("member", "<i8")])


def _stars(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries that share a key, the smallest leader, and the pairs with it."""
    entries = entries[np.lexsort((entries["leader"], entries["key"]))]
    first = np.ones(len(entries), bool)
    first[1:] = entries["key"][1:] != entries["key"][:-1]
    heads = entries[first]
    rest = np.flatnonzero(~first)
    pairs = entries[rest].copy()
    pairs["leader"] = heads["leader"][np.cumsum(first)[rest] - 1]
    pairs["member"] = entries["leader"][rest]
    pairs = pairs[pairs["leader"] != pairs["member"]]
    pairs = pairs[np.lexsort((pairs["member"], pairs["leader"]))]
    if len(pairs):
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs["leader"][1:] != pairs["leader"][:-1]) | (pairs["member"][1:] != pairs["member"][:-1])
        pairs = pairs[new]
    return heads, pairs


def star_pairs(kept: DataFrame) -> DataFrame:
    """Candidates (a, b): for each key a star around its smallest id.

    A batch first makes stars of its own and sends on one row per key, so a key
    that very many sets share reaches its task once per batch. Entries travel
    packed, many to a row."""
    spark = kept.sparkSession
    total = kept.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("keys")).first()["keys"] * _ENTRY.itemsize
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, PACKED_ROWS) for b in batches for low in range(0, b.num_rows, PACKED_ROWS)):
            lists = batch.column(1)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            entries = np.zeros(int(counts.sum()), _ENTRY)
            entries["key"] = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            entries["leader"] = entries["member"] = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            heads, pairs = _stars(entries)
            entries = np.concatenate([heads, pairs])
            bucket = (entries["key"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            filled, first = np.unique(bucket[order], return_index=True)
            parts = np.split(entries[order], first[1:])
            rows = blocks.binaries([p.tobytes() for p in parts if len(p)])
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), rows], ["bucket", "entries"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(b, _ENTRY) for batch in batches for b in batch.column(0).to_pylist()]
        if not parts:
            return
        entries = np.concatenate(parts)
        local = entries["leader"] != entries["member"]
        _, pairs = _stars(entries[~local])
        pairs = np.concatenate([pairs, entries[local]])
        yield pa.RecordBatch.from_arrays([pa.array(pairs["leader"].copy()), pa.array(pairs["member"].copy())], ["a", "b"])

    packed = kept.select("id", "keys").mapInArrow(blocks.tidy(pack), "bucket int, entries binary")
    dealt = packed.repartition(buckets, "bucket").select("entries")
    return dealt.mapInArrow(blocks.tidy(join), "a bigint, b bigint").distinct()


def _copies(kept: DataFrame) -> DataFrame:
    """(id, first) of ids whose set another, smaller id has too: they are linked
    without a look, and only the smallest one is joined with others."""
    equal = ["size", "one", "two"]
    several = kept.groupBy(*equal).agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    found = kept.select("id", *equal).join(sizing.small_side(several), equal).filter("id > first")
    return cut_lineage(found.select("id", "first").distinct())


def _verified(pairs: DataFrame, kept: DataFrame, named: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) for candidate pairs. Sizes too far apart are never linked; the
    sets of all others are made again from their texts and intersected."""
    sizes = kept.select("id", "size").dropDuplicates(["id"])
    known = cut_lineage(pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b"))
    near = F.expr(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
    open_ = known.filter(near).select("a", "b")
    ids = sizing.small_side(open_.select(F.col("a").alias("id")).union(open_.select("b")).distinct())

    def remake(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                for slab in blocks.slabs(part, "text"):
                    hashes, begins = shingle_sets(slab, words)
                    sets = [hashes[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([blocks.column(part, "id", slab), blocks.binaries(sets)], ["id", "hashes"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                shared = int((two[at] == one).sum())
                linked.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    sets = cut_lineage(named.join(ids, "id", "left_semi").mapInArrow(blocks.tidy(remake), "id bigint, hashes binary").dropDuplicates(["id"]))
    ones, twos = sets.toDF("a", "one"), sets.toDF("b", "two")
    # A hub has many pairs, and each row carries sets: its pairs are dealt to several tasks.
    half = skew.join(open_, ones, ["a"], "inner", spread=["b"], hot_rows=HUB_PAIRS)
    compared = skew.join(half, twos, ["b"], "inner", spread=["a"], counts=open_.groupBy("b").count(), hot_rows=HUB_PAIRS)
    compared = compared.select("a", "b", "one", "two")
    rest = known.filter(~near).select("a", "b", F.lit(False).alias("linked"))
    return cut_lineage(rest.union(compared.mapInArrow(blocks.tidy(compare), "a bigint, b bigint, linked boolean")))


def _unsettled(tested: DataFrame, kept: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, component) of the keys whose sets are not yet in one component.

    Such a key also holds a pair that was compared and not linked, so only keys
    of ids in those pairs are looked at; a key of two sets has been compared."""
    doubtful = tested.filter("NOT linked")
    ids = doubtful.select(F.col("a").alias("id")).union(doubtful.select("b")).distinct()
    entries = kept.select("id", F.explode("keys").alias("key"))
    keys = entries.join(sizing.small_side(ids), "id", "left_semi").groupBy("key").count()
    wanted = sizing.small_side(keys.filter("count > 1").select("key"))
    rows = entries.join(wanted, "key", "left_semi").join(sizing.small_side(found), "id", "left")
    return _spread(rows.withColumn("component", F.coalesce("component", "id")))


def _spread(rows: DataFrame) -> DataFrame:
    rows = cut_lineage(rows)
    spread = F.expr("count(*) > 2 AND min(component) < max(component)")
    several = rows.groupBy("key").agg(spread.alias("spread")).filter("spread").select("key")
    return rows.join(sizing.small_side(several), "key", "left_semi")


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """For each key a star around the set that meets most others: the original of
    many near copies shares nearly all its keys, a copy only some."""
    rows = cut_lineage(rows)
    met = sizing.small_side(rows.groupBy("key").count())
    weights = sizing.small_side(rows.join(met, "key").groupBy("id").agg(F.sum("count").alias("weight")))
    heads = rows.join(weights, "id").groupBy("key").agg(
        F.max(F.struct("weight", -F.col("id"), "component")).alias("head")
    )
    pairs = rows.join(sizing.small_side(heads), "key").filter("component <> head.component")
    other = -F.col("head.col2")
    return pairs.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct()


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """Each shingle flips one of ``SKETCH_BITS`` bits, so two sketches differ in at
    most as many bits as the sets differ in shingles."""
    place = (blocks.mixed(hashes) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=SKETCH_BITS) & 1)


def _close(cell: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs in a cell, of two components, that their sketches and sizes allow to link."""
    out = [np.zeros((0, 2), np.int64)]
    sketches = np.ascontiguousarray(cell["sketch"]).view(np.uint64).reshape(len(cell), -1)
    size, component = cell["size"], cell["component"]
    largest = np.unique(component, return_counts=True)
    apart = np.flatnonzero(component != largest[0][largest[1].argmax()])
    for low in range(0, len(apart), 32):
        at = apart[low : low + 32]
        differ = np.bitwise_count(sketches[at][:, None, :] ^ sketches[None, :, :]).sum(2, dtype=np.int64)
        most = (size[at][:, None] + size[None, :]) * (100 - percent) // (100 + percent)
        i, j = np.nonzero((differ <= most) & (component[at][:, None] != component[None, :]))
        out.append(np.stack([at[i], j], 1))
    return np.concatenate(out)


def _sketched_pairs(rows: DataFrame, named: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of a key, of two components, that bit sketches don't rule out.

    A key with many sets is cut into parts, and any two parts meet in a cell of
    bounded size; a task compares a cell at a time and passes on the few pairs left."""
    cells = F.ceil(F.col("count") / CELL_ROWS).cast("int")
    parts = sizing.small_side(rows.groupBy("key").count().select("key", cells.alias("parts")))
    own = F.pmod(F.xxhash64("id"), "parts").cast("int")
    dealt = rows.join(parts, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "id", "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    ids = sizing.small_side(rows.select("id").distinct())

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                for slab in blocks.slabs(part, "text"):
                    hashes, begins = shingle_sets(slab, words)
                    bits = [bit_sketch(hashes[a:b]).tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                    sizes = pa.array(np.diff(begins))
                    yield pa.RecordBatch.from_arrays([blocks.column(part, "id", slab), sizes, blocks.binaries(bits)], ["id", "size", "sketch"])

    made = named.join(ids, "id", "left_semi").mapInArrow(blocks.tidy(sketch), "id bigint, size bigint, sketch binary").dropDuplicates(["id"])
    full = dealt.join(sizing.small_side(made), "id").select("key", "low", "high", "id", "component", "size", "sketch")
    entry = np.dtype([("cell", "<i8", 3), ("id", "<i8"), ("component", "<i8"), ("size", "<i8"), ("sketch", "u1", SKETCH_BITS // 8)])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, entry)
        for batch in [*batches, None]:
            if batch is not None and batch.num_rows:
                new = np.zeros(batch.num_rows, entry)
                for i in range(3):
                    new["cell"][:, i] = batch.column(i).to_numpy(zero_copy_only=False)
                for i, name in enumerate(("id", "component", "size")):
                    new[name] = batch.column(3 + i).to_numpy(zero_copy_only=False)
                new["sketch"] = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(len(new), -1)
                held = np.concatenate([held, new])
            if not len(held):
                continue
            cuts = [0, *(np.flatnonzero((held["cell"][1:] != held["cell"][:-1]).any(1)) + 1).tolist(), len(held)]
            done = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last cell may go on
            found: set[tuple[int, int]] = set()
            for a, b in zip(cuts[:done], cuts[1:], strict=False):
                cell = held[a:b]
                ids = cell["id"][_close(cell, percent)]
                found.update(zip(ids.min(1, initial=1 << 62).tolist(), ids.max(1, initial=-1 << 62).tolist(), strict=True))
            held = held[cuts[done] :].copy()
            columns = [pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    cell = ["key", "low", "high"]
    dealt_out = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(dealt_out, *cell).sortWithinPartitions(*cell).mapInArrow(blocks.tidy(compare), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The class of every document: (id, size, component).

    Words are runs of other than white space, A-Z in lower case; a text's set is
    its distinct runs of ``words`` words (all words, if it has fewer). Two texts link when
    their shared shingles are at least ``percent`` percent of all of theirs; the
    component is the smallest id that links lead to. Nothing is missed: every
    linked pair shares a key, and is compared unless already in one component.
    NULL and empty texts and white space have size 0 and link with nothing; rows
    without an id (an integer) take no part and have no component. An id is taken to
    name one text: repeated rows come back alike, and an empty table gives no
    rows. Other columns play no part.
    """
    named = _named(docs, id_col, text_col)
    kept = profiles(docs, id_col, text_col, words, percent)
    able = kept.filter("size > 0 AND id IS NOT NULL")
    copies = _copies(able)
    distinct = able.join(sizing.small_side(copies.select("id")), "id", "left_anti")
    tested = _verified(star_pairs(distinct), distinct, named, words, percent)
    found = cut_lineage(graph.components(tested.filter("linked").select("a", "b")))
    rows = _unsettled(tested, distinct, found)
    for last in (False, True):  # what stars leave open is compared in full
        new = _sketched_pairs(rows, named, words, percent) if last else _hub_pairs(rows)
        new = new.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        more = _verified(new, distinct, named, words, percent)
        bridges = cut_lineage(more.filter("linked").select("a", "b"))
        tested = tested.union(more)
        if not bridges.isEmpty():
            links = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
            found = cut_lineage(graph.components(links.union(bridges)))
            renewed = rows.drop("component").join(sizing.small_side(found), "id", "left")
            rows = _spread(renewed.withColumn("component", F.coalesce("component", "id")))
    reached = found.withColumnRenamed("id", "first")
    of_copies = copies.join(reached, "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    classes = sizing.small_side(found.union(of_copies))
    return kept.select("id", "size").join(classes, "id", "left").select(
        "id", "size", F.coalesce("component", "id").alias("component")
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that of the smallest id, with all its columns;
    rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col).filter("id <> component").select(F.col("id").alias("_copy"))
    return docs.join(sizing.small_side(found), F.col(f"`{id_col}`") == F.col("_copy"), "left_anti")
