"""Hard negatives by cover trees over norm-augmented candidates.

A candidate x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared
norm, an anchor q gets a zero: then |q - x|^2 = |q|^2 + M - 2 qx, and a node that covers
its candidates within a radius of its centre bounds their inner products from both
sides by the triangle inequality.

Candidates are dealt to cells: one label, one nearest pivot, and as many blocks as
the cell's rows need. A task builds a cover tree per cell: nested nets of centres,
each level's points further apart than the level's scale, every node with its covering
radius. Trees are kept as rows of a table. Anchors meet them in blocks: level by level
the nodes outside an anchor's windows of wanted scores are left, the leaves that remain
are visited best first, in growing rounds, and their candidates are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import sizing
from vitrine.llm import blocks
from vitrine.session import cut_lineage

CELL_ROWS = 2048
LEAF_ROWS = 16
SHRINK = 1.2
# Pivots are picked from so many candidates of smallest id hash; each stands for so many cells' worth of rows.
PIVOT_SAMPLE, PIVOT_CELLS, MOST_PIVOTS = 2048, 8, 256
ANCHOR_BLOCK = 1024
FIRST_LEAVES = 4
SALTS = 16
# Scores are exact in doubles up to here.
LARGEST_NORM = 1 << 53
HELD_BYTES = 32 << 20


def whole_vectors(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, label, vector) with whole components floor(scale * x). Rows without an id, a label or
    a vector, or with a component that is NULL or not finite, take no part, nor do vectors whose
    squared norm is over 2^53, as their products are not exact."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    chosen = rows.filter(F.col(vector_col).isNotNull() & finite)
    named = chosen.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), scaled.alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    small = named.filter("id IS NOT NULL AND label IS NOT NULL").filter(squares <= F.lit(float(LARGEST_NORM)))
    return small.select("id", "label", F.col("vector").cast("array<int>").alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), blocks.ragged(np.zeros(len(sizes), np.int64), sizes)] = flat
    return out


def _augmented(points: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([points, np.sqrt(np.maximum(most - (points * points).sum(axis=1), 0.0))[:, None]])


def _farthest_first(points: np.ndarray, most: float, count: int) -> tuple[list[int], list[float], np.ndarray]:
    """Up to ``count`` centres, each the point furthest from those before it; its distance from
    them; and every point's nearest centre. All points have the squared norm ``most``."""
    order, radii = [0], [np.inf]
    near = np.maximum(2 * (most - points @ points[0]), 0.0)
    owner = np.zeros(len(points), np.int64)
    while len(order) < count:
        at = int(near.argmax())
        if near[at] <= 0:
            break
        radii.append(float(np.sqrt(near[at])))
        own = np.maximum(2 * (most - points @ points[at]), 0.0)
        own[at] = 0.0
        closer = own < near
        owner[closer] = len(order)
        near[closer] = own[closer]
        order.append(at)
    return order, radii, owner


class CoverTree:
    """Nested nets over one cell. ``points`` lie leaf by leaf; leaf j is the j-th centre."""

    def __init__(self, ids, points, most, offsets, centres, sizes, parents, radii) -> None:
        self.ids, self.points, self.most, self.offsets, self.centres = ids, points, most, offsets, centres
        self.sizes, self.parents, self.radii = sizes, parents, radii

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, most: float) -> CoverTree:
        begin = np.argsort(ids, kind="stable")
        ids, points = ids[begin], points[begin]
        full = _augmented(points, most)
        order, scales, owner = _farthest_first(full, most, max(1, len(ids) // LEAF_ROWS))
        count, sizes, level = len(order), [1], 0
        while sizes[-1] < count:
            level += 1
            within = int(np.searchsorted(-np.array(scales[1:]), -scales[1] / SHRINK**level, "right")) + 1
            if within > sizes[-1]:
                sizes.append(within)
        centres = full[order]
        parents, radii, above = [], [], np.arange(count)
        for i in range(len(sizes) - 1, -1, -1):  # from the leaves up; above: each leaf's node of the level
            reach = np.sqrt(np.maximum(2 * (most - np.einsum("ij,ij->i", full, centres[above[owner]])), 0.0))
            radius = np.zeros(sizes[i])
            np.maximum.at(radius, above[owner], reach)
            radii.insert(0, radius)
            if i:
                own = np.arange(sizes[i])
                new = own[sizes[i - 1] :]
                own[new] = (centres[new] @ centres[: sizes[i - 1]].T).argmax(axis=1)
                parents.insert(0, own)
                above = own[above]
        parents.insert(0, np.zeros(1, np.int64))
        leafwise = np.argsort(owner, kind="stable")
        offsets = np.searchsorted(owner[leafwise], np.arange(count + 1))
        return cls(ids[leafwise], points[leafwise], most, offsets, points[order], sizes, parents, radii)

    def packed(self) -> dict[str, bytes]:
        flat = [self.ids, self.points.astype(np.int32), self.offsets, self.centres.astype(np.int32), np.array(self.sizes)]
        return {k: v.tobytes() for k, v in zip(_TREE, [*flat, np.concatenate(self.parents), np.concatenate(self.radii)], strict=True)}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], most: float) -> CoverTree:
        ids, points, offsets, centres, sizes, parents, radii = (np.frombuffer(row[k], t) for k, t in zip(_TREE, _KINDS, strict=True))
        ends = np.cumsum(sizes)[:-1]
        points, centres = (a.reshape(n, -1).astype(np.float64) for a, n in ((points, len(ids)), (centres, len(offsets) - 1)))
        return cls(ids, points, most, offsets, centres, sizes.tolist(), np.split(parents, ends), np.split(radii, ends))

    def leaves(self, anchors: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, leaf, greatest possible score) of the leaves that may hold scores from low to high,
        an anchor's best first."""
        scores = anchors @ self.centres.T
        whole = norms[:, None] + self.most
        distance = np.sqrt(np.maximum(whole - 2 * scores, 0.0))
        slack = 1e-9 * whole + 0.25
        alive = np.ones((len(anchors), 1), bool)
        for size, parent, radius in zip(self.sizes, self.parents, self.radii, strict=True):
            near = np.maximum(distance[:, :size] - radius, 0.0)
            far = distance[:, :size] + radius
            most = (whole - near * near) / 2 + slack
            least = (whole - far * far) / 2 - slack
            alive = alive[:, parent] & (most >= low[:, None]) & (least <= high[:, None])
        anchor, leaf = np.nonzero(alive)
        bound = np.minimum(most[anchor, leaf], high[anchor])
        order = np.lexsort((-scores[anchor, leaf], -bound, anchor))
        return anchor[order], leaf[order], bound[order]


_TREE = ("ids", "points", "offsets", "centres", "sizes", "parents", "radii")
_KINDS = (np.int64, np.int32, np.int64, np.int32, np.int64, np.int64, np.float64)


class Best:
    """The best ``k`` candidates per anchor and window so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), -np.inf)
        self.ids = np.zeros((*low.shape, k), np.int64)

    def needed(self) -> np.ndarray:
        """The least score that still matters, per anchor and window."""
        return np.where(self.high >= self.low, np.maximum(self.low, self.scores[:, :, -1]), np.inf)

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        windows, needed = self.low.shape[1], self.needed()
        for w in range(windows):
            wanted = np.flatnonzero((score >= needed[anchor, w]) & (score <= self.high[anchor, w]))
            if not len(wanted):
                continue
            touched, group = np.unique(anchor[wanted], return_inverse=True)
            group = np.concatenate([np.repeat(np.arange(len(touched)), self.k), group])
            scores = np.concatenate([self.scores[touched, w].ravel(), score[wanted]])
            names = np.concatenate([self.ids[touched, w].ravel(), ids[wanted]])
            order = np.lexsort((names, -scores, group))
            rank = np.arange(len(order)) - np.searchsorted(group[order], np.arange(len(touched)))[group[order]]
            order, rank = order[rank < self.k], rank[rank < self.k]
            self.scores[touched[group[order]], w, rank] = scores[order]
            self.ids[touched[group[order]], w, rank] = names[order]


def descend(tree: CoverTree, anchors: np.ndarray, norms: np.ndarray, own: np.ndarray | None, best: Best, chosen: np.ndarray) -> None:
    """Add to ``best`` what the tree holds for the ``chosen`` anchors. In a tree of their own
    label, where ``own`` are their ids, an anchor is not its own candidate."""
    if not len(chosen):
        return
    needed, high = best.needed().min(axis=1), best.high.max(axis=1)
    anchor, leaf, bound = tree.leaves(anchors[chosen], norms[chosen], needed[chosen], high[chosen])
    anchor = chosen[anchor]
    place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    rounds = np.log2(place // FIRST_LEAVES + 1).astype(np.int64)
    point_norms = (tree.points * tree.points).sum(axis=1)
    for number in range(int(rounds.max(initial=-1)) + 1):
        now = np.flatnonzero((rounds == number) & (bound >= needed[anchor]))
        now = now[np.argsort(leaf[now], kind="stable")]
        found = []
        for part in np.split(now, np.flatnonzero(np.diff(leaf[now])) + 1):
            if not len(part):
                continue
            begin, end = tree.offsets[leaf[part[0]]], tree.offsets[leaf[part[0]] + 1]
            who = anchor[part]
            scores = tree.points[begin:end] @ anchors[who].T
            at, asked = np.nonzero((scores >= needed[who]) & (scores <= high[who]))
            found.append((who[asked], scores[at, asked], at + begin))
        if found:
            who, scores, at = (np.concatenate(parts) for parts in zip(*found, strict=True))
            if own is not None:
                other = (tree.ids[at] != own[who]) | (scores != norms[who]) | (point_norms[at] != norms[who])
                who, scores, at = who[other], scores[other], at[other]
            best.add(who, scores, tree.ids[at])
            needed = best.needed().min(axis=1)


def _distinct_points(candidates: DataFrame, most: int) -> DataFrame:
    """Rows that can matter: of equal vectors of a label only the ``most`` of smallest id, as all
    of them score alike. Spark applies the limit before the shuffle too."""
    window = Window.partitionBy("label", "hash", "vector").orderBy("id")
    rows = candidates.select("id", "label", "vector").distinct().withColumn("hash", F.xxhash64("vector"))
    return rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= most).drop("place", "hash")


def _pivots(points: DataFrame, total: int, width: int, most: float) -> np.ndarray:
    """The top net: centres of a bounded sample, more of them the more rows there are."""
    sample = points.orderBy(F.xxhash64("id"), "id", "label", "vector").limit(PIVOT_SAMPLE).select("vector").toArrow()
    full = _augmented(_matrix(sample["vector"].combine_chunks(), width), most)
    count = min(MOST_PIVOTS, -(-total // (CELL_ROWS * PIVOT_CELLS)))
    return full[_farthest_first(full, most, count)[0]]


def _largest(rows: DataFrame) -> tuple[int, int, float]:
    """Rows, components of the longest vector, largest squared norm."""
    squares = F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x.cast("bigint"))
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width"), F.max(squares).alias("most")).first()
    return facts["rows"], facts["width"] or 0, float(facts["most"] or 0)


def build_trees(points: DataFrame, total: int, width: int, most: float) -> DataFrame:
    """One row per cell: its label and its packed tree."""
    pivots = _pivots(points, total, width, most)
    placed = T.StructType([*points.schema.fields, T.StructField("pivot", T.IntegerType())])

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = _augmented(_matrix(batch.column(batch.schema.get_field_index("vector")), width), most)
            pivot = (full @ pivots.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
            columns = [*batch.columns, pa.array(pivot.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pivot"])

    dealt = cut_lineage(points.mapInArrow(blocks.tidy(nearest), placed))
    parts = F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)).cast("bigint").alias("parts")
    counts = sizing.small_side(dealt.groupBy("label", "pivot").agg(parts))
    cells = dealt.join(counts, ["label", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")))
    keys = ["label", "pivot", "part"]
    schema = T.StructType([points.schema["label"], *(T.StructField(k, T.BinaryType()) for k in _TREE)])

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy().astype(np.int64)
        tree = CoverTree.build(ids, _matrix(table["vector"].combine_chunks(), width), most)
        columns = [pa.array([key[0].as_py()], key[0].type), *(blocks.binaries([v]) for v in tree.packed().values())]
        return pa.Table.from_arrays(columns, ["label", *_TREE])

    # A number of partitions is given, as adaptive execution would merge small but laborious ones.
    spread = cells.select(*keys, "id", "vector").repartition(max(1, -(-total // CELL_ROWS)), *keys)
    return cut_lineage(spread.groupBy(*keys).applyInArrow(build, schema))


def _packed(anchors: DataFrame, width: int, windows: int, count: int) -> tuple[DataFrame, int, bool]:
    """Anchors in blocks: one row per block; the number of blocks; whether they are small."""
    number = max(1, -(-count // ANCHOR_BLOCK))
    label = anchors.schema["label"].dataType
    names = ["rows", "own", "vectors", "low", "high"]
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("labels", T.ArrayType(label)), *(T.StructField(n, T.BinaryType()) for n in names)]
    )

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        def bounds(column: str) -> np.ndarray:
            return np.array(table[column].to_pylist(), np.float64).reshape(-1, windows)

        arrays = [table["row"].to_numpy().astype(np.int64), table["id"].to_numpy().astype(np.int64)]
        arrays += [_matrix(table["vector"].combine_chunks(), width), bounds("low"), bounds("high")]
        labels = table["label"].combine_chunks()
        listed = pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), labels)
        columns = [pa.array([key[0].as_py()], pa.int64()), listed, *(blocks.binaries([a.tobytes()]) for a in arrays)]
        return pa.Table.from_arrays(columns, ["block", "labels", *names])

    blocked = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(number)))
    packed, small = sizing.settle(blocked.groupBy("block").applyInArrow(pack, schema))
    return packed, number, small


def _search(trees: DataFrame, anchors: DataFrame, count: int, width: int, most: float, windows: int, k: int, same_label: bool) -> DataFrame:
    """(row, window, id, score): the best ``k`` candidates per anchor and window, ``rank`` from 1.

    Every tree meets every block of anchors, of which it takes those of its own label or those
    of others; few blocks are broadcast, many are joined."""
    packed, number, small = _packed(anchors, width, windows, count)
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(number - 1).cast("bigint")))
    met = trees.withColumn("block", block)
    if small:
        met = met.join(F.broadcast(packed), "block")
    else:
        salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = met.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")).join(salted, ["block", "salt"]).drop("salt")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for rows, *_, best in held.values():
                anchor, window, place = np.nonzero(best.scores > -np.inf)
                columns = [rows[anchor], window.astype(np.int32), best.ids[anchor, window, place], best.scores[anchor, window, place]]
                columns[3] = columns[3].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "window", "id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] not in held:
                    rows, own = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["own"], np.int64)
                    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(rows), width)
                    low, high = (np.frombuffer(row[n], np.float64).reshape(-1, windows) for n in ("low", "high"))
                    best = Best(low, high, k)
                    held[row["block"]] = rows, own, vectors, (vectors * vectors).sum(axis=1), row["labels"], best
                    size += vectors.nbytes + 2 * best.scores.nbytes + 2 * low.nbytes
                _, own, vectors, norms, labels, best = held[row["block"]]
                wanted = np.array([(label == row["label"]) == same_label for label in labels], bool)
                wanted &= (best.high >= best.low).any(axis=1)
                descend(CoverTree.unpacked(row, most), vectors, norms, own if same_label else None, best, np.flatnonzero(wanted))
                if size > HELD_BYTES:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    found = met.mapInArrow(blocks.tidy(run), "row bigint, window int, id bigint, score bigint")
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _floor_percent(value: Column) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(100)), F.lit(100).cast("bigint"))


def mine(
    candidates: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100
) -> DataFrame:
    """Per anchor and positive the hardest negatives within a window of the positive's score.

    Both tables are (id, label, vector) of ``whole_vectors``. Scores are inner products; a
    greater one comes first, then the smaller id. The positives of an anchor are its first other
    rows of equal label; the negatives of a positive are the first rows of other labels whose
    score is from ``low_percent`` to ``high_percent`` of the positive's. All are returned where
    there are fewer. Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    Repeated rows count once; rows that share only their id are different rows. Vectors of
    different lengths are compared as if the shorter ended in zeros. An empty table gives no rows.
    """
    blocks.bounded(candidates)
    points = cut_lineage(_distinct_points(candidates, max(positives + 1, negatives)))
    asked = cut_lineage(anchors.select("id", "label", "vector").distinct().withColumn("row", F.monotonically_increasing_id()))
    (total, width, most), (count, anchor_width, _) = _largest(points), _largest(asked)
    width = max(width, anchor_width, 1)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not total or not count:
        return asked.limit(0).select(*[F.lit(None).cast("int" if n == "rank" else "bigint").alias(n) for n in names])
    trees = build_trees(points, total, width, most)
    everything = [F.array(F.lit(float(sign + "inf"))).alias(name) for sign, name in (("-", "low"), ("", "high"))]
    first = cut_lineage(_search(trees, asked.select("*", *everything), count, width, most, 1, positives, True))
    # Whole bounds: the least score not under the low percentage, the greatest not over the high one.
    low, high = -_floor_percent(-low_percent * F.col("score")), _floor_percent(high_percent * F.col("score"))
    bounds = first.select("row", F.struct("rank", low.cast("double").alias("low"), high.cast("double").alias("high")).alias("bound"))
    listed = bounds.groupBy("row").agg(F.array_sort(F.collect_list("bound")).alias("bounds"))

    def padded(field: str, value: str) -> Column:
        own = F.transform("bounds", lambda b: b[field])
        return F.concat(own, F.array_repeat(F.lit(float(value)), F.lit(positives) - F.size("bounds"))).alias(field)

    windows = listed.select("row", padded("low", "inf"), padded("high", "-inf"))
    second = _search(trees, asked.join(windows, "row"), count, width, most, positives, negatives, False)
    positive = first.select("row", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = second.join(positive, ["row", "window"]).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return chosen.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
