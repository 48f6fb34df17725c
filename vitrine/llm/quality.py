"""Quality classifier by co-training on two views of a document.

One view is the text's content (byte n-grams), the other the page's metadata:
source, language, length and layout. Each view's classifier learns from the
labelled rows and, over some rounds, from what the other one is surest of among
unlabelled documents. Both are calibrated on labelled rows kept aside, and their
calibrated log-odds are combined to score all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import sizing
from vitrine.llm import blocks
from vitrine.session import cut_lineage

#: The bounded sample of labelled documents that is fitted on, and how many unlabelled ones, the
#: surest of all, each view passes to the other per label and round.
LABELLED, TAKEN = 3000, 150
BUCKETS, SOURCES, LANGUAGES, ROWS = 4096, 32, 8, 256
ROUNDS, SURE = 5, 0.9
STEPS, RATE, DECAY = 200, 0.05, 1e-3
LAYOUT = 12
META = LAYOUT + SOURCES + LANGUAGES


def content(slab: blocks.Slab) -> np.ndarray:
    """(rows, buckets): which hashed 4-byte strings a text holds."""
    rows = slab.last - slab.first
    out = np.zeros((rows, BUCKETS), bool)
    if len(slab.data) >= 4:
        count = len(slab.data) - 3
        grams = np.ndarray(count, np.dtype("<u4"), np.ascontiguousarray(slab.data), strides=(1,)).astype(np.uint64)
        bucket = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        row = np.repeat(np.arange(rows), np.diff(slab.offsets))
        inside = row[:count] == row[3:]
        out.ravel()[(row[:count] * BUCKETS + bucket)[inside]] = True
    return out


def _kinds() -> np.ndarray:
    """Of each byte: digit, upper, lower, space, line end, full stop, other ASCII, continuation, non-ASCII."""
    kind = np.full(256, 6)
    kind[48:58], kind[65:91], kind[97:123] = 0, 1, 2
    kind[[32, 9, 11, 12, 13]], kind[10], kind[46] = 3, 4, 5
    kind[128:192], kind[192:] = 7, 8
    return kind


_KINDS = _kinds()


def metadata(slab: blocks.Slab, present: np.ndarray, source: list[str | None], lang: list[str | None]) -> np.ndarray:
    """(rows, features): layout shares and lengths, how little repeats, and source and
    language by hash."""
    rows = slab.last - slab.first
    out = np.zeros((rows, META), np.float32)
    row = np.repeat(np.arange(rows), np.diff(slab.offsets))
    counts = np.bincount(row * 9 + _KINDS[slab.data], minlength=rows * 9).reshape(rows, 9)
    chars = counts.sum(1) - counts[:, 7]
    out[:, :9] = counts / np.maximum(counts.sum(1), 1)[:, None]
    out[:, 9] = np.log1p(chars)
    out[:, 10] = np.log1p(chars / (1 + counts[:, 3] + counts[:, 4]))
    out[:, 11] = np.log((1 + present.sum(1)) / (1 + np.minimum(counts.sum(1), BUCKETS)))
    for at, names, width in ((LAYOUT, source, SOURCES), (LAYOUT + SOURCES, lang, LANGUAGES)):
        places = [_name_hash(name) % width for name in names]
        out[np.arange(rows), at + np.array(places, np.int64)] = 1
    return out


def _name_hash(name: str | None) -> int:
    out = 0
    for byte in (name or "").encode():
        out = (out * 16777619 ^ byte) & 0xFFFFFFFF
    return out >> 7


def _unit(present: np.ndarray) -> np.ndarray:
    present = present.astype(np.float32)
    return present / np.sqrt(np.maximum(present.sum(1), 1))[:, None]


class Linear(NamedTuple):
    """A logistic classifier of standardised features, with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, features: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        weights = self.weights / self.scale
        return self.slope * (features @ weights + (self.bias - self.mean @ weights)) + self.shift


class Model(NamedTuple):
    text: Linear
    meta: Linear
    mix: np.ndarray

    def scores(self, present: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the text view's, the metadata view's and the combined score."""
        one, two = self.text.odds(_unit(present)), self.meta.odds(meta)
        both = self.mix[0] * one + self.mix[1] * two + self.mix[2]
        return _sigmoid(one), _sigmoid(two), _sigmoid(both)


def _sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _descend(features: np.ndarray, wanted: np.ndarray, decay: float = DECAY, even: bool = True) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam; ``even`` lets both classes weigh the same."""
    weight = np.where(wanted > 0.5, 0.5 / max(wanted.sum(), 1), 0.5 / max((1 - wanted).sum(), 1))
    weight = weight if even else np.full(len(wanted), 1 / max(len(wanted), 1))
    features = features.astype(np.float32)
    point = np.zeros(features.shape[1] + 1, np.float32)
    mean, square = np.zeros_like(point), np.zeros_like(point)
    for step in range(1, STEPS + 1):
        error = ((_sigmoid(features @ point[:-1] + point[-1]) - wanted) * weight).astype(np.float32)
        slope = np.append(error @ features, error.sum())
        slope[:-1] += decay * point[:-1]
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope**2 - square)
        point -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return point[:-1], float(point[-1])


def _fit(features: np.ndarray, wanted: np.ndarray) -> Linear:
    mean, scale = features.mean(0), np.maximum(features.std(0), 1e-2)
    weights, bias = _descend((features - mean) / scale, wanted)
    return Linear(mean, scale, weights, bias)


def _calibrated(view: Linear, features: np.ndarray, wanted: np.ndarray) -> Linear:
    slope, shift = _descend(view.odds(features)[:, None] / 4, wanted, 1e-2, even=False)
    return view._replace(slope=float(max(slope[0], 1e-3)) / 4, shift=shift)


#: From the views fitted so far and what each was given (by key: label and features), what each
#: view is surest of among the unlabelled documents: (key, label, features of both views).
Surest = Callable[[list[Linear], list[dict]], list[list[tuple]]]


def _surest_of(pools: tuple[np.ndarray, np.ndarray], most: int) -> Surest:
    """``Surest`` for unlabelled rows at hand."""

    def surest(fitted: list[Linear], given: list[dict]) -> list[list[tuple]]:
        out = []
        for view, pool, other in zip(fitted, pools, reversed(given), strict=True):
            scores = _sigmoid(view.odds(pool)) if len(pool) else np.zeros(0)
            picked = []
            for label, sure in ((1.0, scores), (0.0, 1 - scores)):
                best = [i for i in np.argsort(-sure, kind="stable").tolist() if sure[i] >= SURE and i not in other]
                picked += [(i, label, *(p[i] for p in pools)) for i in best[:most]]
            out.append(picked)
        return out

    return surest


def co_train(views: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, pools: tuple[np.ndarray, np.ndarray] | Surest) -> Model:
    """Labelled rows as two views with their labels, and unlabelled rows as two views, or a
    function that names the surest of them."""
    order = np.arange(len(wanted))
    aside = order % 5 == 4 if all(len(set(wanted[order % 5 == k])) == 2 for k in (0, 4)) else order < 0
    base = order[~aside]
    surest = pools if callable(pools) else _surest_of(pools, max(1, len(pools[0]) // 20))
    given: list[dict] = [{}, {}]  # pseudo-labels of unlabelled documents, for each view
    for number in range(ROUNDS):
        fitted = []
        for own, taught in zip(views, given, strict=True):
            features = np.concatenate([own[base], *(f[None] for _, f in taught.values())])
            fitted.append(_fit(features, np.concatenate([wanted[base], [label for label, _ in taught.values()]])))
        if number < ROUNDS - 1:
            for k, picked in enumerate(surest(fitted, given)):
                given[1 - k].update((key, (label, features[1 - k])) for key, label, *features in picked)
    kept = order[aside] if aside.any() else order
    text, meta = (_calibrated(f, v[kept], wanted[kept]) for f, v in zip(fitted, views, strict=True))
    odds = np.stack([text.odds(views[0][kept]), meta.odds(views[1][kept])], 1)
    weights, bias = _descend(odds / 4, wanted[kept], 1e-2, even=False)
    return Model(text, meta, np.array([max(weights[0], 0) / 4, max(weights[1], 0) / 4, bias]))


def _unpacked(text: Iterable[bytes], meta: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bits = np.unpackbits(np.array([np.frombuffer(t, np.uint8) for t in text]), axis=1)
    return _unit(bits), np.array([np.frombuffer(m, np.float32) for m in meta])


def _surest_in(pool: DataFrame) -> Surest:
    """``Surest`` over a table of features (id, text, meta): every document is scored in its task,
    and the exact first ``TAKEN`` per view and label are gathered."""

    def surest(fitted: list[Linear], given: list[dict]) -> list[list[tuple]]:
        known = [set(taught) for taught in reversed(given)]
        kind = pool.schema["id"]
        schema = T.StructType([kind, *T._parse_datatype_string("view int, label double, sure double, text binary, meta binary")])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 4 * ROWS):
                    part = batch.slice(low, 4 * ROWS)
                    ids = part.column(0).to_pylist()
                    views = _unpacked(part.column(1).to_pylist(), part.column(2).to_pylist())
                    for k, (view, features) in enumerate(zip(fitted, views, strict=True)):
                        scores = np.round(_sigmoid(view.odds(features)).astype(float), 6)
                        new = np.array([i not in known[k] for i in ids], bool)
                        for label, sure in ((1.0, scores), (0.0, 1 - scores)):
                            chosen = np.flatnonzero((sure >= SURE) & new)
                            if len(chosen) > TAKEN:  # equals of the last one stay
                                chosen = chosen[sure[chosen] >= np.partition(sure[chosen], -TAKEN)[-TAKEN]]
                            rows, size = part.take(pa.array(chosen)), len(chosen)
                            columns = [rows.column(0), pa.array([k] * size, pa.int32()), pa.array([label] * size, pa.float64())]
                            columns += [pa.array(sure[chosen], pa.float64()), rows.column(1), rows.column(2)]
                            yield pa.RecordBatch.from_arrays(columns, schema.names)

        found = pool.select("id", "text", "meta").mapInArrow(blocks.tidy(run), schema)
        order = Window.partitionBy("view", "label").orderBy(F.desc("sure"), F.xxhash64("id"), "id")
        best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TAKEN).drop("place").toPandas()
        if not len(best):
            return [[], []]
        text, meta = _unpacked(best["text"], best["meta"])
        out: list[list[tuple]] = [[], []]
        for i, (key, view, label) in enumerate(zip(best["id"].tolist(), best["view"].tolist(), best["label"].tolist(), strict=True)):
            out[view].append((key, label, text[i], meta[i]))
        return out

    return surest


def _views(rows: DataFrame, scored: Model | None = None) -> DataFrame:
    """(id, text view, metadata view) as packed features, or with a model the scores."""
    kind = rows.schema["id"].dataType
    names = ["id", "text_score", "meta_score", "score"] if scored else ["id", "text", "meta"]
    plain = T.DoubleType() if scored else T.BinaryType()
    schema = T.StructType([T.StructField("id", kind)] + [T.StructField(c, plain) for c in names[1:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                for slab in blocks.slabs(part, "text"):
                    source, lang = (blocks.column(part, c, slab).to_pylist() for c in ("source", "lang"))
                    present = content(slab)
                    meta = metadata(slab, present, source, lang)
                    if scored:
                        columns = [pa.array(s.astype(float)) for s in scored.scores(present, meta)]
                    else:
                        columns = [blocks.binaries([np.packbits(p).tobytes() for p in present]), blocks.binaries([m.tobytes() for m in meta])]
                    yield pa.RecordBatch.from_arrays([blocks.column(part, "id", slab), *columns], names)

    return rows.mapInArrow(blocks.tidy(run), schema)


def _named(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    columns = {"id": id_col, "text": text_col, "source": source_col, "lang": lang_col}
    return docs.select(*(docs[f"`{c}`"].alias(name) for name, c in columns.items()))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: Column | str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> Model | None:
    """A model from about ``LABELLED`` labelled documents, chosen by id hash, and from what each
    view is surest of among all unlabelled ones, which are scored in every round. The features
    of all documents, of fixed size, are a table in the shared folder; those fitted on reach
    the driver. ``labels`` has the document's id and a label of 0 or 1 (an id with both
    counts as 0). Without rows of both labels there is no model."""
    named = _named(docs, id_col, text_col, source_col, lang_col).filter("id IS NOT NULL")
    value = F.col(label) if isinstance(label, str) else label
    known = labels.select(labels[f"`{id_col}`"].alias("id"), value.cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.min("label").cast("double").alias("label"))
    features = cut_lineage(_views(named).join(sizing.small_side(known), "id", "left"))
    labelled = features.filter("label IS NOT NULL")
    count = max(1, labelled.select("id").distinct().count())
    chosen = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(count)) < LABELLED).dropDuplicates(["id"])
    found = chosen.orderBy(F.xxhash64("id"), "id").toPandas()
    label_of = found["label"].to_numpy()
    if len(set(label_of)) < 2:
        return None
    return co_train(_unpacked(found["text"], found["meta"]), label_of, _surest_in(features.filter("label IS NULL")))


def score(
    docs: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """The quality of every document: (id, text_score, meta_score, score), each 0 to 1.

    NULL and empty texts have no content and are scored as such; a NULL source or
    language counts as an empty name. Without a model every score is 0.5. Rows come
    back one for one, NULL and repeated ids included; an empty table gives no
    rows. Other columns play no part.
    """
    named = _named(docs, id_col, text_col, source_col, lang_col)
    if model is None:
        return named.select("id", *(F.lit(0.5).alias(c) for c in ("text_score", "meta_score", "score")))
    return _views(named, model)
