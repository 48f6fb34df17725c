"""Language identification with a string kernel and Nyström ridge regression.

A text is the set of its character n-grams (one to three, hashed to buckets);
the kernel of two texts is the size of the sets' intersection over the root of
their sizes' product. Ridge regression, one language against the rest, uses the
kernel with a few landmark texts, so scoring is a product of batch matrices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import sizing
from vitrine.llm import blocks, bpe
from vitrine.session import cut_lineage

#: The bounded sample that the model learns from: texts and landmarks per language, and of all
#: languages together (but at least one text and landmark of each language).
SAMPLE_TEXTS, LANDMARKS = 300, 40
ALL_TEXTS, ALL_LANDMARKS = 20_000, 2_600
BUCKETS = 1 << 15
RIDGE = 1e-3
ROWS = 128
UNKNOWN = "und"


class Grams:
    """Presence of n-grams in the texts of a slab, letters in lower case."""

    def __init__(self, classes: bytes) -> None:
        codes = np.arange(0x110000, dtype=np.uint32)
        self.letter = np.frombuffer(zlib.decompress(classes), np.uint8) == 0
        self.plain = np.where(self.letter, codes, 32)
        for code in np.flatnonzero(self.letter[:0x2000]).tolist():
            low = chr(code).lower()
            if len(low) == 1:
                self.plain[code] = ord(low)

    def presence(self, slab: blocks.Slab) -> tuple[np.ndarray, np.ndarray]:
        """(rows, buckets) of booleans, and whether each row has a letter."""
        rows = slab.last - slab.first
        out, has_letter = np.zeros((rows, BUCKETS), bool), np.zeros(rows, bool)
        data = slab.data
        if not len(data):
            return out, has_letter
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        row = np.searchsorted(slab.offsets, chars, "right") - 1
        letter = self.letter[codes]
        has_letter[row[letter]] = True
        plain = self.plain[codes].astype(np.uint64)
        hashes, flat, base = np.zeros(len(plain), np.uint64), out.ravel(), row * BUCKETS
        for size in (1, 2, 3):
            count = len(plain) - size + 1
            if count < 1:
                break
            hashes = hashes[:count] * np.uint64(0x100000001B3) + plain[size - 1 :] + np.uint64(size)
            used = letter[:count] | letter[size - 1 :]
            used &= row[:count] == row[size - 1 :]
            bucket = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
            flat[(base[:count] + bucket.astype(np.int64))[used]] = True
        return out, has_letter


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def margins(self, present: np.ndarray) -> np.ndarray:
        return _kernel(present, self.landmarks) @ self.weights


def _kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    left, right = left.astype(np.float32), right.astype(np.float32)
    sizes = np.sqrt(np.maximum(left.sum(1), 1)[:, None] * np.maximum(right.sum(1), 1)[None, :])
    return (left @ right.T) / sizes


def _fit(languages: list[str], present: np.ndarray, language: np.ndarray) -> Model:
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    first = [np.flatnonzero(language == i)[:each] for i in range(len(languages))]
    landmarks = present[np.concatenate(first)]
    kernel = _kernel(present, landmarks).astype(np.float64)
    inner = _kernel(landmarks, landmarks).astype(np.float64)
    wanted = np.where(language[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(language, minlength=len(languages))[language][:, None]
    system = kernel.T @ (kernel * weight) + RIDGE * inner + 1e-8 * np.eye(len(inner))
    return Model(languages, landmarks, np.linalg.solve(system, kernel.T @ (wanted * weight)).astype(np.float32))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model | None:
    """A model of every language from ``SAMPLE_TEXTS`` texts of each, chosen by id hash
    (all texts of a language that has no more; fewer of each where languages are many, so that
    ``ALL_TEXTS`` are taken); their n-gram sets, of fixed size, reach the driver. Rows
    without an id, language or letter are left out; without any other row there is no model."""
    named = docs.select(
        docs[f"`{id_col}`"].alias("id"), docs[f"`{lang_col}`"].alias("lang"), docs[f"`{text_col}`"].alias("text")
    ).filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = cut_lineage(named.groupBy("lang").count())
    known = counts.count()
    if not known:
        return None
    # A share of a language's rows that surely holds enough; only these few meet per language.
    each = max(1, min(SAMPLE_TEXTS, ALL_TEXTS // known))
    some = named.join(sizing.small_side(counts), "lang").filter(F.pmod(F.xxhash64("id"), F.col("count")) < 2 * each + 20)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    texts = some.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)
    classes = bpe.character_classes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(classes)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                for slab in blocks.slabs(part, "text"):
                    present, letters = grams.presence(slab)
                    packed = [np.packbits(p).tobytes() if has else None for p, has in zip(present, letters, strict=True)]
                    ids, langs = (blocks.column(part, c, slab) for c in ("id", "lang"))
                    yield pa.RecordBatch.from_arrays([ids, langs, pa.array(packed, pa.binary())], ["id", "lang", "grams"])

    schema = T.StructType([texts.schema["id"], T.StructField("lang", T.StringType()), T.StructField("grams", T.BinaryType())])
    rows = texts.select("id", "lang", "text").mapInArrow(blocks.tidy(run), schema).filter("grams IS NOT NULL").dropDuplicates(["id", "lang"])
    found = rows.orderBy(F.xxhash64("id"), "id", "lang", "grams").toPandas()
    languages = sorted(set(found["lang"]))
    if not languages:
        return None
    present = np.unpackbits(np.array([np.frombuffer(g, np.uint8) for g in found["grams"]]), axis=1).astype(bool)
    number = {name: i for i, name in enumerate(languages)}
    return _fit(languages, present, found["lang"].map(number).to_numpy())


def _scored(rows: DataFrame, model: Model | None, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` with ``lang_pred`` and ``score`` for the column ``text``."""
    classes = bpe.character_classes()
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(classes)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                for slab in blocks.slabs(part, text):
                    rows = slab.last - slab.first
                    names, scores = [UNKNOWN] * rows, np.zeros(rows)
                    if model is not None:
                        present, letters = grams.presence(slab)
                        margins = model.margins(present)
                        best = margins.argmax(1)
                        scores = np.where(letters, np.clip((margins.max(1) + 1) / 2, 0, 1), 0).astype(float)
                        names = [model.languages[b] if has else UNKNOWN for b, has in zip(best, letters, strict=True)]
                    own = [blocks.column(part, c, slab) for c in keep]
                    columns = [*own, pa.array(names, pa.string()), pa.array(scores)]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    return rows.mapInArrow(blocks.tidy(run), T.StructType([*(rows.schema[c] for c in keep), *added]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: (id, lang_pred, score).

    ``und`` with score 0 if the text is NULL, empty or without letters, or if
    there is no model. Otherwise the language of the largest margin, the first
    by name among equals, with the margin moved to 0..1. Rows come back one for
    one, NULL and repeated ids included; an empty table gives no rows. Only the
    text is used.
    """
    named = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    return _scored(named, model, "text", ["id"])


def in_a_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language, with all their columns; those that
    ``predict`` calls ``und`` go. Without a model nothing is rejected."""
    if model is None:
        return docs
    plain = {f"column_{i}": c for i, c in enumerate(docs.columns)}  # no name clashes with those added
    named = docs.toDF(*plain)
    text = f"column_{docs.columns.index(text_col)}"
    found = _scored(named, model, text, named.columns).filter(F.col("lang_pred") != UNKNOWN)
    return found.select(*(F.col(own).alias(name) for own, name in plain.items()))


def held_out(id_col: Column | str) -> Column:
    """A fixed third of the ids, by the checksum of their text form."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))
