"""Typo correction of search queries against a vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import fuzzy, sizing, skew
from vitrine.functions.text import words

MIN_WORD = 3
MAX_BROADCAST_TERMS = 100_000
DIRECT_TERMS = 500
# Below this threshold two matching words need not share a character pair.
LOWEST_BLOCKED_THRESHOLD = 67


def _small_vocabulary(vocabulary: DataFrame, most: int) -> list[str] | None:
    """The distinct terms if there are no more than ``most``."""
    head = vocabulary.select("term").distinct().limit(most + 1).collect()
    return None if len(head) > most else sorted(row["term"] for row in head)


def best_matches(tokens: DataFrame, vocabulary: DataFrame, threshold: int = 75) -> DataFrame:
    """Best vocabulary term per distinct token: ``token, best``, matches only. Few terms are scored
    against all tokens; more are joined to them first."""
    terms = _small_vocabulary(vocabulary, DIRECT_TERMS)
    if terms is None:
        return joined_matches(tokens, vocabulary, threshold)
    return tokens.select("token", fuzzy.best_of(terms, int(threshold))("token").alias("best")).filter("best IS NOT NULL")


def literal_matches(tokens: DataFrame, terms: list[str], threshold: int = 75) -> DataFrame:
    """Score each token against every term of a short list, for any threshold."""
    best = fuzzy.best_term(F.col("token"), fuzzy.vocabulary_literal(terms), threshold)
    return tokens.select("token", best.alias("best")).filter(F.col("best").isNotNull())


def joined_matches(
    tokens: DataFrame, vocabulary: DataFrame, threshold: int = 75, max_broadcast: int = MAX_BROADCAST_TERMS
) -> DataFrame:
    """Matches by an equi-join, for a vocabulary of any size and any positive threshold.

    Below a threshold of 67 matching words need not share a character pair, but
    still as many single characters as their common subsequence has, so they
    are joined on characters (each with its number among its equals). A common subsequence of length L between words that are D insertions and
    deletions apart keeps at least ``L + 1 - D`` of the padded character pairs,
    which is one or more from a threshold of 67 on. So every matching pair of
    words shares a character pair, and the join on those loses none. Repeated
    character pairs of a word are joined once; their number (``extra``) is taken
    off the required count.
    """
    limit, pairs = F.lit(int(threshold)), threshold >= LOWEST_BLOCKED_THRESHOLD
    left = _paired(tokens, "token", "n", "token_extra", pairs)
    small = _small_vocabulary(vocabulary, max_broadcast)
    terms = (
        vocabulary.select("term").distinct()
        if small is None
        else tokens.sparkSession.createDataFrame([(t,) for t in small], "term string")
    )
    right = _paired(terms, "term", "m", "term_extra", pairs)
    if small is None:
        paired = skew.join(left, right, ["pair"], "inner", spread=["token"])
    else:
        paired = left.join(F.broadcast(right), "pair")
    total = F.col("n") + F.col("m")
    lowest = F.ceil(limit * total / F.lit(200))
    needed = lowest * 3 + 1 - total - F.least("token_extra", "term_extra") if pairs else lowest
    shared = (
        paired.filter(F.least("n", "m") * 200 >= limit * total)
        .groupBy("token", "term", "n", "m", "token_extra", "term_extra")
        .agg(F.count(F.lit(1)).alias("pairs"))
        .filter(F.col("pairs") >= needed)
    )
    hits = fuzzy.lcs_length("token", "term") * 200
    scored = shared.withColumn("hits", hits).filter(F.col("hits") >= limit * total)
    order = F.struct((-(F.col("hits") / total)).alias("rank"), F.col("term"))
    return scored.groupBy("token").agg(F.min(order)["term"].alias("best"))


def _paired(words_of: DataFrame, name: str, length: str, extra: str, pairs: bool) -> DataFrame:
    """A row per word and distinct character pair (or numbered character), with the
    word's length and how many of its pairs are repeats."""
    parts = fuzzy.bigrams(F.col(name)) if pairs else fuzzy.numbered_characters(F.col(name))
    sized = words_of.select(name, F.length(name).alias(length), parts.alias("_pairs"))
    repeats = (F.col(length) + 1 - F.size("_pairs")).alias(extra)
    return sized.select(name, length, repeats, F.explode("_pairs").alias("pair"))


def correct_queries(
    queries: DataFrame,
    vocabulary: DataFrame,
    threshold: int = 75,
    id_column: str = "query_id",
    text: str = "query",
    max_fix_bytes: int = sizing.MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``queries`` with ``corrected_query, was_corrected``, for whole texts.

    Words are lower-cased; words of one or two characters stay; the result is
    rejoined with single blanks even where nothing was corrected. Every
    distinct word is matched once, however often it occurs. The words to
    replace are measured: few are broadcast and applied in place, so texts are
    not shuffled; many are joined to the texts' words.
    """
    split = queries.withColumn("_words", words(F.lower(F.col(text))))
    counts = split.select(F.explode("_words").alias("token")).groupBy("token").count()
    tokens = counts.filter(F.length("token") >= MIN_WORD).select("token")
    fixes = best_matches(tokens, vocabulary, threshold).filter(F.col("best") != F.col("token"))
    fixes, small = sizing.settle(fixes, max_fix_bytes)
    if small:
        made = split.withColumn("_made", _replace_words(fixes)(F.col("_words")))
        corrected, changed = F.col("_made.corrected"), F.col("_made.changed")
    else:
        made = split.join(_rejoined(split, fixes, counts, id_column), id_column, "left")
        corrected, changed = F.col("_corrected"), F.col("_changed")
    return made.select(
        *queries.columns,
        F.coalesce(corrected, F.lit("")).alias("corrected_query"),
        F.coalesce(changed, F.lit(False)).alias("was_corrected"),
    )


def _replace_words(fixes: DataFrame):
    """Replacement of single words by a broadcast table: the distinct words of a batch are
    looked up, and lists are put together again from what they became."""
    table = fixes.select("token", "best").toArrow()
    shared = fixes.sparkSession.sparkContext.broadcast((table["token"].combine_chunks(), table["best"].combine_chunks()))

    @F.arrow_udf("corrected string, changed boolean")
    def replace(lists: pa.Array) -> pa.Array:
        tokens, best = shared.value
        coded = lists.flatten().dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=tokens)
        became = pc.coalesce(best.take(found), coded.dictionary).take(coded.indices)
        hit = pc.is_valid(found).take(coded.indices).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        corrected = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), became), " ")
        hits = np.concatenate([[0], np.cumsum(hit)])
        changed = pa.array(hits[offsets[1:]] > hits[offsets[:-1]])
        return pa.StructArray.from_arrays([corrected, changed], ["corrected", "changed"])

    return replace


def _rejoined(split: DataFrame, fixes: DataFrame, counts: DataFrame, id_column: str) -> DataFrame:
    """Texts put together again from their words and the words' replacements."""
    listed = split.select(F.col(id_column), F.posexplode("_words").alias("pos", "token"))
    fixed = skew.join(listed, fixes, ["token"], "left", spread=[id_column, "pos"], counts=counts)
    word = F.struct("pos", F.coalesce("best", "token").alias("word"))
    return fixed.groupBy(id_column).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["word"]), " ").alias("_corrected"),
        F.bool_or(F.col("best").isNotNull()).alias("_changed"),
    )


def vocabulary_from_titles(catalog: DataFrame) -> DataFrame:
    """Distinct lower-cased title words."""
    return catalog.select(F.explode(words(F.lower("title"))).alias("term")).distinct()
