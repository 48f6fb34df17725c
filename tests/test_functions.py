"""Golden values of the scalar functions."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.functions import fuzzy, jsonfields as J, numeric as N, predicates as P, signing, text as X, vectors as V
from vitrine.operators import embedding, search, typos
from vitrine.sources import seeds


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, wanted",
    [("Nike Air: Zoom | 40", "nike-air-zoom-40"), ("A & B", "a--b"), ("Camiseta Básica", "camiseta-bsica")],
)
def test_slug(spark, title, wanted):
    assert one(spark, X.slug(F.col("t")), t=title) == wanted


def test_text_functions(spark):
    assert one(spark, X.strip_html(F.col("t")), t="<p>Soft</p>") == "Soft"
    assert one(spark, X.parse_tags(F.col("t")), t="a, b,c") == ["a", "b", "c"]
    assert one(spark, X.parse_tags(F.col("t")), t="") == []
    assert one(spark, X.tenant_host(F.col("t")), t="https://x.example/admin") == "x.example"
    assert one(spark, X.words(F.col("t")), t="  a b\n c ") == ["a", "b", "c"]


@pytest.mark.parametrize("price, band", [(0.0, None), (49.99, "budget"), (50.0, "mid"), (149.99, "mid"), (150.0, "premium")])
def test_price_band(spark, price, band):
    assert one(spark, X.price_band(F.col("p")), p=price) == band


@pytest.mark.parametrize("config, asked, wanted", [("unlimited", 5, 1000), ("10", 5, 5), ("10", 50, 10), ("10", None, 10), ("10", 0, 10)])
def test_effective_limit(spark, config, asked, wanted):
    frame = spark.createDataFrame([(config, asked)], "c string, a int")
    assert frame.select(search.effective_limit(F.col("c"), F.col("a"))).first()[0] == wanted


def test_storefront_text(spark):
    frame = spark.createDataFrame([("T", "C", "V", "<b>D</b>", ["x", "y"])], "t string, c string, v string, d string, g array<string>")
    made = frame.select(X.storefront_text(*[F.col(c) for c in "tcvdg"])).first()[0]
    assert made == "T | Category: C | Brand: V | D | Tags: x, y"


def test_empty_parts_leave_no_separator(spark):
    frame = spark.createDataFrame([("T", None, "", None, None)], "t string, d string, v string, c string, g array<string>")
    c = F.col
    assert frame.select(X.flat_text(c("t"), c("d"), c("c"), c("c"), c("g"))).first()[0] == "T"
    assert frame.select(X.bilingual_text(c("t"), c("d"), c("v"), c("c"), c("c"), c("g"), F.lit(0.0))).first()[0] == "T T"
    assert frame.select(X.multilingual_text(c("t"), c("d"), F.lit(None).cast("array<struct<title:string,description:string>>"), c("v"), c("c"), c("g"))).first()[0] == "T"


def test_rounding(spark):
    assert one(spark, N.rounded_ratio(F.col("a"), F.col("b")), a=201, b=200) == 1.01
    assert one(spark, N.rounded_ratio(F.col("a"), F.col("b")), a=1, b=0) == 0.0
    assert one(spark, N.percentage(F.col("a"), F.col("b")), a=2, b=3) == 66.7


def test_vectors(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0])], "a array<float>, z array<float>")
    same, distance, zero, text = frame.select(
        V.cosine_similarity(F.col("a"), F.col("a")),
        V.cosine_distance(F.col("a"), F.col("a")),
        V.cosine_similarity(F.col("a"), F.col("z")),
        V.to_text(F.col("a")),
    ).first()
    assert same == pytest.approx(1.0) and distance == pytest.approx(0.0) and zero is None
    assert frame.select(V.from_text(F.lit(text)) == F.col("a")).first()[0]


def test_json_edits(spark):
    frame = spark.createDataFrame([('{"a":1,"b":null,"flag":true}',), (None,), ("not json",)], "d string")
    made = frame.select(
        J.set_flag("d", "flag", F.lit(False)).alias("s"), J.drop_key("d", "flag").alias("r"), J.flag("d", "flag").alias("f")
    ).collect()
    assert made[0]["f"] is True and made[1]["f"] is False and made[2]["f"] is False
    assert '"a":1' in made[0]["s"] and '"flag":false' in made[0]["s"] and '"b":null' in made[0]["s"]
    assert "flag" not in made[0]["r"]
    assert made[1]["s"] == '{"flag":false}' and made[1]["r"] == "{}"


def test_price_zero_is_a_bound(spark):
    frame = spark.createDataFrame([(0.0,), (5.0,), (None,)], "price double")
    assert frame.filter(P.price_between(high=0.0)).count() == 1
    assert P.price_between() is None


def test_tag_overlap_with_null_elements(spark):
    frame = spark.createDataFrame([(["a", None],), (["b"],), (None,)], "tags array<string>")
    assert frame.filter(P.any_tag(["b", "c"])).count() == 1
    assert frame.filter(~P.any_tag(["b", "c"])).count() == 2


@pytest.mark.parametrize("secret", ["s", "x" * 64, "long" * 40])
def test_signature_equals_hmac(spark, secret):
    body = '{"shop":"é 🏪"}'
    wanted = base64.b64encode(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest()).decode()
    assert one(spark, signing.signature(secret, F.col("b")), b=body) == wanted
    assert one(spark, signing.verdict("", F.col("b"), F.lit(wanted)), b=body) == "invalid"


# ------------------------------------------------------------------ typos

GOLDEN_TYPOS = [
    ("camiseta blanca", "camiseta blanca", False),
    ("correr deportes", "correr deporte", True),
    ("agua termica deporte", "agua termica deporte", False),
    ("comfortable running shoes", "comfortable running shoes", False),
    ("Runing  Shoos", "running shoes", True),
    ("newbalance", "new balance", True),
    ("snowbord", "snowboard", True),
    ("zapato", "zapatos", True),
    ("tablaz", "tabla", True),
    ("ad", "ad", False),
    ("café espresso", "café espresso", False),
    ("portátil para juegos", "portátil para juegos", False),
    ("regalo tecnología", "regalo tecnología", False),
    ("ropa casual", "ropa casual", False),
    ("   ", "", False),
]


def test_typos_golden(spark):
    queries = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(GOLDEN_TYPOS)], "query_id long, query string")
    vocabulary = spark.createDataFrame([(t,) for t in seeds.SEARCH_TERMS], "term string")
    made = typos.correct_queries(queries, vocabulary).orderBy("query_id").collect()
    assert [(r["corrected_query"], r["was_corrected"]) for r in made] == [(c, w) for _, c, w in GOLDEN_TYPOS]
    joined = typos.correct_queries(queries, vocabulary, max_fix_bytes=-1).orderBy("query_id").collect()
    assert joined == made


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, start=1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def brute_force(word: str, terms: list[str], threshold: int) -> str | None:
    scored = [(-200 * lcs(word, t) / (len(word) + len(t)), t) for t in terms if 200 * lcs(word, t) >= threshold * (len(word) + len(t))]
    return min(scored)[1] if scored else None


WORD = st.text(alphabet="abc", min_size=3, max_size=9)


@settings(max_examples=4, deadline=None)
@given(tokens=st.sets(WORD, min_size=5, max_size=60), terms=st.sets(st.text(alphabet="abc", min_size=1, max_size=9), min_size=3, max_size=25), threshold=st.integers(67, 95))
def test_matching_equals_brute_force(spark, tokens, terms, threshold):
    frame = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    vocabulary = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    wanted = {t: b for t in tokens if (b := brute_force(t, sorted(terms), threshold)) is not None}
    joined = {r["token"]: r["best"] for r in typos.joined_matches(frame, vocabulary, threshold).collect()}
    unbounded = {r["token"]: r["best"] for r in typos.joined_matches(frame, vocabulary, threshold, max_broadcast=0).collect()}
    literal = {r["token"]: r["best"] for r in typos.literal_matches(frame, sorted(terms), threshold).collect()}
    assert joined == wanted
    assert unbounded == wanted
    assert literal == wanted


def test_low_threshold_uses_the_literal_form(spark):
    frame = spark.createDataFrame([("abcx",)], "token string")
    vocabulary = spark.createDataFrame([("xyzabc",)], "term string")
    assert typos.best_matches(frame, vocabulary, 50).collect()[0]["best"] == "xyzabc"


def test_lcs_of_long_words(spark):
    a, b = "ab" * 80, "ba" * 75
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    assert frame.select(fuzzy.lcs_length("a", "b")).first()[0] == lcs(a, b)


def test_planned_cost():
    tokens, dollars = embedding.planned_cost(1000, 500)
    assert tokens == 125_000 and dollars == pytest.approx(0.0025)


def test_lcs_of_many_pairs_equals_the_table(spark):
    """Words of 0 to 90 characters, also beyond the basic plane, against the textbook table."""
    import random

    from vitrine.functions import fuzzy

    random.seed(5)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above, row = row, [0]
            for j, y in enumerate(b):
                row.append(max(above[j + 1], row[j], above[j] + (x == y)))
        return row[-1]

    letters = "abcdé東𝄞"
    sizes = [0, 1, 3, 8, 9, 15, 16, 17, 31, 63, 64, 65, 90]
    pairs = [("".join(random.choices(letters, k=random.choice(sizes))), "".join(random.choices(letters, k=random.choice(sizes)))) for _ in range(600)]
    frame = spark.createDataFrame(pairs, "a string, b string").repartition(3)
    for a, b, found in frame.select("a", "b", fuzzy.lcs_length("a", "b").alias("n")).collect():
        assert found == table(a, b), (a, b)


@pytest.mark.parametrize("threshold", [1, 40, 75, 100])
def test_scored_terms_equal_the_joined_ones(spark, threshold):
    """Few terms against all words, side by side, and through the join; long words included."""
    import random

    from vitrine.operators import typos

    random.seed(threshold)
    letters = "abcdé東"
    words = {"".join(random.choices(letters, k=random.choice([3, 4, 6, 9, 17, 40, 64, 65, 80]))) for _ in range(300)}
    terms = {"".join(random.choices(letters, k=random.choice([1, 3, 5, 8, 20, 70]))) for _ in range(25)} | set(list(words)[:5])
    tokens = spark.createDataFrame([(w,) for w in words], "token string").repartition(3)
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term string")
    direct = {tuple(r) for r in typos.best_matches(tokens, vocabulary, threshold).collect()}
    assert direct == {tuple(r) for r in typos.joined_matches(tokens, vocabulary, threshold).collect()}
    assert typos.best_matches(tokens, vocabulary.limit(0), threshold).count() == 0
