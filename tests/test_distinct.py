"""Mergeable distinct counts, numbering, digest comparison and usage lookups against plain Python."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vitrine.operators import diff, distinct, metering
from vitrine.operators.search import ranked_within

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "a", "b"]), rnd.choice([f"q{i}" for i in range(60)] + [None]), START + timedelta(hours=rnd.randrange(24 * 20))) for _ in range(3000)]
    rows.append(("late", "q1", START + timedelta(days=15)))
    return rows, spark.createDataFrame(rows, "shop string, query string, at timestamp_ntz").repartition(5)


def expected(rows, days):
    last = max(at.date() for _, _, at in rows)
    seen = {}
    for shop, query, at in rows:
        if query is not None:
            for ahead in range(days):
                day = at.date() + timedelta(days=ahead)
                if day <= last:
                    seen.setdefault((shop, day), set()).add(query)
    return {(shop, day, len(found)) for (shop, day), found in seen.items()}


@pytest.mark.parametrize("days", [1, 7])
def test_bitmaps_count_trailing_windows(events, days):
    rows, frame = events
    state = distinct.daily_bitmaps(frame, "query", distinct.numbered(frame, "query"), "at", "shop")
    assert {tuple(r) for r in distinct.trailing_distinct(state, days, "shop").collect()} == expected(rows, days)


def test_numbers_are_dense_and_kept(spark, events):
    _, frame = events
    early = distinct.numbered(frame.filter("at < '2024-01-02'"), "query").collect()
    known = {r["value"]: r["number"] for r in early}
    assert sorted(known.values()) == list(range(len(known)))
    table = spark.createDataFrame(early, "value string, number bigint")
    later = {r["value"]: r["number"] for r in distinct.numbered(frame, "query", table).collect()}
    assert sorted(later.values()) == list(range(60)) and known.items() <= later.items()


def test_sketches_stay_within_their_error(spark):
    frame = spark.range(200_000).selectExpr("cast(id % 50000 as string) AS v", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(id % 5) AS at")
    state = distinct.daily_sketches(frame, "v", "at")
    for r in distinct.trailing_estimate(state, 5).collect():
        exact = 10_000 * ((r["date"] - date(2024, 1, 1)).days + 1)
        assert abs(r["distinct_values"] - exact) <= 4 * 1.04 / 64 * exact


def test_ranks_within_groups_with_nulls(spark):
    rows = [(g, i, (i * 7) % 11) for g in (None, "a", "b") for i in range(150)]
    frame = spark.createDataFrame(rows, "g string, i int, v int").repartition(4)
    found = {(r["g"], r["i"]): r["n"] for r in ranked_within(frame, ["g"], [F.col("v"), F.col("i")], "n").collect()}
    for g in (None, "a", "b"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        assert [found[g, i] for _, i, _ in order] == list(range(1, 151))


SNAPSHOT = "shop_domain string, product_id string, title string, description string, price double, ordinal long"


def test_digests_find_the_changed_rows(spark, monkeypatch):
    monkeypatch.setattr(diff, "UPPER_BUCKETS", 16)
    monkeypatch.setattr(diff, "LOWER_BUCKETS", 8)
    stored = [("s" if i % 3 else "t", f"p{i}", f"t{i}", None if i % 50 == 7 else "d", None if i % 40 == 3 else float(i), i) for i in range(600)]
    changed = [(*r[:2], "x", *r[3:]) if i == 5 else (*r[:4], r[4] + 1, r[5]) if i == 100 else r for i, r in enumerate(stored)]
    changed = [r for r in changed if r[1] != "p9"] + [("t", "new", "n", "d", 1.0, 999), (*changed[20][:2], "again", *changed[20][3:5], 1000), changed[30]]
    old = spark.createDataFrame(stored, SNAPSHOT).repartition(3)
    new = spark.createDataFrame(changed, SNAPSHOT).repartition(4)
    columns = ["shop_domain", "product_id", "ordinal", "title_changed", "description_changed", "price_changed", "needs_update", "change_class"]
    rows = lambda frame: sorted(tuple(r) for r in frame.select(*columns).collect())
    assert rows(diff.compare_by_digest(new, old)) == rows(diff.compare(new, old))
    assert {r[-1] for r in rows(diff.compare_by_digest(new, old))} == {"new", "updated", "unchanged"}


def test_an_unchanged_snapshot_compares_no_rows(spark, monkeypatch):
    rows = [("s", f"p{i}", f"t{i}", "d", float(i), i) for i in range(500)]
    old, new = (spark.createDataFrame(r, SNAPSHOT).repartition(3) for r in (rows, rows[::-1]))
    compared = []
    real = diff.compare
    monkeypatch.setattr(diff, "compare", lambda a, b: compared.append((a.count(), b.count())) or real(a, b))
    assert diff.compare_by_digest(new, old).filter("change_class = 'unchanged'").count() == 500
    assert compared == [(0, 0)]


def test_usage_since_reset(spark):
    rnd = random.Random(4)
    tenants = [(f"s{i}", date(2024, 1, 1) + timedelta(days=rnd.randrange(30))) for i in range(20)] + [("none", date(2024, 1, 5))]
    usage = [(f"s{rnd.randrange(18)}", rnd.choice(["search", "sync"]), date(2023, 12, 20) + timedelta(days=rnd.randrange(45)), rnd.randrange(9)) for _ in range(900)]
    subs = spark.createDataFrame(tenants, "shop_domain string, search_reset_date date")
    table = spark.createDataFrame(usage, "shop_domain string, usage_type string, usage_date date, usage_count long").repartition(4)
    wanted = {(s, sum(n for shop, kind, day, n in usage if shop == s and kind == "search" and day >= reset)) for s, reset in tenants}
    assert {tuple(r) for r in metering.usage_since_reset(subs, table).collect()} == wanted
    assert metering.usage_since_reset(subs.limit(0), table).count() == 0
