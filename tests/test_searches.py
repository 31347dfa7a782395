import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nearhome.operators import decay, searches

LISTING = "id long, prix double, latitude double, longitude double, type_bien string"
SEARCH = "id long, min_prix double, max_prix double, latitude double, longitude double, radius double, type_bien string"


def distance(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def brute(listings, asked):
    found = []
    for i, low, high, lat, lon, radius, kind in asked:
        for j, price, y, x, own in listings:
            if low is not None and not (price is not None and price >= low) or high is not None and not (price is not None and price <= high):
                continue
            if kind is not None and kind != own:
                continue
            if None in (lat, lon, radius) or (None not in (y, x) and distance(lat, lon, y, x) <= radius):
                found.append((i, j))
    return sorted(found)


def test_equals_all_pairs_everywhere_on_earth(spark):
    pick = random.Random(1)
    maybe = lambda v, p=0.05: None if pick.random() < p else v
    lat = lambda: pick.choice([pick.uniform(-90, 90), pick.uniform(48, 49), 90.0, -90.0, 89.9])
    lon = lambda: pick.choice([pick.uniform(-180, 180), pick.uniform(2, 3), 180.0, -180.0, 179.99, -179.99])
    listings = [(i, maybe(pick.choice([0.0, 100.0, pick.uniform(-5, 5e5)])), maybe(lat()), maybe(lon()), maybe(pick.choice("AB"))) for i in range(500)]
    asked = []
    for i in range(300):
        low = pick.choice([0.0, 100.0, pick.uniform(0, 4e5)])
        asked.append((i, maybe(low, 0.2), maybe(low + pick.choice([0.0, 1.0, 1e5, -1.0]), 0.2), maybe(lat()), maybe(lon()), maybe(pick.choice([0.0, 0.1, 30.0, 900.0, 9000.0, 25_000.0])), maybe(pick.choice("AB"), 0.6)))
    found = searches.matched_searches(spark.createDataFrame(listings, LISTING), spark.createDataFrame(asked, SEARCH))
    assert sorted((r["search_id"], r["listing_id"]) for r in found.collect()) == brute(listings, asked)


def test_totals_of_listings_and_searches_that_come_many_times(spark, monkeypatch):
    pick = random.Random(2)
    some = lambda values: pick.choice([None, *values])
    listings = [(pick.choice([None, i, i]), some([10.0, 20.0]), some([48.0, 48.5]), some([2.0, 3.0]), some("AB")) for i in range(400)]
    asked = [(pick.choice([None, i % 60, i % 60]), some([10.0, 15.0]), some([15.0, 30.0]), some([48.0]), some([2.0]), some([0.0, 80.0, 9000.0]), some("AB")) for i in range(200)]
    right = {}
    for s in asked:
        for l in listings:
            if brute([l], [s]):
                gap = None if None in s[3:6] else distance(s[3], s[4], l[2], l[3])
                right.setdefault(s[0], []).append((l[0], gap))
    right = {i: (len(found), sum(j for j, _ in found if j is not None), [g for _, g in found if g is not None]) for i, found in right.items()}
    met, pairs = [], searches.matched_searches
    monkeypatch.setattr(searches, "matched_searches", lambda l, s, codes: met.append((l.count(), s.count())) or pairs(l, s, codes))
    found = searches.search_totals(spark.createDataFrame(listings, LISTING), spark.createDataFrame(asked, SEARCH)).collect()
    assert {r["search_id"]: (r["n_listings"], r["listings"]) for r in found} == {i: v[:2] for i, v in right.items()}
    for r in found:
        gaps = right[r["search_id"]][2]
        assert (r["nearest"], r["farthest"]) == ((pytest.approx(min(gaps)), pytest.approx(max(gaps))) if gaps else (None, None))
    assert met[0][0] <= 3 ** 4 and met[0][1] <= 3 ** 3 * 4  # the distinct ones only


def test_a_search_lies_in_few_cells_and_a_hot_place_is_divided_by_price(spark):
    rows = [(i, 10.0 * i, 10.0 * i + 10, 48.85, 2.35, 5.0, None) for i in range(3000)]
    cells = searches.search_cells(spark.createDataFrame(rows, SEARCH)).cache()
    assert cells.groupBy("id").count().agg(F.max("count")).first()[0] <= 8
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] < 20


def test_no_searches_or_listings(spark):
    one = spark.createDataFrame([(1, None, None, None, None, None, None)], SEARCH)
    listings = spark.createDataFrame([(7, None, None, None, None)], LISTING)
    assert [tuple(r) for r in searches.matched_searches(listings, one).collect()] == [(1, 7, None)]
    assert searches.matched_searches(listings.limit(0), one).count() == 0 and searches.matched_searches(listings, one.limit(0)).count() == 0


@pytest.mark.parametrize("half_life", [1, 7, 30])
def test_decayed_sums_of_any_days(spark, half_life):
    pick, start, at = random.Random(half_life), datetime(2023, 12, 1), date(2024, 4, 1)
    rows = [(pick.randrange(5), pick.randrange(4), pick.uniform(0, 5), start + timedelta(days=pick.random() * 100)) for _ in range(500)]
    schema = "user_id long, annonce_id long, interaction_score double, interaction_date timestamp"
    right = {}
    for u, a, s, t in rows:
        w = 2.0 ** (-(at - t.date()).days / half_life)
        total, weight = right.get((u, a), (0.0, 0.0))
        right[u, a] = (total + s * w, weight + w)
    cut = sorted(rows, key=lambda r: r[3])
    odd = [(1, 1, None, start), (1, 1, float("nan"), start), (1, 2, 3.0, None)]
    states = [decay.decay_state(spark.createDataFrame(part, schema), half_life) for part in (cut[:100] + odd, cut[100:130], cut[130:])]
    whole = decay.merged_decay(states[0].unionByName(states[1]).unionByName(states[2]))
    found = {(r["user_id"], r["annonce_id"]): (r["decayed"], r["interaction_score"]) for r in decay.decayed_scores(whole, at, half_life).collect()}
    assert found == {k: (pytest.approx(t, rel=1e-9), pytest.approx(t / w, rel=1e-9)) for k, (t, w) in right.items()}
