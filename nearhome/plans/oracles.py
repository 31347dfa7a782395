"""The same questions in plain SQL, for checking the registered queries with another engine."""

from __future__ import annotations

from nearhome import schemas
from nearhome.operators import synth

LISTING = """
    SELECT p_partkey AS id, p_name AS titre, p_retailprice AS prix, p_type AS type_bien, p_brand AS lease_duration,
           ((p_partkey * 7919) % 18000) / 100.0 - 90 AS latitude,
           ((p_partkey * 104729) % 36000) / 100.0 - 180 AS longitude
    FROM part"""

LISTING_DIRTY = f"""
    SELECT id, titre, CASE WHEN id % 17 <> 0 THEN prix END AS prix, CASE WHEN id % 23 <> 0 THEN type_bien END AS type_bien,
           lease_duration, CASE WHEN id % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE latitude END AS latitude, longitude
    FROM ({LISTING})"""

LISTING_CLEAN = f"""
    SELECT id, prix, type_bien, lease_duration, latitude, longitude FROM ({LISTING_DIRTY})
    WHERE prix IS NOT NULL AND type_bien IS NOT NULL AND lease_duration IS NOT NULL
      AND latitude IS NOT NULL AND NOT isnan(latitude) AND longitude IS NOT NULL AND NOT isnan(longitude)"""

INTERACTION = """
    SELECT event_id AS id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS annonce_id,
           CAST(value AS FLOAT) AS interaction_score, event_type AS interaction_type
    FROM events"""

INTERACTION_DIRTY = f"""
    SELECT id, CASE WHEN id % 97 = 0 THEN -1 ELSE user_id END AS user_id, annonce_id,
           CASE WHEN id % 89 <> 0 THEN interaction_score END AS interaction_score,
           CASE WHEN id % 83 = 0 THEN 'BAD' ELSE interaction_type END AS interaction_type
    FROM ({INTERACTION})"""

PURCHASE = """
    SELECT o_custkey AS user_id, l_partkey AS annonce_id, CAST(l_quantity AS FLOAT) AS interaction_score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _rating(interactions: str, score: str = "interaction_score") -> str:
    """Means of exactly added scores: as whole multiples of 2**-70, in 128-bit integers."""
    return f"""
    SELECT user_id, annonce_id,
           CAST(sum(CAST(CAST({score} AS DOUBLE) * 1180591620717411303424 AS HUGEINT)) AS DOUBLE) / 1180591620717411303424 / nullif(count({score}), 0)
               AS interaction_score
    FROM ({interactions}) GROUP BY user_id, annonce_id"""


def _price_pairs(cluster: str, listings: str = LISTING) -> str:
    return f"""
    SELECT a.id, a.{cluster} AS cluster, b.id AS similar_id,
           CAST(row_number() OVER (PARTITION BY a.id ORDER BY b.prix, b.id) AS INTEGER) AS rank
    FROM ({listings}) a JOIN ({listings}) b ON a.{cluster} = b.{cluster} AND a.id <> b.id
    QUALIFY rank <= 10"""


def _targets(pairs: str, rating: str, n: int) -> str:
    return f"""
    SELECT announce_id, user_id, score,
           CAST(row_number() OVER (PARTITION BY announce_id ORDER BY score DESC, user_id) AS INTEGER) AS rank
    FROM (SELECT p.id AS announce_id, r.user_id, max(r.interaction_score) AS score
          FROM ({pairs}) p JOIN ({rating}) r ON r.annonce_id = p.similar_id
          WHERE r.user_id IN (SELECT c_custkey FROM customer) AND r.interaction_score IS NOT NULL
          GROUP BY p.id, r.user_id)
    QUALIFY rank <= {n}"""


def _cosine_pairs(same_group: str) -> str:
    return f"""
    WITH long AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    unit AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM long)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY gap, similar_id) AS INTEGER) AS rank, similar_id, similarity
    FROM (SELECT a.vec_id AS id, b.vec_id AS similar_id, list_distance(a.u, b.u) AS gap, round(list_cosine_similarity(a.v, b.v), 9) AS similarity
          FROM unit a JOIN unit b ON a.vec_id <> b.vec_id {same_group})
    QUALIFY rank <= 10"""


def _category(column: str) -> str:
    return f"""
    SELECT '{column}' AS column_name, {column} AS value,
           CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS INTEGER) AS idx, count(*) AS n
    FROM ({LISTING}) GROUP BY {column}"""


def _listing_cosine(same_group: str, price: str = "prix") -> str:
    """Cosine of (price, one-hot type without its least frequent value, latitude, longitude), by the difference of unit vectors."""
    return f"""
    WITH idx AS (SELECT value, idx, max(idx) OVER () AS dropped FROM ({_category('type_bien')})),
    f AS (SELECT id, {price} AS prix, latitude, longitude, lease_duration, idx, CASE WHEN idx < dropped THEN 1.0 ELSE 0.0 END AS hot
          FROM ({LISTING}) JOIN idx ON type_bien = value),
    n AS (SELECT *, sqrt(prix * prix + latitude * latitude + longitude * longitude + hot) AS norm FROM f)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY gap, similar_id) AS INTEGER) AS rank, similar_id, similarity
    FROM (SELECT a.id, b.id AS similar_id,
                 (a.prix / a.norm - b.prix / b.norm) ** 2 + (a.latitude / a.norm - b.latitude / b.norm) ** 2
                 + (a.longitude / a.norm - b.longitude / b.norm) ** 2
                 + CASE WHEN a.idx = b.idx THEN (a.hot / a.norm - b.hot / b.norm) ** 2
                        ELSE (a.hot / a.norm) ** 2 + (b.hot / b.norm) ** 2 END AS gap,
                 round((a.prix * b.prix + a.latitude * b.latitude + a.longitude * b.longitude
                        + CASE WHEN a.idx = b.idx THEN a.hot ELSE 0.0 END) / (a.norm * b.norm), 9) AS similarity
          FROM n a JOIN n b ON a.id <> b.id {same_group})
    QUALIFY rank <= 10"""


def _lists(pairs: str) -> str:
    """One row per listing, also for one without neighbours."""
    return f"""
    SELECT l.id, l.lease_duration AS cluster, coalesce(string_agg(CAST(similar_id AS VARCHAR), ',' ORDER BY rank), '') AS ids
    FROM ({LISTING}) l LEFT JOIN ({pairs}) p ON l.id = p.id GROUP BY l.id, l.lease_duration"""


def _mixed(key: str, salt: int) -> str:
    return f"(((({key} + {salt * synth.STEP + 1}) * {synth.MULTIPLIER}) % {synth.MODULUS}) * {synth.MULTIPLIER} % {synth.MODULUS})"


def _pick(values: list[str], key: str, salt: int) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{_mixed(key, salt)} % {len(values)} + 1]"


def _between(key: str, salt: int, low: int, high: int) -> str:
    return f"({_mixed(key, salt)} % {high - low + 1} + {low})"


OWNED = f"""
    SELECT c_custkey * 3 + slot AS id, c_custkey AS user_id
    FROM (SELECT c_custkey, unnest(range({_between('c_custkey', 3, 1, 3)})) AS slot FROM customer)"""

BRAND_PAIRS = _price_pairs("lease_duration")
TYPE_PAIRS = _price_pairs("type_bien")
RATING = _rating(INTERACTION)
RATED_USERS = f"SELECT DISTINCT user_id FROM ({INTERACTION}) WHERE user_id IN (SELECT c_custkey FROM customer)"
RATED_LISTINGS = f"SELECT DISTINCT annonce_id FROM ({INTERACTION}) WHERE user_id IN (SELECT c_custkey FROM customer)"
WEIGHT = "CASE interaction_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 3.0 WHEN 'purchase' THEN 5.0 ELSE 0.0 END"
DECLARED = """CASE interaction_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 3.0 WHEN 'purchase' THEN 5.0
    WHEN 'signup' THEN interaction_score ELSE 0.0 END"""

_BAD_TYPE = "interaction_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')"

SQL: dict[str, str] = {
    "listing_clean": LISTING_CLEAN,
    "category_cardinality": f"""
    SELECT column_name, n_values, n_values >= 2 AS in_model
    FROM (SELECT 'type_bien' AS column_name, count(DISTINCT p_type) AS n_values FROM part
          UNION ALL SELECT 'lease_duration', count(DISTINCT p_brand) FROM part)""",
    "rating_avg": RATING,
    "rating_incremental": RATING,
    "rating_weighted": _rating(INTERACTION, WEIGHT),
    "rating_declared": _rating(INTERACTION, DECLARED),
    "rating_purchases": _rating(PURCHASE),
    "message_ids": f"SELECT id, annonce_id FROM ({INTERACTION})",
    "rating_rejects": f"""
    SELECT count(*) AS n_ratings,
           count(*) FILTER (WHERE user_id NOT BETWEEN -2147483648 AND 2147483647) AS user_out_of_range,
           count(*) FILTER (WHERE annonce_id NOT BETWEEN -2147483648 AND 2147483647) AS listing_out_of_range,
           count(*) FILTER (WHERE interaction_score IS NULL) AS no_score
    FROM ({INTERACTION_DIRTY})""",
    "category_index": f"SELECT * FROM ({_category('type_bien')}) UNION ALL SELECT * FROM ({_category('lease_duration')})",
    "feature_vectors": f"""
    WITH t AS ({_category('type_bien')}), d AS ({_category('lease_duration')}),
    raw AS (SELECT id, list_concat([prix, latitude, longitude],
                   list_concat(list_transform(range((SELECT count(*) FROM t) - 1), lambda i: CASE WHEN i = t.idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
                               list_transform(range((SELECT count(*) FROM d) - 1), lambda i: CASE WHEN i = d.idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS v
            FROM ({LISTING}) l JOIN t ON l.type_bien = t.value JOIN d ON l.lease_duration = d.value),
    flat AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm, unnest(range(len(v))) AS pos FROM raw)
    SELECT id, CAST(pos AS INTEGER) AS pos, round(v[pos + 1] / norm, 9) AS value FROM flat""",
    "kmeans_cluster_summary": "SELECT count(*) AS n_listings, true AS clusters_ok, CAST(0 AS BIGINT) AS misplaced FROM part",
    "kmeans_neighbors_summary": """
    SELECT count(*) AS n_listings, CAST(0 AS BIGINT) AS wrong_length, CAST(0 AS BIGINT) AS other_cluster,
           CAST(0 AS BIGINT) AS self_pairs, CAST(0 AS BIGINT) AS out_of_order FROM part""",
    "cluster_neighbors_price": f"SELECT id, rank, similar_id FROM ({BRAND_PAIRS})",
    "type_neighbors_price": f"SELECT id, rank, similar_id FROM ({TYPE_PAIRS})",
    "heads_incremental": f"""
    SELECT cluster, string_agg(CAST(id AS VARCHAR), ',' ORDER BY prix, id) AS head
    FROM (SELECT type_bien AS cluster, id, prix FROM ({LISTING}) WHERE id NOT IN (SELECT annonce_id FROM ({PURCHASE}) WHERE interaction_score >= 49)
          QUALIFY row_number() OVER (PARTITION BY type_bien ORDER BY prix, id) <= 11)
    GROUP BY cluster""",
    "rating_decayed": f"""
    SELECT user_id, annonce_id, round(sum(score * share), 10) AS decayed, round(sum(score * share) / sum(share), 7) AS interaction_score
    FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS annonce_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS score,
                 2.0::DOUBLE ** (-date_diff('day', CAST(ts AS DATE), DATE '2024-03-01') / 7.0::DOUBLE) AS share
          FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)
    GROUP BY user_id, annonce_id""",
    "search_matches": f"""
    WITH s AS (
        SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN low END AS min_prix, CASE WHEN c_custkey % 13 <> 0 THEN low + c_custkey % 200 END AS max_prix,
               CASE WHEN c_custkey % 3 = 0 THEN 48.85::DOUBLE + (c_custkey % 7) / 100.0::DOUBLE ELSE ((c_custkey * 7919) % 18000) / 100.0::DOUBLE - 90 END AS latitude,
               CASE WHEN c_custkey % 3 = 0 THEN 2.35::DOUBLE + (c_custkey % 5) / 100.0::DOUBLE ELSE ((c_custkey * 104729) % 36000) / 100.0::DOUBLE - 180 END AS longitude,
               CASE WHEN c_custkey % 29 <> 0 THEN 50.0::DOUBLE + c_custkey % 1500 END AS radius,
               CASE WHEN c_custkey % 4 = 0 THEN p_type END AS type_bien
        FROM (SELECT c_custkey, 900.0::DOUBLE + (c_custkey * 13) % 1000 AS low, (c_custkey * 31) % (SELECT count(*) FROM part) AS p FROM customer) JOIN part ON p_partkey = p
    ), d AS (
        SELECT s.id AS search_id, l.id AS listing_id, radius, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
                   sin(radians(l.latitude - s.latitude) / 2) ** 2 + cos(radians(s.latitude)) * cos(radians(l.latitude)) * sin(radians(l.longitude - s.longitude) / 2) ** 2))) AS distance
        FROM s JOIN ({LISTING}) l ON (min_prix IS NULL OR l.prix >= min_prix) AND (max_prix IS NULL OR l.prix <= max_prix) AND (s.type_bien IS NULL OR s.type_bien = l.type_bien)
    )
    SELECT search_id, count(*) AS n_listings, CAST(sum(listing_id) AS BIGINT) AS listings,
           round(min(CASE WHEN radius IS NOT NULL THEN distance END), 6) AS nearest, round(max(CASE WHEN radius IS NOT NULL THEN distance END), 6) AS farthest
    FROM d WHERE radius IS NULL OR distance <= radius GROUP BY search_id""",
    "vector_functions": """
    SELECT a.vec_id AS id, round(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 9) AS norm,
           round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
    FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "cluster_neighbors_cosine": _cosine_pairs("AND a.label = b.label"),
    "cosine_topk": _cosine_pairs(""),
    "cosine_incremental": _cosine_pairs(""),
    "cosine_approx": "SELECT count(*) * least(10, count(*) - 1) AS n_exact, true AS recall_ok, CAST(0 AS BIGINT) AS wrong FROM embeddings",
    "cosine_topk_avg": f"""
    SELECT e.vec_id AS id, CAST(count(p.similar_id) AS INTEGER) AS n_similar, round(coalesce(avg(p.similarity), 0.0), 10) AS similarity
    FROM embeddings e LEFT JOIN ({_cosine_pairs('')}) p ON p.id = e.vec_id GROUP BY e.vec_id""",
    "listing_cosine_topk": _listing_cosine(""),
    "listing_cosine_real_prices": _listing_cosine("", "(prix - 900) * 260 + 10000"),
    "listing_cluster_cosine": _listing_cosine("AND a.lease_duration = b.lease_duration"),
    "similar_messages": f"""
    SELECT '{{"announceId":' || id || ',"similarIds":[' || ids || '],"clusterId":"' || cluster || '"}}' AS value
    FROM ({_lists(BRAND_PAIRS)})""",
    "similar_json_roundtrip": f"SELECT id, cluster, rank - 1 AS pos, similar_id FROM ({BRAND_PAIRS})",
    "similar_csv": f"SELECT id AS \"announceId\", ids AS \"similarsIds\" FROM ({_lists(BRAND_PAIRS)})",
    "similar_pairs": f"SELECT id AS announce_id, similar_id FROM ({BRAND_PAIRS})",
    "similar_latest": f"SELECT id, cluster, 2 AS version, ids AS similar_ids FROM ({_lists(BRAND_PAIRS)})",
    "queue_drain": f"""
    SELECT id AS announce_id, ids AS similar_ids FROM ({_lists(BRAND_PAIRS)})
    WHERE id NOT IN (SELECT annonce_id FROM ({INTERACTION}))""",
    "queue_concurrent": f"""
    SELECT id AS announce_id, ids AS similar_ids, CAST(2 AS BIGINT) AS version FROM ({_lists(TYPE_PAIRS)})
    WHERE id IN (SELECT annonce_id FROM ({INTERACTION}))""",
    "queue_restart": f"""
    SELECT id AS announce_id, ids AS similar_ids, CAST(2 AS BIGINT) AS epoch FROM ({_lists(TYPE_PAIRS)})
    WHERE id IN (SELECT annonce_id FROM ({INTERACTION}))""",
    "stream_latest": f"SELECT id, cluster, ids AS similar_ids, true AS changes_only FROM ({_lists(BRAND_PAIRS)})",
    "stream_similar": f"SELECT id, cluster AS cluster_id, rank - 1 AS pos, similar_id FROM ({BRAND_PAIRS})",
    "stream_similar_events": f"""
    SELECT id, cluster AS cluster_id, rank - 1 AS pos, similar_id FROM ({TYPE_PAIRS})
    WHERE id IN (SELECT annonce_id FROM ({INTERACTION}))""",
    "stream_kmeans_summary": f"""
    SELECT count(*) AS n_results, CAST(0 AS BIGINT) AS other_cluster, CAST(0 AS BIGINT) AS wrong_length, CAST(0 AS BIGINT) AS self_pairs
    FROM ({LISTING_CLEAN})""",
    "stream_cosine": f"""
    SELECT e.vec_id AS id, coalesce(string_agg(CAST(similar_id AS VARCHAR), ',' ORDER BY rank), '') AS similar_ids,
           round(coalesce(avg(p.similarity), 0.0), 10) AS similarity
    FROM embeddings e LEFT JOIN ({_cosine_pairs('')}) p ON p.id = e.vec_id GROUP BY e.vec_id""",
    "target_users_observed": _targets(TYPE_PAIRS, RATING, 1000),
    "target_users_top10": _targets(TYPE_PAIRS, RATING, 10),
    "target_users_purchases": _targets(BRAND_PAIRS, _rating(PURCHASE), 1000),
    "hybrid_notify": f"""
    SELECT t.announce_id, t.user_id FROM ({_targets(_price_pairs('lease_duration', LISTING_CLEAN), _rating(PURCHASE), 1000)}) t
    ANTI JOIN ({PURCHASE}) s ON s.annonce_id = t.announce_id AND s.user_id = t.user_id""",
    "notify_unsent": f"""
    SELECT t.announce_id, t.user_id FROM ({_targets(TYPE_PAIRS, RATING, 1000)}) t
    ANTI JOIN ({INTERACTION}) s ON s.annonce_id = t.announce_id AND s.user_id = t.user_id""",
    "als_user_recs_summary": f"""
    WITH n AS (SELECT least(100, count(*)) AS n FROM ({RATED_LISTINGS}))
    SELECT user_id, n AS n_recs, 1 AS first_rank, CAST(n AS INTEGER) AS last_rank, n AS n_listings, CAST(0 AS BIGINT) AS out_of_order
    FROM ({RATED_USERS}) JOIN n ON true""",
    "als_topn_exact": f"""
    WITH n AS (SELECT least(100, count(DISTINCT annonce_id)) AS n FROM ({PURCHASE}) WHERE user_id IN (SELECT c_custkey FROM customer))
    SELECT DISTINCT user_id, n AS n_recs, n AS n_listings, CAST(0 AS BIGINT) AS n_off
    FROM ({PURCHASE}) JOIN n ON true WHERE user_id IN (SELECT c_custkey FROM customer)""",
    "als_solution": f"""
    SELECT user_id, count(*) AS n_ratings, CAST({schemas.ALS_RANK} AS BIGINT) AS rank, true AS solved, CAST(0 AS BIGINT) AS n_off
    FROM ({RATING}) WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id""",
    "als_unseen_summary": f"""
    WITH seen AS (SELECT DISTINCT user_id, annonce_id FROM ({INTERACTION}))
    SELECT u.user_id, (SELECT least(100, count(*)) FROM ({RATED_LISTINGS})) - count(*) AS n_recs
    FROM ({RATED_USERS}) u JOIN seen s ON s.user_id = u.user_id GROUP BY u.user_id HAVING n_recs > 0""",
    "als_pair_summary": f"""
    SELECT annonce_id, count(DISTINCT user_id) AS n_pairs, CAST(0 AS BIGINT) AS n_nan FROM ({PURCHASE})
    WHERE user_id IN ({RATED_USERS}) AND annonce_id IN ({RATED_LISTINGS}) GROUP BY annonce_id""",
    "target_users_als_summary": f"""
    WITH n AS (SELECT least(1000, count(*)) AS n FROM ({RATED_USERS}))
    SELECT DISTINCT id AS announce_id, n AS n_users, CAST(n AS INTEGER) AS last_rank, CAST(0 AS BIGINT) AS out_of_order
    FROM ({TYPE_PAIRS}) JOIN n ON true WHERE similar_id IN ({RATED_LISTINGS})""",
    "retrain_check": f"""
    WITH t AS (SELECT max(annonce_id) AS last_id FROM ({INTERACTION}))
    SELECT any_value(last_id) AS last_id, count(*) AS new_listings, count(*) >= 100 AS retrain
    FROM t JOIN part ON p_partkey > last_id""",
    "model_lifecycle": f"SELECT CAST(1 AS BIGINT) AS version, max(id) AS last_id, count(*) AS n_scored FROM ({LISTING_CLEAN})",
    "constraint_audit": f"""
    SELECT 'interaction.user_id missing' AS rule, count(*) FILTER (WHERE user_id IS NULL) AS violations FROM ({INTERACTION_DIRTY})
    UNION ALL SELECT 'interaction.annonce_id missing', count(*) FILTER (WHERE annonce_id IS NULL) FROM ({INTERACTION_DIRTY})
    UNION ALL SELECT 'interaction.interaction_score missing', count(*) FILTER (WHERE interaction_score IS NULL) FROM ({INTERACTION_DIRTY})
    UNION ALL SELECT 'interaction.interaction_type outside', count(*) FILTER (WHERE {_BAD_TYPE}) FROM ({INTERACTION_DIRTY})
    UNION ALL SELECT 'listing.prix missing', count(*) FILTER (WHERE prix IS NULL) FROM ({LISTING_DIRTY})
    UNION ALL SELECT 'listing.type_bien missing', count(*) FILTER (WHERE type_bien IS NULL) FROM ({LISTING_DIRTY})
    UNION ALL SELECT 'user.id duplicate', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'user.username duplicate', count(*) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'listing.prix duplicate', count(*) FROM (SELECT prix FROM ({LISTING_DIRTY}) WHERE prix IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'interaction.user_id orphan', count(*) FROM ({INTERACTION_DIRTY}) WHERE user_id NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'interaction.annonce_id orphan', count(*) FROM ({INTERACTION_DIRTY}) WHERE annonce_id NOT IN (SELECT p_partkey FROM part)""",
    "synthetic_listings": f"""
    SELECT id, 'Listing ' || id AS titre, 'Description of listing ' || id AS description,
           {_between('id', 4, 1_000_000, 30_000_000)} / 100.0 AS prix,
           {_pick(schemas.LEASE_DURATIONS, 'id', 5)} AS lease_duration, {_pick(schemas.TYPE_ANNONCE, 'id', 6)} AS type,
           {_pick(schemas.ROOMS, 'id', 7)} AS rooms,
           {_between('id', 8, -9_000, 9_000)} / 100.0 AS latitude, {_between('id', 9, -18_000, 18_000)} / 100.0 AS longitude,
           {_pick(schemas.TYPE_BIEN, 'id', 10)} AS type_bien, {_pick(schemas.STATUS_ANNONCE, 'id', 11)} AS status, user_id
    FROM ({OWNED})""",
    "synthetic_listings_old": f"""
    SELECT p_partkey AS id, 'Listing ' || p_partkey AS title, 'Description of listing ' || p_partkey AS description,
           {_between('p_partkey', 20, 10_000_000, 50_000_000)} / 100.0 AS price,
           {_between('p_partkey', 21, -9_000, 9_000)} / 100.0 AS latitude, {_between('p_partkey', 22, -18_000, 18_000)} / 100.0 AS longitude,
           {_pick(schemas.OLD_TYPES, 'p_partkey', 23)} AS type, {_pick(schemas.OLD_ROOMS, 'p_partkey', 24)} AS rooms
    FROM part""",
    "synthetic_attachments": f"""
    SELECT id AS annonce_id, '/uploads/listing-' || id || '-' || slot || '.jpg' AS attachment_paths
    FROM (SELECT id, unnest(range({_between('id', 12, 1, 3)})) AS slot FROM ({OWNED}))""",
    "synthetic_user_roles": f"""
    SELECT c_custkey AS user_id, unnest(CASE WHEN {_between('c_custkey', 1, 1, 2)} = 2 THEN ['ROLE_USER', 'ROLE_ADMIN']
           ELSE [{_pick(schemas.ROLES, 'c_custkey', 2)}] END) AS roles
    FROM customer""",
    "synthetic_interactions": f"""
    SELECT id, user_id, owner * 3 + {_mixed('id', 14)} % {_between('owner', 3, 1, 3)} AS annonce_id,
           {_between('id', 15, 10, 100)} / 100.0 AS interaction_score, {_pick(schemas.INTERACTION_TYPES, 'id', 16)} AS interaction_type
    FROM (SELECT id, user_id, {_mixed('id', 13)} % (SELECT count(*) FROM customer) AS owner
          FROM (SELECT c_custkey * 5 + slot AS id, c_custkey AS user_id
                FROM (SELECT c_custkey, unnest(range(5)) AS slot FROM customer)))""",
}
for _wide in ("user_recs_summary", "pair_summary"):  # the ids of a model do not change what comes out
    SQL[f"als_wide_{_wide}"] = SQL[f"als_{_wide}"]
SQL["kmeans_cost"] = f"""
    SELECT max(n) AS n_listings, round(sum(squares - total * total / n), 3) AS one_cluster_cost, true AS better
    FROM (SELECT pos, count(*) AS n, sum(value) AS total, sum(value * value) AS squares FROM ({SQL['feature_vectors']}) GROUP BY pos)"""
