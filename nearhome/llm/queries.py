"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.llm import bpe, collocations, exact_dedup, fp_search, mixing, ngram_lm, quality_model, quality_rules, secrets, sharding, simhash, url_filter, warc
from nearhome.session import ship_package, written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, by their digests."""
    return token_digests(_read(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, ["doc_id"])
    digest = F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256)
    counted = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    keep = ["doc_id", "n_tokens", "ids_sha256"]
    return bpe.decode(counted, VOCABULARY, keep).select(*keep, F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_model.fitted(quality_model.rated_features(docs, _read(spark, sf_dir, "labels")))
    return quality_model.graded(docs, model, ["doc_id"])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(mixing.sized(_read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ["doc_id"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_read(spark, sf_dir, "documents"))
    kinds = ("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.encode(secrets.span_list(*kinds), "UTF-8"), 256).alias("base_sha256"),
        secrets.span_list(*kinds, "linked").alias("spans"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document, with the half of the table by hash of the id as a new batch on the other half."""
    snapshot, batch = exact_dedup.halves(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    of_batch, of_snapshot = exact_dedup.dedup_batch(snapshot, batch)
    return of_batch.unionByName(of_snapshot).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(_read(spark, sf_dir, "documents"), ["doc_id"])
    rows = written(prints.select(F.monotonically_increasing_id().alias("row"), "doc_id", "fp"), "simhash-rows")
    return simhash.near_duplicates(rows).select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scored(_read(spark, sf_dir, "documents"), ["doc_id"])


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered_pages(_read(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_read(spark, sf_dir, "pages"))


def op11_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


SHARDS = 24


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(_read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_quality_model, op3_source_mix, op4_quality_rules, op5_secret_scan, op6_exact_dedup, op7_simhash, op8_stupid_backoff,
    op9_url_filter, op10_warc, op11_fp_search, op12_collocations, op13_sharding,
)}



def _template_sql(depth: int = 8) -> str:
    """The path-template tree level by level, as deep as the provided paths go, the groups of similar siblings, and the rules."""
    u, n = url_filter, url_filter.MIN_ROWS
    wildcard = lambda x: f"'*' || regexp_extract({x}, '{u.EXTENSION}', 1)"
    levels = []
    for k in range(depth):
        levels.append(f"""
        c{k} AS (SELECT *, sum(n) OVER (PARTITION BY host, names) AS total, sum(n) OVER (PARTITION BY host, names, rest[1]) AS own,
                        min(array_to_string(rest, '/')) OVER (PARTITION BY host, names) = max(array_to_string(rest, '/')) OVER (PARTITION BY host, names) AS single
                 FROM l{k} WHERE len(rest) > 0),
        l{k + 1} AS (SELECT host, path, n, labelled, rejected, CASE WHEN total < {n} OR single THEN [] ELSE rest[2:] END AS rest,
                     list_append(names, CASE
                         WHEN total < {n} OR single THEN array_to_string(list_transform(rest, lambda s:
                             CASE WHEN total >= {n} AND NOT regexp_matches(s, '{u.VARIABLE}') THEN s ELSE {wildcard('s')} END), '/')
                         WHEN own >= {n} AND NOT regexp_matches(rest[1], '{u.VARIABLE}') THEN rest[1] ELSE {wildcard('rest[1]')} END) AS names FROM c{k})""")
    ended = " UNION ALL ".join(f"SELECT * FROM l{k} WHERE len(rest) = 0" for k in range(depth + 1))
    rules = "\n".join(
        f"WHEN (host = '{at}' OR host LIKE '%.{at}') AND starts_with(path, '/{tail}') THEN '{rule}'"
        for _, rule in sorted(u.RULES, key=lambda r: -len(r[1])) for at, _, tail in [rule.partition("/")]
    )
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for verdict, rule in u.RULES)
    return f"""
        WITH RECURSIVE u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{u.UPPER}', '{u.LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
        ), r AS (SELECT *, CASE {rules} END AS rule FROM u),
        v AS (SELECT *, CASE rule {verdicts} END AS ruled FROM r),
        l0 AS (SELECT host, path, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS rejected,
                      list_filter(string_split(path, '/'), lambda x: x <> '') AS rest, []::VARCHAR[] AS names FROM v GROUP BY host, path),
        {",".join(levels)},
        t AS ({ended}),
        x AS (SELECT host, names[:d] AS node, d, sum(labelled) AS labelled, sum(rejected) AS rejected
              FROM (SELECT host, names, labelled, rejected, unnest(range(len(names) + 1)) AS d FROM t) GROUP BY ALL),
        s AS (SELECT host, node, node[:d - 1] AS parent, floor({u.STEPS} * rejected / labelled)::INT AS share, labelled, rejected FROM x WHERE d > 0 AND labelled > 0),
        b AS (SELECT host, parent, share, sum(labelled) AS n, sum(rejected) AS r, row_number() OVER (PARTITION BY host, parent ORDER BY share) AS place
              FROM s GROUP BY host, parent, share),
        g AS (
            SELECT host, parent, share, place, n, r, n AS gn, r AS gr, 1 AS number FROM b WHERE place = 1
            UNION ALL
            SELECT host, parent, share, place, n, r, CASE WHEN apart THEN n ELSE gn + n END, CASE WHEN apart THEN r ELSE gr + r END,
                   CASE WHEN apart THEN number + 1 ELSE number END
            FROM (SELECT b.*, gn, gr, number, b.r / b.n - gr / gn > {u.SIMILAR} * sqrt(
                      ((b.r + gr + 1) / (b.n + gn + 2)) * (1 - (b.r + gr + 1) / (b.n + gn + 2)) * (1 / b.n + 1 / gn)) AS apart
                  FROM g JOIN b ON b.host = g.host AND b.parent = g.parent AND b.place = g.place + 1)
        ), p AS (SELECT host, parent, share, sum(n) OVER w AS n, sum(r) OVER w AS r FROM g WINDOW w AS (PARTITION BY host, parent, number)),
        k AS (SELECT x.host, x.node, x.d, x.labelled AS own, coalesce(p.n, x.labelled) AS n, coalesce(p.r, x.rejected) AS r
              FROM x LEFT JOIN s ON s.host = x.host AND s.node = x.node LEFT JOIN p ON p.host = s.host AND p.parent = s.parent AND p.share = s.share),
        q AS (
            SELECT host, node, d, own, (r + {u.WEIGHT} * {u.PRIOR}::DOUBLE) / (n + {u.WEIGHT}::DOUBLE) AS purity FROM k WHERE d = 0
            UNION ALL
            SELECT k.host, k.node, k.d, k.own, CASE WHEN k.own = q.own THEN purity ELSE (r + {u.WEIGHT} * purity) / (n + {u.WEIGHT}::DOUBLE) END FROM q JOIN k ON k.host = q.host AND k.d = q.d + 1 AND k.node[:q.d] = q.node
        )
        SELECT page_id, v.host, v.path, rule, coalesce(ruled, CASE WHEN purity >= {u.PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
               CASE WHEN len(names) > 0 THEN v.host || '/' || array_to_string(names, '/') ELSE v.host END AS template, purity
        FROM v JOIN t ON t.host = v.host AND t.path = v.path JOIN q ON q.host = t.host AND q.node = t.names
    """


def _sharding_sql() -> str:
    """The checksum byte by byte, and all jumps of every key: its shard is the last one below the number of shards."""
    following = f"(key * {sharding.MULTIPLIER} + 1) % 18446744073709551616"
    return f"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, x:
                       CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i)) AS steps
        ), d AS (
            SELECT row_number() OVER () AS place, doc_id, octet_length(encode(coalesce(text, ''))) + {sharding.HEADER} AS size,
                   xor(4294967295, list_reduce(
                       list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h:
                           (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1),
                       lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295)) AS text_crc32
            FROM documents, crc
        ), j AS (
            SELECT place, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[:16])::UBIGINT::HUGEINT AS key, 0::BIGINT AS jump FROM d
            UNION ALL
            SELECT place, {following}, floor((jump + 1) * (2147483648::DOUBLE / (({following}) // 8589934592 + 1)::DOUBLE))::BIGINT
            FROM j WHERE jump <= {SHARDS}
        ), s AS (
            SELECT place, max(jump) FILTER (jump < {SHARDS}) AS shard, max(jump) FILTER (jump <= {SHARDS}) AS grown_shard FROM j GROUP BY place
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
        FROM d JOIN s USING (place)
    """


def _search_sql() -> str:
    """Every item against every document by a join on terms."""
    lower = f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    terms = f"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {terms} AS terms FROM documents),
        v AS (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        t AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM v GROUP BY ALL),
        s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
        f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
        i AS (SELECT number, item_id, unnest(terms) AS term
              FROM (SELECT row_number() OVER () AS number, item_id, list_distinct({terms}) AS terms FROM benchmark)),
        x AS (SELECT number, item_id, doc, doc_id,
                     sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
              FROM i JOIN t USING (term) JOIN f USING (term), s GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM x WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {fp_search.TOP}
    """


def _collocations_sql() -> str:
    """Phrases by looking ahead from every word, and all their cuts, in 128-bit integers."""
    folded = f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    return f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({folded}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
        g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, words[i:i + k - 1] AS parts
              FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {collocations.MAX_WORDS + 1})) AS k))),
        c AS (SELECT lang, phrase, any_value(parts) AS parts, any_value(k) AS k, count(*) AS a FROM g GROUP BY lang, phrase),
        t AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
        f AS (SELECT * FROM c WHERE k > 1 AND a >= {collocations.MIN_COUNT}),
        x AS (SELECT f.*, unnest(range(1, k)) AS cut FROM f),
        y AS (SELECT x.lang, x.phrase, x.k, x.a, cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
              FROM x JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(x.parts[:cut], ' ')
                     JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(x.parts[cut + 1:], ' ')),
        b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        d AS (SELECT b.* FROM b WHERE NOT EXISTS (
                  SELECT 1 FROM (SELECT lang, a, array_to_string(unnest([parts[:k - 1], parts[2:]]), ' ') AS inner_phrase FROM f) z
                  WHERE z.lang = b.lang AND z.inner_phrase = b.phrase AND 100 * z.a >= {collocations.SHARE} * b.a)),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank FROM d)
        SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= {collocations.TOP}
    """


SQL = {
    "op12_collocations": _collocations_sql(),
    "op11_fp_search": _search_sql(),
    "op13_sharding": _sharding_sql(),
    "op9_url_filter": _template_sql(),
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), g AS (
            SELECT norm, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -points, b := doc_id)) AS keep_id
            FROM t GROUP BY norm
        )
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
    "op10_warc": r"""
        WITH t AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
