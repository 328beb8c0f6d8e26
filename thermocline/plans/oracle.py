"""SQL twins of the registered queries for an independent engine."""

from __future__ import annotations

_VECTORS = """
vec AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings),
seen AS (SELECT DISTINCT user_id FROM events),
workload AS (SELECT * FROM vec WHERE vec_id IN (SELECT user_id FROM seen)),
held_out AS (SELECT * FROM vec WHERE vec_id NOT IN (SELECT user_id FROM seen))
"""

_TEMPS = _VECTORS + """,
temps AS (
  SELECT d.vec_id AS doc_id, round(sum(greatest(list_dot_product(d.e, q.e) / (d.n * q.n), 0)), 9) AS temperature
  FROM vec d CROSS JOIN workload q GROUP BY d.vec_id)
"""

_TIERS = _TEMPS + """,
cuts AS (SELECT quantile_cont(temperature, 0.95) AS hot_at, quantile_cont(temperature, 0.75) AS warm_at FROM temps),
tiers AS (
  SELECT doc_id, temperature, hot_at, warm_at,
         CASE WHEN temperature >= hot_at THEN 1 WHEN temperature >= warm_at THEN 2 ELSE 3 END AS tier
  FROM temps CROSS JOIN cuts)
"""


def _pairs(asked: str) -> str:
    return f""",
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
         round(list_dot_product(d.e, q.e) / (d.n * q.n), 9) AS score
  FROM vec d CROSS JOIN {asked} q)
"""


def _cascade(asked: str = "held_out") -> str:
    return _TIERS + _pairs(asked) + """,
levels AS (SELECT CAST(unnest([0.2, 0.25, 0.3]) AS DOUBLE) AS threshold),
ranked AS (
  SELECT threshold, query_id, doc_id, score, tier,
         row_number() OVER (PARTITION BY threshold, query_id ORDER BY tier, score DESC, doc_id) AS rank
  FROM pairs JOIN tiers USING (doc_id) JOIN levels ON score >= threshold),
sweep AS (
  SELECT threshold, query_id, CAST(rank AS INTEGER) AS rank, doc_id, score, tier,
         CASE tier WHEN 1 THEN 'hot (T1)' WHEN 2 THEN 'warm (T2)' ELSE 'cold (T3)' END AS source
  FROM ranked WHERE rank <= 5),
hits AS (SELECT * FROM sweep WHERE threshold = 0.25)
"""


_HITS = "SELECT query_id, rank, doc_id, round(score, 6) AS score, tier, source FROM hits"

_ACCESS = """
stats AS (
  SELECT user_id AS doc_id, count(*) AS total_accesses, max(ts) AS last_access, min(ts) AS first_access
  FROM events WHERE ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY user_id),
scores AS (
  SELECT *, (least(1.0::DOUBLE, total_accesses / 100.0::DOUBLE)
    + greatest(0.0::DOUBLE, 1 - date_diff('microsecond', last_access, TIMESTAMP '2024-01-31 00:00:00') / 3600e6 / 24)) / 2 AS score
  FROM stats)
"""

_MOVES = _ACCESS + """,
current AS (SELECT vec_id AS doc_id, CAST(vec_id % 3 + 1 AS INTEGER) AS tier, vec_id AS seq FROM embeddings),
aimed AS (
  SELECT doc_id, tier, seq, coalesce(score, 0.0::DOUBLE) AS score,
         CASE WHEN coalesce(score, 0.0) >= 0.7 THEN 1 WHEN coalesce(score, 0.0) >= 0.3 THEN 2 ELSE 3 END AS target_tier
  FROM current LEFT JOIN scores USING (doc_id)),
wanted AS (
  SELECT *, CASE WHEN tier > target_tier THEN 'promote' ELSE 'demote' END AS action,
         row_number() OVER (ORDER BY seq, doc_id) AS place, CAST(tier + sign(target_tier - tier) AS INTEGER) AS to_tier
  FROM aimed WHERE tier <> target_tier),
capped AS (SELECT * FROM wanted WHERE place <= 20)
"""


def _after(moves: str) -> str:
    return f"""SELECT c.doc_id, coalesce(m.to_tier, c.tier) AS tier, m.tier AS from_tier,
       CASE WHEN m.doc_id IS NOT NULL THEN 'auto' END AS kind
FROM current c LEFT JOIN {moves} m USING (doc_id)"""


_REGISTERED = """
registered AS (
  SELECT vec_id AS doc_id, CAST(vec_id % 3 + 1 AS INTEGER) AS tier, vec_id - 1000000000000 AS seq FROM embeddings
  UNION ALL
  SELECT user_id, CASE WHEN least(value / 100, 1) >= 0.9::DOUBLE THEN 1
                       WHEN least(value / 100, 1) >= 0.7::DOUBLE THEN 2 ELSE 3 END, event_id FROM events)
"""

_LOG = """
log AS (
  SELECT event_id AS query_id, value AS latency_ms, event_type AS system,
         CAST([0.2, 0.25, 0.3][user_id % 3 + 1] AS DOUBLE) AS threshold
  FROM events)
"""


def _nearest(keys: str) -> str:
    return f"""
nearest AS (
  SELECT {keys}, count(*) AS n, avg(latency_ms) AS mean, median(latency_ms) AS median,
         min(latency_ms) AS min, max(latency_ms) AS max,
         list_sort(list(latency_ms))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95,
         list_sort(list(latency_ms))[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99
  FROM log GROUP BY {keys})
"""


_COMPARED = "WITH " + _LOG + "," + _nearest("system, threshold") + """,
compared AS (
  SELECT o.threshold, o.system, b.mean AS baseline_mean, o.mean AS tiered_mean, b.p95 AS baseline_p95, o.p95 AS tiered_p95,
         b.median AS baseline_median, o.median AS tiered_median, b.p99 AS baseline_p99, o.p99 AS tiered_p99,
         CASE WHEN o.mean > 0 THEN b.mean / o.mean * 100 ELSE 0 END AS retention_pct,
         o.mean - b.mean AS mean_diff,
         CASE WHEN b.mean > 0 THEN (o.mean - b.mean) / b.mean * 100 ELSE 0 END AS mean_diff_pct,
         o.p95 - b.p95 AS p95_diff,
         CASE WHEN b.p95 > 0 THEN (o.p95 - b.p95) / b.p95 * 100 ELSE 0 END AS p95_diff_pct,
         CASE WHEN b.mean > 0 THEN (b.mean - o.mean) / b.mean * 100 ELSE 0 END AS improvement_pct
  FROM nearest o JOIN nearest b ON b.threshold = o.threshold AND b.system = 'view' WHERE o.system <> 'view')
"""

_FORCED = """
current AS (SELECT vec_id AS doc_id, CAST(vec_id % 3 + 1 AS INTEGER) AS tier FROM embeddings),
forced AS (
  SELECT d.doc_id, CAST(d.n_chars % 5 AS INTEGER) AS target_tier, c.tier AS from_tier,
         greatest(1, least(3, CAST(d.n_chars % 5 AS INTEGER))) AS reach
  FROM documents d LEFT JOIN current c USING (doc_id))
"""

_STORE = """
outcomes AS (
  SELECT vec_id, label, len(embedding) AS dim, label / 9.0::DOUBLE AS temperature,
         CASE label WHEN 1 THEN 'missing temperature' WHEN 2 THEN 'malformed' WHEN 3 THEN 'bad embedding'
                    WHEN 4 THEN 'bad dimension' WHEN 5 THEN 'bad doc_id' WHEN 6 THEN 'bad temperature'
                    WHEN 7 THEN 'not finite' WHEN 8 THEN 'bad dimension' ELSE 'ok' END AS outcome,
         CASE WHEN label / 9.0::DOUBLE >= 0.9 THEN 1 WHEN label / 9.0::DOUBLE >= 0.7 THEN 2 ELSE 3 END AS tier
  FROM embeddings)
"""

_SCALED = """
scaled AS (
  SELECT vec_id, label, label * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings)
"""

_SPLIT_TEXTS = """
texts AS (
  SELECT doc_id AS query_id, md5(text) AS h, doc_id IN (SELECT user_id FROM events) AS seen FROM documents)
"""


def _quality(scope: str, asked: str) -> str:
    return f"""SELECT '{scope}' AS scope, count(*) AS n_queries, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_results,
       round(coalesce(sum(n), 0) / count(*), 6) AS avg_results,
       round(CASE WHEN coalesce(sum(n), 0) > 0 THEN sum(s) / sum(n) ELSE 0 END, 6) AS avg_similarity
FROM {asked} a LEFT JOIN per_query USING (query_id)"""


def _leak(key: str, name: str) -> str:
    return f"""SELECT CAST(sum(w) AS BIGINT) AS n_workload, CAST(sum(e) AS BIGINT) AS n_held_out,
       CAST(coalesce(sum(e) FILTER (WHERE w > 0), 0) AS BIGINT) AS leaked, '{name}' AS matched_by
FROM (SELECT {key}, count(*) FILTER (WHERE seen) AS w, count(*) FILTER (WHERE NOT seen) AS e FROM texts GROUP BY {key})"""


def _storage() -> str:
    gib = "(1024.0::DOUBLE * 1024 * 1024)"
    return "WITH " + _TIERS + f""",
sizes AS (
  SELECT count(*) FILTER (WHERE tier = 1) AS n_tier1, count(*) FILTER (WHERE tier = 2) AS n_tier2,
         count(*) FILTER (WHERE tier = 3) AS n_tier3,
         sum(len(e)) * 4 * 1.2::DOUBLE / {gib} AS base,
         coalesce(sum(len(e) * 4 + 152) FILTER (WHERE tier = 1), 0) / {gib} AS t1,
         coalesce(sum(len(e)) FILTER (WHERE tier = 2), 0) * 4 * 1.2::DOUBLE / {gib} AS t2,
         coalesce(sum(len(e)) FILTER (WHERE tier = 3), 0) * 4 * 1.2::DOUBLE / {gib} AS t3
  FROM tiers JOIN vec ON vec_id = doc_id)
SELECT baseline_type, n_tier1, n_tier2, n_tier3,
       round(CASE WHEN base > 0 THEN (base - own) / base * 100 ELSE 0 END, 6) AS saved_pct,
       round(base * 1024, 6) AS baseline_mib, round(t1 * 1024, 6) AS tier1_mib, round(t2 * 1024, 6) AS tier2_mib,
       round(t3 * 1024, 6) AS tier3_mib, round((base - own) * 1024, 6) AS saved_mib, round(other * 1024, 6) AS added_mib
FROM (SELECT 'local' AS baseline_type, *, t2 AS own, t3 AS other FROM sizes
      UNION ALL SELECT 'cloud', *, t3, t2 FROM sizes)"""


_ACCESS_ROWS = """SELECT user_id AS doc_id, count(*) AS total_accesses,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_access FROM events GROUP BY user_id"""


def _swept(found: str) -> str:
    """The quality report over ``found(threshold, query_id, score, tier)``."""
    pct = lambda t: f"round(count(*) FILTER (WHERE tier = {t}) * 100.0::DOUBLE / count(*), 6) AS t{t}_pct"
    return f"""
SELECT round(threshold, 6) AS threshold, count(*) AS total_hits,
       round(count(*) / (SELECT count(*) FROM held_out)::DOUBLE, 6) AS avg_results, round(avg(score), 6) AS avg_similarity,
       {pct(1)}, {pct(2)}, {pct(3)}
FROM {found} GROUP BY threshold"""


_EVERY_POINT = """,
reached AS (SELECT query_id, doc_id, score, tier FROM pairs JOIN tiers USING (doc_id) WHERE score >= 0.3),
points AS (
  SELECT DISTINCT score AS threshold FROM (
    SELECT score, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, doc_id) AS n FROM reached) WHERE n <= 5),
best AS (
  SELECT threshold, query_id, score, tier FROM points JOIN reached ON score >= threshold
  QUALIFY row_number() OVER (PARTITION BY threshold, query_id ORDER BY tier, score DESC, doc_id) <= 5)
"""


def _decay() -> str:
    """One uncapped pass after each arrival, as of the latest access so far (in milliseconds)."""
    parts = ["WITH p0 AS (SELECT vec_id AS doc_id, CAST(vec_id % 3 + 1 AS INTEGER) AS tier FROM embeddings)"]
    logs = []
    for number, day in enumerate((9, 17, 25, 32), 1):
        parts.append(f"""
e{number} AS (SELECT user_id AS doc_id, ts FROM events WHERE day(ts) < {day}),
w{number} AS (SELECT date_trunc('millisecond', max(ts)) AS now FROM e{number}),
s{number} AS (
  SELECT doc_id, (least(1.0::DOUBLE, count(*) / 100.0::DOUBLE)
    + greatest(0.0::DOUBLE, 1 - date_diff('microsecond', max(ts), any_value(now)) / 3600e6 / 24)) / 2 AS score
  FROM e{number}, w{number} WHERE ts <= now GROUP BY doc_id),
a{number} AS (
  SELECT doc_id, tier, CASE WHEN coalesce(score, 0.0) >= 0.7 THEN 1 WHEN coalesce(score, 0.0) >= 0.3 THEN 2 ELSE 3 END AS aim
  FROM p{number - 1} LEFT JOIN s{number} USING (doc_id)),
p{number} AS (SELECT doc_id, CAST(tier + sign(aim - tier) AS INTEGER) AS tier FROM a{number})""")
        logs.append(f"""SELECT doc_id, strftime(now, '%Y-%m-%d %H:%M:%S.%f') AS ts, tier AS from_tier,
       CAST(tier + sign(aim - tier) AS INTEGER) AS to_tier, 'auto' AS kind FROM a{number}, w{number} WHERE tier <> aim""")
    return ",".join(parts) + "\n" + "\nUNION ALL ".join(logs)


_COSINE_PAIRS = """
SELECT query_id, doc_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM pairs WHERE score >= 0.25"""

_NEAR_COPIES = """,
changed AS (
  SELECT -vec_id - 1 AS doc_id, list_transform(e, lambda x, i: x * ((i - 1 + vec_id) % 5 * 0.02::DOUBLE + 0.96::DOUBLE)) AS e
  FROM held_out),
copies AS (
  SELECT vec_id AS doc_id, e, n FROM vec
  UNION ALL SELECT doc_id, e, sqrt(list_dot_product(e, e)) FROM changed)
"""


def oracle_sql() -> dict[str, str]:
    with_ = "WITH "
    return {
        "scan_vectors": with_ + _VECTORS + """
            SELECT vec_id AS query_id, CASE WHEN vec_id IN (SELECT user_id FROM seen) THEN 'workload' ELSE 'eval' END AS split,
                   CAST(len(e) AS INTEGER) AS dim FROM vec""",
        "corpus_ingest": """
            SELECT vec_id AS doc_id, CAST(len(embedding) AS INTEGER) AS dim,
                   round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS component_sum FROM embeddings""",
        "ingest_validate": with_ + _STORE + """
            SELECT vec_id AS seq, CASE WHEN outcome NOT IN ('malformed', 'bad doc_id') THEN vec_id END AS doc_id,
                   CASE WHEN outcome = 'bad embedding' THEN 0.5 WHEN outcome = 'bad temperature' THEN 'nan'::DOUBLE
                        WHEN outcome NOT IN ('malformed', 'missing temperature') THEN round(temperature, 6) END AS temperature,
                   CASE WHEN outcome = 'ok' THEN tier END AS tier, outcome FROM outcomes""",
        "query_texts_json": """
            SELECT doc_id AS query_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS line
            FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""",
        "query_log_roundtrip": "SELECT event_id AS query_id, round(value, 6) AS latency_ms, event_type AS system FROM events",
        "multi_log_scan": with_ + _LOG + """
            SELECT system, threshold, count(*) AS n, round(avg(latency_ms), 6) AS mean FROM log GROUP BY system, threshold""",
        "tier_table_roundtrip": with_ + _TIERS + """
            SELECT doc_id, round(temperature, 6) AS temperature, tier, round(hot_at, 6) AS tier1_threshold,
                   round(warm_at, 6) AS tier2_threshold FROM tiers""",
        "tier_clear": with_ + _TIERS + """
            SELECT doc_id, tier, round(temperature, 6) AS temperature, round(list_sum(e), 6) AS component_sum
            FROM tiers JOIN vec ON vec_id = doc_id WHERE tier <> 2 AND doc_id NOT IN (SELECT user_id FROM seen)""",
        "tier_upsert": with_ + _REGISTERED + "SELECT tier, doc_id, max(seq) AS seq FROM registered GROUP BY tier, doc_id",
        "store_upsert": with_ + _REGISTERED + """,
            newest AS (SELECT tier, doc_id, max(seq) AS seq FROM registered GROUP BY tier, doc_id)
            SELECT doc_id, tier, seq, round(list_sum(CAST(embedding AS DOUBLE[])) * CASE WHEN seq >= 0 THEN 2 ELSE 1 END, 6)
                   AS component_sum
            FROM newest JOIN embeddings ON vec_id = doc_id""",
        "store_move": with_ + _MOVES + """,
            sums AS (SELECT vec_id AS doc_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS component_sum FROM embeddings),
            ends AS (
              SELECT c.doc_id, coalesce(m.to_tier, c.tier) AS tier, c.seq, 'move' AS mode FROM current c LEFT JOIN wanted m USING (doc_id)
              UNION ALL SELECT doc_id, tier, seq, 'copy' FROM current
              UNION ALL SELECT doc_id, to_tier, seq, 'copy' FROM wanted)
            SELECT doc_id, tier, seq - 1000000000000 AS seq, component_sum, mode FROM ends JOIN sums USING (doc_id)""",
        "store_delete": """
            SELECT vec_id AS doc_id, CAST(vec_id % 3 + 1 AS INTEGER) AS tier, vec_id - 1000000000000 AS seq,
                   round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS component_sum
            FROM embeddings WHERE vec_id NOT IN (SELECT user_id FROM events)""",
        "register_tiers": with_ + _REGISTERED + """
            SELECT doc_id, arg_max(tier, seq) AS tier, min(seq) AS seq FROM registered GROUP BY doc_id""",
        "tier_get": with_ + _TIERS + """
            SELECT doc_id, tier, CAST(len(e) AS INTEGER) AS dim, round(e[1], 6) AS first_component
            FROM tiers JOIN vec ON vec_id = doc_id WHERE doc_id IN (SELECT user_id FROM seen)""",
        "tier_delete": with_ + _TIERS + """
            SELECT doc_id, tier, round(temperature, 6) AS temperature FROM tiers WHERE doc_id NOT IN (SELECT user_id FROM seen)""",
        "embedding_cache_split": """
            WITH cache AS (
              SELECT DISTINCT md5(text) AS query_md5, CAST(len(embedding) AS INTEGER) AS dimension
              FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id IN (SELECT user_id FROM events)),
            wanted AS (SELECT md5(text) AS query_md5, min(doc_id) AS query_id, count(*) AS n_queries FROM documents GROUP BY 1)
            SELECT query_md5, query_id, n_queries, CASE WHEN dimension IS NULL THEN 'miss' ELSE 'hit' END AS outcome, dimension
            FROM wanted LEFT JOIN cache USING (query_md5)""",
        "l2_normalize": with_ + _SCALED + """
            SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS pos,
                   round(CAST(CAST(CASE WHEN n <> 0 THEN unnest(e) * label / n ELSE 0 END AS FLOAT) AS DOUBLE), 6) AS x
            FROM scaled""",
        "zero_query_guard": with_ + _SCALED + """,
            scored AS (
              SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
                     round(list_dot_product(d.e, q.e) * q.label / (sqrt(list_dot_product(d.e, d.e)) * q.n), 9) AS score
              FROM scaled d CROSS JOIN scaled q WHERE q.n > 0),
            best AS (SELECT * FROM scored WHERE score >= 0.25
                     QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5)
            SELECT s.vec_id AS query_id, CAST(s.n = 0 AS INTEGER) AS is_zero, count(best.doc_id) AS n_results,
                   round(avg(best.score), 6) AS avg_score
            FROM scaled s LEFT JOIN best ON best.query_id = s.vec_id GROUP BY s.vec_id, s.n""",
        "tier_by_temperature": with_ + _TEMPS + """,
            relative AS (SELECT doc_id, round(temperature / (SELECT max(temperature) FROM temps), 9) AS t FROM temps)
            SELECT doc_id, round(t, 6) AS temperature, CASE WHEN t >= 0.9 THEN 1 WHEN t >= 0.7 THEN 2 ELSE 3 END AS tier
            FROM relative""",
        "tier_by_access_score": with_ + _ACCESS + """
            SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 1 WHEN score >= 0.3 THEN 2 ELSE 3 END AS tier
            FROM scores""",
        "tier_by_percentile": with_ + _TIERS + """
            SELECT doc_id, round(temperature, 6) AS temperature, tier, round(hot_at, 6) AS tier1_threshold,
                   round(warm_at, 6) AS tier2_threshold FROM tiers""",
        "doc_key_codec": "SELECT vec_id AS doc_id, 'doc' || vec_id AS doc_key, vec_id AS decoded FROM embeddings",
        "cosine_pairs": with_ + _VECTORS + _pairs("held_out") + _COSINE_PAIRS,
        "similarity_profile": with_ + _VECTORS + _pairs("held_out") + """
            SELECT doc_id, round(min(score), 6) AS sim_min, round(max(score), 6) AS sim_max,
                   round(avg(score), 6) AS sim_mean, count(*) AS n_queries FROM pairs GROUP BY doc_id""",
        "doc_temperature": with_ + _TEMPS + "SELECT doc_id, round(temperature, 6) AS temperature FROM temps",
        "temperature_maintained": with_ + _TEMPS + """
            SELECT doc_id, round(temperature, 6) AS temperature FROM temps JOIN vec ON vec_id = doc_id WHERE label <> 9""",
        "temperature_sketches": """
            SELECT share::DOUBLE AS share, count(*) AS n, true AS close
            FROM embeddings, (VALUES (0.95), (0.75)) s(share) GROUP BY share""",
        "latency_sketches": with_ + _LOG + """
            SELECT system, share::DOUBLE AS share, count(*) AS n, true AS close
            FROM log, (VALUES (0.5), (0.95), (0.99)) s(share) GROUP BY system, share""",
        "temperature_stats": with_ + _TEMPS + """
            SELECT count(*) AS n_docs, round(min(temperature), 6) AS min_temperature, round(max(temperature), 6) AS max_temperature,
                   round(avg(temperature), 6) AS mean_temperature, round(stddev_pop(temperature), 6) AS std_temperature FROM temps""",
        "tier_distribution": with_ + _TIERS + "SELECT tier, count(*) AS n_docs FROM tiers GROUP BY tier",
        "cascade_topk": with_ + _cascade() + _HITS,
        "cascade_staged": with_ + _cascade() + _HITS,
        "cascade_indexed": with_ + _cascade() + _HITS,
        "cascade_indexed_recall": with_ + _cascade() + "SELECT count(*) AS n_exact, true AS recall_reached FROM hits",
        "codes_recall": with_ + _VECTORS + "SELECT count(*) * 5 AS n_exact, true AS recall_reached FROM held_out",
        "pruned_pairs": with_ + _VECTORS + _pairs("held_out") + _COSINE_PAIRS,
        "near_copy_leakage": with_ + _VECTORS + _NEAR_COPIES + """
            SELECT q.vec_id AS query_id, c.doc_id, round(list_dot_product(c.e, q.e) / (c.n * q.n), 6) AS score
            FROM copies c JOIN held_out q ON round(list_dot_product(c.e, q.e) / (c.n * q.n), 9) >= 0.99""",
        "near_copy_pruning": with_ + _VECTORS + _NEAR_COPIES + """
            SELECT (SELECT count(*) FROM copies) * (SELECT count(*) FROM held_out) AS pairs, true AS half_skipped""",
        "cascade_sweep": with_ + _cascade() + """
            SELECT threshold, query_id, rank, doc_id, round(score, 6) AS score, tier, source FROM sweep""",
        "baseline_topk": with_ + _VECTORS + _pairs("held_out") + """
            SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs)
            WHERE rank <= 5""",
        "ann_all_cells": with_ + _VECTORS + _pairs("held_out") + """
            SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
              FROM pairs WHERE score >= 0.25)
            WHERE rank <= 5""",
        "embedding_cache_grown": """
            SELECT md5(text) AS query_md5,
                   CASE WHEN bool_or(doc_id IN (SELECT user_id FROM events)) THEN 'given' ELSE 'later' END AS model,
                   CAST(max(len(embedding)) AS INTEGER) AS dimension
            FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1""",
        "threshold_search": with_ + _TIERS + _pairs("held_out") + """
            SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (
              SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
              FROM pairs JOIN tiers USING (doc_id) WHERE tier = 1 AND score >= 0.25)
            WHERE rank <= 5""",
        "enrich_hits": with_ + _cascade() + """
            SELECT query_id, rank, 'doc' || h.doc_id AS doc_key, d.source || '-' || d.doc_id AS title,
                   CASE WHEN length(d.text) > 200 THEN substring(d.text, 1, 200) || '...' ELSE d.text END AS snippet
            FROM hits h LEFT JOIN documents d USING (doc_id)""",
        "sample_query_results": with_ + _cascade() + """,
            sample AS (SELECT vec_id AS query_id FROM held_out ORDER BY vec_id LIMIT 5),
            nested AS (SELECT query_id, string_agg(rank || ':' || doc_id || ':' || source, ';' ORDER BY rank) AS results
                       FROM hits GROUP BY query_id)
            SELECT s.query_id, coalesce(d.text, 'Query ' || (s.query_id + 1)) AS query_text, coalesce(n.results, '') AS results
            FROM sample s LEFT JOIN nested n USING (query_id) LEFT JOIN documents d ON d.doc_id = s.query_id""",
        "tier_hit_rates": with_ + _cascade() + """
            SELECT t.tier, count(h.doc_id) AS hits,
                   round(CASE WHEN (SELECT count(*) FROM hits) > 0
                              THEN count(h.doc_id) * 100.0::DOUBLE / (SELECT count(*) FROM hits) ELSE 0 END, 6) AS hit_pct
            FROM (VALUES (1), (2), (3)) t(tier) LEFT JOIN hits h ON h.tier = t.tier GROUP BY t.tier""",
        "result_quality": with_ + _cascade() + """,
            per_query AS (SELECT query_id, count(*) AS n, sum(score) AS s FROM hits GROUP BY query_id),
            asked AS (SELECT vec_id AS query_id FROM held_out),
            first_asked AS (SELECT query_id FROM asked ORDER BY query_id LIMIT 5) """
        + _quality("all", "asked") + " UNION ALL " + _quality("first 5", "first_asked"),
        "threshold_report": _COMPARED + "," + _cascade() + """
            SELECT l.threshold, any_value(round(c.baseline_mean, 6)) AS baseline_mean, any_value(round(c.baseline_p95, 6)) AS baseline_p95,
                   any_value(round(c.tiered_mean, 6)) AS tiered_mean, any_value(round(c.tiered_p95, 6)) AS tiered_p95,
                   any_value(round(c.baseline_median, 6)) AS baseline_median, any_value(round(c.tiered_median, 6)) AS tiered_median,
                   any_value(round(c.baseline_p99, 6)) AS baseline_p99, any_value(round(c.tiered_p99, 6)) AS tiered_p99,
                   any_value(round(c.retention_pct, 6)) AS retention_pct, count(s.doc_id) AS total_hits,
                   round(count(s.doc_id) / (SELECT count(*) FROM held_out)::DOUBLE, 6) AS avg_results,
                   round(coalesce(avg(s.score), 0), 6) AS avg_similarity,
                   round(CASE WHEN count(s.doc_id) > 0 THEN count(*) FILTER (WHERE tier = 1) * 100.0::DOUBLE / count(s.doc_id) ELSE 0 END, 6) AS t1_pct,
                   round(CASE WHEN count(s.doc_id) > 0 THEN count(*) FILTER (WHERE tier = 2) * 100.0::DOUBLE / count(s.doc_id) ELSE 0 END, 6) AS t2_pct,
                   round(CASE WHEN count(s.doc_id) > 0 THEN count(*) FILTER (WHERE tier = 3) * 100.0::DOUBLE / count(s.doc_id) ELSE 0 END, 6) AS t3_pct
            FROM levels l LEFT JOIN sweep s USING (threshold)
            LEFT JOIN compared c ON c.threshold = l.threshold AND c.system = 'click' GROUP BY l.threshold""",
        "sweep_points": with_ + _TIERS + _pairs("held_out") + _EVERY_POINT + _swept("best"),
        "sweep_report": with_ + _cascade() + _swept("sweep"),
        "query_slice": "SELECT doc_id AS query_id, text AS query_text FROM documents ORDER BY doc_id LIMIT 20 OFFSET 50",
        "incremental_queries": with_ + _VECTORS + """,
            numbered AS (
              SELECT vec_id AS query_id, 'existing' AS origin, 0 AS later FROM workload
              UNION ALL SELECT vec_id, 'new', 1 FROM held_out)
            SELECT query_id, origin FROM (
              SELECT *, row_number() OVER (ORDER BY later, query_id) AS place FROM numbered)
            WHERE place <= (SELECT count(*) * 4 // 5 FROM embeddings)""",
        "query_leakage": with_ + _SPLIT_TEXTS + _leak("query_id", "id") + " UNION ALL " + _leak("h", "text"),
        "access_stats": with_ + _ACCESS + """
            SELECT vec_id AS doc_id, coalesce(total_accesses, 0) AS total_accesses,
                   strftime(last_access, '%Y-%m-%d %H:%M:%S.%f') AS last_access, round(coalesce(score, 0), 6) AS score
            FROM embeddings LEFT JOIN scores ON doc_id = vec_id""",
        "access_score": with_ + _ACCESS + "SELECT doc_id, total_accesses, round(score, 6) AS score FROM scores",
        "top_accessed": with_ + _ACCESS + """
            SELECT doc_id, round(score, 6) AS score FROM (
              SELECT * FROM scores ORDER BY scores.score DESC, first_access, doc_id LIMIT 10)""",
        "migration_candidates": with_ + _MOVES + """
            SELECT doc_id, seq, tier, target_tier, round(score, 6) AS score, action FROM capped""",
        "migration_pass": with_ + _MOVES + _after("capped"),
        "migration_pass_uncapped": with_ + _MOVES + _after("wanted"),
        "apply_moves": with_ + _MOVES + """
            SELECT c.doc_id, coalesce(m.to_tier, c.tier) AS tier, 'move' AS mode FROM current c LEFT JOIN wanted m USING (doc_id)
            UNION ALL SELECT doc_id, tier, 'copy' FROM current
            UNION ALL SELECT doc_id, to_tier, 'copy' FROM wanted""",
        "migration_converge": with_ + _MOVES + """,
            steps AS (
              SELECT doc_id, pass, CAST(tier + sign(target_tier - tier) * (pass - 1) AS INTEGER) AS from_tier,
                     CAST(tier + sign(target_tier - tier) * pass AS INTEGER) AS to_tier
              FROM wanted JOIN (VALUES (1), (2)) p(pass) ON pass <= abs(target_tier - tier))
            SELECT doc_id, target_tier AS final_tier, pass, from_tier, to_tier FROM aimed LEFT JOIN steps USING (doc_id)""",
        "migration_capped": with_ + _MOVES + """,
            steps AS (
              SELECT doc_id, CAST(tier + sign(target_tier - tier) * (pass - 1) AS INTEGER) AS from_tier,
                     CAST(tier + sign(target_tier - tier) * pass AS INTEGER) AS to_tier
              FROM wanted JOIN (VALUES (1), (2)) p(pass) ON pass <= abs(target_tier - tier))
            SELECT doc_id, target_tier AS final_tier, from_tier, to_tier FROM aimed LEFT JOIN steps USING (doc_id)""",
        "migration_capped_passes": "WITH RECURSIVE " + _MOVES + """,
            flagged AS (SELECT *, CAST(abs(target_tier - tier) = 2 AS INTEGER) AS two FROM wanted),
            counted AS (SELECT place, sum(two) OVER (ORDER BY place) AS upto FROM flagged),
            begins AS (
              SELECT CAST(0 AS BIGINT) AS pass, CAST(0 AS BIGINT) AS before
              UNION ALL
              SELECT pass + 1, CAST((pass + 1) * 20 - coalesce(c.upto, 0) AS BIGINT)
              FROM begins LEFT JOIN counted c ON c.place = before WHERE before < (SELECT count(*) FROM wanted)),
            started AS (
              SELECT w.*, (SELECT max(pass) FROM begins WHERE before < w.place) + 1 AS first_pass FROM wanted w)
            SELECT doc_id, CAST(tier + sign(target_tier - tier) * (step - 1) AS INTEGER) AS from_tier,
                   CAST(tier + sign(target_tier - tier) * step AS INTEGER) AS to_tier, CAST(first_pass + step - 1 AS INTEGER) AS pass
            FROM started JOIN (VALUES (1), (2)) p(step) ON step <= abs(target_tier - tier)""",
        "force_migration": with_ + _FORCED + """
            SELECT doc_id, target_tier, from_tier,
                   CAST(from_tier IS NOT NULL AND target_tier BETWEEN 1 AND 3 AS INTEGER) AS success,
                   CAST(coalesce(abs(reach - from_tier), 0) AS BIGINT) AS n_steps,
                   CASE WHEN from_tier IS NOT NULL THEN reach END AS end_tier FROM forced""",
        "migration_history": with_ + _FORCED + """
            SELECT doc_id, CAST(abs(reach - from_tier) AS BIGINT) AS n_moves, '2024-01-31 00:00:00.000000' AS first_ts,
                   '2024-01-31 00:00:00.000000' AS last_ts, from_tier AS first_from, reach AS last_to
            FROM forced WHERE from_tier <> reach""",
        "migration_moves": with_ + _FORCED + """
            SELECT doc_id, CAST(move AS INTEGER) AS move, '2024-01-31 00:00:00.000000' AS ts,
                   CAST(from_tier + sign(reach - from_tier) * (move - 1) AS INTEGER) AS from_tier,
                   CAST(from_tier + sign(reach - from_tier) * move AS INTEGER) AS to_tier
            FROM (SELECT *, unnest(range(1, abs(reach - from_tier) + 1)) AS move FROM forced WHERE from_tier <> reach)""",
        "migration_stats": with_ + _MOVES + """
            SELECT count(*) AS total_migrations FROM wanted
            WHERE TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR * (doc_id % 48) > TIMESTAMP '2024-01-30 00:00:00'""",
        "status_report": with_ + _MOVES + """,
            after AS (SELECT coalesce(m.to_tier, c.tier) AS tier FROM current c LEFT JOIN capped m USING (doc_id))
            SELECT 'migrations' AS section, 'total' AS key, CAST(count(*) AS DOUBLE) AS value FROM capped
            UNION ALL SELECT 'tier_distribution', CAST(tier AS VARCHAR), CAST(count(*) AS DOUBLE) FROM after GROUP BY tier
            UNION ALL SELECT 'top_documents', CAST(doc_id AS VARCHAR), round(score, 6) FROM (
              SELECT * FROM scores ORDER BY scores.score DESC, first_access, doc_id LIMIT 5)
            UNION ALL SELECT 'access_thresholds', 'tier1', 0.7 UNION ALL SELECT 'access_thresholds', 'tier2', 0.3
            UNION ALL SELECT 'temperature_thresholds', 'tier1', 0.9 UNION ALL SELECT 'temperature_thresholds', 'tier2', 0.7""",
        "latency_stats_nearest_rank": with_ + _LOG + "," + _nearest("system") + """
            SELECT system, n, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max, round(median, 6) AS median,
                   round(p95, 6) AS p95, round(p99, 6) AS p99 FROM nearest""",
        "latency_stats_linear": with_ + _LOG + """
            SELECT system, count(*) AS n, round(avg(latency_ms), 6) AS mean, round(min(latency_ms), 6) AS min,
                   round(max(latency_ms), 6) AS max, round(median(latency_ms), 6) AS median,
                   round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99
            FROM log GROUP BY system""",
        "latency_compare": _COMPARED + """
            SELECT threshold, system, round(baseline_mean, 6) AS baseline_mean, round(tiered_mean, 6) AS tiered_mean,
                   round(baseline_p95, 6) AS baseline_p95, round(tiered_p95, 6) AS tiered_p95,
                   round(baseline_median, 6) AS baseline_median, round(tiered_median, 6) AS tiered_median,
                   round(baseline_p99, 6) AS baseline_p99, round(tiered_p99, 6) AS tiered_p99,
                   round(retention_pct, 6) AS retention_pct, round(mean_diff, 6) AS mean_diff,
                   round(mean_diff_pct, 6) AS mean_diff_pct, round(p95_diff, 6) AS p95_diff,
                   round(p95_diff_pct, 6) AS p95_diff_pct, round(improvement_pct, 6) AS improvement_pct FROM compared""",
        "storage_report": _storage(),
        "stream_access_stats": _ACCESS_ROWS,
        "stream_access_dedup": _ACCESS_ROWS,
        "stream_store": with_ + _STORE + """
            SELECT vec_id AS seq, CASE WHEN outcome = 'ok' THEN tier END AS tier,
                   CASE WHEN outcome = 'ok' THEN CAST(dim AS INTEGER) END AS dim,
                   CASE WHEN outcome = 'ok' THEN round(temperature, 6) END AS temperature, outcome FROM outcomes""",
        "stream_retrieve": with_ + _cascade("vec") + _HITS,
        "stream_decay": _decay(),
        "stream_access_redelivered": _ACCESS_ROWS,
        "stream_migrate": with_ + _MOVES + _after("wanted"),
    }
