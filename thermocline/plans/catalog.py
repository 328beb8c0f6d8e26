"""The registered queries: every operator over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions import text, tiers, vectors
from thermocline.operators import (
    access,
    ann,
    bucket_store,
    inverted_file,
    maintained,
    metrics,
    migration,
    retrieval,
    sketches,
    sweep,
    tier_table,
    tiering,
)
from thermocline.operators.similarity import document_warmth
from thermocline.plans import bindings as b
from thermocline.plans import lifecycle
from thermocline.session import materialize, scratch_path
from thermocline.sources import logs, queries as query_sources, vectors as vector_sources
from thermocline.streaming import decay, jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _register(query: Query) -> Query:
    _QUERIES[query.__name__] = query
    return query


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _r(column: Column | str, name: str | None = None) -> Column:
    column_ = F.col(column) if isinstance(column, str) else column
    return F.round(column_, 6).alias(name or column)


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


# -- sources and sinks -------------------------------------------------------


@_register
def scan_vectors(spark, sf):
    return b.all_queries(spark, sf).select("query_id", "split", vectors.dimension("embedding").alias("dim"))


@_register
def corpus_ingest(spark, sf):
    path = scratch_path(spark, "corpus")
    vector_sources.ingest_corpus(b.vectors(spark, sf), path)
    stored = spark.read.schema("doc_id bigint, embedding array<float>").parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return stored.select("doc_id", F.size("embedding").alias("dim"), _r(total, "component_sum"))


@_register
def ingest_validate(spark, sf):
    parsed = vector_sources.parse_store_requests(b.store_requests(spark, sf), dimension=b.DIMENSION)
    return parsed.select("seq", "doc_id", _r("temperature"), "tier", F.coalesce("reason", F.lit("ok")).alias("outcome"))


@_register
def query_texts_json(spark, sf):
    path = scratch_path(spark, "query-texts")
    # each text travels as a JSON array of its lines inside a JSON object per row
    lines = F.to_json(F.split("query_text", "\n"))
    query_sources.write_query_texts(b.query_texts(spark, sf).withColumn("query_text", lines), path)
    stored = query_sources.read_query_texts(spark, path)
    return query_sources.explode_texts(stored, "query_text").select(
        "query_id", F.col("pos").alias("line_no"), F.col("query_text").alias("line")
    )


@_register
def query_log_roundtrip(spark, sf):
    path = scratch_path(spark, "query-log")
    logs.write_query_log(b.latency_log(spark, sf), path)
    return logs.read_query_log(spark, path).select("query_id", _r("latency_ms"), "system")


@_register
def multi_log_scan(spark, sf):
    root = scratch_path(spark, "named-logs")
    logs.write_named_logs(b.latency_log(spark, sf), root)
    return logs.read_named_logs(spark, root).groupBy("system", "threshold").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("latency_ms"), "mean")
    )


@_register
def tier_table_roundtrip(spark, sf):
    build = b.tier_build(spark, sf)
    path = scratch_path(spark, "tier-table")
    assigned = build.assignment
    # a store that starts with everything warm, then each tier is rebuilt from the saved assignment
    tier_table.save_tiers(tier_table.single_tier(assigned.drop("tier"), tiers.WARM), path)
    for tier in (tiers.HOT, tiers.WARM, tiers.COLD):
        tier_table.rebuild_tier(spark, path, assigned, tier)
    stored = tier_table.load_tiers(spark, path, assigned.schema)
    return stored.select("doc_id", _r("temperature"), "tier", _r("tier1_threshold"), _r("tier2_threshold"))


@_register
def embedding_cache_grown(spark, sf):
    """The cache after the vectors of its misses were added; sums show whose vector an entry holds."""
    texts = b.query_texts(spark, sf)
    embedded = lambda vectors: texts.join(vectors, "query_id")
    cache = query_sources.one_entry_per_text(query_sources.cache_entries(embedded(b.workload(spark, sf)), "given"))
    fresh = query_sources.cache_entries(embedded(b.held_out(spark, sf)), "later")
    grown = query_sources.append_to_cache(cache, fresh)
    return grown.select("query_md5", "model", "dimension")


@_register
def tier_clear(spark, sf):
    """One tier rebuilt to nothing, accessed documents deleted from the others; read back with vector sums."""
    stored = b.tiered_docs(spark, sf)
    path = scratch_path(spark, "tier-cleared")
    tier_table.save_tiers(stored, path)
    tier_table.rebuild_tier(spark, path, stored.where(F.lit(False)), tiers.WARM)
    tier_table.delete_documents(spark, path, stored.schema, b.accesses(spark, sf))
    left = tier_table.load_tiers(spark, path, stored.schema)
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return left.select("doc_id", "tier", _r("temperature"), _r(total, "component_sum"))


@_register
def tier_upsert(spark, sf):
    return tier_table.upsert(b.initial_registrations(spark, sf), b.event_registrations(spark, sf)).select(
        "tier", "doc_id", "seq"
    )


def _bucket_store(spark, sf):
    """The migration keys' tier map with vectors, stored by tier and bucket."""
    stored = b.initial_registrations(spark, sf).join(b.doc_vectors(spark, sf), "doc_id")
    return bucket_store.create(stored, scratch_path(spark, "bucket-store"), 8)


def _checksums(df, *more):
    """Rows of a store with the sum of each vector's components."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select("doc_id", "tier", "seq", _r(total, "component_sum"), *more)


@_register
def store_upsert(spark, sf):
    """Every event stores its document's vector again, doubled; only touched folders are written."""
    store = _bucket_store(spark, sf)
    doubled = b.doc_vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
    bucket_store.upsert(store, b.event_registrations(spark, sf).join(doubled, "doc_id"))
    return _checksums(bucket_store.read(spark, store))


@_register
def store_move(spark, sf):
    """The moves of a migration pass on stored vectors, with the old copy removed and kept."""
    _, log = migration.migration_pass(b.current_tiers(spark, sf), b.scores(spark, sf), b.as_of(), cap=None)
    moved, copied = _bucket_store(spark, sf), _bucket_store(spark, sf)
    bucket_store.move(moved, log)
    bucket_store.move(copied, log, remove=False)
    mode = lambda store, name: _checksums(bucket_store.read(spark, store), F.lit(name).alias("mode"))
    return mode(moved, "move").unionByName(mode(copied, "copy"))


@_register
def store_delete(spark, sf):
    store = _bucket_store(spark, sf)
    bucket_store.delete(store, b.accesses(spark, sf))
    return _checksums(bucket_store.read(spark, store))


@_register
def register_tiers(spark, sf):
    return migration.register_tiers(
        b.initial_registrations(spark, sf).unionByName(b.event_registrations(spark, sf))
    ).select("doc_id", "tier", "seq")


@_register
def tier_get(spark, sf):
    found = tier_table.get_documents(b.tiered_docs(spark, sf), b.accesses(spark, sf))
    return found.select("doc_id", "tier", "dim", _r(F.element_at("embedding", 1).cast("double"), "first_component"))


@_register
def tier_delete(spark, sf):
    kept = tier_table.without_documents(b.tiered_docs(spark, sf), b.accesses(spark, sf))
    return kept.select("doc_id", "tier", _r("temperature"))


@_register
def embedding_cache_split(spark, sf):
    texts = b.query_texts(spark, sf)
    known = texts.join(b.workload(spark, sf), "query_id")
    cache = query_sources.one_entry_per_text(query_sources.cache_entries(known, "given"))
    hits, misses = query_sources.cache_lookup(texts, cache)
    return hits.select("query_md5", "query_id", "n_queries", F.lit("hit").alias("outcome"), "dimension").unionByName(
        misses.select("query_md5", "query_id", "n_queries", F.lit("miss").alias("outcome"),
                      F.lit(None).cast("int").alias("dimension"))
    )


# -- projections and scalar functions ----------------------------------------


@_register
def l2_normalize(spark, sf):
    unit = vector_sources.normalize(b.scaled_vectors(spark, sf))
    return unit.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", "pos", _r(F.col("x").cast("double"), "x")
    )


@_register
def zero_query_guard(spark, sf):
    asked = b.scaled_vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieval.threshold_topk(b.doc_vectors(spark, sf), asked, b.K, b.THRESHOLD)
    flagged = retrieval.zero_queries(asked).select("query_id", "is_zero")
    return flagged.join(retrieval.results_per_query(asked, hits), "query_id").select(
        "query_id", F.col("is_zero").cast("int").alias("is_zero"), "n_results", _r("avg_score")
    )


@_register
def tier_by_temperature(spark, sf):
    relative = tiering.relative_temperatures(b.tier_build(spark, sf).assignment.select("doc_id", "temperature"))
    return tiering.assign_by_temperature(relative).select("doc_id", _r("temperature"), "tier")


@_register
def tier_by_access_score(spark, sf):
    return tiering.assign_by_access_score(b.scores(spark, sf)).select("doc_id", _r("score"), "tier")


@_register
def tier_by_percentile(spark, sf):
    return b.tier_build(spark, sf).assignment.select(
        "doc_id", _r("temperature"), "tier", _r("tier1_threshold"), _r("tier2_threshold")
    )


@_register
def doc_key_codec(spark, sf):
    key = b.doc_vectors(spark, sf).select("doc_id", text.doc_key(F.col("doc_id")).alias("doc_key"))
    return key.withColumn("decoded", text.doc_id_of_key(F.col("doc_key")))


# -- similarity and retrieval ------------------------------------------------


@_register
def cosine_pairs(spark, sf):
    pairs = retrieval.similar_pairs(b.doc_vectors(spark, sf), b.held_out(spark, sf), b.THRESHOLD)
    return pairs.select("query_id", "doc_id", _r("score"), _r("distance"))


@_register
def similarity_profile(spark, sf):
    warmth = document_warmth(b.doc_vectors(spark, sf), b.held_out(spark, sf), profile=True)
    return warmth.select(
        "doc_id", _r("sim_min"), _r("sim_max"), _r(F.col("sim_sum") / F.col("n_queries"), "sim_mean"), "n_queries"
    )


@_register
def doc_temperature(spark, sf):
    return tiering.temperatures(b.doc_vectors(spark, sf), b.workload(spark, sf)).select("doc_id", _r("temperature"))


@_register
def temperature_maintained(spark, sf):
    """Three rounds of changed queries and documents instead of a rebuild."""
    label = F.col("label")
    docs = b.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    part = lambda df, n: df.where(F.pmod("query_id", F.lit(3)) == n)
    work, others = b.workload(spark, sf), b.held_out(spark, sf)
    state = maintained.warm_up(docs.where(~label.isin(0, 1)), part(work, 0).unionByName(part(others, 0)))
    now = part(work, 0).unionByName(part(work, 1)).unionByName(part(others, 0))
    state = maintained.change(state, now, added_queries=part(work, 1), added_docs=docs.where(label == 0))
    now = part(work, 0).unionByName(part(work, 1))
    state = maintained.change(state, now, removed_queries=part(others, 0), removed_docs=docs.where(label == 9))
    state = maintained.change(state, work, added_queries=part(work, 2), added_docs=docs.where(label == 1))
    return maintained.temperatures_of(state).select("doc_id", _r("temperature"))


@_register
def temperature_sketches(spark, sf):
    """Tier cut-offs from sketches of seven parts, merged; exact ranks say how far off they are."""
    temps = b.tier_build(spark, sf).assignment.select("doc_id", "temperature").withColumn("part", F.col("doc_id") % 7)
    whole = sketches.merged(sketches.sketches(temps, ["part"], "temperature"), [])
    found = sketches.quantiles(whole, [], tiers.PERCENTILE_CUTS)
    errors = sketches.rank_errors(temps, [], "temperature", found)
    return errors.select("share", "n", (F.col("rank_error") <= sketches.RANK_ERROR).alias("close"))


@_register
def temperature_stats(spark, sf):
    stats = tiering.temperature_stats(tiering.temperatures(b.doc_vectors(spark, sf), b.workload(spark, sf)))
    return stats.select("n_docs", *[_r(c) for c in stats.columns if c != "n_docs"])


@_register
def tier_distribution(spark, sf):
    return tiering.tier_distribution(b.tiered_docs(spark, sf))


def _hits_columns(hits):
    return hits.select("query_id", "rank", "doc_id", _r("score"), "tier", "source")


@_register
def cascade_topk(spark, sf):
    return _hits_columns(retrieval.cascade_topk(b.tiered_docs(spark, sf), b.held_out(spark, sf), b.K, b.THRESHOLD))


@_register
def cascade_staged(spark, sf):
    return _hits_columns(retrieval.cascade_staged(b.tiered_docs(spark, sf), b.held_out(spark, sf), b.K, b.THRESHOLD))


@_register
def cascade_sweep(spark, sf):
    hits = retrieval.cascade_sweep(b.tiered_docs(spark, sf), b.held_out(spark, sf), b.K, b.THRESHOLDS)
    return hits.select("threshold", "query_id", "rank", "doc_id", _r("score"), "tier", "source")


@_register
def baseline_topk(spark, sf):
    store = tier_table.single_tier(b.doc_vectors(spark, sf), tiers.COLD)
    hits = retrieval.baseline_topk(store, b.held_out(spark, sf), b.K, b.THRESHOLD)
    return hits.select("query_id", "rank", "doc_id", _r("score"))


@_register
def threshold_search(spark, sf):
    hot = b.tiered_docs(spark, sf).where(F.col("tier") == tiers.HOT)
    hits = retrieval.threshold_topk(hot, b.held_out(spark, sf), b.K, b.THRESHOLD)
    return hits.select("query_id", "rank", "doc_id", _r("score"))


@_register
def ann_topk(spark, sf):
    """Approximate, so it has no SQL twin; tests compare it with exact search."""
    index = ann.build_cells(b.doc_vectors(spark, sf), cells=16)
    return ann.ann_topk(index, b.held_out(spark, sf), b.K, b.THRESHOLD, probes=12)


@_register
def ann_all_cells(spark, sf):
    """The index probed in all its cells: exact."""
    index = ann.build_cells(b.doc_vectors(spark, sf), cells=16)
    return ann.ann_topk(index, b.held_out(spark, sf), b.K, b.THRESHOLD, probes=16).select("query_id", "rank", "doc_id", _r("score"))


@_register
def cascade_indexed(spark, sf):
    """The cascade with colder tiers read through the inverted file, all cells probed: exact."""
    return _hits_columns(inverted_file.cascade_indexed(
        b.indexed(spark, sf), b.tiered_docs(spark, sf), b.held_out(spark, sf), b.K, b.THRESHOLD, probes=None))


def _recall(found, wanted):
    """Hits of the exact answer, and whether 95 of 100 are found."""
    both = wanted.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("recall_reached"))


@_register
def cascade_indexed_recall(spark, sf):
    """Most cells probed, the cold tier scored by its codes first."""
    tiered, asked = b.tiered_docs(spark, sf), b.held_out(spark, sf)
    found = inverted_file.cascade_indexed(
        b.indexed(spark, sf), tiered, asked, b.K, b.THRESHOLD, probes=b.CELLS - 2, compressed=(tiers.COLD,))
    return _recall(found, retrieval.cascade_topk(tiered, asked, b.K, b.THRESHOLD))


@_register
def codes_recall(spark, sf):
    """Top-k over all tiers by codes and reranking, against the exact scan."""
    asked = b.held_out(spark, sf)
    found = inverted_file.search(b.indexed(spark, sf), None, asked, b.K, None, None, codes=True)
    return _recall(found, retrieval.baseline_topk(b.doc_vectors(spark, sf), asked, b.K))


@_register
def pruned_pairs(spark, sf):
    """The threshold join through the inverted file."""
    pairs = inverted_file.similar_pairs(b.indexed(spark, sf), b.held_out(spark, sf), b.THRESHOLD)
    return pairs.select("query_id", "doc_id", _r("score"), _r("distance"))


def _near_copy_index(spark, sf):
    docs = tier_table.single_tier(b.near_copies(spark, sf), tiers.COLD)
    return inverted_file.build(docs, scratch_path(spark, "near-copies"), b.CELLS, block_rows=8)


@_register
def near_copy_leakage(spark, sf):
    """Documents that are near copies of held-out queries."""
    pairs = inverted_file.similar_pairs(_near_copy_index(spark, sf), b.held_out(spark, sf), b.NEAR)
    return pairs.select("query_id", "doc_id", _r("score"))


@_register
def near_copy_pruning(spark, sf):
    """All pairs of that join, and whether more than half of them were skipped."""
    share = inverted_file.scored_share(_near_copy_index(spark, sf), b.held_out(spark, sf), b.NEAR)
    return share.select("pairs", (F.col("scored") * 2 < F.col("pairs")).alias("half_skipped"))


@_register
def enrich_hits(spark, sf):
    hits = retrieval.cascade_topk(b.tiered_docs(spark, sf), b.held_out(spark, sf), b.K, b.THRESHOLD)
    return retrieval.enrich(hits, b.doc_meta(spark, sf)).select("query_id", "rank", "doc_key", "title", "snippet")


@_register
def sample_query_results(spark, sf):
    asked = b.held_out(spark, sf)
    hits = retrieval.cascade_topk(b.tiered_docs(spark, sf), asked, b.K, b.THRESHOLD)
    sample = retrieval.sample_results(asked, hits, b.query_texts(spark, sf), 5)
    one = lambda hit: F.concat_ws(":", hit["rank"].cast("string"), hit["doc_id"].cast("string"), hit["source"])
    return sample.select(
        "query_id", "query_text", F.coalesce(F.concat_ws(";", F.transform("results", one)), F.lit("")).alias("results")
    )


@_register
def tier_hit_rates(spark, sf):
    hits = retrieval.cascade_topk(b.tiered_docs(spark, sf), b.held_out(spark, sf), b.K, b.THRESHOLD)
    return metrics.tier_hit_rates(hits).select("tier", "hits", _r("hit_pct"))


@_register
def result_quality(spark, sf):
    asked = b.held_out(spark, sf)
    hits = retrieval.cascade_topk(b.tiered_docs(spark, sf), asked, b.K, b.THRESHOLD)
    hits = materialize(hits, "hits")  # reported twice
    report = metrics.result_quality(asked, hits).withColumn("scope", F.lit("all")).unionByName(
        metrics.result_quality(asked, hits, 5).withColumn("scope", F.lit("first 5"))
    )
    return report.select("scope", "n_queries", "n_results", _r("avg_results"), _r("avg_similarity"))


@_register
def threshold_report(spark, sf):
    asked = b.held_out(spark, sf)
    report = lifecycle.evaluate(
        b.tiered_docs(spark, sf), asked, b.latency_log(spark, sf), b.K, b.THRESHOLDS, b.BASELINE, b.TIERED
    )
    report = materialize(report, "threshold-report")
    return report.select(
        "threshold", "total_hits", *[_r(c) for c in report.columns if c not in ("threshold", "total_hits")]
    )


@_register
def sweep_points(spark, sf):
    """The quality report at every threshold from the highest of the three on at which a result changes."""
    points = sweep.quality_at_every_threshold(b.tiered_docs(spark, sf), b.held_out(spark, sf), b.K, max(b.THRESHOLDS))
    return points.select(_r("threshold"), "total_hits", *[_r(c) for c in points.columns if c not in ("threshold", "total_hits")])


@_register
def sweep_report(spark, sf):
    """The same sweep from the lowest threshold on, looked up at the three."""
    points = sweep.quality_at_every_threshold(b.tiered_docs(spark, sf), b.held_out(spark, sf), b.K, min(b.THRESHOLDS))
    found = sweep.quality_at(points, b.THRESHOLDS)
    return found.select("threshold", "total_hits", *[_r(c) for c in found.columns if c not in ("threshold", "total_hits")])


# -- query sets --------------------------------------------------------------


@_register
def query_slice(spark, sf):
    return query_sources.query_slice(b.query_texts(spark, sf), 50, 20).select("query_id", "query_text")


@_register
def incremental_queries(spark, sf):
    existing = b.workload(spark, sf).select("query_id")
    incoming = b.all_queries(spark, sf).select("query_id")
    wanted = incoming.count() * 4 // 5
    return query_sources.incremental_queries(existing, incoming, wanted).select("query_id", "origin")


@_register
def query_leakage(spark, sf):
    texts = b.query_texts(spark, sf)
    seen = b.accesses(spark, sf).select(F.col("doc_id").alias("query_id"))
    return query_sources.query_leakage(query_sources.split_queries(texts, seen))


# -- access ------------------------------------------------------------------


@_register
def access_stats(spark, sf):
    stats = access.access_stats(b.accesses(spark, sf), b.AS_OF)
    records = access.access_records(b.doc_vectors(spark, sf), stats, b.AS_OF)
    return records.select("doc_id", "total_accesses", _stamp("last_access"), _r("score"))


@_register
def access_score(spark, sf):
    return b.scores(spark, sf).select("doc_id", "total_accesses", _r("score"))


@_register
def top_accessed(spark, sf):
    return access.top_accessed(b.scores(spark, sf), 10).select("doc_id", _r("score"))


# -- migration ---------------------------------------------------------------


@_register
def migration_candidates(spark, sf):
    found = migration.migration_candidates(b.current_tiers(spark, sf), b.scores(spark, sf), tiers.MIGRATION_CAP)
    return found.select("doc_id", "seq", "tier", "target_tier", _r("score"), "action")


@_register
def migration_pass(spark, sf):
    new, log = migration.migration_pass(b.current_tiers(spark, sf), b.scores(spark, sf), b.as_of(), tiers.MIGRATION_CAP)
    moved = log.select("doc_id", "from_tier", "kind")
    return new.join(moved, "doc_id", "left").select("doc_id", "tier", "from_tier", "kind")


@_register
def migration_pass_uncapped(spark, sf):
    new, log = migration.migration_pass(b.current_tiers(spark, sf), b.scores(spark, sf), b.as_of(), cap=None)
    moved = log.select("doc_id", "from_tier", "kind")
    return new.join(moved, "doc_id", "left").select("doc_id", "tier", "from_tier", "kind")


@_register
def apply_moves(spark, sf):
    current = b.current_tiers(spark, sf)
    _, log = migration.migration_pass(current, b.scores(spark, sf), b.as_of(), cap=None)
    moved = migration.apply_moves(current, log)
    copied = migration.apply_moves(current, log, remove=False, shared=True)
    mode = lambda df, name: df.select("doc_id", "tier", F.lit(name).alias("mode"))
    return mode(moved, "move").unionByName(mode(copied, "copy"))


@_register
def migration_converge(spark, sf):
    new, log = migration.migrate_until_stable(b.current_tiers(spark, sf), b.scores(spark, sf), b.as_of())
    end = new.select("doc_id", F.col("tier").alias("final_tier"))
    return end.join(log.select("doc_id", "pass", "from_tier", "to_tier"), "doc_id", "left")


@_register
def force_migration(spark, sf):
    outcome, log, new = migration.force_migration(b.current_tiers(spark, sf), b.forced_requests(spark, sf), b.as_of())
    steps = log.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_steps"))
    ends = new.select("doc_id", F.col("tier").alias("end_tier"))
    return outcome.join(steps, "doc_id", "left").join(ends, "doc_id", "left").select(
        "doc_id", "target_tier", "from_tier", F.col("success").cast("int").alias("success"),
        F.coalesce("n_steps", F.lit(0).cast("bigint")).alias("n_steps"), "end_tier",
    )


@_register
def migration_history(spark, sf):
    _, log, _ = migration.force_migration(b.current_tiers(spark, sf), b.forced_requests(spark, sf), b.as_of())
    history = migration.migration_history(log)
    return history.select("doc_id", "n_moves", _stamp("first_ts"), _stamp("last_ts"), "first_from", "last_to")


@_register
def migration_moves(spark, sf):
    _, log, _ = migration.force_migration(b.current_tiers(spark, sf), b.forced_requests(spark, sf), b.as_of())
    return migration.migration_moves(log).select("doc_id", "move", _stamp("ts"), "from_tier", "to_tier")


@_register
def migration_capped(spark, sf):
    """Capped passes until stable; the cap is a third of the documents, so the passes grow with nothing."""
    current = b.current_tiers(spark, sf)
    cap = max(1, current.count() // 3)
    new, log = migration.migrate_capped_until_stable(current, b.scores(spark, sf), b.as_of(), cap)
    end = new.select("doc_id", F.col("tier").alias("final_tier"))
    return end.join(log.select("doc_id", "from_tier", "to_tier"), "doc_id", "left")


@_register
def migration_capped_passes(spark, sf):
    """The pass of every step under the standard cap."""
    _, log = migration.migrate_capped_until_stable(
        b.current_tiers(spark, sf), b.scores(spark, sf), b.as_of(), tiers.MIGRATION_CAP)
    return log.select("doc_id", "from_tier", "to_tier", "pass")


def _shifted_log(spark, sf):
    """Log of an uncapped pass whose moves lie up to two days back."""
    back = F.timestamp_add("HOUR", (-(F.col("doc_id") % 48)).cast("int"), b.as_of())
    return migration.migration_pass(b.current_tiers(spark, sf), b.scores(spark, sf), back, cap=None)[1]


@_register
def migration_stats(spark, sf):
    return migration.migration_stats(_shifted_log(spark, sf), b.as_of(), 24)


@_register
def status_report(spark, sf):
    new, log = migration.migration_pass(b.current_tiers(spark, sf), b.scores(spark, sf), b.as_of(), tiers.MIGRATION_CAP)
    report = migration.status_report(new, log, b.scores(spark, sf))
    return report.select("section", "key", _r("value"))


# -- reports -----------------------------------------------------------------


def _rounded(stats, plain):
    return stats.select(*plain, *[_r(c) for c in stats.columns if c not in plain])


@_register
def latency_stats_nearest_rank(spark, sf):
    return _rounded(metrics.latency_stats_nearest_rank(b.latency_log(spark, sf), ["system"]), ["system", "n"])


@_register
def latency_stats_linear(spark, sf):
    return _rounded(metrics.latency_stats_linear(b.latency_log(spark, sf), ["system"]), ["system", "n"])


@_register
def latency_sketches(spark, sf):
    """Percentiles per system from stored sketches of single days."""
    log = b.table(spark, sf, "events").select(
        F.col("event_type").alias("system"), F.to_date("ts").alias("day"), F.col("value").alias("latency_ms"))
    days = materialize(sketches.sketches(log, ["system", "day"], "latency_ms"), "day-sketches")
    found = sketches.quantiles(sketches.merged(days, ["system"]), ["system"], (0.5, 0.95, 0.99))
    errors = sketches.rank_errors(log, ["system"], "latency_ms", found)
    return errors.select("system", "share", "n", (F.col("rank_error") <= sketches.RANK_ERROR).alias("close"))


@_register
def latency_compare(spark, sf):
    stats = metrics.latency_stats_nearest_rank(b.latency_log(spark, sf), ["system", "threshold"])
    return _rounded(metrics.latency_compare(stats, b.BASELINE), ["threshold", "system"])


@_register
def storage_report(spark, sf):
    report = metrics.storage_report(b.tiered_docs(spark, sf).select("tier", "dim"))
    gb = [c for c in report.columns if c.endswith("_gb")]
    # shown in MiB, so six places keep their meaning on small tables
    return report.select(
        "baseline_type", "n_tier1", "n_tier2", "n_tier3", _r("saved_pct"),
        *[_r(F.col(c) * 1024, c.replace("_gb", "_mib")) for c in gb],
    )


# -- streaming ---------------------------------------------------------------


def _event_stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    stream = jobs.stream_stored(spark, sf, "events", schema)
    return stream.select("event_id", F.col("user_id").alias("doc_id"), "ts")


@_register
def stream_access_stats(spark, sf):
    path = scratch_path(spark, "stream-access")
    jobs.count_accesses(_event_stream(spark, sf), path).awaitTermination()
    return jobs.read_access_counts(spark, path).select("doc_id", "total_accesses", _stamp("last_access"))


@_register
def stream_access_dedup(spark, sf):
    path = scratch_path(spark, "stream-access-once")
    # every event is delivered twice and counted once
    twice = _event_stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    jobs.count_accesses(twice, path, once=True).awaitTermination()
    counts = jobs.read_access_counts(spark, path)
    return counts.select("doc_id", "total_accesses", _stamp("last_access"))


@_register
def stream_store(spark, sf):
    path = scratch_path(spark, "stream-store")
    folder = scratch_path(spark, "store-requests")
    b.store_requests(spark, sf).write.parquet(folder)
    requests = jobs.stream_table(spark, folder, "body string, seq bigint")
    jobs.store_documents(requests, path, dimension=b.DIMENSION).awaitTermination()
    stored = jobs.read_stored(spark, path).select(
        "seq", "tier", F.size("embedding").alias("dim"), _r("temperature"), F.lit("ok").alias("outcome")
    )
    refused = jobs.read_rejected(spark, path).select(
        "seq", F.lit(None).cast("int").alias("tier"), F.lit(None).cast("int").alias("dim"),
        F.lit(None).cast("double").alias("temperature"), F.col("reason").alias("outcome"),
    )
    return stored.unionByName(refused)


@_register
def stream_retrieve(spark, sf):
    path = scratch_path(spark, "stream-answers")
    asked = jobs.stream_stored(spark, sf, "embeddings", b.vectors(spark, sf).schema)
    asked = asked.select(F.col("vec_id").alias("query_id"), "embedding")
    jobs.answer_queries(asked, b.tiered_docs(spark, sf), path, b.K, b.THRESHOLD).awaitTermination()
    return _hits_columns(jobs.read_answers(spark, path))


@_register
def stream_migrate(spark, sf):
    path = scratch_path(spark, "stream-migrate")
    current = b.current_tiers(spark, sf)
    jobs.migrate_on_access(_event_stream(spark, sf), current, path, b.AS_OF, b.as_of(), None).awaitTermination()
    log = jobs.read_migration_log(spark, path)
    moved = log.select("doc_id", "from_tier", "kind")
    return jobs.current_tiers(current, log).join(moved, "doc_id", "left").select("doc_id", "tier", "from_tier", "kind")


@_register
def stream_decay(spark, sf):
    """Moves by keyed state and timers: the access log arrives in four files, one pass after each."""
    folder, path = scratch_path(spark, "decay-events"), scratch_path(spark, "stream-decay")
    for start, end in zip(b.ARRIVALS, b.ARRIVALS[1:]):
        day = F.dayofmonth("ts")
        b.accesses(spark, sf).where((day >= start) & (day < end)).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.stream_table(spark, folder, b.accesses(spark, sf).schema, max_files=1)
    current = b.current_tiers(spark, sf)
    decay.migrate_on_time(stream, current, path).awaitTermination()
    log = jobs.read_migration_log(spark, path)
    return log.select("doc_id", _stamp("ts"), "from_tier", "to_tier", "kind")


@_register
def stream_access_redelivered(spark, sf):
    """Three deliveries, each the events of a third of the days and all of the delivery before: counted once."""
    folder, path = scratch_path(spark, "redelivered"), scratch_path(spark, "stream-redelivered")
    part = F.dayofmonth("ts") % 3
    for number in range(3):
        b.accesses(spark, sf).where(part.isin(number, number - 1)).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.stream_table(spark, folder, b.accesses(spark, sf).schema, max_files=1)
    jobs.count_accesses(stream, path, once=True).awaitTermination()
    return jobs.read_access_counts(spark, path).select("doc_id", "total_accesses", _stamp("last_access"))
