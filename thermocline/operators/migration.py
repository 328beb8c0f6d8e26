"""Planning, applying and logging tier moves.

``tiers(doc_id, tier, seq, ...)`` is the single truth; a move and its log row
always come from the same rows. ``log(doc_id, ts, from_tier, to_tier, kind)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermocline.functions import tiers as rules
from thermocline.operators.access import top_accessed
from thermocline.operators.schedule import first_passes
from thermocline.operators.tiering import tier_distribution

AUTO, FORCED = "auto", "forced"


def register_tiers(assignments: DataFrame) -> DataFrame:
    """Current tier per document from ``(doc_id, tier, seq)`` registrations.

    The latest registration wins, the document keeps its first position.
    """
    return assignments.groupBy("doc_id").agg(F.max_by("tier", "seq").alias("tier"), F.min("seq").alias("seq"))


def _scored(tiers: DataFrame, scores: DataFrame, cuts: tuple[float, float]) -> DataFrame:
    known = scores.select("doc_id", "score")
    return tiers.join(known, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn(
        "target_tier", rules.by_access_score(F.col("score"), cuts)
    )


def migration_candidates(tiers: DataFrame, scores: DataFrame, cap: int | None,
                         cuts: tuple[float, float] = rules.ACCESS_CUTS) -> DataFrame:
    """Documents whose access score asks for another tier, the first ``cap`` in registration order."""
    moving = _scored(tiers, scores, cuts).where(F.col("tier") != F.col("target_tier")).withColumn(
        "action", F.when(F.col("tier") > F.col("target_tier"), "promote").otherwise("demote")
    )
    moving = moving.select("doc_id", "seq", "tier", "target_tier", "score", "action")
    return moving if cap is None else moving.orderBy("seq", "doc_id").limit(cap)


def _one_step(tier: Column, target: Column) -> Column:
    return (tier + F.signum(target - tier)).cast("int")


def _log_rows(moves: DataFrame, ts: Column, kind: str, *extra: str) -> DataFrame:
    return moves.select("doc_id", ts.alias("ts"), "from_tier", "to_tier", F.lit(kind).alias("kind"), *extra)


def migration_pass(tiers: DataFrame, scores: DataFrame, ts: Column, cap: int | None,
                   cuts: tuple[float, float] = rules.ACCESS_CUTS) -> tuple[DataFrame, DataFrame]:
    """One pass: every candidate moves one step. Returns the new tiers and the log rows."""
    candidates = migration_candidates(tiers, scores, cap, cuts)
    moves = candidates.select(
        "doc_id", F.col("tier").alias("from_tier"), _one_step(F.col("tier"), F.col("target_tier")).alias("to_tier")
    )
    log = _log_rows(moves, ts, AUTO)
    if cap is None:  # every row knows its own move, no join back
        moved = _scored(tiers, scores, cuts)
        new = moved.withColumn("tier", _one_step(F.col("tier"), F.col("target_tier"))).select(*tiers.columns)
        return new, log
    return apply_moves(tiers, moves), log


def apply_moves(tiers: DataFrame, moves: DataFrame, remove: bool = True, shared: bool = False) -> DataFrame:
    """Apply ``moves(doc_id, from_tier, to_tier)`` in either direction.

    With ``remove=False`` the old copy stays, so tiers share the document from
    then on. ``shared=True`` says tiers may share documents already: a copy
    moved onto an older one replaces it.
    """
    steps = moves.select("doc_id", F.col("from_tier").alias("tier"), "to_tier")
    joined = tiers.join(steps, ["doc_id", "tier"], "left")
    both = F.array(F.col("tier"), F.col("to_tier"))
    after = F.when(F.col("to_tier").isNull(), F.array(F.col("tier"))).otherwise(
        F.array(F.col("to_tier")) if remove else both
    )
    rest = [c for c in tiers.columns if c != "tier"]
    out = joined.select(*rest, F.col("tier").alias("_was"), F.explode(after).alias("tier"))
    if shared:
        newest = W.partitionBy("tier", "doc_id").orderBy((F.col("_was") != F.col("tier")).desc())
        out = out.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1)
    return out.select(*tiers.columns)


def _walk(moves: DataFrame, *extra: str) -> DataFrame:
    """Every single step from ``tier`` to ``target_tier``; ``step`` counts from 1."""
    path = F.sequence(F.col("tier"), F.col("target_tier"))
    steps = F.transform(
        F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))),
        lambda to, i: F.struct(
            (i + 1).alias("step"), F.element_at(path, i + 1).alias("from_tier"), to.alias("to_tier")
        ),
    )
    return moves.select("doc_id", *extra, F.inline(steps))


def migrate_until_stable(tiers: DataFrame, scores: DataFrame, ts: Column,
                         cuts: tuple[float, float] = rules.ACCESS_CUTS) -> tuple[DataFrame, DataFrame]:
    """Uncapped passes until no candidate is left, as one plan.

    Scores do not change between passes, so a document walks straight to its
    target; the log carries the number of the ``pass`` each step belongs to.
    """
    scored = _scored(tiers, scores, cuts)
    walk = _walk(scored.where(F.col("tier") != F.col("target_tier"))).withColumnRenamed("step", "pass")
    new = scored.withColumn("tier", F.col("target_tier")).select(*tiers.columns)
    return new, _log_rows(walk, ts, AUTO, "pass")


def migrate_capped_until_stable(tiers: DataFrame, scores: DataFrame, ts: Column, cap: int,
                                cuts: tuple[float, float] = rules.ACCESS_CUTS) -> tuple[DataFrame, DataFrame]:
    """Capped passes until no candidate is left, however many that takes, as one plan.

    Every pass moves the first ``cap`` waiting documents in registration order by
    one step. The log carries the ``pass`` of every step.
    """
    if cap < 1:
        raise ValueError("a pass must move a document")
    scored = _scored(tiers, scores, cuts)
    waiting = scored.where(F.col("tier") != F.col("target_tier")).withColumn("steps", F.abs(F.col("target_tier") - F.col("tier")))
    planned = first_passes(waiting.select("doc_id", "seq", "tier", "target_tier", "steps"), ["seq", "doc_id"], cap)
    # a document on its way stays at the front: its second step follows in the next pass
    walk = _walk(planned, "pass").withColumn("pass", F.col("pass") + F.col("step") - 1)
    new = scored.withColumn("tier", F.col("target_tier")).select(*tiers.columns)
    return new, _log_rows(walk, ts, AUTO, "pass")


def force_migration(tiers: DataFrame, requests: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walk each requested document to ``target_tier``: (outcome, log rows, new tiers).

    The latest request for a document counts (by ``seq``, where there is one). An unknown document fails without a move; a
    target outside 1..3 fails after the walk has reached the last real tier.
    """
    current = tiers.select("doc_id", "tier")
    latest = F.max_by("target_tier", "seq") if "seq" in requests.columns else F.max("target_tier")
    requests = requests.groupBy("doc_id").agg(latest.alias("target_tier"))
    asked = requests.select("doc_id", "target_tier").join(current, "doc_id", "left")
    outcome = asked.select(
        "doc_id", "target_tier", F.col("tier").alias("from_tier"),
        (F.col("tier").isNotNull() & F.col("target_tier").between(rules.HOT, rules.COLD)).alias("success"),
    )
    reach = F.least(F.greatest(F.col("target_tier"), F.lit(rules.HOT)), F.lit(rules.COLD))
    known = asked.where(F.col("tier").isNotNull()).withColumn("target_tier", reach)
    log = _log_rows(_walk(known), ts, FORCED, "step")
    ends = known.select("doc_id", F.col("target_tier").alias("_end"))
    new = tiers.join(ends, "doc_id", "left").withColumn("tier", F.coalesce("_end", "tier")).select(*tiers.columns)
    return outcome, log, new


def migration_history(log: DataFrame) -> DataFrame:
    """Per document: number of moves, first and last move. The moves themselves stay rows of the log,
    so a document with very many of them is never gathered into one array."""
    place = F.struct("ts", "step") if "step" in log.columns else F.col("ts")
    return log.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_moves"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("from_tier", place).alias("first_from"), F.max_by("to_tier", place).alias("last_to"),
    )


def migration_moves(log: DataFrame) -> DataFrame:
    """The moves of every document in order: ``(doc_id, move, ts, from_tier, to_tier)``, ``move`` from 1."""
    order = [c for c in ("ts", "pass", "step") if c in log.columns]
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    return log.select("doc_id", place.alias("move"), "ts", "from_tier", "to_tier")


def migration_stats(log: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Moves strictly newer than ``hours`` before ``as_of``."""
    cutoff = F.timestamp_add("HOUR", F.lit(-hours), as_of)
    return log.where(F.col("ts") > cutoff).agg(F.count(F.lit(1)).alias("total_migrations"))


def status_report(tiers: DataFrame, log: DataFrame, scored: DataFrame, top: int = 5,
                  access_cuts: tuple[float, float] = rules.ACCESS_CUTS,
                  temperature_cuts: tuple[float, float] = rules.TEMPERATURE_CUTS) -> DataFrame:
    """``(section, key, value)``: automatic moves so far, documents per tier, top documents, active cut-offs."""
    line = lambda df, section, key, value: df.select(
        F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value")
    )
    moves = log.where(F.col("kind") == AUTO).agg(F.count(F.lit(1)).alias("n"))
    per_tier = tier_distribution(tiers)
    active = [
        (name, f"tier{place}", cut)
        for name, cuts in (("access_thresholds", access_cuts), ("temperature_thresholds", temperature_cuts))
        for place, cut in enumerate(cuts, 1)
    ]
    cut_rows = tiers.sparkSession.createDataFrame(active, "section string, key string, value double")
    return (
        line(moves, "migrations", F.lit("total"), F.col("n"))
        .unionByName(line(per_tier, "tier_distribution", F.col("tier"), F.col("n_docs")))
        .unionByName(line(top_accessed(scored, top), "top_documents", F.col("doc_id"), F.col("score")))
        .unionByName(cut_rows)
    )
