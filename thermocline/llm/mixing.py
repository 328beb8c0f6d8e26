"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the mixture by weight, at most ``MOST`` times
its own size; what a full source leaves over goes to the others by weight until none
is above. Every document of a source then has the same expected copies, target divided by size.
Documents are laid end to end by expected copies, one random offset per source is
added, and a document is emitted once per integer boundary its stretch crosses.

Documents lie in order of size, and a seeded shuffle within a size: prefix
sums of copies stray by less than one from their expectation, so the words taken
stray from the target by less than the longest document. Prefix sums are exact
(integers of 10^-12 copies in decimals), the same in every run.

No window holds a source: ``ranks.ranked`` deals rows into sorted ranges, ranges and
sources are counted. Targets come from one row per source.

Defined results: a null source is the last source; a null or empty text has size
zero and may be taken without adding words; a source of size zero has target zero;
null ids are kept; repeated rows are rows of their own, each emitted up to ``MOST`` times; no rows give no rows.
Columns named size, source_size, target, copies or taken are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thermocline.llm.common import read_table, store
from thermocline.llm.ranks import fresh, ranked

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mixture-1"
WORD = r"[^\x20\x09-\x0D]+"
UNIT = 10 ** 12


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, source_size)``, one row per source.

    Sources are taken in order of cap / weight, the order in which they fill up
    as the level (words per weight) rises: the first that is not full at the level its
    predecessors leave sets the level of all that follow.
    """
    number = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "number")
    weighed = (
        sizes.withColumn("number", F.row_number().over(number))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    )
    everything = Window.partitionBy()
    levels = weighed.withColumn("place", F.row_number().over(fill)).withColumn(
        "level",
        (F.sum("source_size").over(everything)
         - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double")
        / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    ).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)
    return levels.withColumn("first", first).select(
        "source", "source_size",
        F.when(F.col("place") >= F.col("first.place"), F.col("first.level") * F.col("weight"))
        .otherwise(F.col("cap").cast("double")).alias("target"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED,
        order: str = "doc_id") -> DataFrame:
    """``rows`` with ``source_size``, ``target`` (their source's), ``copies`` and ``taken`` (words).

    ``rows`` has ``source``, ``size`` and the column ``order`` that identifies a
    row. All columns travel through one shuffle; callers pass those they need.
    """
    rows = rows.drop("source_size", "target", "copies", "taken")
    label, shuffle, place, share, offset = fresh(rows, "_label", "_shuffle", "_place", "_share", "_offset")
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))  # never null
    bits = lambda text: F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")
    stored = store(rows.withColumn(label, named).withColumn(
        shuffle, F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(order).cast("string"), F.lit("~"))))), "sized")
    sizes = stored.groupBy("source").agg(F.sum("size").alias("source_size"))
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    shares = source_targets(sizes, weights, most).select(
        named.alias(label), "source_size", "target",
        F.floor(expected * float(UNIT) + 0.5).cast("decimal(14,0)").alias(share))
    place_of = ranked(stored, ["size", shuffle, order], place, group=label)
    whole = F.expr(f"bigint((`{offset}` * {UNIT}bd) div 4294967296bd)").cast("decimal(13,0)")
    crossed = (f"((cast(`{place}` as decimal(18,0)) * `{share}` + `{offset}`) div {UNIT}bd"
               f" - (cast(`{place}` - 1 as decimal(18,0)) * `{share}` + `{offset}`) div {UNIT}bd)")
    return (
        place_of.join(shares, label)
        .withColumn(offset, bits(F.concat(F.lit(f"{seed}|"), F.col(label)))).withColumn(offset, whole)
        .withColumn("copies", F.expr(crossed).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(label, shuffle, place, share, offset)
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mixture itself: every row as often as it has ``copies``, numbered in ``copy``."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target and the words the mixture takes of it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


_BITS = "('0x' || md5('{SEED}|' || {of})[1:8])::BIGINT"
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS label,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~')) AS h FROM documents),
s AS (SELECT source, label, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number, source_size * {MOST} AS cap FROM s),
v AS (SELECT *, {list(WEIGHTS)}[((number - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM w),
f AS (
  SELECT *, row_number() OVER fill AS place,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM v WINDOW fill AS (ORDER BY cap::DOUBLE / weight, number)),
o AS (SELECT place AS first_place, level AS first_level FROM f WHERE cap > level * weight ORDER BY place LIMIT 1),
t AS (
  SELECT label, source_size,
    CASE WHEN place >= first_place THEN first_level * weight ELSE cap::DOUBLE END AS target
  FROM f LEFT JOIN o ON true),
e AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN least(target / source_size, {float(MOST)}) ELSE 0.0 END * 1e12::DOUBLE + 0.5)::HUGEINT
           AS share,
         {_BITS.format(SEED=SEED, of='label')}::HUGEINT * {UNIT} // 4294967296 AS start
  FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size, h, doc_id NULLS FIRST)::HUGEINT AS place FROM d),
c AS (
  SELECT p.doc_id, p.size, e.source_size, e.target,
         ((place * share + start) // {UNIT} - ((place - 1) * share + start) // {UNIT})::INTEGER AS copies
  FROM p JOIN e USING (label))
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""
