"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of a stratum (source) are shuffled by a seeded hash and ranked. A row's
fractional rank, ``(rank - 1 + phase) / rows of its source``, spreads each source
evenly over (0, 1); the phase is a hash of the source, so small sources do not
all meet at one point. All rows sorted by fractional rank and cut into equal runs give
shards whose mixture is the corpus mixture to within one row or so per source.

No window ever holds a source, and no task rows of one value: both orders are dealt into sorted ranges
(``ranks.ranked``), where rows that are equal in everything are split by a tie number.

Law ``rows``: shard sizes differ by one row at most. Defined results: a null
source is a stratum of its own; null ids and texts hash as such; rows equal in
all ordering columns are interchangeable; no rows give no rows. Columns named
``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.llm.common import empty_as, read_table, store
from thermocline.llm.ranks import fresh, ranked

SHARDS = 24
SEED = "interleave-1"


def _bits(text):
    """The leading 32 bits of an md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def interleave(rows: DataFrame, shards: int, stratum: str = "source", order: tuple[str, ...] = ("doc_id",),
               seed: str = SEED) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless within a shard).

    ``order`` names the columns that identify a row; they feed the seeded
    shuffle and break ties. All columns travel through two shuffles, so callers
    pass the columns they need and join wide ones by key.
    """
    rows = rows.drop("shard", "slot")
    label, shuffle, rank, at, place, held = fresh(rows, "_label", "_hash", "_rank", "_at", "_place", "_held")
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in order])
    # The label replaces the stratum as key: it is never null.
    named = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("~"))
    keyed = store(rows.withColumn(label, named).withColumn(shuffle, F.md5(text)), "keyed")
    n = keyed.count()
    sizes = keyed.groupBy(label).agg(F.count("*").alias(held))
    phase = _bits(F.concat(F.lit(f"{seed}|"), F.col(label))) / F.lit(2.0 ** 32)
    spread = store(
        ranked(keyed, [shuffle, *order], rank, group=label).join(sizes, label)
        .withColumn(at, (F.col(rank) - 1 + phase) / F.col(held)).drop(rank, held), "spread")
    return (
        ranked(spread, [at, label, shuffle, *order], place)
        .withColumn(place, F.col(place) - 1)
        .withColumn("shard", F.expr(f"int(`{place}` * {shards} div {max(n, 1)})"))
        .withColumn("slot", F.expr(f"`{place}` - (shard * {n}L + {shards - 1}) div {shards}"))
        .drop(label, shuffle, at, place)
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, slot and what an auditor needs to check the cut."""
    text = empty_as()
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleave(docs, SHARDS, order=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# The checksum is worked out byte by byte: the polynomial's table comes from
# eight shift steps per entry.
OP2_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b:
              CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM (SELECT unnest(range(256)) AS i)),
hexed AS (SELECT doc_id, source, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS digits FROM documents),
summed AS (
  SELECT doc_id, source, strlen(body) + 8 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(digits, '..'), lambda d: ('0x' || d)::BIGINT)),
      lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM hexed, crc_table),
keyed AS (
  SELECT *, coalesce('=' || source, '~') AS label,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~') || '|' || text_crc32::VARCHAR) AS h FROM summed),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY label ORDER BY h, doc_id NULLS FIRST, text_crc32) - 1
             + ('0x' || md5('{SEED}|' || label)[1:8])::BIGINT / 4294967296.0::DOUBLE)
            / count(*) OVER (PARTITION BY label) AS frac FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, label, h, doc_id NULLS FIRST, text_crc32) - 1 AS place,
         count(*) OVER () AS n FROM ranked),
cut AS (SELECT *, (place * {SHARDS}) // n AS shard_no FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard_no::INTEGER AS shard,
       place - (shard_no * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
