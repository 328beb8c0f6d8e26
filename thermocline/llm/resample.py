"""Target-distribution importance resampling with hashed word runs.

Features are runs of consecutive words (``grams``), hashed into buckets by crc32. A bucket's gain
is the logarithm of how much more often the target texts have it than the documents,
with one added to every count. A document's weight is its mean gain; Gumbel noise from
a hash of its id turns the highest scores into a draw without replacement,
proportional to the exponential of the weight.

Tasks intern the runs of a piece of a batch in an open-addressed NumPy
table (``grams.Interned``: XXH64 keys, verified by bytes), so a bucket is worked out once per distinct
run. Slots store bucket and count: counts are summed per bucket when gains are learned, and
each occurrence gathers its gain through its slot when documents are scored.

Documents are read twice and never shuffled; only ``buckets`` numbers meet. The draw
counts rows per score to find the cut and ranks only rows at or above it.

Defined results: a null or empty text has no features, weight 0, and is never drawn; gains are
floored thousandths; a null id hashes as an empty one and comes first among equal scores; repeated rows
score alike and are ranked one after the other; no target texts leave every gain to the documents' counts; no rows give
no rows. Columns named n_features, n_words, weight, score or rank are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from thermocline.llm.common import read_table, store, tidy, with_workers
from thermocline.llm.grams import Interned, Words, pieces
from thermocline.llm.ranks import fresh, ranked

BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
RUNS_AT_ONCE = 500_000


def slots(words: Words, longest: int, buckets: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of 1 to ``longest`` words, some at a time, with the slot of each and every slot's bucket and count."""
    for n in range(1, longest + 1):
        runs = words.runs(n)
        for start in range(0, len(runs), RUNS_AT_ONCE):
            part = runs.part(slice(start, start + RUNS_AT_ONCE))
            table = Interned.of(part)
            used, raw = table.used(), part.buffer.tobytes()
            first = table.owner[used]
            bucket = np.zeros(len(table.owner), np.int64)
            ends = (part.start + part.size)[first].tolist()
            bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(part.start[first].tolist(), ends)]
            yield part, table.slot, bucket, np.bincount(table.slot, minlength=len(bucket))


def bucket_counts(texts: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over whole texts; a task sends a row per bucket at most."""
    with_workers(texts.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches):
            for _, _, bucket, count in slots(Words.of(piece["text"]), longest, buckets):
                total += np.bincount(bucket, weights=count, minlength=buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select("text").mapInArrow(tidy(task), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def learn_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in floored thousandths."""
    source = bucket_counts(docs, longest, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, longest, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    joined = every.join(source, "bucket", "left").join(wanted, "bucket", "left").fillna(0, ["s", "t"])
    totals = Window.partitionBy()  # over the buckets
    ratio = ((F.col("t") + 1).cast("double") * (F.sum("s").over(totals) + buckets).cast("double")
             / ((F.col("s") + 1).cast("double") * (F.sum("t").over(totals) + buckets).cast("double")))
    rows = joined.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()  # ``buckets`` rows
    gains = np.zeros(buckets, np.int64)
    for row in rows:
        gains[row["bucket"]] = row["gain"]
    return gains


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """``docs`` without ``text``, with ``n_features``, ``n_words`` and ``weight`` (floored mean gain)."""
    docs = docs.drop("n_features", "n_words", "weight")
    with_workers(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = ["n_features", "n_words", "weight"]
    schema = T.StructType([*kept, *[T.StructField(name, T.LongType()) for name in names]])
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = Words.of(piece["text"])
            total, features = np.zeros((2, piece.num_rows), np.int64)
            for runs, slot, bucket, _ in slots(words, longest, len(shared.value)):
                np.add.at(total, runs.row, shared.value[bucket][slot])
                features += np.bincount(runs.row, minlength=piece.num_rows)
            found = [features, words.count, total // np.maximum(features, 1)]
            out = piece.select([f.name for f in kept])
            for name, column in zip(names, found):
                out = out.append_column(name, pa.array(column))
            yield from out.combine_chunks().to_batches()

    return docs.mapInArrow(tidy(task), schema)


def with_score(weighed: DataFrame, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """Adds ``score``: weight plus a Gumbel variate, in thousandths, from the hash of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """Adds ``rank`` to the highest ``percent`` of the rows with ``least_words`` words; null for the others.

    ``scored`` is read several times: pass a stored table.
    """
    scored = scored.drop("rank")
    fits = F.col("n_words") >= least_words
    # One row per distinct score: scores are thousandths of a logarithm.
    counts = scored.where(fits).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score"))
    total = F.sum("n").over(Window.partitionBy())
    cut = (counts.withColumn("upto", F.sum("n").over(above)).withColumn("total", total)
           .withColumn("drawn", F.expr(f"total * {percent} div 100")).where("upto >= drawn AND drawn > 0")
           .agg(F.max("score").alias("cut"), F.max("drawn").alias("drawn")).first())
    none = F.lit(None).cast("long")
    if cut["cut"] is None:
        return scored.withColumn("rank", none)
    reaches = fits & (F.col("score") >= cut["cut"])
    (place,) = fresh(scored, "_place")
    order = ["score", key, "n_features", "weight"]
    best = ranked(store(scored.where(reaches), "candidates"), order, place, descending=("score",))
    best = best.withColumn("rank", F.when(F.col(place) <= cut["drawn"], F.col(place)).otherwise(none)).drop(place)
    return best.unionByName(scored.where(~reaches).withColumn("rank", none))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight and score, and its rank if it is drawn."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    gains = learn_gains(docs, read_table(spark, sf_dir, "benchmark"))
    scored = store(with_score(weigh(docs, gains)), "scored")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""

# The checksum is worked out once per distinct word, byte by byte: the
# polynomial's table comes from eight shift steps per entry.
OP12_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b:
              CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
f AS (SELECT r, unnest(words) AS word FROM d),
g AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket
  FROM (SELECT word FROM f UNION SELECT word FROM g), crc_table),
s AS (SELECT bucket, count(*) AS s FROM f JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT b.bucket, floor(1000.0::DOUBLE * ln(
      (coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + {BUCKETS})::DOUBLE
      / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (
  SELECT r, sum(gain)::BIGINT AS total FROM f JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT doc_id, len(words)::BIGINT AS n_features,
    CASE WHEN len(words) = 0 THEN 0
         ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END::BIGINT AS weight,
    ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM d LEFT JOIN sums USING (r)),
scored AS (
  SELECT doc_id, n_features, weight,
    (weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM weighed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS}
                               ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place,
         count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) * {PERCENT} // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= drawn THEN place END::BIGINT AS rank
FROM placed
"""
