"""SimHash near-duplicates by multi-index hashing.

A fingerprint holds, per bit, the majority among a document's hashed word shingles.
Fingerprints are cut into segments. If two are close, they are close in some
segment, so every fingerprint is stored under the value of each segment and
looked up under all values within one bit of it; what meets in a table is
verified by the complete distance. A pair one bit apart in a segment is only
looked up from the side whose bit is zero, which halves the probes.

``linked_fingerprints`` joins 64-bit fingerprints at three or fewer differing
bits: two segments of 32 bits lose no pair. ``near_groups`` finds
documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more:
such pairs differ in about 15 % of the bits, so it takes longer fingerprints,
with as many segments as keep the chance of missing a pair at the threshold under
``MISS``; candidates are verified by the complete distance and then by the exact similarity.
Few shingles make poor majorities, so texts of at most ``SHORT`` shingles are linked exactly instead: sets
that similar share a subset that leaves out few elements of either, and all such subsets are hashed and joined.

No group of copies is ever paired with itself. Equal texts are one node.
Texts that fall under one segment value are first compared with one pivot each, which
joins most of a large group in a linear number of pairs; afterwards only pairs
of different groups are looked up, the nearest of each text compared first, and members of large groups
(over ``LARGE_GROUP``) never meet members of the same group. Where at least ``CROWD`` texts lie under one value and
not all of them have been joined, texts carry marks of their shingles that prove most dissimilar pairs dissimilar,
so such pairs are never made and no similar one is lost. What stays open must also pass a long fingerprint, so in a
group whose pairs lie below the threshold only those very near it are compared exactly.

Defined results: a null text is an empty one; fewer words than a shingle are
one shingle; texts without a word have fingerprint zero, are equal to each other and
similar to nothing else; equal rows share a group; null ids are kept and are
smallest only in a group without other ids; no rows give no rows. Nodes of ``near_groups`` are 64-bit hashes
of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import asin, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermocline.llm.common import LOWER, discard, empty_as, read_table, store, tidy, with_workers
from thermocline.llm.graph import components
from thermocline.llm.ranks import fresh

SEED = 42
SIMILARITY = 0.8
NEAR_SHINGLE = 5
MISS = 0.02
CHECK_BITS = 22
"""Most differing bits among 64 spare ones before the exact check; at the threshold 9.7 are expected, deviation 2.9."""
LARGE_GROUP = 1000
SHORT = 15
COVERED = int(SIMILARITY * SHORT)
"""A text of so many shingles has no partner over ``SHORT``, so it needs no fingerprint."""
BROADCAST_IDS = 2_000_000
LONG_WORDS = 64
"""64-bit words of the fingerprint that open pairs must pass before texts are compared."""
LONG_SALT = 99
FEW_PARTNERS = 4
CROWD = 16
"""So many texts under one segment value are no chance: segments are as wide as to leave one there."""
MARK_BITS = (256, 4096)
"""Least and most bits of a text's marks; in between it is the power of two over twice its shingles."""


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words of the text in lower case, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    ends = ends[min(size, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of each hash; word 0 is the hash itself."""
    if word == 0:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` times 64 majority bits, as unsigned numbers."""
    out = np.zeros(words, np.uint64)
    for word in range(words):
        ones = np.zeros(64, np.int64)
        mixed = _mixed(hashes, word)
        for at in range(0, len(mixed), 255):
            block = mixed[at:at + 255]
            bits = np.unpackbits(block.astype("<u8").view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint8)
        out[word] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint ``fp`` (as a signed number) of every row."""
    with_workers(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(text.as_py(), shingle))[0] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(hashed), "doc_id long, fp long")


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints ``fp`` that differ in at most three bits.

    One of the two 32-bit halves then differs in at most one bit. A fingerprint has
    at most 43,744 others within three bits, so the pairs of one are bounded however large its group.
    Spark takes an exploded table to be as small as what it came from, here about 34 times too small, and
    would send it through the driver; so both sides are dealt out by a shuffle at any size.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = F.explode(F.array(
        F.struct(F.lit(0).alias("segment"), low.alias("key")),
        F.struct(F.lit(1).alias("segment"), F.shiftrightunsigned("fp", 32).alias("key"))))
    table = distinct.select("fp", halves.alias("x")).select("fp", "x.segment", "x.key")
    ball = F.expr("""explode(concat(array(struct(key AS key, 0 AS off)), transform(
        filter(sequence(0, 31), j -> (key & shiftleft(1L, j)) = 0), j -> struct(key | shiftleft(1L, j) AS key, 1 AS off))))""")
    probes = table.select(F.col("fp").alias("a"), "segment", ball.alias("y")).select("a", "segment", "y.key", "y.off")
    return (
        table.withColumnRenamed("fp", "b").join(probes.hint("merge"), ["segment", "key"])
        .where("(off = 1 OR a < b) AND bit_count(a ^ b) <= 3").select("a", "b")
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    All joined tables grow with the documents and lie packed in their files, so none goes through the driver.
    """
    rows = store(fingerprints(read_table(spark, sf_dir, "documents")), "fingerprints")
    first = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(linked_fingerprints(first.select("fp")))
    rooted = store(
        first.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.select("fp", "root").join(smallest.hint("merge"), "root").select("fp", "component_id")
    return rows.join(labels.hint("merge"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two shingle sets of one size with this Jaccard similarity."""
    return 0.5 - asin(2 * similarity / (1 + similarity)) / pi


def segment_plan(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """Bits per segment and number of segments for ``n`` texts.

    Wider segments keep the texts that share a value by chance constant as n grows;
    the number of segments follows from the chance that a pair at the
    threshold is within one bit in none of them.
    """
    width = min(32, max(18, ceil(log2(max(n, 2)))))
    p = differing_share(similarity)
    hit = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return width, ceil(log(miss) / log(1 - hit))


def _sketches(docs: DataFrame, width: int, segments: int) -> DataFrame:
    """id, segment values and 64 check bits of every distinct text over ``COVERED`` shingles."""
    words = -(-width * segments // 64) + 1

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(width)).astype(np.int64)
        for batch in batches:
            ids, places = np.unique(batch.column("id").to_numpy(), return_index=True)
            texts = batch.column("text").take(pa.array(places))
            sets = [np.unique(shingle_hashes(t.as_py(), NEAR_SHINGLE)) for t in texts]
            long = [i for i, found in enumerate(sets) if len(found) > COVERED]
            ids = ids[long]
            prints = np.array([fingerprint(sets[i], words) for i in long], np.uint64).reshape(len(ids), words)
            bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(ids), 8 * words), axis=1,
                                 bitorder="little")
            keys = bits[:, :width * segments].reshape(len(ids), segments, width) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * segments),
                                             pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), lists, pa.array(prints[:, -1].view(np.int64))], ["id", "keys", "check"])

    return docs.select("id", "text").mapInArrow(tidy(sketch), "id long, keys array<long>, check long").dropDuplicates(["id"])


def left_out(size: int) -> int:
    """The most elements that a set can lack in what it shares with one at least ``SIMILARITY`` similar.

    Sets that share i elements and have a and b others are similar enough if a + b <= i / 4 (at 0.8).
    """
    return max(a for a in range(size + 1) if a <= _others(size - a))


def _others(shared: int) -> int:
    return int(shared * (1 - SIMILARITY) / SIMILARITY + 1e-9)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def few_shingles(text: str | None) -> np.ndarray | None:
    """The distinct hashes of a text's shingles, or None as soon as there are more than ``SHORT``."""
    lower = (text or "").encode().translate(LOWER)
    found: set[int] = set()
    held: list[bytes] = []
    for match in WORD.finditer(lower):
        held.append(match[0])
        if len(held) >= NEAR_SHINGLE:
            found.add(xxhash.xxh64_intdigest(b" ".join(held[-NEAR_SHINGLE:]), SEED))
            del held[:-NEAR_SHINGLE]
            if len(found) > SHORT:
                return None
    if held and not found:
        found.add(xxhash.xxh64_intdigest(b" ".join(held), SEED))
    return np.array(sorted(found), np.uint64)


def short_links(docs: DataFrame) -> DataFrame:
    """Links (a, b) that join exactly the similar texts of at most ``SHORT`` shingles.

    Under a shared subset everything hangs on one text that lacks least of it: whatever is similar through this
    subset is similar to that text too. So a subset gives a link per text, however many texts have it.
    """
    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = np.unique(batch.column("id").to_numpy(), return_index=True)
            rows = []
            for key, text in zip(ids.tolist(), batch.column("text").take(pa.array(places))):
                found = few_shingles(text.as_py())
                if found is not None:
                    other = _mixed(found, 1)
                    for out in range(left_out(len(found)) + 1):
                        for gone in combinations(range(len(found)), out):
                            kept = np.delete(np.arange(len(found)), gone)
                            rows.append((found[kept].sum(dtype=np.uint64), other[kept].sum(dtype=np.uint64), len(kept), out, key))
            key_a, key_b, shared, out, key = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(key_a, np.uint64).view(np.int64)), pa.array(np.array(key_b, np.uint64).view(np.int64)),
                pa.array(shared, pa.int32()), pa.array(out, pa.int32()), pa.array(key, pa.int64())],
                ["key_a", "key_b", "shared", "out", "id"])

    schema = "key_a long, key_b long, shared int, out int, id long"
    table = store(docs.select("id", "text").mapInArrow(tidy(subsets), schema), "subsets")
    keys = ["key_a", "key_b", "shared"]
    pivot = table.groupBy(*keys).agg(F.min(F.struct("out", "id")).alias("pivot"), F.max("id").alias("last"), F.min("id").alias("first"))
    several = pivot.where("first <> last").select(*keys, F.col("pivot.id").alias("b"), F.col("pivot.out").alias("out_b"))
    room = F.element_at(F.array(*[F.lit(_others(i)) for i in range(SHORT + 1)]), F.col("shared") + 1)
    links = table.join(several, keys).where((F.col("id") != F.col("b")) & (F.col("out") + F.col("out_b") <= room))
    return store(links.select(F.col("id").alias("a"), "b").distinct(), "short-links")


def _table(sketches: DataFrame, width: int) -> DataFrame:
    """One row per text and segment; ``key`` holds the segment's number and value."""
    keep = [c for c in sketches.columns if c != "keys"]
    return sketches.select(*keep, F.posexplode("keys").alias("segment", "value")).select(
        *keep, F.expr(f"shiftleft(cast(segment AS long), {width}) | value").alias("key"))


def _distance(a: str, b: str) -> Column:
    """Differing bits of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _most_apart(bits: int) -> int:
    """Four standard deviations over the distance that fingerprints of so many bits have at the threshold."""
    p = differing_share(SIMILARITY)
    return int(bits * p + 4 * sqrt(bits * p * (1 - p)))


def _close(pairs: DataFrame, sketches: DataFrame, width: int, segments: int) -> DataFrame:
    """Distinct pairs (a, b) whose complete fingerprints may belong to similar texts, with their ``distance``."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    prints = sketches.select("id", F.array_append("keys", F.col("check")).alias("bits"))
    return store(pairs.join(prints.toDF("a", "bits_a"), "a").join(prints.toDF("b", "bits_b"), "b")
                 .select("a", "b", _distance("bits_a", "bits_b").alias("distance"))
                 .where(F.col("distance") <= _most_apart(width * segments + 64)), "close-pairs")


def _ids(pairs: DataFrame) -> DataFrame:
    """The texts that occur in ``pairs``; each side is made distinct before they meet."""
    return store(pairs.select(F.col("a").alias("id")).distinct()
                 .union(pairs.select(F.col("b").alias("id")).distinct()).distinct(), "pair-ids")


def _only(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose id is in the stored table ``ids``."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _grams(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """id and the set of 32-bit shingle hashes of every text in ``pairs``."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for place, key in enumerate(batch.column("id").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    fresh.append(place)
            chosen = batch.take(pa.array(fresh, pa.int64()))
            found = [np.unique(shingle_hashes(t.as_py(), NEAR_SHINGLE).astype(np.uint32)).view(np.int32)
                     for t in chosen.column("text")]
            yield pa.RecordBatch.from_arrays([chosen.column("id"), pa.array(found, pa.list_(pa.int32()))], ["id", "grams"])

    ids = _ids(pairs)
    grams = store(_only(texts, ids).select("id", "text")
                  .mapInArrow(tidy(sets), "id long, grams array<int>").dropDuplicates(["id"]), "grams")
    discard(ids)
    return grams


def _alike(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs (a, b) of text ids whose shingle sets are similar enough."""
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - both
    return store(
        pairs.select("a", "b").join(grams.toDF("a", "grams_a"), "a").join(grams.toDF("b", "grams_b"), "b")
        .where((both >= F.lit(SIMILARITY) * union)).select("a", "b"), "similar")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of text ids whose texts are similar enough."""
    grams = _grams(pairs, texts)
    similar = _alike(pairs, grams)
    discard(grams)
    return similar


def _long_close(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """``pairs`` whose long fingerprints may belong to similar texts, with their ``distance``."""
    bits = 64 * LONG_WORDS

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [row.values.to_numpy().view(np.uint32).astype(np.uint64) for row in batch.column("grams")]
            found = [fingerprint(_mixed(hashes, LONG_SALT), LONG_WORDS).view(np.int64) for hashes in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "bits"])

    ids = _ids(pairs)
    long = store(_only(grams, ids).mapInArrow(tidy(prints), "id long, bits array<long>"), "long-prints")
    near = store(pairs.join(long.toDF("a", "bits_a"), "a").join(long.toDF("b", "bits_b"), "b")
                 .withColumn("distance", _distance("bits_a", "bits_b")).drop("bits_a", "bits_b")
                 .where(F.col("distance") <= _most_apart(bits)), "long-close")
    discard(ids, long)
    return near


def _regrouped(pairs: DataFrame, roots: DataFrame, a: str = "grp_a", b: str = "grp_b") -> DataFrame:
    """``pairs`` that ``roots`` leaves in different groups; columns ``a`` and ``b`` are what roots are looked up by."""
    return (
        pairs.join(roots.toDF(a, "root_a"), a, "left").join(roots.toDF(b, "root_b"), b, "left")
        .withColumn("grp_a", F.coalesce("root_a", a)).withColumn("grp_b", F.coalesce("root_b", b))
        .where("grp_a <> grp_b").drop("root_a", "root_b"))


def _linking(pairs: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """``known`` links and enough of the similar pairs to join whatever all of them would join.

    The nearest partner of every text is compared first. That joins most of a
    group, and pairs inside what is joined by then need no comparison of texts. Pairs of different groups
    must pass a fingerprint of ``LONG_WORDS`` words, which tells similarities near the threshold apart far better;
    while each text has several partners left, the nearest is compared again, as long as that joins many. All that is left is compared.
    """
    grams = _grams(pairs, texts)
    nearest = pairs.groupBy("a").agg(F.min_by("b", "distance").alias("b"))
    links = known.union(_alike(nearest, grams))
    apart = store(_regrouped(pairs.select("a", "b"), components(links), "a", "b"), "pairs-apart")
    left = _long_close(apart, grams)
    discard(apart)
    while True:
        n, askers = left.agg(F.count("*"), F.count_distinct("a")).first()
        if n <= FEW_PARTNERS * askers:
            break
        nearest = store(left.groupBy("a").agg(F.min_by(F.struct("b", "grp_a", "grp_b"), "distance").alias("x"))
                        .select("a", "x.*"), "nearest")
        similar = _alike(nearest, grams)
        links = links.union(similar)
        meets = nearest.join(similar, ["a", "b"]).select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"))
        following = store(_regrouped(left.join(nearest.select("a", "b"), ["a", "b"], "left_anti"), components(meets)), "pairs-left")
        discard(left, nearest)
        left = following
        if FEW_PARTNERS * similar.count() < askers:
            break
    links = links.union(_alike(left, grams))
    discard(left, grams)
    return links


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """One bit per class of low hash bits, set where the class holds an odd number of ``hashes``; as signed words.

    Two sets differ in at least as many elements as their bits differ. Folding the upper half onto the lower by XOR
    gives the bits for half as many classes.
    """
    least, most = MARK_BITS
    bits = min(most, max(least, 1 << (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _marks(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id and ``marks`` (size and parity bits of the shingle set) of the texts in ``ids``."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = np.unique(batch.column("id").to_numpy(), return_index=True)
            sets = [np.unique(shingle_hashes(t.as_py(), NEAR_SHINGLE)) for t in batch.column("text").take(pa.array(places))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(found) for found in sets], pa.int32()),
                 pa.array([parity_bits(found) for found in sets], pa.list_(pa.int64()))], ["id", "size", "bits"])

    return (_only(texts, ids).select("id", "text").mapInArrow(tidy(marked), "id long, size int, bits array<long>")
            .dropDuplicates(["id"]).select("id", F.struct("size", "bits").alias("marks")))


def _may_be_similar() -> Column:
    """Whether ``marks_a`` and ``marks_b`` leave room for ``SIMILARITY``; true if either is missing.

    Sets of a and b elements that differ in d have the similarity (a + b - d) / (a + b + d).
    """
    def folded(own: str, other: str) -> Column:
        half = F.size(other)
        return F.when(F.size(own) > half, F.zip_with(
            F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(own))

    size_a, size_b = F.col("marks_a.size"), F.col("marks_b.size")
    near = F.least(size_a, size_b) >= F.greatest(size_a, size_b) * SIMILARITY - 1e-6
    differ = F.aggregate(F.zip_with(folded("marks_a.bits", "marks_b.bits"), folded("marks_b.bits", "marks_a.bits"),
                                    lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.coalesce(near & (differ * (1 + SIMILARITY) <= (size_a + size_b) * (1 - SIMILARITY) + 1e-6), F.lit(True))


def _ball(width: int) -> Column:
    """``key`` and all keys within one bit of it."""
    return F.expr(f"explode(concat(array(key), transform(sequence(0, {width - 1}), j -> key ^ shiftleft(1L, j))))")


def _crowded(table: DataFrame, width: int) -> DataFrame:
    """Texts within one bit of a segment value of at least ``CROWD`` texts, where that ball holds several groups.

    Whatever meets more than ``CROWD`` texts of another group in one lookup is among them.
    """
    dense = store(table.groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {CROWD}").select("key"), "dense-keys")
    balls = dense.select(F.col("key").alias("centre"), _ball(width).alias("key"))

    def inside(rows: DataFrame, keys: DataFrame, many: bool) -> DataFrame:
        return rows.join(keys if many else F.broadcast(keys), "key", "left_semi")

    many = dense.count() * (width + 1) > BROADCAST_IDS
    near = store(inside(table.select("id", "grp", "key"), balls.select("key").distinct(), many), "near-dense")
    held = near.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    mixed = balls.join(held, "key").groupBy("centre").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    open_keys = mixed.select(F.col("centre").alias("key")).select(_ball(width).alias("key")).distinct()
    ids = store(inside(near, open_keys, many).select("id").distinct(), "crowded-ids")
    discard(dense, near)
    return ids


def _pivot_pairs(table: DataFrame) -> DataFrame:
    """Each text with the smallest one under the same segment value."""
    pivot = table.groupBy("key").agg(F.min("id").alias("b"), F.min_by("check", "id").alias("check_b"), F.count("*").alias("n"))
    return (table.join(pivot.where("n > 1").drop("n"), "key")
            .where(f"id <> b AND bit_count(check ^ check_b) <= {CHECK_BITS}").select(F.col("id").alias("a"), "b"))


def _ball_pairs(table: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Pairs of different groups within one bit of a segment value; the large groups' rows; the test of a pair.

    Rows of a large group only look up rows outside large groups and the other
    way round; two large groups meet through their own join, key by key and group by
    group, so no large group is matched with itself.
    """
    ball = F.expr(f"""explode(concat(array(struct(key AS key, 0 AS off)), transform(
        filter(sequence(0, {width - 1}), j -> (key & shiftleft(1L, j)) = 0),
        j -> struct(key | shiftleft(1L, j) AS key, 1 AS off))))""")
    close = F.expr(f"grp_a <> grp_b AND (off = 1 OR a < b) AND bit_count(check_a ^ check_b) <= {CHECK_BITS}") & _may_be_similar()
    probes = table.select(F.col("id").alias("a"), F.col("check").alias("check_a"), F.col("grp").alias("grp_a"),
                          F.col("marks").alias("marks_a"), "large", ball.alias("y")).select(
        "a", "check_a", "grp_a", "marks_a", "large", "y.key", "y.off")
    stored = table.select(F.col("id").alias("b"), F.col("check").alias("check_b"), F.col("grp").alias("grp_b"),
                          F.col("marks").alias("marks_b"), "large", "key")
    # A lookup by a large group's row runs in lane true, which holds no large group's rows.
    lanes = stored.select("b", "check_b", "grp_b", "marks_b", "key", F.explode(
        F.when(F.col("large"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("large"))
    pairs = probes.join(lanes, ["key", "large"]).where(close).select("a", "b")
    return pairs, probes.where("large"), stored.where("large"), close


def _large_pairs(probes: DataFrame, stored: DataFrame, close: Column) -> DataFrame:
    """Pairs across large groups, by the groups that meet under a key."""
    meets = probes.select("key", "grp_a").distinct().join(stored.select("key", "grp_b").distinct(), "key").where("grp_a <> grp_b")
    return (probes.drop("large").join(meets, ["key", "grp_a"]).join(stored.drop("large"), ["key", "grp_b"])
            .where(close).select("a", "b"))


def near_groups(docs: DataFrame) -> DataFrame:
    """``id`` (hash of a text) and ``root`` of every text that is near another one."""
    with_workers(docs.sparkSession)
    texts = docs.select(empty_as().alias("text")).withColumn("id", F.xxhash64("text"))
    n = docs.count()
    width, segments = segment_plan(n)
    sketches = store(_sketches(texts, width, segments), "sketches")

    first = short_links(texts).union(
        _similar(_close(_pivot_pairs(_table(sketches, width)), sketches, width, segments), texts))
    groups = components(first).withColumnRenamed("node", "id").withColumnRenamed("root", "grp")
    large = groups.groupBy("grp").agg((F.count("*") > LARGE_GROUP).alias("large"))
    grouped = store(
        sketches.join(groups.join(large, "grp"), "id", "left")
        .select("id", "check", "keys", F.coalesce("grp", "id").alias("grp"), F.coalesce("large", F.lit(False)).alias("large")),
        "grouped")
    crowded = _crowded(_table(grouped, width), width)
    marked = store(grouped.join(_marks(texts, crowded), "id", "left"), "marked")
    discard(grouped, crowded)
    table = _table(marked, width)
    pairs, large_probes, large_stored, close = _ball_pairs(table, width)
    if marked.where("large").select("grp").distinct().limit(2).count() > 1:
        pairs = pairs.union(_large_pairs(large_probes, large_stored, close))
    links = _linking(_close(pairs, sketches, width, segments), first, texts)
    roots = components(links).withColumnRenamed("node", "id")
    discard(sketches, marked)
    return roots


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, then the smallest text hash."""
    text_id = F.xxhash64(empty_as())
    own, key, doc, n = fresh(docs, "_own", "_key", "_doc", "_n")
    roots = near_groups(docs)
    copies = docs.select("doc_id", text_id.alias("id")).groupBy("id", "doc_id").agg(F.count("*").alias("n"))
    winners = store(
        copies.join(roots, "id", "left")
        .groupBy(F.coalesce("root", "id").alias("root"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "n")).alias("w"))
        .select(F.col("w.id").alias(key), F.col("w.doc_id").alias(doc), F.col("w.n").alias(n)), "winners")
    keyed = docs.withColumn(own, text_id)

    def chosen(keys: DataFrame) -> DataFrame:
        match = (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc))
        return keyed.join(keys.hint("shuffle_hash"), match, "left_semi")

    kept = chosen(winners)
    several = F.col(n) > 1
    if winners.where(several).limit(1).count():
        kept = chosen(winners.where(~several)).union(chosen(winners.where(several)).dropDuplicates([own, "doc_id"]))
    return kept.drop(own)
