"""Sequence packing by exact-complement hashing, then best fit.

Lengths are at most the capacity, so a corpus of any size is a histogram of at
most ``capacity`` classes, and the whole plan is made on that histogram: a list
of patterns (a multiset of lengths) with the number of sequences cut after each.
A pattern starts from the longest length left. An index of the sums that single
lengths, pairs and triples reach, kept under availability counts, tells whether one, two or three pieces
fill the gap exactly; if so they are consumed. If not, the longest piece that
fits goes in (best fit) and the gap is tried again. A pattern is then repeated
as often as the counts allow, so each one uses up a class.

Spark counts the classes, ranks the pieces within their class (file by file of
the stored piece table, so a class of any size is spread), and turns ranks into
places by the plan. The plan's size depends on the capacity alone; the counts of each file
stay a table, joined by a shuffle on the same keys as the ranks.

Defined results: columns of the caller keep their names and values; a null text packs as an empty one, a document without tokens
is its end id alone; equal rows give equal pieces with places of their own; no
rows give no rows. Null ids are kept.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from thermocline.llm.common import read_table, store, tidy, with_workers
from thermocline.llm.ranks import fresh

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CACHED_WORDS = 200_000
CACHED_CHARS = 40


# Lower-case Latin-1 parts of a word, as the tokenizer's splitter makes them: endings,
# letters, single digits, other signs.
LATIN_PARTS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable, else the next free code from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [c for c in range(256) if c not in printable]
    return {c: chr(c) for c in printable} | {c: chr(256 + i) for i, c in enumerate(hidden)}


class Memory(dict):
    """A cache that keeps the newest and the previous ``size`` entries."""

    def __init__(self, make, size: int):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Tokens:
    """Token ids of whole texts, worked out once per distinct word.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its blank-separated words in order. Latin-1 words
    are cut into the splitter's parts here, and the tokenizer's model encodes
    each distinct part; all other words go through the whole tokenizer.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = Memory(self._word, CACHED_WORDS)
        self.parts = Memory(self._part, CACHED_WORDS)

    def _part(self, part: str) -> bytes:
        found = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        return np.array([x.id for x in found], "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if b"<|" in word or max(text) > "\xff":
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.parts[part] for part in LATIN_PARTS.findall(text.lower())])

    def forget(self) -> None:
        """Keep only the newest words between tasks."""
        self.words.older, self.parts.older = {}, {}

    def of(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        known = self.words
        return b"".join([known[word] for word in text.encode().split()])


@lru_cache(maxsize=2)
def tokens(file: str) -> Tokens:
    return Tokens(file)


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, file: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """Documents as runs of at most ``capacity`` ids; ``keep_ids`` adds the ids themselves."""
    with_workers(docs.sparkSession)
    schema = T.StructType([*PIECES.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids])
    step, end = capacity * 4, np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = tokens(file).of(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part),
                                 *[np.frombuffer(part, "<i4")] * keep_ids))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], schema.names)
        tokens(file).forget()

    return docs.select("doc_id", "text").mapInArrow(tidy(cut), schema)


class Lengths:
    """Availability counts with an index of the sums that pairs and triples of lengths reach.

    ``pairs[s]`` and ``triples[s]`` count the multisets of available lengths with sum s.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.capacity = len(counts) - 1
        self.some = self.left > 0
        # Ordered pairs and triples of different and equal lengths; equal ones are taken out and put back where
        # there are enough pieces.
        same2, same3 = self._times(self.some, 2), self._times(self.some, 3)
        two, three = self._times(self.left >= 2, 2), self._times(self.left >= 3, 3)
        pairs = self._sums(self.some, self.some)
        triples = self._sums(pairs, self.some)
        self.pairs = (pairs - same2) // 2 + two
        self.triples = ((triples - 3 * self._sums(same2, self.some) + 2 * same3) // 6
                        + self._sums(two, self.some) - self._times(self.left >= 2, 3) + three)

    def _times(self, there: np.ndarray, k: int) -> np.ndarray:
        """Which sums k pieces of one of these lengths have."""
        out = np.zeros(self.capacity + 1, np.int64)
        out[::k] = there[:len(out[::k])]
        return out

    def _sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many ways each sum comes from one of ``a`` and one of ``b``."""
        return np.rint(np.convolve(a.astype(np.float64), b.astype(np.float64))[:self.capacity + 1]).astype(np.int64)

    def take(self, length: int, n: int) -> None:
        before, after = self.left[length], self.left[length] - n
        self.left[length] = after
        if before >= 3 > after and 3 * length <= self.capacity:
            self.triples[3 * length] -= 1
        if before >= 2 > after and 2 * length <= self.capacity:
            self.pairs[2 * length] -= 1
            others = np.flatnonzero(self.some[:self.capacity - 2 * length + 1])
            self.triples[others[others != length] + 2 * length] -= 1
        if after == 0:
            self.some[length] = False
            others = np.flatnonzero(self.some[:self.capacity - length + 1])
            self.pairs[others + length] -= 1
            # Without this length the pairs are those that made triples with it.
            self.triples[length:] -= self.pairs[:self.capacity + 1 - length]

    def longest(self, at_most: int) -> int:
        found = np.flatnonzero(self.some[:at_most + 1])
        return int(found[-1]) if found.size else 0

    def _pair(self, gap: int, used: int = 0) -> list[int] | None:
        """Two lengths with this sum, the longer as long as can be; one of ``used`` is spoken for."""
        if gap < 2 or not self.pairs[gap]:
            return None
        longer = np.arange(gap - 1, (gap - 1) // 2, -1)
        for a in longer[self.some[longer] & self.some[gap - longer]]:
            need = Counter([int(a), gap - int(a), *[used] * bool(used)])
            if all(self.left[x] >= k for x, k in need.items()):
                return [int(a), gap - int(a)]
        return None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly."""
        if self.some[gap]:
            return [gap]
        if found := self._pair(gap):
            return found
        if not self.triples[gap]:
            return None
        third = np.flatnonzero(self.some[:max(gap - 1, 0)])
        for c in third[self.pairs[gap - third] > 0][::-1]:
            if found := self._pair(gap - int(c), int(c)):
                return [int(c), *found]
        return None


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Patterns (length: pieces per sequence) and the number of sequences of each."""
    held = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        held[length] = n
    lengths, plan = Lengths(held), []
    while first := lengths.longest(capacity):
        pattern, gap = Counter([first]), capacity - first
        lengths.take(first, 1)
        while gap:
            if exact := lengths.fill(gap):
                chosen = Counter(exact)
            elif fits := lengths.longest(gap):
                # Far from the end of the gap, tiny pieces go in by the run.
                chosen = Counter({fits: int(max(1, min(lengths.left[fits], gap // fits - 8)))})
            else:
                break
            for length, n in chosen.items():
                lengths.take(length, n)
                gap -= length * n
            pattern += chosen
        more = int(min(lengths.left[length] // n for length, n in pattern.items()))
        if more:
            for length, n in pattern.items():
                lengths.take(length, n * more)
        plan.append((pattern, 1 + more))
    return plan


def _places(plan: list[tuple[Counter, int]]) -> dict[int, np.ndarray]:
    """Of each length: rows of first rank, pieces per sequence, first sequence, first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = Counter(), 0
    for pattern, repeats in plan:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.setdefault(length, []).append((ranks[length], n, sequence, offset))
            ranks[length] += n * repeats
            offset += length * n
        sequence += repeats
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs a ``length`` of 1 to ``capacity``."""
    spark = with_workers(pieces.sparkSession)
    kept = store(pieces.drop("sequence_id", "offset"), "pieces")
    file, row, n, before, place_ = fresh(kept, "_file", "_row", "_n", "_before", "_rank")
    stored = kept.metadataColumn("_metadata")
    filed = kept.select("*", F.xxhash64(stored["file_path"]).alias(file), stored["row_index"].alias(row))
    parts = filed.groupBy("length", file).agg(F.count("*").alias(n))
    along = Window.partitionBy("length").orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    parts = store(parts.select("length", file, n, F.coalesce(F.sum(n).over(along), F.lit(0)).alias(before)), "classes")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum(n).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan_sequences(counts, capacity)))
    inside = Window.partitionBy("length", file).orderBy(row)
    # The ranks need this partitioning anyway; the counts grow with the files and are not broadcast.
    ranked = filed.join(parts.drop(n).hint("merge"), ["length", file]).withColumn(
        place_, F.col(before) + F.row_number().over(inside) - 1).select(*kept.columns, place_)
    carried = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column(place_).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                table = places.value[int(value)]
                step = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                ahead = rank[rows] - step[:, 0]
                sequence[rows] = step[:, 2] + ahead // step[:, 1]
                offset[rows] = step[:, 3] + ahead % step[:, 1] * value
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(tidy(place), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences themselves, of pieces that kept their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read_table(spark, sf_dir, "documents")))
