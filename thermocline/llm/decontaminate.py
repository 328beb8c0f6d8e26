"""Benchmark decontamination with an FM-index per training shard.

A test phrase is every window of ten consecutive words of an item (a shorter
item is one phrase). Training documents are read in shards of about a million
words. A shard's words become numbers, its suffixes are sorted, and the Burrows-Wheeler
transform goes into a wavelet matrix with ranks. All phrases are searched backwards at
once; found rows are located by walking to sampled suffix positions; the covered
words of each document merge into removal spans.

Words that occur in no phrase only end a match, so a run of them is one
separator in the index, and runs too short to hold any phrase are left out; nothing that could match is.

The benchmark is read in blocks of about ``BLOCK_BYTES``, each broadcast for a
pass of its own (stored before the next), so its size is not limited by memory.
The documents are never shuffled and a task holds one shard at a time (a longer
document is a shard of its own).

Defined results: a null text has no words; equal rows get equal rows; an
item_id that repeats counts once, a null one is listed as ``null``; an empty benchmark
hits nothing; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from thermocline.llm.common import discard, read_table, store, tidy, with_texts, with_workers

WINDOW = 10
SHARD_WORDS = 1 << 20
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 24 << 20
PATTERN_ROWS = 1 << 16
HASH_STEP = 0x9E3779B97F4A7C15
SAMPLE = 16
OTHER = 1
"""Symbol of words outside the phrases; 0 ends the shard."""
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the sorted depth of those not yet apart."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for step in range(depth):
        key <<= bits
        key[:n - step] |= symbols[step:] if step < n else 0
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(n, bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        lone = first & np.append(first[1:], True)
        open_ = np.flatnonzero(~lone)
        if not open_.size:
            return order
        suffixes = order[open_]
        after = np.minimum(suffixes + depth, n)
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[suffixes]
        inner = np.argsort(group * (n + 1) + following, kind="stable")
        order[open_] = suffixes = suffixes[inner]
        group, following = group[inner], following[inner]
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
        first[open_] = new
        rank[suffixes] = np.maximum.accumulate(np.where(new, open_, 0))
        depth *= 2


class Bits:
    """A bit vector with constant-time ranks: packed words and a running count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        inside = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Backward search and location over a sequence of symbols; the last one must be 0 and unique."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(symbols)
        self.n, self.sample = len(symbols), sample
        self.levels = list(range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1))
        counts = np.bincount(symbols, minlength=int(symbols.max()) + 2)
        self.less = np.concatenate(([0], np.cumsum(counts)))
        column = symbols[order - 1]
        self.bits, self.zeros = [], []
        for level in self.levels:
            ones = (column >> level & 1).astype(bool)
            self.bits.append(Bits(ones))
            self.zeros.append(int(len(ones) - ones.sum()))
            column = np.concatenate((column[~ones], column[ones]))
        self.origin = self._descend(np.arange(len(counts)), np.zeros(len(counts), np.int64))
        sampled = order % sample == 0
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(self.levels, self.bits, self.zeros):
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each row of the transform."""
        return self._descend(symbol, at) - self.origin[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of the suffixes that start with each pattern."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero(patterns.max(axis=1) < len(self.origin)) if len(patterns) else np.zeros(0, np.int64)
        high[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            low[alive] = self.less[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.less[symbol] + self.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, high

    def _previous(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one position earlier."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for level, bits, zeros in zip(self.levels, self.bits, self.zeros):
            ones, bit = bits.rank(at), bits.get(at)
            symbol |= bit.astype(np.int64) << level
            at = np.where(bit, zeros + ones, at - ones)
        return self.less[symbol] + at - self.origin[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        position, row = np.zeros(len(rows), np.int64), rows.astype(np.int64)
        waiting = np.arange(len(rows))
        for steps in range(self.n):
            here = self.sampled.get(row)
            position[waiting[here]] = self.positions[self.sampled.rank(row[here])] + steps
            waiting, row = waiting[~here], row[~here]
            if not waiting.size:
                break
            row = self._previous(row)
        return position


class Phrases:
    """The distinct windows of a block of items, as symbols, with the items of each.

    All words of the block are one array and a window is its first place there, so a block takes
    a few times its size however long the windows are.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.symbols: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        texts, starts, owners, sizes, total = [], [], [], [], 0
        for item, text in items:
            codes = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in words_of(text)]
            size = min(window, len(codes))
            if size:
                at = np.arange(total, total + len(codes) - size + 1)
                texts.append(np.array(codes, np.int32))
                starts.append(at)
                owners.append(np.full(len(at), number[item], np.int32))
                sizes.append(np.full(len(at), size, np.int32))
                total += len(codes)
        self.codes = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        if not texts:
            self.shortest = 0
            return
        starts, owners, sizes = np.concatenate(starts), np.concatenate(owners), np.concatenate(sizes)
        for size in np.unique(sizes).tolist():
            chosen = sizes == size
            self.by_length.append((size, *self._distinct(starts[chosen], owners[chosen], size)))
        self.shortest = self.by_length[0][0]

    def _distinct(self, starts: np.ndarray, owners: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One place of each window, and where its owners begin and end among the owners.

        Windows are brought together by a hash and told apart by their words; two that share the hash by chance
        may be listed more than once, which changes no match.
        """
        key = np.zeros(len(starts), np.uint64)
        for column in range(size):
            key = (key ^ self.codes[starts + column].astype(np.uint64)) * np.uint64(HASH_STEP)
            key ^= key >> np.uint64(29)
        order = np.lexsort((owners, key))
        starts, owners = starts[order], owners[order]
        new = np.ones(len(starts), bool)
        new[1:] = False
        for column in range(size):
            word = self.codes[starts + column]
            new[1:] |= word[1:] != word[:-1]
        first = np.flatnonzero(new)
        return starts[first].astype(np.int32), np.append(first, len(starts)).astype(np.int32), owners

    def patterns(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of one length, a block of rows at a time, with the bounds of each one's owners, and the owners."""
        for size, starts, bounds, owners in self.by_length:
            for low in range(0, len(starts), PATTERN_ROWS):
                at = starts[low:low + PATTERN_ROWS, None] + np.arange(size, dtype=np.int32)
                yield self.codes[at].astype(np.int64), bounds[low:low + PATTERN_ROWS + 1], owners

    def items(self, owners: np.ndarray) -> list[str]:
        return [self.names[i] for i in owners.tolist()]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Shard:
    """Documents gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.origins, self.size, self.bytes = phrases, [], [], 0, 0
        self.documents = 0

    def add(self, text: str | None) -> int:
        """Take a document; returns its number of words."""
        words, number = words_of(text), self.documents
        self.documents += 1
        self.bytes += len(text or "")
        shortest = self.phrases.shortest
        if not shortest or len(words) < shortest:
            return len(words)
        codes = np.fromiter(map(self.phrases.symbols.get, words, repeat(OTHER)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes != OTHER, [False]))))
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start >= shortest:
                self.parts += [codes[start:end], [OTHER]]
                self.origins.append((self.size, number, start))
                self.size += int(end - start) + 1
        return len(words)

    def matches(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Of each hit document: covered word ranges and items."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if not self.parts:
            return spans, items
        index = FMIndex(np.concatenate([*self.parts, [0]]).astype(np.int64))
        origins = np.array(self.origins, np.int64)
        for patterns, bounds, owners in self.phrases.patterns():
            low, high = index.search(patterns)
            found = np.flatnonzero(high > low)
            sizes = (high - low)[found]
            rows = np.arange(sizes.sum()) + np.repeat(low[found] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            at = index.locate(rows)
            run = np.searchsorted(origins[:, 0], at, side="right") - 1
            document, start = origins[run, 1], origins[run, 2] + at - origins[run, 0]
            for number, word, pattern in zip(document.tolist(), start.tolist(), np.repeat(found, sizes).tolist()):
                spans.setdefault(number, []).append((word, word + patterns.shape[1]))
                items.setdefault(number, set()).update(self.phrases.items(owners[bounds[pattern]:bounds[pattern + 1]]))
        return spans, items


FOUND = [
    T.StructField("_n_words", T.LongType()),
    T.StructField("_spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("_items", T.ArrayType(T.StringType())),
]
_ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]


def _answered(batches: list[pa.RecordBatch], counts: list[int], shard: Shard) -> Iterator[pa.RecordBatch]:
    """The shard's batches with what was found, added to what earlier blocks found."""
    spans, items = shard.matches()
    number = 0
    for batch in batches:
        rows = range(number, number + batch.num_rows)
        number += batch.num_rows
        kept = [name for name in batch.schema.names if name not in ("_n_words", "_spans", "_items")]
        earlier = "_spans" in batch.schema.names
        old_spans = batch.column("_spans").to_pylist() if earlier else repeat([])
        old_items = batch.column("_items").to_pylist() if earlier else repeat([])
        merged = [[{"start": a, "end": b} for a, b in _joined([(s["start"], s["end"]) for s in old] + spans.get(i, []))]
                  for i, old in zip(rows, old_spans)]
        listed = [sorted({*old, *items.get(i, ())}) for i, old in zip(rows, old_items)]
        found = [pa.array(list(x), kind) for x, kind in zip(([counts[i] for i in rows], merged, listed), _ARROW)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], [*kept, *[f.name for f in FOUND]])


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without the characters from the first to the last word of each range."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for span in spans:
        out.append(text[at:places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return "".join([*out, text[at:]])


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, finish, schema: T.StructType) -> DataFrame:
    """``docs`` through one pass per block; ``finish`` turns the last pass's batches into rows of ``schema``.

    A pass is one Python worker per task: with several blocks the passes are
    stored between, so workers and blocks never add up.
    """
    spark = with_workers(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    inner = T.StructType([*docs.schema.fields, *FOUND])
    found = docs
    for number in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).toArrow()
        phrases = spark.sparkContext.broadcast(
            Phrases(list(zip(block["item"].to_pylist(), block["text"].to_pylist())), window))
        last = number == blocks - 1

        def scan(batches: Iterator[pa.RecordBatch], phrases=phrases, last=last) -> Iterator[pa.RecordBatch]:
            shard, held, counts = Shard(phrases.value), [], []
            for batch in batches:
                held.append(batch)
                counts += [shard.add(text.as_py()) for text in batch.column("text")]
                if shard.size >= SHARD_WORDS or shard.bytes >= SHARD_BYTES:
                    yield from map(finish, _answered(held, counts, shard)) if last else _answered(held, counts, shard)
                    shard, held, counts = Shard(phrases.value), [], []
            yield from map(finish, _answered(held, counts, shard)) if last else _answered(held, counts, shard)

        previous, found = found, found.mapInArrow(tidy(scan), schema if last else inner)
        if not last:
            found = store(found, "phrases")
        if 0 < number < blocks - 1:
            discard(previous)
    return found


def _as_found(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``_n_words``, ``_spans`` (merged word ranges) and ``_items`` (ids as sorted text)."""
    docs = docs.drop(*[f.name for f in FOUND])
    return _scanned(docs, benchmark, window, _as_found, T.StructType([*docs.schema.fields, *FOUND]))


def remove_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same rows and columns with benchmark passages cut out of ``text``."""
    # Columns of the caller that have a name of ours step aside meanwhile.
    aside = {f.name: f"_kept{f.name}" for f in FOUND if f.name in docs.columns}
    inner = docs.withColumnsRenamed(aside)
    columns = inner.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [without_spans(text.as_py(), spans.as_py()) if len(spans) else text.as_py()
                 for text, spans in zip(batch.column("text"), batch.column("_spans"))]
        return with_texts(batch, texts).select(columns)

    found = _scanned(inner, benchmark, window, cut, inner.schema)
    return found.withColumnsRenamed({new: old for old, new in aside.items()})


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_phrases(docs, read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size,
         array_to_string(w[i + 1:i + least({WINDOW}, len(w))], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (
  SELECT r, i, size, array_to_string(w[i + 1:i + size], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, occ.size, item_id FROM occ JOIN win ON occ.size = win.size AND occ.words = win.words),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, 'null') AS name FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
