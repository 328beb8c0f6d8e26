"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at line ends, after end signs, and before a
capital letter, so that a passage pasted into the middle of a sentence still lines
up. Sentences of more than ``LONG`` words are cut into parts before the word with the smallest hash of
each ``WINDOW`` words (winnowing), which depends on those words alone. From every part starts one span,
the shortest run of at least ``MIN_SENTENCES`` parts with at least ``MIN_WORDS`` words. Spans are hashed and
joined over the whole corpus; a part goes if any span that covers it occurred before.

Any 50 words that two texts share hold a full span: parts have at most 12 words, and only the words up to the
first and from the last cut that both texts share (12 of a short sentence, 17 of a long one at either end) can be cut differently.
A word is what stands between blanks; in scripts without blanks, a character.

The first occurrence is the one in the smallest document (by doc_id, then position; documents
without an id come last, by text hash). Repeats inside a document are found where it is read, so
each document sends a span once; counting is pre-aggregated and a passage that a third of all
documents share is an ordinary key of a join that Spark can split. Spans are worked out once and stored with
their characters' places, so a text is cut by places alone and one without repeats passes through.

Defined results: null and empty texts have no sentence and stay as they are; rows that
share a doc_id count as one document in the order, and equal rows get equal results; white space within a span
does not matter; a text without ``MIN_WORDS`` words after a sentence start forms no span there; no
rows give no rows. Columns named ``n_sentences``, ``n_removed`` or ``removed`` are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from thermocline.llm.common import discard, empty_as, read_table, store, tidy, with_workers
from thermocline.llm.ranks import fresh

MIN_SENTENCES = 2
MIN_WORDS = 15
LONG = 12
WINDOW = 9
CAPITALS = "".join(c for c in map(chr, range(0x600)) if c.isupper())
BREAK = re.compile(rf"\s*\n\s*|(?<=[.!?])\s+|(?<=[。！？।॥])\s*|\s+(?=[{CAPITALS}])")
BLANKLESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3003-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff"
HAS_BLANKLESS = re.compile(f"[{BLANKLESS}]")
WORD = re.compile(rf"[{BLANKLESS}]|[^\s{BLANKLESS}]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence, without the white space between them."""
    out, at = [], 0
    for gap in BREAK.finditer(text):
        if gap.start() > at:
            out.append((at, gap.start()))
        at = gap.end()
    if at < len(text.rstrip()):
        out.append((at, len(text.rstrip())))
    return out


def cuts(words: list[str]) -> list[int]:
    """Places of the last smallest hash in each ``WINDOW`` words."""
    hashes = [zlib.crc32(w.encode()) for w in words]
    out, at, least = [], -1, 0
    for end in range(WINDOW - 1, len(hashes)):
        start = end - WINDOW + 1
        if at < start:
            seen = hashes[start:end + 1]
            least = min(seen)
            at = end - seen[::-1].index(least)
            out.append(at)
        elif hashes[end] <= least:
            at, least = end, hashes[end]
            out.append(at)
    return out


def parts(text: str, found_sentences: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """Start and end of every part, its number of words, and its bytes with single blanks."""
    blankless = HAS_BLANKLESS.search(text) is not None
    places, counts, pieces = [], [], []
    for start, end in found_sentences:
        words = text[start:end].split()
        if blankless or len(words) > LONG:
            found = list(WORD.finditer(text, start, end))
            if len(found) > LONG:
                at = [0, *[c for c in cuts([m[0] for m in found]) if c], len(found)]
                for low, high in zip(at, at[1:]):
                    places.append((found[low].start(), found[high - 1].end()))
                    counts.append(high - low)
                    pieces.append(" ".join(text[places[-1][0]:places[-1][1]].split()).encode())
                continue
            counts.append(len(found))
        else:
            counts.append(len(words))
        places.append((start, end))
        pieces.append(" ".join(words).encode())
    return places, counts, pieces


def spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """The parts, and (hash, hash, first part, end part) of each span."""
    return spans_of(text, sentences(text))


def spans_of(text: str, found_sentences: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    found, sizes, joined = parts(text, found_sentences)
    ends, counts, total, size = [], [0], 0, 0
    for piece, n in zip(joined, sizes):
        size += len(piece) + 1
        ends.append(size)
        total += n
        counts.append(total)
    whole, out, end = b" ".join(joined), [], 0
    for start in range(len(found)):
        end = max(end, start + MIN_SENTENCES)
        while end <= len(found) and counts[end] - counts[start] < MIN_WORDS:
            end += 1
        if end > len(found):
            break
        digest = xxhash.xxh3_128_intdigest(whole[ends[start - 1] if start else 0:ends[end - 1] - 1])
        out.append(((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (digest >> 96) - (1 << 31), start, end))
    return found, out


def _order() -> list:
    """A document's place in the order, rows without an id after all others, and its text's hash."""
    none = F.col("doc_id").isNull()
    return [none.alias("late"), F.when(none, F.xxhash64(empty_as())).otherwise(F.col("doc_id")).alias("doc"),
            F.xxhash64(empty_as()).alias("body")]


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row per document and span, with the span's characters; ``own`` marks a span that the text had before.

    One more row per document, with a null ``own``, has its number of sentences as ``start``.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, low, high, own, counts = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                before, seen = len(a), set()
                whole = sentences(text)
                places, found = spans_of(text, whole)
                a.append(0)
                b.append(0)
                low.append(len(whole))
                high.append(0)
                own.append(None)
                for x, y, start, end in found:
                    own.append((x, y) in seen)
                    seen.add((x, y))
                    a.append(x)
                    b.append(y)
                    low.append(places[start][0])
                    high.append(places[end - 1][1])
                counts.append(len(a) - before)
            row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([
                pa.array(a, pa.int64()), pa.array(b, pa.int32()), *[batch.column(c).take(row) for c in ("late", "doc", "body")],
                pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(own, pa.bool_())],
                ["a", "b", "late", "doc", "body", "start", "end", "own"])

    return docs.select(*_order(), empty_as().alias("text")).mapInArrow(
        tidy(emit), "a long, b int, late boolean, doc long, body long, start int, end int, own boolean")


def cut_out(text: str, ranges: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without ranges of characters, and the ranges joined where only white space lies between."""
    removed: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if removed and (start <= removed[-1][1] or not text[removed[-1][1]:start].strip()):
            removed[-1] = (removed[-1][0], max(end, removed[-1][1]))
        else:
            removed.append((start, end))
    rest, at = [], 0
    for start, end in removed:
        rest.append(text[at:start])
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return "".join([*rest, text[at:]]), removed


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; adds n_sentences, n_removed (sentences fewer) and removed (characters)."""
    with_workers(docs.sparkSession)
    docs = docs.drop("n_sentences", "n_removed", "removed")
    late_, doc_, body_, later_, n_ = fresh(docs, "_late", "_doc", "_body", "_later", "_sentences")
    rows = store(_occurrences(docs), "spans")
    once = rows.where("NOT own")
    early = F.when(~F.col("late"), F.col("doc"))
    last = F.when(F.col("late"), F.col("doc"))
    repeated = store(once.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(early).alias("early"), F.min(last).alias("last"))
                     .where("n > 1").select("a", "b", "early", "last"), "repeated-spans")
    first = (F.col("late") & F.col("early").isNull() & (F.col("doc") == F.col("last"))) | (
        ~F.col("late") & (F.col("doc") == F.col("early")))
    place = ["late", "doc", "body", "start", "end"]
    cut_spans = once.join(repeated, ["a", "b"]).where(~first).select(*place, F.lit(True).alias("cut")).union(
        rows.where("own IS NULL OR own").select(*place, F.coalesce("own", F.lit(False)).alias("cut")))
    later = store(cut_spans.groupBy("late", "doc", "body").agg(
        F.collect_set(F.when(F.col("cut"), F.struct("start", "end"))).alias("later"),
        F.max(F.when(~F.col("cut"), F.col("start"))).alias("n")), "later-spans")
    discard(rows)

    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.IntegerType()),
                           T.StructField("n_removed", T.IntegerType()), T.StructField("removed", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone, marks = [], [], [], []
            for text, found, n in zip(*(batch.column(c).to_pylist() for c in ("text", later_, n_))):
                removed = []
                if found:
                    text, removed = cut_out(text, [(x["start"], x["end"]) for x in found])
                texts.append(text)
                counts.append(n)
                gone.append(n - len(sentences(text)) if removed else 0)
                marks.append(",".join(f"{a}:{b}" for a, b in removed))
            out = batch.select(columns).set_column(columns.index("text"), "text", pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), pa.array(marks, pa.string())],
                schema.names)

    late, doc, body = _order()
    keyed = docs.select("*", late.alias(late_), doc.alias(doc_), body.alias(body_))
    found = later.toDF(late_, doc_, body_, later_, n_).hint("shuffle_hash")
    return keyed.join(found, [late_, doc_, body_], "left").select(*columns, later_, n_).mapInArrow(tidy(cut), schema)


def op5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_sentences", "n_removed", "removed", "text")
