"""Quality classifier: a factorisation machine over words, structure and metadata.

A text is a sparse vector: hashed words (square roots of their shares), standardised
structure statistics, and the stored length as metadata. The machine adds to a linear
model the interaction of every pair of features through rank-``RANK`` factors;
by the identity  sum_{i<j} <v_i, v_j> x_i x_j = ((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2
a score takes time linear in the features present.

The model is fitted on about ``TRAIN_ROWS`` labelled rows, half of each class, chosen by
hash; rows are weighted back to the classes' true shares. Features of that bounded sample
come to the driver, at most ``WORD_BUCKETS`` numbers a row. Scoring is one pass without a
shuffle over whole texts.

Defined results: a null or empty text is scored from its (zero) statistics; a
null length is that of the text; equal rows get equal scores; a label that repeats for a
document counts once, of rows that share a labelled id one is learned from (the smallest features); null labels do not count; without labels of both classes every score is the share of
label 1, or 0.5 without any. Null ids are scored but not learned from and count as not held out.
No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.llm.common import LOWER, fold, read_table, tidy, with_workers

WORD_BUCKETS = 4096
TRAIN_ROWS = 6000
RANK = 8
EPOCHS = 12
STEPS = 1200
"""Steps at least, so a small sample is passed over more often."""
BATCH = 64
RATE = 0.05
DECAY = 1e-4
CLIP = 4.0
THRESHOLD = 0.3
SEED = 8

# Classes of bytes: 0 other, 1 lower-case letter, 2 upper-case, 3 digit, 4 blank, 5 sentence
# sign, 6 other sign, 7 part of a non-ASCII character.
CLASSES = np.array([
    1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b" \t\n\r\v\f"
    else 5 if c in b".,;:!?'\"()-" else 6 if 33 <= c <= 126 else 7 if c >= 128 else 0 for c in range(256)], np.uint8)


def statistics(text: str | None, length: int | None) -> np.ndarray:
    """Structure statistics of a text, and its stored length."""
    data = (text or "").encode()
    size = max(1, len(data))
    classes = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=8) / size
    words = data.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()] or [b""]
    sentences = max(1, data.count(b".") + data.count(b"!") + data.count(b"?"))
    return np.array([
        *classes,
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(text or "") if length is None else max(0, length)),
        len(distinct) / n, max(distinct.values(), default=0) / n, len(set(lines)) / len(lines),
        max(Counter(lines).values()) / len(lines), np.log1p(len(lines)), np.log1p(n / len(lines)),
        np.log1p(n / sentences), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines) / len(lines),
        data.count(b"!") / n, data.count(b"|") / n, data.count(b"#") / n, data.count(b"http") / n, data.count(b"@") / n,
    ])


STATISTICS = len(statistics("", 0))


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's words and the square roots of their shares."""
    counts = Counter((text or "").encode().translate(LOWER).split())
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    hashed = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORD_BUCKETS
    shares = np.bincount(hashed, np.fromiter(counts.values(), np.float64, len(counts)), WORD_BUCKETS)
    found = np.flatnonzero(shares)
    return found, np.sqrt(shares[found] / shares.sum())


class Machine:
    """A fitted factorisation machine: means and scales of the statistics, weights and factors."""

    def __init__(self, prior: float):
        self.prior, self.fitted = prior, False

    def vector(self, statistic: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        standard = np.clip((statistic - self.mean) / self.scale, -CLIP, CLIP) / np.sqrt(STATISTICS)
        return np.concatenate((np.arange(STATISTICS), words[0] + STATISTICS)), np.concatenate((standard, words[1]))

    def raw(self, index: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The score before the logistic, the factors times values, and their sums."""
        scaled = self.factors[index] * value[:, None]
        whole = scaled.sum(axis=0)
        return self.bias + self.weights[index] @ value + 0.5 * (whole @ whole - np.vdot(scaled, scaled)), scaled, whole

    def fit(self, rows: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]], labels: np.ndarray, weight: np.ndarray) -> None:
        """Adagrad on the weighted logistic loss, in a fixed random order."""
        random = np.random.default_rng(SEED)
        stats = np.array([s for s, _ in rows])
        self.mean, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
        n = STATISTICS + WORD_BUCKETS
        self.bias = float(np.log(self.prior / (1 - self.prior)))
        self.weights, self.factors = np.zeros(n), random.normal(0, 0.05, (n, RANK))
        seen_b, seen_w, seen_f = 1e-8, np.full(n, 1e-8), np.full((n, RANK), 1e-8)
        vectors = [self.vector(*row) for row in rows]
        for _ in range(max(EPOCHS, STEPS * BATCH // len(rows))):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                chosen = order[at:at + BATCH]
                indexes, slopes_w, slopes_f, total = [], [], [], 0.0
                for row in chosen:
                    index, value = vectors[row]
                    raw, scaled, whole = self.raw(index, value)
                    slope = weight[row] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[row]) / len(chosen)
                    total += slope
                    indexes.append(index)
                    slopes_w.append(slope * value)
                    slopes_f.append(slope * value[:, None] * (whole - scaled))
                touched, place = np.unique(np.concatenate(indexes), return_inverse=True)
                g_w = np.bincount(place, np.concatenate(slopes_w)) + DECAY * self.weights[touched]
                g_f = np.zeros((len(touched), RANK))
                np.add.at(g_f, place, np.concatenate(slopes_f))
                g_f += DECAY * self.factors[touched]
                seen_b += total * total
                seen_w[touched] += g_w * g_w
                seen_f[touched] += g_f * g_f
                self.bias -= RATE * total / np.sqrt(seen_b)
                self.weights[touched] -= RATE * g_w / np.sqrt(seen_w[touched])
                self.factors[touched] -= RATE * g_f / np.sqrt(seen_f[touched])
        self.fitted = True

    def score(self, text: str | None, length: int | None) -> float:
        if not self.fitted:
            return self.prior
        raw = self.raw(*self.vector(statistics(text, length), words_of(text)))[0]
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on labelled rows: ``docs`` (doc_id, text, n_chars) and ``labels`` (doc_id, quality)."""
    with_workers(docs.sparkSession)
    labels = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    held = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(held.values())
    machine = Machine(held.get(1, 0) / total if total else 0.5)
    if len(held) < 2:
        return machine
    part = F.create_map(*[F.lit(x) for label, n in held.items() for x in (label, min(1.0, rows / 2 / n))])
    chosen = labels.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(23)), 11) < part[F.col("quality")] * F.lit(2.0 ** 53)).distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            found = [words_of(text) for text in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("quality"),
                pa.array([statistics(t, n) for t, n in zip(texts, lengths)], pa.list_(pa.float64())),
                pa.array([index.astype(np.int32) for index, _ in found], pa.list_(pa.int32())),
                pa.array([value.astype(np.float32) for _, value in found], pa.list_(pa.float32())),
            ], ["doc_id", "quality", "statistics", "index", "value"])

    # The chosen labels are about ``rows`` in number, so they are sent to the scan.
    sample = (docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")
              .mapInArrow(tidy(features), "doc_id long, quality int, statistics array<double>, index array<int>, value array<float>")
              # a hot id sends one row per task and arrives as one
              .groupBy("doc_id", "quality").agg(F.min(F.struct("statistics", "index", "value")).alias("f"))
              .select("doc_id", "quality", "f.*").toArrow().to_pylist())
    if len({r["quality"] for r in sample}) < 2:
        return machine
    # In a fixed order, however the tasks ended.
    sample.sort(key=lambda r: (r["doc_id"], r["quality"], r["statistics"], r["index"]))
    marks = np.array([r["quality"] for r in sample], np.float64)
    ones = marks.mean()
    weight = np.where(marks == 1, machine.prior / ones, (1 - machine.prior) / (1 - ones))
    machine.fit([(np.array(r["statistics"]), (np.array(r["index"], np.int64), np.array(r["value"], np.float64))) for r in sample],
                marks, weight)
    return machine


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    model = with_workers(docs.sparkSession).sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(text.as_py(), n.as_py())
                      for text, n in zip(batch.column("text"), batch.column("n_chars"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text", "n_chars").mapInArrow(tidy(score), "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = score_quality(docs, learn(docs.where(fold("doc_id", 5) != 0), labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
