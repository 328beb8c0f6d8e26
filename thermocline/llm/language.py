"""Language identification by multilingual mixture inference.

A text is a mixture of languages. Each language has a distribution over hashed
character trigrams, counted on labelled documents. For a text,
expectation-maximisation estimates the proportions of all languages from its
trigram likelihoods; then the sets of its strongest languages, one more each time,
are refitted as long as the penalised likelihood rises, and the last set wins. The text's language is the
set's largest share; ``identify`` returns the whole set with its shares.

Training reads whole texts of about ``TRAIN_TEXTS`` rows per language (the
lowest part of the hash range), counted by Spark; the model has one row per
trigram bucket and one column per language, half a megabyte each. Scoring
is one pass without a shuffle; a long text is counted in blocks that overlap by what a trigram spans, so its
counts are those of the whole.

Defined results: a null text or one without a letter is ``und`` with score 0; a
text of one or two letters still forms a trigram with its borders; ties go to
the language that sorts first; repeated rows get equal rows; null ids are
scored but never learned from and count as not held out. With nothing to learn from every text is
``und``. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from thermocline.llm.common import fold, read_table, tidy, with_workers

BUCKETS = 1 << 16
TRAIN_TEXTS = 1000
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 3.0
OVERLAP = 3.0
"""Trigrams share characters: a text's evidence is that of a third of them."""
BLOCK_CHARS = 400_000
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(lowered: str) -> np.ndarray:
    """Letters as code points; every run of other characters is one 0."""
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    if not points.size:
        return points
    keep = np.ones(points.size, bool)
    keep[1:] = (points[1:] > 0) | (points[:-1] > 0)
    return points[keep]


def _buckets(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every trigram around a letter."""
    codes = codes.astype(np.uint64)
    if codes.size < 3:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
                 + codes[2:] * np.uint64(0x165667B19E3779F9))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[codes[1:-1] > 0]


def trigrams(text: str, buckets: int) -> np.ndarray:
    """Bucket of every trigram around a letter, text borders included."""
    return _buckets(np.concatenate(([0], _codes(text.lower()), [0])), buckets)


def _counted(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    if len(text) <= BLOCK_CHARS:
        return np.unique(trigrams(text, buckets), return_counts=True)
    total, last = np.zeros(buckets, np.int64), np.zeros(1, np.uint32)
    lowered = text.lower()
    for start in range(0, len(lowered), BLOCK_CHARS):
        codes = _codes(lowered[start:start + BLOCK_CHARS])
        if last[-1] == 0 and codes.size and codes[0] == 0:
            codes = codes[1:]  # one run of other characters over both blocks
        codes = np.concatenate((last, codes))
        total += np.bincount(_buckets(codes, buckets), minlength=buckets)
        last = codes[-2:]  # its last letter has no trigram yet
    total += np.bincount(_buckets(np.concatenate((last, [0])), buckets), minlength=buckets)
    found = np.flatnonzero(total)
    return found, total[found]


def learn(docs: DataFrame, per_language: int = TRAIN_TEXTS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log probabilities, from rows with ``text`` and ``lang``."""
    with_workers(docs.sparkSession)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(held)
    if not languages:
        return [], np.zeros((1, 0))
    buckets = BUCKETS
    # A text is learned from if its hash is in the lowest part of the hash range
    # that holds ``per_language`` of the language's rows.
    part = F.create_map(*[F.lit(x) for lang, n in held.items() for x in (lang, min(1.0, per_language / n))])
    chosen = F.shiftrightunsigned(F.xxhash64("text", F.lit(17)), 11) < part[F.col("lang")] * F.lit(2.0 ** 53)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found, counts = _counted(text.as_py(), buckets)
                seen.setdefault(lang, np.zeros(buckets, np.int64))[found] += counts
        for lang, counts in seen.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(counts[found])],
                ["lang", "bucket", "n"])

    sums = (rows.where(chosen).mapInArrow(tidy(count), "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.full((buckets, len(languages)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    counts[sums["bucket"].to_numpy(), [place[x] for x in sums["lang"].to_pylist()]] += sums["n"].to_numpy()
    return languages, np.log(counts / counts.sum(axis=0))


class Mixtures:
    """Expectation-maximisation for many texts at once; a text is a run of trigram rows."""

    def __init__(self, log_p: np.ndarray, counted: list[tuple[np.ndarray, np.ndarray]]):
        sizes = [len(found) for found, _ in counted]
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.counts = np.concatenate([c for _, c in counted]).astype(np.float64)
        logs = log_p[np.concatenate([f for f, _ in counted])]
        self.total = np.add.reduceat(self.counts, self.starts)
        self.single = np.add.reduceat(logs * self.counts[:, None], self.starts)
        self.p = np.exp(logs)

    def fit(self, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after ``rounds`` steps and their log likelihoods; a share of zero stays zero."""
        likelihood = None
        for step in range(rounds + 1):
            weighted = self.p * shares[self.owner]
            whole = weighted.sum(axis=1)
            if step == rounds:
                likelihood = np.add.reduceat(self.counts * np.log(whole), self.starts)
                break
            shares = np.add.reduceat(weighted * (self.counts / whole)[:, None], self.starts) / self.total[:, None]
        return shares, likelihood

    def select(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best set's shares, its likelihood per trigram, and the posterior of the best single language."""
        n, k = self.single.shape
        everything, _ = self.fit(np.full((n, k), 1 / k), ROUNDS)
        ranked = np.argsort(-everything, axis=1, kind="stable")
        best = np.zeros((n, k))
        best[np.arange(n), self.single.argmax(axis=1)] = 1.0
        value = self.single.max(axis=1)
        likelihood = value.copy()
        rising = np.ones(n, bool)
        for size in range(2, k + 1):
            shares = np.zeros((n, k))
            np.put_along_axis(shares, ranked[:, :size], np.take_along_axis(everything, ranked[:, :size], 1) + 1e-9, 1)
            shares, whole = self.fit(shares / shares.sum(axis=1, keepdims=True), ROUNDS // 2)
            penalised = whole - OVERLAP * PENALTY * (size - 1) * np.log(self.total + 1)
            better = rising & (penalised > value)
            if not better.any():
                break
            rising = better
            best[better], value[better], likelihood[better] = shares[better], penalised[better], whole[better]
        odds = np.exp((self.single - self.single.max(axis=1, keepdims=True)) / OVERLAP)
        return best, likelihood / self.total, (odds / odds.sum(axis=1, keepdims=True))


Found = tuple[str, float, float, list[dict]]


def predict(texts: list[str | None], languages: list[str], log_p: np.ndarray) -> list[tuple[str, float, float]]:
    """``infer`` without the mixtures."""
    return [found[:3] for found in infer(texts, languages, log_p)]


def infer(texts: list[str | None], languages: list[str], log_p: np.ndarray) -> list[Found]:
    """(language, score, nats per trigram better than a uniform guess, its languages with shares) of every text."""
    out: list[Found] = [(NONE, 0.0, 0.0, [])] * len(texts)
    waiting, chars = [], 0

    def flush() -> None:
        if waiting:
            best, fit, posterior = Mixtures(log_p, [c for _, c in waiting]).select()
            top = best.argmax(axis=1)
            for row, (place, _) in enumerate(waiting):
                share = best[row, top[row]]
                score = share * (posterior[row, top[row]] if share > 0.999 else 1.0)
                mixture = [{"lang": languages[i], "share": float(best[row, i])}
                           for i in np.argsort(-best[row], kind="stable") if best[row, i] > 0]
                out[place] = (languages[top[row]], float(min(1.0, score)), float(fit[row] + np.log(len(log_p))), mixture)
            waiting.clear()

    for place, text in enumerate(texts):
        if text and languages:
            found, counts = _counted(text, len(log_p))
            if found.size:
                waiting.append((place, (found, counts)))
                chars += len(text)
        if chars > BLOCK_CHARS:
            flush()
            chars = 0
    flush()
    return out


FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType()),
    T.StructField("mixture", T.ArrayType(T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))),
])
_ARROW = [pa.string(), pa.float64(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, fit and mixture (languages with their shares, largest first) of every row."""
    session = with_workers(docs.sparkSession).sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = infer(batch.column("text").to_pylist(), *session.value)
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], FOUND.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(score), FOUND)


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Rows, unchanged, whose text has letters and fits its languages better than chance."""
    session = with_workers(docs.sparkSession).sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(batch.column("text").to_pylist(), *session.value)
            yield batch.filter(pa.array([lang != NONE and fit > 0 for lang, _, fit in found], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents outside the held-out fold."""
    return docs.where(fold("doc_id", 4) != 2).select("lang", "text")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, learn(training_rows(docs)))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "fit", "mixture")
