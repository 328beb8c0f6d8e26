"""Ranked lexical search over per-shard inverted lists by hybrid TAAT-DAAT.

``build_index`` turns consecutive documents into shards of bounded size. A shard is a small index: one row per
term with the places and counts of the documents that hold it, and one row
(null term) with ids and lengths. Words are interned per shard (``grams.Interned``); nothing is shuffled.

``search`` sends the lists of the queried terms to their shards, a shard to one
task. A query's short lists are summed term at a time into accumulators; these then act
as one iterator, whose bound is the largest sum, beside the long lists, whose bounds are their largest
contributions. Documents are visited in order, a stretch at a time: iterators whose bounds together stay
below the k-th best score so far cannot bring a document in, they are only
looked up (by bisection, so stretches between candidates are skipped) for documents the others bring, the largest bound first, while a
document can still reach the score. The best k of a query are kept across all shards of a task.

Scores are exact 64-bit integers, so pruning loses nothing; a document is dropped only
strictly below the k-th score, and equal scores rank by id. Queries are broadcast in
blocks of ``BLOCK_BYTES`` of text; a block reads the terms' lists once for document frequencies, once for scores.

Defined results: a null or empty text has no term and is never found; documents with equal ids
are documents of their own, a null id comes first among equal scores; rows that share an item id are one item with
all their terms; an item without a term, or whose terms occur nowhere, has no row; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from thermocline.llm.common import read_table, store, tidy, with_workers
from thermocline.llm.grams import Interned, Words, pieces

TOP = 10
SHARD_ROWS = 4096
BLOCK_BYTES = 8 << 20
SHORT = 1 / 16
"""Lists are summed into accumulators, the shortest first, until they hold this share of the shard's documents."""
STRETCH = 1024
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX = "shard long, term string, holders int, places array<int>, counts array<long>, ids array<long>"


def build_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stored index of ``docs(key, text)``."""
    with_workers(docs.sparkSession)
    arrow = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("holders", pa.int32()),
                       ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for number, piece in enumerate(pieces(batches, rows=SHARD_ROWS)):
            shard, words, rows = partition << 32 | number, Words.of(piece["text"]), piece.num_rows
            ids = piece[key].to_pylist()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "holders": rows, "counts": words.count.tolist(), "ids": ids}], schema=arrow)
            if not len(words):
                continue
            table = Interned.of(words)
            pairs, counts = np.unique(table.slot * rows + words.row, return_counts=True)
            slot, place = np.divmod(pairs, rows)
            at = np.flatnonzero(np.diff(slot, prepend=-1))
            holders = np.diff(at, append=len(slot))
            offsets = np.append(at, len(slot)).astype(np.int32)
            none = pa.nulls(len(at), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), shard)), words.strings(table.owner[slot[at]]), pa.array(holders.astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))), none], schema=arrow)

    rows = docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(tidy(task), INDEX)
    return store(rows, "lexical-index")


class Best:
    """The best k documents of every query met so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        none = np.zeros(0, np.int64)
        self.of = [(none, none, none.astype(bool))] * queries  # scores, ids, whether there is an id

    def least(self, query: int) -> int:
        """What a document must score; any score above zero while there are fewer than k."""
        scores = self.of[query][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = (np.concatenate(pair) for pair in zip(self.of[query], (scores, ids, known)))
        order = np.lexsort((ids, known, -scores))[:self.k]
        self.of[query] = scores[order], ids[order], known[order]


class Shard:
    """The lists of one shard, ready for queries."""

    def __init__(self, lists: dict[str, tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, ids: np.ndarray,
                 known: np.ndarray, documents: int, words: int):
        self.lists, self.ids, self.known = lists, ids, known
        self.norms = 100 - 90 + (90 * lengths * documents) // max(words, 1)
        self.ready: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}

    def list_of(self, term: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places, contributions at weight one, and the largest of them."""
        if term not in self.ready:
            places, counts = self.lists[term]
            gives = (1_000_000_000 * counts) // (1000 * counts + 8 * self.norms[places])
            self.ready[term] = places, gives, int(gives.max())
        return self.ready[term]

    def search(self, query: int, terms: list[tuple[str, int]], best: Best) -> None:
        found = sorted(((weight, *self.list_of(term)) for term, weight in terms if weight and term in self.lists),
                       key=lambda x: len(x[1]))
        # Term at a time: short lists become one.
        short, room = 0, max(1, int(SHORT * len(self.ids)))
        while short < len(found) and len(found[short][1]) <= room:
            room -= len(found[short][1])
            short += 1
        iterators = [(places, weight * gives, weight * most) for weight, places, gives, most in found[short:]]
        if short:
            places = np.concatenate([f[1] for f in found[:short]])
            order = np.argsort(places, kind="stable")
            gives = np.concatenate([f[0] * f[2] for f in found[:short]])[order]
            first = np.flatnonzero(np.diff(places[order], prepend=-1))
            sums = np.add.reduceat(gives, first)
            iterators.append((places[order][first], sums, int(sums.max())))
        # Document at a time: bounds of the iterators, the smallest first, summed.
        iterators.sort(key=lambda x: x[2])
        upto = np.cumsum([0, *[bound for _, _, bound in iterators]])
        at = 0
        while True:
            least = best.least(query)
            leading = int(np.searchsorted(upto[1:], least))  # those before cannot reach it together
            lead = iterators[leading:]
            starts = [np.searchsorted(places, at) for places, _, _ in lead]
            nexts = [int(places[s]) for (places, _, _), s in zip(lead, starts) if s < len(places)]
            if not nexts:
                return
            at = min(nexts) + STRETCH
            parts = [slice(s, np.searchsorted(places, at)) for (places, _, _), s in zip(lead, starts)]
            places = np.concatenate([it[0][p] for it, p in zip(lead, parts)])
            order = np.argsort(places, kind="stable")
            gives = np.concatenate([it[1][p] for it, p in zip(lead, parts)])[order]
            first = np.flatnonzero(np.diff(places[order], prepend=-1))
            docs, scores = places[order][first], np.add.reduceat(gives, first)
            for rest in range(leading - 1, -1, -1):
                alive = scores + upto[rest + 1] >= least
                docs, scores = docs[alive], scores[alive]
                places, gives, _ = iterators[rest]
                place = np.searchsorted(places, docs)
                there = place < len(places)
                there[there] = places[place[there]] == docs[there]
                scores = scores.copy()
                scores[there] += gives[place[there]]
            good = scores >= least
            if good.any():
                best.add(query, scores[good], self.ids[docs[good]], self.known[docs[good]])


def _shards(batches: Iterator[pa.RecordBatch], documents: int, words: int) -> Iterator[Shard]:
    """Shards from rows of the index in order of shard."""
    def ready() -> Shard:
        return Shard(lists, *lengths, documents, words)

    now, lists, lengths = None, {}, None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        for i in range(batch.num_rows):
            if shard[i] != now:
                if lists:
                    yield ready()
                now, lists, lengths = shard[i], {}, None
            term, counts = batch.column("term")[i].as_py(), batch.column("counts")[i].values.to_numpy()
            if term is None:
                ids = batch.column("ids")[i].values
                lengths = counts, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            else:
                lists[term] = batch.column("places")[i].values.to_numpy(), counts
    if lists:
        yield ready()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``(item_id, term)``."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(f"({PATTERN})"))
    return items.select("item_id", F.explode(words).alias("term")).distinct()


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best ``k`` documents of every item of ``items(item_id, text)``."""
    spark = with_workers(index.sparkSession)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
    with_term = F.size(F.filter("counts", lambda n: n > 0)).cast("long")
    lengths = index.where(F.col("term").isNull())
    stats = lengths.agg(F.coalesce(F.sum(with_term), F.lit(0)).alias("documents"), F.coalesce(F.sum(total), F.lit(0)).alias("words")).first()
    documents, words = stats["documents"], stats["words"]
    terms = store(item_terms(items), "query-terms")
    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    hits = None
    for number in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        wanted = F.broadcast(block.select("term").distinct())  # a block is at most about BLOCK_BYTES
        held = index.where(F.col("term").isNotNull()).join(wanted, "term", "left_semi")
        frequency = held.groupBy("term").agg(F.sum("holders").alias("df"))
        weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("df") + 1)))
        weighed = block.join(frequency, "term").select("item_id", "term", weight.alias("weight")).toArrow()
        lists = held.unionByName(lengths).repartition("shard").sortWithinPartitions("shard")
        found = _block_hits(lists, weighed, documents, words, k, schema)
        found = store(found, "lexical-hits") if blocks > 1 else found
        hits = found if hits is None else hits.unionByName(found)
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block_hits(lists: DataFrame, weighed: pa.Table, documents: int, words: int, k: int, schema: T.StructType) -> DataFrame:
    """The best ``k`` of every item of a block, per task."""
    names = weighed["item_id"].unique()
    number = {name: i for i, name in enumerate(names.to_pylist())}
    queries: list[list[tuple[str, int]]] = [[] for _ in names]
    for item, term, weight in zip(*(weighed[c].to_pylist() for c in ("item_id", "term", "weight"))):
        queries[number[item]].append((term, weight))
    shared = lists.sparkSession.sparkContext.broadcast((names, queries))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        best = Best(len(queries), k)
        for shard in _shards(batches, documents, words):
            for query, terms in enumerate(queries):
                shard.search(query, terms, best)
        for query, (scores, ids, known) in enumerate(best.of):
            if len(scores):
                item = names.take(pa.array(np.full(len(scores), query)))
                yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=~known), pa.array(scores)], ["item_id", "doc_id", "score"])

    return lists.mapInArrow(tidy(task), schema)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    index = build_index(read_table(spark, sf_dir, "documents"))
    return search(index, read_table(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS terms FROM documents),
stats AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
w AS (
  SELECT term, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM tf, stats WHERE term IN (SELECT term FROM q) GROUP BY term),
n AS (SELECT r, doc_id, 100 - 90 + (90 * len(terms)::BIGINT * docs) // words AS m FROM d, stats WHERE len(terms) > 0),
scored AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r) GROUP BY item_id, r)
SELECT item_id, row_number() OVER best ::INTEGER AS rank, doc_id, score
FROM scored JOIN n USING (r) WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)
QUALIFY row_number() OVER best <= {TOP}
"""
