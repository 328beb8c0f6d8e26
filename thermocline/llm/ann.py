"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (random signs and a
Hadamard transform, three times) and hashed to its nearest signed axis. A table's bucket
joins the axes of one or more rotations, the last over fewer axes, so that a bucket
holds about ``OCCUPANCY`` vectors at any corpus size. ``TABLES`` tables hold every vector; a query
looks into the ``probes`` buckets nearest to its rotated image in each. What
is met is reranked by the exact Euclidean distance of the original vectors.

Equal vectors are one class, indexed once, with its smallest ids; a class of any
size is found, ranked and expanded as one, so no bucket fills with copies. Only ids
travel through the tables; vectors join once for reranking, and query vectors are
sent to the tasks in blocks of ``BLOCK_QUERIES``. Queries that met too few
candidates are answered exactly, in such blocks against all classes.

Measured recall of the 10 nearest (test tables, nearly random directions in 64 dimensions):
see the README. Beyond 65,536 classes probes grow with the power 0.4 of the classes.

Defined results: rows without an id, null or zero vectors, vectors with null or
non-finite parts, and vectors of another than the commonest dimension take no part;
ties go to the smaller id; a query row that repeats in id and vector is one query, candidate rows
that repeat stay apart; fewer candidates than ``k`` are all returned; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thermocline.llm.common import read_table, store, tidy, with_workers

TABLES = 24
PROBES = 64
OCCUPANCY = 3.0
NEIGHBOURS = 10
BLOCK_QUERIES = 20_000
EXACT_QUERIES = 256
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows, by butterflies."""
    n, width, step = *x.shape, 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


class Hashes:
    """The tables' rotations and axes for ``n`` vectors of a dimension."""

    def __init__(self, dimension: int, n: int, tables: int = TABLES, probes: int = PROBES):
        self.width, self.tables = 1 << max(0, ceil(log2(max(dimension, 1)))), tables
        self.axes, wanted = [], max(2.0, n / OCCUPANCY)
        while wanted >= 2 or not self.axes:
            self.axes.append(int(min(self.width, 2 ** max(0, round(log2(wanted / 2))))))
            wanted /= 2 * self.axes[-1]
        self.probes = int(probes * max(1.0, n / 65536) ** 0.4)
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, len(self.axes), 3, self.width))

    def images(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """Rotated unit vectors, as coordinates on the signed axes, of each rotation."""
        unit = np.zeros((len(vectors), self.width))
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        scaled = vectors / largest
        unit[:, :vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        out = []
        for axes, signs in zip(self.axes, self.signs[table]):
            turned = unit
            for sign in signs:
                turned = hadamard(turned * sign)
            out.append(np.concatenate((turned[:, :axes], -turned[:, :axes]), axis=1))
        return out

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket number of each vector in each table."""
        out = np.zeros((len(vectors), self.tables), np.int64)
        for table in range(self.tables):
            for image in self.images(vectors, table):
                out[:, table] = out[:, table] * image.shape[1] + image.argmax(axis=1)
            out[:, table] |= np.int64(table) << 48
        return out

    def nearest_buckets(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The probed buckets of each vector, the nearest first.

        Lists of axes are merged two at a time: the i-th and j-th best can only be
        among the best P together if (i + 1)(j + 1) <= P.
        """
        code = cost = None
        for image in self.images(vectors, table):
            gap = (image.max(axis=1, keepdims=True) - image) ** 2
            axis = np.argsort(gap, axis=1, kind="stable")[:, :self.probes]
            gap = np.take_along_axis(gap, axis, 1)
            if code is None:
                code, cost = axis.astype(np.int64), gap
                continue
            i, j = np.meshgrid(np.arange(code.shape[1]), np.arange(axis.shape[1]), indexing="ij")
            i, j = (x[(i + 1) * (j + 1) <= self.probes] for x in (i, j))
            both = cost[:, i] + gap[:, j]
            best = np.argsort(both, axis=1, kind="stable")[:, :self.probes]
            code = np.take_along_axis(code[:, i] * image.shape[1] + axis[:, j], best, 1)
            cost = np.take_along_axis(both, best, 1)
        return code | np.int64(table) << 48


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _keys(rows: DataFrame, hashes: Hashes, probing: bool) -> DataFrame:
    """(key, cls) for every table: the own bucket, or all probed ones."""
    shared = rows.sparkSession.sparkContext.broadcast(hashes)
    step = 256 if probing else 4096

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                vectors, ids = _matrix(batch.column("vector")), batch.column("cls").to_numpy()
                parts = ([h.nearest_buckets(vectors, t) for t in range(h.tables)] if probing else [h.buckets(vectors)])
                for keys in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "cls"])

    return rows.select("cls", "vector").mapInArrow(tidy(emit), "key long, cls long")


def _candidates(classes: DataFrame, of_queries: DataFrame, hashes: Hashes) -> DataFrame:
    """(query_cls, cls) that meet in a bucket of some table.

    Spark takes what a Python function gives to be as large as its input, here up to hundreds of times too
    small, and would send all probes through the driver; so both sides are dealt out by a shuffle at any size.
    """
    probes = _keys(of_queries, hashes, True).withColumnRenamed("cls", "query_cls")
    return _keys(classes, hashes, False).join(probes.hint("merge"), "key").select("query_cls", "cls").distinct()


SCORED = "query_cls long, cls long, score double"


def _scored(pairs: DataFrame, query_ids: np.ndarray, query_vectors: np.ndarray) -> DataFrame:
    """Exact distance of (query_cls, cls, vector) rows whose query is in the given block."""
    order = np.argsort(query_ids)
    shared = pairs.sparkSession.sparkContext.broadcast((query_ids[order], query_vectors[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            asked = batch.column("query_cls").to_numpy()
            place = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
            here = np.flatnonzero(ids[place] == asked)
            chosen = batch.take(pa.array(here))
            apart = _matrix(chosen.column("vector")) - vectors[place[here]] if len(here) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [chosen.column("query_cls"), chosen.column("cls"), pa.array(np.sqrt((apart * apart).sum(axis=1)))],
                ["query_cls", "cls", "score"])

    return pairs.mapInArrow(tidy(score), SCORED)


def _all_scored(classes: DataFrame, query_ids: np.ndarray, query_vectors: np.ndarray, keep: int) -> DataFrame:
    """The nearest ``keep`` classes of a small block of queries in each task's batches."""
    shared = classes.sparkSession.sparkContext.broadcast((query_ids, query_vectors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            rows, cls, first = _matrix(batch.column("vector")), batch.column("cls").to_numpy(), batch.column("first").to_numpy()
            for query, vector in zip(ids, vectors):
                distance = np.sqrt(((rows - vector) ** 2).sum(axis=1))
                best = np.lexsort((first, distance))[:keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), query)), pa.array(cls[best]), pa.array(distance[best])],
                    ["query_cls", "cls", "score"])

    return classes.select("cls", "vector", F.col("ids")[0].alias("first")).mapInArrow(tidy(score), SCORED)


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors: ``cls`` (a hash), ``vector`` and the ``keep`` smallest ``ids``; rows (vec_id, vector)."""
    hashed = rows.withColumn("cls", F.xxhash64("vector"))
    order = Window.partitionBy("cls").orderBy("vec_id")
    return (hashed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
            .groupBy("cls").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")))


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, from (vec_id, embedding)."""
    part = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.select("vec_id", part.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite)
        & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (sizes["d"] if sizes else 0))


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Nearest rows of every query, by the tables.

    ``rows`` and ``queries`` are (vec_id, embedding); queries are rows of ``rows``
    and never find the row of their own id.
    """
    spark = with_workers(rows.sparkSession)
    rows = valid_vectors(rows)
    classes = store(vector_classes(rows, k + 1), "vector-classes")
    asked = store(valid_vectors(queries).select("vec_id", F.xxhash64("vector").alias("query_cls")).distinct(), "queries")
    n = classes.count()
    if n == 0 or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = len(classes.first()["vector"])
    hashes = Hashes(dimension, n, tables, probes)
    of_queries = store(classes.join(asked.select(F.col("query_cls").alias("cls")).distinct(), "cls", "left_semi")
                       .select("cls", "vector"), "query-vectors")
    met = store(_candidates(classes, of_queries, hashes), "candidates")

    # Blocks of query vectors by hash, about BLOCK_QUERIES each whatever their number.
    n_blocks = -(-of_queries.count() // BLOCK_QUERIES)
    block = F.pmod(F.xxhash64("cls", F.lit(SEED)), F.lit(n_blocks))
    scored = None
    for number in range(n_blocks):
        part = of_queries.where(block == number).toArrow()
        ids, vectors = part["cls"].to_numpy(), _matrix(part["vector"].combine_chunks())
        if len(ids):
            own = F.pmod(F.xxhash64("query_cls", F.lit(SEED)), F.lit(n_blocks)) == number
            found = _scored(met.where(own).join(classes.select("cls", "vector"), "cls").select("query_cls", "cls", "vector"),
                            ids, vectors)
            scored = found if scored is None else scored.union(found)
    best = store(_nearest_ids(scored, classes, k + 1), "nearest")

    # All candidates must be met where there are no more than k + 1 rows to find.
    wanted = min(k + 1, rows.count())
    short = store(of_queries.join(
        best.groupBy("query_cls").count().where(F.col("count") >= wanted).select(F.col("query_cls").alias("cls")),
        "cls", "left_anti"), "short-queries")
    n_short = short.count()
    if n_short:
        rest, n_blocks = None, -(-n_short // EXACT_QUERIES)
        block = F.pmod(F.xxhash64("cls", F.lit(SEED + 1)), F.lit(n_blocks))
        for number in range(n_blocks):
            part = short.where(block == number).toArrow()
            if len(part):
                found = _all_scored(classes, part["cls"].to_numpy(), _matrix(part["vector"].combine_chunks()), k + 1)
                rest = found if rest is None else rest.union(found)
        answered = best.join(short.select(F.col("cls").alias("query_cls")), "query_cls", "left_anti")
        best = answered.unionByName(_nearest_ids(rest, classes, k + 1))

    # The query's own row leaves its list once.
    place = Window.partitionBy("query_id", "query_cls").orderBy("score", "vec_id")
    own = Window.partitionBy("query_id", "query_cls", "own").orderBy("score", "vec_id")
    return (
        asked.withColumnRenamed("vec_id", "query_id").join(best, "query_cls")
        .withColumn("own", (F.col("cls") == F.col("query_cls")) & (F.col("vec_id") == F.col("query_id")))
        .withColumn("nth", F.row_number().over(own)).where("NOT (own AND nth = 1)")
        .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _nearest_ids(scored: DataFrame, classes: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest rows of each query class: its nearest classes, then their ids."""
    first = classes.select("cls", "ids")
    near = Window.partitionBy("query_cls").orderBy("score", F.col("ids")[0], "cls")
    ordered = Window.partitionBy("query_cls").orderBy("score", "vec_id", "cls")
    return (
        scored.join(first, "cls").withColumn("place", F.row_number().over(near)).where(F.col("place") <= keep)
        .select("query_cls", "cls", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= keep)
        .select("query_cls", "cls", "score", "vec_id")
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"))
