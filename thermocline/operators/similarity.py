"""Block similarity between a document table and a query set.

Every operator here scores all (document, query) pairs without ever making a
row per pair: Spark partitions the documents, each task multiplies a batch of
documents with a block of queries and emits only what survives (a sum per
document, or the best hits per query).

There is one layout for query sets of every size. The queries are cut into
blocks of a checked size and number, each broadcast once. Documents stay where the scan
finds them: a task multiplies them with one block after the other (with several
blocks, a bounded chunk of documents at a time) and never holds more than one
block. Documents are scanned once and never shuffled, and a document row is
scored as a row, whether or not its id repeats.

A vector with a component that is not finite has no direction: it takes no part
in searches and adds nothing to any temperature.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.functions.vectors import SCORE_DIGITS
from thermocline.session import ship_package

_SLACK = 10.0 ** -(SCORE_DIGITS - 1)
# one product block of 1024 x 256 scores (2 MiB) stays in a core's cache
_QUERY_STEP = 256
_DOC_STEP = 1024
_HELD_ROWS = 50_000  # hits kept before they are cut back to the best k, or sent on
KEPT_ROWS = 1_000_000  # best hits of all queries that a task keeps at once
_READY_COMPONENTS = 8_000_000  # query components kept as unit vectors (64 MB)


@dataclass(frozen=True)
class Layout:
    """Bytes of stored components that a task holds at once; they change no result."""

    block_bytes: int = 32 * 1024 * 1024
    chunk_bytes: int = 64 * 1024 * 1024


# --------------------------------------------------------------------------
# numpy helpers that run inside tasks


def _components(lists, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of its own float type (dim 0: as long as they are)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if lists.null_count:
        raise ValueError("a vector is null")
    values = lists.flatten().to_numpy(zero_copy_only=False)
    dim = dim or (len(values) // len(lists) if len(lists) else 0)
    if len(values) != len(lists) * dim or np.any(np.diff(lists.offsets.to_numpy()) != dim):
        raise ValueError(f"a vector does not have {dim} components")
    return values.reshape(len(lists), dim)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in float64; zero rows stay zero."""
    rows = rows.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(length > 0.0, length, 1.0)[:, None]


def unit_matrix(lists, dim: int) -> np.ndarray:
    return unit_rows(_components(lists, dim))


def _ints(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class QueryBlock:
    """Queries of one task: ids and stored components, made unit vectors at once or, if many, a few at a time."""

    ids: np.ndarray
    rows: np.ndarray
    ready: np.ndarray | None = None

    @staticmethod
    def of(table: pa.Table, dim: int) -> QueryBlock:
        ids = _ints(table.column("query_id")).astype(np.int64)
        return QueryBlock(ids, _components(table.column("embedding"), dim) if len(ids) else np.zeros((0, dim)))

    def __len__(self) -> int:
        return len(self.ids)

    def directed(self) -> np.ndarray:
        """Positions of the queries that can have hits; a zero vector has no direction."""
        return np.flatnonzero(np.any(self.rows != 0.0, axis=1) & np.isfinite(self.rows).all(axis=1))

    def prepared(self) -> QueryBlock:
        return replace(self, ready=unit_rows(self.rows)) if self.rows.size <= _READY_COMPONENTS else self

    def units(self, at) -> np.ndarray:
        return unit_rows(self.rows[at]) if self.ready is None else self.ready[at]


@dataclass(frozen=True)
class DocBatch:
    ids: np.ndarray
    tiers: np.ndarray
    units: np.ndarray
    source: pa.RecordBatch


def _doc_batches(batches, dim: int) -> Iterator[DocBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _DOC_STEP):
            part = batch.slice(start, _DOC_STEP)
            ids = _ints(part.column("doc_id"))
            with_tier = "tier" in part.schema.names
            tiers = _ints(part.column("tier")) if with_tier else np.zeros(len(ids), dtype=np.int32)
            yield DocBatch(ids, tiers, unit_matrix(part.column("embedding"), dim), part)


Loader = Callable[[], QueryBlock]


def _chunks(docs: Iterator[DocBatch], size: int) -> Iterator[list[DocBatch]]:
    """Batches gathered up to ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in docs:
        held.append(batch)
        held_bytes += batch.units.nbytes
        if held_bytes >= size:
            yield held
            held, held_bytes = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class _Warmth:
    """Per document: sum of positive similarities; on request also the profile of all of them."""

    keep_vectors: bool
    profile: bool
    base: str | None = None  # column that the sums are added to
    sign: float = 1.0

    @property
    def schema(self) -> str:
        parts = ["doc_id long, temperature double"]
        if self.profile:
            parts.append("sim_min double, sim_max double, sim_sum double, n_queries long")
        if self.keep_vectors:
            parts.append("embedding array<float>")
        return ", ".join(parts)

    def run(self, docs: Iterator[DocBatch], blocks: list[Loader], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(docs, chunk_bytes if len(blocks) > 1 else 1):
            sums = [self._sums(batch) for batch in chunk]
            for load in blocks:
                queries = load()
                for batch, mine in zip(chunk, sums):
                    self._add(batch, queries, mine)
            for batch, mine in zip(chunk, sums):
                yield self._rows(batch, mine)

    def _sums(self, batch: DocBatch) -> dict:
        n = len(batch.ids)
        warm = np.zeros(n) if self.base is None else batch.source.column(self.base).to_numpy(zero_copy_only=False).copy()
        return {"warm": warm, "low": np.full(n, np.inf), "high": np.full(n, -np.inf), "total": np.zeros(n), "count": 0}

    def _add(self, batch: DocBatch, queries: QueryBlock, mine: dict) -> None:
        for start in range(0, len(queries), _QUERY_STEP):
            sims = batch.units @ queries.units(slice(start, start + _QUERY_STEP)).T
            if self.profile:
                mine["total"] += np.nansum(sims, axis=1)
                np.fmin(mine["low"], np.fmin.reduce(sims, axis=1), out=mine["low"])
                np.fmax(mine["high"], np.fmax.reduce(sims, axis=1), out=mine["high"])
            mine["warm"] += self.sign * np.fmax(sims, 0.0, out=sims).sum(axis=1)
        mine["count"] += len(queries)

    def _rows(self, batch: DocBatch, mine: dict) -> pa.RecordBatch:
        n = len(batch.ids)
        columns, names = [pa.array(batch.ids), pa.array(mine["warm"])], ["doc_id", "temperature"]
        if self.profile:
            none = ~np.isfinite(mine["low"])  # no query, or no direction
            columns += [pa.array(np.round(mine[x], SCORE_DIGITS), mask=none) for x in ("low", "high")]
            columns += [pa.array(mine["total"]), pa.array(np.full(n, mine["count"], dtype=np.int64))]
            names += ["sim_min", "sim_max", "sim_sum", "n_queries"]
        if self.keep_vectors:
            columns.append(batch.source.column("embedding"))
            names.append("embedding")
        return pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Hits:
    """Hits with score >= floor, per (query, tier) the best k of this task (all of them when k is None)."""

    k: int | None
    floor: float

    def run(self, docs: Iterator[DocBatch], blocks: list[Loader], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
        if len(blocks) == 1:
            yield from self.search(docs, blocks[0]())
            return
        for chunk in _chunks(docs, chunk_bytes):
            for load in blocks:
                yield from self.search(iter(chunk), load())

    def search(self, docs: Iterator[DocBatch], queries: QueryBlock) -> Iterator[pa.RecordBatch]:
        """Hits of one block of queries."""
        askers = queries.directed()

        def parts():
            for batch in docs:
                finite = np.isfinite(batch.units).all(axis=1)
                for tier in np.unique(batch.tiers):
                    members = (batch.tiers == tier) & finite
                    yield int(tier), askers, batch.ids[members], batch.units[members]

        yield from self.collect(parts(), queries)

    def collect(self, parts, queries: QueryBlock) -> Iterator[pa.RecordBatch]:
        """Hits of ``(tier, positions of the asking queries, document ids, unit vectors)`` parts."""
        held: list[tuple[np.ndarray, ...]] = []
        held_rows = 0
        bars: dict[int, np.ndarray] = {}  # per tier: score a new hit must reach, per query
        for tier, askers, ids, units in parts:
            bar = bars.setdefault(tier, np.full(len(queries), self.floor))
            for start in range(0, len(askers), _QUERY_STEP):
                at = askers[start : start + _QUERY_STEP]
                found, scores, doc_ids = self._block(queries.units(at), units, ids, bar[at])
                if not len(found):
                    continue
                held.append((at[found], np.full(len(found), tier, dtype=np.int32), scores, doc_ids))
                held_rows += len(found)
            if self.k is None and held_rows > _HELD_ROWS:
                yield self.emit(held, queries.ids)
                held, held_rows = [], 0
            elif self.k is not None and held_rows > _HELD_ROWS + 2 * self.k * len(queries):
                held = [self.trimmed(held, bars)]
                held_rows = len(held[0][0])
        if held:
            yield self.emit(held if self.k is None else [self.trimmed(held, bars)], queries.ids)

    def _block(self, queries, docs, ids, bar):
        sims = queries @ docs.T
        reached = sims >= (bar - _SLACK)[:, None]
        if self.k is not None and len(ids) > self.k and np.count_nonzero(reached) > 4 * self.k * len(queries):
            best_here = np.partition(sims, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            reached = sims >= (np.maximum(bar, best_here) - _SLACK)[:, None]
        query_at, doc_at = np.divmod(np.flatnonzero(reached), len(ids))
        scores = np.round(sims[query_at, doc_at], SCORE_DIGITS) + 0.0
        keep = scores >= bar[query_at]
        return query_at[keep], scores[keep], ids[doc_at[keep]]

    def trimmed(self, held, bars=None):
        """The best k per (query, tier) of ``(query position, tier, score, document id)`` columns; raises the bars."""
        query_at, tiers, scores, ids = (np.concatenate(column) for column in zip(*held))
        order = np.lexsort((ids, -scores, tiers, query_at))
        query_at, tiers, scores, ids = query_at[order], tiers[order], scores[order], ids[order]
        first = np.ones(len(ids), dtype=bool)
        first[1:] = (query_at[1:] != query_at[:-1]) | (tiers[1:] != tiers[:-1])
        starts = np.flatnonzero(first)
        rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        full = rank == self.k - 1
        for tier, bar in (bars or {}).items():
            here = full & (tiers == tier)
            bar[query_at[here]] = scores[here]
        keep = rank < self.k
        return query_at[keep], tiers[keep], scores[keep], ids[keep]

    @staticmethod
    def emit(held, query_ids):
        query_at, tiers, scores, ids = (np.concatenate(column) for column in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[query_at]), pa.array(tiers), pa.array(ids), pa.array(scores)],
            names=["query_id", "tier", "doc_id", "score"],
        )


# --------------------------------------------------------------------------
# Spark layouts


@dataclass(frozen=True)
class VectorStats:
    rows: int
    dim: int
    width: int = 4  # bytes of a component

    @property
    def bytes(self) -> int:
        return self.rows * self.dim * self.width


def vector_stats(vectors: DataFrame) -> VectorStats:
    """Row count and dimension; every vector must have the same one."""
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")
    ).first()
    if row["n"] and row["lo"] != row["hi"]:
        raise ValueError(f"vectors of {row['lo']} and of {row['hi']} components in one set")
    width = 8 if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else 4
    return VectorStats(row["n"], row["hi"] or 0, width)


def run_pairs(docs: DataFrame, queries: DataFrame, work, schema: str, layout: Layout) -> DataFrame:
    """Apply ``work`` to all pairs; every document row is seen by one task.

    ``docs(doc_id, embedding[, tier])``, ``queries(query_id, embedding)``. The
    query set is read twice, for its size and for its vectors: pass a stored
    table or something as cheap to read.
    """
    ship_package(docs.sparkSession)
    asked = queries.select("query_id", "embedding")
    stats = vector_stats(asked)
    rows_per_block = max(1, layout.block_bytes // max(1, stats.dim * stats.width))
    if isinstance(work, Hits) and work.k is not None:  # a task keeps k hits of each query of a block
        rows_per_block = max(1, min(rows_per_block, KEPT_ROWS // max(1, work.k)))
    parts = max(1, math.ceil(stats.rows / rows_per_block))
    # spread by content: a repeated id does not fill a block
    part = F.pmod(F.xxhash64("query_id", "embedding"), F.lit(parts))
    shared = []
    for number in range(parts):
        table = (asked if parts == 1 else asked.where(part == number)).toArrow()
        for start in range(0, table.num_rows, rows_per_block) or ([0] if parts == 1 else []):
            block = QueryBlock.of(table.slice(start, rows_per_block).combine_chunks(), stats.dim)
            if isinstance(work, Hits) and not len(block.directed()):  # no hit possible
                continue
            shared.append(docs.sparkSession.sparkContext.broadcast((block.ids, block.rows)))
    if not shared and isinstance(work, Hits):  # nothing to scan
        return docs.sparkSession.createDataFrame([], schema)
    dim, chunk_bytes = stats.dim, layout.chunk_bytes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(block) -> QueryBlock:
            ready = QueryBlock(*block.value).prepared()
            if len(shared) > 1:
                block.__dict__.pop("_value", None)  # a worker keeps what it has read; here only one block at a time
            return ready

        yield from work.run(_doc_batches(batches, dim), [lambda b=b: load(b) for b in shared], chunk_bytes)

    return docs.mapInArrow(task, schema)


HITS_SCHEMA = "query_id long, tier int, doc_id long, score double"


def document_warmth(docs: DataFrame, queries: DataFrame, keep_vectors: bool = False, profile: bool = False,
                    layout: Layout = Layout(), base: str | None = None, sign: float = 1.0) -> DataFrame:
    """Per document: ``temperature`` = sum of its positive similarities to the queries.

    ``profile`` adds the minimum, maximum, sum and count of all similarities.
    ``base`` names a column of earlier sums that this one, times ``sign``, is added to.
    One row per document row, whether or not its id repeats. ``keep_vectors``
    hands the vectors through, which spares joining them back.
    """
    vector = F.col("embedding").cast("array<float>") if keep_vectors else F.col("embedding")
    work = _Warmth(keep_vectors, profile, base, sign)
    earlier = [base] if base else []
    return run_pairs(docs.select("doc_id", vector.alias("embedding"), *earlier), queries, work, work.schema, layout)


def similarity_hits(docs: DataFrame, queries: DataFrame, floor: float | None, k: int | None = None,
                    layout: Layout = Layout(), work: Hits | None = None) -> DataFrame:
    """``(query_id, tier, doc_id, score)`` for pairs with score >= ``floor``.

    With ``k`` each task keeps its best k per (query, tier); the rows returned
    then contain the overall best k and have to be ranked once more.
    Documents without a ``tier`` column count as tier 0.
    """
    columns = [F.col("doc_id"), F.col("embedding")]
    if "tier" in docs.columns:
        columns.append(F.col("tier").cast("int").alias("tier"))
    docs = docs.select(*columns)
    work = work or Hits(k, -math.inf if floor is None else floor)
    return run_pairs(docs, queries, work, HITS_SCHEMA, layout)
