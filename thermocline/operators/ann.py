"""Approximate nearest neighbours: documents grouped into cells, queries look into the nearest cells only.

Cells are k-means clusters of the unit vectors. The stored index is ordered by
cell, so a scan skips row groups no query looks into, and a task multiplies the
documents of a cell only with the queries that probe it. A cell is never moved
into one task: its documents stay where the scan finds them, however many
there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.operators.retrieval import best_first
from thermocline.operators.similarity import (
    DocBatch,
    Hits,
    Layout,
    QueryBlock,
    similarity_hits,
    unit_matrix,
)
from thermocline.session import materialize, ship_package
from thermocline.sources.vectors import normalize

_STEP_SCORES = 4_000_000  # vector-by-cell scores held at once


@dataclass(frozen=True)
class CellIndex:
    centres: np.ndarray  # one unit vector per cell; its size is set by the caller's ``cells``
    docs: DataFrame  # doc_id, cell, embedding, ordered by cell


def nearest_cells(units: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of each vector, nearest first."""
    out = np.empty((len(units), probes), np.int32)
    step = max(1, _STEP_SCORES // len(centres))
    for start in range(0, len(units), step):
        far = -(units[start : start + step] @ centres.T)
        if probes < len(centres):
            near = np.sort(np.argpartition(far, probes - 1, axis=1)[:, :probes], axis=1)
        else:
            near = np.broadcast_to(np.arange(len(centres)), far.shape)
        order = np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable")
        out[start : start + step] = np.take_along_axis(near, order, 1)
    return out


def fit_centres(docs: DataFrame, cells: int, seed: int = 42) -> np.ndarray:
    """Unit centres of the clusters of all documents' unit vectors."""
    ship_package(docs.sparkSession)
    unit = normalize(docs.select("embedding").where(F.exists("embedding", lambda x: x != 0)))
    training = unit.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(training)
    centres = np.array([np.asarray(c) for c in model.clusterCenters()])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def build_cells(docs: DataFrame, cells: int, seed: int = 42) -> CellIndex:
    """Cluster the unit vectors of all documents into cells, then put every document into its nearest cell."""
    centres = fit_centres(docs, cells, seed)
    shared = docs.sparkSession.sparkContext.broadcast(centres)
    dim = centres.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest_cells(unit_matrix(batch.column("embedding"), dim), shared.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cell), batch.column("embedding")], names=["doc_id", "cell", "embedding"]
            )

    placed = docs.select("doc_id", "embedding").mapInArrow(task, "doc_id long, cell int, embedding array<float>")
    # range partitioning on (cell, doc_id) splits a crowded cell over several files
    ordered = placed.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell")
    return CellIndex(centres, materialize(ordered, "cells"))


def _probed_cells(queries: DataFrame, centres: np.ndarray, probes: int) -> list[int]:
    """Cells any query looks into (at most one number per cell reaches the driver)."""
    dim = centres.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.unique(nearest_cells(unit_matrix(batch.column("embedding"), dim), centres, probes))
            yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])

    rows = queries.select("embedding").mapInArrow(task, "cell int").distinct().collect()
    return sorted(row["cell"] for row in rows)


class _CellHits(Hits):
    """Best k per query over the documents of the cells it probes."""

    def __init__(self, k: int, floor: float, centres: np.ndarray, probes: int):
        super().__init__(k, floor)
        self.centres = centres
        self.probes = probes

    def search(self, docs: Iterator[DocBatch], queries: QueryBlock) -> Iterator[pa.RecordBatch]:
        steps = range(0, len(queries), 4096)
        probed = np.concatenate([
            nearest_cells(queries.units(slice(start, start + 4096)), self.centres, self.probes) for start in steps
        ])
        directed = queries.directed()
        askers = {int(cell): directed[(probed[directed] == cell).any(axis=1)] for cell in np.unique(probed)}

        def parts():
            for batch in docs:  # the cell travels in the tier column
                for cell in np.unique(batch.tiers):
                    if int(cell) in askers:
                        members = (batch.tiers == cell) & np.isfinite(batch.units).all(axis=1)
                        yield 0, askers[int(cell)], batch.ids[members], batch.units[members]

        yield from self.collect(parts(), queries)


def ann_topk(index: CellIndex, queries: DataFrame, k: int, threshold: float | None, probes: int,
             layout: Layout = Layout()) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: best k documents in the query's ``probes`` nearest cells.

    Scores are exact; a neighbour outside the probed cells is missed. Probing
    all cells gives the exact answer.
    """
    docs = index.docs
    probes = min(probes, len(index.centres))
    wanted = _probed_cells(queries, index.centres, probes)
    if len(wanted) < len(index.centres):
        docs = docs.where(F.col("cell").isin(wanted))
    floor = -math.inf if threshold is None else threshold
    work = _CellHits(k, floor, index.centres, probes)
    hits = similarity_hits(docs.withColumnRenamed("cell", "tier"), queries, threshold, k, layout, work)
    return best_first(hits.drop("tier"), k).select("query_id", "rank", "doc_id", "score")
