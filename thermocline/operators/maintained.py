"""Temperatures kept up to date: what changed is scored, what did not is left alone.

The state is a stored table ``(doc_id, temperature, embedding)`` with unrounded
sums. Added workload queries add their positive similarities, removed ones take
theirs away, new documents meet the whole workload, deleted ones leave. A round costs one pass over the documents
with the changed queries only; sums ride along with the vectors, nothing is joined but the deleted ids. Sums differ from a full
rebuild by rounding errors far below the places that temperatures are rounded to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.operators.similarity import Layout, document_warmth
from thermocline.operators.tiering import TEMPERATURE_DIGITS
from thermocline.session import materialize


def warm_up(docs: DataFrame, workload: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The state of ``docs(doc_id, embedding)`` under a workload, from scratch."""
    return materialize(document_warmth(docs, workload, keep_vectors=True, layout=layout), "warm-state")


def change(state: DataFrame, workload: DataFrame, added_queries: DataFrame | None = None,
           removed_queries: DataFrame | None = None, added_docs: DataFrame | None = None,
           removed_docs: DataFrame | None = None, layout: Layout = Layout()) -> DataFrame:
    """The state after a round of changes.

    ``workload`` is the whole workload after the round; only new documents meet it. Queries are rows: one that is
    in the workload twice is removed once by one removed row. ``removed_docs(doc_id)`` takes every row of an id away.
    """
    if removed_docs is not None:
        state = state.join(removed_docs.select("doc_id").distinct(), "doc_id", "left_anti")
    for queries, sign in ((added_queries, 1.0), (removed_queries, -1.0)):
        if queries is not None:
            state = document_warmth(state, queries, keep_vectors=True, layout=layout, base="temperature", sign=sign)
    if added_docs is not None:
        fresh = document_warmth(added_docs.select("doc_id", "embedding"), workload, keep_vectors=True, layout=layout)
        state = state.select(*fresh.columns).unionByName(fresh)
    return materialize(state.select("doc_id", "temperature", "embedding"), "warm-state")


def temperatures_of(state: DataFrame) -> DataFrame:
    """``(doc_id, temperature)`` as ``tiering.temperatures`` gives it."""
    return state.select("doc_id", F.round("temperature", TEMPERATURE_DIGITS).alias("temperature"))
