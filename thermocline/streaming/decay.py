"""Migration by time: keyed state and event-time timers instead of rescoring every document.

A document's access score rises with an access and otherwise only fades, so its
target tier changes at an access or at a moment that is known beforehand. Each document keeps its counts, its tier and
one timer in the state store; a micro-batch touches the documents that were accessed, whose score crosses
a cut, or that are halfway to their target, and no others.

A pass happens whenever the watermark advances and is made as of the watermark ``W``: it
equals the batch pass over the events up to ``W``, scored as of ``W``, each document moving one step. Events ahead of the
watermark wait in the state until it reaches them. Events may come up to ``delay`` out of order;
an event behind the watermark when it arrives is dropped by Spark and does not count.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from thermocline.functions import tiers as rules
from thermocline.operators.migration import AUTO
from thermocline.session import ship_package
from thermocline.streaming.jobs import EPOCH, ONCE, keep_state_in_rocksdb, micros, start_stream, write_batches

_HOUR = 3600 * 10**6  # microseconds
MOVES_SCHEMA = "doc_id long, micros long, from_tier int, to_tier int"


def score(total: int, last: int, now: int) -> float:
    """The access score of ``functions.tiers.access_score``, for times in microseconds."""
    if not total:
        return 0.0
    frequency = min(1.0, total / rules.FULL_FREQUENCY)
    recency = max(0.0, 1.0 - (now - last) / _HOUR / rules.RECENCY_HOURS)
    return (frequency + recency) / 2.0


def target(total: int, last: int, now: int, cuts: tuple[float, float]) -> int:
    value = score(total, last, now)
    return rules.HOT if value >= cuts[0] else rules.WARM if value >= cuts[1] else rules.COLD


def next_change(total: int, last: int, now: int, cuts: tuple[float, float]) -> int | None:
    """The first millisecond after ``now`` at which the fading score has left its tier; None if it never does."""
    here = target(total, last, now, cuts)
    if here == rules.COLD:
        return None
    cut = cuts[here - rules.HOT]
    least = 2.0 * cut - min(1.0, total / rules.FULL_FREQUENCY)  # the recency that still reaches the cut
    if least <= 0.0:
        return None
    leaves = last + (1.0 - least) * rules.RECENCY_HOURS * _HOUR
    return max(int(leaves // 1000), now // 1000) + 1


class Decay(StatefulProcessor):
    """Per document, in one value: accesses counted so far, tier, timer, and the accesses ahead of the watermark.

    Every call of the state costs a round trip to the store, so a batch reads and writes a document once,
    however many accesses it brings.
    """

    def __init__(self, cuts: tuple[float, float]):
        self.cuts = cuts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ahead: microseconds as 8-byte integers, in no order, one per access
        self.known = handle.getValueState("known", "total long, last long, tier int, timer long, ahead binary")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState, timerValues) -> None:
        timer = None
        if initialState.tier != rules.COLD:
            timer = 1  # never accessed: goes down from the first pass on
            self.handle.registerTimer(timer)
        self.known.update((0, 0, initialState.tier, timer, b""))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = array("q", [row.micros for row in rows])
        state = self.known.get() if new else None
        if state is not None:
            total, last, tier, timer, ahead = state
            # never in this batch: what arrives now counts once the watermark has passed it
            millis = max(-(-min(new) // 1000), timerValues.getCurrentWatermarkInMs() + 1)
            if timer is None or timer > millis:  # one timer per document, the earliest asked for
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(millis)
                timer = millis
            self.known.update((total, last, tier, timer, bytes(ahead) + new.tobytes()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        now = watermark * 1000
        total, last, tier, _, held = self.known.get()
        ahead = array("q", bytes(held))
        due = [micros for micros in ahead if micros <= now]
        if due:
            total, last = total + len(due), max(last, max(due)) if total else max(due)
            ahead = array("q", [micros for micros in ahead if micros > now])
        aim = target(total, last, now, self.cuts)
        step = tier + (aim > tier) - (aim < tier)
        wakes = [next_change(total, last, now, self.cuts) if total else None]
        wakes.append(-(-min(ahead) // 1000) if ahead else None)
        wakes.append(watermark + 1 if step != aim else None)
        timer = min((max(millis, watermark + 1) for millis in wakes if millis is not None), default=None)
        if timer is not None:
            self.handle.registerTimer(timer)
        self.known.update((total, last, step, timer, ahead.tobytes()))
        if step != tier:
            yield Row(doc_id=key[0], micros=now, from_tier=tier, to_tier=step)


def migrate_on_time(events: DataFrame, tiers: DataFrame, path: str, delay: str = "0 seconds",
                    cuts: tuple[float, float] = rules.ACCESS_CUTS, checkpoint: str | None = None,
                    trigger: dict = ONCE) -> StreamingQuery:
    """Log the moves of ``tiers(doc_id, tier)``, one row a document, that ``events(doc_id, ts)`` and the passing of time ask for.

    Accesses of documents ``tiers`` does not know change nothing.
    """
    spark = events.sparkSession
    ship_package(spark)
    keep_state_in_rocksdb(spark)
    at = F.timestamp_micros(F.col("micros"))
    accesses = events.select("doc_id", micros(F.col("ts")).alias("micros")).withColumn("at", at).withWatermark("at", delay)
    placed = tiers.select("doc_id", "tier")
    accesses = accesses.join(placed.select("doc_id"), "doc_id", "left_semi")  # after the watermark, which all accesses move
    moves = accesses.groupBy("doc_id").transformWithState(
        Decay(cuts), MOVES_SCHEMA, "Append", "EventTime", placed.groupBy("doc_id"))
    stamp = F.timestamp_add("MICROSECOND", F.col("micros"), F.expr(EPOCH))
    log = moves.select("doc_id", stamp.alias("ts"), "from_tier", "to_tier", F.lit(AUTO).alias("kind"))
    return start_stream(log, write_batches(f"{path}/log"), checkpoint, trigger)
