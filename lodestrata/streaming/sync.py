"""Continuous sync: debounce, deduplication, state checks, and the batch reconcile that must agree with them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..durable import whole_rank
from ..schemas import TRANSITIONS
from ..sources.versions import VersionedTable


def debounce(events: DataFrame, gap: str, key: str = "path", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, first_ts, last_ts, n_events) of bursts that a quiet gap ends; the same on a batch and on a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(F.col(ts), gap), key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))
    return out.drop("session_window")


def bursts(events: DataFrame, gap_us: int, key: str, ts_us: str) -> DataFrame:
    """The same over a batch in whole microseconds, by gaps and islands."""
    by = Window.partitionBy(key).orderBy(ts_us)
    fresh = (F.col(ts_us) - F.lag(ts_us).over(by) >= gap_us).cast("long")
    island = F.sum(F.coalesce(F.col("__fresh"), F.lit(1))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("__fresh", fresh).withColumn("__island", island).groupBy(key, "__island").agg(F.min(ts_us).alias("first_us"), F.max(ts_us).alias("last_us"), F.count("*").alias("n_events")).drop("__island")


def dedup(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once; on a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, ts: str = "ts", by: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """(window_start, by, n, total) over tumbling or sliding windows (this engine's own, not part of the design it follows)."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width, slide or width), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total")


def check_transitions(changes: DataFrame, machine: str) -> DataFrame:
    """changes (entity_id, seq, state) with the state before and whether the step is one of the machine's; else it is refused."""
    edges = changes.sparkSession.createDataFrame(TRANSITIONS[machine], "prev_state string, state string").distinct().withColumn("known", F.lit(True))
    prev = F.lag("state").over(Window.partitionBy("entity_id").orderBy("seq"))
    told = changes.withColumn("prev_state", prev).join(F.broadcast(edges), ["prev_state", "state"], "left")
    return told.select("entity_id", "seq", "prev_state", "state", (F.col("prev_state").isNull() | F.col("known").isNotNull()).alias("accepted"))


def apply_machine(stream: DataFrame, machine: str) -> DataFrame:
    """(entity_id, seq, state, accepted) of a stream of changes: a refused step leaves the entity's state as it was."""
    legal = set(TRANSITIONS[machine])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("seq")
        ok = []
        for s in rows["state"]:
            good = now is None or (now, s) in legal
            now = s if good else now
            ok.append(good)
        state.update((now,))
        yield pd.DataFrame({"entity_id": key[0], "seq": rows["seq"], "state": rows["state"], "accepted": ok})

    kind = stream.schema["entity_id"].dataType.simpleString()
    return stream.groupBy("entity_id").applyInPandasWithState(step, f"entity_id {kind}, seq long, state string, accepted boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def sync_table(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Applies batches of changed chunks to a versioned table; a batch whose rows are there already adds no version.

    Of the table only the batch's keys are looked at, which are few enough to be sent to every scan.
    """

    def apply(batch: DataFrame, n: int) -> None:
        last = Window.partitionBy(table.key).orderBy(F.desc("seq"))
        rows = batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "seq")
        if table.current() is not None:
            have = table.lookup(rows.select(table.key)).select(table.key, "content_hash")
            rows = rows.join(have, [table.key, "content_hash"], "left_anti")
        if not rows.isEmpty():
            table.upsert(rows)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def lru_evictions(uses: DataFrame, capacity: int, key: str = "worker_id", used: str = "last_used") -> DataFrame:
    """Keys in order of last use, and whether they are evicted at this capacity; ranges of the order are ranked side by side."""
    last = uses.groupBy(key).agg(F.max(used).alias(used))
    return whole_rank(last, [F.desc(used), F.col(key)], "recency").withColumn("evicted", F.col("recency") > capacity)
