"""State machines of entities over a stream, with event-time timers, expiry, and a reader of the state; and the same over a batch.

Events wait in an entity's state until the watermark has passed them, and are then
taken in the order of event time, whatever batch or order they came in. An entity
that hears nothing for `quiet` becomes idle: a timer gives a row for it, and its
state expires, so what is kept grows with the entities that are awake. Of what
waits, only the earliest event has a timer, so that calls into the state grow with
entities and batches, not with events. Two
events at one time go by state, then sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "at_us long, seq long, prev_state string, state string, accepted boolean"
IDLE = "idle"


class Machine(StatefulProcessor):
    """Steps of one entity; legal holds (state before, state) pairs, quiet_us the time after which it is idle."""

    def __init__(self, legal: set[tuple[str, str]], quiet_us: int):
        self.legal, self.quiet_us = legal, quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long, seq long, state string")
        self.now = handle.getValueState("now", "state string, at_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        came = [(r["at_us"], r["seq"], r["state"]) for r in rows]
        self.waiting.appendList(came)
        self.handle.registerTimer(_ms(min(t for t, _, _ in came)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        """Takes all that the watermark has passed, in order; a later timer of the same batch finds nothing and does nothing."""
        due = timerValues.getCurrentWatermarkInMs()
        every = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [x for x in every if _ms(x[0]) <= due], [x for x in every if _ms(x[0]) > due]
        state, last = self.now.get() if self.now.exists() else (None, None)
        out = []
        for at, seq, to in ready:
            if last is not None and at - last > self.quiet_us:
                out.append(Row(**_row(key, last + self.quiet_us, None, state, IDLE, True)))
                state = None
            out.append(Row(**_row(key, at, seq, state, to, state is None or (state, to) in self.legal)))
            state, last = to, at
        if last is not None and _ms(last + self.quiet_us) <= due:
            # nothing came in time: what waits still is later than the watermark
            out.append(Row(**_row(key, last + self.quiet_us, None, state, IDLE, True)))
            self.now.clear()
        elif ready:
            self.now.update((state, last))
            self.handle.registerTimer(_ms(last + self.quiet_us))
        if len(rest) != len(every):
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(_ms(rest[0][0]))
            else:
                self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    """The first whole millisecond at or after a time."""
    return -(-us // 1000)


def _row(key: tuple, at: int, seq: int | None, prev: str | None, state: str, ok: bool) -> dict:
    return {"entity_id": key[0], "at_us": at, "seq": seq, "prev_state": prev, "state": state, "accepted": ok}


def run_machine(stream: DataFrame, legal: set[tuple[str, str]], quiet_us: int, late: str = "10 minutes") -> DataFrame:
    """(entity_id, at_us, seq, prev_state, state, accepted) of a stream of (entity_id, ts, seq, state): a row for each event and for each time an entity becomes idle.

    A step that is none of the machine's is marked, and taken; the first event of an
    entity, or after it was idle, is always accepted. Rows come out when the
    watermark has passed them. Rows with a null entity or time take no part.
    """
    rows = stream.where("entity_id is not null and ts is not null").withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))
    kind = stream.schema["entity_id"].dataType.simpleString()
    return rows.groupBy("entity_id").transformWithState(Machine(legal, quiet_us), f"entity_id {kind}, {OUT}", "append", "eventTime")


def start_machine(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what has come into Parquet at path, state kept in RocksDB; a query that starts again goes on where the last one ended."""
    conf, name = out.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        return out.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def machine_state(spark: SparkSession, checkpoint: str, variable: str = "now") -> DataFrame:
    """What the machine holds after the last batch: of each entity that is awake its state and the time of its last event."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    return rows.select(F.col("key.*"), F.col("value.*")) if variable == "now" else rows


def machine_batch(events: DataFrame, legal: set[tuple[str, str]], quiet_us: int) -> DataFrame:
    """What run_machine gives once the watermark has passed all rows of events, by windows."""
    order = Window.partitionBy("entity_id").orderBy("at_us", "seq", "state")
    rows = events.where("entity_id is not null and ts is not null").select("entity_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "seq", "state")
    told = rows.withColumn("next_us", F.lead("at_us").over(order)).withColumn("last_us", F.lag("at_us").over(order)).withColumn("last_state", F.lag("state").over(order))
    prev = F.when(F.col("at_us") - F.col("last_us") <= quiet_us, F.col("last_state"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(legal)])
    ok = prev.isNull() | F.array_contains(pairs, F.struct(prev.alias("a"), F.col("state").alias("b")))
    steps = told.select("entity_id", "at_us", "seq", prev.alias("prev_state"), "state", ok.alias("accepted"))
    quiet = F.col("next_us").isNull() | (F.col("next_us") - F.col("at_us") > quiet_us)
    idle = told.where(quiet).select("entity_id", (F.col("at_us") + quiet_us).alias("at_us"), F.lit(None).cast("long").alias("seq"), F.col("state").alias("prev_state"), F.lit(IDLE).alias("state"), F.lit(True).alias("accepted"))
    return steps.unionByName(idle)
