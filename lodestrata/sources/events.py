"""Event feeds: poll, subscribe, transcripts, and the local observability sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType


def feed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stream of JSON lines; files that have come are read once."""
    return spark.readStream.schema(schema).json(path)


def poll(spark: SparkSession, path: str, schema: StructType | str, checkpoint: str, sink: str) -> DataFrame:
    """Drains what has come since the last poll into sink and returns it; nothing new: no rows."""
    seen: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")
        seen.append(f"{sink}/batch={n}")

    feed(spark, path, schema).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(*seen) if seen else spark.createDataFrame([], schema)


def subscribe(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each micro-batch to handler."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handler)
    return (writer.trigger(availableNow=True) if once else writer).start()


def emit(events: DataFrame, path: str, enabled: bool = False) -> int:
    """Appends (name, attributes) rows to local JSON lines; off unless enabled; returns how many.

    They are counted as they are written, so their plan runs once.
    """
    if not enabled:
        return 0
    return observed(events, {"n": F.count(F.lit(1))}, lambda rows: rows.write.mode("append").json(path))["n"]


def observed(rows: DataFrame, metrics: dict[str, Column], action: Callable[[DataFrame], None]) -> dict:
    """What the metrics come to over the rows that pass while the action runs."""
    seen = Observation()
    action(rows.observe(seen, *[m.alias(k) for k, m in metrics.items()]))
    return seen.get


class StreamMetrics(StreamingQueryListener):
    """Keeps what observed streams report: (name of the observation, batch, metrics), a row for each batch."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, dict]] = []

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        for name, row in event.progress.observedMetrics.items():
            self.rows.append((name, event.progress.batchId, row.asDict()))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def outbox(events: DataFrame, known_types: tuple[str, ...]) -> DataFrame:
    """At-least-once events (event_id, seq, type, payload) once each, the first by seq, then type and payload; unknown types are marked."""
    once = events.groupBy("event_id").agg(F.min(F.struct("seq", "type", "payload")).alias("e"))
    return once.select("event_id", "e.*", (~F.col("e.type").isin(*known_types)).alias("unknown_type"))


#: A line of a session transcript.
TRANSCRIPT = "session_id string, seq long, ts timestamp_ntz, kind string, role string, text string, path string, old_text string, new_text string"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines as rows of TRANSCRIPT; a line that is none has only nulls and is left out."""
    return spark.read.schema(TRANSCRIPT).json(path).where("session_id is not null and seq is not null")


def transcript_deltas(lines: DataFrame) -> DataFrame:
    """(session_id, path, n_edits, chars_added, chars_removed, first_seq, last_seq) of the edits that a transcript's lines tell of."""
    edits = lines.where("kind = 'edit' and path is not null")
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    return edits.groupBy("session_id", "path").agg(F.count("*").alias("n_edits"), F.sum(size("new_text")).alias("chars_added"), F.sum(size("old_text")).alias("chars_removed"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


#: A line of a team's event log; task and subject may be absent.
TEAM_EVENT = "ts string, event string, session string, name string, task string, subject string"


def append_team_events(rows: DataFrame, path: str) -> None:
    """Appends rows of TEAM_EVENT to JSON lines, which team_events reads; what is there stays. Columns that rows lacks are absent from the lines."""
    fields = [f.split()[0] for f in TEAM_EVENT.split(", ")]
    rows.select(*[c for c in fields if c in rows.columns]).write.mode("append").json(path)


def team_events(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a team's log as rows that operators.lint reads; a line that names no event is left out."""
    return spark.read.schema(TEAM_EVENT).json(path).where("event is not null")
