"""The state machine on a stream against its batch twin, and the append-only log read by offsets, both through restarts."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import append_log
from lodestrata.streaming import machines

LEGAL = {("click", "purchase"), ("view", "click"), ("click", "click"), ("signup", "view")}
DAY = 86_400_000_000


def test_machine_on_a_stream_equals_the_batch_through_increments_and_restarts(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 7).alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    # three increments by time, shuffled within, with two events at one time and a last one that moves the watermark past all
    twin = e.limit(20).withColumn("seq", F.col("seq") + 100_000)
    e = e.unionByName(twin)
    cuts = ["2024-01-10", "2024-01-20", "2025-01-01"]
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    low = "2000-01-01"
    for k, high in enumerate(cuts):
        part = e.where((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.lit(high).cast("timestamp")))
        if k == 2:
            part = part.unionByName(spark.createDataFrame([(-1, "2030-01-01", -1, "end")], "entity_id long, ts string, seq long, state string").withColumn("ts", F.col("ts").cast("timestamp")))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(src)
        stream = machines.run_machine(spark.readStream.schema(e.schema).parquet(src), LEGAL, 6 * DAY // 24)
        machines.start_machine(stream, out, cp).awaitTermination()
        if k == 0:
            awake = {r.entity_id: r.state for r in machines.machine_state(spark, cp).collect()}
            assert awake and set(awake) <= set(range(7))
        low = high
    got = spark.read.parquet(out).where("entity_id >= 0")
    want = machines.machine_batch(e, LEGAL, 6 * DAY // 24)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    assert want.where("state = 'idle'").count() > 20 and want.where("not accepted").count() > 20
    # all entities but the last are idle, so nothing of them is kept
    assert [r.entity_id for r in machines.machine_state(spark, cp).collect()] == []


class FakeState:
    """Timers and state of one entity, as the engine holds them; counts the timers that were asked for."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getListState(self, *_):  # noqa: N802
        return self.list

    def getValueState(self, *_):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.add(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None

    def appendList(self, rows):  # noqa: N802
        self.value = (self.value or []) + rows


def through(batches, quiet):
    """Rows of one entity's machine over (events, watermark after them), and the timers it asked for."""
    handle, out = FakeState(), []
    handle.list = FakeState()
    machine = machines.Machine(LEGAL, quiet)
    machine.init(handle)
    for rows, mark in batches:
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda _, mark=mark: mark})()
        if rows:
            list(machine.handleInputRows((1,), iter([{"at_us": t, "seq": n, "state": s} for t, n, s in rows]), clock))
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            out += [(r["at_us"], r["seq"], r["prev_state"], r["state"], r["accepted"]) for r in machine.handleExpiredTimer((1,), clock, None)]
    return out, handle


def test_an_entity_asks_for_timers_by_batch_and_not_by_event():
    r = random.Random(6)
    for quiet in (40_000, 700_000):
        events = [(r.randrange(5_000_000), k, r.choice(["click", "view", "purchase", "signup"])) for k in range(600)]
        whole, _ = through([(events, 10_000)], quiet)
        assert len(whole) > 600
        # the watermark stops between events; each comes before the watermark has passed it, in any order
        marks, batches, left = list(range(250, 5_001, 250)), [], events
        for last, mark in zip([0, *marks], marks, strict=False):
            now = [e for e in left if e[0] <= mark * 1000 or r.random() < 0.2]
            left = [e for e in left if e not in now]
            batches.append((r.sample(now, len(now)), mark - 120))
        told, handle = through([*batches, (left, 10_000)], quiet)
        assert [e for e in told if e[0] != 0] == [e for e in whole if e[0] != 0] and not handle.timers
        assert handle.asked <= 3 * (len(batches) + 1)


def drained(spark, path, cp, sink, **options):
    stream = append_log.tail(spark, path, "k long, s string", **options)
    stream.writeStream.option("checkpointLocation", cp).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()
    return sorted((r.k, r.s) for r in spark.read.schema("file string, byte_offset long, k long, s string").parquet(sink).collect())


def test_a_growing_file_gives_each_line_once(spark, tmp_path):
    log, cp, sink = tmp_path / "log", str(tmp_path / "cp"), str(tmp_path / "sink")
    log.mkdir()
    line = lambda k: json.dumps({"k": k, "s": "é漢" * (k % 9)}, ensure_ascii=False)
    want = [(k, "é漢" * (k % 9)) for k in range(60)]
    a = log / "a.jsonl"
    a.write_text("\n".join(map(line, range(20))) + "\n" + line(20)[:9])
    assert drained(spark, str(log), cp, sink, rangeBytes="50") == want[:20]
    assert drained(spark, str(log), cp, sink, rangeBytes="50") == want[:20]  # started again: nothing new, half a line waits
    with a.open("a") as f:
        f.write(line(20)[9:] + "\nnot json\n\r\n" + line(21) + "\r\n")
    (log / "b.jsonl").write_text("".join(line(k) + "\n" for k in range(22, 60)))
    (log / "other.txt").write_text("no line of it\n")
    assert drained(spark, str(log), cp, sink, rangeBytes="50") == want
    batch = append_log.tail(spark, str(log), "k long, s string", stream=False, rangeBytes="37")
    assert sorted((r.k, r.s) for r in batch.collect()) == want and batch.rdd.getNumPartitions() > 10
    a.write_text("")
    with pytest.raises(Exception, match="shrunk"):
        drained(spark, str(log), cp, sink)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_ranges_of_any_size_read_the_same_lines(tmp_path, step, monkeypatch):
    monkeypatch.setattr(append_log, "READ_BYTES", 5)
    f = tmp_path / "x.jsonl"
    data = b"a\n\nbcd\r\n" + b"e" * 23 + b"\n\xff\xfe\nlast\nhalf"
    f.write_bytes(data)
    files = append_log._Files({"path": str(f), "rangeBytes": str(step)})
    ends = files.ends({})
    assert ends == {str(f): len(data) - 4}
    got = [(o, x) for p in files.ranges({}, ends) for b in files.lines(p) for o, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert got == [(0, "a"), (3, "bcd"), (8, "e" * 23), (32, "��"), (35, "last")]


def test_a_log_that_is_not_there_yet(spark, tmp_path):
    assert append_log.tail(spark, str(tmp_path / "none"), "k long", stream=False).count() == 0
