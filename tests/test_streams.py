"""Streams with keyed state: restarts, replays, times to live, and plain loops over the same rows."""

import collections
import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.streaming import jobs


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def batches(spark, tmp_path, parts, schema, work):
    """Runs ``work(stream)`` (a writer) once for each part of the input, with one checkpoint: a restart between each."""
    source = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        work(spark.readStream.schema(schema).parquet(source)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()


def test_outbox_writes_each_key_once_over_restarts(spark, tmp_path):
    sink, schema = str(tmp_path / "out"), "kind string, subject_id string, n int"
    parts = [[("a", "1", 5), ("a", "1", 2), ("a", None, 1)], [("a", "1", 0), ("b", "1", 3), ("a", None, 1)], [("a", "1", 0), ("b", "1", 9)]]
    batches(spark, tmp_path, parts, schema, lambda s: jobs.outbox(s, sink, ["kind", "subject_id"], ["n"]))
    got = sorted(((r.kind, r.subject_id or "", r.n) for r in spark.read.parquet(sink).collect()))
    assert got == [("a", "", 1), ("a", "", 1), ("a", "1", 2), ("b", "1", 3)]


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    write = jobs.batches_into(str(tmp_path / "out"))
    rows = spark.createDataFrame([("a", 1)], "kind string, n int")
    for number in (0, 1, 1, 0):
        write(rows, number)
    assert sorted(r.batch for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_a_key_is_forgotten_after_its_time_to_live():
    """The state function by itself: a stream with such a timeout goes on for ever."""

    class State:
        def __init__(self):
            self.value, self.now, self.exists, self.hasTimedOut, self.wait = None, 1000, False, False, None

        get = property(lambda self: (self.value,))

        def getCurrentProcessingTimeMs(self):
            return self.now

        def update(self, value):
            self.value, self.exists = value[0], True

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.wait = ms

    state, frame = State(), pd.DataFrame({"n": [3, 1, 2]})
    work = jobs._first(["n"], 500)
    assert [x["n"].tolist() for x in work(("k",), iter([frame, frame]), state)] == [[1]] and state.wait == 500
    state.now = 1400
    assert list(work(("k",), iter([frame]), state)) == [] and state.wait == 100
    state.now = 1500
    assert [x["n"].tolist() for x in work(("k",), iter([frame]), state)] == [[1]] and state.value == 1500
    state.hasTimedOut = True
    assert list(work(("k",), iter([]), state)) == [] and not state.exists


def test_misses_against_a_plain_loop(spark, tmp_path):
    r, sink = random.Random(3), str(tmp_path / "out")
    parts = [[(s, str(i), run, r.random() < 0.8, r.random() < 0.3) for run in range(first, first + 4) for s in "ab" for i in range(6) if r.random() < 0.9] for first in (0, 4)]
    want, last = {}, {}
    for part in parts:
        for s, i, run, eligible, seen in sorted(part, key=lambda x: x[2]):
            want[s, i] = 0 if seen else want.get((s, i), 0) + eligible
    for part in parts:
        r.shuffle(part)
    batches(spark, tmp_path, parts, "source string, external_id string, run long, eligible boolean, seen boolean", lambda s: jobs.counted_misses(s).writeStream.outputMode("update").foreachBatch(jobs.batches_into(sink)))
    for x in sorted(spark.read.parquet(sink).collect(), key=lambda x: x.batch):
        last[x.source, x.external_id] = x.misses
    assert last == want and max(want.values()) > 2


def test_limited_stream_and_subjects_once(spark, tmp_path):
    r, sink = random.Random(4), str(tmp_path / "out")
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    hits = sorted((r.randrange(400), k) for k in "xy" for _ in range(60))
    parts = [[(k, at(n)) for n, k in hits if lo <= n < lo + 200] for lo in (0, 200)]
    batches(spark, tmp_path, parts, "key string, at timestamp", lambda s: jobs.limited(s, 3, 50.0).writeStream.foreachBatch(jobs.batches_into(sink)))
    want, accepted = collections.Counter(), collections.defaultdict(list)
    for n, k in hits:
        own = [t for t in accepted[k] if t > n - 50]
        want[k, n, len(own) < 3] += 1
        accepted[k] = [*own, n] if len(own) < 3 else own
    got = collections.Counter((x.key, int((x.at - at(0)).total_seconds()), x.allowed) for x in spark.read.parquet(sink).collect())
    assert got == want

    events = spark.createDataFrame([("a", "1", at(0)), ("a", "1", at(5)), ("a", "2", at(9))], "kind string, subject_id string, ts timestamp")
    events.write.parquet(str(tmp_path / "events"))
    stream = jobs.once_per_subject(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "once")).trigger(availableNow=True).foreachBatch(jobs.batches_into(str(tmp_path / "told"))).start().awaitTermination()
    assert sorted(x.subject_id for x in spark.read.parquet(str(tmp_path / "told")).select(F.col("subject_id")).collect()) == ["1", "2"]
