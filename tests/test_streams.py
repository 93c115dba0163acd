"""Late records, windows in append mode and repeated batches."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from skytally.operators import detectors
from skytally.sources.telemetry import telemetry
from skytally.streaming import stateful, windows


def folder(spark, tmp_path, batches):
    """A folder of event files whose times of change are those of the batches."""
    os.makedirs(tmp_path / "in")
    for k, seconds in enumerate(batches):
        rows = [(100 * k + j, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=s), 1, "view", 10.0, '{"k": 3}') for j, s in enumerate(seconds)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"file://{tmp_path}/b{k}")
        (part,) = (tmp_path / f"b{k}").glob("*.parquet")
        os.rename(part, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (10**9 + k, 10**9 + k))
    return f"file://{tmp_path}/in"


def test_late_records_are_dropped_and_open_windows_wait(spark, tmp_path):
    """The view's seconds are the events' minutes. The last batch has a record for a window that was given out before."""
    path = folder(spark, tmp_path, [[0, 10, 29], [31, 70], [95], [5, 200]])
    rows = windows.drained(windows.tumbling(windows.source(spark, path, "*.parquet"))).orderBy("start_us").collect()
    first = min(r.start_us for r in rows)
    assert [((r.start_us - first) // 1_000_000, r.n) for r in rows] == [(0, 3), (30, 1), (60, 1), (90, 1)]


def test_no_window_twice(spark, tmp_path):
    path = folder(spark, tmp_path, [[0], [40], [80], [120]])
    rows = windows.drained(windows.sliding(windows.source(spark, path, "*.parquet"))).groupBy("start_us", "function_id").count().where("count > 1").count()
    assert rows == 0


def test_repeated_records_within_the_watermark(spark, tmp_path):
    path = folder(spark, tmp_path, [[0, 1], [2]])
    stream = windows.source(spark, path, "*.parquet").withColumn("event_id", F.lit(1).cast("long"))
    assert windows.drained(windows.deduplicated(stream)).count() == 1


def votes_of(df):
    return {r.event_id: tuple(r) for r in df.collect()}


def dealt(spark, tmp_path, pieces):
    """A folder of the pieces of the events as files, in order."""
    os.makedirs(tmp_path / "in")
    for k, piece in enumerate(pieces):
        piece.coalesce(1).write.parquet(f"file://{tmp_path}/p{k}")
        (part,) = (tmp_path / f"p{k}").glob("*.parquet")
        os.rename(part, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (10**9 + k, 10**9 + k))
    return windows.source(spark, f"file://{tmp_path}/in", "*.parquet")


@pytest.mark.parametrize("files", [1, 2, 7])
def test_votes_do_not_depend_on_how_the_input_is_split(spark, tables, tmp_path, files):
    """As many votes as records are settled, each the panel's over all records."""
    events = spark.read.parquet(f"{tables}/events.parquet").where("event_id < 420")
    cut = sorted(r.event_id for r in events.select("event_id").collect())
    ends = [cut[len(cut) * k // files] for k in range(files)] + [10**9]
    pieces = [events.where(f"event_id >= {a} AND event_id < {b}") for a, b in zip(ends, ends[1:], strict=False)]
    want = votes_of(detectors.votes(telemetry(events)))
    last = max(r[1] for r in want.values())
    assert votes_of(stateful.settled_votes(dealt(spark, tmp_path, pieces))) == {k: r for k, r in want.items() if r[1] <= last - stateful.LATENESS}


def test_late_records_change_no_vote(spark, tables, tmp_path):
    """A record within the lateness waits for its place; a later one is dropped; an empty file and one without times settle nothing."""
    events = spark.read.parquet(f"{tables}/events.parquet").where("event_id < 260")
    view = {r.event_id: r.t_us for r in telemetry(events).collect()}
    lateness = 3_000_000_000
    late = sorted(i for i in view if i % 40 == 7 and i < 150)
    known = set(view) - set(late)
    ids = lambda s: F.col("event_id").isin(sorted(s))
    first, second = {i for i in known if i < 150}, {i for i in known if i >= 150}
    dropped = {i for i in late if view[i] <= max(view[k] for k in first) - lateness}
    pieces = [events.where(ids(first)), events.limit(0), events.where(ids(set(late))), events.where(ids(second)), events.limit(1).withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "event_id": F.lit(9999).cast("long")})]
    got = votes_of(stateful.settled_votes(dealt(spark, tmp_path, pieces), lateness=lateness))
    want = votes_of(detectors.votes(telemetry(events.where(~ids(dropped)))))
    assert dropped and set(late) - dropped and got == {k: r for k, r in want.items() if r[1] <= max(view.values()) - lateness}


def test_a_batch_that_runs_again_replaces_itself(spark, tables, tmp_path):
    rows = telemetry(spark.read.parquet(f"{tables}/events.parquet").where("event_id < 300"))
    halves = [rows.where("event_id < 150"), rows.where("event_id >= 150")]
    twice, once = (stateful.Carried(spark, f"file://{tmp_path}/{n}") for n in ("twice", "once"))
    for k, half in enumerate(halves):
        once.add(half, k)
        twice.add(half, k)
        twice.add(half, k)
    assert votes_of(twice.results(2)) == votes_of(once.results(2)) and twice.results(2).count() == once.results(2).count()
