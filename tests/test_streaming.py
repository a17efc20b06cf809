"""Streams in several batches: nothing is lost at the end, and what comes too late is counted."""

from pyspark.sql import functions as F

from palisade.config import MINUTE, SECOND, UebaConfig
from palisade.operators import endpoint, ueba
from palisade.streaming import jobs
from test_rules import T0, auth, make_events


def told(rows):
    return sorted((r.detection_id, tuple(r.evidence_event_ids), r.last_seen) for r in rows.collect())


def as_stream(spark, batches, folder):
    """A file stream of one batch a file."""
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{folder}/{k}")
    files = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return files.parquet(str(folder))


def test_brute_force_and_features_over_batches(spark, tmp_path):
    rows = [auth(i, T0 + i * 40 * SECOND, "failed" if i % 5 else "success", ip=f"10.1.1.{i % 2}") for i in range(60)]
    rows += [auth(100 + i, T0 + (2 * 60 + i) * MINUTE, "failed") for i in range(4)] + [auth(120, T0 + 125 * MINUTE, "success")]
    events = make_events(spark, rows)
    parts = [events.where(F.col("event_id").between(a, b)) for a, b in (("e000", "e029"), ("e030", "e059"), ("e100", "e999"))]
    stream = as_stream(spark, parts, tmp_path / "in")
    folder = str(tmp_path / "brute")
    out = jobs.drain(jobs.brute_force(jobs.closable(stream, folder), "10 minutes"), folder, stream.schema)
    assert told(out) == told(endpoint.auth_001(events)) and out.count() > 3
    assert jobs.late_rows(spark, folder) == 0

    folder = str(tmp_path / "features")
    windows = jobs.drain(jobs.user_features(jobs.closable(stream, folder), "10 minutes"), folder, stream.schema)
    whole = ueba.features(events, UebaConfig()).drop("window_start")
    got = jobs.with_new_addresses(windows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect()))


def test_late_rows_are_counted(spark, tmp_path):
    on_time = make_events(spark, [auth(i, T0 + i * MINUTE, "failed") for i in range(100)])
    late = make_events(spark, [auth(200 + i, T0 + i * SECOND, "failed") for i in range(7)])
    # a batch drops what the watermark of the batch before it had passed
    more = make_events(spark, [auth(300 + i, T0 + (100 + i) * MINUTE, "failed") for i in range(5)])
    stream = as_stream(spark, [on_time, more, late], tmp_path / "in")
    folder = str(tmp_path / "out")
    windows = jobs.drain(jobs.user_features(jobs.closable(stream, folder), "10 minutes"), folder, stream.schema)
    assert windows.agg(F.sum("event_count")).first()[0] == 105 and jobs.late_rows(spark, folder) == 7
