"""Streaming forms of the ingest, rate, behaviour and brute-force operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.config import MINUTE, UEBA_FEATURES, DetectConfig, UebaConfig
from palisade.functions.core import blank, from_micros, micros, nz
from palisade.functions.detection import detections
from palisade.functions.state import counted, ensure_checkpoint_dir, pin
from palisade.operators.detect import Rule, run_rules
from palisade.operators.endpoint import FAILED, SUCCEEDED


def work_folder(df: DataFrame) -> str:
    """A fresh folder below the shared checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


#: A closing mark: an event of its own user, later than all others.
CLOSING, CLOSING_US = "closing-mark", 7_258_118_400 * 1_000_000


def closable(events: DataFrame, folder: str) -> DataFrame:
    """The stream with room for closing marks, which are read from `folder`/marks.

    A mark is later than any event, so once it is read the watermark passes all windows and waiting
    rows, and a finite stream ends with everything emitted. What comes after a mark is late.
    """
    spark = events.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/marks")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    # state schemas are fixed by the first batch: no column may be less nullable than with marks
    never = {f.name: F.nullif(F.col(f.name), F.lit(CLOSING)) for f in events.schema
             if not f.nullable and isinstance(f.dataType, T.StringType)}
    return events.withColumns(never).unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/marks"))


def write_mark(spark: SparkSession, schema: T.StructType, folder: str) -> None:
    told = {"event_id": F.lit(CLOSING), "user": F.lit(CLOSING), "event_type": F.lit("authentication"), "status": F.lit("success"),
            "ts_us": F.lit(CLOSING_US), "timestamp": from_micros(F.lit(CLOSING_US))}
    one = spark.range(1).select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    one.coalesce(1).write.mode("append").parquet(f"{folder}/marks")


def drain(stream: DataFrame, folder: str | None = None, closing: T.StructType | None = None) -> DataFrame:
    """Run an append stream over what is available now and read what it wrote.

    With `closing`, the schema of a `closable` stream over the same folder, a mark is written after
    the data and the stream runs on over it, so that open windows are emitted too. The rows that
    came too late, by Spark's own count over the last batches, are in `folder`/late.
    """
    folder = folder or work_folder(stream)
    spark = stream.sparkSession
    late = 0
    for last in (False, True) if closing is not None else (False,):
        if last:
            write_mark(spark, closing, folder)
        query = stream.writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        late += sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    spark.range(1).select(F.lit(late).cast("bigint").alias("rows")).coalesce(1).write.mode("overwrite").json(f"{folder}/late")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def late_rows(spark: SparkSession, folder: str) -> int:
    return spark.read.schema("rows bigint").json(f"{folder}/late").first()["rows"]


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Attach ordering and event time and accept rows up to `delay` late."""
    rows = events if "ts_us" in events.columns else events.withColumn("ts_us", micros("timestamp"))
    return rows.withColumn("event_time", from_micros("ts_us").cast("timestamp")).withWatermark(
        "event_time", delay)


def ingest_dedup(events: DataFrame, delay: str) -> DataFrame:
    """First arrival of every event id within the lateness horizon.

    Other streams start with this too: here each late row counts as one in Spark's metrics, which a
    partial aggregation would blur.
    """
    return _timed(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def rate_buckets(flows: DataFrame, width: str) -> DataFrame:
    """Flows and packets per target in epoch-anchored windows, emitted when closed."""
    key = F.when(blank("destination_ip"), F.lit("GLOBAL")).otherwise(F.col("destination_ip"))
    counted = flows.groupBy(F.window("event_time", width), key.alias("key")).agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum(nz("fwd_pkts", 0.0) + nz("bwd_pkts", 0.0)).alias("packets"))
    return counted.select("key", F.unix_micros("window.start").alias("window_us"), "flows", "packets")


def user_features(events: DataFrame, delay: str, cfg: UebaConfig = UebaConfig()) -> DataFrame:
    """Hourly behaviour of each user with the addresses of the hour, emitted when closed.

    All features but the count of new addresses, which `with_new_addresses` adds to the output.
    """
    rows = ingest_dedup(events.where(~blank("user")), delay)
    auth = F.col("event_type") == "authentication"
    status, hour = F.lower(nz("status", "")), F.hour(from_micros("ts_us"))
    target = F.when(~blank("destination_ip"), F.col("destination_ip")).when(~blank("domain"), F.col("domain"))
    return rows.groupBy(F.window("event_time", f"{cfg.window_hours} hour"), "user").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(auth).alias("auth_event_count"),
        F.count_if(auth & status.isin(*FAILED)).alias("failed_auth_count"),
        F.count_if(auth & status.isin(*SUCCEEDED)).alias("successful_auth_count"),
        F.collect_set(F.when(~blank("source_ip"), F.col("source_ip"))).alias("addresses"),
        F.size(F.collect_set(target)).alias("unique_destination_count"),
        F.count_if(F.col("event_type") == "dns_query").alias("dns_event_count"),
        F.log1p(F.greatest(F.sum(nz("bytes_sent")), F.lit(0))).alias("outbound_bytes_log1p"),
        F.count_if(F.col("event_type") == "process_creation").alias("process_event_count"),
        F.count_if((hour < cfg.day_start_hour) | (hour >= cfg.day_end_hour)).alias("unusual_hour_event_count"),
    ).select(F.col("user").alias("entity_key"), F.unix_micros("window.start").alias("window_us"), "event_count", "auth_event_count",
             "failed_auth_count", "successful_auth_count", "addresses", "unique_destination_count", "dns_event_count",
             "outbound_bytes_log1p", "process_event_count", "unusual_hour_event_count")


def with_new_addresses(windows: DataFrame) -> DataFrame:
    """The 12 features of emitted windows: an address is new in the first of its user's windows that has it."""
    seen = windows.select("entity_key", "window_us", F.explode("addresses").alias("address"))
    first = seen.groupBy("entity_key", "address").agg(F.min("window_us").alias("window_us"))
    fresh = first.groupBy("entity_key", "window_us").agg(F.count(F.lit(1)).alias("fresh"))
    whole = windows.join(fresh, ["entity_key", "window_us"], "left").withColumns({
        "unique_source_ip_count": F.size("addresses"), "new_source_ip_count": nz("fresh"),
        "failed_auth_ratio": F.when(F.col("auth_event_count") > 0, F.col("failed_auth_count") / F.col("auth_event_count")).otherwise(0.0)})
    return whole.select("entity_key", "window_us", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in UEBA_FEATURES])


def _brute_state(window_us: int, need: int):
    def handle(key, batches, state: GroupState):
        kept = [tuple(r) for r in zip(*state.get)] if state.exists else []
        for pdf in batches:
            kept += list(zip(pdf["ts_us"].tolist(), pdf["event_id"].tolist(), pdf["ok"].tolist()))
        kept.sort()
        # Rows up to the watermark are final; later ones may still gain neighbours.
        done = state.getCurrentWatermarkMs() * 1000
        fired, fail_us, fail_ids, first = [], [], [], 0
        for us, event_id, ok in kept:
            if not ok:
                fail_us.append(us)
                fail_ids.append(event_id)
                continue
            # successes come in order, so the window's first failure only moves on
            while first < len(fail_us) and fail_us[first] < us - window_us:
                first += 1
            if us <= done and len(fail_us) - first >= need:
                fired.append((key[0], key[1], fail_ids[first:], fail_us[first], event_id, us))
        rest = [r for r in kept if r[0] > done or (not r[2] and r[0] >= done - window_us)]
        waiting = [r[0] for r in rest if r[2]]
        if rest:
            state.update(tuple(map(list, zip(*rest))))
            due = min(waiting) // 1000 + 1 if waiting else (rest[-1][0] + window_us) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(fired, columns=["user", "anchor", "fails", "first_us", "event_id", "ts_us"])

    return handle


def brute_force(events: DataFrame, delay: str, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """AUTH-001 over a stream: failures per user and origin are kept for the window, and
    a success is judged once the watermark has passed it."""
    host = F.when(blank("host"), F.lit("unknown")).otherwise(F.col("host"))
    anchor = F.when(blank("source_ip"), F.concat(F.lit("host:"), host)).otherwise(F.col("source_ip"))
    rows = ingest_dedup(events.where(
        (F.col("event_type") == "authentication") & ~blank("user")
        & F.col("status").isin(*FAILED, *SUCCEEDED)), delay)
    rows = rows.select("user", anchor.alias("anchor"), "event_id", "ts_us", "event_time",
                       F.col("status").isin(*SUCCEEDED).alias("ok"))
    fired = rows.groupBy("user", "anchor").applyInPandasWithState(
        _brute_state(cfg.brute_window_minutes * MINUTE, cfg.brute_min_fails),
        "user string, anchor string, fails array<string>, first_us bigint, event_id string, ts_us bigint",
        "us array<bigint>, ids array<string>, ok array<boolean>", "append",
        GroupStateTimeout.EventTimeTimeout)
    n = F.size("fails").cast("bigint")
    reason = F.concat(
        n.cast("string"), F.lit(" failed authentication attempts for user '"), F.col("user"),
        F.lit("' from "), F.col("anchor"), F.lit(
            f" were followed by a successful authentication within {cfg.brute_window_minutes} minutes."))
    return detections(
        fired, "AUTH-001", F.least(0.60 + 0.08 * n, F.lit(0.95)), reason,
        {"user": F.col("user"), "anchor": F.col("anchor"), "fail_count": n,
         "same_ip": ~F.col("anchor").startswith("host:")},
        evidence=F.concat("fails", F.array("event_id")), first_us=F.col("first_us"), last_us=F.col("ts_us"))


def _once(batch: DataFrame) -> DataFrame:
    """One row an event id. Ids are counted first, so that whole rows travel only where one repeats."""
    repeated = counted(batch.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("event_id"))
    if repeated.isEmpty():
        return batch
    again = batch.join(repeated, "event_id", "left_semi").dropDuplicates(["event_id"])
    return batch.join(repeated, "event_id", "left_anti").unionByName(again)


def chunk_step(rules: dict[str, Rule], folder: str, overlap_us: int,
               members: bool = True) -> Callable[[DataFrame, int], None]:
    """foreachBatch step: detect over the new rows plus the carried recent ones.

    Everything is written under the batch number, so a repeated batch overwrites
    its own output. Rows older than the carry horizon are still examined with
    their batch and are counted in `late`. Recent rows are read where their batch
    landed; `carry` tells which batches have some and from when on.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The stream turns adaptive planning off; the rules inside are batch queries.
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        # Landing the batch first keeps the plans of the rules short.
        landed = f"{folder}/in/{batch_id}"
        batch.drop("event_time").write.mode("overwrite").parquet(landed)
        batch = spark.read.parquet(landed)
        newest = batch.agg(F.max("ts_us").alias("t")).first()["t"]
        layout = "batch bigint, newest bigint, cut bigint"
        held = spark.read.schema(layout).json(f"{folder}/carry/{batch_id - 1}").collect() if batch_id > 0 else []
        keep = [tuple(r) for r in held]
        if newest is not None:
            horizon = max((r["newest"] for r in held), default=0)
            late = batch.where(F.col("ts_us") <= horizon - overlap_us)
            late.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(f"{folder}/late/{batch_id}")
            cut = max([newest - overlap_us, *(r["cut"] for r in held)])
            rows = _once(batch)
            recent = [f"{folder}/in/{r['batch']}" for r in held if r["newest"] > cut]
            if recent:
                fresh = _once(spark.read.parquet(*recent).where(F.col("ts_us") > cut))
                rows = rows.unionByName(pin(fresh.join(batch.select("event_id"), "event_id", "left_anti")))
            out = run_rules(rows, rules)
            out.detections.write.mode("overwrite").parquet(f"{folder}/detections/batch={batch_id}")
            if members:
                out.members.write.mode("overwrite").parquet(f"{folder}/members/batch={batch_id}")
            out.failed.write.mode("overwrite").json(f"{folder}/failed/batch={batch_id}")
            keep = [(b, t, cut) for b, t in [*((r["batch"], r["newest"]) for r in held), (batch_id, newest)] if t > cut]
        spark.createDataFrame(keep, layout).coalesce(1).write.mode("overwrite").json(f"{folder}/carry/{batch_id}")

    return step


def chunked_detect(flows: DataFrame, rules: dict[str, Rule], overlap_us: int,
                   folder: str | None = None) -> DataFrame:
    """Detections of a flow stream taken in batches with a carry of recent rows.

    Bucket members are written where the caller names the folder they can be read from.
    """
    named, folder = folder is not None, folder or work_folder(flows)
    step = chunk_step(rules, folder, overlap_us, members=named)
    query = flows.writeStream.foreachBatch(step).option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return flows.sparkSession.read.parquet(f"{folder}/detections").drop("batch").dropDuplicates(
        ["fingerprint"])
