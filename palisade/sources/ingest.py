"""Contract checks, canonical form and first-arrival storage of submitted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from palisade.functions.core import blank, nz
from palisade.functions.state import pin
from palisade.operators.intel import with_address
from palisade.operators.text import SECRETS
from palisade.schema import EVENT_COLUMNS

# Longest text per column, required columns, event vocabulary.
MAX_LENGTH = {"event_id": 256, "event_type": 128, "source": 128, "host": 256, "user": 256,
              "protocol": 32, "process_name": 512, "parent_process": 512, "file_hash": 256,
              "domain": 512, "status": 64}
REQUIRED = ("event_id", "timestamp", "event_type", "source", "raw_event")
VOCABULARY = ("authentication", "process_creation", "network_connection", "dns_query",
              "file_activity", "data_transfer")
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_time(text: Column) -> Column:
    """Naive UTC time of a text that carries its zone; NULL otherwise."""
    moment = F.try_to_timestamp(text)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
    return F.when(text.rlike(ZONED), utc)


def validate_contract(submitted: DataFrame) -> DataFrame:
    """Add `errors`: codes of every contract breach. Text columns as submitted.

    Columns outside the contract are reported as `unknown:<name>` when not NULL;
    `arrival` is the caller's own row order and not part of the submission.
    """
    rows = submitted
    for c in ("source_ip", "destination_ip"):
        rows = with_address(rows, c, f"_{c}")
    has = lambda c: ~blank(F.trim(F.col(c)))
    port = F.col("destination_port").try_cast("bigint")
    known = {n for n, _ in EVENT_COLUMNS}
    checks = [F.when(~has(c), f"missing:{c}") for c in REQUIRED]
    checks += [F.when(F.length(F.trim(c)) > n, f"too_long:{c}") for c, n in MAX_LENGTH.items()]
    checks += [
        F.when(has("timestamp") & ~F.trim("timestamp").rlike(ZONED), "naive:timestamp"),
        F.when(has("timestamp") & F.trim("timestamp").rlike(ZONED)
               & parse_time(F.trim("timestamp")).isNull(), "bad:timestamp"),
        F.when(F.col("destination_port").isNotNull() & ~nz(port.between(0, 65535), False),
               "bad:destination_port"),
    ]
    checks += [F.when(has(c) & F.col(f"_{c}").isNull(), f"bad:{c}") for c in ("source_ip", "destination_ip")]
    checks += [F.when(F.col(c) < 0, f"negative:{c}") for c in ("bytes_sent", "bytes_received")]
    checks += [F.when(F.col(c).isNotNull(), f"unknown:{c}") for c in submitted.columns
                 if c not in known and c != "arrival" and not c.startswith("_")]
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def _tidy(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def normalize_event(valid: DataFrame) -> DataFrame:
    """Canonical columns of checked submissions; the raw payload stays as it came."""
    shape = {"event_type": F.lower, "file_hash": F.lower, "domain": F.lower, "status": F.lower,
             "protocol": F.upper}
    out = []
    for name, kind in EVENT_COLUMNS:
        if name == "timestamp":
            col = parse_time(F.trim("timestamp"))
        elif name == "raw_event":
            col = F.col("raw_event")
        elif name in ("source_ip", "destination_ip"):
            col = F.coalesce(F.col(f"_{name}"), _tidy(name))
        elif kind == "string":
            col = shape.get(name, lambda x: x)(_tidy(name))
        else:
            col = F.col(name).cast(kind)
        out.append(col.alias(name))
    return valid.select(*out, *[c for c in ("arrival",) if c in valid.columns])


def split_new(events: DataFrame, stored: DataFrame | None, arrival: str = "arrival") -> DataFrame:
    """Add `status`: created for the first arrival of an unseen event id, else duplicate.

    Equal arrivals of an id are told apart by a hash of their other columns.
    """
    rest = [F.col(c) for c, kind in events.dtypes if c != arrival and "map<" not in kind]
    w = W.partitionBy("event_id").orderBy(arrival, F.xxhash64(*rest))
    rows = events.withColumn("_first", F.row_number().over(w) == 1)
    if stored is not None:
        seen = stored.select("event_id").distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(seen, "event_id", "left")
    else:
        rows = rows.withColumn("_seen", F.lit(None).cast("boolean"))
    fresh = F.col("_first") & F.col("_seen").isNull()
    return rows.withColumn("status", F.when(fresh, "created").otherwise("duplicate")).drop("_first", "_seen")


def batch_report(submitted: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per submitted item: created, duplicate or rejected. Needs an `arrival` column."""
    # kept, so that each item is checked once, and not again for either kind and within its filter
    checked = pin(validate_contract(submitted).select("event_id", "arrival", (F.size("errors") > 0).alias("bad")))
    good = split_new(checked.where("NOT bad").select(_tidy("event_id").alias("event_id"), "arrival"), stored)
    rejected = checked.where("bad").select("event_id", "arrival", F.lit("rejected").alias("status"))
    return good.select("event_id", "arrival", "status").unionByName(rejected)


def append_events(events: DataFrame, path: str) -> None:
    """Append first arrivals of unseen ids to the stored table."""
    spark = events.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.parquet(path) if there else None
    split_new(events, stored).where("status = 'created'").drop("status", "arrival").write.mode(
        "append").parquet(path)


def telemetry_audit(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Add `errors`: quality breaches of each stored event, payload checks included."""
    raw = lambda k: F.get_json_object("raw_event", f"$.{k}")
    rows = events
    for c in ("source_ip", "destination_ip"):
        rows = with_address(rows, c, f"_{c}")
    copies = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    kinds = rows.groupBy(raw("scenario_id").alias("_sid")).agg(
        F.count_distinct(raw("scenario_type")).alias("_types")).where("_types > 1")
    rows = rows.withColumn("_sid", raw("scenario_id")).join(copies, "event_id", "left").join(
        kinds, "_sid", "left")
    blob = F.concat_ws(" ", "command_line", "url", "raw_event")
    secret = F.lit(None).cast("string")
    for p in reversed(SECRETS):
        secret = F.when(blob.rlike(f"(?i){p}"), F.lit(f"secret:{p}")).otherwise(secret)
    late = F.lit(False) if now is None else F.col("timestamp") > now
    checks = [
        *[F.when(blank(F.col(c).cast("string")), f"missing:{c}") for c in REQUIRED],
        F.when(F.col("_copies").isNotNull(), "duplicate:event_id"), F.when(late, "future:timestamp"),
        F.when(~nz(F.col("event_type").isin(*VOCABULARY), False), "bad:event_type"),
        *[F.when(~blank(c) & F.col(f"_{c}").isNull(), f"bad:{c}") for c in ("source_ip", "destination_ip")],
        F.when(~F.col("destination_port").between(0, 65535), "bad:destination_port"),
        *[F.when(blank(raw(k)), f"raw_missing:{k}") for k in ("generator", "scenario_id", "scenario_type")],
        F.when(F.col("_types").isNotNull(), "inconsistent:scenario_id"), secret,
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*checks))).drop(
        "_sid", "_copies", "_types", "_source_ip", "_destination_ip")


def upsert(stored: DataFrame | None, batch: DataFrame, key: str, at: Column,
           keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Stored rows after an idempotent write: batch columns replace, `keep` columns and
    unknown ids survive. Adds created_at, updated_at and `change` (created, updated, kept)."""
    # of rows that repeat a key in one batch, the one with the least hash
    mark = F.xxhash64(*[F.col(c) for c, kind in batch.dtypes if "map<" not in kind])
    batch = batch.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(mark))).where("_k = 1").drop("_k")
    if stored is None:
        return batch.withColumns({"created_at": at, "updated_at": at, "change": F.lit("created")})
    held = [c for c in stored.columns if c not in (key, "change")]
    old = stored.select(key, *[F.col(c).alias(f"_old_{c}") for c in held], F.lit(True).alias("_had"))
    both = old.join(batch.withColumn("_has", F.lit(True)), key, "full_outer")
    had, has = F.col("_had").isNotNull(), F.col("_has").isNotNull()
    out = {}
    for c in dict.fromkeys([*batch.columns, *held]):
        if c == key or c == "updated_at":
            continue
        was = F.col(f"_old_{c}") if c in held else F.lit(None)
        if c == "created_at" or (c in keep and c not in batch.columns):
            out[c] = F.coalesce(was, at) if c == "created_at" else was
        elif c in keep:
            out[c] = F.when(had, was).otherwise(F.col(c))
        elif c in batch.columns:
            out[c] = F.when(has, F.col(c)).otherwise(was)
        else:
            out[c] = was
    updated = F.when(has, at).otherwise(F.col("_old_updated_at"))
    change = F.when(~has, "kept").when(had, "updated").otherwise("created")
    return both.select(key, *[v.alias(k) for k, v in out.items()], updated.alias("updated_at"),
                       change.alias("change"))


def upsert_detections(stored, batch, at: Column) -> DataFrame:
    return upsert(stored, batch, "detection_id", at)


def upsert_incidents(stored, batch, at: Column, preserve_status: bool = False) -> DataFrame:
    """As above; the batch resets `status` unless told to preserve it, and the assignee
    survives either way."""
    keep = ("created_at", "assignee") + (("status",) if preserve_status else ())
    return upsert(stored, batch, "incident_id", at, keep)


def referential_check(incidents: DataFrame, dets: DataFrame) -> DataFrame:
    """Detection ids cited by incidents but not stored."""
    cited = incidents.select("incident_id", F.explode("detection_ids").alias("detection_id"))
    return cited.join(dets.select("detection_id"), "detection_id", "left_anti")


def jsonl(records: DataFrame, order: str = "fingerprint") -> DataFrame:
    """One key-sorted JSON line per record."""
    return records.select(F.col(order).alias("order"), F.to_json(
        F.struct(*sorted(records.columns))).alias("line"))


def digest(lines: DataFrame) -> DataFrame:
    """One content digest and the number of lines, by a tree of SHA-256.

    Line hashes are ordered and hashed together within their first six hex digits, these digests
    within the first three, and those at the top; so a node has 4,096 children at most, and a leaf
    the 16-millionth part of all lines.
    """
    rows = lines.select(F.sha2(F.concat_ws("|", "order", "line"), 256).alias("h"))
    together = lambda key, what: F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(what).alias("v")))), lambda x: x["v"]), ""), 256)
    low = rows.groupBy(F.substring("h", 1, 6).alias("p")).agg(together("h", "h").alias("d"), F.count(F.lit(1)).alias("n"))
    mid = low.groupBy(F.substring("p", 1, 3).alias("q")).agg(together("p", "d").alias("d"), F.sum("n").alias("n"))
    return mid.agg(together("q", "d").alias("sha256"), F.sum("n").alias("lines"))


def write_jsonl(records: DataFrame, path: str, order: str = "fingerprint") -> DataFrame:
    """Write the lines in order and return their digest."""
    lines = jsonl(records, order)
    lines.orderBy("order").select("line").write.mode("overwrite").text(path)
    return digest(lines)


def write_metrics(frames: dict[str, DataFrame], folder: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
