"""Flow-meter CSV files: reading, row numbers and the two dataset adapters."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from palisade.functions.core import nz, uuid5
from palisade.operators.evaluate import normalize_label
from palisade.operators.intel import with_address
from palisade.schema import EVENT_DDL, FLOW_NUMERICS

# Protocol numbers, header aliases, dataset identities.
PROTOCOLS = {"6": "TCP", "17": "UDP", "1": "ICMP"}
ALIASES = {
    "Tot Fwd Pkts": "Total Fwd Packets", "Tot Bwd Pkts": "Total Backward Packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packets", "TotLen Bwd Pkts": "Total Length of Bwd Packets",
    "Fwd Pkt Len Mean": "Fwd Packet Length Mean", "Bwd Pkt Len Mean": "Bwd Packet Length Mean",
    "Fwd Seg Size Avg": "Avg Fwd Segment Size", "Bwd Seg Size Avg": "Avg Bwd Segment Size",
    "SYN Flag Cnt": "SYN Flag Count", "ACK Flag Cnt": "ACK Flag Count",
    "FIN Flag Cnt": "FIN Flag Count", "RST Flag Cnt": "RST Flag Count",
    "Fwd Header Len": "Fwd Header Length", "Bwd Header Len": "Bwd Header Length",
    "Init Fwd Win Byts": "Init_Win_bytes_forward", "Init Bwd Win Byts": "Init_Win_bytes_backward",
}
NAMESPACE_2018 = "c7a2b4e13f5d5a6b8c9d0e1f2a3b4c5d"
SOURCE_2018, VERSION_2018, DATASET_2018 = "cse_cic_ids2018", "cse-cic-ids2018-v1", "CSE-CIC-IDS2018"
NAMESPACE_2017 = "db2ad4b68e0d553394b62ecc528b741c"
SOURCE_2017, VERSION_2017, DATASET_2017 = "cicids2017", "cicids2017-v1", "CICIDS2017"


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The files behind a path or pattern, as Spark lists them."""
    return sorted(spark.read.text(path).inputFiles())


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of a file, trimmed; read from its first line, parsed as CSV."""
    line = spark.read.text(file).first()
    return tuple(c.strip() for c in next(csv.reader([line["value"].lstrip("\ufeff")]), [])) if line else ()


def read_flow_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """All-text rows with trimmed headers and no NULLs, plus file and 1-based row number.

    Files are read by their own header: those with equal headers together, the groups united by
    name, a column that a file lacks being ''. Of columns with one name the last counts. Row numbers
    come from per-block counts and in-block positions, so a file is never gathered in one task; the
    counts are a second scan, no input is stored. Records must not span lines.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in _listed(spark, path):
        groups.setdefault(_header(spark, file), []).append(file)
    parts = [_read_group(spark, names, files) for names, files in groups.items() if names]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out = out.fillna("", [c for c in out.columns if c != "source_row"])
    return out if limit is None else out.where(F.col("source_row") <= limit)


def _read_group(spark: SparkSession, names: tuple[str, ...], files: list[str]) -> DataFrame:
    """Rows of files that share a header."""
    slots = ", ".join(f"_{i} string" for i in range(len(names)))
    raw = spark.read.schema(slots).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(files)
    last = {n: i for i, n in enumerate(names)}
    rows = raw.select(*[nz(F.col(f"_{i}"), "").alias(n) for n, i in last.items()],
                      F.col("_metadata.file_path").alias("_path"),
                      F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_id"))
    firsts = raw.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_id")).groupBy("_path", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = firsts.withColumn("_before", nz(F.sum("_n").over(before)))
    # ids rise by one within a block, which one task reads in order
    return rows.join(starts.select("_path", "_block", "_first", "_before"), ["_path", "_block"]).select(
        *last, F.element_at(F.split("_path", "/"), -1).alias("source_file"),
        (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("source_row"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry as JSON lines; the payload stays text."""
    return spark.read.schema(EVENT_DDL.replace("timestamp_ntz", "string")).json(path)


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry CSV: '' is NULL, counters are integers, raw_event is JSON text."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    whole = {"destination_port": "int", "bytes_sent": "bigint", "bytes_received": "bigint"}
    return raw.select(*[
        (F.nullif(F.col(c), F.lit("")).try_cast(whole[c]) if c in whole
         else F.col(c) if c == "raw_event" else F.nullif(F.col(c), F.lit(""))).alias(c)
        for c in raw.columns])


def number(c: Column) -> Column:
    """Double of a text with thousands separators; NULL unless a finite number."""
    d = F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def lossless_number(c: Column) -> Column:
    """Text of a value kept exactly: integral without fraction, other numbers as
    numbers, anything else as given."""
    d = number(c)
    whole = d.try_cast("bigint")
    return F.when(F.trim(c) == "", "").when(d.isNull(), F.trim(c)).when(
        whole.cast("double") == d, whole.cast("string")).otherwise(d.cast("string"))


def _whole(c: Column) -> Column:
    d = F.trim(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d).try_cast("bigint")


def time_2018(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz")


def session_of(source_file: Column) -> Column:
    """Which half of the day a capture file covers; NULL for unknown files."""
    f = F.lower(F.trim(source_file))
    return F.when(f.contains("portscan"), "friday-pm").when(f.contains("tuesday"), "tuesday-fullday")


def time_2017(c: Column, session: Column) -> Column:
    """Day-first 12-hour stamp without AM/PM, read by the file's session."""
    shape = r"^(\d{1,2})/(\d{1,2})/(\d{1,4})\s+(\d{1,2}):(\d{1,2})$"
    part = lambda i: F.regexp_extract(F.trim(c), shape, i).try_cast("int")
    hour = part(4)
    noon = F.when(hour == 12, 12)
    clock = F.when(session == "friday-pm", F.coalesce(noon, F.when(hour.between(1, 11), hour + 12))).when(
        session == "tuesday-fullday", F.coalesce(
            noon, F.when(hour.between(8, 11), hour), F.when(hour.between(1, 5), hour + 12)))
    return F.try_to_timestamp(
        F.format_string("%04d-%02d-%02d %02d:%02d:00", part(3), part(2), part(1), clock, part(5)),
        F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def _adapt(rows: DataFrame, *, ts: Column, port_name: str, sip: str, dip: str, source: str, version: str,
           dataset: str, namespace: str, session_ok: Column | None = None) -> DataFrame:
    have = set(rows.columns)
    cell = lambda n: (F.col(f"`{n}`") if n in have else F.col(f"`{ALIASES[n]}`")
                      if ALIASES.get(n) in have else F.lit(""))
    for column, out in ((sip, "_sip"), (dip, "_dip")):
        rows = with_address(rows, f"`{column}`", out) if column in have else rows.withColumn(
            out, F.lit(None).cast("string"))
    port_text = F.trim(cell(port_name))
    port = _whole(port_text)
    bad_port = (port_text != "") & ~nz(port.between(0, 65535), False)
    proto = F.trim(cell("Protocol"))
    names = F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv])
    size = lambda n: F.when(_whole(cell(n)) >= 0, _whole(cell(n)))
    identity = F.concat_ws("|", F.lit(source), F.lit(version), "source_file", F.col("source_row").cast("string"))
    label = normalize_label(cell("Label"))
    flow_cells = [(c, F.col(f"`{c}`")) for c in rows.columns
                  if c not in ("Label", "source_file", "source_row", "_sip", "_dip")]
    flow_cells += [(k, F.col(f"`{a}`")) for k, a in ALIASES.items() if a in have and k not in have]
    flow = F.create_map(*[x for n, c in flow_cells for x in (F.lit(n), lossless_number(c))])
    reject = F.when(F.lit(False) if session_ok is None else ~session_ok, "bad_session").when(
        ts.isNull(), "bad_timestamp").when(bad_port, "bad_port")
    none = F.lit(None).cast("string")
    empty = ("host", "user", "process_name", "parent_process", "command_line", "file_hash", "domain",
             "url", "status")
    raw = F.to_json(F.struct(
        F.lit(dataset).alias("dataset"), F.col("source_file"), F.lit(version).alias("adapter_version"),
        F.struct(F.trim(cell("Label")).alias("label"), F.lit(True).alias("evaluation")).alias("evaluation_only"),
        flow.alias("flow")))
    values = {
        "event_id": uuid5(namespace, identity), "timestamp": ts, "event_type": F.lit("network_connection"),
        "source": F.lit(source), "source_ip": F.col("_sip"), "destination_ip": F.col("_dip"),
        "destination_port": F.when(~bad_port, port).cast("int"),
        "protocol": F.coalesce(F.element_at(names, proto), F.nullif(proto, F.lit(""))),
        "bytes_sent": size("TotLen Fwd Pkts"), "bytes_received": size("TotLen Bwd Pkts"),
        "raw_event": raw, **{c: none for c in empty}}
    from palisade.schema import EVENT_COLUMNS
    return rows.select(
        *[values[n].alias(n) for n, _ in EVENT_COLUMNS], "source_file", "source_row",
        *[number(cell(n)).alias(out) for n, out in FLOW_NUMERICS], label.alias("label"),
        reject.alias("reject_code"))


def adapt_flow_2018(rows: DataFrame) -> DataFrame:
    """2018 flow rows -> events with numerics; `reject_code` marks unusable rows."""
    return _adapt(rows, ts=time_2018(F.col("Timestamp")), port_name="Dst Port", sip="Src IP", dip="Dst IP",
                  source=SOURCE_2018, version=VERSION_2018, dataset=DATASET_2018, namespace=NAMESPACE_2018)


def adapt_flow_2017(rows: DataFrame) -> DataFrame:
    """2017 flow rows, whose clock depends on the capture file."""
    session = session_of(F.col("source_file"))
    return _adapt(rows, ts=time_2017(F.col("Timestamp"), session), port_name="Destination Port",
                  sip="Source IP", dip="Destination IP", source=SOURCE_2017, version=VERSION_2017,
                  dataset=DATASET_2017, namespace=NAMESPACE_2017, session_ok=session.isNotNull())


def flow_view(events: DataFrame) -> DataFrame:
    """What flow rules may see: endpoints, counts and numerics, never labels.

    Numerics come from adapter columns, or from the payload's flow block when the
    events carry only JSON.
    """
    from palisade.functions.core import micros
    from palisade.schema import FLOW_FIELDS
    rows = events.where(F.col("event_type") == "network_connection").withColumn("ts_us", micros("timestamp"))
    if FLOW_NUMERICS[0][1] not in events.columns:
        block = F.from_json(F.get_json_object("raw_event", "$.flow"), "map<string,string>")
        rows = rows.withColumn("_flow", block).withColumns(
            {out: number(F.element_at("_flow", F.lit(n))) for n, out in FLOW_NUMERICS})
    return rows.select(*FLOW_FIELDS, *[c for _, c in FLOW_NUMERICS])


def dataset_profile(adapted: DataFrame) -> DataFrame:
    """One row of counts over an adapted file: rows, rejects, span, missing entities."""
    ok = F.col("reject_code").isNull()
    missing = lambda c: F.count_if(ok & F.col(c).isNull()).alias(f"missing_{c}")
    return adapted.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(ok).alias("normalized"),
        F.count_if(~ok).alias("rejected"), F.min(F.when(ok, F.col("timestamp"))).alias("first_seen"),
        F.max(F.when(ok, F.col("timestamp"))).alias("last_seen"),
        *[missing(c) for c in ("source_ip", "destination_ip", "user", "host")],
        F.count_distinct(F.when(ok, F.col("event_id"))).alias("distinct_ids"))


def value_counts(adapted: DataFrame, label: Column | None = None) -> DataFrame:
    """(kind, value, rows): usable rows by event type and by the label as it was read, or as `label` says,
    rejected ones by reason.

    Each row is counted under its kinds by one partial aggregation; an empty label reads `<empty>`.
    """
    ok = F.col("reject_code").isNull()
    label = F.get_json_object("raw_event", "$.evaluation_only.label") if label is None else label
    kinds = F.filter(F.array(
        F.struct(F.lit("event_type").alias("kind"), F.when(ok, F.coalesce("event_type", F.lit("?"))).alias("value")),
        F.struct(F.lit("label").alias("kind"), F.when(ok, F.coalesce(F.nullif(label, F.lit("")), F.lit("<empty>"))).alias("value")),
        F.struct(F.lit("reject_code").alias("kind"), F.col("reject_code").alias("value"))), lambda k: k["value"].isNotNull())
    return adapted.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("rows"))


def reject_reasons(adapted: DataFrame) -> DataFrame:
    return adapted.where(F.col("reject_code").isNotNull()).groupBy("reject_code").agg(
        F.count(F.lit(1)).alias("rows"))
