"""Observables in events, their normal form, and catalog look-up."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.core import blank, micros, nz

# Shapes of observables.
OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
LABEL = r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
DOMAIN = rf"^{LABEL}(\.{LABEL})+$"
HEX_DIGEST = r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
HTTP_URL = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@\[\]]+)(?::(\d*))?([/?#].*)?$"
SOURCES = (("source_ip", "ip"), ("destination_ip", "ip"), ("domain", "domain"), ("url", "url"),
           ("file_hash", "file_hash"))


@F.pandas_udf(T.StringType())
def _ipv6(values: pd.Series) -> pd.Series:
    def one(v):
        try:
            return str(ipaddress.IPv6Address(v)) if v is not None else None
        except ValueError:
            return None
    return values.map(one)


@F.pandas_udf(T.StringType())
def _idna(values: pd.Series) -> pd.Series:
    def one(v):
        try:
            return v.encode("idna").decode("ascii") if v is not None else None
        except (UnicodeError, ValueError):
            return None
    return values.map(one)


def with_address(df: DataFrame, column: str, out: str) -> DataFrame:
    """Canonical address text; rows without a colon never reach Python."""
    c = F.trim(F.col(column))
    return df.withColumn(out, F.when(c.rlike(IPV4), c).when(c.contains(":"), _ipv6(
        F.when(c.contains(":"), c))))


def domain(c: Column, idna: bool = True) -> Column:
    d = F.lower(F.rtrim(F.trim(c), F.lit(".")))
    if idna:
        d = F.when(d.rlike(r"^[\x00-\x7f]*$"), d).otherwise(
            _idna(F.when(~d.rlike(r"^[\x00-\x7f]*$"), d)))
    return F.when((F.length(d) <= 253) & d.rlike(DOMAIN), d)


def url(c: Column, idna: bool = True) -> Column:
    """http(s) URL with a normal host; path, query and fragment as given."""
    part = lambda i: F.regexp_extract(F.trim(c), HTTP_URL, i)
    port = F.when(part(3) != "", F.concat(F.lit(":"), part(3).try_cast("int").cast("string"))).otherwise("")
    return F.when(F.trim(c).rlike(HTTP_URL), F.concat(
        F.lower(part(1)), F.lit("://"), domain(part(2), idna), port, part(4)))


def file_hash(c: Column) -> Column:
    h = F.lower(F.trim(c))
    return F.when(h.rlike(HEX_DIGEST), h)


def normalize_observable(df: DataFrame, kind: str = "kind", value: str = "value", idna=True) -> DataFrame:
    """Add `type` and `normalized_value`; both NULL where the value is malformed."""
    k = F.lower(F.trim(kind))
    rows = with_address(df, value, "_addr")
    is_ip = k.isin("ip", "ipv4", "ipv6")
    family = F.when(F.col("_addr").contains(":"), "ipv6").when(F.col("_addr").isNotNull(), "ipv4")
    family = F.when((k == "ip") | (k == family), family)
    v = F.col(value)
    normal = (F.when(is_ip & family.isNotNull(), F.col("_addr")).when(k == "domain", domain(v, idna))
              .when(k == "url", url(v, idna)).when(k.isin("file_hash", "hash"), file_hash(v)))
    kind_out = F.when(is_ip, family).when(k == "hash", "file_hash").otherwise(k)
    rows = rows.withColumn("normalized_value", normal)
    return rows.withColumn("type", F.when(F.col("normalized_value").isNotNull(), kind_out)).drop("_addr")


def observed(events: DataFrame, idna: bool = True) -> DataFrame:
    """One row per event column holding a well-formed observable."""
    cells = F.array(*[F.struct(F.lit(c).alias("source"), F.lit(k).alias("kind"), F.col(c).alias("value"))
                      for c, k in SOURCES])
    rows = events.select("event_id", micros("timestamp").alias("ts_us"), F.explode(
        F.filter(cells, lambda x: ~blank(x["value"]))).alias("o")).select("event_id", "ts_us", "o.*")
    return normalize_observable(rows, idna=idna).where(F.col("normalized_value").isNotNull())


def observable_events(events: DataFrame, idna: bool = True) -> DataFrame:
    """(type, normalized_value, source, event_id): every event of every observable, as rows."""
    return observed(events, idna).select("type", "normalized_value", "source", "event_id").distinct()


def extract_observables(events: DataFrame, idna: bool = True, refs: int | None = None) -> DataFrame:
    """Distinct observables with span and event count; `observable_events` has their events.

    With `refs`, the first that many event ids are added as `event_ids`.
    """
    once = observed(events, idna).groupBy("type", "normalized_value", "source", "event_id").agg(
        F.min(F.struct("ts_us", F.trim("value").alias("value"))).alias("lo"), F.max("ts_us").alias("hi"))
    key = ["type", "normalized_value", "source"]
    totals = once.groupBy(*key).agg(
        F.min(F.struct("lo.ts_us", "event_id", "lo.value")).alias("first"), F.max("hi").alias("last_us"),
        F.count(F.lit(1)).alias("event_count"))
    found = totals.select(*key, F.col("first.value").alias("value"), F.col("first.ts_us").alias("first_us"),
                          "last_us", "event_count")
    if refs is None:
        return found
    from palisade.operators.flow import top
    return found.join(top(once, key, [F.col("event_id")], refs).groupBy(*key).agg(
        F.array_sort(F.collect_list("event_id")).alias("event_ids")), key)


def intel_lookup(observables: DataFrame, catalog: DataFrame, provider: str = "local-test") -> DataFrame:
    """Catalog verdict per observable, 'unknown' with confidence 0 when absent."""
    entries = catalog.select(
        "type", F.col("value").alias("normalized_value"), "classification",
        F.col("confidence").alias("intel_confidence"), "categories", "reference",
        F.col("first_seen").alias("intel_first_seen"))
    return observables.join(entries, ["type", "normalized_value"], "left").withColumns({
        "provider": F.lit(provider), "classification": nz("classification", "unknown"),
        "intel_confidence": nz("intel_confidence", 0.0),
        "categories": F.coalesce("categories", F.array(F.lit("not-in-fixture")))})


def intel_trace(incidents: DataFrame, dets: DataFrame, events: DataFrame, catalog: DataFrame,
                sample: int | None = None, idna: bool = True) -> DataFrame:
    """Per incident, the observables of its evidence events (the first `sample`, if given), their
    verdict, and all member detections citing the same events."""
    from palisade.operators.investigate import evidence_sample, first_of
    rows = observed(evidence_sample(incidents, events, sample), idna).select(
        "event_id", "type", "normalized_value", "source").distinct()
    held = incidents.select("incident_id", F.explode(first_of("evidence_event_ids", sample)).alias("event_id"))
    key = ["incident_id", "type", "normalized_value", "source"]
    found = held.join(rows, "event_id")
    cited = incidents.select("incident_id", F.explode("detection_ids").alias("detection_id")).join(
        dets.select("detection_id", F.explode("evidence_event_ids").alias("event_id")), "detection_id")
    # one pass: both the count and the citing detections come from the same rows, so values are normalised once
    told = found.distinct().join(cited, ["incident_id", "event_id"], "left").groupBy(*key).agg(
        F.count_distinct("event_id").alias("event_count"), F.array_sort(F.collect_set("detection_id")).alias("ids"))
    return intel_lookup(told.withColumn("detection_ids", F.when(F.size("ids") > 0, F.col("ids"))).drop("ids"), catalog)
