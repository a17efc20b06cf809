"""Behaviour features per user and hour, an isolation forest over them, and its
attachment to incidents."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.config import HOUR, UEBA_FEATURES, UebaConfig
from palisade.functions.core import blank, from_micros, nz, two_decimals
from palisade.functions.quantiles import order_statistics, quantile
from palisade.functions.state import pin
from palisade.operators.endpoint import FAILED, SUCCEEDED


def _rows(events: DataFrame, cfg: UebaConfig) -> DataFrame:
    width = cfg.window_hours * HOUR
    # of rows that repeat an id the earliest counts; blank users go only then
    first = W.partitionBy("event_id").orderBy("ts_us", F.xxhash64("user", "source_ip", "event_type"))
    once = events.where(~blank("event_id")).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return once.where(~blank("user")).withColumn(
        "window_us", F.floor(F.col("ts_us") / F.lit(width)) * width)


def new_ips(rows: DataFrame) -> DataFrame:
    """Addresses first used by the user in each window."""
    first = rows.where(~blank("source_ip")).groupBy("user", "source_ip").agg(
        F.min("window_us").alias("window_us"))
    return first.groupBy("user", "window_us").agg(F.count(F.lit(1)).alias("new_ips"))


def features(events: DataFrame, cfg: UebaConfig = UebaConfig()) -> DataFrame:
    """(user, window) -> 12 features. Input has `ts_us`."""
    rows = _rows(events, cfg)
    auth = F.col("event_type") == "authentication"
    status, hour = F.lower(nz("status", "")), F.hour(from_micros("ts_us"))
    target = F.when(~blank("destination_ip"), F.col("destination_ip")).when(
        ~blank("domain"), F.col("domain"))
    off_hours = (hour < cfg.day_start_hour) | (hour >= cfg.day_end_hour)
    counts = rows.groupBy("user", "window_us").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(auth).alias("auth_event_count"),
        F.count_if(auth & status.isin(*FAILED)).alias("failed_auth_count"),
        F.count_if(auth & status.isin(*SUCCEEDED)).alias("successful_auth_count"),
        F.count_distinct(F.when(~blank("source_ip"), F.col("source_ip")))
        .alias("unique_source_ip_count"),
        F.count_distinct(target).alias("unique_destination_count"),
        F.count_if(F.col("event_type") == "dns_query").alias("dns_event_count"),
        F.log1p(F.greatest(F.sum(nz("bytes_sent")), F.lit(0))).alias("outbound_bytes_log1p"),
        F.count_if(F.col("event_type") == "process_creation").alias("process_event_count"),
        F.count_if(off_hours).alias("unusual_hour_event_count"),
    )
    counts = counts.withColumn("failed_auth_ratio", F.when(
        F.col("auth_event_count") > 0,
        F.col("failed_auth_count") / F.col("auth_event_count")).otherwise(0.0))
    joined = counts.join(new_ips(rows), ["user", "window_us"], "left").withColumn(
        "new_source_ip_count", nz("new_ips"))
    return joined.select(
        F.col("user").alias("entity_key"), "window_us", from_micros("window_us").alias("window_start"),
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in UEBA_FEATURES])


def observation_members(events: DataFrame, cfg: UebaConfig = UebaConfig()) -> DataFrame:
    """(entity_key, window_us, event_id): the events behind each observation, as rows
    because one user's hour can hold any number of them."""
    return _rows(events, cfg).select(F.col("user").alias("entity_key"), "window_us", "event_id")


def baseline(obs: DataFrame, cfg: UebaConfig = UebaConfig()) -> DataFrame:
    """How much history each observation has. One row per user and hour, so the
    per-user window stays small."""
    w = W.partitionBy("entity_key").orderBy("window_us").rowsBetween(W.unboundedPreceding, -1)
    seen, events = F.col("history_windows"), F.col("history_events")
    return obs.select(
        "entity_key", "window_us", F.count(F.lit(1)).over(w).alias("history_windows"),
        nz(F.sum("event_count").over(w), 0.0).cast("bigint").alias("history_events"),
    ).withColumn("baseline_status", F.when((seen == 0) & (events == 0), "COLD_START").when(
        (seen < cfg.min_history_windows) | (events < cfg.min_history_events),
        "INSUFFICIENT_HISTORY").otherwise("READY"))


def train_split(events: DataFrame, cut_us: int, normal: Column) -> DataFrame:
    """Normal rows before the cut."""
    return events.where((F.col("ts_us") < cut_us) & normal)


#: Path lengths are whole numbers of this part of a step, so that their sums are exact in any order.
PATH_UNIT = 1 << 20
_EULER = 0.5772156649015329
#: A prime below 2**31: draws are products of two numbers below it.
_PRIME = 2_147_483_647

FOREST_DDL = "tree int, node bigint, feature int, cut double, n bigint, path bigint"


class Model(NamedTuple):
    forest: pd.DataFrame  # one row a node
    bounds: dict  # least and greatest raw score of the training rows, the flagging quantile
    config: UebaConfig


def _hex(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def _path(depth: int, n: Column) -> Column:
    """`depth` and the mean unsuccessful search of a binary tree over n rows, in units."""
    search = F.when(n > 2, 2 * (F.ln(n - 1) + _EULER) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(0.0)
    return F.round((search + depth) * PATH_UNIT).cast("bigint")


def _mean_search(n: int) -> float:
    return 2 * (float(np.log(n - 1)) + _EULER) - 2 * (n - 1) / n if n > 2 else 1.0


def tree_samples(obs: DataFrame, cfg: UebaConfig) -> DataFrame:
    """(tree, x, ...): for each tree the `tree_rows` observations with the least draws.

    An observation is hashed once; its draw in each tree is a linear function of two hashes modulo a
    prime. Draws far beyond the sample are left out before rows are multiplied, so a tree ranks about
    four times its sample, whatever the input; small inputs are not thinned.
    """
    total = obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    h = F.md5(F.concat_ws("|", "entity_key", F.col("window_us").cast("string"), F.lit(str(cfg.seed))))
    rows = obs.select("entity_key", "window_us", F.array(*[F.col(c).cast("double") for c in UEBA_FEATURES]).alias("x"),
                      (_hex(h, 1, 8) % _PRIME).alias("_a"), (_hex(h, 9, 8) % _PRIME).alias("_b"), total.alias("_n"))
    trees = F.filter(F.sequence(F.lit(0), F.lit(cfg.trees - 1)), lambda t: ((F.col("_a") * (t + 1) + F.col("_b")) % _PRIME)
                     / float(_PRIME) * F.col("_n") <= 4.0 * cfg.tree_rows)
    drawn = rows.withColumn("tree", F.explode(trees)).withColumn(
        "_draw", (F.col("_a") * (F.col("tree") + 1) + F.col("_b")) % _PRIME)
    w = W.partitionBy("tree").orderBy("_draw", "entity_key", "window_us")
    return drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cfg.tree_rows).select("tree", "x")


def fit_forest(obs: DataFrame, cfg: UebaConfig = UebaConfig()) -> DataFrame:
    """Forest as a table of nodes (tree, node, feature, cut, n, path), grown level by level.

    Node 1 is the root, 2k and 2k + 1 are the children of k. At each level every node's rows give
    the range of each feature; a hash of (seed, tree, node) picks one of those that vary and a cut in
    its range. A node of one row, of equal rows or at the last level is a leaf: feature -1 and the
    path length of what ends there. A tree has at most tree_rows rows and is grown in one task.

    Scaling the features would only move cut points, not the splits, so raw features are used.
    """
    limit = int(np.ceil(np.log2(cfg.tree_rows)))
    k = range(len(UEBA_FEATURES))
    rows = tree_samples(obs, cfg).repartition("tree").select(
        "tree", "x", F.lit(1).cast("bigint").alias("node"), F.lit(False).alias("done"),
        F.array().cast("array<struct<node:bigint,feature:int,cut:double,n:bigint,path:bigint>>").alias("way"))
    for depth in range(limit + 1):
        w = W.partitionBy("tree", "node")
        rows = rows.select(
            "*", F.count(F.lit(1)).over(w).alias("n"), F.array(*[F.min(F.col("x")[j]).over(w) for j in k]).alias("lo"),
            F.array(*[F.max(F.col("x")[j]).over(w) for j in k]).alias("hi"))
        varying = F.filter(F.sequence(F.lit(0), F.lit(len(k) - 1)), lambda j: F.get("hi", j) > F.get("lo", j))
        h = F.md5(F.concat_ws("|", F.lit(str(cfg.seed)), F.col("tree").cast("string"), F.col("node").cast("string")))
        rows = rows.withColumns({"vary": varying, "h": h})
        leaf = (F.size("vary") == 0) if depth < limit else F.lit(True)
        rows = rows.withColumn("f", F.when(leaf, -1).otherwise(
            F.get("vary", (_hex(F.col("h"), 1, 8) % F.greatest(F.size("vary"), F.lit(1))).cast("int"))))
        low, high = F.get("lo", F.col("f")), F.get("hi", F.col("f"))
        share = _hex(F.col("h"), 9, 13) / float(1 << 52)
        rows = rows.withColumn("cut", F.when(F.col("f") >= 0, low + share * (high - low)).otherwise(0.0))
        step = F.struct("node", F.col("f").alias("feature"), "cut", "n", F.when(F.col("f") < 0, _path(depth, F.col("n"))).otherwise(
            F.lit(0)).alias("path"))
        right = (F.get("x", F.col("f")) > F.col("cut")).cast("bigint")
        rows = rows.select(
            "tree", "x", F.when(F.col("done") | (F.col("f") < 0), F.col("node")).otherwise(F.col("node") * 2 + right).alias("node"),
            (F.col("done") | (F.col("f") < 0)).alias("done"),
            F.when(F.col("done"), F.col("way")).otherwise(F.concat("way", F.array(step))).alias("way"))
    return rows.select("tree", F.explode("way").alias("s")).select("tree", "s.*").distinct()


def depths(obs: DataFrame, forest: pd.DataFrame, cfg: UebaConfig = UebaConfig()) -> DataFrame:
    """Add `depth`, the sum of a row's path lengths over all trees, in units: least is most isolated.

    The forest has at most trees x 2 ** (levels + 1) nodes, a size fixed by the configuration.
    """
    size = 2 << int(np.ceil(np.log2(cfg.tree_rows)))
    feature = np.full((cfg.trees, size), -1, np.int64)
    cut, path = np.zeros((cfg.trees, size)), np.zeros((cfg.trees, size), np.int64)
    at = forest["tree"].to_numpy(), forest["node"].to_numpy()
    feature[at], cut[at], path[at] = forest["feature"], forest["cut"], forest["path"]
    shared = obs.sparkSession.sparkContext.broadcast((feature, cut, path))

    @F.pandas_udf(T.LongType())
    def total(f: pd.DataFrame) -> pd.Series:
        x, out = f.to_numpy(float), np.zeros(len(f), np.int64)
        for feature, cut, path in zip(*shared.value, strict=True):
            node = np.ones(len(x), int)
            while len(inner := np.flatnonzero(feature[node] >= 0)):
                own = node[inner]
                node[inner] = 2 * own + (x[inner, feature[own]] > cut[own])
            out += path[node]
        return pd.Series(out)

    return obs.withColumn("depth", total(F.struct(*[F.col(c).cast("double") for c in UEBA_FEATURES])))


def _raw(depth: Column, cfg: UebaConfig) -> Column:
    """1 is isolated at once, 0.5 is average."""
    return F.pow(F.lit(2.0), -(depth / float(cfg.trees * PATH_UNIT)) / _mean_search(cfg.tree_rows))


def fit(obs: DataFrame, cfg: UebaConfig = UebaConfig()) -> Model:
    """Forest and train bounds: least and greatest raw score, and the exact upper quantile that flags."""
    n = obs.count()
    use = replace(cfg, tree_rows=max(2, min(cfg.tree_rows, n)))
    forest = fit_forest(obs, use).toPandas()
    # the order of raw scores is that of whole numbers, so the quantile is exact
    deep = pin(depths(obs, forest, use).select((-F.col("depth")).alias("height")))
    ends = deep.agg(F.min("height").alias("lo"), F.max("height").alias("hi")).first()
    found = quantile(deep, [], "height", 1.0 - cfg.contamination).first()
    deep.unpersist()
    if found is None:
        return Model(forest, {"lo": 0.0, "hi": 1.0, "threshold": 0.5, "least_depth": -1}, use)
    raw = lambda height: 2.0 ** (height / (use.trees * PATH_UNIT) / _mean_search(use.tree_rows))
    lower, upper, part = raw(found["lower"]), raw(found["upper"] if found["upper"] is not None else found["lower"]), found["fraction"]
    return Model(forest, {
        "lo": raw(ends["lo"]), "hi": raw(ends["hi"]), "threshold": lower + part * (upper - lower) if part > 0 else lower,
        "least_depth": -int(found["upper"] if part > 0 else found["lower"])}, use)


def save_model(spark: SparkSession, model: Model, folder: str) -> None:
    """The forest, its bounds and configuration as two Parquet tables."""
    spark.createDataFrame(model.forest, FOREST_DDL).write.parquet(f"{folder}/forest")
    facts = {**model.bounds, **asdict(model.config)}
    spark.createDataFrame([(k, json.dumps(v)) for k, v in facts.items()], "name string, value string").coalesce(1).write.parquet(
        f"{folder}/facts")


def load_model(spark: SparkSession, folder: str) -> Model:
    facts = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{folder}/facts").collect()}
    config = UebaConfig(**{f.name: facts[f.name] for f in fields(UebaConfig)})
    bounds = {k: facts[k] for k in ("lo", "hi", "threshold", "least_depth")}
    return Model(spark.read.parquet(f"{folder}/forest").toPandas(), bounds, config)


def score(obs: DataFrame, model: Model, cfg: UebaConfig = UebaConfig()) -> DataFrame:
    """Anomaly score in [0, 1] by training bounds, flag, history and context."""
    bounds, use = model.bounds, model.config
    span = max(bounds["hi"] - bounds["lo"], 1e-9)
    scaled = F.greatest(F.least((_raw(F.col("depth"), use) - bounds["lo"]) / span, F.lit(1.0)), F.lit(0.0))
    context = F.map_filter(
        F.create_map(*[x for c in UEBA_FEATURES for x in (F.lit(c), F.col(c))]), lambda k, v: v != 0)
    return depths(obs, model.forest, use).join(
        baseline(obs, cfg), ["entity_key", "window_us"]).select(
        "entity_key", "window_us", "window_start", F.round(scaled, 4).alias("anomaly_score"),
        (F.col("depth") <= bounds["least_depth"]).alias("anomaly_flag"),
        F.lit(cfg.model_version).alias("model_version"),
        F.lit(cfg.feature_version).alias("feature_version"), "baseline_status", "history_windows",
        context.alias("feature_context"), F.col("event_count").cast("bigint").alias("event_count"))


def attach(incidents: DataFrame, scored: DataFrame | None, members: DataFrame | None = None) -> DataFrame:
    """Incidents with behavioural evidence: windows of the incident's single user that
    start by its last event and contain some of its evidence."""
    from palisade.functions.core import micros
    user = F.col("metadata.user")
    if scored is None:
        why = F.lit("UEBA model unavailable: no behavioral anomaly evidence attached. "
                    "Deterministic risk is unaffected.")
        return incidents.withColumn("ueba", F.struct(
            F.lit(False).alias("available"), F.lit(None).cast("double").alias("anomaly_score"),
            F.lit(None).cast("boolean").alias("anomaly_flag"), why.alias("reason"),
            F.array().cast("array<string>").alias("observations")))
    cited = incidents.select(
        "incident_id", user.alias("entity_key"), micros("last_seen").alias("last_us"),
        F.explode("evidence_event_ids").alias("event_id")).where(~blank("entity_key"))
    met = cited.join(members, ["entity_key", "event_id"]).where(
        F.col("window_us") <= F.col("last_us")).groupBy("incident_id", "entity_key", "window_us").agg(
        F.array_sort(F.collect_list("event_id")).alias("event_overlap"))
    facts = scored.drop("event_count", "window_start")
    found = met.join(facts, ["entity_key", "window_us"]).groupBy("incident_id").agg(
        F.max("anomaly_score").alias("score"), F.max("anomaly_flag").alias("flag"),
        F.count(F.lit(1)).alias("windows"), F.count_if("anomaly_flag").alias("flagged"),
        F.max_by("window_us", F.struct("anomaly_score", -F.col("window_us"))).alias("peak_us"),
        F.array_sort(F.collect_list(F.struct(
            "window_us", "entity_key", "anomaly_score", "anomaly_flag", "baseline_status",
            "feature_context", "event_overlap")), lambda a, b: F.when(
                a["window_us"] < b["window_us"], -1).when(a["window_us"] > b["window_us"], 1)
            .otherwise(0)).alias("observations"))
    hit = F.col("score").isNotNull()
    reason = (
        F.when(hit, F.format_string(
            "UEBA behavioral anomaly evidence for user '%s': %d overlapping hourly observation(s), "
            "%d flagged anomalous, peak score %s at %s. Behavior is %s relative to the learned "
            "baseline; this is analyst context, not proof of compromise.",
            user, F.col("windows"), F.col("flagged"), two_decimals(F.col("score"), 4),
            F.date_format(from_micros("peak_us"), "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(F.col("flag"), "behaviorally anomalous").otherwise("not anomalous")))
        .when(blank(user), F.lit(
            "UEBA unavailable: incident has no single attributed user, so no behavioral baseline "
            "applies. Deterministic risk is unaffected."))
        .otherwise(F.lit(
            "UEBA found no behavioral observations overlapping this incident's evidence within its "
            "time window. Deterministic risk is unaffected."))
    )
    return incidents.join(found, "incident_id", "left").withColumn("ueba", F.struct(
        hit.alias("available"), F.col("score").alias("anomaly_score"),
        F.col("flag").alias("anomaly_flag"), reason.alias("reason"), F.col("observations"))).drop(
        "score", "flag", "windows", "flagged", "peak_us", "observations")


def scenario_report(
    scored: DataFrame, members: DataFrame, events: DataFrame, scenario: Column
) -> DataFrame:
    """Mean score, windows and flags per dominant scenario of the window, and of all windows (scenario NULL)
    with rate, extremes and the upper median."""
    kinds = members.join(
        events.select("event_id", scenario.alias("scenario")), "event_id")
    n = kinds.groupBy("entity_key", "window_us", "scenario").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("entity_key", "window_us").agg(
        F.max_by("scenario", F.struct("n", "scenario")).alias("scenario"))
    facts = [F.avg("anomaly_score").alias("mean_score"), F.count(F.lit(1)).alias("windows"),
             F.count_if("anomaly_flag").alias("flagged"), F.min("anomaly_score").alias("min_score"),
             F.max("anomaly_score").alias("max_score")]
    per = scored.join(top, ["entity_key", "window_us"]).groupBy("scenario").agg(*facts).withColumn(
        "median_score", F.lit(None).cast("double"))
    middle = order_statistics(scored, [], "anomaly_score", F.floor(F.col("n") / 2)).select("lower")
    whole = scored.agg(*facts).where("windows > 0").select(
        F.lit(None).cast("string").alias("scenario"), "*", middle.scalar().alias("median_score"))
    return per.unionByName(whole).withColumn("flag_rate", F.col("flagged") / F.col("windows"))
