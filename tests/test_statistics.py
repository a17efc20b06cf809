"""Exact quantiles of groups of any size; the forest's model on disk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.config import HOUR, UebaConfig
from palisade.functions import quantiles, skew
from palisade.operators import ueba

INF = float("inf")


def odd_values() -> dict:
    rng = np.random.default_rng(1)
    return {
        "wide": rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400), "two": np.repeat([1.5, -2.25], 60),
        "one": np.array([5.0]), "ends": np.array([5e-324, -5e-324, 0.0, -0.0, INF, -INF, 1e308] * 5),
        None: rng.integers(-50, 50, 300).astype(float), "close": 1.0 + np.arange(60) * 2.3e-16}


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_are_exact(spark, monkeypatch, share):
    """Small buckets force all rounds of refining."""
    monkeypatch.setattr(quantiles, "SMALL", 8)
    groups = odd_values()
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("wide", None), ("nothing", None)]
    random.Random(1).shuffle(rows)
    got = {r.k: r for r in quantiles.quantile(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", share).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        place = (len(own) - 1) * share
        low = int(np.floor(place))
        ordered = np.sort(own)
        assert got[k].n == len(own) and got[k].lower == ordered[low]
        if place > low:
            assert got[k].upper == ordered[low + 1]
        if np.isfinite(ordered[low:low + 2]).all():
            assert got[k]["quantile"] == np.quantile(own, share) or place == low or abs(got[k]["quantile"] / np.quantile(own, share) - 1) < 1e-12


def test_quantile_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 8)
    rows = spark.range(1001).select((F.col("id") % 77).cast("double").alias("v"))
    assert quantiles.quantile(rows, [], "v", 0.5).first()["quantile"] == float(np.median(np.arange(1001) % 77))
    assert quantiles.quantile(rows.where("false"), [], "v", 0.5).count() == 0
    plan = quantiles.quantile(rows, [], "v", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median" not in plan


def test_hot_groups_are_broadcast(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, None).otherwise(F.col("id") % 7).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.join_groups(rows, groups, ["k"], "n", 3000)
    assert got.count() == 3000 and got.where("k is null").first()["n"] == 2500


def observations(spark):
    names = ueba.UEBA_FEATURES
    rows = [(f"u{i}", 0, *[float((i * 7 + j) % 5) for j in range(len(names))]) for i in range(300)]
    rows += [("odd", HOUR, *[50.0] * len(names))]
    return spark.createDataFrame(rows, "entity_key string, window_us bigint, " + ", ".join(f"{n} double" for n in names)).withColumn(
        "window_start", F.lit("x"))


def test_forest_is_sound(spark):
    """Leaves of each tree hold its sample; children's rows add up; cuts part their node's rows."""
    nodes = ueba.fit_forest(observations(spark), UebaConfig(trees=12, tree_rows=64)).toPandas()
    assert (nodes[nodes["feature"] < 0].groupby("tree")["n"].sum() == 64).all() and nodes["tree"].nunique() == 12
    n = nodes.set_index(["tree", "node"])["n"]
    for r in nodes[nodes["feature"] >= 0].itertuples():
        assert n[r.tree, 2 * r.node] + n[r.tree, 2 * r.node + 1] == r.n
    assert nodes["node"].max() < 128


def test_model_survives_the_disk(spark, tmp_path):
    obs = observations(spark)
    model = ueba.fit(obs, UebaConfig(trees=20, tree_rows=64))
    ueba.save_model(spark, model, str(tmp_path / "model"))
    again = ueba.load_model(spark, str(tmp_path / "model"))
    assert again.config == model.config and again.bounds == model.bounds
    rows = lambda m: sorted(map(tuple, ueba.score(obs, m).select("entity_key", "anomaly_score", "anomaly_flag").collect()))
    assert rows(model) == rows(again)
    assert ueba.fit(obs.where("false"), UebaConfig(trees=3)).bounds["threshold"] == 0.5


def test_flags_follow_the_quantile(spark):
    """About the configured share of training rows is flagged, by the raw scores' own quantile."""
    obs = observations(spark)
    model = ueba.fit(obs, UebaConfig(trees=20))
    raw = ueba.depths(obs, model.forest, model.config).select(ueba._raw(F.col("depth"), model.config).alias("raw")).toPandas()["raw"]
    assert model.bounds["threshold"] == pytest.approx(np.quantile(raw, 0.95), rel=1e-12)
    flagged = ueba.score(obs, model).where("anomaly_flag").count()
    assert flagged == int((raw >= np.quantile(raw, 0.95)).sum())
