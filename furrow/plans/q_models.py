"""Queries that fit models; their splits and thresholds have oracles, their scores can't have."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import indices as X
from furrow.functions.scalars import r6
from furrow.operators import models as M
from furrow.operators import series as S
from furrow.plans.registry import query
from furrow.session import scratch

_FEATURES = ["ndvi__p10", "ndvi__p90", "ndvi__amp", "cfi__p90", "cfi__amp", "ndvi_190", "ndvi_210"]


def features(t):
    """Features of every trial with a three-group label that they explain in part."""
    f = S.feature_table(t.ts, {"ndvi": X.ndvi(), "cfi": X.cfi()}).select("trial_id", *_FEATURES)
    label = F.when(F.col("cfi__amp") > 0.12, 0).when(F.col("ndvi__amp") > 0.5, 1).otherwise(2)
    noisy = F.when(F.col("trial_id") % 11 == 0, 2).otherwise(F.coalesce(label, F.lit(2)))
    return f.join(t.trial.select("trial_id", "site_id", "yr"), "trial_id").withColumn("label", noisy.cast("double"))


def _fit(t, pipeline):
    train, test = M.temporal_split(M.balanced_weights(features(t), "label"), "yr", 1999)
    return pipeline.fit(train).transform(test).groupBy("label", "prediction").agg(F.count("*").alias("n"))


query("ML1", "boosted_classifier")(lambda t: _fit(t, M.boosted(_FEATURES, 5)))
query("ML2", "forest_classifier")(lambda t: _fit(t, M.forest(_FEATURES, 20)))
query("ML2", "logistic_classifier")(lambda t: _fit(t, M.logistic(_FEATURES)))
query("ML3", "selected_features_classifier")(lambda t: _fit(t, M.selected_forest(_FEATURES, 4)))

query("ML4 S32", "yield_regression")(lambda t: _yield(t))


def _yield(t):
    rows = features(t).withColumn("y", 1.0 + 3 * F.coalesce("ndvi__p90", F.lit(0.5)) + (F.col("site_id") % 10) / 20.0)
    model, factor = M.yield_model(rows, _FEATURES, "y", 5)
    model = M.save(model, scratch(t.spark, "model"))
    return M.with_yield(rows.drop("features"), model, factor, F.when(F.col("label") == 1, "Cereal").otherwise("Other"), "Cereal").select("trial_id", r6("yield_tha").alias("yield_tha"), r6("yield_tha_calibrated").alias("yield_tha_calibrated"))


query("ML5", "baseline_yield")(lambda t: _baseline(t))


def _baseline(t):
    rows = t.mapped.withColumn("state", (F.col("region") % 5).cast("string")).withColumn("year", F.col("yr").cast("string"))
    return M.baseline_yield(rows, ["year", "state"], "ha").transform(rows).select("region", "yr", "cls", r6("prediction").alias("prediction"))


query("ML6", "group_folds", """
  with s as (select site_id, count(*) as n from fx_trial group by 1), o as (select site_id, row_number() over (order by n desc, site_id)-1 as o from s)
  select trial_id, cast(case when (o//5)%2=0 then o%5 else 4-o%5 end as integer) as fold, yr<=1998 as train from fx_trial join o using (site_id)
""")(lambda t: M.group_folds(t.trial, "site_id", 5).select("trial_id", "fold", (F.col("yr") <= 1998).alias("train")))

query("ML6", "out_of_fold_predictions")(lambda t: M.out_of_fold(M.group_folds(M.balanced_weights(features(t), "label"), "site_id", 3), M.forest(_FEATURES, 10), 3).select("trial_id", "fold", "label", "prediction"))

query("ML7", "grid_search")(lambda t: _search(t))


def _search(t):
    rows = M.group_folds(M.balanced_weights(features(t), "label"), "site_id", 3)
    found = M.grid_search(rows, _FEATURES, {"numTrees": [5, 15], "maxDepth": [3, 5]})
    return t.spark.createDataFrame([(i, float(m)) for i, m in enumerate(found.avgMetrics)], "setting int, f1 double").withColumn("f1", r6("f1"))


query("ML10 F14", "out_of_class_scores", """
  select stratum, c as cut, count(*) as n, round(avg(case when abs(bal)/10000>=c then 1.0::double else 0 end),6) as passed from fx_site, (select unnest([0.2,0.4,0.6,0.8])::double as c) where crop=8 group by 1,2
""")(lambda t: M.out_of_class(t.sites.where("crop = 8").withColumn("conf", F.abs("bal") / 10000), "conf", "stratum", [0.2, 0.4, 0.6, 0.8]).withColumn("passed", r6("passed")))

query("ML9", "embedding_features", "select label, count(*) as n, round(avg(cast(embedding[1] as double)),6) as m0 from embeddings group by 1")(
    lambda t: t.embeddings.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(F.element_at("embedding", 1).cast("double"))).alias("m0")))

query("S31", "keyed_fit_cache", "select count(*) as n from fx_trial")(lambda t: _cached(t))


def _cached(t):
    """A result stored under a key of its inputs' shape, and read back only under the same key."""
    key = F.md5(F.to_json(F.struct(F.count("*").alias("n"), F.max("trial_id").alias("top"))))
    path = scratch(t.spark, "fit")
    t.trial.agg(F.count("*").alias("n"), key.alias("key")).write.parquet(path)
    now = t.trial.agg(key.alias("key"))
    return t.spark.read.parquet(path).join(F.broadcast(now), "key").select("n")
