"""Classifiers and regressors in MLlib (ML1-ML7, ML10). Scores differ from other libraries' learners; the contracts don't."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.sampling import row_index


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (classes * n of the class) per row, from the class counts."""
    counts = df.groupBy(label).count()
    total = counts.agg(F.sum("count").alias("_n"), F.count("*").alias("_k"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("count"))).alias(name))
    return df.join(F.broadcast(weights), label)


def _prepare(features: list[str]) -> list:
    filled = [f"{c}__filled" for c in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")]


def boosted(features: list[str], iterations: int = 20, seed: int = 0) -> Pipeline:
    """Boosted trees for many classes: one against the rest, balanced by weights."""
    gbt = GBTClassifier(maxIter=iterations, maxDepth=3, stepSize=0.2, seed=seed, weightCol="weight")
    return Pipeline(stages=[*_prepare(features), OneVsRest(classifier=gbt, labelCol="label", featuresCol="features", weightCol="weight")])


def forest(features: list[str], trees: int = 50, seed: int = 0) -> Pipeline:
    return Pipeline(stages=[*_prepare(features), RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed, labelCol="label", featuresCol="features", weightCol="weight")])


def logistic(features: list[str]) -> Pipeline:
    return Pipeline(stages=[*_prepare(features), StandardScaler(inputCol="features", outputCol="scaled"), LogisticRegression(labelCol="label", featuresCol="scaled", weightCol="weight", maxIter=50)])


def selected_forest(features: list[str], k: int, seed: int = 0) -> Pipeline:
    """The k features of the largest ANOVA F, chosen inside the fit, then a forest."""
    select = UnivariateFeatureSelector(featuresCol="features", outputCol="chosen", labelCol="label", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return Pipeline(stages=[*_prepare(features), select, RandomForestClassifier(numTrees=30, maxDepth=5, seed=seed, labelCol="label", featuresCol="chosen", weightCol="weight")])


def group_folds(df: DataFrame, group: str, k: int, name: str = "fold") -> DataFrame:
    """A fold per group, large groups dealt first in turns, so that no group is split and folds are even."""
    sizes = df.groupBy(group).count()
    placed = row_index(sizes.withColumn("_less", -F.col("count")), "_less", group)
    order = F.col("row_index")
    lap = F.floor(order / k)
    turn = F.when(lap % 2 == 0, order % k).otherwise(k - 1 - order % k).cast("int")  # back and forth
    return df.join(placed.select(group, turn.alias(name)), group)


def temporal_split(df: DataFrame, year: str, last: int) -> tuple[DataFrame, DataFrame]:
    """Training rows up to a year and test rows after it."""
    return df.where(F.col(year) <= last), df.where(F.col(year) > last)


def out_of_fold(df: DataFrame, pipeline: Pipeline, k: int, fold: str = "fold") -> DataFrame:
    """Predictions for every row from a model that did not see its fold."""
    parts = [pipeline.fit(df.where(F.col(fold) != i)).transform(df.where(F.col(fold) == i)) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def grid_search(df: DataFrame, features: list[str], grid: dict[str, list], folds: int = 3, parallelism: int = 4) -> CrossValidatorModel:
    """A forest's settings by cross-validation over given folds, settings fitted side by side."""
    prepared = Pipeline(stages=_prepare(features)).fit(df).transform(df)
    rf = RandomForestClassifier(seed=0, labelCol="label", featuresCol="features", weightCol="weight")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(rf.getParam(name), values)
    scorer = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    return CrossValidator(estimator=rf, estimatorParamMaps=builder.build(), evaluator=scorer, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(prepared)


def yield_model(df: DataFrame, features: list[str], target: str, iterations: int = 20) -> tuple[PipelineModel, float]:
    """A boosted regressor and the factor that makes its mean the observed mean."""
    gbt = GBTRegressor(maxIter=iterations, maxDepth=3, seed=0, labelCol=target, featuresCol="features")
    model = Pipeline(stages=[*_prepare(features), gbt]).fit(df)
    seen, got = model.transform(df).agg(F.avg(target), F.avg("prediction")).first()
    return model, float(seen / got) if got else 1.0


def with_yield(df: DataFrame, model: PipelineModel, factor: float, pred: Column, crop: str) -> DataFrame:
    """Yields where the class is the model's crop, plain and calibrated, else NULL."""
    scored = model.transform(df)
    own = pred == crop
    return scored.withColumns({"yield_tha": F.when(own, F.col("prediction")), "yield_tha_calibrated": F.when(own, F.col("prediction") * factor)})


def baseline_yield(df: DataFrame, categories: list[str], target: str) -> PipelineModel:
    """A linear model on one-hot year and state: what a yield model has to beat."""
    index = StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories], handleInvalid="keep")
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=[f"{c}_v" for c in categories], outputCol="features"), LinearRegression(labelCol=target, featuresCol="features", regParam=0.01)]).fit(df)


def regression_score(df: DataFrame, target: str, metric: str = "r2") -> float:
    return RegressionEvaluator(labelCol=target, metricName=metric).evaluate(df)


def out_of_class(df: DataFrame, confidence: str, stratum: str, cuts: list[float]) -> DataFrame:
    """Per stratum of rows that belong to no class, how many each confidence cut-off lets through."""
    rows = df.withColumn("cut", F.explode(F.array(*(F.lit(c) for c in cuts))))
    return rows.groupBy(stratum, "cut").agg(F.count("*").alias("n"), F.avg((F.col(confidence) >= F.col("cut")).cast("double")).alias("passed"))


def save(model: PipelineModel, path: str) -> PipelineModel:
    """Write a model bundle and read it back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)
