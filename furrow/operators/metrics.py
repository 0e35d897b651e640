"""Agreement, accuracy and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def confusion(df: DataFrame, truth: str, pred: str, classes: tuple[str, ...]) -> DataFrame:
    """Counts by truth and, as columns n_<class>, prediction; classes without rows have zeros."""
    base = df.sparkSession.createDataFrame([(c,) for c in classes], f"{truth} string")
    counts = df.groupBy(truth).agg(*(F.count_if(F.col(pred) == c).alias(f"n_{c.lower()}") for c in classes))
    return base.join(counts, truth, "left").na.fill(0)


def class_metrics(df: DataFrame, truth: str, pred: str, classes: tuple[str, ...]) -> DataFrame:
    """Per class tp, fp, fn, precision, recall and F1, zero where undefined; one pass over the rows."""
    one = df.agg(*(
        F.struct(
            F.count_if((F.col(truth) == c) & (F.col(pred) == c)).alias("tp"), F.count_if((F.col(truth) != c) & (F.col(pred) == c)).alias("fp"),
            F.count_if((F.col(truth) == c) & (F.col(pred) != c)).alias("fn"),
        ).alias(c) for c in classes
    ))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("cls"), F.col(f"`{c}`.tp").alias("tp"), F.col(f"`{c}`.fp").alias("fp"), F.col(f"`{c}`.fn").alias("fn")) for c in classes))).alias("r")).select("r.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("cls", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def overall_metrics(df: DataFrame, truth: str, pred: str, classes: tuple[str, ...]) -> DataFrame:
    """One row: accuracy, macro F1 and balanced accuracy."""
    per = class_metrics(df, truth, pred, classes).agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
    return df.agg(_share(F.col(truth) == F.col(pred)).alias("accuracy")).join(per)


def two_by_two(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Kappa, IoU and conditional rates from the four areas of a 2 x 2 table (both, only first, only second, none)."""
    n = a + b + c + d
    observed = F.try_divide(a + d, n)
    expected = F.try_divide((a + b) * (a + c) + (c + d) * (b + d), n * n)
    return {
        "agreement": observed, "kappa": F.try_divide(observed - expected, 1 - expected), "iou": F.try_divide(a, a + b + c),
        "second_given_first": F.try_divide(a, a + b), "first_given_second": F.try_divide(a, a + c),
    }


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks from 1 within keys, ties averaged."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def auc(df: DataFrame, score: str, positive: str, keys: list[str], least: int = 4) -> DataFrame:
    """Mann-Whitney AUC per key from average ranks; NULL with fewer than ``least`` rows on either side.

    Rows are first counted per distinct score, so ranks run over scores, not rows.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = per.withColumn("_u", F.col("_p") * (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_n") / 2.0))
    total = wins.groupBy(*keys).agg(F.sum("_u").alias("u"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    enough = (F.col("n_pos") >= least) & (F.col("n_neg") >= least)
    return total.withColumn("auc", F.when(enough, F.col("u") / (F.col("n_pos") * F.col("n_neg"))))


def mann_whitney_p(u: Column, n: Column, m: Column) -> Column:
    """Two-sided p of a Mann-Whitney U by the normal approximation, from an even polynomial of the error function."""
    z = F.abs(u - n * m / 2.0) / F.sqrt(n * m * (n + m + 1) / 12.0)
    t = 1 / (1 + 0.3275911 * z / F.sqrt(F.lit(2.0)))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z / 2)


def youden(df: DataFrame, value: str, positive: str, cuts: list[float], keys: list[str]) -> DataFrame:
    """Per key the cut with the largest true-positive rate minus false-positive rate, the lowest of ties."""
    hit = lambda c, side: F.avg(F.when(side, (F.col(value) >= c).cast("double")))
    pos = F.col(positive)
    scores = F.array(*(F.struct((F.round(hit(c, pos) - hit(c, ~pos), 9)).alias("j"), F.lit(-float(c)).alias("m"), (hit(c, pos) - hit(c, ~pos)).alias("youden_j"), F.lit(float(c)).alias("cut")) for c in cuts))
    return df.groupBy(*keys).agg(F.array_max(scores).alias("_b")).where(F.col("_b.j").isNotNull()).select(*keys, "_b.youden_j", "_b.cut")


def sensitivity_at(df: DataFrame, score: str, positive: str, keys: list[str], fpr: float = 0.05) -> DataFrame:
    """Per key the threshold that lets through a share of the negatives, and the positives' rate at it."""
    neg = df.groupBy(*keys).agg(F.percentile(F.when(~F.col(positive), F.col(score)), F.lit(1 - fpr)).alias("cut"))
    joined = df.join(neg, keys) if keys else df.join(F.broadcast(neg))
    hits = F.count_if(F.col(positive) & (F.col(score) > F.col("cut")))
    return joined.groupBy(*keys, "cut").agg(hits.alias("hits"), F.count_if(F.col(positive)).alias("n_pos")).withColumn("sensitivity", F.try_divide(F.col("hits").cast("double"), F.col("n_pos").cast("double")))


def average_precision(df: DataFrame, score: str, positive: str, keys: list[str]) -> DataFrame:
    """Step-wise area under precision and recall per key; equal scores enter together."""
    per = df.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count("*").alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = per.withColumn("_prec", F.sum("_p").over(down) / F.sum("_n").over(down).cast("double"))
    return steps.groupBy(*keys).agg((F.sum(F.col("_p") * F.col("_prec")) / F.sum("_p").cast("double")).alias("average_precision"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a proportion; NULL for no trials."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    centre, denominator = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    good = n > 0
    return F.when(good, (centre - half) / denominator), F.when(good, (centre + half) / denominator)


def regression_errors(truth: Column, pred: Column) -> dict[str, Column]:
    """R squared, RMSE and MAE as aggregates."""
    err = truth - pred
    return {"r2": 1 - F.try_divide(F.sum(err * err), F.sum(truth * truth) - F.sum(truth) * F.sum(truth) / F.count(truth)), "rmse": F.sqrt(F.avg(err * err)), "mae": F.avg(F.abs(err))}


def replicate_weight(unit: Column, replicate: Column, seed: int = 1) -> Column:
    """A Poisson(1) weight from a deterministic mix of unit and replicate: the bootstrap without resampling.

    The mix is integer arithmetic, so that other engines give the same weights.
    """
    a = (unit * 7919 + replicate * 104729 + seed * 1299709) % 1000003
    mixed = (a * a + unit * 31 + replicate * 17) % 1000003
    u = mixed / 1000003.0
    cuts = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    return sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def bootstrap(df: DataFrame, unit: str, replicates: int, value: Column, name: str = "stat", seed: int = 1) -> DataFrame:
    """(replicate, stat): the weighted mean of ``value`` in every replicate; rows of a unit share their weights."""
    rows = df.withColumn("_v", value.cast("double")).groupBy(unit).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = replicate_weight(F.col(unit), F.col("replicate"), seed)
    return rows.withColumn("_w", w).groupBy("replicate").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n")).cast("double")).alias(name))


def interval(boot: DataFrame, name: str = "stat", level: float = 0.95) -> DataFrame:
    """The percentile interval and median over replicates."""
    tail = (1 - level) / 2
    p = F.percentile(name, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    return boot.agg(p[0].alias("low"), p[1].alias("mid"), p[2].alias("high"))


def contrast(mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column) -> Column:
    """Difference of means in pooled standard deviations."""
    return F.try_divide(F.abs(mean_a - mean_b), F.sqrt((sd_a * sd_a + sd_b * sd_b) / 2))
