"""Splits, scaling, fitting, evaluation and scoring of the relevance classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_DIGITS = 3  # 16^3 hash buckets per class


def hash_ranked(df: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``rn``, the exact rank inside the stratum by salted hash, and ``n_stratum``.

    A class may hold most rows, so no window covers one. Ranks are bucket offsets plus a rank
    inside one of 4096 hash buckets.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    counts = rows.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(stratum)
    offsets = counts.select(
        stratum, "_b",
        F.coalesce(F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        F.sum("_c").over(whole).alias("n_stratum"),
    )
    inside = Window.partitionBy(stratum, "_b").orderBy("_h", key)
    ranked = rows.withColumn("_r", F.row_number().over(inside))
    return ranked.join(offsets, [stratum, "_b"]).withColumn("rn", F.col("_o") + F.col("_r")).drop("_h", "_b", "_o", "_r")


def stratified_split(df: DataFrame, label: str = "label", key: str = "submission_id", test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the same share of every class, rounded to whole rows."""
    ranked = hash_ranked(df, label, key, seed)
    quota = F.floor(F.col("n_stratum") * test_share + 0.5)
    return ranked.withColumn("is_test", F.col("rn") <= quota).drop("rn", "n_stratum")


def stratified_folds(df: DataFrame, folds: int = 5, label: str = "label", key: str = "submission_id",
                     seed: int = 42) -> DataFrame:
    ranked = hash_ranked(df, label, key, seed)
    return ranked.withColumn("fold", ((F.col("rn") - 1) % folds).cast("int")).drop("rn", "n_stratum")


def check_same_features(train: list[str], test: list[str]) -> None:
    if len(train) != len(test):
        raise ValueError(f"feature count differs: {len(train)} against {len(test)}")
    for i, (a, b) in enumerate(zip(train, test)):
        if a != b:
            raise ValueError(f"feature {i} differs: {a} against {b}")


def column_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation per feature, long form."""
    sums = df.agg(*[a for n in names for a in (F.avg(n).alias(f"{n}_m"), F.stddev_pop(n).alias(f"{n}_s"))])
    rows = [F.struct(F.lit(n).alias("feature"), F.col(f"{n}_m").alias("mean"), F.col(f"{n}_s").alias("std")) for n in names]
    return sums.select(F.inline(F.array(*rows)))


def fit_scaler(train: DataFrame, features: str = "features", output: str = "scaled"):
    """Scaler fitted on the training part only: mean 0 and population deviation 1, as in ``column_stats``.

    The built-in scaler divides by the sample deviation, so one constant factor follows it.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import ElementwiseProduct, StandardScaler
    from pyspark.ml.linalg import Vectors

    scaler = StandardScaler(withMean=True, withStd=True, inputCol=features, outputCol=f"{output}_sample").fit(train)
    n = train.count()
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    constant = ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(scaler.mean)), inputCol=f"{output}_sample", outputCol=output)
    return PipelineModel([scaler, constant])


def make_classifier(kind: str = "logistic_regression", features: str = "scaled", label: str = "label", **params):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    if kind == "logistic_regression":
        return LogisticRegression(featuresCol=features, labelCol=label, **params)
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, **params)
    raise ValueError(f"unsupported model type: {kind}")


def cross_validate(train: DataFrame, classifier, grid: dict[str, list], folds: int = 5, metric: str = "areaUnderROC",
                   parallelism: int = 4):
    """Grid search on stratified folds; returns the fitted cross-validation model."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    label = classifier.getLabelCol()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), values)
    if metric == "accuracy":
        judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    else:
        judge = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    return CrossValidator(
        estimator=classifier, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, foldCol="fold",
        parallelism=parallelism,
    ).fit(stratified_folds(train, folds, label))


def grid_scores(model) -> list[tuple[str, float, float]]:
    """Parameter text, mean and deviation of the metric per grid point."""
    maps = model.getEstimatorParamMaps()
    return [
        (", ".join(f"{p.name}={v}" for p, v in m.items()), float(avg), float(std))
        for m, avg, std in zip(maps, model.avgMetrics, model.stdMetrics)
    ]


def score(docs: DataFrame, model, key: str = "submission_id", error: Column | None = None) -> DataFrame:
    """Label, class name, probabilities and confidence per row; rows with an error keep it."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    failed = error.isNotNull() if error is not None else F.lit(False)
    hit = F.col("prediction").cast("int")
    return model.transform(docs).select(
        key,
        F.when(failed, 0).otherwise(hit).alias("predicted_label"),
        F.when(failed, "error").when(hit == 1, "relevant").otherwise("irrelevant").alias("predicted_class"),
        F.when(failed, 0.5).otherwise(p[0]).alias("probability_irrelevant"),
        F.when(failed, 0.5).otherwise(p[1]).alias("probability_relevant"),
        F.when(failed, 0.0).otherwise(F.array_max(p)).alias("confidence"),
        (error if error is not None else F.lit(None).cast("string")).alias("error"),
    )


def feature_importance(spark, model, names: list[str]) -> DataFrame:
    """Coefficients or tree importances by feature name; as many rows as features."""
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values.toArray())], "feature string, importance double"
    )


def fit_certificate(train: DataFrame, model, names: list[str], label: str = "label") -> DataFrame:
    """Whether a logistic fit is the best one, from the rows alone: per feature the moment the labels show and the one the fit implies.

    At the minimum of the mean logistic loss with a ridge penalty the gradient is zero: the mean of label times
    feature equals the mean of probability times feature plus the penalty's share. The penalty is on
    coefficients of features divided by their sample deviation. The intercept stands for a feature of ones.
    """
    from pyspark.ml.functions import vector_to_array

    spark = train.sparkSession
    p = vector_to_array("probability")[1]
    x = F.concat(vector_to_array(model.getFeaturesCol()), F.array(F.lit(1.0)))
    rows = model.transform(train).select(F.col(label).cast("double").alias("y"), p.alias("p"), F.posexplode(x).alias("i", "x"))
    moments = rows.groupBy("i").agg(
        F.avg(F.col("y") * F.col("x")).alias("observed"), F.avg(F.col("p") * F.col("x")).alias("told"), F.var_samp("x").alias("spread"))
    ridge = float(model.getRegParam()) * (1 - float(model.getElasticNetParam()))
    fitted = [(i, n, float(v) * ridge) for i, (n, v) in enumerate(zip([*names, "intercept"], [*model.coefficients.toArray(), 0.0]))]
    known = spark.createDataFrame(fitted, "i int, feature string, pull double")
    implied = F.col("told") + F.col("pull") * F.col("spread")
    return moments.join(F.broadcast(known), "i").select("feature", "observed", implied.alias("implied"), (implied - F.col("observed")).alias("gradient"))


def top_features(importance: DataFrame, k: int = 15) -> DataFrame:
    return importance.orderBy(F.abs("importance").desc(), "feature").limit(k)


# --------------------------------------------------------------- evaluation

def confusion(predictions: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    return predictions.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Precision, recall, F1 and support per class from the four confusion counts."""
    cells = confusion(predictions, label, predicted)
    sides = cells.select(
        F.inline(F.array(
            F.struct(F.col(label).alias("class"), F.lit("t").alias("side"), "n", (F.col(label) == F.col(predicted)).alias("ok")),
            F.struct(F.col(predicted).alias("class"), F.lit("p").alias("side"), "n", (F.col(label) == F.col(predicted)).alias("ok")),
        ))
    )
    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    sums = sides.groupBy("class").agg(
        total((F.col("side") == "t") & F.col("ok")).alias("tp"), total(F.col("side") == "t").alias("support"),
        total(F.col("side") == "p").alias("predicted"),
    )
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def accuracy(predictions: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    return predictions.agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"))


def running_totals(df: DataFrame, order: str, columns: list[str], slices: int = 256) -> DataFrame:
    """Adds ``cum_<c>``, totals over all rows with a larger or equal ``order`` value.

    ``order`` is unique. Quantile cuts split the rows into slices, whose totals are few enough for
    one small window; the rest runs per slice. No task ever sees the whole order.
    """
    from pyspark.ml.feature import Bucketizer

    cuts = df.approxQuantile(order, [i / slices for i in range(1, slices)], 1 / (4 * slices))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    sliced = Bucketizer(splits=splits, inputCol=order, outputCol="_s").transform(df)
    totals = sliced.groupBy("_s").agg(*[F.sum(c).alias(c) for c in columns])
    # at most ``slices`` rows
    above = Window.orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_s", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("_s").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in columns}).join(starts, "_s")
    return ranked.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_{c}") for c in columns}).drop(
        "_s", *[f"_{c}" for c in columns]
    )


def ranking_metrics(scored: DataFrame, label: str = "label", probability: str = "probability_relevant") -> DataFrame:
    """Exact ROC AUC and precision-recall AUC; equal scores count as one threshold."""
    points = scored.groupBy(F.col(probability).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    curve = running_totals(points, "s", ["pos", "neg"])
    pos, neg = F.col("pos"), F.col("neg")
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    precision = tp / (tp + fp)
    before = F.coalesce(F.try_divide(tp - pos, tp + fp - pos - neg), F.lit(1.0))
    sums = curve.agg(
        F.sum(pos).alias("p"), F.sum(neg).alias("n"),
        F.sum(neg * (tp - pos + pos * 0.5)).alias("roc"), F.sum(pos * (precision + before) / 2).alias("pr"),
    )
    return sums.select(
        F.coalesce(F.try_divide("roc", F.col("p") * F.col("n")), F.lit(0.0)).alias("roc_auc"),
        F.coalesce(F.try_divide("pr", "p"), F.lit(0.0)).alias("pr_auc"),
    )


def save_features(features: DataFrame, path: str, names: list[str], key: str = "submission_id", label: str = "label") -> None:
    """Named columns keep the feature names in the schema."""
    features.select(key, label, *names).write.mode("overwrite").parquet(path)


def load_features(spark, path: str) -> tuple[DataFrame, list[str]]:
    df = spark.read.parquet(path)
    return df, df.columns[2:]
