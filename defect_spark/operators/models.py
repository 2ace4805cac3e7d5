"""Fitting, scoring and storing of models. Feature columns are numeric; the label is 0, 1, ..."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defect_spark.operators import features, knn, metrics, ranges, svm


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features_", handleInvalid="error").transform(df)


def fit_random_forest(df: DataFrame, columns: list[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42) -> Model:
    return RandomForestClassifier(featuresCol="features_", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(df, columns))


def fit_logistic(df: DataFrame, columns: list[str], label: str, c: float = 1.0) -> Model:
    """Ridge logistic regression; c is the inverse strength, as a sum over rows."""
    return LogisticRegression(featuresCol="features_", labelCol=label, regParam=1 / (c * max(1, df.count())), standardization=False).fit(assembled(df, columns))


class KernelSvm(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted machine: margins are sums of coefficients times kernel values with points; no points for the linear kernel.

    It is stored and loaded like any stage of a pipeline. At most ``landmarks`` points are kept.
    """

    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)
    options = Param(Params._dummy(), "options", "kernel, gamma, degree and coef0")
    points = Param(Params._dummy(), "points", "landmarks")
    coefficients = Param(Params._dummy(), "coefficients", "a number for each point or column", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "added to each margin", TypeConverters.toFloat)

    def __init__(self, columns: list[str] = (), options: dict | None = None, points: list[list[float]] = (), coefficients: list[float] = (), intercept: float = 0.0):
        super().__init__()
        self._set(columns=list(columns), options=options or {}, points=list(points), coefficients=list(coefficients), intercept=intercept)

    def margin(self) -> Column:
        options = self.getOrDefault(self.options)
        gamma, coef0, power = F.lit(options["gamma"]), F.lit(options["coef0"]), F.lit(float(options["degree"]))
        literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), F.lit(kind))
        add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        vector = F.array(*(F.col(f"`{c}`").cast("double") for c in self.getOrDefault(self.columns)))

        def value(point: Column) -> Column:
            dot = add(F.zip_with(vector, point, lambda a, b: a * b))
            if options["kernel"] == "poly":
                return F.pow(gamma * dot + coef0, power)
            if options["kernel"] == "sigmoid":
                return F.tanh(gamma * dot + coef0)
            return F.exp(-gamma * add(F.zip_with(vector, point, lambda a, b: (a - b) * (a - b))))

        coefficients = literal(self.getOrDefault(self.coefficients), "array<double>")
        if options["kernel"] == "linear":
            made = F.zip_with(vector, coefficients, lambda a, b: a * b)
        else:
            made = F.zip_with(literal(self.getOrDefault(self.points), "array<array<double>>"), coefficients, lambda p, a: a * value(p))
        return add(made) + self.getOrDefault(self.intercept)

    def _transform(self, df: DataFrame) -> DataFrame:
        """df with margin and prediction."""
        return df.withColumn("margin", self.margin()).withColumn("prediction", (F.col("margin") > 0).cast("double"))


def fit_svm(df: DataFrame, columns: list[str], label: str, key: str, c: float = 1.0, kernel: str = "rbf", gamma: float = 0.1, degree: int = 3, coef0: float = 0.0, landmarks: int = 50, passes: int = 8) -> KernelSvm:
    """A support vector machine with balanced class weights, by ``landmarks`` rows (those with the smallest hash of key).

    With all rows as landmarks it is the exact machine, to the rounding of the hinge; see svm. The
    linear kernel needs no landmarks. Labels are 0 and 1, without nulls.
    """
    if kernel not in svm.KINDS:
        raise ValueError(f"unknown kernel {kernel}")
    vector = F.array(*(F.col(f"`{x}`").cast("double") for x in columns)).alias("vector")
    data = ranges.checkpointed(df.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), vector, F.lit(0).alias("fold")))
    candidate = svm.Candidate(0, svm.landmarks_of(data, landmarks), c, kernel, gamma, degree, coef0)
    weights = svm.fit_all(data, [candidate], [svm.NO_FOLD], passes=passes)[0][0]
    points, coefficients, intercept = svm.machine(candidate, weights)
    return KernelSvm(columns, candidate.options, points, coefficients, intercept)


def feature_importance(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """(feature, importance): a forest's importances, else the absolute coefficients; no rows for a model without either."""
    if isinstance(model, KernelSvm):
        linear = model.getOrDefault(model.options)["kernel"] == "linear"
        values = [abs(v) for v in model.getOrDefault(model.coefficients)] if linear else []
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = abs(model.coefficients.toArray()) if hasattr(model, "coefficients") else []
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")


def score_probability(probability: Column, margin: Column) -> Column:
    """p(1) of two classes, the highest of more; without probabilities the sigmoid of a margin, else a half."""
    from_array = F.when(F.size(probability) == 2, F.get(probability, F.lit(1))).otherwise(F.array_max(probability))
    return F.coalesce(from_array, 1 / (1 + F.exp(-margin)), F.lit(0.5))


def apply_threshold(probability: Column, own: Column, threshold: float) -> Column:
    """Label by a threshold; a half leaves the model's own label."""
    return own.cast("int") if threshold == 0.5 else (probability >= threshold).cast("int")


def prediction_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, label, prediction, probability, confidence, correct); confidence is the probability of the predicted label."""
    confidence = F.when(F.col("prediction") == 1, F.col("probability")).otherwise(1 - F.col("probability"))
    return df.select(key, "label", "prediction", "probability", confidence.alias("confidence"), (F.col("label") == F.col("prediction")).alias("correct"))


def soft_vote(members: list[DataFrame], key: str) -> DataFrame:
    """(key, probability, prediction): the mean of the members' probabilities; 0 on a tie. Rows need not be in all members.

    Probabilities are added in the order of members, so the last digit, and with it a tie, is not
    that of the order in which a shuffle brings them.
    """
    rows = reduce(lambda a, b: a.unionByName(b), (m.select(key, "probability", F.lit(i).alias("member_")) for i, m in enumerate(members)))
    of = lambda i: F.coalesce(F.sum(F.when(F.col("member_") == i, F.col("probability"))), F.lit(0.0))
    total = reduce(lambda a, b: a + b, (of(i) for i in range(len(members))))
    mean = rows.groupBy(key).agg((total / F.nullif(F.count("probability"), F.lit(0))).alias("probability"))
    return mean.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def probabilities(model, df: DataFrame, columns: list[str], key: str, label: str) -> DataFrame:
    """(key, label, own, probability) by a fitted model of any family here."""
    svm_model = isinstance(model, KernelSvm)
    made = model.transform(df if svm_model else assembled(df, columns))
    none = F.lit(None).cast("array<double>")
    probability = vector_to_array("probability") if "probability" in made.columns and not svm_model else none
    margin = F.col("margin") if svm_model else F.get(vector_to_array("rawPrediction"), F.lit(1))
    return made.select(key, F.col(label).alias("label"), F.col("prediction").cast("int").alias("own"), score_probability(probability, margin).alias("probability"))


class KnnModel:
    """Scaled training rows with the scaler and parameters: what nearest-neighbour scoring needs."""

    def __init__(self, rows: DataFrame, scaler: DataFrame, columns: list[str], params: dict):
        self.rows, self.scaler, self.columns, self.params = rows, scaler, columns, params


def vectors(df: DataFrame, columns: list[str], *others: str) -> DataFrame:
    return df.select(*others, F.array(*(F.col(c).cast("double") for c in columns)).alias("vector_"))


def fit_knn(df: DataFrame, columns: list[str], label: str, key: str, k: int = 5, p: float = 2.0, weights: str = "uniform") -> KnnModel:
    scaler = features.fit_scaler(df, columns)
    rows = vectors(features.apply_scaler(df, scaler, columns), columns, F.col(key).alias("key"), F.col(label).alias("label"))
    return KnnModel(rows, scaler, columns, {"k": k, "p": p, "weights": weights})


@dataclass
class ModelPackage:
    """What scoring new data needs: the model, its columns in order, their scaler, and which of them it uses.

    A KnnModel has its own scaler. mask has a 0 or 1 for each column; metadata is a JSON table.
    """

    model: object
    columns: list[str]
    scaler: DataFrame | None = None
    mask: list[int] | None = None
    metadata: dict = field(default_factory=dict)

    def used(self) -> list[str]:
        return [c for c, bit in zip(self.columns, self.mask) if bit] if self.mask is not None else self.columns


def neighbour_share(df: DataFrame, model: KnnModel, key: str, label: str) -> DataFrame:
    """(key, label, own, probability) by votes of neighbours among the model's rows."""
    scaled = features.apply_scaler(df.select(key, label, *model.columns), model.scaler, model.columns)
    asked = vectors(scaled, model.columns, F.col(key).alias("key"))
    near = knn.knn_join(asked, model.rows, model.params["k"], "key", "vector_", model.params["p"])
    votes = knn.knn_shares(near, model.rows, "key", "label", model.params["weights"])
    ones = votes.groupBy("query_id").agg(F.sum(F.when(F.col("label") == 1, F.col("share")).otherwise(0.0)).alias("probability"))
    joined = df.select(key, F.col(label).alias("label")).join(ones.withColumnRenamed("query_id", key), key)
    return joined.select(key, "label", (F.col("probability") > 0.5).alias("own"), "probability")


def batch_score(df: DataFrame, model: KnnModel | ModelPackage, key: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Prediction rows of new data by a model of any family: its columns are picked, its own scaler and mask applied.

    A column that the model needs and df lacks is an error; see evaluate for the metrics of the
    rows. For neighbours keys are longs and share one space with the training rows; a training
    row scored again doesn't count itself as a neighbour.
    """
    package = model if isinstance(model, ModelPackage) else ModelPackage(model, model.columns)
    missing = features.missing_features(df.columns, package.columns)
    if missing:
        raise ValueError(f"missing features: {missing}")
    rows = df.select(key, label, *package.columns)
    if isinstance(package.model, KnnModel):
        made = neighbour_share(rows, package.model, key, label)
    else:
        scaled = features.apply_scaler(rows, package.scaler, package.columns) if package.scaler is not None else rows
        made = probabilities(package.model, scaled, package.used(), key, label)
    labelled = made.withColumn("prediction", apply_threshold(F.col("probability"), F.col("own"), threshold))
    return prediction_rows(labelled, key)


def save_model(model, path: str, spark: SparkSession, metadata: dict | None = None) -> None:
    """A folder with the model or package: the model, its scaler if any, and a JSON table of metadata (scores, names, mask)."""
    package = model if isinstance(model, ModelPackage) else None
    model = package.model if package else model
    more = {"columns": package.columns, "mask": package.mask, "scaled": package.scaler is not None} if package else {}
    if isinstance(model, KnnModel):
        model.rows.write.mode("overwrite").parquet(f"{path}/rows")
        model.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
        more |= {"kind": "knn", "used": model.columns, "params": model.params}
    else:
        PipelineModel([model]).write().overwrite().save(f"{path}/model")
        more |= {"kind": "ml"}
        if package and package.scaler is not None:
            package.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    stored = {**(package.metadata if package else {}), **(metadata or {}), **more}
    spark.createDataFrame([(json.dumps(stored),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str, spark: SparkSession) -> tuple[object, dict]:
    """(model, metadata) as saved; a package loads as its bare model here."""
    metadata = json.loads(spark.read.text(f"{path}/metadata").first().value)
    if metadata["kind"] == "knn":
        model = KnnModel(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/scaler"), metadata["used"], metadata["params"])
        return model, metadata
    return PipelineModel.load(f"{path}/model").stages[0], metadata


def load_package(path: str, spark: SparkSession) -> ModelPackage:
    """A package as saved; its metadata has what was given and the names, mask and kind."""
    model, metadata = load_model(path, spark)
    if "columns" not in metadata:
        raise ValueError(f"{path} holds a bare model; see load_model")
    scaler = spark.read.parquet(f"{path}/scaler") if metadata["scaled"] else None
    return ModelPackage(model, metadata["columns"], scaler, metadata["mask"], metadata)


def evaluate(rows: DataFrame) -> DataFrame:
    """The binary and ranking metrics of prediction rows, as one row."""
    df = rows.select(F.lit(0).alias("g"), "label", "prediction", F.col("probability").alias("score"))
    return metrics.binary_metrics(df, "g").join(metrics.ranking_metrics(df, "g"), "g").drop("g")
