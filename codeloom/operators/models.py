"""Technique classifiers on code features with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``weight`` rows / (classes x rows of the class), so that every class weighs the same."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("n_all"), F.count(F.lit(1)).alias("n_classes"))
    own = df.join(counts, label).crossJoin(F.broadcast(total))  # one row
    return own.withColumn("weight", F.col("n_all") / (F.col("n_classes") * F.col("n_class"))).drop("n_class", "n_all", "n_classes")


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 10, seed: int = 42) -> PipelineModel:
    indexer = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip").fit(df)
    stages = [
        indexer,
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels),
    ]
    return Pipeline(stages=stages).fit(balanced(df, label))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``predicted``, the ``confidence`` of the predicted class and ``scores``, a map of every class."""
    chances = vector_to_array("probability")
    names = F.array(*map(F.lit, model.stages[0].labels))
    return model.transform(df).withColumn("confidence", F.array_max(chances)).withColumn("scores", F.map_from_arrays(names, chances))


def top_classes(predicted: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, place, label, score) of the k most probable classes of each row, ties by label; ranked within the row."""
    pairs = F.expr("array_sort(transform(map_entries(scores), e -> struct(-e.value AS minus, e.key AS label)))")
    return predicted.select(key, F.posexplode(F.slice(pairs, 1, k)).alias("place", "e")).select(
        key, (F.col("place") + 1).alias("place"), F.col("e.label").alias("label"), (-F.col("e.minus")).alias("score")
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, features: list[str], least: float = 0.01) -> dict[str, float]:
    """Importance of the features over ``least``, the greatest first."""
    found = zip(features, model.stages[2].featureImportances.toArray().tolist(), strict=True)
    return dict(sorted(((f, x) for f, x in found if x > least), key=lambda e: (-e[1], e[0])))


def cross_validate(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, trees: int = 100, depth: int = 10) -> tuple[float, float]:
    """Mean and population deviation of the accuracy over folds cut by md5 of the key."""
    fold = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long"), F.lit(folds))
    own = df.withColumn("_fold", fold)
    found = []
    for k in range(folds):
        model = fit_forest(own.where(F.col("_fold") != k), features, label, trees, depth)
        hits = predict(model, own.where(F.col("_fold") == k)).agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
        found.append(hits or 0.0)
    mean = sum(found) / folds
    return mean, (sum((x - mean) ** 2 for x in found) / folds) ** 0.5


def grid_search(df: DataFrame, features: list[str], label: str, key: str, trees: tuple[int, ...] = (50, 100, 200), depths: tuple[int, ...] = (5, 10, 15, 20)) -> dict:
    """The best of the grid of forest sizes and depths (at most 30 in Spark) by accuracy on a fifth of the rows."""
    held = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long"), F.lit(5)) == 0
    best = {"accuracy": -1.0}
    for n in trees:
        for depth in depths:
            model = fit_forest(df.where(~held), features, label, n, depth)
            accuracy = predict(model, df.where(held)).agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] or 0.0
            if accuracy > best["accuracy"]:
                best = {"accuracy": accuracy, "trees": n, "depth": depth}
    return best
