"""Gradient-boosted device failure model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsilt.operators.log_classifier import aligned, evaluation_report, stratified
from netsilt.operators.maintenance import FEATURE_NAMES

CLASSES = {0: "normal", 1: "pre-failure"}


@dataclass
class TrainedFailureModel:
    model: PipelineModel
    report: DataFrame


def train_failure_model(features: DataFrame, labels: DataFrame, max_iter: int = 150, max_depth: int = 4,
                        step_size: float = 0.05, subsample: float = 0.8, seed: int = 42,
                        partitions: int = 8) -> TrainedFailureModel:
    """Fit on 80 % of the devices of each class, evaluate on the rest.

    ``features`` is the device feature table, ``labels`` (device, label 0/1). Devices are
    dealt into ``partitions`` by hash whatever their number, as subsampling goes by partition.
    """
    rows = aligned(features, labels, "device")
    try:
        # subsampling goes by row order, so the order is fixed
        split = stratified(rows, "label", "device", seed)
        ready = split.repartition(partitions, "device").sortWithinPartitions("device").persist(StorageLevel.MEMORY_AND_DISK)
        steps = Pipeline(stages=[
            VectorAssembler(inputCols=FEATURE_NAMES, outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            GBTClassifier(labelCol="label", featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                          stepSize=step_size, subsamplingRate=subsample, seed=seed),
        ])
        model = steps.fit(ready.filter("part = 'train'"))
        tested = model.transform(ready.filter("part = 'test'"))
        name = lambda c: F.when(F.col(c) == 1, CLASSES[1]).otherwise(CLASSES[0])
        named = tested.select(name("label").alias("actual"), name("prediction").alias("guess"))
        # one row per class
        report = features.sparkSession.createDataFrame(
            evaluation_report(named, "actual", "guess").collect(),
            "class string, precision double, recall double, f1 double, support long")
        ready.unpersist()
        return TrainedFailureModel(model, report)
    finally:
        rows.unpersist()


def failure_probabilities(features: DataFrame, model: PipelineModel | None) -> DataFrame:
    """(device, failure_probability); 0 without a trained model."""
    if model is None:
        return features.select("device", F.lit(0.0).alias("failure_probability"))
    return model.transform(features).select(
        "device", F.get(vector_to_array("probability"), F.lit(1)).alias("failure_probability"))
