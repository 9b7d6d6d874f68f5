"""Models on disk: a model with the document that names its features, read again by any session."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from gridloom.operators.forests import Forest

_NODES = "tree int, node int, feature int, threshold double, value array<double>"


def save_model(model: PipelineModel | Forest, document: dict, path: str) -> None:
    """Writes the model below path, in place of one that is there: Spark's own layout for its pipelines, a table
    of nodes for a forest, and the document as JSON beside it."""
    spark = SparkSession.active()
    kind = "forest" if isinstance(model, Forest) else "pipeline"
    about = {"kind": kind, "document": document}
    if isinstance(model, Forest):
        about |= {"features": list(model.features), "classes": None if model.classes is None else list(model.classes), "shape": list(model.value.shape)}
        trees, nodes = np.indices(model.feature.shape).reshape(2, -1)
        rows = zip(trees.tolist(), nodes.tolist(), model.feature.ravel().tolist(), model.threshold.ravel().tolist(), model.value.reshape(len(trees), -1).tolist(), strict=True)
        spark.createDataFrame(list(rows), _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/document")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | Forest, dict]:
    """(model, document) of `save_model`."""
    about = json.loads(spark.read.text(f"{path}/document").first()[0])
    if about["kind"] == "pipeline":
        return PipelineModel.load(f"{path}/model"), about["document"]
    return _forest(spark.read.schema(_NODES).parquet(f"{path}/model"), about), about["document"]


def _forest(nodes: DataFrame, about: dict) -> Forest:
    got = nodes.orderBy("tree", "node").toArrow()  # as many rows as the forest has nodes
    shape = tuple(about["shape"])
    return Forest(
        got.column("feature").to_numpy().reshape(shape[:2]), got.column("threshold").to_numpy().reshape(shape[:2]), np.array(got.column("value").to_pylist()).reshape(shape),
        tuple(about["features"]), None if about["classes"] is None else tuple(about["classes"]),
    )
