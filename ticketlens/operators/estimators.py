"""Classifiers as pipeline stages that save and load (M3)."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from ticketlens.operators import classify


class _ClassifierParams(Params):
    kind = Param(Params._dummy(), "kind", "svm (text) or embedding (vectors)", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "key of a row; deals the folds", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label to learn", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "text or vector column", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "further options of the kind, as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(kind="svm", keyCol="ticket_id", labelCol="domain", inputCol="text", options="{}")

    def _column_options(self) -> dict:
        name = "text" if self.getOrDefault("kind") == "svm" else "vector"
        return {"key": self.getOrDefault("keyCol"), "label": self.getOrDefault("labelCol"), name: self.getOrDefault("inputCol"),
                **json.loads(self.getOrDefault("options"))}


class TicketClassifier(Estimator, _ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Trains M2's or V5's classifier; the model adds what predict_proba of the kind gives."""

    @keyword_only
    def __init__(self, *, kind: str = "svm", keyCol: str = "ticket_id", labelCol: str = "domain", inputCol: str = "text",
                 options: str = "{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TicketClassifierModel":
        fitted = classify.train_classifier(dataset, self.getOrDefault("kind"), **self._column_options())
        return self._copyValues(TicketClassifierModel(fitted))


class TicketClassifierModel(Model, _ClassifierParams, MLWritable, MLReadable):
    """A fitted classifier.  svm adds probability and prediction; embedding gives V5's rows per query and class."""

    def __init__(self, fitted=None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict_proba(dataset)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, model: TicketClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted.save(f"{path}/fitted")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TicketClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.fitted = classify.KINDS[model.getOrDefault("kind")].load(f"{path}/fitted")
        return model
