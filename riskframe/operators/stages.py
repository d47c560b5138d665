"""Fitted operators as Spark ML stages.

The label dictionary, the scaler and the dense network as ``Estimator`` and
``Model`` with writers and readers, so that a whole preparation and scoring
chain is one ``Pipeline`` that is saved and loaded like any other.  The models
keep what they need as a table (dictionary) or as parameters (numbers); scoring
after loading never fits anything again.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from riskframe.operators import minibatch
from riskframe.operators.dictionaries import LabelDictionary, fit_label_dictionary
from riskframe.operators.encoders import Standardization, fit_standard_scaler
from riskframe.operators.scoring import MLP, score


class _Columns(Params):
    """The columns a stage works on."""

    columns = Param(Params._dummy(), "columns", "columns to work on, in order",
                    TypeConverters.toListString)

    def getColumns(self) -> list[str]:
        return self.getOrDefault(self.columns)


# ------------------------------------------------------------------ label dictionary
class LabelDictionaryEstimator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a dictionary of sorted values per column."""

    handleInvalid = Param(Params._dummy(), "handleInvalid", "keep or error", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, handleInvalid: str = "keep") -> None:
        super().__init__()
        self._setDefault(columns=[], handleInvalid="keep")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "LabelDictionaryModel":
        fitted = fit_label_dictionary(dataset, self.getColumns(),
                                      self.getOrDefault(self.handleInvalid))
        return LabelDictionaryModel(fitted)


class LabelDictionaryModel(Model, _Columns, MLReadable, MLWritable):
    """Replaces values by their codes."""

    def __init__(self, dictionary: LabelDictionary) -> None:
        super().__init__()
        self.dictionary = dictionary
        self._set(columns=list(dictionary.sizes))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.dictionary.transform(dataset, self.getColumns())

    def write(self) -> MLWriter:
        return _DictionaryWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DictionaryReader(cls)


class _DictionaryWriter(MLWriter):
    def __init__(self, instance: LabelDictionaryModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.dictionary.save(f"{path}/dictionary")


class _DictionaryReader(MLReader):
    def __init__(self, cls) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LabelDictionaryModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(LabelDictionary.load(self.sparkSession, f"{path}/dictionary"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


# ------------------------------------------------------------------ scaler
class StandardizationEstimator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits means and population deviations."""

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None) -> None:
        super().__init__()
        self._setDefault(columns=[])
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "StandardizationModel":
        fitted = fit_standard_scaler(dataset, self.getColumns())
        return StandardizationModel(columns=self.getColumns(), numbers=fitted.to_json())


class StandardizationModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Scales the columns in place."""

    numbers = Param(Params._dummy(), "numbers", "means and deviations", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, numbers: str = "{}") -> None:
        super().__init__()
        self._setDefault(columns=[], numbers="{}")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return Standardization.from_json(self.getOrDefault(self.numbers)).transform(
            dataset, self.getColumns())


# ------------------------------------------------------------------ dense network
class DenseNetworkEstimator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Trains a dense network of sigmoid or relu layers by mini-batches (M2-M4).
    The input holds a label, a key and a split column with train and val rows."""

    label = Param(Params._dummy(), "label", "label column, 0 or 1", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "key column", TypeConverters.toString)
    split = Param(Params._dummy(), "split", "split column", TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "units per hidden layer", TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "sigmoid or relu", TypeConverters.toString)
    limits = Param(Params._dummy(), "limits", "epochs, batch, lr, patience and more, as JSON",
                   TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, label: str = "label", key: str = "id",
                 split: str = "split", hidden: list[int] | None = None, activation: str = "relu",
                 limits: str = "{}") -> None:
        super().__init__()
        self._setDefault(columns=[], label="label", key="id", split="split", hidden=[10],
                         activation="relu", limits="{}")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "DenseNetworkModel":
        get = self.getOrDefault
        config = {"hidden": get(self.hidden), "activation": get(self.activation)}
        trained, = minibatch.train_shared(
            dataset, self.getColumns(), get(self.label), [config], get(self.key),
            split_col=get(self.split), **json.loads(get(self.limits)))
        return DenseNetworkModel(columns=self.getColumns(), network=trained.model.to_json())


class DenseNetworkModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction`` (M6)."""

    network = Param(Params._dummy(), "network", "weights and activations, as JSON",
                    TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "least probability of class 1",
                      TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, network: str = "{}",
                 threshold: float = 0.5) -> None:
        super().__init__()
        self._setDefault(columns=[], network="{}", threshold=0.5)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return score(dataset, MLP.from_json(self.getOrDefault(self.network)), self.getColumns(),
                     t=self.getOrDefault(self.threshold))
