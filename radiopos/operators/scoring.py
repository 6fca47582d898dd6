"""Distributed scoring with a user-supplied predictor."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import tables

PREDICTION = "crop_id long, heatmap array<float>"


def score(samples: DataFrame, predictor: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], splits: list[str] | None = None, schema: str = PREDICTION) -> DataFrame:
    """Predictions for the samples of the chosen splits. predictor() is called once a task and returns a function from
    a batch of samples to rows of the schema."""
    chosen = samples if splits is None else samples.filter(F.col("split").isin(splits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = predictor()
        for b in batches:
            yield predict(b)

    return chosen.mapInPandas(run, schema)


#: Models of this worker, by the run that made them.
_MODELS: dict[str, Callable[[pd.DataFrame], np.ndarray]] = {}


def _loaded(run_id: str, model: Callable[[], Callable[[pd.DataFrame], np.ndarray]]) -> Callable[[pd.DataFrame], np.ndarray]:
    """The model of a run in this worker. Tasks reach it by this function's name: their own globals are copies."""
    if run_id not in _MODELS:
        _MODELS.clear()
        _MODELS[run_id] = model()
    return _MODELS[run_id]


_CARRIED = ("crop_id", "ue_y", "ue_x", "original_img_size", "center_lat", "center_lon", "domain", "difficulty")


def predictions(samples: DataFrame, model: Callable[[], Callable[[pd.DataFrame], np.ndarray]], inputs: list[str], splits: list[str] | None = None) -> DataFrame:
    """Prediction rows (tables.PREDICTIONS): the heat map that the model gives for each sample's inputs, with the sample's key,
    true place and map. model() loads a model, once a worker process; what it returns turns a batch of the inputs into an
    array of one flat heat map a row. splits: the difficulties to score."""
    chosen = samples if splits is None else samples.filter(F.col("difficulty").isin(splits))
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _loaded(run_id, model)
        for b in batches:
            maps = np.ascontiguousarray(predict(b.select(inputs).to_pandas()), np.float32)
            if len(maps) != b.num_rows:
                raise ValueError(f"the model gave {len(maps)} heat maps for {b.num_rows} samples")
            ends = pa.array(np.arange(0, maps.size + 1, max(1, maps.shape[1] if maps.size else 1), dtype=np.int32))
            heat = pa.ListArray.from_arrays(ends, pa.array(maps.ravel())) if maps.size else pa.array([[]] * len(maps), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _CARRIED), heat], [*_CARRIED, "heatmap"])

    types = dict(samples.select(*_CARRIED).dtypes)
    rows = chosen.select(*_CARRIED, *(c for c in inputs if c not in _CARRIED)).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in _CARRIED) + ", heatmap array<float>")
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(tables.PREDICTIONS).fields))


def score_to(samples: DataFrame, model: Callable[[], Callable[[pd.DataFrame], np.ndarray]], inputs: list[str], path: str, splits: list[str] | None = None) -> DataFrame:
    """Writes the predictions by domain and difficulty and reads them back."""
    tables.write_predictions(predictions(samples, model, inputs, splits), path)
    return tables.read_predictions(samples.sparkSession, path)


def center_predictor(size: int) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """The baseline that always answers the middle of the map."""

    def make():
        flat = [0.0] * (size * size)
        flat[(size // 2) * size + size // 2] = 1.0
        return lambda b: pd.DataFrame({"crop_id": b["crop_id"], "heatmap": [flat] * len(b)})

    return make
