"""Hooks for models that the caller brings: batches go through Arrow, weights are never part of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predictor(load: Callable[[], Callable[[np.ndarray], np.ndarray]]):
    """A pandas UDF array<double> -> array<double>; load runs once a worker and returns a function of rows."""

    @F.pandas_udf("array<double>")
    def predict(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in it:
            yield pd.Series(list(model(np.stack(s.to_list()))) if len(s) else [])

    return predict


def sigmoid_mean(logits: Column) -> Column:
    """Probability of several views of a pixel: the mean of logits, then the sigmoid."""
    n = F.size(logits)
    return 1 / (1 + F.exp(-F.aggregate(logits, F.lit(0.0), lambda a, v: a + v) / n))


def fold_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of a value over folds, by keys."""
    return rows.groupBy(*keys).agg(F.avg(value).alias(value))
