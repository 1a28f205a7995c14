"""Arrow functions that run the kernels on planes held as array columns; many rows a call, no row-at-a-time UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels


def _plane(v, side: int) -> np.ndarray:
    return np.asarray(v, float).reshape(-1, side)


def pair_metric(fn: Callable[[np.ndarray, np.ndarray], float], side: int) -> Callable[[Column, Column], Column]:
    """A column function of two planes (array<double>, rows of `side`), null where either is null."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else fn(_plane(x, side), _plane(y, side)) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def plane_map(fn: Callable[[np.ndarray], np.ndarray], side: int) -> Callable[[Column], Column]:
    """A column function from plane to plane."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(fn(_plane(x, side)), float).ravel())

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")


SIGNALS = "edge_density double, var_laplacian double, noise double, noise_flat double, spectrum double, tenengrad double, local_std double"


def signals(side: int) -> Callable[[Column], Column]:
    """A column function from plane to a struct of SIGNALS."""

    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.signal_battery(_plane(x, side)) for x in v], columns=[f.split()[0] for f in SIGNALS.split(", ")])

    run.__annotations__ = {"v": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, SIGNALS)
