"""8 x 8 blocks: the cosine transform and its inverse, quantizing and choice of class."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tapeframe.functions import bits

#: Steps of the quantizer classes, finest first; levels above the limit do not fit.
STEPS, LIMIT = (1.0, 2.0, 4.0, 8.0), 255


def matrix() -> np.ndarray:
    """64 x 64 orthonormal transform of a block in row order."""
    k = np.arange(8)
    one = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    return np.kron(one, one)


def _transform(m: np.ndarray):
    """A batch of blocks is one matrix product; no built-in function multiplies matrices."""

    @pandas_udf("array<double>")
    def run(blocks: pd.Series) -> pd.Series:
        whole = np.array([b if b is not None else np.zeros(64) for b in blocks], float).reshape(-1, 64) @ m.T
        return pd.Series([None if b is None else w for b, w in zip(blocks, whole)])

    return run


def forward(block: str) -> Column:
    return _transform(matrix())(block)


def inverse(coefficients: str) -> Column:
    return _transform(matrix().T)(coefficients)


def assembled(rows: DataFrame, unit: str, place: str, block: str, mode: str) -> DataFrame:
    """(unit, px): 16 x 16 in row order from blocks 0 to 3 (left to right, then down); null if one is missing or in field mode."""
    parts = rows.groupBy(unit).agg(F.max(mode).alias("field"), *(F.max(F.when(F.col(place) == j, F.col(block))).alias(f"b{j}") for j in range(4)))
    lines = [F.slice(f"b{2 * (y // 8) + half}", 8 * (y % 8) + 1, 8) for y in range(16) for half in (0, 1)]
    return parts.select(unit, F.when(F.col("field") == 0, F.concat(*lines)).alias("px"))


def encoded(rows: DataFrame, coefficients: str) -> DataFrame:
    """Levels of the first class in which all fit, else of the one with the fewest that do not; the DC apart."""
    over = [F.size(F.filter(bits.levels(coefficients, s), lambda x: F.abs(x) > LIMIT)) for s in STEPS]
    rows = rows.withColumn("over", F.array(*over))
    cls = F.array_position("over", F.array_min("over")) - 1
    rows = rows.withColumn("cls", cls.cast("int"))
    step = F.get(F.array(*(F.lit(s) for s in STEPS)), F.col("cls"))
    rows = rows.withColumn("levels", F.transform(coefficients, lambda x: F.rint(x / step).cast("int")))
    dc = F.greatest(F.least(F.bround((F.get(F.col(coefficients), 0) - 1024) / 4, 0), F.lit(255)), F.lit(-256)).cast("int")
    return rows.withColumn("dc", dc).withColumn("saturated", F.array_min("over")).drop("over")
