"""Text to unit vectors with a model supplied by the user."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType


def embed_text(
    df: DataFrame,
    text: str,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    output: str = "embedding",
    batch_size: int = 64,
    normalize: bool = True,
) -> DataFrame:
    """Add a vector per text. ``make_model`` runs once per Python worker and returns a
    function from a batch of strings to a matrix with one row per string."""

    def make_predict() -> Callable[[np.ndarray], np.ndarray]:
        encode = make_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            matrix = np.asarray(encode(texts), dtype="float64")
            if normalize:
                length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                matrix = matrix / np.where(length > 0, length, 1.0)
            return matrix.astype("float32")

        return predict

    encode = predict_batch_udf(
        make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size
    )
    return df.withColumn(output, encode(text))
