"""Tables of recommendation requests and the values shown for their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as fixed
from ..functions.text import strip_blanks


def validate_queries(
    queries: DataFrame, query: str = "query", min_len: int = fixed.QUERY_MIN_LENGTH
) -> tuple[DataFrame, DataFrame]:
    """(accepted with trimmed text, rejected with an ``error``)."""
    trimmed = queries.withColumn(query, strip_blanks(F.coalesce(query, F.lit(""))))
    valid = F.char_length(query) >= min_len
    return (
        trimmed.where(valid),
        trimmed.where(~valid).withColumn("error", F.lit(fixed.QUERY_ERROR)),
    )


def present_recommendations(recommendations: DataFrame) -> DataFrame:
    """Bar length in percent, whole stars and the reading of the mixing weight."""
    bar = (F.col("similitud") - fixed.BAR_START) / (1.0 - fixed.BAR_START) * 100
    return recommendations.withColumns(
        {
            "bar_pct": F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), bar))).cast("int"),
            "stars": F.floor(F.col("polarity") + 0.5).cast("int"),
            "alpha_label": F.when(F.col("alpha") >= fixed.ALPHA_CONTENT, fixed.LABEL_CONTENT)
            .when(F.col("alpha") <= fixed.ALPHA_COLLABORATIVE, fixed.LABEL_COLLABORATIVE)
            .otherwise(fixed.LABEL_BALANCED),
        }
    )
