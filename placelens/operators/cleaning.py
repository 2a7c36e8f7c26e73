"""From raw all-string reviews to typed, filtered, feature-bearing reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import numeric, text

REVIEW_COLUMNS = ["Title", "Review", "Town", "Region", "Type", "Polarity"]


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add an id that follows file names and the order of rows in a file, for rows straight
    from a file source. Spark packs files into tasks by size, so the order of the scan is
    another one. Only the order of ids is ever used; they have gaps. Write the result before
    sampling from it more than once."""
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    located = df.select("*", file.alias("_file"), block.alias("_block"), position.alias("_at"))
    splits = df.select(file.alias("_file"), block.alias("_block")).distinct()
    order = F.row_number().over(Window.orderBy("_file", "_block"))  # one row a split
    numbered = splits.select("_file", "_block", F.shiftleft(order.cast("long"), 33).alias("_split"))
    return located.join(numbered, ["_file", "_block"]).select(
        *df.columns, (F.col("_split") + F.col("_at")).alias(name)
    )


def clean_text_columns(df: DataFrame) -> DataFrame:
    """Repair the four text columns; only the review is also cleaned and trimmed."""
    return df.withColumns(
        {
            "Title": text.fix_encoding("Title"),
            "Review": text.clean_review("Review"),
            "Town": text.fix_encoding("Town"),
            "Region": text.fix_encoding("Region"),
        }
    )


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows lacking a critical value. After text repair, which maps null to '', only
    ``Polarity`` and ``Type`` can still be null; empty reviews and towns survive."""
    return df.na.drop(subset=columns or ["Polarity", "Town", "Type", "Review"])


def filter_polarity_range(df: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    return df.where(F.col("Polarity").between(low, high))


def text_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "n_chars": text.n_chars("Review"),
            "n_words": text.n_words("Review"),
            "n_sents": text.n_sentences("Review"),
            "title_len": text.n_chars("Title"),
        }
    )


def with_full_text(df: DataFrame) -> DataFrame:
    return df.withColumn("full_text", text.full_text("Title", "Review"))


def clean_reviews(raw: DataFrame, observation: Observation | None = None) -> DataFrame:
    """All of the above as one map-side projection and filter: no shuffle, and columns a
    later step does not read are pruned together with the work to compute them.

    The row filter needs only ``Type`` and ``Polarity``, so it runs before any text work.
    ``observation`` receives ``rows_before`` from the first action on the result.
    """
    if observation is not None:
        raw = raw.observe(observation, F.count(F.lit(1)).alias("rows_before"))
    typed = raw.withColumn("Polarity", numeric.coerce_polarity("Polarity"))
    kept = filter_polarity_range(drop_missing(typed, ["Polarity", "Type"]))
    return with_full_text(text_features(clean_text_columns(kept)))


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Rows before, after and removed by cleaning, in one scan of two narrow columns."""
    polarity = numeric.coerce_polarity("Polarity")
    kept = F.count_if(F.col("Type").isNotNull() & polarity.between(1, 5))
    return raw.agg(F.count(F.lit(1)).alias("rows_before"), kept.alias("rows_after")).withColumn(
        "rows_removed", F.col("rows_before") - F.col("rows_after")
    )


def preview(df: DataFrame, n: int = 3, order: str = "row_id") -> DataFrame:
    """First ``n`` rows in row order."""
    return df.orderBy(order).limit(n)
