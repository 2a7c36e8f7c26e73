"""Queries over the reviews: sources, cleaning, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import cleaning, entities, statistics
from ..operators.counts import count_groups, review_cells
from ..session import written
from ..sources import artifacts, fixtures, reviews_csv
from .common import rounded, scratch
from .views import RAW, REVIEWS, STATS, with_views

# Towns have 45 to 46 reviews at the checking size: this keeps some and drops some.
MIN_N = 46


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return review_cells(fixtures.reviews(spark, d))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return entities.entity_stats(_cells(spark, d))


def _read_csv(spark: SparkSession, d: str) -> DataFrame:
    """All raw reviews written as CSV and read back."""
    return reviews_csv.read_reviews_csv(spark, _csv_files(spark, d))


def _csv_files(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "reviews-csv")
    raw = fixtures.reviews_raw(spark, d).drop("row_id")
    raw.write.csv(path, header=True, quote='"', escape='"')
    return path


def _csv_to_stats(spark: SparkSession, d: str) -> DataFrame:
    """From files to statistics: read, number, clean, count, summarise."""
    raw = cleaning.with_row_id(reviews_csv.read_reviews_csv(spark, _csv_files(spark, d)))
    stats = entities.entity_stats(review_cells(cleaning.clean_reviews(raw)))
    return rounded(stats.drop("Region"))


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "artifacts")
    saved = artifacts.load_or_build(spark, path, lambda: {"meta": entities.entity_meta(_cells(spark, d))})
    return rounded(saved["meta"])


def _mojibake(spark: SparkSession, d: str) -> DataFrame:
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    documents = fixtures.table(spark, d, "documents")
    return documents.select("doc_id", text.fix_encoding(broken).alias("text"))


def _clean_review(spark: SparkSession, d: str) -> DataFrame:
    raw = fixtures.reviews_raw(spark, d)
    return raw.select(
        "row_id", text.clean_review("Review").alias("Review"),
        text.clean_review(F.concat("Review", F.lit("... Más \n"))).alias("unmarked"),
    )


def _clipped(spark: SparkSession, d: str) -> DataFrame:
    limits = {"n_words": (400, 500, 600), "n_chars": (2500,)}
    return fixtures.reviews(spark, d).select(
        "row_id",
        *[
            numeric.clip(c, 0, high).alias(f"{c}_{high}")
            for c, highs in limits.items()
            for high in highs
        ],
    )


QUERIES = {
    "a1_read_reviews_csv": lambda s, d: _read_csv(s, d),
    "a2_save_load_artifacts": _artifacts,
    "a5_csv_to_entity_stats": _csv_to_stats,
    "b1_fix_encoding": _mojibake,
    "b2_clean_review": _clean_review,
    "b3_coerce_polarity": lambda s, d: fixtures.reviews_raw(s, d).select(
        "row_id", numeric.coerce_polarity("Polarity").alias("polarity")
    ),
    "b4_drop_missing": lambda s, d: cleaning.drop_missing(
        fixtures.reviews_raw(s, d).withColumn("Polarity", numeric.coerce_polarity("Polarity"))
    ).select("row_id", "Type", "Polarity"),
    "b5_filter_polarity_range": lambda s, d: cleaning.filter_polarity_range(
        fixtures.reviews_raw(s, d).withColumn("Polarity", numeric.coerce_polarity("Polarity"))
    ).select("row_id", "Polarity"),
    "b6_with_row_id": lambda s, d: cleaning.with_row_id(
        fixtures.table(s, d, "documents").select("doc_id", "source")
    ).groupBy("source").agg(
        F.min_by("doc_id", "row_id").alias("first_doc"),
        F.max_by("doc_id", "row_id").alias("last_doc"),
        F.count_distinct("row_id").alias("n"),
    ),
    "b7_text_features": lambda s, d: fixtures.reviews(s, d).select(
        "row_id", "n_chars", "n_words", "n_sents", "title_len"
    ),
    "b8_full_text": lambda s, d: fixtures.reviews(s, d).select("row_id", "full_text"),
    "b9_clean_reviews": lambda s, d: cleaning.cleaning_report(fixtures.reviews_raw(s, d)),
    "b10_clip": _clipped,
    "b11_polarity_weight": lambda s, d: fixtures.reviews(s, d).select(
        "row_id", numeric.polarity_weight("Polarity").alias("weight")
    ),
    "b12_subsets": lambda s, d: fixtures.reviews(s, d).groupBy("Town").agg(
        F.count_if(F.col("Polarity") == 5).alias("n_best"),
        F.count_if(F.col("Polarity") <= 2).alias("n_negative"),
    ),
    "b13_preview": lambda s, d: cleaning.preview(fixtures.reviews(s, d)).select(
        "row_id", "Title", "Review", "Town", "Region", "Type", "Polarity"
    ),
    "c1_dataset_summary": lambda s, d: rounded(statistics.dataset_summary(_cells(s, d))),
    "c2_null_counts": lambda s, d: statistics.null_counts(fixtures.reviews_raw(s, d)),
    "c3_polarity_distribution": lambda s, d: rounded(
        statistics.polarity_distribution(_cells(s, d))
    ),
    "c4_polarity_by_type": lambda s, d: rounded(statistics.polarity_by_type(_cells(s, d))),
    "c5_boxplot_stats": lambda s, d: _boxplots(s, d),
    "c6_describe_by_type": lambda s, d: rounded(statistics.describe_by_type(_cells(s, d))),
    "c7_type_share": lambda s, d: rounded(statistics.type_share(_cells(s, d))),
    "c8_region_by_type": lambda s, d: statistics.region_by_type(_cells(s, d)),
    "c9_histogram_words": lambda s, d: rounded(
        statistics.histogram(fixtures.reviews(s, d), "n_words", 0, 400)
    ),
    "c9_histogram_chars": lambda s, d: rounded(
        statistics.histogram(fixtures.reviews(s, d), "n_chars", 0, 2500)
    ),
    "c10_mean_median_markers": lambda s, d: rounded(
        statistics.mean_median_markers(fixtures.reviews(s, d))
    ),
    "c11_mean_words_by_polarity": lambda s, d: rounded(
        statistics.mean_words_by_polarity(fixtures.reviews(s, d))
    ),
    "c12_describe": lambda s, d: rounded(statistics.describe(fixtures.reviews(s, d))),
    "c13_entity_stats": lambda s, d: rounded(_stats(s, d)),
    "c14_entity_meta": lambda s, d: rounded(entities.entity_meta(_cells(s, d))),
    "c15_top_by_volume": lambda s, d: entities.top_by_volume(_stats(s, d)).select(
        "Town", "n_reviews"
    ),
    "c16_top_by_mean": lambda s, d: rounded(
        entities.top_by_mean(_stats(s, d), min_n=MIN_N).select("Town", "mean_polarity")
    ),
    "c17_bottom_by_mean": lambda s, d: rounded(
        entities.bottom_by_mean(_stats(s, d)).select("Town", "mean_polarity")
    ),
    "c18_volume_vs_quality": lambda s, d: rounded(entities.volume_vs_quality(_stats(s, d))),
    "c19_entity_index": lambda s, d: entities.entity_index(fixtures.reviews(s, d)),
    "c20_rank_entities_by_count": lambda s, d: entities.rank_entities_by_count(_cells(s, d), 9),
    "c21_words_vs_polarity_points": lambda s, d: statistics.words_vs_polarity_points(
        fixtures.reviews(s, d)
    ),
}


def _boxplots(spark: SparkSession, d: str) -> DataFrame:
    """The three box plots as one frame, from one scan of the reviews."""
    clipped = numeric.clip("n_words", 0, 500).alias("n_words")
    cells = written(count_groups(fixtures.reviews(spark, d), "Type", "Polarity", clipped), "boxplot-cells")
    plots = [("Polarity", "Type"), ("n_words", "Type"), ("n_words", "Polarity")]
    frames = [
        statistics.boxplot_of_counts(cells, by, value).select(
            F.lit(f"{value} by {by}").alias("plot"), F.col(by).cast("string").alias("grp"),
            "size", "q1", "median", "q3",
            F.col("whisker_low").cast("double").alias("whisker_low"),
            F.col("whisker_high").cast("double").alias("whisker_high"), "outliers",
        )
        for value, by in plots
    ]
    return rounded(frames[0].unionByName(frames[1]).unionByName(frames[2]))


def _boxplot_sql(value: str, by: str, name: str) -> str:
    return f"""
  SELECT '{name}' AS plot, grp, count(*) AS size, q1, median, q3,
         least(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), q1)::DOUBLE AS whisker_low,
         greatest(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), q3)::DOUBLE AS whisker_high,
         count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM (SELECT CAST("{by}" AS VARCHAR) AS grp, {value} AS v,
               quantile_cont({value}, 0.25) OVER w AS q1,
               quantile_cont({value}, 0.5) OVER w AS median,
               quantile_cont({value}, 0.75) OVER w AS q3
        FROM reviews WINDOW w AS (PARTITION BY "{by}"))
  GROUP BY grp, q1, median, q3"""


def _describe_sql(column: str) -> str:
    return f"""
  SELECT '{column}' AS metric, count(*) AS count, round(avg({column}), 6) AS mean,
         round(stddev_samp({column}), 6) AS std, min({column})::BIGINT AS min,
         round(quantile_cont({column}, 0.25), 6) AS p25, round(median({column}), 6) AS p50,
         round(quantile_cont({column}, 0.75), 6) AS p75, max({column})::BIGINT AS max
  FROM reviews"""


def _histogram_sql(column: str, high: int) -> str:
    return f"""
, v AS (SELECT least(greatest({column}, 0), {high}) AS x FROM reviews),
m AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5::DOUBLE ELSE min(x)::DOUBLE END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5::DOUBLE ELSE max(x)::DOUBLE END AS hi
      FROM v),
placed AS (SELECT least(floor((x - lo) * 60 / (hi - lo)), 59)::INT AS bin, count(*) AS n
           FROM v, m GROUP BY 1)
SELECT b.bin::INT AS bin, round(lo + b.bin * (hi - lo) / 60, 6) AS bin_start,
       coalesce(n, 0) AS n
FROM (SELECT unnest(range(60)) AS bin) b CROSS JOIN m LEFT JOIN placed p ON p.bin = b.bin"""


def _top_sql(columns: str, where: str, order: str, k: int) -> str:
    return with_views(
        REVIEWS + STATS, f"SELECT {columns} FROM stats WHERE {where} ORDER BY {order} LIMIT {k}"
    )


def _review_sql(select: str) -> str:
    return with_views(REVIEWS, select)


ORACLE = {
    "a1_read_reviews_csv": with_views(
        RAW, """SELECT "Title", "Review", "Town", "Region", "Type",
        CASE WHEN "Polarity" <> 'n/a' THEN "Polarity" END AS "Polarity" FROM reviews_raw"""
    ),
    "a2_save_load_artifacts": None,  # set below: same as c14
    "b1_fix_encoding": "SELECT doc_id, text FROM documents",
    "b2_clean_review": with_views(
        RAW, """SELECT row_id, trim(replace("Review", chr(10), ' ')) AS "Review",
        trim(replace("Review", chr(10), ' ')) AS unmarked FROM reviews_raw"""
    ),
    "b3_coerce_polarity": with_views(
        RAW, """SELECT row_id, CAST(trunc(TRY_CAST("Polarity" AS DOUBLE)) AS INT) AS polarity
        FROM reviews_raw"""
    ),
    "b4_drop_missing": with_views(
        RAW, """SELECT row_id, "Type", CAST(trunc(TRY_CAST("Polarity" AS DOUBLE)) AS INT)
        AS "Polarity" FROM reviews_raw
        WHERE "Type" IS NOT NULL AND TRY_CAST("Polarity" AS DOUBLE) IS NOT NULL"""
    ),
    "b5_filter_polarity_range": with_views(
        RAW, """SELECT row_id, CAST(trunc(TRY_CAST("Polarity" AS DOUBLE)) AS INT) AS "Polarity"
        FROM reviews_raw WHERE trunc(TRY_CAST("Polarity" AS DOUBLE)) BETWEEN 1 AND 5"""
    ),
    "b6_with_row_id": """SELECT source, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
        count(*) AS n FROM documents GROUP BY source""",
    "b7_text_features": _review_sql(
        "SELECT row_id, n_chars, n_words, n_sents, title_len FROM reviews"
    ),
    "b8_full_text": _review_sql("SELECT row_id, full_text FROM reviews"),
    "b9_clean_reviews": _review_sql(
        """SELECT b AS rows_before, a AS rows_after, b - a AS rows_removed
        FROM (SELECT count(*) AS b FROM reviews_raw), (SELECT count(*) AS a FROM reviews)"""
    ),
    "b10_clip": _review_sql(
        """SELECT row_id, least(greatest(n_words, 0), 400) AS n_words_400,
        least(greatest(n_words, 0), 500) AS n_words_500,
        least(greatest(n_words, 0), 600) AS n_words_600,
        least(greatest(n_chars, 0), 2500) AS n_chars_2500 FROM reviews"""
    ),
    "b11_polarity_weight": _review_sql(
        """SELECT row_id, CASE "Polarity" WHEN 1 THEN 0.2 WHEN 2 THEN 0.4 WHEN 3 THEN 0.6
        WHEN 4 THEN 0.8 ELSE 1.0 END::DOUBLE AS weight FROM reviews"""
    ),
    "b12_subsets": _review_sql(
        """SELECT "Town", count(*) FILTER ("Polarity" = 5) AS n_best,
        count(*) FILTER ("Polarity" <= 2) AS n_negative FROM reviews GROUP BY "Town" """
    ),
    "b13_preview": _review_sql(
        """SELECT row_id, "Title", "Review", "Town", "Region", "Type", "Polarity"
        FROM reviews ORDER BY row_id LIMIT 3"""
    ),
    "c1_dataset_summary": _review_sql(
        """SELECT count(*) AS n_reviews, count(DISTINCT "Town") AS n_towns,
        count(DISTINCT "Region") AS n_regions,
        string_agg(DISTINCT "Type", ', ' ORDER BY "Type") AS types,
        min("Polarity") AS min_polarity, max("Polarity") AS max_polarity,
        round(avg("Polarity"), 6) AS mean_polarity,
        round(median("Polarity"), 6) AS median_polarity FROM reviews"""
    ),
    "c2_null_counts": with_views(
        RAW,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) FILTER ("{c}" IS NULL) AS nulls
            FROM reviews_raw"""
            for c in ["row_id", *cleaning.REVIEW_COLUMNS]
        ),
    ),
    "c3_polarity_distribution": _review_sql(
        """SELECT "Polarity", count(*) AS n,
        round(count(*) / sum(count(*)) OVER () * 100, 6)::DOUBLE AS pct
        FROM reviews GROUP BY "Polarity" """
    ),
    "c4_polarity_by_type": _review_sql(
        'SELECT "Type", '
        + ", ".join(f'count(*) FILTER ("Polarity" = {p}) AS n_{p}' for p in range(1, 6))
        + ", "
        + ", ".join(
            f'round(count(*) FILTER ("Polarity" = {p}) / count(*) * 100, 6) AS pct_{p}'
            for p in range(1, 6)
        )
        + ' FROM reviews GROUP BY "Type"'
    ),
    "c5_boxplot_stats": _review_sql(
        "SELECT plot, grp, size, round(q1, 6) AS q1, round(median, 6) AS median,"
        " round(q3, 6) AS q3, round(whisker_low, 6) AS whisker_low,"
        " round(whisker_high, 6) AS whisker_high, outliers FROM ("
        + " UNION ALL ".join(
            [
                _boxplot_sql('"Polarity"', "Type", "Polarity by Type"),
                _boxplot_sql("least(n_words, 500)", "Type", "n_words by Type"),
                _boxplot_sql("least(n_words, 500)", "Polarity", "n_words by Polarity"),
            ]
        )
        + ")"
    ),
    "c6_describe_by_type": _review_sql(
        """SELECT "Type", count(*) AS n, round(avg("Polarity"), 6) AS mean_polarity,
        round(median("Polarity"), 6) AS median_polarity,
        round(stddev_samp("Polarity"), 6) AS std_polarity FROM reviews GROUP BY "Type" """
    ),
    "c7_type_share": _review_sql(
        """SELECT "Type", count(*) AS n,
        round(count(*) / sum(count(*)) OVER () * 100, 6)::DOUBLE AS pct
        FROM reviews GROUP BY "Type" """
    ),
    "c8_region_by_type": _review_sql(
        """SELECT "Region", "Type", count(*) AS n,
        CAST(sum(count(*)) OVER (PARTITION BY "Region") AS BIGINT) AS total FROM reviews GROUP BY "Region", "Type" """
    ),
    "c9_histogram_words": _review_sql(_histogram_sql("n_words", 400)),
    "c9_histogram_chars": _review_sql(_histogram_sql("n_chars", 2500)),
    "c10_mean_median_markers": _review_sql(
        """SELECT round(median(n_words), 6) AS median_words, round(avg(n_words), 6) AS mean_words,
        round(median(n_chars), 6) AS median_chars FROM reviews"""
    ),
    "c11_mean_words_by_polarity": _review_sql(
        'SELECT "Polarity", round(avg(n_words), 6) AS mean_words FROM reviews GROUP BY "Polarity"'
    ),
    "c12_describe": _review_sql(
        " UNION ALL ".join(_describe_sql(c) for c in ("n_chars", "n_words", "n_sents"))
    ),
    "a5_csv_to_entity_stats": with_views(REVIEWS + STATS, 'SELECT * EXCLUDE ("Region") FROM stats'),
    "c13_entity_stats": with_views(REVIEWS + STATS, "SELECT * FROM stats"),
    "c14_entity_meta": _review_sql(
        """SELECT "Town", arg_min("Region", row_id) AS "Region", count(*) AS n_reviews,
        round(avg("Polarity"), 6) AS avg_polarity,
        round(count(*) FILTER ("Polarity" = 5) / count(*) * 100, 6) AS pct_5,
        round(count(*) FILTER ("Polarity" <= 2) / count(*) * 100, 6) AS pct_neg,
        string_agg(DISTINCT "Type", ' / ' ORDER BY "Type") AS tipos
        FROM reviews GROUP BY "Town" """
    ),
    "c15_top_by_volume": _top_sql('"Town", n_reviews', "true", 'n_reviews DESC, "Town"', 20),
    "c16_top_by_mean": _top_sql(
        '"Town", mean_polarity', f"n_reviews >= {MIN_N}", 'mean_polarity DESC, "Town"', 20
    ),
    "c17_bottom_by_mean": _top_sql(
        '"Town", mean_polarity', "n_reviews >= 10", 'mean_polarity, "Town"', 15
    ),
    "c18_volume_vs_quality": with_views(
        REVIEWS + STATS,
        """SELECT "Town", n_reviews, mean_polarity,
        round(coalesce(std_polarity, 0.5) * 200 + 20, 6) AS mark_size
        FROM stats WHERE n_reviews >= 5""",
    ),
    "c19_entity_index": _review_sql(
        """SELECT "Town", row_number() OVER (ORDER BY "Town") - 1 AS entity_idx
        FROM (SELECT DISTINCT "Town" FROM reviews)"""
    ),
    "c20_rank_entities_by_count": _review_sql(
        """SELECT "Town", count(*) AS n_reviews FROM reviews GROUP BY "Town"
        ORDER BY n_reviews DESC, "Town" LIMIT 9"""
    ),
    "c21_words_vs_polarity_points": _review_sql(
        'SELECT row_id, "Polarity", least(greatest(n_words, 0), 600) AS n_words FROM reviews'
    ),
}
ORACLE["a2_save_load_artifacts"] = ORACLE["c14_entity_meta"]
