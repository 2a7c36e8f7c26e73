"""The views of ``sources.fixtures`` as SQL, for the checking side."""

RAW = """
reviews_raw AS (
  SELECT d.doc_id AS row_id, split_part(d.text, ' ', 1) AS "Title", d.text AS "Review",
         d.source AS "Town", r.r_name AS "Region",
         CASE WHEN d.doc_id % 47 = 0 THEN NULL ELSE d.lang END AS "Type",
         CASE WHEN d.doc_id % 41 = 0 THEN 'n/a' WHEN d.doc_id % 43 = 0 THEN '7'
              WHEN d.doc_id % 53 = 0 THEN '4.7' WHEN d.doc_id % 59 = 0 THEN '0.9'
              ELSE CAST(1 + (d.doc_id * 31 + d.n_chars) % 5 AS VARCHAR(2)) END AS "Polarity"
  FROM documents d JOIN region r ON r.r_regionkey = CAST(substr(d.source, 4) AS INT) % 5
)"""

REVIEWS = RAW + """,
cleaned AS (
  SELECT row_id, "Title", trim(replace("Review", chr(10), ' ')) AS "Review", "Town", "Region",
         "Type", CAST(trunc(TRY_CAST("Polarity" AS DOUBLE)) AS INT) AS "Polarity"
  FROM reviews_raw
  WHERE "Type" IS NOT NULL AND trunc(TRY_CAST("Polarity" AS DOUBLE)) BETWEEN 1 AND 5
),
reviews AS (
  SELECT *, CAST(length("Review") AS INT) AS n_chars,
         CAST(len(regexp_extract_all("Review", '[^\\s]+')) AS INT) AS n_words,
         CAST(len(regexp_extract_all("Review", '[.!?]+')) AS INT) AS n_sents,
         CAST(length("Title") AS INT) AS title_len,
         "Title" || '. ' || "Review" AS full_text
  FROM cleaned
)"""

STATS = """,
stats AS (
  SELECT "Town", arg_min("Region", row_id) AS "Region", count(*) AS n_reviews,
         round_even(avg("Polarity") * 100.0::DOUBLE, 0)::DOUBLE / 100 AS mean_polarity,
         round_even(median("Polarity") * 100.0::DOUBLE, 0)::DOUBLE / 100 AS median_polarity,
         round_even(stddev_samp("Polarity") * 100.0::DOUBLE, 0)::DOUBLE / 100 AS std_polarity,
         round_even(count(*) FILTER ("Polarity" = 5) / count(*) * 100 * 100.0::DOUBLE, 0)::DOUBLE
           / 100 AS pct_5,
         round_even(count(*) FILTER ("Polarity" <= 2) / count(*) * 100 * 100.0::DOUBLE, 0)::DOUBLE
           / 100 AS pct_1_2,
         string_agg(DISTINCT "Type", ', ' ORDER BY "Type") AS types
  FROM reviews GROUP BY "Town"
)"""

VECTORS = """
review_vectors AS (
  SELECT vec_id AS row_id, concat('T', CAST(label AS VARCHAR(3))) AS "Town",
         CAST(1 + vec_id % 5 AS INT) AS "Polarity", embedding::DOUBLE[] AS embedding, label
  FROM embeddings
)"""

VECTOR_REVIEWS = VECTORS + """,
vector_reviews AS (
  SELECT v.row_id, v."Town", r.r_name AS "Region", coalesce(d.lang, 'en') AS "Type",
         v."Polarity", v.embedding
  FROM review_vectors v JOIN region r ON v.label % 5 = r.r_regionkey
       LEFT JOIN documents d ON d.doc_id = v.row_id
)"""

TOPICS = """
review_topics AS (
  SELECT vec_id AS row_id, concat('S', CAST(vec_id % 20 AS VARCHAR(3))) AS "Town",
         CASE WHEN label = 9 THEN -1 ELSE label END AS topic, embedding::DOUBLE[] AS embedding
  FROM embeddings
)"""


def with_views(views: str, select: str) -> str:
    """One statement: the views, any further named steps in ``select``, and the result."""
    select = select.strip()
    if select.startswith(","):
        return f"WITH {views}{select}"
    return f"WITH {views}\n{select}"
