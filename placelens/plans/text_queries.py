"""Queries over the words of the reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import COMPLAINT_LEXICON, STOPWORDS_ENTITY, STOPWORDS_FREQUENCY
from ..operators import terms, tfidf
from ..operators.counts import review_cells
from ..operators.entities import entity_stats
from ..session import written
from ..sources import fixtures
from .common import rounded
from .views import REVIEWS, STATS, with_views

# The default lexicon is Spanish and hardly occurs in the generated texts, so the queries
# also classify by frequent groups of letters.
LETTER_GROUPS = {"A": ["tion", "ther"], "B": ["eau", "oi"], "C": ["sch", "ich"], "D": ["que", "los"]}
MIN_N = 46


def _cells(s: SparkSession, d: str) -> DataFrame:
    return review_cells(fixtures.reviews(s, d))


def _tokens(s: SparkSession, d: str, column: str, min_len: int, stopwords) -> DataFrame:
    """Number of words per review and the words themselves as one string."""
    words = text.tokenize(column, min_len, stopwords)
    return fixtures.reviews(s, d).select(
        "row_id", F.size(words).alias("n"), F.array_join(words, " ").alias("words")
    )


def _frequency_by_entity(s: SparkSession, d: str) -> DataFrame:
    reviews, cells = fixtures.reviews(s, d), _cells(s, d)
    top = terms.term_frequency_by_entity(reviews, cells, entity_stats(cells, decimals=None))
    return rounded(top)


def _complaints(s: SparkSession, d: str) -> DataFrame:
    return fixtures.reviews(s, d).select(
        "row_id",
        text.classify_complaint("Review", LETTER_GROUPS).alias("letters"),
        text.classify_complaint("Review", COMPLAINT_LEXICON).alias("complaint"),
    )


def _weights(s: SparkSession, d: str) -> DataFrame:
    reviews = fixtures.reviews(s, d)
    counts = written(tfidf.ngram_counts(reviews), "ngrams")
    return written(tfidf.tfidf(counts, tfidf.entity_count(reviews)), "tfidf")


def _discriminative(s: SparkSession, d: str) -> DataFrame:
    n = tfidf.entity_count(fixtures.reviews(s, d))
    return rounded(tfidf.discriminative_terms(_weights(s, d), _cells(s, d), n))


def _top_terms(s: SparkSession, d: str) -> DataFrame:
    cells = _cells(s, d)
    stats = entity_stats(cells, decimals=None)
    return rounded(tfidf.top_terms_per_entity(_weights(s, d), cells, stats))


def _diversity(s: SparkSession, d: str) -> DataFrame:
    return terms.lexical_diversity(fixtures.reviews(s, d))


QUERIES = {
    "d1_tokenize": lambda s, d: _tokens(s, d, "Review", 4, STOPWORDS_FREQUENCY),
    "d2_tokenize_doc": lambda s, d: _tokens(s, d, "full_text", 3, STOPWORDS_ENTITY),
    "d3_term_frequency_by_class": lambda s, d: terms.term_frequency_by_class(
        fixtures.reviews(s, d)
    ),
    "d4_term_frequency_by_entity": _frequency_by_entity,
    "d5_classify_complaint": _complaints,
    "d6_complaint_matrix": lambda s, d: rounded(
        terms.complaint_matrix(fixtures.reviews(s, d), LETTER_GROUPS)
    ),
    "d7_ngrams": lambda s, d: tfidf.ngram_counts(fixtures.reviews(s, d)),
    "d8_tfidf": lambda s, d: rounded(_weights(s, d)),
    "d9_discriminative_terms": _discriminative,
    "d10_top_terms_per_entity": _top_terms,
    "d11_lexical_diversity": lambda s, d: rounded(_diversity(s, d)),
    "d12_lexical_top": lambda s, d: rounded(terms.lexical_top(_diversity(s, d), 9)),
    "d12_lexical_ttr": lambda s, d: rounded(terms.lexical_ttr(_diversity(s, d), MIN_N)),
}


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _word_list(column: str, min_len: int, stopwords) -> str:
    """Replace, split, filter: the definition itself, unlike the regex of the query."""
    replaced = f"regexp_replace(lower({column}), '[^a-záéíóúüñ ]', ' ', 'g')"
    return f"""list_filter(string_split({replaced}, ' '), lambda w:
        length(w) >= {min_len} AND NOT list_contains([{_quoted(stopwords)}], w))"""


_REVIEW_WORDS = _word_list('"Review"', 4, STOPWORDS_FREQUENCY)
_ENTITY_WORDS = _word_list('"Review"', 4, STOPWORDS_ENTITY)
_DOC_WORDS = _word_list("full_text", 3, STOPWORDS_ENTITY)


def _complaint_sql(lexicon) -> str:
    scores = [
        "(" + " + ".join(f"contains(lower(\"Review\"), '{w}')::INT" for w in words) + ")"
        for words in lexicon.values()
    ]
    best = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN {best} = {sc} THEN '{c}'" for sc, c in zip(scores, lexicon))
    return f"CASE WHEN {best} = 0 THEN 'Otro' {cases} END"


# One document per town: its reviews' words in row order, joined before pairing.
_NGRAMS = f""",
docs AS (
  SELECT "Town", flatten(list({_DOC_WORDS} ORDER BY row_id)) AS words
  FROM reviews GROUP BY "Town"
),
grams AS (
  SELECT "Town", unnest(words) AS term FROM docs
  UNION ALL
  SELECT "Town", unnest(list_transform(list_zip(words[:-2], words[2:]),
                                       lambda p: p[1] || ' ' || p[2])) FROM docs
),
ngrams AS (SELECT "Town", term, count(*) AS n FROM grams GROUP BY ALL)"""

_WEIGHTS = _NGRAMS + """,
vocabulary AS (
  SELECT term, count(*) AS df, sum(n) AS total FROM ngrams GROUP BY term
  HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 5000
),
towns AS (SELECT count(DISTINCT "Town")::DOUBLE AS n_towns FROM reviews),
raw_weights AS (
  SELECT "Town", term, n AS tf, (1 + ln(n)) * (ln((1 + n_towns) / (1 + df)) + 1) AS w
  FROM ngrams JOIN vocabulary USING (term), towns
),
weights AS (
  SELECT "Town", term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY "Town")) AS tfidf
  FROM raw_weights
)"""

_TOP_TOWNS = """(SELECT "Town" FROM reviews GROUP BY "Town"
  ORDER BY count(*) DESC, "Town" LIMIT {k})"""

_DIVERSITY = f""",
w AS (SELECT "Town", unnest({_ENTITY_WORDS}) AS term FROM reviews),
diversity AS (
  SELECT t."Town", coalesce(total_words, 0) AS total_words,
         coalesce(unique_words, 0) AS unique_words,
         round(coalesce(unique_words, 0) / greatest(coalesce(total_words, 0), 1), 6) AS ttr,
         n_reviews
  FROM (SELECT "Town", count(*) AS n_reviews FROM reviews GROUP BY 1) t
  LEFT JOIN (SELECT "Town", count(*) AS total_words, count(DISTINCT term) AS unique_words
             FROM w GROUP BY 1) v USING ("Town")
)"""


def _sql(select: str) -> str:
    return with_views(REVIEWS, select)


ORACLE = {
    "d1_tokenize": _sql(
        f"""SELECT row_id, len({_REVIEW_WORDS})::INT AS n,
        array_to_string({_REVIEW_WORDS}, ' ') AS words FROM reviews"""
    ),
    "d2_tokenize_doc": _sql(
        f"""SELECT row_id, len({_DOC_WORDS})::INT AS n,
        array_to_string({_DOC_WORDS}, ' ') AS words FROM reviews"""
    ),
    "d3_term_frequency_by_class": _sql(
        f""", w AS (SELECT CASE WHEN "Polarity" = 5 THEN 'positive' ELSE 'negative' END AS class,
          unnest({_REVIEW_WORDS}) AS term FROM reviews WHERE "Polarity" = 5 OR "Polarity" <= 2),
        c AS (SELECT class, term, count(*) AS n FROM w GROUP BY ALL)
        SELECT class, term, n, CAST(row_number() OVER (PARTITION BY class
          ORDER BY n DESC, term) AS INT) AS rank FROM c QUALIFY rank <= 80"""
    ),
    "d4_term_frequency_by_entity": _sql(
        f""", w AS (SELECT "Town", unnest({_ENTITY_WORDS}) AS term FROM reviews
          WHERE "Town" IN {_TOP_TOWNS.format(k=9)}),
        c AS (SELECT "Town", term, count(*) AS n FROM w GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "Town" ORDER BY n DESC, term)
          AS INT) AS rank FROM c QUALIFY rank <= 60)
        SELECT r.*, s."Region", s.n_reviews, s.mean_polarity FROM r JOIN (
          SELECT "Town", arg_min("Region", row_id) AS "Region", count(*) AS n_reviews,
                 round(avg("Polarity"), 6) AS mean_polarity FROM reviews GROUP BY 1) s
        USING ("Town")"""
    ),
    "d5_classify_complaint": _sql(
        f"""SELECT row_id, {_complaint_sql(LETTER_GROUPS)} AS letters,
        {_complaint_sql(COMPLAINT_LEXICON)} AS complaint FROM reviews"""
    ),
    "d6_complaint_matrix": _sql(
        f""", c AS (SELECT "Town", {_complaint_sql(LETTER_GROUPS)} AS complaint
          FROM reviews WHERE "Polarity" <= 2)
        SELECT "Town", count(*) AS n_negative, """
        + ", ".join(
            f"""round(count(*) FILTER (complaint = '{c}') / count(*) * 100, 6) AS "{c}" """
            for c in [*LETTER_GROUPS, "Otro"]
        )
        + ' FROM c GROUP BY "Town" HAVING count(*) >= 10'
    ),
    "d7_ngrams": _sql(_NGRAMS + ' SELECT "Town", term, n FROM ngrams'),
    "d8_tfidf": _sql(_WEIGHTS + ' SELECT "Town", term, tf, round(tfidf, 6) AS tfidf FROM weights'),
    "d9_discriminative_terms": _sql(
        _WEIGHTS
        + f""",
        variances AS (
          SELECT term, round(sum(tfidf * tfidf) / n_towns - (sum(tfidf) / n_towns) ** 2, 12)
                 AS variance
          FROM weights, towns GROUP BY term, n_towns ORDER BY variance DESC, term DESC LIMIT 30)
        SELECT t."Town", v.term, round(v.variance, 6) AS variance,
               round(coalesce(w.tfidf, 0), 6) AS tfidf
        FROM {_TOP_TOWNS.format(k=20)} t CROSS JOIN variances v
        LEFT JOIN weights w ON w."Town" = t."Town" AND w.term = v.term"""
    ),
    "d10_top_terms_per_entity": _sql(
        _WEIGHTS
        + f""",
        r AS (SELECT "Town", term, tfidf, CAST(row_number() OVER (PARTITION BY "Town"
              ORDER BY round(tfidf, 12) DESC, term) AS INT) AS rank
              FROM weights WHERE "Town" IN {_TOP_TOWNS.format(k=16)} QUALIFY rank <= 8)
        SELECT r."Town", s."Region", s.n_reviews, rank, term, round(tfidf, 6) AS tfidf
        FROM r JOIN (SELECT "Town", arg_min("Region", row_id) AS "Region",
                            count(*) AS n_reviews FROM reviews GROUP BY 1) s USING ("Town")"""
    ),
    "d11_lexical_diversity": _sql(_DIVERSITY + " SELECT * FROM diversity"),
    "d12_lexical_top": _sql(
        _DIVERSITY + ' SELECT * FROM diversity ORDER BY unique_words DESC, "Town" LIMIT 9'
    ),
    "d12_lexical_ttr": _sql(_DIVERSITY + f" SELECT * FROM diversity WHERE n_reviews >= {MIN_N}"),
}
