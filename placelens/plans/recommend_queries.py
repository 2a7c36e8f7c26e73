"""Queries over review vectors: profiles, neighbours, recommendation, evaluation, clusters, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import clustering, evaluation, hybrid, maps, neighbours, pivots, profiles, requests, sampling, topics
from ..operators.counts import review_cells
from ..operators.entities import entity_meta
from ..sources import artifacts, fixtures
from .common import long_vectors, rounded, scratch
from .views import TOPICS, VECTOR_REVIEWS, with_views

# The published sizes of samples, lists and restarts, and the number of topics.
PER_ENTITY, FIRST_N, CORPUS, EVALUATION, BALANCED, TOP, K = 100, 150, 8_000, 800, 200, 5, 20
STARTS, TOPIC_COUNT = 15, 19


def _reviews(s: SparkSession, d: str) -> DataFrame:
    return fixtures.vector_reviews(s, d)


def _queries(s: SparkSession, d: str) -> DataFrame:
    return _reviews(s, d).select(F.col("row_id").alias("query_id"), "embedding")


def _profiles(s: SparkSession, d: str) -> DataFrame:
    return profiles.entity_profile_stratified(_reviews(s, d), PER_ENTITY)


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_corpus(_reviews(s, d), CORPUS)


def _near(s: SparkSession, d: str, queries: DataFrame | None = None) -> DataFrame:
    return neighbours.knn(queries if queries is not None else _queries(s, d), _corpus(s, d), K + 1)


def _cells(s: SparkSession, d: str) -> DataFrame:
    return review_cells(_reviews(s, d))


def _alphas(s: SparkSession, d: str) -> DataFrame:
    return hybrid.dynamic_alpha(_cells(s, d))


def _recommended(s: SparkSession, d: str, decimals: bool = False) -> DataFrame:
    return hybrid.recommend(
        _queries(s, d), _corpus(s, d), _profiles(s, d), _alphas(s, d), entity_meta(_cells(s, d)),
        top_n=TOP, k=K, decimals=decimals,
    )


def _own_topics(s: SparkSession, d: str) -> DataFrame:
    """Explained topics of the towns that are recommended, from the topics of their own reviews."""
    said = _topics(s, d).drop("Town").join(_reviews(s, d).select("row_id", "Town"), "row_id")
    return topics.topic_explanation(topics.topic_distribution(said), _topic_words(s, d))


def _explained(s: SparkSession, d: str) -> DataFrame:
    """Recommendations with the cluster, its colour and the explained topics of each town; a town without topics
    has an empty list or null."""
    return hybrid.recommend(
        _queries(s, d), _corpus(s, d), _profiles(s, d), _alphas(s, d), entity_meta(_cells(s, d)),
        clusters=_assigned(s, d), topics=_own_topics(s, d), top_n=TOP, k=K,
    )


def _scored(s: SparkSession, d: str) -> DataFrame:
    votes = hybrid.neighbour_vote(_near(s, d))
    scored = hybrid.score_hybrid(_queries(s, d), votes, _profiles(s, d), _alphas(s, d), TOP)
    return hybrid.rank_recommendations(scored, TOP)


def _ranks(s: SparkSession, d: str) -> DataFrame:
    chosen = sampling.evaluation_set(_reviews(s, d), EVALUATION)
    queries = chosen.select(F.col("row_id").alias("query_id"), F.col("Town").alias("truth"), "embedding")
    votes = hybrid.neighbour_vote(_near(s, d, queries))
    return hybrid.truth_ranks(queries, votes, _profiles(s, d), _alphas(s, d))


def _record(s: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(_ranks(s, d))


def _metrics_file(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "metrics")
    artifacts.write_metrics(_record(s, d), path)
    return rounded(artifacts.read_metrics(s, path))


def _requests(s: SparkSession, d: str) -> DataFrame:
    asked = fixtures.reviews_raw(s, d).select("row_id", F.concat(F.lit(" "), F.col("Title"), F.lit("\t")).alias("query"))
    accepted, rejected = requests.validate_queries(asked)
    return accepted.withColumn("error", F.lit(None).cast("string")).unionByName(rejected)


def _topics(s: SparkSession, d: str) -> DataFrame:
    return fixtures.review_topics(s, d)


def _distribution(s: SparkSession, d: str) -> DataFrame:
    return topics.topic_distribution(_topics(s, d))


def _topic_words(s: SparkSession, d: str) -> DataFrame:
    documents = fixtures.table(s, d, "documents").select("doc_id", "text")
    said = _topics(s, d).join(documents, F.col("row_id") == F.col("doc_id")).select("topic", "text")
    return topics.topic_terms(topics.topic_term_counts(said))


def _topic_files(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "topics")
    artifacts.save_topics(path, _topics(s, d), _topic_words(s, d), _distribution(s, d))
    loaded = artifacts.load_topics(s, path)
    return rounded(loaded["distribution"].join(
        loaded["assigned"].groupBy("Town").agg(F.count("*").alias("n_reviews")), "Town"
    ))


def _town_topics(s: SparkSession, d: str) -> DataFrame:
    """Profiles of the towns that have topics."""
    return profiles.mean_vector(_topics(s, d))


def _features(s: SparkSession, d: str) -> DataFrame:
    return clustering.to_features(_profiles(s, d))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    return clustering.sweep_table(s, clustering.sweep(_features(s, d), n_init=STARTS))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    features = _features(s, d)
    return clustering.kmeans_restarts(features, 3, STARTS).assign(features)


def _silhouette(s: SparkSession, d: str) -> DataFrame:
    labelled = fixtures.review_vectors(s, d).select(
        F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster")
    )
    score = clustering.silhouette_cosine(labelled)
    return rounded(s.createDataFrame([(float(score),)], "silhouette double"))


def _compared(s: SparkSession, d: str) -> DataFrame:
    plain = _town_topics(s, d)
    enriched = topics.enriched_profile(plain, _distribution(s, d))
    return clustering.compare_clusterings(
        {"plain": clustering.to_features(plain), "topics": clustering.to_features(enriched)}, k_max=10, n_init=STARTS
    )


def _map(s: SparkSession, d: str) -> DataFrame:
    """The three frames under one another."""
    frames = maps.entity_map_2d(_profiles(s, d), _queries(s, d), _assigned(s, d), _recommended(s, d))
    towns, users, marks = (df.withColumn("frame", F.lit(name)) for df, name in zip(frames, ("entity", "query", "mark"), strict=True))
    return towns.unionByName(users, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)


QUERIES = {
    "a3_metrics_file": _metrics_file,
    "a4_topic_files": _topic_files,
    "e2_l2_normalize": lambda s, d: rounded(long_vectors(
        _reviews(s, d).select("row_id", vectors.l2_normalize("embedding").alias("unit")), ["row_id"], "unit")),
    "e3_profile_first_n": lambda s, d: rounded(long_vectors(
        profiles.entity_profile_first_n(_reviews(s, d), FIRST_N), ["Town"], "profile")),
    "e4_profile_stratified": lambda s, d: rounded(long_vectors(_profiles(s, d), ["Town"], "profile")),
    "e5_cosine_search": lambda s, d: rounded(neighbours.cosine_search(_queries(s, d), _profiles(s, d), 3)),
    "e6_similar_entities": lambda s, d: rounded(neighbours.similar_entities(_profiles(s, d), 3)),
    "e7_most_similar_pairs": lambda s, d: rounded(neighbours.most_similar_pairs(_profiles(s, d), 10)),
    "e7_pairs_by_pivots": lambda s, d: rounded(pivots.closest_pairs(_profiles(s, d), 10).rows),
    "e8_stratified_corpus": lambda s, d: _corpus(s, d).select("row_id", "Town", "Polarity"),
    "e9_knn": lambda s, d: rounded(_near(s, d)),
    "e9_knn_by_pivots": lambda s, d: rounded(pivots.search(_queries(s, d), _corpus(s, d), K + 1, payload=("Town", "Polarity")).rows),
    "e10_neighbour_vote": lambda s, d: rounded(hybrid.neighbour_vote(_near(s, d))),
    "e11_dynamic_alpha": lambda s, d: rounded(_alphas(s, d)),
    "e12_alpha_extremes": lambda s, d: rounded(hybrid.alpha_extremes(_alphas(s, d))),
    "e13_score_hybrid": lambda s, d: rounded(_scored(s, d)),
    "e14_recommend": lambda s, d: rounded(_recommended(s, d)),
    "e14_recommend_explained": _explained,
    "e15_validate_queries": _requests,
    "e16_present_recommendations": lambda s, d: requests.present_recommendations(_recommended(s, d)).select(
        "query_id", "rank", "pueblo", "bar_pct", "stars", "alpha_label"),
    "e17_entity_map": _map,
    "f1_kmeans_restarts": _assigned,
    "f2_silhouette_cosine": _silhouette,
    "f3_choose_k": lambda s, d: _sweep(s, d).where("best").select("k", "silhouette"),
    "f4_inertia_curve": lambda s, d: _sweep(s, d).select("k", "inertia"),
    "f5_cluster_colour": lambda s, d: clustering.with_cluster_colour(
        fixtures.review_vectors(s, d).select("row_id", F.col("label").alias("cluster"))),
    "g1_evaluation_set": lambda s, d: sampling.evaluation_set(_reviews(s, d), EVALUATION).select("row_id", "Town", "Polarity"),
    "g2_rank_of_truth": _ranks,
    "g3_hit_rate": lambda s, d: rounded(_record(s, d).select("method", "`HR@1`", "`HR@3`", "`HR@5`", "`HR@10`")),
    "g4_mrr": lambda s, d: rounded(_record(s, d).select("method", "MRR")),
    "g5_ndcg": lambda s, d: rounded(_record(s, d).select("method", "`NDCG@5`")),
    "g6_mean_rank": lambda s, d: rounded(_record(s, d).select("method", "rank_mean")),
    "g7_evaluate": lambda s, d: rounded(_record(s, d)),
    "g8_metric_gain": lambda s, d: rounded(evaluation.metric_gain(_record(s, d))),
    "h1_balanced_sample": lambda s, d: sampling.balanced_sample(_topics(s, d), BALANCED).select("row_id", "Town"),
    "h2_assign_topics": lambda s, d: topics.assign_topics(
        sampling.balanced_sample(_topics(s, d), BALANCED).drop("topic"), TOPIC_COUNT).select("row_id", "topic"),
    "h3_topic_terms": lambda s, d: rounded(_topic_words(s, d)),
    "h4_topic_sizes": lambda s, d: topics.topic_sizes(_topics(s, d)),
    "h5_topic_distribution": lambda s, d: rounded(_distribution(s, d)),
    "h6_enriched_profile": lambda s, d: rounded(long_vectors(
        topics.enriched_profile(_town_topics(s, d), _distribution(s, d)), ["Town"], "profile")),
    "h7_compare_clusterings": _compared,
    "h8_topic_explanation": lambda s, d: rounded(
        topics.topic_explanation(_distribution(s, d), _topic_words(s, d))
        .select("Town", F.posexplode_outer("topicos").alias("pos", "entry"))
        .select("Town", "pos", "entry.topico", "entry.pct", "entry.label")),
    "h9_dominant_topic_counts": lambda s, d: topics.dominant_topic_counts(_distribution(s, d)),
}

STEPS = VECTOR_REVIEWS + f""",
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY "Town", "Polarity" ORDER BY row_id) AS place,
         row_number() OVER (PARTITION BY "Town" ORDER BY row_id) AS place_in_town,
         row_number() OVER (PARTITION BY "Town", "Polarity"
           ORDER BY md5(concat_ws('|', '42', CAST(row_id AS VARCHAR))), row_id) AS draw
  FROM vector_reviews),
towns AS (SELECT count(DISTINCT "Town") AS n FROM vector_reviews),
profiles AS (
  SELECT "Town", list(m ORDER BY p) AS profile FROM (
    SELECT "Town", p, avg(v) AS m FROM (
      SELECT "Town", unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM numbered WHERE place <= {PER_ENTITY // 5})
    GROUP BY "Town", p) GROUP BY "Town"),
corpus AS (
  SELECT numbered.* FROM numbered, towns WHERE draw <= greatest(1, {CORPUS} // greatest(1, towns.n) // 5)),
alphas AS (
  SELECT "Town", 1.0 - (n / max(n) OVER () * 0.6 + least(coalesce(std, 0) / 1.5, 1.0) * 0.4) AS raw,
         greatest(0.2, least(0.95, raw))::DOUBLE AS alpha
  FROM (SELECT "Town", count(*)::DOUBLE AS n, stddev_samp("Polarity") AS std FROM vector_reviews GROUP BY "Town"))"""

QUERIES_ALL = """,
q AS (SELECT row_id AS query_id, embedding, CAST(NULL AS VARCHAR) AS truth FROM vector_reviews)"""
QUERIES_EVALUATION = f""",
chosen AS (
  SELECT numbered.* FROM numbered, towns WHERE place <= greatest(1, greatest(1, {EVALUATION} // greatest(1, towns.n)) // 5)),
q AS (SELECT row_id AS query_id, embedding, "Town" AS truth FROM chosen)"""
NEAR = f""",
near AS (
  SELECT query_id, row_id, "Town", "Polarity", similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM (
      SELECT q.query_id, c.row_id, c."Town", c."Polarity",
             round(list_cosine_similarity(q.embedding, c.embedding), 12) AS similarity
      FROM q, corpus c)) WHERE rank <= {K + 1}),
sums AS (
  SELECT query_id, "Town", sum(similarity * "Polarity" * 0.2) AS votes FROM near WHERE rank > 1 GROUP BY ALL),
votes AS (
  SELECT query_id, "Town", CASE WHEN max(votes) OVER w > 0 THEN votes / max(votes) OVER w ELSE votes END AS cf
  FROM sums WINDOW w AS (PARTITION BY query_id))"""
SCORES = """,
scores AS (
  SELECT *, round(alpha * cb + (1 - alpha) * cf, 12) AS score FROM (
    SELECT q.query_id, q.truth, p."Town", a.alpha,
           round(list_cosine_similarity(q.embedding, p.profile), 12) AS cb, coalesce(v.cf, 0)::DOUBLE AS cf
    FROM q, profiles p JOIN alphas a ON a."Town" = p."Town"
    LEFT JOIN votes v ON v.query_id = q.query_id AND v."Town" = p."Town"))"""
BEST = f""",
meta AS (
  SELECT "Town", arg_min("Region", row_id) AS region, count(*) AS n_reviews, avg("Polarity") AS polarity,
         count(*) FILTER ("Polarity" <= 2) / count(*) * 100 AS pct_neg,
         string_agg(DISTINCT "Type", ' / ' ORDER BY "Type") AS tipos
  FROM vector_reviews GROUP BY "Town"),
best AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "Town" DESC) AS INT) AS rank FROM scores)
  WHERE rank <= {TOP}),
recommended AS (
  SELECT query_id, rank, b."Town" AS pueblo, region, score AS similitud, polarity, n_reviews, pct_neg, tipos, alpha
  FROM best b JOIN meta m ON m."Town" = b."Town")"""
RANKS = """,
own AS (SELECT query_id, score AS own_score, cb AS own_cb FROM scores WHERE "Town" = truth),
ranks AS (
  SELECT query_id, method, CAST(CASE method WHEN 'hybrid' THEN h ELSE c END AS BIGINT) + 1 AS rank FROM (
    SELECT s.query_id,
           count(*) FILTER ("Town" <> truth AND (score > own_score OR score = own_score AND "Town" > truth)) AS h,
           count(*) FILTER ("Town" <> truth AND (cb > own_cb OR cb = own_cb AND "Town" > truth)) AS c
    FROM scores s JOIN own o ON o.query_id = s.query_id GROUP BY s.query_id), (VALUES ('hybrid'), ('content_based')) m(method)),
record AS (
  SELECT method, count(*) AS n_eval, avg((rank <= 1)::DOUBLE) AS "HR@1", avg((rank <= 3)::DOUBLE) AS "HR@3",
         avg((rank <= 5)::DOUBLE) AS "HR@5", avg((rank <= 10)::DOUBLE) AS "HR@10", avg(1.0::DOUBLE / rank) AS "MRR",
         avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS "NDCG@5", avg(rank) AS rank_mean
  FROM ranks GROUP BY method)"""
FOR_ALL = STEPS + QUERIES_ALL + NEAR
FOR_EVALUATION = STEPS + QUERIES_EVALUATION + NEAR + SCORES + RANKS

TOPIC_STEPS = TOPICS + """,
counted AS (SELECT "Town", topic, count(*) AS n FROM review_topics GROUP BY ALL),
valid AS (SELECT DISTINCT topic FROM counted WHERE topic <> -1),
totals AS (SELECT "Town", sum(n) FILTER (topic <> -1) AS total FROM counted GROUP BY "Town"),
shares AS (
  SELECT t."Town", v.topic, CASE WHEN t.total > 0 THEN coalesce(c.n, 0) / t.total ELSE 0 END::DOUBLE AS share
  FROM totals t, valid v LEFT JOIN counted c ON c."Town" = t."Town" AND c.topic = v.topic)"""
TERM_STEPS = """,
said AS (
  SELECT topic, unnest(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}_]{2,}')) AS term
  FROM review_topics r JOIN documents d ON d.doc_id = r.row_id),
tf AS (SELECT topic, term, count(*) AS n FROM said GROUP BY ALL),
words AS (SELECT topic, sum(n) AS words FROM tf GROUP BY topic),
f AS (SELECT term, sum(n) AS f FROM tf GROUP BY term),
weighted AS (
  SELECT tf.topic, tf.term, round(n / words.words * ln(1 + (SELECT avg(words) FROM words) / f.f), 12) AS weight
  FROM tf JOIN words ON words.topic = tf.topic JOIN f ON f.term = tf.term WHERE tf.topic <> -1),
terms AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS INT) AS rank FROM weighted)
  WHERE rank <= 5)"""


def _vector_sql(keys: str, vector: str, source: str) -> str:
    return (
        f"SELECT {keys}, CAST(generate_subscripts({vector}, 1) - 1 AS INT) AS pos, unnest({vector}) AS value FROM {source}"
    )


def _rounded_vectors(keys: str, vector: str, source: str) -> str:
    return f"SELECT {keys}, pos, round(value, 6) AS value FROM ({_vector_sql(keys, vector, source)})"


PAIRS = """
SELECT a."Town" AS entity_a, b."Town" AS entity_b, round(list_cosine_similarity(a.profile, b.profile), 12) AS similarity
FROM profiles a JOIN profiles b ON {on}"""

ORACLE = {
    "a3_metrics_file": with_views(FOR_EVALUATION, "SELECT method, n_eval, round(\"HR@1\", 6) AS \"HR@1\", round(\"HR@3\", 6) AS \"HR@3\", round(\"HR@5\", 6) AS \"HR@5\", round(\"HR@10\", 6) AS \"HR@10\", round(\"MRR\", 6) AS \"MRR\", round(\"NDCG@5\", 6) AS \"NDCG@5\", round(rank_mean, 6) AS rank_mean FROM record"),
    "a4_topic_files": with_views(TOPIC_STEPS, """SELECT s."Town", s.topic, round(s.share, 6) AS share, t.n_reviews
        FROM shares s JOIN (SELECT "Town", count(*) AS n_reviews FROM review_topics GROUP BY "Town") t ON t."Town" = s."Town" """),
    "e2_l2_normalize": with_views(STEPS, """, unit AS (
        SELECT row_id, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS unit FROM vector_reviews)
        """ + _rounded_vectors("row_id", "unit", "unit")),
    "e3_profile_first_n": with_views(STEPS, f"""SELECT "Town", CAST(p - 1 AS INT) AS pos, round(avg(v), 6) AS value FROM (
        SELECT "Town", unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM numbered WHERE place_in_town <= {FIRST_N})
        GROUP BY "Town", p"""),
    "e4_profile_stratified": with_views(STEPS, _rounded_vectors('"Town"', "profile", "profiles")),
    "e5_cosine_search": with_views(STEPS + QUERIES_ALL, """SELECT query_id, "Town", round(similarity, 6) AS similarity, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, "Town") AS INT) AS rank FROM (
          SELECT query_id, "Town", round(list_cosine_similarity(embedding, profile), 12) AS similarity FROM q, profiles)) WHERE rank <= 3"""),
    "e6_similar_entities": with_views(STEPS, f"""SELECT entity_a, entity_b, round(similarity, 6) AS similarity, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY entity_a ORDER BY similarity DESC, entity_b) AS INT) AS rank
        FROM ({PAIRS.format(on='a."Town" <> b."Town"')})) WHERE rank <= 3"""),
    "e7_most_similar_pairs": with_views(STEPS, f"""SELECT entity_a, entity_b, round(similarity, 6) AS similarity
        FROM ({PAIRS.format(on='a."Town" < b."Town"')}) t ORDER BY t.similarity DESC, entity_a, entity_b LIMIT 10"""),
    "e8_stratified_corpus": with_views(STEPS, 'SELECT row_id, "Town", "Polarity" FROM corpus'),
    "e9_knn": with_views(FOR_ALL, 'SELECT query_id, row_id, "Town", "Polarity", round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM near'),
    "e10_neighbour_vote": with_views(FOR_ALL, 'SELECT query_id, "Town", round(cf, 6) AS cf FROM votes'),
    "e11_dynamic_alpha": with_views(STEPS, 'SELECT "Town", round(alpha, 6) AS alpha FROM alphas'),
    "e12_alpha_extremes": with_views(STEPS, """SELECT "Town", round(alpha, 6) AS alpha, 'low' AS side
        FROM (FROM alphas ORDER BY alpha, "Town" LIMIT 3)
        UNION ALL SELECT "Town", round(alpha, 6), 'high' FROM (FROM alphas ORDER BY alpha DESC, "Town" DESC LIMIT 3)"""),
    "e13_score_hybrid": with_views(FOR_ALL + SCORES + BEST, 'SELECT query_id, "Town", round(alpha, 6) AS alpha, round(cb, 6) AS cb, round(cf, 6) AS cf, round(score, 6) AS score, rank FROM best'),
    "e14_recommend": with_views(FOR_ALL + SCORES + BEST, """SELECT query_id, rank, pueblo, region, round(similitud, 6) AS similitud,
        round(polarity, 6) AS polarity, n_reviews, round(pct_neg, 6) AS pct_neg, tipos, round(alpha, 6) AS alpha FROM recommended"""),
    "e15_validate_queries": """SELECT doc_id AS row_id, trim(split_part(text, ' ', 1), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS query,
        CASE WHEN length(trim(split_part(text, ' ', 1), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 3 THEN 'query inválido' END AS error FROM documents""",
    "e16_present_recommendations": with_views(FOR_ALL + SCORES + BEST, """SELECT query_id, rank, pueblo,
        CAST(round(greatest(0, least(100, (similitud - 0.85) / (1.0::DOUBLE - 0.85) * 100))) AS INT) AS bar_pct,
        CAST(floor(polarity + 0.5) AS INT) AS stars,
        CASE WHEN alpha >= 0.7 THEN 'más contenido' WHEN alpha <= 0.4 THEN 'más colaborativo' ELSE 'equilibrado' END AS alpha_label
        FROM recommended"""),
    "f2_silhouette_cosine": with_views(STEPS, """, unit AS (
          SELECT row_id, label, p, v / sqrt(list_inner_product(e, e)) AS u FROM (
            SELECT row_id, label, embedding AS e, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM review_vectors)),
        centre AS (SELECT label, p, sum(u) AS s FROM unit GROUP BY ALL),
        size AS (SELECT label, count(*) AS n FROM review_vectors GROUP BY label),
        away AS (
          SELECT u.row_id, u.label AS own, c.label AS other, 1 - sum(u.u * c.s) / any_value(z.n) AS d, any_value(z.n) AS n
          FROM unit u JOIN centre c ON c.p = u.p JOIN size z ON z.label = c.label GROUP BY u.row_id, u.label, c.label),
        near AS (
          SELECT row_id, max(n) FILTER (own = other) AS n, max(d * n / greatest(n - 1, 1)) FILTER (own = other) AS a,
                 min(d) FILTER (own <> other) AS b FROM away GROUP BY row_id)
        SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette FROM near"""),
    "f5_cluster_colour": """SELECT vec_id AS row_id, label AS cluster,
        ['#E53935', '#1E88E5', '#43A047', '#FB8C00', '#8E24AA', '#00ACC1', '#F4511E', '#6D4C41', '#546E7A', '#FFB300'][label % 10 + 1] AS color
        FROM embeddings""",
    "g1_evaluation_set": with_views(STEPS + QUERIES_EVALUATION, 'SELECT row_id, "Town", "Polarity" FROM chosen'),
    "g2_rank_of_truth": with_views(FOR_EVALUATION, "SELECT query_id, method, rank FROM ranks"),
    "g3_hit_rate": with_views(FOR_EVALUATION, "SELECT method, round(\"HR@1\", 6) AS \"HR@1\", round(\"HR@3\", 6) AS \"HR@3\", round(\"HR@5\", 6) AS \"HR@5\", round(\"HR@10\", 6) AS \"HR@10\" FROM record"),
    "g4_mrr": with_views(FOR_EVALUATION, "SELECT method, round(\"MRR\", 6) AS \"MRR\" FROM record"),
    "g5_ndcg": with_views(FOR_EVALUATION, "SELECT method, round(\"NDCG@5\", 6) AS \"NDCG@5\" FROM record"),
    "g6_mean_rank": with_views(FOR_EVALUATION, "SELECT method, round(rank_mean, 6) AS rank_mean FROM record"),
    "g8_metric_gain": with_views(FOR_EVALUATION, """SELECT round((h."HR@5" - c."HR@5") * 100, 6) AS "gain_HR@5",
        round((h."MRR" - c."MRR") * 100, 6) AS "gain_MRR", round((h."NDCG@5" - c."NDCG@5") * 100, 6) AS "gain_NDCG@5"
        FROM record h, record c WHERE h.method = 'hybrid' AND c.method = 'content_based'"""),
    "h1_balanced_sample": with_views(TOPIC_STEPS, f"""SELECT row_id, "Town" FROM (
        SELECT *, row_number() OVER (PARTITION BY "Town" ORDER BY md5(concat_ws('|', '42', CAST(row_id AS VARCHAR))), row_id) AS draw
        FROM review_topics) WHERE draw <= {BALANCED}"""),
    "h3_topic_terms": with_views(TOPIC_STEPS + TERM_STEPS, "SELECT topic, term, round(weight, 6) AS weight, rank FROM terms"),
    "h4_topic_sizes": with_views(TOPIC_STEPS, "SELECT topic, count(*) AS n FROM review_topics WHERE topic <> -1 GROUP BY topic"),
    "h5_topic_distribution": with_views(TOPIC_STEPS, 'SELECT "Town", topic, round(share, 6) AS share FROM shares'),
    "h6_enriched_profile": with_views(TOPIC_STEPS, """, means AS (
          SELECT "Town", p - 1 AS pos, avg(v) AS v FROM (
            SELECT "Town", unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM review_topics) GROUP BY "Town", p),
        parts AS (
          SELECT "Town", pos, v FROM means UNION ALL
          SELECT "Town", 64 + row_number() OVER (PARTITION BY "Town" ORDER BY topic) - 1, share FROM shares)
        SELECT "Town", CAST(pos AS INT) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY "Town")), 6) AS value FROM parts"""),
    "h8_topic_explanation": with_views(TOPIC_STEPS + TERM_STEPS, """, top AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Town" ORDER BY share DESC, topic) AS r FROM shares)
          WHERE r <= 3 AND share >= 0.03),
        labels AS (SELECT topic, string_agg(term, ' · ' ORDER BY rank) AS label FROM terms WHERE rank <= 3 GROUP BY topic)
        SELECT w."Town", CAST(t.r - 1 AS INT) AS pos, 'T' || t.topic AS topico, round(round_even(t.share * 100 * 10, 0) / 10, 6) AS pct,
               coalesce(l.label, 'T' || t.topic) AS label
        FROM (SELECT DISTINCT "Town" FROM shares) w LEFT JOIN top t ON t."Town" = w."Town" LEFT JOIN labels l ON l.topic = t.topic"""),
    "h9_dominant_topic_counts": with_views(TOPIC_STEPS, """SELECT topic, count(*) AS n FROM (
        SELECT "Town", topic, row_number() OVER (PARTITION BY "Town" ORDER BY share DESC, topic) AS r FROM shares WHERE share > 0)
        WHERE r = 1 GROUP BY topic"""),
}
ORACLE["g7_evaluate"] = ORACLE["a3_metrics_file"]
# The searches by pivots return the rows of the full grids.
ORACLE["e7_pairs_by_pivots"] = ORACLE["e7_most_similar_pairs"]
ORACLE["e9_knn_by_pivots"] = ORACLE["e9_knn"]
