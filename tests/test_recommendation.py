"""Traps of ranking, weights and topics that the SQL checks cannot reach."""

from __future__ import annotations

import pytest
from placelens.operators import clustering, evaluation, hybrid, maps, neighbours, profiles, requests, topics
from placelens.session import ship
from pyspark.sql import functions as F

V = "array<double>"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def frames(spark):
    towns = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [1.0, 0.0]), ("C", [0.0, 1.0])], f"Town string, profile {V}")
    alphas = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "Town string, alpha double")
    votes = spark.createDataFrame([], "query_id long, Town string, cf double")
    queries = spark.createDataFrame([(1, [1.0, 0.0], "A"), (2, [0.0, 1.0], "nowhere")], f"query_id long, embedding {V}, truth string")
    return towns, alphas, votes, queries


def test_equal_scores_go_to_the_later_entity(spark):
    towns, alphas, votes, queries = frames(spark)
    scored = hybrid.score_hybrid(queries, votes, towns, alphas, 2)
    best = hybrid.rank_recommendations(scored, 2).where("query_id = 1").orderBy("rank").collect()
    assert [r["Town"] for r in best] == ["B", "A"]


def test_entities_and_truths_are_not_dropped(spark):
    towns, alphas, votes, queries = frames(spark)
    scored = hybrid.score_hybrid(queries, votes, towns, alphas, 3)
    assert scored.where("query_id = 2").count() == 3  # C has no weight of its own
    ranks = hybrid.truth_ranks(queries, votes, towns, alphas)
    got = {(r["query_id"], r["method"]): r["rank"] for r in ranks.collect()}
    assert got == {(1, "hybrid"): 2, (1, "content_based"): 2, (2, "hybrid"): 4, (2, "content_based"): 4}
    assert {r["n_eval"] for r in evaluation.evaluate(ranks).collect()} == {2}


def test_top_n_must_be_positive(spark):
    towns, alphas, votes, queries = frames(spark)
    with pytest.raises(ValueError):
        hybrid.rank_recommendations(hybrid.score_hybrid(queries, votes, towns, alphas, 1), 0)


def test_weight_of_one_review_takes_no_spread(spark):
    cells = spark.createDataFrame([("A", 5, 1), ("B", 1, 2), ("B", 5, 2)], "Town string, Polarity int, n long")
    got = {r["Town"]: r["alpha"] for r in hybrid.dynamic_alpha(cells).collect()}
    assert abs(got["A"] - (1 - 0.25 * 0.6)) < 1e-12 and abs(got["B"] - 0.2) < 1e-12


def test_similar_entities_leave_out_the_entity(spark):
    towns, *_ = frames(spark)
    got = {(r["entity_a"], r["entity_b"]) for r in neighbours.similar_entities(towns, 1).collect()}
    assert got == {("A", "B"), ("B", "A"), ("C", "A")}


def test_requests(spark):
    asked = spark.createDataFrame([(1, " ab "), (2, None), (3, "abc\t")], "k int, query string")
    accepted, rejected = requests.validate_queries(asked)
    assert [r["query"] for r in accepted.collect()] == ["abc"]
    assert {(r["k"], r["error"]) for r in rejected.collect()} == {(1, "query inválido"), (2, "query inválido")}


def test_explanations(spark):
    rows = [("X", 0, 0.5), ("X", 1, 0.02), ("X", 2, 0.4), ("X", 3, 0.08), ("Y", 0, 0.9), ("Y", 1, 0.02), ("Y", 2, 0.02), ("Y", 3, 0.06)]
    shares = spark.createDataFrame(rows, "Town string, topic int, share double")
    terms = spark.createDataFrame([(0, "a", 1)], "topic int, term string, rank int")
    got = {r["Town"]: [(t["topico"], t["pct"]) for t in r["topicos"]] for r in topics.topic_explanation(shares, terms).collect()}
    assert got == {"X": [("T0", 50.0), ("T2", 40.0), ("T3", 8.0)], "Y": [("T0", 90.0), ("T3", 6.0)]}


def test_entities_without_topics_get_zeros(spark):
    assigned = spark.createDataFrame([("A", 0), ("A", 1), ("B", -1)], "Town string, topic int")
    shares = topics.topic_distribution(assigned)
    assert {(r["Town"], r["topic"]): r["share"] for r in shares.collect()} == {("A", 0): 0.5, ("A", 1): 0.5, ("B", 0): 0.0, ("B", 1): 0.0}
    towns = spark.createDataFrame([("A", [1.0]), ("C", [2.0])], f"Town string, profile {V}")
    got = {r["Town"]: r["profile"] for r in topics.enriched_profile(towns, shares).collect()}
    assert got["C"] == [1.0, 0.0, 0.0] and len(got["A"]) == 3


def test_clusters(spark):
    points = [(f"T{k}", [float(k % 3 == 0), float(k % 3 == 1), float(k % 3 == 2) + 0.01 * k]) for k in range(12)]
    features = clustering.to_features(spark.createDataFrame(points, f"Town string, profile {V}"))
    best = clustering.choose_k(clustering.sweep(features, k_max=5, n_init=3))
    assert best.k == 3 and best.silhouette > 0.9
    same = clustering.to_features(spark.createDataFrame([(f"T{k}", [1.0, 0.0]) for k in range(4)], f"Town string, profile {V}"))
    assert all(c.silhouette == 0.0 for c in clustering.sweep(same, k_max=3, n_init=1))


def test_map_frames(spark):
    towns, alphas, votes, queries = frames(spark)
    clusters = spark.createDataFrame([("A", 0)], "Town string, cluster int")
    marks = spark.createDataFrame([(1, "A", 1), (1, "C", 3)], "query_id long, pueblo string, rank int")
    places, users, marked = maps.entity_map_2d(towns, queries, clusters, marks)
    assert places.count() == 3 and users.count() == 2
    assert {(r["Town"], r["mark"], r["highlight"]) for r in marked.collect()} == {("A", 220, 500), ("C", 220, 360)}


def test_profiles_are_plain_means(spark):
    rows = [(k, "A", 1 + k % 5, [float(k), 1.0]) for k in range(20)]
    df = spark.createDataFrame(rows, f"row_id long, Town string, Polarity int, embedding {V}")
    assert profiles.entity_profile_first_n(df, 4).first()["profile"] == [1.5, 1.0]
    assert profiles.entity_profile_stratified(df, 5).first()["profile"] == [2.0, 1.0]
    assert df.agg(F.count("*")).first()[0] == 20


def test_registered_recommendation_with_clusters_and_topics(spark):
    """The rows of the plain recommendation; cluster, colour and topics are those of their own queries."""
    from placelens.plans import recommend_queries as plans
    from placelens.session import ship

    sf = "/root/testdata/sf0.001"
    ship(spark)
    got = plans.QUERIES["e14_recommend_explained"](spark, sf).collect()
    plain = plans._recommended(spark, sf, decimals=True).collect()
    names = [c for c in plain[0].asDict()]
    assert sorted(map(repr, ([r[c] for c in names] for r in got))) == sorted(map(repr, ([r[c] for c in names] for r in plain)))
    clusters = {r["Town"]: r["cluster"] for r in plans._assigned(spark, sf).collect()}
    topicos = {r["Town"]: r["topicos"] for r in plans._own_topics(spark, sf).collect()}
    assert all(r["cluster"] == clusters[r["pueblo"]] and r["color"] for r in got)
    assert all(r["topicos"] == topicos.get(r["pueblo"]) for r in got) and any(r["topicos"] for r in got)
    for town, entries in topicos.items():  # a review's label is its town's number and its topic; 9 is an outlier
        assert [e["topico"] for e in entries] == ([] if town == "T9" else [town])
