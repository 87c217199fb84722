import itertools
import random

import pytest
from pyspark.sql import functions as F

import brute
from veridoc.functions import hashing
from veridoc.operators import authorship, candidates, ranks, similarity, terms

GREEK = "alpha beta gamma delta epsilon zeta eta theta"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def mixed(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(random.choices(words, k=random.randint(0, 40))) for _ in range(12)]
    near = [t + " tail" for t in base[:4]]
    return docs(spark, *base, *near, "", "a b", "one", "same few words here", "same few words here")


@pytest.fixture(scope="module")
def cut(mixed):
    return [r.tokens for r in terms.tokenized(mixed).orderBy("doc_id").collect()]


def test_hash_vectors():
    tokens = GREEK.split()
    assert int(hashing.plain_hash([b"alpha"])[0]) == 1569418667
    assert int(hashing.seeded_hash([b"alpha"], hashing.SEEDS)[0, 0]) == 241123379
    sig = hashing.signatures([tokens])
    assert sig[0, :5].tolist() == [52261054, 17362492, 207003553, 2531993732, 165829697]
    keys = hashing.band_keys(sig, 20, 5)[0]
    assert (int(keys[0]), int(keys[19])) == (1515764846, 3642540996)
    assert hashing.fingerprints([tokens])[0].tolist() == [399609364, 3226031630, 3488636679, 4125510610]


def test_tfidf_of_two_documents(spark):
    tokens = terms.tokenized(docs(spark, "common rare", "common"), ())
    assert terms.token_totals(tokens).first().asDict() == {"documents": 2, "tokens": 3, "vocabulary": 2}
    held = {r.term: r.tfidf for r in terms.tfidf_weights(tokens).where("doc_id = 0").collect()}
    assert held["rare"] > held["common"]
    assert terms.tfidf_lookup(tokens, terms.tfidf_weights(tokens), "none").agg(F.sum("tfidf")).first()[0] == 0


def test_everything_against_brute_force(mixed, cut):
    tokens = terms.tokenized(mixed)
    expected = brute.weights(cut)
    found = {(r.doc_id, r.term): r.tfidf for r in terms.tfidf_weights(tokens).collect()}
    assert found == pytest.approx({(i, t): v for i, w in enumerate(expected) for t, v in w.items()})

    signs = {r.doc_id: r.signature for r in candidates.signatures(tokens).collect()}
    assert signs == {i: brute.signature(t) for i, t in enumerate(cut)}
    keys = {i: [brute.band_key(s[5 * b : 5 * b + 5], b) for b in range(20)] for i, s in signs.items()}
    first = {}
    for a, b in itertools.combinations(sorted(keys), 2):
        shared = [(k, keys[a][k]) for k in range(20) if keys[a][k] == keys[b][k]]
        if shared:
            first[a, b] = shared[0]
    pairs = candidates.candidate_pairs(candidates.band_lists(tokens))
    assert {(r.a, r.b): (r.first_band, r.first_key) for r in pairs.collect()} == first and first

    scores = {(r.a, r.b): r for r in similarity.pair_scores(pairs, tokens).collect()}
    assert set(scores) == set(first)
    for (a, b), s in scores.items():
        assert s.cosine == pytest.approx(brute.cosine(expected[a], expected[b]))
        assert s.rabin_karp == pytest.approx(brute.jaccard(brute.prints(cut[a]), brute.prints(cut[b])))
        assert s.combined == pytest.approx(0.6 * s.cosine + 0.4 * s.rabin_karp)


def test_few_tokens_alike_score_06_and_are_not_flagged(mixed):
    tokens = terms.tokenized(mixed)
    scores = similarity.pair_scores(candidates.candidate_pairs(candidates.band_lists(tokens)), tokens)
    few = scores.where("a = 19 AND b = 20").first()
    assert (few.cosine, few.rabin_karp, few.combined) == (pytest.approx(1), 0, pytest.approx(0.6))
    assert similarity.flagged(scores, 0.75).where("a = 19").isEmpty()


def test_pairs_given_by_hand(spark):
    tokens = terms.tokenized(docs(spark, GREEK, GREEK, "compiler memory kernel scheduler process cache thread network"))
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    scores = similarity.pair_scores(pairs, tokens)
    high, low = scores.orderBy("b").collect()
    assert min(high.cosine, high.rabin_karp, high.combined) > 0.999 and low.combined < 0.25
    long = similarity.similarity_long(scores, docs(spark, "", "", ""))
    cells = {(r.row, r.col): r.score for r in long.collect()}
    assert cells[0, 1] == cells[1, 0] and all(cells[i, i] == 1.0 for i in range(3))
    block = similarity.matrix_block(long, docs(spark, "", "", ""), 0, 20)
    assert block.count() == 9 and block.where("row = 1 AND col = 2").first().score == 0


def test_empty_documents_are_candidates_with_score_0(spark):
    tokens = terms.tokenized(docs(spark, "", None, "some words"))
    pairs = candidates.candidate_pairs(candidates.band_lists(tokens))
    assert [(r.a, r.b, r.combined) for r in similarity.pair_scores(pairs, tokens).collect()] == [(0, 1, 0.0)]


def test_empty_table(spark):
    tokens = terms.tokenized(docs(spark).limit(0) if False else spark.createDataFrame([], "doc_id long, text string"))
    pairs = candidates.candidate_pairs(candidates.band_lists(tokens))
    assert similarity.pair_scores(pairs, tokens).count() == 0


def test_perplexity_and_scores(spark, mixed, cut):
    corpus = spark.createDataFrame([("w1 w2 w3 w4. w1 w2 w3 w5 and w1 w2 w4 w4 w4",)], "text string")
    model = authorship.train(spark, corpus)
    words = terms.tokenized(corpus.withColumn("doc_id", F.lit(0))).first().tokens
    found = {r.doc_id: r.perplexity for r in authorship.perplexity(terms.tokenized(mixed), ["doc_id"], model).collect()}
    assert found == pytest.approx({i: brute.perplexity(t, words) for i, t in enumerate(cut)})
    assert (found[16], found[17], found[18]) == (1000, 500, 500)  # nothing; b, as a is a stopword; one


def test_variance_is_around_the_document(spark):
    text = "w1 w2 w3 w4. w9 w8. w1 w2 w3!"
    corpus = spark.createDataFrame([("w1 w2 w3 w4 w1 w2 w3 w5",)], "text string")
    model = authorship.train(spark, corpus)
    source = docs(spark, text, "only one sentence here", "")
    rows = authorship.authorship_scores(source, terms.tokenized(source), model).orderBy("doc_id").collect()
    words = "w1 w2 w3 w4 w1 w2 w3 w5".split()
    whole = brute.perplexity("w1 w2 w3 w4 w9 w8 w1 w2 w3".split(), words)
    parts = [brute.perplexity(p.split(), words) for p in ("w1 w2 w3 w4", "w9 w8", "w1 w2 w3")]
    spread = sum((p - whole) ** 2 for p in parts) / 3
    assert rows[0].perplexity_variance == pytest.approx(spread)
    assert rows[0].ai_score == pytest.approx(100 / (1 + whole / 75) / (1 + spread**0.5 / 100))
    assert rows[1].perplexity_variance == 0 and rows[2].mean_perplexity == 1000


def test_idf_is_the_same_without_the_broadcast(mixed, monkeypatch):
    tokens = terms.tokenized(mixed)
    rows = lambda: {(r.doc_id, r.term): r.tfidf for r in terms.tfidf_weights(tokens).collect()}
    wide = rows()
    monkeypatch.setattr(terms, "MOST_BROADCAST", 1)
    assert rows() == wide


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "v long, w string").repartition(5)
    assert all(r.place == 100 - r.v for r in ranks.numbered(rows, "place", F.desc("v")).collect())
    assert ranks.numbered(rows.where("false"), "place", F.desc("v")).count() == 0


def test_order_is_two_at_least(spark):
    assert authorship.train(spark, order=1).order == 2
