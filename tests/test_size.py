"""What is shuffled and held must not grow faster than the input."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import brute
from veridoc import queries
from veridoc.functions import hashing
from veridoc.operators import authorship, blocks, candidates, similarity, terms
from veridoc.sources import readers


def shuffled(spark, action) -> int:
    """Records that the stages of action write for others."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    action()
    return sum(n for k, n in total().items() if k not in before)


def table(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def near_copies(count, words=80):
    random.seed(5)
    base = [f"w{i}" for i in range(words)]
    return [" ".join([*base, f"x{i}"]) for i in range(count)]


@pytest.mark.parametrize("name", ["cosine_pairs", "rk_pairs", "similarity_scores", "flagged_pairs"])
def test_terms_are_not_shuffled_for_each_pair(spark, tmp_path, name):
    where = table(spark, tmp_path, near_copies(200))
    rows = []
    records = shuffled(spark, lambda: rows.extend(queries.QUERIES[name](spark, where).collect()))
    assert len(rows) == 200 * 199 // 2
    assert records < 6 * 200 * 81  # a few times the terms of all documents, and not 81 for each pair


def test_blocks_give_the_scores_of_all_pairs(spark, monkeypatch):
    texts = [*near_copies(14, 20), *near_copies(7, 20), "", None, "", "same few words", "same few words", "nothing like it"]
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = terms.tokenized(source)
    cut = [r.tokens for r in tokens.orderBy("doc_id").collect()]
    weights = brute.weights(cut)
    keys = [[brute.band_key(s[5 * b : 5 * b + 5], b) for b in range(20)] for s in map(brute.signature, cut)]
    expected = {}
    for a, b in itertools.combinations(range(len(cut)), 2):
        met = [(k, keys[a][k]) for k in range(20) if keys[a][k] == keys[b][k]]
        if met:
            expected[a, b] = *met[0], brute.cosine(weights[a], weights[b]), brute.jaccard(brute.prints(cut[a]), brute.prints(cut[b]))
    for rows, members in ((512, 256), (3, 2)):
        monkeypatch.setattr(blocks, "CHUNK_ROWS", rows)
        monkeypatch.setattr(candidates, "MEMBERS_AT_ONCE", members)
        found = similarity.candidate_scores(similarity.candidates_of(tokens), tokens).pairs().collect()
        assert len(found) == len(expected) > 200
        for r in found:
            assert (r.first_band, r.first_key, r.cosine, r.rabin_karp) == pytest.approx(expected[r.a, r.b])
        pairs = candidates.candidate_pairs(candidates.band_lists(tokens)).collect()
        assert {(r.a, r.b): (r.first_band, r.first_key) for r in pairs} == {k: v[:2] for k, v in expected.items()} and len(pairs) == len(expected)


def test_a_file_is_opened_once(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"{i:03}.txt").write_text(f"text {i}" if i % 9 else "")
    (tmp_path / "a b%20c.txt").write_text("")
    numbered, sorted_ = readers.numbered, []
    monkeypatch.setattr(readers, "numbered", lambda df, *order: sorted_.append(df) or numbered(df, *order))
    rows = readers.from_folder(spark, str(tmp_path)).orderBy("doc_id").collect()
    names = sorted([f"{i:03}.txt" for i in range(40)] + ["a b%20c.txt"])
    assert [(r.doc_id, r.filename, r.bytes, r.text) for r in rows] == [(i, n, (tmp_path / n).stat().st_size, (tmp_path / n).read_text()) for i, n in enumerate(names)]
    assert {r.path.rpartition("/")[0] for r in rows} == {f"file:{tmp_path}"}
    plan = sorted_[0]._jdf.queryExecution().toString()
    assert sorted_[0].columns == ["path"] and "binaryFile" not in plan  # sorting reads its input twice


SENTENCES = " ".join(f"The quick brown fox jumps over w{i}." for i in range(30))


@pytest.mark.parametrize("name", ["sentence_perplexity", "ai_scores", "ai_ranking", "written_scores"])
def test_ngrams_and_sentences_are_not_shuffled(spark, tmp_path, name):
    where = table(spark, tmp_path, [f"{SENTENCES} {i}" for i in range(100)])
    rows = []
    records = shuffled(spark, lambda: rows.extend(queries.QUERIES[name](spark, where).collect()))
    assert len(rows) == 100 * (31 if name == "sentence_perplexity" else 1)
    assert records < 1200  # the documents a few times, the model's n-grams, and not the 3,100 sentences


@pytest.mark.parametrize("order", [2, 3, 4])
def test_a_model_that_is_joined_gives_the_same(spark, monkeypatch, order):
    random.seed(6)
    words = [f"w{i}" for i in range(6)]
    texts = ["".join(random.choice(words) + random.choice(" . !") + " " for _ in range(random.randint(0, 40))) for _ in range(20)]
    source = spark.createDataFrame(list(enumerate([*texts, "", None, "w1", "... !!!"])), "doc_id long, text string")
    corpus = " ".join(random.choices(words[:4], k=60))
    tokens = terms.tokenized(source)
    cut = [r.tokens for r in tokens.orderBy("doc_id").collect()]
    for most in (authorship.MOST_SENT, 2):
        monkeypatch.setattr(authorship, "MOST_SENT", most)
        monkeypatch.setattr(authorship, "TOKENS_AT_ONCE", 50)
        model = authorship.train(spark, spark.createDataFrame([(corpus,)], "text string"), order)
        found = {r.doc_id: r.perplexity for r in authorship.perplexity(tokens, ["doc_id"], model).collect()}
        assert found == pytest.approx({i: brute.perplexity(t, corpus.split(), order) for i, t in enumerate(cut)})
        scores = {r.doc_id: (r.mean_perplexity, r.perplexity_variance) for r in authorship.authorship_scores(source, tokens, model).collect()}
        for i, text in enumerate(texts):
            parts = [brute.perplexity(p.split(), corpus.split(), order) for p in text.replace("!", ".").split(".") if p.split()]
            spread = sum((p - found[i]) ** 2 for p in parts) / len(parts) if len(parts) > 1 else 0
            assert scores[i] == pytest.approx((found[i], spread))


class Given:
    """Stands for a table, and hands back the function that is mapped over it."""

    def __init__(self, spark):
        self.schema = spark.createDataFrame([], "doc_id long, tokens array<string>").schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("make", [candidates.signatures, candidates.band_lists, candidates.fingerprints])
def test_a_worker_holds_a_run_of_tokens_and_not_a_batch(spark, make):
    words = pa.array([f"w{i}" for i in range(3000)])
    picks = pa.array(np.random.default_rng(2).integers(0, 3000, 1_500_000))
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, 1_500_001, 1000), pa.int32()), words.take(picks))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), tokens], ["doc_id", "tokens"])
    run = make(Given(spark))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == 1500
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()


def test_runs_and_seed_groups_change_no_hash(monkeypatch):
    random.seed(4)
    documents = [[random.choice("abcdefgh") * random.randint(1, 9) for _ in range(random.randint(0, 30))] for _ in range(40)]
    expected = [brute.signature(d) for d in documents]
    assert hashing.signatures(documents).tolist() == expected
    for name, value in (("TOKENS_AT_ONCE", 25), ("ROWS_AT_ONCE", 3), ("CELLS_AT_ONCE", 70)):
        monkeypatch.setattr(hashing, name, value)
    lists = pa.array(documents, pa.list_(pa.string())).slice(3)
    found = list(hashing.runs(lists))
    assert [a for a, _ in found[1:]] == [b for _, b in found[:-1]] and found[0][0] == 0 and found[-1][1] == len(lists) and len(found) > 5
    assert [row for a, b in found for row in hashing.signatures(lists.slice(a, b - a)).tolist()] == expected[3:]
    assert [set(map(int, row)) for a, b in found for row in hashing.fingerprints(lists.slice(a, b - a))] == [brute.prints(d) for d in documents[3:]]
