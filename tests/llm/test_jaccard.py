import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from veridoc.llm import components, jaccard
from veridoc.llm.decontaminate import normalised


def item_set(text):
    words = normalised(text)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """(class id, links) of each place."""
    sets = [item_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for held in holders.values() for k, a in enumerate(held) for b in held[k + 1 :])
    links, root = Counter(), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(top(i), []).append(key)
    return [(min((k for k in least[top(i)] if k is not None), default=None), links[i]) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    random.seed(6)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(25):
        base = random.choices(words, k=random.choice([3, 6, 40, 90, 200]))
        out.append(" ".join(base))
        for _ in range(random.randint(0, 4)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 40))):
                copy[random.randrange(len(copy))] = random.choice(words)
            out.append(" ".join(copy))
    base = random.choices(words, k=120)  # a dense group, larger than a chunk
    for i in range(150):
        copy = list(base)
        copy[random.randrange(120)] = f"x{i}"
        out.append(" ".join(copy))
    out += [out[-1]] * 20 + ["", None, "...", "a b", "A, b!", "x" * 3000]
    ids = list(range(len(out)))
    random.shuffle(ids)
    return list(zip(ids, out)) + [(None, out[0]), (7000, out[3]), (7000, out[3])]


def test_join_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, row string").repartition(5)
    found = Counter((r.id, r.class_id, r.n_links) for r in jaccard.jaccard_join(docs).collect())
    expected = Counter((key, c, n) for (key, _), (c, n) in zip(rows, brute(rows)))
    wordless = {key for key, t in rows if not item_set(t)}
    assert {k: v for k, v in found.items() if k[0] not in wordless} == {k: v for k, v in expected.items() if k[0] not in wordless}
    assert all((key, key, 0) in found for key in wordless)


@pytest.mark.parametrize("members, star", [(24, 10_000), (24, 8), (1024, 8)])
def test_nodes_of_many_chunks(spark, rows, monkeypatch, members, star):
    """With and without centres, in nodes of one chunk and of many."""
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "STAR", star)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r.id, r.class_id, r.n_links) for r in jaccard.jaccard_join(docs).collect() if r.n_links)
    assert found == Counter((key, c, n) for (key, _), (c, n) in zip(rows, brute(rows)) if n)


def test_rows_of_a_group_are_linear(spark, monkeypatch):
    """Of 500, 1000 and 2000 near copies no join sees more rows a document in the larger group, and none of
    their pairs is verified."""
    seen = []
    monkeypatch.setattr(jaccard, "settle", lambda df, label, real=jaccard.settle: seen.append((label, real(df, label))) or seen[-1][1])
    monkeypatch.setattr(jaccard, "discard", lambda df: None)
    random.seed(4)
    base = random.choices([f"w{i}" for i in range(3000)], k=200)
    for n in (500, 2000):
        seen.clear()
        copies = [(i, " ".join(base[: i % 200] + [f"x{i}"] + base[i % 200 + 1 :])) for i in range(n)]
        assert {r.n_links for r in jaccard.jaccard_join(spark.createDataFrame(copies, "doc_id long, text string")).collect()} == {n - 1}
        counts = [(label, df.count()) for label, df in seen]
        assert all(k <= jaccard.TREES * n for _, k in counts) and dict(counts)["members"] < n // 2


def test_a_target_that_no_prefix_reaches_compares_all(spark):
    texts = ["a b c d e f g h i j k l", "a b c d e f x y z w v u", "q w e r t y u i o p a s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard.jaccard_join(docs, 0.1, 0.999).orderBy("id").collect()
    assert [(r.n_links, r.class_id, r.recall) for r in found] == [(1, 0, 1.0), (1, 0, 1.0), (0, 2, 1.0)]


def test_which_repeated_row_stays_does_not_depend_on_order(spark):
    rows = [(1, "a b c d e f", x) for x in range(20)]
    stay = [jaccard.one_of_each(spark.createDataFrame(r, "doc_id long, text string, kept int").repartition(4)).collect() for r in (rows, rows[::-1])]
    assert len(stay[0]) == 1 and stay[0] == stay[1]


def test_one_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [r.asDict() for r in jaccard.one_of_each(docs).collect()]
    classes = {}
    for (key, text), (c, _) in zip(rows, brute(rows)):
        if item_set(text):
            classes.setdefault(c, set()).add((key, text))
    stay = [(r["doc_id"], r["text"]) for r in kept if item_set(r["text"])]
    assert len(stay) == len(classes)
    assert all(sum(k in members for k in stay) == 1 for members in classes.values())
    assert len(kept) - len(stay) == sum(not item_set(t) for _, t in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(docs).count() == 0 and jaccard.one_of_each(docs).count() == 0


def test_sets_and_depth():
    texts = ["a b c d e f", "A-b/c d,e f", "a b", "", None, "ü" * 50 + " b c d e"]
    sets = list(jaccard.item_sets(texts))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1] and (sets[0] == sets[1]).all()
    assert jaccard.chance(0.8, jaccard.first_depth(0.8, 0.999)) >= 0.999
    same = list(jaccard.item_sets([" ".join(map(str, range(k))) for k in range(400)]))
    assert [len(s) for s in same] == [0, 1, 1, 1, 1, *range(1, 396)]


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: top(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.op6_jaccard(spark, sf_dir).collect()}
    assert found == {key: x for (key, _), x in zip(texts, brute(texts))}
    assert np.sum([n for _, n in found.values()]) > 0
