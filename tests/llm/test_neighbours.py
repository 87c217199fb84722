import numpy as np
import pytest

from veridoc.llm import neighbours as n


def brute(vectors, usual):
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) == usual and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([vectors[i] for i in good])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    links = np.zeros(len(vectors), int)
    links[good] = hit.sum(axis=1)
    root = list(range(len(vectors)))
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(hit)):
            low = min(root[good[a]], root[good[b]])
            changed |= root[good[a]] != low or root[good[b]] != low
            root[good[a]] = root[good[b]] = low
    return links, root


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 16))
    near = x[random.integers(0, 60, 200)] + 0.08 * random.normal(size=(200, 16))
    dense = random.normal(size=16) + 0.05 * random.normal(size=(150, 16))
    out = [list(map(float, v)) for v in np.concatenate([x, near, dense, x[:5], 3 * x[:5]])]
    out += [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1e300] * 16, [1.0] * 16]
    return out


def test_against_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(n, "SHARD", 100)  # several centroids, and a dense group of several chunks
    table = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, row string").repartition(4)
    links, root = brute(vectors, 16)
    rows = {r.id: r for r in n.near_vectors(table).collect()}
    assert len(rows) == len(vectors)
    assert all(rows[i].n_links <= links[i] for i in rows)
    assert sum(r.n_links for r in rows.values()) >= 0.97 * links.sum()
    assert rows[0].recall >= 0.9
    assert np.mean([rows[i].component_id == root[i] for i in rows]) >= 0.97
    for i in range(len(vectors) - 8, len(vectors) - 2):
        assert (rows[i].n_links, rows[i].component_id) == (0, i)
    assert rows[len(vectors) - 1].n_links == 1  # the huge vector of the same direction


def test_vectors_of_several_lengths_and_null_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0]), (4, [0.1, 1.0]), (None, [0.0, 2.0]), (None, None), (6, [1.0]), (7, []), (8, [5.0])]
    found = {(r.id, r.n_links, r.component_id) for r in n.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {(1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 3), (None, 2, 3), (None, 0, None), (6, 1, 6), (8, 1, 6), (7, 0, 7)}


def test_below_the_target_all_are_compared(spark, vectors, monkeypatch):
    monkeypatch.setattr(n, "SHARD", 100)
    monkeypatch.setattr(n, "ATTEMPTS", 1)
    monkeypatch.setattr(n, "TARGET", 1.1)
    rows = n.near_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    links, root = brute(vectors, 16)
    assert all((r.n_links, r.component_id, r.recall) == (links[r.id], root[r.id], 1.0) for r in rows)


def test_empty_table(spark):
    assert n.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_graph_of_one_and_two():
    assert n.build_graph(np.ones((1, 4))).tolist() == [[-1]]
    graph = n.build_graph(np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert [set(g[g >= 0]) for g in graph] == [{1}, {0}]


def test_search_reaches_what_lies_within_the_radius():
    random = np.random.default_rng(5)
    x = np.concatenate([random.normal(size=(500, 32)), np.zeros((0, 32))])
    x = np.concatenate([x, x[:100] + 0.1 * random.normal(size=(100, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = n.build_graph(x)
    q, node = n.search(x, np.full(len(x), -1), x, graph, int((x @ x.mean(axis=0)).argmax()), 16)
    truth = (x @ x.T >= 0.9).sum()
    assert len(q) >= 0.9 * truth  # from the medoid alone
