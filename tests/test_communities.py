"""Communities against a plain run, ticker by ticker."""

import random

import pytest

from tidemark.operators import graph as G

SCHEMA = "src string, dst string, n long"


def one_by_one(edges, passes=20):
    near = {}
    for a, b, n in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = n
    degree = {v: sum(near[v].values()) for v in near}
    m = sum(degree.values()) / 2
    label, total = {v: v for v in near}, dict(degree)
    for _ in range(passes):
        moves = 0
        for v in sorted(near):
            total[label[v]] -= degree[v]
            into = {}
            for u in sorted(near[v]):
                into[label[u]] = into.get(label[u], 0) + near[v][u]
            gain, to = 0, label[v]
            for c, n in into.items():
                if n - total[c] * degree[v] / (2 * m) > gain:
                    gain, to = n - total[c] * degree[v] / (2 * m), c
            moves += to != label[v]
            label[v] = to
            total[to] += degree[v]
        if not moves:
            break
    return label


def drawn(n, chance, seed, most=4):
    dice = random.Random(seed)
    names = [f"T{i:03d}" for i in range(n)]
    dice.shuffle(names)
    pairs = [(i, j) for i in range(n) for j in range(i) if dice.random() < chance(i, j)]
    return [(*sorted((names[i], names[j])), dice.randint(1, most)) for i, j in pairs]


GRAPHS = {
    "sparse": drawn(200, lambda i, j: 0.03, 1),
    "dense, of equal weights": drawn(60, lambda i, j: 0.3, 2, most=1),
    "planted": drawn(200, lambda i, j: 0.5 if i % 10 == j % 10 else 0.02, 3),
    "a hub of all": [("HUB", f"T{i:03d}", 1) for i in range(60)] + drawn(60, lambda i, j: 0.05, 4),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_same_partition_as_one_by_one(spark, name):
    edges = GRAPHS[name]
    got = G.communities(spark.createDataFrame(edges, SCHEMA))
    assert {r["ticker"]: r["community"] for r in got.collect()} == one_by_one(edges)


def test_passes_end_a_run(spark):
    edges = GRAPHS["dense, of equal weights"]
    got = G.communities(spark.createDataFrame(edges, SCHEMA), passes=1)
    assert {r["ticker"]: r["community"] for r in got.collect()} == one_by_one(edges, passes=1) != one_by_one(edges)


def test_odd_edges(spark):
    odd = [("A", "A", 9), (None, "B", 5), ("A", None, 5), ("C", "D", None), ("E", "F", 0), ("A", "B", 1), ("A", "B", 2), ("B", "A", 1)]
    assert {tuple(r) for r in G.communities(spark.createDataFrame(odd, SCHEMA)).collect()} == {("A", "B"), ("B", "B")}
    assert G.communities(spark.createDataFrame([], SCHEMA)).count() == 0
