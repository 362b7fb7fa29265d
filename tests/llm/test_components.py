"""Components of few edges, found by one task, are those of rounds of stars."""

import random

import numpy as np

from tessera.llm import components as cc


def test_least_nodes_are_those_of_a_search():
    r = random.Random(5)
    for n in (1, 2, 40, 300):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(n // 2 + 1)] + [(k + 1000, k + 1001) for k in range(60)]
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = {}
        for node in sorted(near):
            todo = [node] if node not in want else []
            while todo:
                if (x := todo.pop()) not in want:
                    want[x] = node
                    todo += near[x]
        nodes, least = cc.least_of(*(np.array(x, np.int64) for x in zip(*edges)))
        assert dict(zip(nodes.tolist(), least.tolist())) == want


def test_few_edges_are_settled_by_one_job_as_by_stars(spark, monkeypatch):
    r = random.Random(6)
    edges = cc.directed(spark.createDataFrame([(r.randrange(80), r.randrange(80)) for _ in range(50)], "a long, b long")).cache()
    few = {tuple(x) for x in cc.contract(edges, 1).collect()}
    assert few == {tuple(x) for x in cc.settle(edges).collect()} and cc.settle(edges.limit(0)).count() == 0
    monkeypatch.setattr(cc, "FEW", 0)
    assert few == {tuple(x) for x in cc.settle(edges).collect()}
