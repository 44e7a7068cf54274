"""Levels of call graphs that are taken off layer by layer."""

import random

from millrace.operators import graph


def test_levels_of_large_scopes(spark, monkeypatch):
    random.seed(5)
    nodes = [(s, n) for s in (0, 1) for n in range(60)]
    edges = {(s, a, random.randrange(max(a, 1))) for s, a in nodes if a % 7} | {(0, 30, 31), (0, 31, 30), (1, 20, 20), (1, 10, 12), (1, 12, 40), (1, 40, 10)}
    n, e = spark.createDataFrame(nodes, "scope int, node long"), spark.createDataFrame(sorted(edges), "scope int, src long, dst long")
    want = {(r["scope"], r["node"]): r["level"] for r in graph.components(n, e, "scope", "node").collect()}
    monkeypatch.setattr(graph, "AT_ONCE", 5)
    sizes, rest = [], graph._rest_levels
    monkeypatch.setattr(graph, "_rest_levels", lambda base, *a: (sizes.append(base.count()), rest(base, *a))[1])
    got = {(r["scope"], r["node"]): r["level"] for r in graph.levels(n, e, "scope", "node").collect()}
    assert got == want and sizes[0] < 60
