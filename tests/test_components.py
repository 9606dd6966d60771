import random

from ledgerline.operators.components import components


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (1, 1), (None, 4), (9, None)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, q in edges:
        if p is not None and q is not None:
            x, y = sorted((top(p), top(q)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()}
    assert got == {x: top(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "p long, q long"), "p", "q").count() == 0
