import random

from weftline.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def run(spark, edges):
    return {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 360)]
    assert run(spark, edges) == brute([e for e in edges if e[0] != e[1]])


def test_nulls_loops_repeats_and_no_edges(spark):
    assert run(spark, [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None)]) == {1: 1, 2: 1}
    assert run(spark, []) == {}
