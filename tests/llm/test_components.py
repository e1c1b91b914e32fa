import random

from bucketwise.llm.components import components


def brute(links):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(1000 + i, 1001 + i) for i in range(130)] + [(5000, i) for i in range(6000, 6200)] + [(1, 1), (None, 2), (3, None), (-5, -9)]
    want = brute(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
