import random

import pytest

from cdm_engine.llm.components import components


@pytest.mark.parametrize("shape", ["path", "shuffled path", "star", "random"])
def test_against_union_find(spark, shape):
    r = random.Random(3)
    n = 120
    names = list(range(n))
    if shape == "shuffled path":
        r.shuffle(names)
    edges = {"star": [(names[60], x) for x in names if x != 60], "random": [(r.choice(names), r.choice(names)) for _ in range(70)]}.get(shape, list(zip(names, names[1:], strict=False)))
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
