from __future__ import annotations

import random

from lectern.llm.neardup import components


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(500, 600 + i) for i in range(30)] + [(700, 700)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["cid"]: r["root"] for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark, spark.createDataFrame([], "a long, b long")).collect() == []
