import random

import pytest
from pyspark.sql import functions as F

from bytequarry.operators import graph


def brute(roots, edges):
    kids = {}
    for s, o, d in edges:
        kids.setdefault(s, []).append((o, d))
    out = []
    for root in roots:
        met = []

        def walk(node, above):
            for _, d in sorted(set(kids.get(node, []))):
                if d in above:
                    continue
                if d >= 100:
                    met.append(d)
                else:
                    walk(d, above | {d})

        walk(root, {root})
        out += [(root, leaf, i) for i, leaf in enumerate(dict.fromkeys(met), 1)]
    return sorted(out)


def found(spark, roots, edges):
    r = spark.createDataFrame([(x,) for x in [*roots, roots[0], None]], "node long")
    e = spark.createDataFrame([*edges, edges[0], (None, 1, 3), (3, 1, None)], "src long, ordinal long, dst long").repartition(2)
    return sorted((x.root, x.leaf, x.place) for x in graph.first_leaves(r, e, F.col("dst") >= 100).collect())


@pytest.mark.parametrize("cycles", [False, True])
def test_leaves_where_a_walk_meets_them_first(spark, cycles):
    r = random.Random(6)
    edges = []
    for i in range(12):
        targets = r.sample(range(i + 1, 14), min(13 - i, r.randint(1, 3))) + r.sample(range(100, 110), r.randint(0, 2))
        if cycles and i % 5 == 3:
            targets.append(r.randint(0, i))
        r.shuffle(targets)
        edges += [(i, o, d) for o, d in enumerate(targets)]
    assert found(spark, [0, 1, 4, 11, 50], edges) == brute([0, 1, 4, 11, 50], edges)


def test_a_chain_of_diamonds_ends(spark):
    edges = []
    for i in range(0, 48, 2):  # 2**24 paths; shifted so that no inner node looks like a leaf
        a, b, end = -3 * i - 1, -3 * i - 2, -3 * i - 6
        edges += [(-3 * i, 0, a), (-3 * i, 1, b), (a, 0, end), (a, 1, 100 + i), (b, 0, end), (b, 1, 101 + i)]
    edges += [(-144, 0, 1000)]
    got = found(spark, [0], edges)
    assert len(got) == 49 and got[-1] == (0, 1000, 1)
    # the deepest are met first: its own leaf of every first branch, then those of the second
    assert [x[1] for x in sorted(got, key=lambda x: x[2])][:3] == [1000, 146, 147]
