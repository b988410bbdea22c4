import random

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import hashx
from bytequarry.operators import names, sets


def members(spark):
    r = random.Random(2)
    rows = []
    for o in range(60):
        n = r.choice([0, 1, 1, 2, 2, 3])
        rows += [(o, x, f"n{o % 3}") for x in r.sample("abcd", n) for _ in range(r.randint(1, 2))]
        if r.random() < 0.2:
            rows.append((o, None, f"n{o % 3}"))
    rows += [(None, "a", "n0"), (100, "a", None), (101, None, "n0"), (102, None, "n0")]
    return spark.createDataFrame(rows, "o int, x string, name string")


def brute(df):
    held, name = {}, {}
    for r in df.collect():
        if r.o is not None and r.x is not None:
            held.setdefault(r.o, set()).add(r.x)
        if r.o is not None:
            name[r.o] = r.name
    out = {}
    for o, s in held.items():
        same = [p for p, t in held.items() if t == s]
        if len(same) > 1:
            out[o] = (min(same), len(s), sum(name[p] != name[o] for p in same))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_sets_meet_by_prints_and_are_compared(spark, monkeypatch, weak):
    """With a print that says nothing but the size, members alone tell sets apart."""
    if weak:
        monkeypatch.setattr(sets, "_print", lambda x: [F.count("*").alias("n")])
    df = members(spark)
    want = brute(df)
    got = {r.o: (r.set_id, r.n_members) for r in sets.set_classes(df, "o", "x").collect()}
    assert got == {o: v[:2] for o, v in want.items()}
    partners = {r.o: (r.set_id, r.n_members, r.partners) for r in sets.set_partners(df, "o", "x", "name").collect()}
    assert partners == {o: v for o, v in want.items() if v[2]}
    assert sets.set_classes(df.limit(0), "o", "x").collect() == []


def test_no_set_is_gathered(spark):
    df = members(spark)
    plan = sets.set_classes(df, "o", "x")._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan


@pytest.mark.parametrize("kind,hasher", [("joaat", hashx.joaat), ("fnv1", hashx.fnv1)])
def test_states_meet_in_the_middle(spark, kind, hasher):
    words = ["", "a", "Bgm_", "été", "x\\y", "long_" * 30, "z9"]
    ends = ["", "_01", "É", "B", "\\q", "a"]
    p, s = (spark.createDataFrame([(w,) for w in [*x, x[0], None]], "w string") for x in (words, ends))
    names_ = [a + b for a in words for b in ends]
    some = spark.createDataFrame([(n,) for n in [*names_[::3], "nothing"]], "n string").select(hasher(F.col("n")).alias("h")).unionByName(spark.createDataFrame([(None,)], "h long"))
    known = {r.h for r in some.collect()}
    every = spark.createDataFrame([(a, b) for a in words for b in ends], "a string, b string").withColumn("h", hasher(F.concat("a", "b")))
    want = sorted((r.h, r.a, r.b) for r in every.collect() if r.h in known)
    got = names.met_in_the_middle(p.withColumnRenamed("w", "p"), s, some, "p", "w", "h", kind)
    assert sorted((r.h, r.p, r.w) for r in got.collect()) == want
