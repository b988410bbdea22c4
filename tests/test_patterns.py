import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from bytequarry.operators import patterns
from bytequarry.sources import blobs


def brute(names, rules, fold=False):
    low = (lambda x: x.lower()) if fold else (lambda x: x)
    made = {p: re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in low(p)) + r"\Z", re.S) for p in rules}
    return sorted((n, p) for n in names for p in rules if made[p].match(low(n)))


def frames(spark, names, rules):
    return spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "name string"), spark.createDataFrame([(p,) for p in [*rules, None, rules[0]]], "pattern string")


@pytest.mark.parametrize("fold", [False, True])
def test_hits_equal_trying_each_on_each(spark, fold):
    r = random.Random(7)
    made = lambda n: "".join(r.choices("abBé._*?[+", k=n))
    names = sorted({made(r.randint(0, 9)) for _ in range(300)} | {"", "BGM_01.wav", "bgm_02.WAV", "a\nb", "x" * 300})
    rules = sorted({made(r.randint(0, 6)) for _ in range(200)} | {"", "*", "**", "?", "?*?", "bgm_??.*", "*.wav", "a?b", "nowhere*", "?" * 300, "*x"})
    left, right = frames(spark, names, rules)
    got = sorted((x["name"], x["pattern"]) for x in patterns.hits(left, right, fold=fold).collect())
    assert got == brute(names, rules, fold)


def test_ten_thousand_patterns_without_a_nested_loop(spark):
    names = spark.range(20_000).select(F.format_string("dir/%05d_%s.bin", "id", F.hex(F.col("id") * 7919)).alias("name"))
    rules = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, F.format_string("dir/%05d_*", "id")).otherwise(F.format_string("*_%s.b?n", F.hex(F.col("id") * 7919))).alias("pattern"))
    got = patterns.hits(names, rules)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 10_000


def test_include_and_exclude(spark):
    rows, some = frames(spark, ["a.wav", "b.wav", "a.txt", "c"], ["a*", "*.wav"])
    out = spark.createDataFrame([("b*",)], "pattern string")
    assert sorted(r["name"] for r in patterns.selected(rows, "name", some, out).collect()) == ["a.txt", "a.wav", "a.wav"]
    assert sorted(str(r["name"]) for r in patterns.selected(rows, "name", exclude=some).collect()) == ["None", "c"]
    assert patterns.selected(rows, "name", some.limit(0)).collect() == []


def test_list_file(spark):
    files = spark.createDataFrame([("/d/one.bin", 1), ("/d/two.txt", 2), ("/e/three.bin", 3)], "path string, n int")
    lines = spark.createDataFrame([("# all of *",), (" t*.bin ",), ("one.???",), ("",)], "line string")
    assert sorted(r.path for r in blobs.from_list(files, lines).collect()) == ["/d/one.bin", "/e/three.bin"] == sorted(p for p in ("/d/one.bin", "/d/two.txt", "/e/three.bin") if any(fnmatch.fnmatchcase(p[3:], x) for x in ("t*.bin", "one.???")))


def test_candidates_by_place_are_few(spark, monkeypatch):
    """Numbers behind a common head: pieces of three digits would let each name meet many patterns."""
    tried = spark.sparkContext.accumulator(0)
    real = patterns.regex_of

    @F.udf("string", useArrow=False)
    def seen(x):
        tried.add(1)
        return x

    monkeypatch.setattr(patterns, "regex_of", lambda p: real(seen.asNondeterministic()(p)))
    names = spark.range(20_000).select(F.format_string("o/%d_O.1", F.col("id") + 100_000).alias("name"))
    rules = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.format_string("o/%d*", F.col("id") + 101_000)).otherwise(F.format_string("*%d_O.?", F.col("id") + 101_000)).alias("pattern"))
    assert patterns.hits(names, rules).count() == 4000
    assert tried.value <= 3 * 4000


def test_places_beyond_the_most_named_go_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(patterns, "PLACES", 1)
    r = random.Random(3)
    names = sorted({"".join(r.choices("abé_", k=r.randint(0, 8))) for _ in range(200)})
    rules = sorted({"".join(r.choices("abé_*?", k=r.randint(0, 6))) for _ in range(150)})
    left, right = frames(spark, names, rules)
    assert sorted((x["name"], x["pattern"]) for x in patterns.hits(left, right).collect()) == brute(names, rules)
