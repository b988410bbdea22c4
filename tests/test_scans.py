import random
import re

import pytest
from pyspark.sql import functions as F

from bytequarry.operators import ordered, scans


def frame(spark, n=300, keys=(1, 1, 1, 2, None)):
    r = random.Random(n)
    made = [(r.choice(keys), i, r.choice([None, "a", "b", "b"]), r.choice([None, 0, 5, 9]), r.random() < 0.2, r.choice(["", " ", "x"]), 7, 8, 9) for i in range(n)]
    r.shuffle(made)
    return spark.createDataFrame(made, "k int, seq int, v string, size int, e boolean, line string, g0 int, at int, row int").repartition(5)


OPERATORS = {
    "islands": lambda df, hot: ordered.islands(df, ["k"], ["seq"], F.col("e"), hot=hot),
    "islands_after": lambda df, hot: ordered.islands_after(df, ["k"], ["seq"], F.col("e"), hot=hot),
    "islands_on_change": lambda df, hot: ordered.islands_on_change(df, ["k"], ["seq"], F.col("v"), F.col("e"), hot=hot),
    "carried": lambda df, hot: ordered.carried(df, ["k"], ["seq"], F.col("v"), "last", F.lit("none"), hot=hot),
    "carried_or_first": lambda df, hot: ordered.carried_or_first(df, ["k"], ["seq"], F.col("v"), "v", hot=hot),
    "one_shot": lambda df, hot: ordered.one_shot(df, ["k"], ["seq"], F.col("v"), F.col("e"), "used", hot=hot),
    "running_offsets": lambda df, hot: ordered.running_offsets(df, ["k"], "seq", "size", hot=hot),
    "sizes_by_next": lambda df, hot: ordered.sizes_by_next(df.drop("size"), ["k"], "seq", F.lit(1000), hot=hot),
    "numbered": lambda df, hot: ordered.numbered(df, ["k"], ["seq"], hot=hot),
    "falls": lambda df, hot: ordered.falls(df, ["k"], ["seq"], "size", hot=hot),
    "blanks": lambda df, hot: ordered.without_repeated_blanks(df, ["k"], "seq", "line", hot=hot),
    "first_flag": lambda df, hot: ordered.first_flag(df, ["k"], ["seq"], hot=hot),
    "names": lambda df, hot: ordered.numbered_names(df, "v", ["seq"], hot=hot),
    "sections": lambda df, hot: ordered.section_sorted(df, "k", "seq", "line", hot=hot),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_large_keys_give_what_a_window_gives(spark, name):
    df = frame(spark)
    whole, cut = (OPERATORS[name](df, hot) for hot in (None, 40))
    assert cut.columns == whole.columns and [f.dataType for f in cut.schema] == [f.dataType for f in whole.schema]
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_holds_a_large_key(spark):
    df = frame(spark, 400, keys=(1,))
    got = ordered.islands(df, ["k"], ["seq"], F.col("e"), hot=50)
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan(got))
    assert any(w.startswith("part#") for w in windows)
    assert got.count() == 400
    parts = scans.running(df, [], ["seq"], {"n": scans.Running("sum", F.lit(1))}, hot=50)
    assert sorted(r.n for r in parts.collect()) == list(range(1, 401))


def test_values_before_by_plain_python(spark):
    df = frame(spark, 120)
    rows = sorted((r.k is not None, r.k or 0, r.seq, r.size) for r in df.collect())
    want, last = {}, {}
    for a, b, seq, size in rows:
        want[seq] = last.get((a, b))
        last[a, b] = size
    got = scans.running(df, ["k"], ["seq"], {"b": scans.before(F.col("size"))}, hot=10)
    assert {r.seq: r.b and r.b.v for r in got.collect()} == want


def test_empty_and_ties(spark):
    empty = frame(spark, 20).limit(0)
    assert ordered.numbered(empty, ["k"], ["seq"], hot=0).collect() == []
    same = spark.range(200).select(F.lit(1).alias("k"), F.lit(1).alias("seq"), F.lit("x").alias("n"))
    assert sorted(r.n for r in ordered.numbered(same, ["k"], ["seq"], hot=10).collect()) == list(range(200))
