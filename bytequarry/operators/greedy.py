"""The greedy one-to-one choice of scored pairs, over many tasks.

Pairs stand in one total order (score, then ids). A pair that is the first of
both its sides is chosen by the sequential choice as well, whatever else
happens, so each round takes all such pairs at once and leaves out the pairs
that share a side with them. Problems of few pairs are solved whole by a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similar import one_to_one
from .staging import held, light

#: Pairs of a problem that one task may sort.
TASK_PAIRS = 200_000


def one_to_one_in_rounds(pairs: DataFrame, problem: str, left: str, right: str, score: str, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """The pairs that one_to_one chooses: in each problem by falling score (then left, right), each side used once.

    A problem of more than task_pairs pairs goes in rounds of grouped maxima
    until what is left of it is as few. A null score, id or problem is no
    pair; of repeated pairs the best stands. Rounds follow the longest chain
    of pairs each better than the next, some dozen for scores without pattern.
    """
    p, l, r, s = "p", "l", "r", "s"
    names = {problem: p, left: l, right: r, score: s}
    now = pairs.select(*[F.col(a).alias(b) for a, b in names.items()]).dropna()
    now = held(now.groupBy(p, l, r).agg(F.max(s).cast("double").alias(s)))
    chosen: list[DataFrame] = []
    while True:
        sizes = held(now.groupBy(p).agg((F.count("*") > task_pairs).alias("large")))
        # problems may be few and large, so the pairs stay where they are
        split = now.join(light(sizes), p)
        chosen.append(one_to_one(split.filter("NOT large").drop("large"), p, l, r, s))
        if sizes.filter("large").isEmpty():
            break
        large = split.filter("large").drop("large")
        # the first of each side is its highest score, then the least of the other side, which a struct's order says from scores turned round
        first = lambda side, other: large.groupBy(p, side).agg(F.min(F.struct((-F.col(s)).alias("m"), F.col(other))).alias("b")).select(p, side, F.col(f"b.{other}").alias(other), (-F.col("b.m")).alias(s))
        taken = held(first(l, r).join(first(r, l), [p, l, r, s]))
        chosen.append(taken)
        now = held(large.join(taken.select(p, l), [p, l], "left_anti").join(taken.select(p, r), [p, r], "left_anti"))
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out.select(*[F.col(b).alias(a) for a, b in names.items()])
