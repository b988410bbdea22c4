"""Many wildcard patterns against many names, without trying each on each.

A pattern's rarest piece of literal text is its key: a piece of GRAM characters
(or fewer where its literals are shorter) that may stand anywhere, or its
longest literal before the first * or after the last, which stands at a fixed
place from the name's start or end and tells names apart however many there
are. A name is asked for under each piece of its own text, and under its text
at each place that patterns name. Keys meet in an equi-join, and the whole
pattern is tried on what met. Patterns of wildcards alone say only how long a
name is, and meet by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import held, light

#: Characters of a piece that stands anywhere, and places of longer ones, those that most patterns name; patterns of other places go by pieces alone.
GRAM, PLACES = 3, 64


def regex_of(pattern: Column) -> Column:
    """The regular expression of a pattern in which * stands for any text and ? for one character."""
    safe = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(safe, r"\*+", ".*"), r"\?", "."), F.lit(r"\z"))


def _grams(text: Column, q: Column | int) -> Column:
    size = F.lit(q) if isinstance(q, int) else q
    n = F.char_length(text) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>"))


def _longest(segment: Column) -> Column:
    """(at, run): the longest text without ? of a segment without *, and where it stands in it."""
    start = F.struct(F.lit(0).alias("next"), F.lit(0).alias("at"), F.lit("").alias("run"))

    def step(a: Column, x: Column) -> Column:
        longer = F.char_length(x) > F.char_length(a["run"])
        return F.struct((a["next"] + F.char_length(x) + 1).alias("next"), F.when(longer, a["next"]).otherwise(a["at"]).alias("at"), F.when(longer, x).otherwise(a["run"]).alias("run"))

    return F.aggregate(F.split(segment, r"\?"), start, step)


def _placed(rule: Column) -> Column:
    """[(side, at, size, run)] of a pattern: h, so many characters after the name's start; t, beginning so many before its end."""
    tail = F.substring_index(rule, "*", -1)
    head, end = _longest(F.substring_index(rule, "*", 1)), _longest(tail)
    place = lambda side, at, run: F.struct(F.lit(side).alias("side"), at.alias("at"), F.char_length(run).alias("size"), run.alias("run"))
    both = F.array(place("h", head["at"], head["run"]), F.when(F.contains(rule, F.lit("*")), place("t", F.char_length(tail) - end["at"], end["run"])))
    return F.filter(both, lambda x: x["size"] > 0)


def _at_places(text: Column, places: list[tuple[str, int, int]]) -> Column:
    """The keys of a name: its text at each place."""
    key = lambda side, at, size: F.when(F.char_length(text) >= (at + size if side == "h" else at), F.concat(F.lit(f"{side}{at}.{size}:"), F.substring(text, at + 1 if side == "h" else -at, size)))
    return F.filter(F.array(*[key(*p) for p in places]).cast("array<string>"), lambda x: x.isNotNull())


def hits(names: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern", fold: bool = False) -> DataFrame:
    """(name, pattern) of each distinct name and each distinct pattern that fits the whole of it; fold: whatever the case.

    Nulls fit nothing; an empty pattern fits the empty name.
    """
    case = F.lower if fold else (lambda c: c)
    distinct = lambda df, c, to: df.select(F.col(c).cast("string").alias(to)).dropna().distinct()
    texts = held(distinct(names, name, "name").withColumn("text", case(F.col("name"))))
    rules = distinct(patterns, pattern, "pattern").withColumn("rule", case(F.col("pattern")))
    runs = F.split("rule", r"[*?]+")
    rules = rules.withColumn("runs", F.filter(runs, lambda x: x != "")).withColumn("q", F.least(F.lit(GRAM), F.coalesce(F.array_max(F.transform("runs", F.char_length)), F.lit(0))))
    rules = held(rules)
    wide = [r["q"] for r in rules.filter("q > 0").select("q").distinct().collect()]

    placed = rules.filter("q > 0").select("pattern", "rule", F.explode(_placed(F.col("rule"))).alias("p")).select("pattern", "rule", "p.*")
    places = [(r["side"], r["at"], r["size"]) for r in placed.groupBy("side", "at", "size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "side", "at", "size").limit(PLACES).collect()]

    pieces = texts.select("name", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[_grams(F.col("text"), q) for q in wide]))).alias("gram"))
    spots = texts.select("name", F.explode(_at_places(F.col("text"), places)).alias("gram"))
    own = F.array_distinct(F.flatten(F.transform("runs", lambda x: _grams(x, F.col("q")))))
    anywhere = held(rules.filter("q > 0").select("pattern", "rule", F.explode(own).alias("gram")))
    at_place = placed.filter(F.struct("side", "at", "size").isin([F.struct(F.lit(x), F.lit(y), F.lit(z)) for x, y, z in places])) if places else placed.limit(0)
    at_place = held(at_place.select("pattern", "rule", F.concat("side", F.col("at").cast("string"), F.lit("."), F.col("size").cast("string"), F.lit(":"), "run").alias("gram")))
    # a pattern with a piece that no name has fits none
    counted = None
    for side, (have, wanted) in enumerate(((pieces, anywhere), (spots, at_place))):
        common = have.select("gram").join(light(held(wanted.select("gram").distinct())), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        each = wanted.join(light(held(common)), "gram", "left").select("pattern", "rule", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.lit(-side).alias("side"), "gram").alias("k"))
        counted = each if counted is None else counted.unionByName(each)
    keys = held(counted.groupBy("pattern", "rule").agg(F.min("k").alias("k")).filter("k.n > 0").select("pattern", "rule", F.col("k.gram").alias("gram"), "k.side"))
    met = pieces.join(light(held(keys.filter("side = 0").drop("side"))), "gram").unionByName(spots.join(light(held(keys.filter("side < 0").drop("side"))), "gram"))
    found = met.filter(F.regexp_like(case(F.col("name")), regex_of(F.col("rule")))).select("name", "pattern")

    # wildcards alone: ? count characters, * lets more follow
    bare = held(rules.filter("q = 0").select("pattern", F.char_length(F.regexp_replace("rule", r"\*", "")).alias("size"), F.contains("rule", F.lit("*")).alias("more")))
    long = F.char_length("text")
    exact = texts.withColumn("size", long).join(light(bare.filter("NOT more")), "size").select("name", "pattern")
    least = texts.withColumn("size", F.explode(F.sequence(F.lit(0), long))).join(light(bare.filter("more")), "size").select("name", "pattern")
    return found.unionByName(exact).unionByName(least).select(F.col("name").alias(name), F.col("pattern").alias(pattern))


def selected(rows: DataFrame, name: str, include: DataFrame | None = None, exclude: DataFrame | None = None, pattern: str = "pattern", fold: bool = False) -> DataFrame:
    """Rows whose name some pattern of include fits (all, without one) and none of exclude; a null name is never included and never excluded."""
    out = rows
    for patterns, how in ((include, "left_semi"), (exclude, "left_anti")):
        if patterns is not None:
            fits = held(hits(rows, patterns, name, pattern, fold).select(name).distinct())
            out = out.join(light(fits), name, how)
    return out
