"""Quality by a sparse rule ensemble: tree paths become conjunctive rules, a lasso weighs them, Spark evaluates them.

Statistics of a text are column expressions, so texts are read once, in one
scan without Python or an exchange. A random forest is grown on the labelled
rows, every path from a root to a node below is a rule, and a logistic model
with an L1 penalty keeps few of them. The score is one expression over the
statistics again.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

#: Of crc32(id as text) mod FOLDS, rows with 0 are held out.
FOLDS = 5
#: The forests (trees, depth, statistics that a node may choose from), so that rules of a single statistic are among them; the penalty on weights.
FORESTS = ((24, 3, "onethird"), (40, 2, "1"))
BINS, PENALTY, ROUNDS, SEED = 64, 0.0002, 60, 7
#: Score from which label 1 is predicted.
LEAST_SCORE = 0.3

#: The statistics that rules speak of.
NAMES = ["log_words", "word_length", "longest_word", "letters", "upper", "digits", "marks", "bangs", "bars", "symbols", "repeated_words", "distinct_words", "repeated_lines", "words_per_stop"]

#: A condition: low < statistic <= high; either bound may be missing.
Condition = tuple[str, float | None, float | None]


def statistics(texts: DataFrame) -> DataFrame:
    """(doc_id, NAMES) of (doc_id, text): statistics of each text, 0 where it has nothing to count.

    log_words, word_length: of maximal runs without white space; longest_word
    as a logarithm. letters, digits, marks, bangs, bars, symbols: shares of the
    characters that aren't white space. upper: of the letters. repeated_words:
    words equal to the one before; distinct_words; repeated_lines: lines that
    stood before; words_per_stop as a logarithm.
    """
    share = lambda part, whole: F.when(F.col(whole) > 0, part / F.col(whole)).otherwise(F.lit(0.0))
    kept = lambda what, of="solid": F.length(F.regexp_replace(of, f"[^{what}]+", ""))
    log = lambda c: F.log1p(c.cast("double"))
    # each step stands in a projection of its own, so that none is worked out twice
    cut = texts.select("doc_id", F.regexp_replace("text", r"\s+", "").alias("solid"), F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("words"), F.split("text", r"[\n\r]+").alias("lines"))
    counted = cut.select(
        "doc_id", "words", F.col("words")[0].alias("first_word"), F.regexp_replace("solid", r"[\p{L}\p{Nd}]+", "").alias("others"), F.length("solid").alias("n_solid"), kept(r"\p{L}").alias("n_letters"), kept(r"\p{Lu}").alias("n_upper"), kept(r"\p{Nd}").alias("n_digits"),
        F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_distinct_lines"),
    )
    marks = counted.withColumn("n_words", F.when(F.col("first_word") == "", 0).otherwise(F.col("n_words"))).withColumn("n_stops", kept(".!?", "others"))
    told = {
        "log_words": log(F.col("n_words")),
        "word_length": share(F.col("n_solid"), "n_words"),
        "longest_word": log(F.array_max(F.transform("words", F.length))),
        "letters": share(F.col("n_letters"), "n_solid"),
        "upper": share(F.col("n_upper"), "n_letters"),
        "digits": share(F.col("n_digits"), "n_solid"),
        "marks": share(kept(r".,;:?'\"()\-", "others"), "n_solid"),
        "bangs": share(kept("!", "others"), "n_solid"),
        "bars": share(kept("|", "others"), "n_solid"),
        "symbols": share(kept(r"\p{S}#%&*@_/\\{}\[\]&&[^|]", "others"), "n_solid"),
        "repeated_words": share(F.size(F.filter(F.zip_with(F.slice("words", 2, F.size("words")), "words", lambda b, a: b == a), lambda x: x)), "n_words"),
        "distinct_words": share(F.col("n_distinct"), "n_words"),
        "repeated_lines": share(F.col("n_lines") - F.col("n_distinct_lines"), "n_lines"),
        "words_per_stop": log(F.col("n_words") / (F.col("n_stops") + 1)),
    }
    return marks.select("doc_id", *[told[n].cast("double").alias(n) for n in NAMES])


def held_out(id_col: str) -> Column:
    """Whether a row takes no part in the fit; a null id counts as the empty text, so it doesn't."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (doc_id, the statistics) of each row; null text is empty. Other columns are not read."""
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return staged(statistics(text), "text-statistics")


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights, over columns of statistics."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """The chance of label 1: an expression over the columns of statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def explain(self) -> list[str]:
        """The rules in words, heaviest first."""
        said = lambda c: " and ".join(filter(None, [c[1] is not None and f"{c[0]} > {c[1]:.4g}", c[2] is not None and f"{c[0]} <= {c[2]:.4g}"]))
        return [f"{w:+.3f} if {' and '.join(map(said, conds))}" for conds, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def holds(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, low, high in conditions:
        if low is not None:
            out = out & (F.col(name) > low)
        if high is not None:
            out = out & (F.col(name) <= high)
    return out


def paths(tree: str, names: list[str]) -> list[tuple[Condition, ...]]:
    """The conditions on the way from the root to each other node of a printed tree; several on one statistic become one."""
    out, above = [], []
    for line in tree.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        above = [x for x in above if x[0] < depth]
        above.append((depth, names[int(m[3])], m[4], float(m[5])))
        found: dict[str, tuple[float, float]] = {}
        for _, name, op, bound in above:
            low, high = found.get(name, (-math.inf, math.inf))
            found[name] = (max(low, bound), high) if op == ">" else (low, min(high, bound))
        out.append(tuple(sorted((n, None if low == -math.inf else low, None if high == math.inf else high) for n, (low, high) in found.items())))
    return out


def fit(rows: DataFrame, label: str = "label", names: list[str] = NAMES) -> Ensemble:
    """The ensemble that rows (statistics and a label of 0 or 1) teach; all of them take part, on Spark.

    Without rows, or with one label only, there are no rules and the score is
    the labels' share, each taken once more than seen.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    seen = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    if len(seen) < 2:
        return Ensemble(math.log((seen.get(1, 0) + 1) / (seen.get(0, 0) + 1)), ())
    vectors = VectorAssembler(inputCols=names, outputCol="__statistics").transform(rows)
    grown = [RandomForestClassifier(featuresCol="__statistics", labelCol=label, numTrees=n, maxDepth=depth, maxBins=BINS, featureSubsetStrategy=choice, subsamplingRate=0.7, seed=SEED).fit(vectors) for n, depth, choice in FORESTS]
    rules = sorted({p for forest in grown for tree in forest.trees for p in paths(tree.toDebugString, names)}, key=repr)
    if not rules:
        return Ensemble(math.log((seen[1] + 1) / (seen[0] + 1)), ())
    fired = rows.select(label, *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="__rules").transform(fired).select(label, "__rules")
    lasso = LogisticRegression(featuresCol="__rules", labelCol=label, elasticNetParam=1.0, regParam=PENALTY, maxIter=ROUNDS).fit(staged_vectors(fired))
    weights = lasso.coefficients.toArray()
    return Ensemble(round(float(lasso.intercept), 6), tuple((r, round(float(w), 6)) for r, w in zip(rules, weights, strict=True) if abs(w) >= 1e-6))


def staged_vectors(rows: DataFrame) -> DataFrame:
    """rows in the shared folder, in as many parts as tasks run at once: each round of the fit reads them again."""
    return staged(rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism), "fired-rules")


def labelled(told: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Staged rows of described() with the label (0 or 1) that `labels` (doc_id, label) gives them; without those held out. Other labels don't count."""
    marks = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct().filter(~held_out("doc_id"))
    return staged(told.join(marks, "doc_id"), "labelled-statistics")


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from LEAST_SCORE on).

    The ensemble learns from rows that `labels` marks with 0 or 1 and that are
    not held out; only statistics of the text are its input. Null text is
    empty and gets a score like any other; repeated rows get equal scores. A
    null id has no label. An empty table gives no row.
    """
    told = described(docs, id_col, text_col)
    ensemble = fit(labelled(told, labels, label))
    score = ensemble.score()
    return told.select(F.col("doc_id").alias(id_col), held_out("doc_id").alias("held_out"), score.alias("score"), F.when(score >= LEAST_SCORE, 1).otherwise(0).alias("predicted"))
