import math
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bytequarry.llm import rule_ensemble as rules

SF = Path("/root/testdata/sf0.01")


def brute(text):
    """The statistics by plain Python."""
    text = text or ""
    words, lines = re.findall(r"[^ \t\n\x0b\f\r]+", text), re.split(r"[\n\r]+", text)
    solid = "".join(words)
    share = lambda a, b: a / b if b else 0.0
    count = lambda cond: sum(map(cond, solid))
    import unicodedata as u

    letters, sign = count(lambda c: u.category(c)[0] == "L"), lambda c: u.category(c)[0] == "S"
    return {
        "log_words": math.log1p(len(words)),
        "word_length": share(len(solid), len(words)),
        "longest_word": math.log1p(max(map(len, words), default=0)),
        "letters": share(letters, len(solid)),
        "upper": share(count(lambda c: u.category(c) == "Lu"), letters),
        "digits": share(count(lambda c: u.category(c) == "Nd"), len(solid)),
        "marks": share(count(lambda c: c in ".,;:?'\"()-"), len(solid)),
        "bangs": share(count(lambda c: c == "!"), len(solid)),
        "bars": share(count(lambda c: c == "|"), len(solid)),
        "symbols": share(count(lambda c: c != "|" and (sign(c) or c in "#%&*@_/\\{}[]")), len(solid)),
        "repeated_words": share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
        "distinct_words": share(len(set(words)), len(words)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        "words_per_stop": math.log1p(len(words) / (1 + count(lambda c: c in ".!?"))),
    }


TEXTS = [None, "", " \n\t ", "one", "Two words.", "THE!! THE!! END!!", "a | b | c", "x*** y$$$ %%% &&&", "same same same same", "line\nline\nline\nother", "Été ÉTÉ 日本 😀 42 €", "a-b 'c' (d)?", "tail \n", "w" * 50_000, "word " * 30_000, "=+<>~^`|_/\\[]{}@#", " lead\r\n\r\nx"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1.0, 2) for i, t in rows], "doc_id long, text string, lang string, score double, words int")


def test_statistics_equal_a_plain_count(spark):
    got = {r.doc_id: r for r in rules.described(frame(spark, enumerate(TEXTS))).collect()}
    for i, t in enumerate(TEXTS):
        for name, want in brute(t).items():
            assert got[i][name] == pytest.approx(want, abs=1e-12), (t and t[:20], name)


def test_paths_of_a_printed_tree():
    tree = "DecisionTree: uid=x\n  If (feature 0 <= 1.5)\n   If (feature 1 <= -2.0E-4)\n    Predict: 0.0\n   Else (feature 1 > -2.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   If (feature 0 <= 3.0)\n    Predict: 0.0\n   Else (feature 0 > 3.0)\n    Predict: 1.0"
    assert rules.paths(tree, ["a", "b"]) == [
        (("a", None, 1.5),),
        (("a", None, 1.5), ("b", None, -2e-4)),
        (("a", None, 1.5), ("b", -2e-4, None)),
        (("a", 1.5, None),),
        (("a", 1.5, 3.0),),
        (("a", 3.0, None),),
    ]


def test_compiled_score_equals_the_rules_one_by_one(spark):
    e = rules.Ensemble(-0.5, (((("upper", 0.1, None), ("bars", None, 0.2)), 1.25), ((("log_words", 0.5, 3.0),), -2.0), ((("bangs", None, 0.0),), 0.75)))
    told = rules.described(frame(spark, enumerate(TEXTS)))
    for r in told.withColumn("score", e.score()).collect():
        z = e.intercept + sum(w for conds, w in e.rules if all((lo is None or r[n] > lo) and (hi is None or r[n] <= hi) for n, lo, hi in conds))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_held_out_rows_teach_nothing_and_are_judged_well(spark):
    if not SF.exists():
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    got = rules.rate(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    out = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in out) >= 0.95 * len(out)
    assert all(a == 1 for a, b in out if b == 1)
    # turned labels of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(rules.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.predicted for r in rules.rate(docs.withColumn("lang", F.lit(None)), turned).collect()}
    assert again == {r.doc_id: r.predicted for r in rows}


def test_without_labels_or_with_one(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, None), (None, "x")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in rules.rate(docs, none).collect()] == [(0.5, 1)] * 4
    ones = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 6)] + [(None, 0), (7, None), (8, 5)], "doc_id long, quality int")
    scores = {round(r.score, 6) for r in rules.rate(docs, ones).collect()}
    taught = sum(i in (1, 1, 2) and zlib.crc32(str(i).encode()) % 5 > 0 for i in (1, 1, 2))
    assert scores == {round((taught + 1) / (taught + 2), 6)}
    assert rules.rate(frame(spark, []), ones).collect() == []
