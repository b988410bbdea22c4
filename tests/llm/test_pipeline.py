"""The pipeline's stages against brute force, each on what its predecessor kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from bytequarry.llm import decontaminate, language_id

from test_corpus import edit_distance, pieces_hold, plain
from test_dedup import brute_links

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def place(spark, docs, corpus, tmp_path_factory):
    """The corpus without its one very long text, a benchmark with a passage of it, and an empty table."""
    folder = tmp_path_factory.mktemp("pipeline")
    item = " ".join(corpus[3][1].split()[10:40])
    spark.createDataFrame([(1, item), (2, None), (3, "nowhere to be found in here at all")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs.filter("doc_id <> 76 OR doc_id IS NULL").withColumn("__uid", F.lit(1)).write.parquet(str(folder / "documents.parquet"))
    return folder, item


def test_stages_in_order(spark, place, tokens_path):
    folder, item = place
    now = spark.read.parquet(str(folder / "documents.parquet"))
    columns = now.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, now, str(folder))
        if name != "packed":
            assert df.columns == columns, name
        df.write.parquet(str(folder / f"after-{name}"))
        after[name] = (now, now := spark.read.parquet(str(folder / f"after-{name}")))
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    key = lambda x: sorted(x, key=str)

    # language: what fusion keeps, which a slow computation holds elsewhere
    before, kept = after["language"]
    verdict = language_id.identify(before, language_id.fit(before)).filter("kept")
    assert Counter(r.doc_id for r in verdict.collect()) == Counter(d for d, _ in rows(kept))
    # exact: of equal texts the largest id, once
    before, kept = after["exact"]
    best = {}
    for d, t in rows(before):
        best[t or ""] = max(best.get(t or "", -1), -1 if d is None else d)
    assert key((d, t or "") for d, t in rows(kept)) == key((None if d < 0 else d, t) for t, d in best.items())
    # near: of each class the least id
    before, kept = after["near"]
    every = rows(before)
    alone = Counter(d for d, c, n in brute_links(every) if n == 0 or d == c)
    assert Counter(d for d, _ in rows(kept)) == alone
    # clean: no item within its budget of edits
    before, kept = after["clean"]
    pattern = plain(item)
    assert key(d for d, t in rows(before) if edit_distance(pattern, plain(t)) > int(len(pattern) * decontaminate.RATE)) == key(d for d, _ in rows(kept))
    assert len(rows(kept)) < len(every)
    # packed: every token once, in full sequences
    before, pieces = after["packed"]
    pieces_hold(pieces.collect(), rows(before), tokens_path, 1024, added=True)


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_nothing(spark, place, name):
    folder, _ = place
    none = spark.read.parquet(str(folder / "documents.parquet")).limit(0)
    got = STAGES[name](spark, none, str(folder))
    assert got.count() == 0 and (name == "packed" or got.columns == none.columns)
