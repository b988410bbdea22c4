import random
import re
from collections import Counter

import pytest

from bytequarry.llm import collocations as c

FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, longest=5, least=100, share=100, top=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    known = {k: v for k, v in counts.items() if v >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in known.items():
        cuts = [(1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(lang == x and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in known.items())
        if not inside:
            out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(best, 1)]
    return sorted(ranked)


def texts(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "of", "Ünd", "ünd", "new", "york", "a", "😀", "x y", "l'eau", "-"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! ", "\x0b", "; ", "\x85"]
    made = lambda k: "".join(r.choice(words) + r.choice(seps) for _ in range(k))
    rows = [(made(r.randint(0, 60)) + ("New York is big " * r.randint(0, 2)), r.choice(["en", "de", None, ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \n\t ", "de"), ("a a a a a a a a", "en"), ("word", None), ("same words " * 3000, "en"), (rows[0][0], rows[0][1]), ("und this", "und")]


def frame(spark, rows):
    return spark.createDataFrame([(t, g, "p", 1, 2) for t, g in rows], "text string, lang string, phrase string, n long, words int").repartition(3)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("seed,least,longest,share,top", [(1, 3, 5, 100, 2000), (2, 5, 4, 60, 2000), (3, 2, 2, 100, 7)])
def test_equal_to_brute_force(spark, seed, least, longest, share, top):
    rows = texts(seed)
    got = found(c.collocations(frame(spark, rows), least=least, longest=longest, share=share, top=top))
    assert got == brute(rows, longest, least, share, top)


def test_small_blocks_and_full_sketches_give_the_same(spark, monkeypatch):
    """A sketch of 16 cells lets everything through; blocks of 256 bytes cut texts where pieces end."""
    rows = texts(4)
    frame_ = frame(spark, rows)
    fold, want = c._FOLD, found(c.collocations(frame_, least=4))
    monkeypatch.setattr(c, "BLOCK", 256)
    lang_blocks = list(c._blocks(iter(frame_.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").toArrow().to_batches())))
    whole = Counter(w for t, g in rows if t and g is not None for w in t.encode().translate(fold).split())
    assert Counter(w for _, b in lang_blocks for w in b.split()) == whole
    assert all(b.endswith(b"\n") for _, b in lang_blocks)
    monkeypatch.setattr(c, "MIN_BITS", 4)
    monkeypatch.setattr(c, "MAX_BITS", 4)
    parts = list(c._combined(c._batch("en", 1, c.pa.array([str(i % 7), "x"]), [1, i]) for i in range(40)))
    assert sum(c.pa.Table.from_batches(parts).column("n").to_pylist()) == 40 + sum(range(40)) and sum(b.num_rows for b in parts) == 8
    monkeypatch.setattr(c, "COMBINED", 5)
    parts = list(c._combined(c._batch("en", 1, c.pa.array([str(i % 7), "x"]), [1, i]) for i in range(40)))
    assert sum(c.pa.Table.from_batches(parts).column("n").to_pylist()) == 40 + sum(range(40))
    assert found(c.collocations(frame_, least=4)) == want == brute(rows, least=4)


def test_counts_beyond_64_bits_in_products(spark):
    counts = spark.createDataFrame([("en", 0, "", 9_000_000_000_000_000), ("en", 1, "a", 5_000_000_000_000), ("en", 1, "b", 4_000_000_000_000), ("en", 2, "a b", 3_000_000_000_000)], "lang string, words int, phrase string, n long")
    (r,) = c.scored(counts).collect()
    assert r.score == 1000 * 3_000_000_000_000 * 9_000_000_000_000_000 // (5_000_000_000_000 * 4_000_000_000_000)


def test_nothing(spark):
    for rows in ([], [(None, None)], [("", "en")], [("one two", "en")]):
        assert c.collocations(frame(spark, rows)).collect() == []
