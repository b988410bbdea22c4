"""Language identification against a slow computation, on pages whose truth is held back."""

import math
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytequarry.llm import language_id
from bytequarry.llm.queries import queries

SF = Path("/root/testdata/sf0.001")


def slow_trigrams(text):
    """Hashed trigrams of bytes, word by word."""
    out = []
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.lower().encode()):
        if re.search(rb"[0-9]", word):
            continue
        b = [32, *(x if x >= 128 or 97 <= x <= 122 else 32 for x in word), 32]
        for i in range(1, len(b) - 1):
            if b[i] != 32:
                out.append((((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 0x9E3779B1) & 0xFFFFFFFF) >> 17)
    return out


def slow_fusion(rows, languages, table):
    """rows (id, text, declared, address) to {id: (language, probability, kept)}."""
    k = len(languages)
    classes = [*languages, "und"]
    grams = {r[0]: slow_trigrams(r[1] or "") for r in rows}
    host = lambda a: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", a or "") or [0, a or ""])[1].lower()
    ll = {}
    for i, g in grams.items():
        ll[i] = [sum(float(table[c][x]) for x in g) * min(len(g), language_id.EVIDENCE) / max(1, len(g)) for c in range(k + 1)]

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    by_host, by_suffix, whole = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [0.0] * k), [0.0] * k
    suffix = lambda h: h.rsplit(".", 1)[-1] if "." in h else ""
    for i, _, _, a in rows:
        if grams[i]:
            for c, p in enumerate(soft(ll[i][:k])):
                by_host[host(a)][c] += p
                by_suffix[suffix(host(a))][c] += p
                whole[c] += p
    overall = [(x + 1) / (sum(whole) + k) for x in whole]
    smooth = lambda n, wider: [(x + language_id.KAPPA * w) / (sum(n) + language_id.KAPPA) for x, w in zip(n, wider, strict=True)]
    out = {}
    for i, _, declared, a in rows:
        h = host(a)
        prior = smooth(by_host[h], smooth(by_suffix[suffix(h)], overall)) if h in by_host else overall
        said = [0.0 if declared not in languages else math.log(language_id.TRUST) if x == declared else math.log((1 - language_id.TRUST) / max(1, k - 1)) for x in languages]
        p = soft([*(l + s + math.log(q) for l, s, q in zip(ll[i], said, prior, strict=False)), ll[i][k] + math.log(language_id.UNKNOWN_PRIOR)])
        best = max(range(k + 1), key=lambda c: p[c])
        out[i] = (classes[best], p[best], p[k] < language_id.REJECT) if grams[i] else ("und", 1.0, False)
    return out


def test_fusion_against_a_slow_computation(spark):
    r = random.Random(12)
    sounds = {"aa": ["the", "of", "ing"], "bb": ["que", "la", "ño"], "cc": ["sch", "ei", "ö"]}
    text = lambda l, n: " ".join("".join(r.choices(sounds[l], k=r.randint(1, 2))) for _ in range(n))
    train = [(i, text(l, 30), l) for i in range(90) for l in [r.choice(list(sounds))]]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = [(i, text(r.choice(list(sounds)), r.choice([1, 3, 40])), r.choice(["aa", "bb", None, "zz"]), r.choice(["http://a.x.org/1", "https://me@B.y.com:80/q", "c.z.com", "plain", None, ""])) for i in range(120)]
    rows += [(500, None, "aa", "http://a.x.org/"), (501, "12 a1 --", "bb", None), (502, "zqjx kvwq zzxq " * 20, "aa", "http://a.x.org/"), (503, "the " * 3000, "cc", "new.host.net")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model).collect()
    want = slow_fusion(rows, *model)
    assert len(got) == len(rows)
    for x in got:
        language, probability, kept = want[x.doc_id]
        assert (x.language, x.kept) == (language, kept) and abs(x.probability - probability) < 1e-5, x


def test_declared_languages():
    said = language_id.declared_language
    assert [said(x) for x in ('<!doctype html><html class=x lang="de-AT">', "<HTML xml:lang='FR'>", "<html lang = es >", "<html><body lang=de>", "", "<html data-lang=de>", "<htmlx lang=de>", '<html lang="">')] == ["de", "fr", "es", None, None, None, None, None]
    assert said('<html><meta charset=utf-8><meta http-equiv="Content-Language" content="it, en">') == "it"


def test_pages_whose_language_is_held_back(spark):
    if not SF.exists():
        pytest.skip("no tables here")
    pages = language_id.page_evidence(spark.read.parquet(f"{SF}/pages.parquet"))
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    truth = {r.page_id: r.declared for r in pages.collect()}
    got = language_id.identify(pages.withColumn("declared", F.lit(None).cast("string")), model, "page_id", "text", "declared", "url").collect()
    assert len(got) == len(truth) and np.mean([r.language == truth[r.doc_id] for r in got]) > 0.95
    query = queries()["op8_language_id"](spark, str(SF))
    assert query.columns == ["page_id", "declared", "language", "probability", "kept"] and query.count() == len(truth)


def test_page_edges(spark):
    rows = spark.createDataFrame([(1, None, None, 1, "x"), (None, "u", "", 2, None), (1, "u", "<html lang=aa><p>the of</p><script>que la</script>", None, "y")], "page_id long, url string, html string, text int, declared string")
    got = language_id.page_evidence(rows).collect()
    assert sorted((str(r.page_id), r.declared, r.text) for r in got if r.text) == [("1", "aa", "the of")] and len(got) == 3
    assert language_id.page_evidence(rows.limit(0)).count() == 0
