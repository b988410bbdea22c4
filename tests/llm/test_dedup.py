import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytequarry.llm import exact_dedup, jaccard_join, substring_dedup
from bytequarry.llm.components import components
from bytequarry.llm.suffix_automaton import SuffixAutomaton
from bytequarry.llm.wordhash import ngram_hashes, sliding, words


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 48) - 1), min_size=1, max_size=300))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.int64)
    assert exact_dedup.golomb_decode(len(v), *exact_dedup.golomb_encode(v)).tolist() == v.tolist()


def test_exact_duplicates(docs, corpus, nothing):
    got = exact_dedup.exact_duplicates(docs).collect()
    texts = Counter(r[1] or "" for r in corpus)
    last = {}
    for d, t, *_ in corpus:
        if d is not None:
            last[t or ""] = max(d, last.get(t or "", d))
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert len(got) == len(corpus)
    for r in got:
        t = digest[r.text_sha256]
        assert (r.group_size, r.keep_id) == (texts[t], last.get(t))
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(texts)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter(dict.fromkeys(texts, 1))
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0


def test_fingerprint_collisions_drop_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FINGERPRINT_BITS", 8)
    monkeypatch.setattr(exact_dedup, "suspects", lambda f, n, bits=8: exact_dedup.staged(f.distinct(), "all"))
    df = spark.createDataFrame([(i, f"t{i % 700}") for i in range(1000)], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(df).collect()
    assert sum(r.kept for r in got) == 700 and {r.group_size for r in got} == {1, 2}


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_spans(rows, k):
    seen, out = set(), []
    for d, t in rows:
        w = WORD.findall((t or "").encode())
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                keep[i : i + k] = [False] * k
            seen.add(key)
        out.append((d, len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, y in zip(w, keep, strict=True) if y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [256, 1])
def test_substring_dedup(docs, corpus, nothing, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    ordered = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    # rows that repeat an id here repeat the text too or have none, so their order doesn't matter
    want = brute_spans([(r[0], r[1]) for r in ordered], 20)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.strip_repeats(docs).collect()), key=str)
    assert got == want
    if hot == 256:
        assert substring_dedup.strip_repeats(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=5))
def test_automaton_against_brute_force(spans):
    sam, past = SuffixAutomaton(), []
    for span in spans:
        held = lambda w, upto: any(w == s[i : i + len(w)] for s in past for i in range(len(s) - len(w) + 1)) or any(w == span[i : i + len(w)] for i in range(upto - len(w)))  # noqa: B023, E731
        want_match = [max((n for n in range(1, e + 2) if any(span[e - n + 1 : e + 1] == s[i : i + n] for s in past for i in range(len(s) - n + 1))), default=0) for e in range(len(span))]
        assert sam.match(span) == want_match
        want = [max((n for n in range(1, e + 2) if held(span[e - n + 1 : e + 1], e + 1)), default=0) for e in range(len(span))]
        assert sam.add(span) == want
        past.append(span)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n é", max_size=30), min_size=1, max_size=6))
def test_words_and_hashes(texts):
    raw = [t.encode() for t in texts]
    w = words(raw)
    want = [x for t in raw for x in WORD.findall(t)]
    assert [w.data[a:b] for a, b in zip(w.begin, w.end, strict=True)] == want
    by = {}
    assert all(by.setdefault(x, h) == h for x, h in zip(want, w.hash.tolist(), strict=True)) and len(set(by.values())) == len(by)
    grams = [tuple(want[i : i + 3]) for i in range(len(want) - 2)]
    by = {}
    assert all(by.setdefault(g, h) == h for g, h in zip(grams, ngram_hashes(w.hash, 3).tolist(), strict=True)) and len(set(by.values())) == len(by)


def test_sliding():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 15, 16):
        assert sliding(x, width, np.minimum).tolist() == [min(x[i : i + width]) for i in range(51 - width)]


def brute_links(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower().encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in classes.items()}
    return sorted(((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("bucket", [512, 3])
def test_jaccard_join(docs, corpus, nothing, bucket):
    want = brute_links([(r[0], r[1]) for r in corpus])
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs, bucket=bucket).collect()), key=str)
    assert got == want
    if bucket == 512:
        assert jaccard_join.near_duplicates(nothing).count() == 0
        left = jaccard_join.drop_near_duplicates(docs)
        assert left.columns == docs.columns
        kept = Counter(r.doc_id for r in left.collect())
        assert set(kept) == {d for d, c, _ in want if d is None or d == c}


def test_common_counts_both_ways():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 120).astype(np.uint64)) for _ in range(60)]
    a, b = np.triu_indices(60, 1)
    want = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)]
    assert jaccard_join.common_counts(sets, a, b).tolist() == want
    assert jaccard_join.common_counts(sets, a[:2], b[:2]).tolist() == want[:2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
