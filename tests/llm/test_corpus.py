import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytequarry.llm import decontaminate, language_id, packing, sharding


# --- packing -------------------------------------------------------------------


def test_tokenizer_equals_the_library(tokens_path, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens_path)
    t.encode_special_tokens = True
    own = packing.ChunkTokenizer(tokens_path)
    r = random.Random(1)
    odd = ["".join(r.choice([" ", "\n", "a", "'s", "é", "1", "²", "!", "\t", "word", " ", "日", "  "]) for _ in range(40)) for _ in range(300)]
    for text in [*(x[1] for x in corpus if x[1]), *odd]:
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


def pieces_hold(rows, docs, path, length, added=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not added
    want = Counter()
    for d, text, *_ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    for s, spans in at.items():
        place = 0
        for o, n in sorted(spans):
            assert o == place
            place += n
        assert place == length or s == max(at)
    assert sorted(at) == list(range(len(at)))
    assert sum(r.length for r in rows) == sum(k[1] * n for k, n in want.items())
    for d, text, *_ in docs:
        if sum(x[0] == d for x in docs) == 1:
            ids, place = [*t.encode(text or "", add_special_tokens=False).ids, 0], 0
            for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (place, len(ids))
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
                place += r.length
            assert place == len(ids)


@pytest.mark.parametrize(("length", "targets"), [(64, None), (100, {"s0": 0.8})])
def test_packing(docs, corpus, nothing, tokens_path, length, targets):
    rows = packing.pack(docs, tokens_path, length, targets).collect()
    pieces_hold(rows, corpus, tokens_path, length)
    share = Counter()
    whole = Counter()
    for r in rows:
        whole[r.source] += r.length
        if r.sequence_id < 10:
            share[r.source] += r.length
    want = 0.8 if targets else whole["s0"] / sum(whole.values())
    assert abs(share["s0"] / (10 * length) - want) < 0.05
    if length == 64:
        assert packing.pack(nothing, tokens_path).count() == 0


def test_schedule_is_the_round_robin():
    totals, length = [1000, 37, 260], 50
    plan = packing.Schedule(totals, [0.5, 0.2, 0.3], length)
    stream, served, credit = [], [0, 0, 0], [0, 0, 0]
    while sum(served) < sum(totals):
        for q in range(3):
            credit[q] += plan.quanta[q]
            n = min(credit[q] >> packing.UNIT, totals[q] - served[q])
            credit[q] -= n << packing.UNIT
            stream += [(q, served[q] + i) for i in range(n)]
            served[q] += n
    queue = np.array([0, 0, 1, 2, 2])
    start, n = np.array([0, 990, 0, 0, 100]), np.array([990, 10, 37, 100, 160])
    doc, at, size, place = plan.pieces(queue, start, n, length)
    got = [None] * len(stream)
    for d, a, k, p in zip(doc, at, size, place, strict=True):
        for i in range(k):
            got[p + i] = (queue[d], start[d] + a + i)
    assert got == stream
    assert all(p // length == (p + k - 1) // length for p, k in zip(place, size, strict=True))


def test_sequences(spark, tokens_path):
    df = spark.createDataFrame([(i, f"text number {i} " * (i + 1), f"s{i % 2}") for i in range(8)], "doc_id long, text string, source string")
    pieces = packing.pack(df, tokens_path, 32)
    got = {r.sequence_id: r.ids for r in packing.sequences(df, pieces, tokens_path, 32).collect()}
    assert all(len(v) == 32 for k, v in got.items() if k < max(got))
    assert sum(map(len, got.values())) == pieces.agg(F.sum("length")).first()[0]


# --- sharding -------------------------------------------------------------------


def test_sharding(docs, corpus, nothing):
    tree = sharding.uniform_tree(16)
    grown = sharding.grown(tree)
    rows = sharding.assign_shards(docs, tree, grown).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus)
    text = {r[0]: r[1] for r in corpus}
    for r in rows:
        if r.doc_id is not None:
            b = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    for s in {r.shard for r in rows}:
        own = sorted((r.slot, -1 if r.doc_id is None else r.doc_id) for r in rows if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    assert sharding.assign_shards(nothing, tree, grown).count() == 0


def descended(key, tree):
    """The descent, one key at a time."""
    inside, place = [x for x in tree if x.weight > 0], ()
    for level in ("region", "rack", "shard"):
        best = None
        for name in {getattr(x, level) for x in inside}:
            at = ".".join(map(str, (*place, name)))
            u = (int(hashlib.md5(f"{key}/{at}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            draw = -math.log(u) / sum(x.weight for x in inside if getattr(x, level) == name)
            best = min(best, (draw, name)) if best else (draw, name)
        inside, place = [x for x in inside if getattr(x, level) == best[1]], (*place, best[1])
    return inside[0].shard


def test_weights_and_movement(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    tree = [sharding.Leaf(i, i // 4, i // 2 % 2, 1.0 + i % 3) for i in range(8)]
    heavier = [sharding.Leaf(x.shard, x.region, x.rack, x.weight * (3 if x.shard == 5 else 1)) for x in tree]
    gone = [sharding.Leaf(x.shard, x.region, x.rack, 0 if x.shard == 2 else x.weight) for x in tree]
    larger = sharding.grown(sharding.uniform_tree(17))
    rows = keys.select("k", *[sharding.shard_of(F.col("k"), t).alias(n) for n, t in (("a", tree), ("b", heavier), ("c", gone), ("d", sharding.uniform_tree(17)), ("e", larger))]).collect()
    n = Counter(r.a for r in rows)
    whole = sum(x.weight for x in tree)
    assert all(abs(n[x.shard] / 20_000 - x.weight / whole) < 0.015 for x in tree)
    at = {x.shard: (x.region, x.rack, x.shard) for x in tree}

    def parted(x, y):
        """(what was left, what was entered) at the level where two places part."""
        k = next(i for i in range(3) if at[x][i] != at[y][i]) + 1
        return at[x][:k], at[y][:k]

    # keys enter only subtrees that gained, and leave only such as lost
    assert any(r.a != r.b for r in rows) and all(r.a == r.b or parted(r.a, r.b)[1] == at[5][: len(parted(r.a, r.b)[1])] for r in rows)
    assert all(r.a == r.c or parted(r.a, r.c)[0] == at[2][: len(parted(r.a, r.c)[0])] for r in rows) and all(r.c != 2 for r in rows)
    assert all(r.e in (r.d, 17) for r in rows) and abs(sum(r.e == 17 for r in rows) / 20_000 - 1 / 18) < 0.01
    for name, t in (("a", tree), ("b", heavier), ("c", gone), ("e", larger)):
        assert all(r[name] == descended(r.k, t) for r in rows[:2000])


# --- decontamination ----------------------------------------------------------------


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, c in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (p != c)))
        row = now
    return min(row)


def plain(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()).strip()


def test_matcher_against_brute_force():
    r = random.Random(2)
    words = ["".join(r.choices("abcde", k=r.randint(1, 6))) for _ in range(40)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 14)))) for i in range(12)]
    m = decontaminate.Matcher(items, 0.15)
    for _ in range(150):
        q = list(r.choice(items)[1])
        for _ in range(r.randint(0, 8)):
            x = r.randrange(len(q)) if q else 0
            q[x : x + r.randint(0, 1)] = r.choice(["", "a", "zz", " "])
        text = " ".join(r.choices(words, k=5)) + " " + "".join(q) + " " + " ".join(r.choices(words, k=5))
        want = [(i, d) for i, p in items if (d := edit_distance(p, text)) <= int(len(p) * 0.15)]
        assert [(i, d) for i, d, _ in m.find(text)] == want


def test_leaks(spark, docs, corpus, nothing):
    item = " ".join(corpus[3][1].split()[10:40])
    bench = spark.createDataFrame([(1, item.upper().replace(" ", " !! ")), (2, item.replace("e", "x", 3)), (3, None), (4, "..."), (5, "nowhere to be found in here at all")], "item_id long, text string")
    want = sorted((d, i) for d, t, *_ in corpus for i, b in ((1, plain(item)), (2, plain(item.replace("e", "x", 3)))) if len(t or "") < 5000 and edit_distance(b, plain(t)) <= int(len(b) * decontaminate.RATE))
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == want and want
    clean = decontaminate.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(corpus) - len({d for d, _ in want})
    assert decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(docs, bench.limit(0)).count() == len(corpus)


# --- language ID ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(3)
    sounds = {"aa": ["the", "of", "ing", "wh"], "bb": ["que", "la", "ño", "ci"], "cc": ["sch", "ei", "ung", "ö"]}
    word = lambda l: "".join(r.choices(sounds[l], k=r.randint(1, 3)))
    rows = [(i, " ".join(word(l) for _ in range(r.choice([4, 30, 300]))), l, f"h{i % 4}.{l}") for i in range(600) for l in [r.choice("abc") * 2]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language_accuracy_on_held_out_rows(languages):
    model = language_id.fit(languages.filter("doc_id % 2 = 0"))
    rows = language_id.identify(languages.filter("doc_id % 2 = 1").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string")), model)
    got = rows.join(languages.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) / len(got) > 0.98 and all(r.kept for r in got)
    # a short text goes with its host and declaration, a long one with what it says
    odd = languages.sparkSession.createDataFrame([(1, "x", "bb", "h0.bb"), (2, "the of whing " * 30, "bb", "h0.bb"), (3, "zqjxkv wvzkq jjxq " * 20, "aa", "h0.aa")], "doc_id long, text string, lang string, source string")
    by = {r.doc_id: r for r in language_id.identify(odd.unionByName(languages.filter("doc_id >= 300 AND lang = 'bb'")), model).collect()}
    assert by[1].language == "bb" and by[2].language == "aa" and not by[3].kept


def test_language_edges(docs, corpus, nothing, languages):
    model = language_id.fit(languages)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(corpus)
    assert all(r.language == "und" and not r.kept for r in rows if r.doc_id in (70, 71, 72))
    left = language_id.drop_unknown(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in rows)
    assert language_id.identify(nothing, model).count() == 0
    assert language_id.fit(nothing)[0] == [] and language_id.identify(docs, language_id.fit(nothing)).filter("kept").count() == 0
