import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from bytequarry.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, place long, ends string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes as tuples of all first turns, each sum by a look at every node."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            mark = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, mark, said))
    convs = {c: [x[3] for x in sorted(t)] for c, t in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        t = convs.get(base, [])[:h] + convs[c][h:]
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []
    for node, m in members.items():
        sub = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in sub if x)
        joined = ",".join(map(str, ends.get(node, [])))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), sum(not kids[x] for x in sub), saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=3, n=60):
    r = random.Random(seed)
    said = [("user", "hello"), ("user", "héllo 😀"), ("assistant", "yes"), ("assistant", ""), (None, None), ("", "x"), ("system", "be brief " * 40)]
    rows, common = [], [r.choice(said) for _ in range(12)]
    for c in [*range(n), 1002, 1003, 1006, -7, -3, 5_000_000_000]:
        if c % 11 == 4 and c < n:
            continue  # bases or members that are absent
        t = common[: r.randint(0, 12)] if r.random() < 0.5 else []
        t = t + [r.choice(said) for _ in range(r.randint(0 if t else 1, 9))]
        rows += [(c, None if i == 0 and r.random() < 0.2 else i, *x) for i, x in enumerate(t)]
    rows += [(12, 3, "user", "a tie"), (12, 3, "user", "b tie"), (12, 3, "user", "a tie"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    for c in (70, 71, 72, 200, 205, 210, 215):  # copies of one conversation over families
        rows += [(c, i, *said[i % 5]) for i in range(40)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "k", 1, 2, "z") for x in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("long", [20_000, 20, 3])
def test_nodes_equal_brute_force_with_families_in_one_task_or_in_segments(spark, long):
    rows = conversations()
    df = prefix_trie(frame(spark, rows), long=long, segment=4)
    assert df.columns == COLUMNS
    assert found(df) == brute(rows)


def test_long_chains_shared_by_families(spark):
    rows = [(c, i, "user", str(i)) for c in (5, 10, 15, 21) for i in range(300)] + [(c, i, "user", str(i)) for c in (30, 31) for i in range(170)]
    assert found(prefix_trie(frame(spark, rows))) == brute(rows)


def test_small_tables(spark):
    assert prefix_trie(frame(spark, [])).collect() == []
    for rows in ([(7, 0, "user", "x")], [(5, 0, None, None)], [(4, None, "a", "b"), (4, None, "a", "b")], [(c, 0, "u", "t") for c in range(40)]):
        assert found(prefix_trie(frame(spark, rows))) == brute(rows)


def test_a_long_text_and_a_node_with_many_ends(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 140_000, 7)] + [(3, 0, "user", "é" * 300_000)]
    got = {tuple(r[c] for c in COLUMNS) for r in prefix_trie(frame(spark, rows)).collect()}
    ends = defaultdict(list)
    for c in sorted({x[0] for x in rows}):
        h, base = zlib.crc32(str(c).encode()) % 9, c - c % 5
        own = c == base or h == 0
        there = own or base % 7 == 0
        ends[(None if not there else "long" if (c == 3 and own) else "same")].append(c)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {g[7] for g in got} == {sha(v) for v in ends.values()}
