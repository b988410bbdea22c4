"""op6 against a slow computation: transcripts with bare, shouted and quoting turns, counts and Viterbi line by line."""

import math
import random
import re
import zlib
from collections import defaultdict

from bytequarry.llm import transcripts
from bytequarry.llm.queries import queries

ROWS = "conv_id long, turn long, role string, text string, extra int"


def talk(conv, r):
    rows = [("system", "be kind")] if r.random() < 0.3 else []
    for _ in range(r.randint(1, 4)):
        rows += [("user", "what is " + "word " * r.randint(1, 5) + "?"), ("assistant", "\n".join("answer " * r.randint(5, 30) for _ in range(r.randint(1, 4))))]
    return [(conv, i, role, text, 1) for i, (role, text) in enumerate(rows)]


def raw(conv, turn, role, text):
    def mark(who):
        return transcripts.STYLES[conv % len(transcripts.STYLES)].replace("{Name}", who.capitalize()).replace("{name}", who)

    def luck(salt, one_in):
        return zlib.crc32(f"{salt}/{conv}/{turn}".encode()) % one_in == 0

    marker = "" if luck("bare", transcripts.BARE) else mark(role).upper() if luck("shouted", transcripts.SHOUTED) else mark(role)
    quote = "\n" + mark("assistant" if role == "user" else "user") + "as was said before" if luck("quoted", transcripts.QUOTED) else ""
    return marker + (text or "") + quote


def features(line):
    marker = next((i + 1 for i, names in enumerate(transcripts.SPEAKERS.values()) if re.search(transcripts._marker(names), line)), 0)
    kind = 0 if not line.strip(" ") else 1 if line.rstrip(" ").endswith("?") else 2 if re.match(r"\s*(?:[-*+•]|\d+[.)])\s", line) else 3 if re.match(r"```|    |\t", line) else 4
    return {"marker": marker, "length": min(15, int(math.log2(len(line) + 1))), "kind": kind}


def slow_model(convs):
    """Log chances by state (role, later line), counted one line after another."""
    roles = sorted({role for lines in convs.values() for role, _, _ in lines})
    states = [(role, later) for role in roles for later in (False, True)]
    moves = {a: dict.fromkeys(states, 0.5) for a in [None, *states]}
    emit = {k: {s: [0.5] * n for s in states} for k, n in transcripts.FEATURES.items()}
    for role, later in states:
        place = 0 if later else list(transcripts.SPEAKERS).index(role) + 1
        emit["marker"][role, later][place] += transcripts.MARKER_PRIOR
    for lines in convs.values():
        before = None
        for role, line, text in lines:
            state = (role, line > 0)
            moves[before][state] += 1
            before = state
            for k, v in features(text).items():
                emit[k][state][v] += 1

    def move(a, b):
        if b[1] and (a is None or a[0] != b[0]):
            return transcripts.NEVER
        return math.log(moves[a][b] / sum(moves[a].values()))

    return states, move, lambda s, text: sum(math.log(emit[k][s][v] / sum(emit[k][s])) for k, v in features(text).items())


def test_the_query_against_a_slow_viterbi(spark, tmp_path):
    r = random.Random(3)
    rows = [x for c in range(90) for x in talk(c, r)] + [(90, 0, "user", None, 1), (90, 1, "assistant", "", 1)]
    spark.createDataFrame(rows, ROWS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = defaultdict(dict)
    for x in queries()["op6_transcripts"](spark, str(tmp_path)).collect():
        got[x.conv_id][x.turn, x.line] = x
    convs = defaultdict(list)
    keys = defaultdict(list)
    for c, turn, role, text, _ in rows:
        for line, said in enumerate(raw(c, turn, role, text).split("\n")):
            convs[c].append((role, line, said))
            keys[c].append((turn, line))
    assert {c: sorted(v) for c, v in got.items()} == keys
    states, move, seen = slow_model(convs)
    right, lines_seen, not_marked = 0, 0, 0
    for c, lines in convs.items():
        best = {None: 0.0}
        for _, _, said in lines:
            best = {s: max(v + move(a, s) for a, v in best.items()) + seen(s, said) for s in states}
        before, total, number = None, 0.0, -1
        for (declared, line, said), key in zip(lines, keys[c], strict=True):
            x = got[c][key]
            state = (x.role, not x.begins)
            total += move(before, state) + seen(state, said)
            before = state
            number += x.begins
            found = re.match(transcripts._marker(transcripts.SPEAKERS[x.role]), said) if x.begins else None
            marker = found.group() if found else ""
            rest = said[len(marker) :]
            assert (x.declared, x.number, x.marker) == (declared, number, marker)
            assert x.rendered == ((f"<|{x.role}|>\n{rest}" if rest else f"<|{x.role}|>") if x.begins else said)
            right += (x.role, x.begins) == (declared, line == 0)
            not_marked += x.begins != (features(said)["marker"] > 0)
            lines_seen += 1
        assert abs(total - max(best.values())) < 1e-6
    assert not_marked > 20  # what marks alone would say is not what is found
    assert right / lines_seen > 0.9
