"""Decontamination where many items share a stem: equal to brute force, and its time."""

import random
import time

import numpy as np
import pytest
from bytequarry.llm import decontaminate

from test_corpus import edit_distance


def words(r, n, letters="abcdefghij"):
    return " ".join("".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("many", [1, 3])
def test_shared_pieces_against_brute_force(many, monkeypatch):
    monkeypatch.setattr(decontaminate, "MANY", many)
    r = random.Random(many)
    hits = 0
    for _ in range(12):
        stem = words(r, 6)
        items = [(i, r.choice([f"{stem} {words(r, r.randint(1, 9))}", f"{words(r, 4)} {stem}", f"{words(r, 2)} {stem} {words(r, 12)}", words(r, 5), "é 世", ""])) for i in range(25)]
        m = decontaminate.Matcher(items, 0.12)
        for _ in range(6):
            q = list(r.choice(items)[1] or stem)
            for _ in range(r.randint(0, 7)):
                x = r.randrange(len(q)) if q else 0
                q[x : x + r.randint(0, 1)] = r.choice(["", "a", "世", " "])
            text = " ".join([words(r, 3), stem, words(r, 2), "".join(q), "ß", stem, words(r, 3)])
            want = [(i, d) for i, p in items if p and (d := edit_distance(p, text)) <= int(len(p) * 0.12)]
            assert [(i, d) for i, d, _ in m.find(text)] == want
            assert m.holds(text) == bool(want)
            hits += len(want)
    assert hits


def test_least_distances_against_a_table():
    r = random.Random(4)
    sizes = np.array([r.randint(0, decontaminate.SEGMENT) for _ in range(60)])
    rows = np.zeros((60, decontaminate.SEGMENT), np.uint8)
    for row, n in zip(rows, sizes, strict=True):
        row[decontaminate.SEGMENT - n :] = r.choices(range(1, 5), k=n)
    windows = np.array([r.choices(range(5), k=90) for _ in range(7)], np.uint8)
    for which in (np.zeros(60, np.int64), np.arange(60) % 7):
        got = decontaminate.least_distances(rows, sizes, windows, which)
        assert got.tolist() == [edit_distance(row[decontaminate.SEGMENT - n :].tolist(), windows[w].tolist()) for row, n, w in zip(rows, sizes, which, strict=True)]


def test_a_stem_of_twenty_thousand_items_takes_seconds():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stem = words(r, 14, letters)
    m = decontaminate.Matcher([(i, f"{stem} {words(r, 10, letters)}") for i in range(20_000)])
    text = " ".join(f"{words(r, 6, letters)} {stem} {words(r, 8, letters)}" for _ in range(10)) + " " + m.items[77][1]
    begin = time.perf_counter()
    assert [i for i, d, _ in m.find(text) if d == 0] == [77]
    assert time.perf_counter() - begin < 8  # one to two seconds on an idle machine; item by item it takes minutes
