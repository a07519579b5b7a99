"""Substring removal against a version that looks every window up."""

import random

import numpy as np

from batchkeeper.llm.substring import WINDOW, pieces, remove_repeats


def brute(rows):
    """Per row: words, removed words, kept text."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - WINDOW + 1):
            if i is not None:
                key = tuple(w[j : j + WINDOW])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - WINDOW + 1):
            if i is not None and first[tuple(w[j : j + WINDOW])] < i:
                gone[j : j + WINDOW] = [True] * WINDOW
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def test_equals_looking_up_every_window(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    passages = [some(n) for n in (49, 50, 51, 60, 90, 300)]
    rows = []
    for i in range(160):
        text = some(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edited"
            if rng.random() < 0.3:
                p = p[rng.randrange(10) :]
            text += p + some(rng.randrange(30))
        rows.append((i, rng.choice((" ", "\n", "  \t")).join(text)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 160, 7)]  # whole copies
    rows += [(300, "same " * 130), (301, "same " * 60), (302, "a b " * 80), (303, "b a " * 80)]  # periodic
    rows += [(400, None), (401, ""), (402, " \n"), (403, "few words"), (10, rows[20][1]), (None, rows[5][1])]
    table = [(t, i, "x") for i, t in rows]
    rng.shuffle(table)
    docs = spark.createDataFrame(table, "text string, doc_id long, words string").repartition(6)
    got = sorted((tuple(r) for r in remove_repeats(docs).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_tile_the_windows():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
    start, n, *_ = pieces(hashes)
    assert start[0] == 0
    assert (start[1:] == start[:-1] + n[:-1]).all()
    assert n.sum() == 500 - WINDOW + 1


def test_equal_words_make_equal_pieces_wherever_they_stand():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 2**63, 300).astype(np.uint64)
    found = []
    for lead in (0, 7, 400):
        text = np.concatenate((rng.integers(0, 2**63, lead).astype(np.uint64), passage, rng.integers(0, 2**63, 90).astype(np.uint64)))
        _, n, anchor, own, sides = pieces(text)
        found.append(set(zip(n.tolist(), anchor.tolist(), own.tolist(), sides.tolist(), strict=True)))
    assert len(found[0] & found[1] & found[2]) > 8
