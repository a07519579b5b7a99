"""Plain versions that several tests compare with."""

import re

from batchkeeper.llm.graph import UnionFind

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingles(text):
    found = WORDS.findall((text or "").translate(FOLD))
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def groups_of(ids, linked):
    found = UnionFind()
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                found.link(a, b)
    return found


def near(text, rng, changes):
    found = text.split(" ")
    for _ in range(changes):
        found[rng.randrange(len(found))] = f"new{rng.randrange(10**6)}"
    return " ".join(found)
