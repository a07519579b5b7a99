"""Ranked search, spelling variants and personal data against plain versions."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from batchkeeper.llm import ball_tree, pii, variants
from batchkeeper.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
EXTRA = ("line", "n", "places", "counts", "score", "rank", "word", "form", "root", "turned", "half", "spans", "finds", "kind", "uses", "pattern", "name", "part")


def with_extra(df):
    return df.select("*", *[F.lit(7).alias(c) for c in EXTRA if c not in df.columns])


# ---- ranked search -------------------------------------------------------------------------------------------


def plain_ranking(docs, items, top=50):
    held = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = 0
            for t in set(TERM.findall((text or "").translate(FOLD))) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, (i is None, i or 0), i))
        for rank, (s, _, i) in enumerate(sorted(found, key=lambda f: f[:2])[:top]):
            out[(item, rank + 1, i, -s)] += 1
    return out


def corpus(rng, n, size=400):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(size)]
    return [(i, " ".join(rng.choice(words[: rng.choice((20, size))]) for _ in range(rng.randrange(1, 60)))) for i in range(n)]


def search(spark, docs, items, parts=3, **kind):
    d = with_extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts))
    q = with_extra(spark.createDataFrame(items, "item_id long, text string"))
    return Counter(map(tuple, ball_tree.ranked_search(d, q, **kind).collect()))


def test_ranked_search_equals_the_plain_version(spark):
    rng = random.Random(1)
    docs = corpus(rng, 300)
    docs += [docs[5], docs[5], (5, "other words abc"), (None, docs[7][1]), (900, None), (901, ""), (902, " .,- "), (903, "É é İ ABC abc Abc 12")]
    docs += [(1000 + k, docs[3][1]) for k in range(90)]  # more equal scores than there are ranks
    items = corpus(rng, 12) + [(3, docs[3][1]), (None, "abc"), (50, None), (51, "..."), (52, "unknownterm"), (53, "ABC é")]
    assert search(spark, docs, items) == plain_ranking(docs, items)


def test_ranked_search_in_several_blocks_of_items_and_documents(spark, monkeypatch):
    rng = random.Random(2)
    docs, items = corpus(rng, 200), corpus(rng, 9)
    want = plain_ranking(docs, items, 5)
    monkeypatch.setattr(ball_tree, "ITEMS", 4)
    assert search(spark, docs, items, top=5) == want
    found = ball_tree.Items.of(list(range(9)), [i for i, _ in items], [t for _, t in items])
    assert [len(found.terms_of(i)) for i in range(9)] == [len(set(t.split())) for _, t in items]


def test_ranked_search_of_empty_tables_and_long_texts(spark):
    rng = random.Random(3)
    docs, items = corpus(rng, 20), corpus(rng, 3)
    assert not search(spark, [], items) and not search(spark, docs, [])
    long_ones = [(100, " ".join(t for _, t in corpus(rng, 20000))), (101, "a" * 300000 + " abc")]
    assert search(spark, docs + long_ones, items) == plain_ranking(docs + long_ones, items)


def test_bounds_hold_and_prune():
    rng = random.Random(4)
    docs = [(i, " ".join(f"{k}w{rng.randrange(30)}" for _ in range(20))) for k in range(8) for i in range(k * 64, k * 64 + 64)]
    items = ball_tree.Items.of([0, 1], [0, 1], ["0w1 0w2 0w3", "5w7 5w8"])
    places, values, first = [], [], [0]
    for _, t in docs:
        for w, n in Counter(t.split()).items():
            hit = [k for k, q in enumerate(["0w1", "0w2", "0w3", "5w7", "5w8"]) if q == w]
            places += hit
            values += [n * 1000 + k for k in hit]
        first.append(len(places))
    block = ball_tree.Block([i for i, _ in docs], np.array(first), np.array(places), np.array(values, dtype=np.int64))
    root = ball_tree.grow(block, 0, len(docs), items, 5)

    def scores(node, i):
        own = set(items.terms_of(i).tolist())
        return [
            sum(int(v) for p, v in zip(block.places[block.entries(d, d + 1)], block.values[block.entries(d, d + 1)], strict=True) if int(p) in own)
            for d in range(node.lo, node.hi)
        ]

    def walk(node):
        assert all(max(scores(node, i)) <= node.bounds[i] for i in (0, 1))
        return 1 + sum(walk(c) for c in node.children)

    assert walk(root) == 2 * len(docs) // ball_tree.LEAF - 1
    best = [ball_tree.Best(5), ball_tree.Best(5)]
    assert ball_tree.search(block, items, best, 5) < 2 * len(docs) // ball_tree.LEAF  # some leaves are never scored


# ---- spelling variants ---------------------------------------------------------------------------------------


def plain_words(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs):
    words = plain_words(docs)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, peers in near.items():
        best = min(peers, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def misspelt(rng, word):
    k = rng.randrange(len(word) + 1)
    return rng.choice((word[:k] + rng.choice("abñ") + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice("xyé") + word[k + 1 :]))


def spellings(rng, n=60):
    base = ["".join(rng.choice("abcñ") for _ in range(rng.randrange(7, 14))) for _ in range(25)] + ["a" * 7, "a" * 8, "a" * 9, "Ü" * 7]
    text = []
    for w in base:
        text += [w] * rng.choice((2, 30, 400))
        for _ in range(6):
            v = misspelt(rng, w)
            text += [v] * rng.choice((2, 3, 20)) + [misspelt(rng, v)] * 2
    rng.shuffle(text)
    size = len(text) // n + 1
    return [(i, rng.choice((" ", ", ", "9")).join(text[i * size : i * size + size])) for i in range(n)]


def found_variants(spark, docs):
    table = with_extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    rows = variants.spelling_variants(table).collect()
    assert len(rows) == len({r.word for r in rows})
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("crowd", [None, 4])
def test_variants_equal_the_plain_version(spark, monkeypatch, crowd):
    if crowd:
        monkeypatch.setattr(variants, "CROWD", crowd)  # ranges in blocks
    docs = spellings(random.Random(5))
    docs += [docs[0], docs[0], (None, docs[1][1]), (0, "again again"), (70, None), (71, ""), (72, "123 ... "), (73, "MIXED Mixed mixedCASE ÀÉÞ × ÷")]
    want = plain_variants(docs)
    assert found_variants(spark, docs) == want
    assert any(f and f != r for _, f, r, *_ in want) and any(k > 3 for *_, k, _ in want)


def test_variants_of_long_words_and_an_empty_table(spark):
    rng = random.Random(6)
    long_word = "".join(rng.choice("abcdefgh") for _ in range(3000))
    near = long_word[:1700] + "z" + long_word[1701:]
    docs = [(k, " ".join([long_word, near, long_word[:-1], "x" + long_word, near[1:]])) for k in range(3)]
    assert found_variants(spark, docs) == plain_variants(docs)
    assert found_variants(spark, []) == set()


def test_roots_of_a_long_chain(spark):
    n = 40
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(n)], "word string, form string")
    assert {tuple(r) for r in variants.roots(forms).collect()} == {(f"w{k}", f"w{n}") for k in range(n)}


def test_near_pairs_along_the_list():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(150)})
    listed = variants.Sorted(words, np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64))
    pairs = [(int(q), int(w)) for a, b in variants.near(np.arange(len(words)), np.ones(len(words), dtype=bool), listed) for q, w in zip(a, b, strict=True)]
    assert sorted(pairs) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)]


# ---- personal data -------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    def digits(m):
        return [int(c) for c in m[0] if c.isdigit()]

    def good_card(d):
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if good_card(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    parts = ["@", ".", "a", "b-", "1", "23", "255", "256", " ", "+", "-", "(", ")", "@a.b", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "é", "%", "1.2.3.4", "\n", "0001"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_base_spans_take_time_in_proportion():
    n = 300_000
    texts = ["a" * n, "a@" * n, "a@b" * n, "1" * n, "1." * n, "1 " * n, "+1" + " " * n, "+1 " * n, "1.1.1.1." * n, "a." * n, "(at)" * n, "12:" * n, "1-" * n + "x", "@" * n]
    begin = time.time()
    for text in texts:
        known = pii.base_spans(text)
        starts = [a for a, _, _ in pii.candidates(text, known)]
        pii.contexts(text, starts)
    assert time.time() - begin < 60


def people(spark, rows, parts=3):
    table = with_extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    found = pii.find_personal(table).collect()
    assert len(found) == len(rows)
    return {r.doc_id: [tuple(s) for s in r.spans] for r in found}


def test_contexts_discover_identifiers(spark):
    rng = random.Random(9)
    filler = ["red", "green", "blue", "tall", "short"]

    def said(*words):
        return " ".join([*(rng.choice(filler) for _ in range(5)), *words, rng.choice(filler)])

    docs = [(k, said("hotline:", f"+1 555 010 {1000 + k}")) for k in range(20)]
    docs += [(100, said("hotline:", "(555) 010-7777")), (101, said("hotline:", "020 7946 0000"))]  # without a country
    # a second pattern that no seed has: what the first one found teaches it
    docs += [(200 + k, said("hotline:", f"555 020 {2000 + k}")) for k in range(4)]
    docs += [(300 + k, said("reachable under", f"555 020 {2000 + k}")) for k in range(4)]
    docs += [(400, said("reachable under", "555 030 9999"))]
    # a context that is mostly followed by something else, and one that only stands before numbers that are no seeds
    docs += [(500 + k, said("count", f"+1 555 040 {1000 + k}")) for k in range(4)] + [(520 + k, said("count", "nothing")) for k in range(9)]
    docs += [(540, said("count", "555 040 1234")), (541, said("serial", "555 050 1234")), (542, said("serial", "555 050 1235"))]
    docs += [(None, said("hotline:", "555 060 1111")), (600, None), (601, ""), (602, "no one here")]
    got = people(spark, docs)
    text = dict(docs)

    def taken(i):
        return [(k, text[i][a:b]) for k, a, b in got[i]]

    assert taken(3) == [("phone", "+1 555 010 1003")]
    assert taken(100) == [("context", "(555) 010-7777")] and taken(101) == [("context", "020 7946 0000")]
    assert taken(302) == [("context", "555 020 2002")] and taken(400) == [("context", "555 030 9999")]
    assert got[540] == got[541] == got[542] == got[525] == got[600] == got[601] == got[602] == []
    assert taken(None) == [("context", "555 060 1111")]


def plain_scores(edges, rounds):
    """Confidences by plain loops over the graph."""
    seeds = {(n, k) for _, n, k, *_ in edges if k >= 0}
    sure = {key: 1.0 for key in seeds}
    uses = {p: u for p, _, _, _, _, u in edges}
    for _ in range(rounds):
        weight, support = defaultdict(float), defaultdict(int)
        count = Counter()
        for p, name, _, _, n, _ in edges:
            count[(p, name)] += n
        for (p, name), n in count.items():
            for k in range(4):
                if (name, k) in sure:
                    weight[(p, k)] += n * sure[(name, k)]
                    support[(p, k)] += sure[(name, k)] >= pii.TRUSTED
        patterns = {key: min(w / uses[key[0]], pii.SUREST) for key, w in weight.items()}
        patterns = {key: c for key, c in patterns.items() if c >= pii.TRUSTED and support[key] >= pii.SUPPORT}
        doubt = defaultdict(dict)
        for p, name, kind, fits, _, _ in edges:
            for k in fits if kind < 0 else []:
                if (name, k) not in seeds and (p, k) in patterns:
                    doubt[(name, k)][p] = 1 - patterns[(p, k)]
        found = {key: 1 - math.prod(d.values()) for key, d in doubt.items()}
        sure = {key: 1.0 for key in seeds} | found
    return patterns, found


def test_scores_equal_plain_loops(spark):
    rng = random.Random(10)
    edges = {}
    for _ in range(400):
        seed = rng.random() < 0.7
        name = f"s{rng.randrange(60)}" if seed else f"c{rng.randrange(30)}"
        kind = len(name) % 2 + 2 if seed else -1
        fits = [kind] if seed else [2, 3]
        p = rng.randrange(25)
        edges[(p, name, kind)] = (fits, rng.randrange(1, 4))
    total = Counter()
    for (p, _, _), (_, n) in edges.items():
        total[p] += n
    rows = [(p, name, kind, fits, n, total[p] + p % 3) for (p, name, kind), (fits, n) in edges.items()]
    table = spark.createDataFrame(rows, "pattern long, name string, kind int, fits array<int>, n long, uses long")
    patterns, found = pii.scored(table)
    want = plain_scores(rows, pii.ROUNDS)
    for got, key, expected in ((patterns, "pattern", want[0]), (found, "name", want[1])):
        have = {(r[key], r.kind): r.confidence for r in got.collect()}
        assert have.keys() == expected.keys() and len(have) > 0
        assert all(abs(have[k] - v) < 1e-9 for k, v in expected.items())


def test_personal_data_of_repeats_long_texts_and_an_empty_table(spark):
    text = "mail a.b@c.org or 10.0.0.1, " * 20000
    docs = [(1, text), (2, "x " + text[:28]), (2, "x " + text[:28]), (3, "ü a@b.c")]
    got = people(spark, docs)
    assert [s for s in got[1] if s[0] != "context"] == [(pii.KINDS[k], a, b) for a, k, b in plain_base(text)]
    assert got[2] == [("email", 7, 16), ("ip", 20, 28)] and got[3] == [("email", 2, 7)]
    assert people(spark, []) == {}


def test_uses_of_patterns(spark):
    rows = [(1, "call me: call me call us"), (2, "ME call"), (3, None), (4, "me")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    import pyarrow as pa

    found = pii.words(pa.array(["call me", "us"]))
    one, two = (x.view(np.int64) for x in pii.pattern_keys(found))
    keys = {"me": int(one[1]), "call me": int(two[1]), "us": int(one[2])}
    table = spark.createDataFrame([(k,) for k in keys.values()], "pattern long")
    got = {r.pattern: r.uses for r in pii.uses(texts, table).collect()}
    assert got == {keys["me"]: 4, keys["call me"]: 2, keys["us"]: 1}


def test_queries_of_this_round(spark):
    assert {"op11_bootstrap", "op12_variants", "op13_ball_tree"} <= set(QUERIES)
