"""SuperMinHash near copies and lattice cells against all-pairs versions."""

import random

import numpy as np
import pytest

from batchkeeper.llm.graph import UnionFind, components
from batchkeeper.llm.lattice import cells, decode, near_vectors, roots
from batchkeeper.llm.superminhash import near_duplicates, signature
from tests_support import groups_of, near, shingles

def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        base = " ".join(rng.choice(words) for _ in range(rng.choice((5, 30, 120, 400))))
        texts += [base] + [near(base, rng, c) for c in (0, 1, 2, 4, 8)]
    # one group whose members resemble its origin more than each other, and a passage that many texts share
    origin = " ".join(rng.choice(words) for _ in range(150))
    texts += [near(origin, rng, 4) for _ in range(60)]
    texts += [origin[:500] + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    texts += ["", None, " \t\n", "one two", "ONE  two", "One two\n", "Éa b c d e", "éa b c d e"]
    rng.shuffle(texts)
    return texts


def test_groups_equal_all_pairs(spark):
    texts = corpus()
    rows = [(i, t, "x", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bands string, n_shingles double").repartition(5)
    sets = [shingles(t) for t in texts]
    want = groups_of(
        list(range(len(texts))),
        lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]),
    )
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want.root(i), want.root(i) == i)


def test_rows_without_id_repeated_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "only here"), (3, None)]
    got = sorted(near_duplicates(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert [tuple(r) for r in got if r.doc_id == 7] == [(7, 2, 7, True)] * 2
    assert [tuple(r) for r in got if r.doc_id == 9] == [(9, 2, 7, False)]
    assert sorted(tuple(r) for r in got if r.doc_id is None and r.component_id == 7) == [(None, 2, 7, False)]
    assert [tuple(r) for r in got if r.doc_id is None and r.component_id is None] == [(None, 1, None, True)]
    assert [tuple(r) for r in got if r.doc_id == 3] == [(3, 0, 3, True)]
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.concatenate((a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)))
        errors.append((signature(a) == signature(b)).mean() - 240 / 360)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.05
    # a set smaller than the signature fills every place
    assert np.isfinite(signature(a[:1])).all()
    assert (np.sort(np.floor(signature(a[:1]))) == np.arange(128)).all()


@pytest.mark.parametrize("shape", ["path", "star", "cycles"])
def test_components(spark, shape):
    links = {
        "path": [(i, i + 1) for i in range(40)] + [(100, 101)],
        "star": [(0, i) for i in range(1, 40)] + [(i, 500) for i in range(30, 40)],
        "cycles": [(i, (i + 1) % 9) for i in range(9)] + [(20, 21), (21, 22), (22, 20), (5, 5)],
    }[shape]
    want = UnionFind()
    for a, b in links:
        want.link(a, b)
    edges = spark.createDataFrame([*links, (None, 1), (3, None)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {x: want.root(x) for a, b in links for x in (a, b) if a != b}


def test_lattice_points():
    assert len({tuple(r) for r in roots()}) == 240
    assert set(np.round((roots() ** 2).sum(axis=1), 9)) == {2.0}
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)) * 2
    home = decode(x)
    gap = ((x - home) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all()  # the covering radius
    for r in roots():
        assert (gap <= ((x - home - r) ** 2).sum(axis=1) + 1e-9).all()


def test_pairs_at_the_limit_meet():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    a, b = cells(x), cells(0.98 * x + np.sqrt(1 - 0.98**2) * z)
    meet = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert meet.mean() > 0.999


def vectors():
    rng = np.random.default_rng(4)
    out = []
    for label in (0, 1, None):
        for _ in range(12):
            x = rng.normal(size=16)
            out += [(x, label)] + [(x + rng.normal(size=16) * s, label) for s in (0, 0.02, 0.05, 0.12)]
    big = rng.normal(size=16)
    out += [(big + rng.normal(size=16) * 0.05, 1) for _ in range(1500)]
    rows = [(i, [float(v) for v in x], label) for i, (x, label) in enumerate(out)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(len(rows) + i, v, 1) for i, v in enumerate(odd)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_equal_all_pairs(spark, kind):
    rows = vectors()
    table = spark.createDataFrame(
        [(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, cell string"
    ).repartition(6)
    stored = {r.vec_id: r.embedding for r in table.collect()}
    valid = [r for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    x = np.array([stored[r[0]] for r in valid])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    label = np.array([r[2] for r in valid])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    ids = np.array([r[0] for r in valid])
    want = UnionFind()
    for a, b in zip(*np.nonzero(hit), strict=True):
        want.link(int(ids[a]), int(ids[b]))
    links = dict(zip(ids.tolist(), hit.sum(axis=1).tolist(), strict=True))
    got = near_vectors(table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), want.root(r.vec_id), want.root(r.vec_id) == r.vec_id)


def test_vectors_without_id(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (8, [1.0, 0.0], 2)]
    got = sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 2, 4, False), (None, 2, 4, False), (4, 2, 4, True), (None, 0, None, True), (8, 0, 8, True)], key=str)
    assert near_vectors(spark.createDataFrame([], schema)).collect() == []
