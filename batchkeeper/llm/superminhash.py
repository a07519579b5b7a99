"""Near copies among texts: SuperMinHash signatures, banding, exact verification and union-find groups.

A text's set is its distinct shingles of five words, lower-cased in A to Z; a shorter text has one shingle,
its whole word sequence. Two texts are linked if their Jaccard similarity is 0.75 or more.

1. One pass makes each text's signature. SuperMinHash gives every shingle a pseudo-random permutation of the
   signature's places; the place drawn in round j is offered ``j`` plus a fraction. No place is left for
   rounds past the largest value in the signature, so a text of some hundred shingles takes one or two.
2. Texts with equal sets (equal 128-bit fingerprints) become one class, so exact copies cost nothing further.
3. Classes that share a band (4 of 128 values) meet. A pair at 0.75 misses all 32 bands with a probability of 5e-6.
4. In each bucket every class is verified against the bucket's smallest id, on full sets. Classes not yet in
   one component are then compared block against block inside tasks: by signature, and what could still reach the
   threshold on full sets. Only links that join components leave a task. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.graph import UnionFind, components
from batchkeeper.llm.text import BYTE_STEP, by_batch, column, mix, prepare, windows, words
from batchkeeper.session import materialize

SHINGLE = 5
PERCENT = 75
VALUES = 128
ROWS = 4
BANDS = VALUES // ROWS
BLOCK = 256
# a signature of 128 values that agrees in under 74 (0.58) is that of a pair at 0.75 once in 100,000 times
AGREE = 74

PAIR = "a long, b long"


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; empty without words."""
    found = words(texts, lower=True)
    hashes = found.hashes()
    out = []
    for i in range(len(texts)):
        own = hashes[found.first[i] : found.first[i + 1]]
        out.append(np.unique(windows(own, min(SHINGLE, len(own)))) if len(own) else own)
    return out


def signature(shingles: np.ndarray, values: int = VALUES) -> np.ndarray:
    """SuperMinHash of a non-empty set; every place holds the smallest ``round + fraction`` it was offered."""
    best = np.full(values, np.inf)
    state = shingles
    places = None
    swaps = np.zeros(0, dtype=np.int64)
    every = np.arange(len(shingles))
    for j in range(values):
        if best.max() < j:
            break
        state = mix(state + np.uint64(BYTE_STEP))
        offer = j + (state >> np.uint64(40)) * 2.0**-24
        drawn = j + ((state & np.uint64(0xFFFFFFFF)) * np.uint64(values - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place, swaps = drawn, drawn
        else:
            if places is None:  # the permutations after the first swap
                places = np.tile(np.arange(values, dtype=np.int16), (len(shingles), 1))
                places[every, swaps] = 0
                places[:, 0] = swaps
            place = places[every, drawn]
            places[every, drawn] = places[:, j]
            places[:, j] = place
        np.minimum.at(best, place, offer)
    return best


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _describe(batch: pa.RecordBatch) -> dict:
    sets = shingle_sets(column(batch, "text"))
    bands = []
    for own in sets:
        if len(own):
            # 16 bits of each value, four of them to a band: the band's key and the values are one array
            short = (mix(signature(own).view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
            bands.append(_signed(short.view(np.uint64)))
        else:
            bands.append(None)
    return {
        "doc_id": column(batch, "doc_id"),
        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
        "k1": _signed(np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)),
        "k2": _signed(np.array([mix(s ^ np.uint64(BYTE_STEP)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)),
        "bands": pa.array(bands, pa.list_(pa.int64())),
    }


def _full_sets(batch: pa.RecordBatch) -> dict:
    sets = [_signed(s) for s in shingle_sets(column(batch, "text"))]
    return {"node": column(batch, "doc_id"), "shingles": pa.array(sets, pa.list_(pa.int64()))}


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return two.where(100 * common >= PERCENT * union).select("a", "b")


def _block_links(rows: pa.Table, crossed: bool, band: int) -> Iterator[pa.RecordBatch]:
    """Links that join components of one block; those that join nothing new need not be told."""
    node, comp, size, part = (rows.column(c).to_numpy() for c in ("node", "component", "n_shingles", "chunk"))
    keys = np.stack(rows.column("bands").to_numpy(zero_copy_only=False)).astype(np.int64)
    values = keys.view(np.uint16)
    flat = np.concatenate(rows.column("shingles").to_numpy(zero_copy_only=False))
    names, shingle = np.unique(flat, return_inverse=True)
    first = np.concatenate(([0], np.cumsum(size)))
    mine = np.zeros(len(names), dtype=bool)
    groups = UnionFind()
    roots = comp.copy()
    links = []
    for i in range(len(node) - 1):
        rest = slice(i + 1, None)
        open_ = roots[rest] != roots[i]
        if crossed:
            open_ &= part[rest] != part[i]
        open_ &= 100 * np.minimum(size[rest], size[i]) >= PERCENT * np.maximum(size[rest], size[i])
        at = np.flatnonzero(open_) + i + 1
        # a pair that shares several bands is looked at in the first of them
        at = at[(keys[at, :band] != keys[i, :band]).all(axis=1)]
        at = at[(values[at] == values[i]).sum(axis=1) >= AGREE]
        if not len(at):
            continue
        own = shingle[first[i] : first[i + 1]]
        mine[own] = True
        theirs = np.concatenate([shingle[first[j] : first[j + 1]] for j in at])
        begin = np.concatenate(([0], np.cumsum(size[at])[:-1]))
        common = np.add.reduceat(mine[theirs].astype(np.int64), begin)
        mine[own] = False
        for j in at[100 * common >= PERCENT * (size[at] + size[i] - common)]:
            if groups.root(int(comp[i])) != groups.root(int(comp[j])):
                groups.link(int(comp[i]), int(comp[j]))
                links.append((max(node[i], node[j]), min(node[i], node[j])))
                roots[roots == roots[j]] = roots[i]
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: gathers one block at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "key", "low", "high")), strict=True))
        begin = 0
        while begin < len(keys):
            end = begin + 1
            while end < len(keys) and keys[end] == keys[begin]:
                end += 1
            if keys[begin] != now:
                if held:
                    yield from _block_links(pa.Table.from_batches(held), now[2] != now[3], now[0])
                held, now = [], keys[begin]
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield from _block_links(pa.Table.from_batches(held), now[2] != now[3], now[0])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    ``component_id`` is the smallest id among the documents reachable by links, itself included;
    ``kept`` marks that document. Null and empty texts, and texts of white space, have no shingles and link
    with nothing. Rows that share an id are one document of several texts. A row without an id keeps its
    component if a copy of its text has one, and is kept otherwise. Other columns are ignored. An empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(
        by_batch(texts, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>", _describe), "signatures"
    )
    keys = ["k1", "k2", "n_shingles"]
    classes = materialize(
        described.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("node")), "classes"
    )
    rows = described.join(classes, keys, "left").select("doc_id", "n_shingles", "node", "bands")
    rows = rows.withColumn("bands", F.when(F.col("doc_id") == F.col("node"), F.col("bands")))
    rows = materialize(rows, "classed")

    banded = rows.where("bands is not null").select(
        "node", "n_shingles", F.posexplode("bands").alias("band", "key")
    )
    buckets = banded.groupBy("band", "key").agg(
        F.min("node").alias("b"), F.max("node").alias("most"), F.min("n_shingles").alias("n_b"), F.count("*").alias("n")
    )
    buckets = materialize(buckets.where("b < most").drop("most", "n_b"), "buckets")
    members = materialize(banded.join(buckets, ["band", "key"]), "members")

    pairs = materialize(members.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    wanted = materialize(members.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    sets = by_batch(texts.join(wanted, "doc_id", "left_semi"), "node long, shingles array<long>", _full_sets)
    sets = materialize(sets, "sets")
    links = materialize(verified(pairs, sets), "links")

    if not links.isEmpty() or not pairs.isEmpty():
        more = _open_links(members, rows, sets, components(links, "a", "b"))
        links = materialize(links.unionByName(more), "links")
    groups = materialize(components(links, "a", "b"), "groups")
    out = rows.drop("bands").join(groups, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _open_links(members: DataFrame, rows: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between components among the members of buckets of three or more, block against block."""
    groups = materialize(groups, "groups")
    placed = members.where("n > 2").join(groups, "node", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    torn = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("most"))
    torn = materialize(torn.where("low < most").drop("low", "most"), "torn")
    loose = placed.join(torn, ["band", "key"])
    loose = loose.join(rows.where("bands is not null").select("node", "bands"), "node").join(sets, "node")
    # blocks of about BLOCK classes: each class meets every block of its bucket, in one task for each two blocks
    chunks = F.ceil(F.col("n") / BLOCK).cast("long")
    loose = loose.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks))
    loose = loose.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    block = ["band", "key", "low", "high"]
    loose = loose.select(
        "band", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "chunk", "node", "component", "n_shingles", "bands", "shingles",
    )
    return loose.repartition(*block).sortWithinPartitions(*block).mapInArrow(_compare, PAIR).distinct()
