"""Ranked lexical search: exact best-first inner products over sparse ball trees.

A document is a sparse vector with one coordinate for each of its terms, the term's contribution to any score
(a whole number: the term's weight times a saturating share of its occurrences). An item is the vector of ones at
its terms, so its score with a document is an inner product, and the order of scores is that of products.

1. One pass over the texts counts terms that any item holds; the vectors are written once, without the texts.
2. Document frequencies, the number of documents and their lengths are sums over that table.
3. Tasks read the vectors block by block and halve each block into a ball tree: every node has the centroid of its
   documents, the radius around it, and the largest deviation from it in each coordinate. For an item, no document of
   a node scores above ``centroid . item + |item| * radius``, the radius taken in the item's own coordinates where
   that is smaller, and rounded up. Nodes are visited best bound first, until no bound reaches the item's
   worst kept document. Leaves are scored in whole numbers. What a task keeps carries over to its next blocks.
4. Each task gives its best documents of each item, and a ranking in two steps merges them.

Items go through in blocks, so neither their number nor their vocabulary bounds what a task or the driver holds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchkeeper.llm.text import LOWER, Words, by_batch, column, prepare, runs, utf8
from batchkeeper.session import materialize

# fixed values: term characters are ASCII digits and letters and all beyond ASCII; the constants of the score
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[ord("0") : ord("9") + 1] = IS_TERM[ord("A") : ord("Z") + 1] = IS_TERM[ord("a") : ord("z") + 1] = True
IS_TERM[128:] = True
UNIT, SCALED, DAMPING, SHARE = 1_000_000_000, 1000, 20, 50

TOP = 50
#: Documents and vector entries of one tree, documents of a leaf, items and terms of one pass.
BLOCK, ENTRIES, LEAF = 4096, 1 << 21, 32
ITEMS, TERMS = 1024, 1 << 18
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
#: Relative error that the sums of a bound can have, many times over.
SLACK = 1e-11

HIT = "line long, item_id long, doc_id long, score long"


def terms(texts: pa.Array) -> Words:
    """Terms of each text, A to Z folded; null is an empty text."""
    data, offsets = utf8(texts)
    inside = IS_TERM[data]
    starts, ends = runs(inside, offsets)
    return Words(np.where(inside, LOWER[data], np.uint8(32)), offsets, starts, ends, np.searchsorted(starts, offsets))


def keys(found: Words) -> np.ndarray:
    """128 bits for each term, as pairs of 64: a term of an item is told from any other by both."""
    return np.stack([found.hashes(11), found.hashes(12)], axis=1)


@dataclass
class Items:
    """A block of items: their ids, and their distinct terms as places in one sorted vocabulary."""

    lines: np.ndarray
    ids: list
    known: np.ndarray  # the first 64 bits of each term, sorted
    check: np.ndarray  # the other 64
    first: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, lines: list[int], ids: list, texts: list) -> Items:
        found = terms(pa.array(texts, pa.string()))
        own = keys(found)
        vocabulary, place = np.unique(own, axis=0, return_inverse=True)
        place = place.reshape(-1)
        each = [np.unique(place[a:b]) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        first = np.concatenate(([0], np.cumsum([len(e) for e in each])))
        return cls(
            np.array(lines, dtype=np.int64), ids, vocabulary[:, 0].copy(), vocabulary[:, 1].copy(), first,
            np.concatenate([*each, np.zeros(0, dtype=np.int64)]).astype(np.int64),
        )

    def terms_of(self, i: int) -> np.ndarray:
        return self.places[self.first[i] : self.first[i + 1]]


def _vectors(items: Items):
    """Per document: its length in terms, and how often it holds each term of the items."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = terms(column(batch, "text"))
        own = keys(found)
        at = np.minimum(np.searchsorted(items.known, own[:, 0]), max(len(items.known) - 1, 0))
        hit = (
            (items.known[at] == own[:, 0]) & (items.check[at] == own[:, 1])
            if len(items.known)
            else np.zeros(len(own), dtype=bool)
        )
        n = np.diff(found.first)
        doc = np.repeat(np.arange(batch.num_rows), n)[hit]
        cell, tf = np.unique(doc * max(len(items.known), 1) + at[hit], return_counts=True)
        doc, place = np.divmod(cell, max(len(items.known), 1))
        cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        place, tf = place.astype("<u4"), tf.astype("<u4")
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return {
            "doc_id": column(batch, "doc_id"), "n": n.astype(np.int64),
            "places": pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()),
            "counts": pa.array([tf[a:b].tobytes() for a, b in spans], pa.binary()),
        }

    return rows


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        held = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4")
        n = np.bincount(held, minlength=len(total)).astype(np.int64)
        n[: len(total)] += total
        total = n
    places = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places])], names=["place", "df"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Documents of one tree in the order of its leaves: entries ``first[d]:first[d + 1]`` are document d's."""

    ids: list
    first: np.ndarray
    places: np.ndarray
    values: np.ndarray  # contributions, whole numbers

    def entries(self, lo: int, hi: int) -> slice:
        return slice(self.first[lo], self.first[hi])

    def rows(self, lo: int, hi: int) -> np.ndarray:
        return np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))

    def ordered(self, order: np.ndarray, lo: int, hi: int) -> None:
        """Put the documents from ``lo`` to ``hi`` into another order, in place."""
        size = np.diff(self.first[lo : hi + 1])
        begin = self.first[lo:hi][order]
        size = size[order]
        after = np.cumsum(size)
        take = np.arange(after[-1] if len(after) else 0) + np.repeat(begin - (after - size), size)
        part = self.entries(lo, hi)
        self.places[part], self.values[part] = self.places[take], self.values[take]
        self.first[lo + 1 : hi + 1] = self.first[lo] + after
        self.ids[lo:hi] = [self.ids[lo + i] for i in order]


@dataclass
class Node:
    lo: int
    hi: int
    bounds: np.ndarray  # per item: no document of the node scores more
    children: tuple[Node, ...] = ()


def _bounds(block: Block, lo: int, hi: int, items: Items, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per item the largest score that the node's ball allows; and the centroid."""
    part = block.entries(lo, hi)
    places, values = block.places[part], block.values[part].astype(np.float64)
    center = np.bincount(places, values, size) / (hi - lo)
    most = np.zeros(size)
    np.maximum.at(most, places, values)
    away = np.maximum(most - center, center) ** 2
    norms = np.bincount(block.rows(lo, hi), values * values, hi - lo)
    dots = np.bincount(block.rows(lo, hi), values * center[places], hi - lo)
    middle = float(center @ center)
    far = norms - 2 * dots + middle + SLACK * (norms + middle)
    radius = math.sqrt(max(float(far.max()), 0.0))
    filled = np.append(items.places, 0)
    own = np.sqrt(np.add.reduceat(away[filled], items.first[:-1]))
    along = np.add.reduceat(center[filled], items.first[:-1])
    length = np.diff(items.first)
    bound = (along + np.sqrt(length) * np.minimum(own, radius)) * (1 + SLACK * 100) + 1
    return np.where(length > 0, bound, -1.0), center


def grow(block: Block, lo: int, hi: int, items: Items, size: int) -> Node:
    """The ball tree over documents ``lo`` to ``hi``; halves along the line between two far documents."""
    bounds, center = _bounds(block, lo, hi, items, size)
    node = Node(lo, hi, bounds)
    if hi - lo <= LEAF:
        return node
    part = block.entries(lo, hi)
    rows, places, values = block.rows(lo, hi), block.places[part], block.values[part].astype(np.float64)

    def spread(d: int) -> np.ndarray:
        out = np.zeros(size)
        own = block.entries(lo + d, lo + d + 1)
        out[block.places[own]] = block.values[own]
        return out

    norms = np.bincount(rows, values * values, hi - lo)
    a = spread(int((norms - 2 * np.bincount(rows, values * center[places], hi - lo)).argmax()))
    b = spread(int((norms - 2 * np.bincount(rows, values * a[places], hi - lo)).argmax()))
    order = np.argsort(np.bincount(rows, values * (a - b)[places], hi - lo), kind="stable")
    block.ordered(order, lo, hi)
    middle = (lo + hi) // 2
    node.children = (grow(block, lo, middle, items, size), grow(block, middle, hi, items, size))
    return node


class Best:
    """The best documents of one item: highest score first, then smallest id, null last."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.heap: list[tuple] = []  # the worst kept is at the top

    @property
    def least(self) -> int:
        """A document below this score cannot enter."""
        return max(self.heap[0][0], 1) if len(self.heap) == self.top else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, -doc_id if doc_id is not None else -math.inf, doc_id)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry[:2] > self.heap[0][:2]:
            heapq.heapreplace(self.heap, entry)


def search(block: Block, items: Items, best: list[Best], size: int) -> int:
    """Best-first over the block's tree for every item; gives the number of leaves that were scored."""
    root = grow(block, 0, len(block.ids), items, size)
    wanted = np.zeros(size, dtype=bool)
    owners = block.rows(0, len(block.ids))
    scored = 0
    for i, kept in enumerate(best):
        own = items.terms_of(i)
        if not len(own):
            continue
        wanted[own] = True
        queue = [(-root.bounds[i], root.lo, root)]
        while queue and -queue[0][0] >= kept.least:
            _, _, node = heapq.heappop(queue)
            for child in node.children:
                if child.bounds[i] >= kept.least:
                    heapq.heappush(queue, (-child.bounds[i], child.lo, child))
            if node.children:
                continue
            scored += 1
            part = block.entries(node.lo, node.hi)
            hit = np.flatnonzero(wanted[block.places[part]])
            if not len(hit):
                continue
            rows = owners[part][hit] - node.lo
            values = block.values[part][hit]
            if int(values.max()) * len(own) < EXACT:
                scores = np.bincount(rows, values, node.hi - node.lo).astype(np.int64)
            else:
                scores = np.zeros(node.hi - node.lo, dtype=np.int64)
                np.add.at(scores, rows, values)
            for d in np.flatnonzero(scores >= kept.least):
                kept.add(int(scores[d]), block.ids[node.lo + d])
        wanted[own] = False
    return scored


def _searched(items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    """Blocks of the vectors one after the other; at the end the best documents of each item."""

    def block_of(rows: list[pa.RecordBatch]) -> Block:
        table = pa.Table.from_batches(rows)
        held = table.column("places").to_pylist()
        places = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int64)
        tf = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype="<u4").astype(np.int64)
        each = np.array([len(h) // 4 for h in held], dtype=np.int64)
        m = (100 - SHARE) + SHARE * table.column("n").to_numpy() * n_docs // max(n_terms, 1)
        values = weights[places] * (UNIT * tf // (SCALED * tf + DAMPING * np.repeat(m, each)))
        return Block(table.column("doc_id").to_pylist(), np.concatenate(([0], np.cumsum(each))), places, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items.ids]
        held: list[pa.RecordBatch] = []
        docs = entries = 0
        for batch in batches:
            for part in (batch.slice(i, LEAF) for i in range(0, batch.num_rows, LEAF)):
                held.append(part)
                docs += part.num_rows
                entries += sum(len(p) for p in part.column("places").to_pylist()) // 4
                if docs >= BLOCK or entries >= ENTRIES:
                    search(block_of(held), items, best, len(weights))
                    held, docs, entries = [], 0, 0
        if docs:
            search(block_of(held), items, best, len(weights))
        found = [(int(items.lines[i]), items.ids[i], d, s) for i, kept in enumerate(best) for s, _, d in kept.heap]
        names = ("line", "item_id", "doc_id", "score")
        columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return run


def _blocks(items: DataFrame) -> Iterator[Items]:
    """All items in blocks of bounded size, streamed through the driver one input partition at a time."""
    lines: list[int] = []
    ids: list = []
    texts: list = []
    held = 0
    for row in items.toLocalIterator():
        lines.append(row.line)
        ids.append(row.item_id)
        texts.append(row.text)
        held += len(row.text or "") // 4
        if len(lines) >= ITEMS or held >= TERMS:
            yield Items.of(lines, ids, texts)
            lines, ids, texts, held = [], [], [], 0
    if lines:
        yield Items.of(lines, ids, texts)


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", top: int = TOP,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of ``docs`` with the highest scores for each row of ``items``.

    Only scores above 0; fewer rows where fewer documents reach that. Equal scores are ranked by ascending
    ``doc_id``, null last. Null and empty texts, and texts without terms, hold nothing: as documents they do not count,
    as items they give no rows. Repeated rows of ``docs``, and rows that share an id, are documents of their own; so are rows of
    ``items``, each ranked from 1. Whole texts count, however long: a batch holds a very long one by itself. Other
    columns are ignored, whatever their names. Either table empty: no rows.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(
        F.monotonically_increasing_id().alias("line"), F.col(item_col).cast("long").alias("item_id"),
        F.col(item_text_col).cast("string").alias("text"),
    )
    asked = materialize(asked, "items")
    out = None
    for block in _blocks(asked):
        schema = "doc_id long, n long, places binary, counts binary"
        vectors = materialize(by_batch(source, schema, _vectors(block)), "vectors").where("n > 0")
        sums = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        partial = vectors.select("places").mapInArrow(_frequencies, "place long, df long")
        counted = partial.groupBy("place").agg(F.sum("df").alias("df")).toArrow()
        weights = np.zeros(max(len(block.known), 1), dtype=np.int64)
        for place, df in zip(counted.column("place").to_pylist(), counted.column("df").to_pylist(), strict=True):
            weights[place] = weight(sums.n, df)
        found = vectors.where(F.length("places") > 0).mapInArrow(_searched(block, weights, sums.n, sums.l, top), HIT)
        found = materialize(found.withColumn("part", F.spark_partition_id()), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # tasks give up to ``top`` rows of an item each: groups of them first, then all
    out = out.withColumn("share", F.pmod(F.xxhash64("part"), F.lit(64)))
    some = Window.partitionBy("line", "share").orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("line").orderBy(*order)))
    return out.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS line, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
e AS (SELECT line, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
p AS (SELECT line, doc_id, n, term, count(*)::BIGINT AS tf FROM e GROUP BY line, doc_id, n, term),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM p, s GROUP BY term),
q AS (SELECT DISTINCT line, item_id, unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT row_number() OVER () AS line, item_id, text FROM benchmark)),
r AS (SELECT q.line, q.item_id, p.line AS doc_line, p.doc_id,
             sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * s.big_n) // s.l))))::BIGINT AS score
      FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term, s
      GROUP BY q.line, q.item_id, p.line, p.doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY line ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank,
             doc_id, score
      FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
