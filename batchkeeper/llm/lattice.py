"""Near copies among embeddings: random projections decoded to points of the E8 lattice, then exact cosines.

Each table projects unit vectors to twice 8 dimensions and takes the nearest points of the E8 lattice, a pair of
them, as the vector's home cell. A vector stands in its home cell, and looks into that cell and the nearest of those
around it, where either point moves to one of the 240 around it. Two vectors meet in a table if either looks into the
other's home. At a cosine of 0.98 a table with the settings below misses about 24 in 100 pairs, eight tables 1 in
100,000; closer pairs are missed less often.

Cells meet first, by their keys alone; vectors move only for cells where two of them meet. Cells are dealt out as
blocks of about 4,096 standing vectors. A task multiplies the matrices of one block, counts links and joins
groups there, so neither a crowded cell nor a large group of copies lists its pairs.
A pair that meets more than once counts where it meets first, which both vectors' cells tell.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.graph import components
from batchkeeper.llm.text import by_batch, column, mix, prepare
from batchkeeper.session import materialize

COSINE = 0.98
TABLES = 8
PROBES = 4
#: Lattice points to a cell: one point of the scale below has some thousand cells in reach, two have millions.
PARTS = 2
SCALE = 0.6
BLOCK = 4096
#: Rows of a product at once: what a task holds of one block is STRIP x BLOCK.
STRIP = 128
LOOKS = 1 + PROBES


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd, the worst coordinate the other way."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    gap = x[odd] - point[odd]
    worst = np.abs(gap).argmax(axis=1)
    point[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the even integer points and the same moved by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def projection(dims: int, t: int) -> np.ndarray:
    return np.random.default_rng([dims, t]).normal(size=(dims, 8 * PARTS)) * SCALE


def _sums(points: np.ndarray, part: int) -> np.ndarray:
    """A 64-bit sum of a lattice point's coordinates; those of a cell's parts add up to its own."""
    twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    return (twice * mix(np.arange(1, 9, dtype=np.uint64) + np.uint64(8 * part))).sum(axis=-1, dtype=np.uint64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Per vector and table: the home cell, then the nearest cells around it, as 32-bit numbers.

    Two cells that share a number only meet in vain.
    """
    around = roots()
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int32)
    for t in range(tables):
        x = unit @ projection(unit.shape[1], t)
        far, total = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), dtype=np.uint64)
        for part in range(PARTS):
            own = x[:, 8 * part : 8 * part + 8]
            home = decode(own)
            gain = (own - home) @ around.T
            nearest = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            # how much further off each cell is than the home
            cost = np.concatenate((np.zeros((len(unit), 1)), 2 - 2 * np.take_along_axis(gain, nearest, 1)), axis=1)
            sums = _sums(np.concatenate((home[:, None, :], home[:, None, :] + around[nearest]), axis=1), part)
            far = (far[:, :, None] + cost[:, None, :]).reshape(len(unit), -1)
            total = (total[:, :, None] + sums[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(far, axis=1, kind="stable")[:, : 1 + probes]
            far, total = np.take_along_axis(far, best, 1), np.take_along_axis(total, best, 1)
        out[:, t] = (mix(total) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _units(values: list[bytes], kind: str) -> np.ndarray:
    found = np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1).astype(np.float64)
    return found / np.sqrt((found * found).sum(axis=1))[:, None]


def _vectors(kind: str):
    def rows(batch: pa.RecordBatch) -> dict:
        vectors, keys = [], []
        for v in column(batch, "vector").to_pylist():
            values = None
            if v and None not in v:
                values = np.array(v, dtype=kind)
                wide = values.astype(np.float64)
                if not np.isfinite(wide).all() or not 0 < (wide * wide).sum() < np.inf:
                    values = None
            vectors.append(None if values is None else values.tobytes())
            keys.append(None if values is None else hashlib.blake2b(vectors[-1], digest_size=16).digest())
        return {
            "vec_id": column(batch, "vec_id"), "label": column(batch, "label"), "line": column(batch, "line"),
            "vector": pa.array(vectors, pa.binary()), "key": pa.array(keys, pa.binary()),
        }

    return rows


def _place(kind: str):
    def rows(batch: pa.RecordBatch) -> dict:
        values = column(batch, "vector").to_pylist()
        found: list = [None] * len(values)
        for size in {len(v) for v in values}:
            at = [i for i, v in enumerate(values) if len(v) == size]
            for i, c in zip(at, cells(_units([values[i] for i in at], kind)).reshape(len(at), -1), strict=True):
                found[i] = c
        return {n: column(batch, n) for n in batch.schema.names} | {"cells": pa.array(found, pa.list_(pa.int32()))}

    return rows


def _meet(kind: str):
    """Rows sorted by block, standing vectors first: links counted and joined, block by block."""

    def strip(t: int, base: dict, looking: dict, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        hits = looking["unit"] @ base["unit"].T >= COSINE
        hits &= looking["line"][:, None] != base["line"][None, :]
        if not hits.any():
            return
        q, b = np.nonzero(hits)
        one, two = looking["cells"][q], base["cells"][b]
        forth = (one == two[:, :, :1]).any(axis=2)  # per table: the looking vector sees the standing one's home
        back = (two == one[:, :, :1]).any(axis=2)
        ours = (forth | back).argmax(axis=1) == t
        ours &= (looking["line"][q] < base["line"][b]) | ~back[:, t]
        q, b = q[ours], b[ours]
        seen = np.bincount(q, base["weight"][b], len(looking["line"])).astype(np.int64)
        met = np.bincount(b, looking["weight"][q], len(base["line"])).astype(np.int64)
        old, top = marks.copy(), looking["rep"].copy()
        while True:
            low = np.minimum(top, np.where(hits, marks[None, :], np.iinfo(np.int64).max).min(axis=1))
            new = np.minimum(marks, np.where(hits, low[:, None], np.iinfo(np.int64).max).min(axis=0))
            if (low == top).all() and (new == marks).all():
                break
            top, marks[:] = low, new
        own, moved = hits.any(axis=1), np.flatnonzero(old != marks)
        node = np.concatenate([looking["rep"][own], old[moved], ])
        peer = np.concatenate([top[own], marks[moved]])
        lines = np.concatenate([looking["line"][seen > 0], base["line"][met > 0]])
        links = np.concatenate([seen[seen > 0], met[met > 0]])
        none = pa.nulls(len(lines), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(links), none, none], names=["line", "links", "a", "b"])
        none = pa.nulls(len(node), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(node), pa.array(peer)], names=["line", "links", "a", "b"])

    def arrays(rows: pa.Table | pa.RecordBatch) -> dict:
        table = rows if isinstance(rows, pa.Table) else pa.Table.from_batches([rows])
        flat = np.stack(table.column("cells").to_numpy(zero_copy_only=False)).astype(np.int32)
        return {n: table.column(n).to_numpy() for n in ("line", "rep", "weight")} | {
            "unit": _units(table.column("vector").to_pylist(), kind), "cells": flat.reshape(len(flat), -1, LOOKS),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, base, marks = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("label", "dims", "t", "cell", "chunk", "looking")
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            changes = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                changes[1:] |= (c[1:] != c[:-1]).astype(bool)
            begins = np.flatnonzero(changes).tolist()
            for begin, end in zip([0, *begins], [*begins, batch.num_rows], strict=True):
                *key, looking = (c[begin] for c in columns)
                if key != now:
                    now, held, base = key, [], None
                part = batch.slice(begin, end - begin)
                if not looking:
                    held.append(part)
                elif held:
                    if base is None:
                        base = arrays(pa.Table.from_batches(held))
                        marks = base["rep"].copy()
                    for i in range(0, part.num_rows, STRIP):
                        yield from strip(int(now[2]), base, arrays(part.slice(i, STRIP)), marks)

    return run


def _meetings(leads: DataFrame) -> DataFrame:
    """Who takes part in which cells: ``line, place`` (of its cells), ``n`` standing there, ``looking``.

    Cells that one vector alone stands in or looks into take part in nothing, and most do; so this deals with keys
    of cells, and no vector moves for them. Two cells that share a key only meet in vain.
    """
    keys = leads.select("line", "label", "dims", F.posexplode("cells").alias("place", "cell"))
    table = F.floor(F.col("place") / LOOKS)
    keys = keys.select("line", "place", F.xxhash64("label", "dims", table, "cell").alias("key"))
    home = F.col("place") % LOOKS == 0
    homes = materialize(keys.where(home).groupBy("key").agg(F.count("*").alias("n")), "homes")
    # a look beyond the own home is a meeting where anybody stands
    looks = materialize(keys.where(~home).join(homes, "key"), "looks")
    seen = looks.select("key").distinct().withColumn("seen", F.lit(True))
    live = homes.join(seen, "key", "left").where("n > 1 or seen").drop("seen")
    stand = materialize(keys.where(home).join(materialize(live, "live"), "key"), "standing")
    standing = stand.select("line", "place", "n", F.lit(False).alias("looking"))
    inward = stand.where("n > 1").select("line", "place", "n", F.lit(True).alias("looking"))
    return standing.unionByName(inward).unionByName(looks.select("line", "place", "n", F.lit(True).alias("looking")))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    Linked are rows of equal, non-null labels whose vectors have a cosine of 0.98 or more, in double precision.
    ``n_links`` counts the other rows linked directly; ``component_id`` is the smallest id reachable, itself
    included. Null, empty and zero vectors, and those with null or non-finite components, link with nothing, nor
    do vectors of different lengths. Rows that share an id are counted apart and grouped together. A row without
    an id is counted and grouped, but gives its group no name. Other columns are ignored; an empty table
    gives none.
    """
    prepare(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    source = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"),
        F.monotonically_increasing_id().alias("line"),
    )
    schema = "vec_id long, label string, line long, vector binary, key binary"
    rows = materialize(by_batch(source, schema, _vectors(kind)), "vectors")

    valid = rows.where("label is not null and key is not null")
    classes = valid.groupBy("label", "key").agg(
        F.min("vec_id").alias("rep"), F.min("line").alias("first"), F.count("*").alias("weight")
    )
    classes = materialize(classes, "classes")
    leads = valid.join(classes, ["label", "key"]).where("line = first")
    leads = leads.select("label", "line", "rep", "weight", "vector")
    # no id at all: a name of its own, above every id, that is dropped again at the end
    named = F.coalesce("rep", F.col("line") + F.lit(2**62))
    leads = by_batch(
        leads.withColumn("rep", named),
        "label string, line long, rep long, weight long, vector binary, cells array<int>", _place(kind),
    )
    leads = materialize(leads.withColumn("dims", F.length("vector")), "leads")

    meetings = _meetings(leads)
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    chunk = F.pmod(F.xxhash64("line"), chunks).cast("int")
    every = F.sequence(F.lit(0), chunks - 1)
    meetings = meetings.withColumn("chunk", F.explode(F.when(F.col("looking"), every).otherwise(F.array(chunk)))).drop("n")
    there = materialize(meetings, "meetings").join(leads, "line")
    there = there.withColumn("t", F.floor(F.col("place") / LOOKS).cast("int")).withColumn("cell", F.expr("cells[place]"))
    block = ["label", "dims", "t", "cell", "chunk"]
    columns = [*block, "looking", "line", "rep", "weight", "vector", "cells"]
    dealt = there.select(*columns).repartition(*block)
    met = dealt.sortWithinPartitions(*block, "looking").mapInArrow(_meet(kind), "line long, links long, a long, b long")
    met = materialize(met, "met")

    counted = materialize(met.where("line is not null").groupBy("line").agg(F.sum("links").alias("links")), "counted")
    groups = components(met.where("a <> b"), "a", "b")
    groups = groups.select(F.col("node").alias("rep"), "component")
    counted = counted.withColumnRenamed("line", "first")
    known = classes.join(counted, "first", "left").withColumn("rep", F.coalesce("rep", F.col("first") + F.lit(2**62)))
    known = known.join(groups, "rep", "left")
    known = known.select("label", "key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = materialize(known, "known")
    out = rows.join(known, ["label", "key"], "left")
    named = F.when(F.col("component") < 2**62, F.col("component"))
    component = F.coalesce(named, "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
