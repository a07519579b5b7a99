"""Removal of word sequences that an earlier document already holds, by de Bruijn compaction.

An edge of the graph is a run of 50 consecutive words (a *window*); its nodes are the runs of 49 at either
end. Every window but the first of its document follows another edge, so a document is a walk.

1. *Pieces.* Consecutive windows with the same anchor (the smallest hash among the 16-word runs inside a
   window) make one piece. The anchor depends on the window's words alone, so equal windows always lie in
   pieces with equal anchors, and one row in about eighteen words is enough to find them.
2. *Paths.* Spark joins give each repeated piece its first document. Where all occurrences of a piece are
   followed by one and the same piece, which always follows it, nothing branches, and the two compact into a
   path, to be handled as one.
3. *Source coordinates.* A path's words are read again at the place of its first occurrence and digested. A
   document loses words only if its own words have that digest, so a hash never decides.
4. *Branches.* Pieces with equal anchors but different words (where a repeat begins, ends or was edited) are
   compared window by window, once per distinct piece, in the same way.

Nothing is sampled or capped: anchors only group windows, every window of 50 words is decided.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchkeeper.llm.text import BYTE_STEP, by_batch, column, mix, powers, prepare, windows, words
from batchkeeper.session import materialize

WINDOW = 50
ANCHOR = 16
#: Windows handled at once; a place within them fits the low bits of a packed anchor.
SLICE = 1 << 20
PLACE = np.uint64((1 << 24) - 1)

#: Equal windows agree on the anchor and, of the 34 other words, on the 17 before it or on the 17 after it.
HALF = (WINDOW - ANCHOR) // 2

PIECES = "doc_id long, start long, n long, anchor long, words long, sides long"
COLUMNS = ("doc_id", "start", "n", "anchor", "words", "sides")


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :])


def pieces(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """``start, n, anchor, words, sides`` of the pieces of one document: ``n`` windows from word ``start`` on.

    ``words`` is a hash of all the piece's words. ``sides`` holds 32 bits for the anchor with the words before it,
    and 32 for it with those after it; a half is 0 where no window of the piece reaches so far.
    """
    out = []
    inverse = pow(BYTE_STEP, -1, 1 << 64)
    for base in range(0, len(hashes) - WINDOW + 1, SLICE):
        own = hashes[base : base + SLICE + WINDOW - 1]
        runs = windows(own, ANCHOR)
        packed = (runs & ~PLACE) | np.arange(len(runs), dtype=np.uint64)
        place = _smallest(packed, WINDOW - ANCHOR + 1) & PLACE
        start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        n = np.diff(np.append(start, len(place)))
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(own * powers(BYTE_STEP, len(own)), out=sums[1:])
        unshift = powers(inverse, len(own))

        def of(first: np.ndarray, last: np.ndarray, sums: np.ndarray = sums, unshift: np.ndarray = unshift) -> np.ndarray:
            """A hash of the words from each first to before each last."""
            return mix((sums[last] - sums[first]) * unshift[first])

        text = of(start, start + n + WINDOW - 1)
        at = place[start].astype(np.int64)
        low = np.maximum(at - HALF, 0)
        high = np.minimum(at + ANCHOR + HALF, len(own))
        before = np.where(at - HALF >= start, of(low, at + ANCHOR) >> np.uint64(32) | np.uint64(1), np.uint64(0))
        after = np.where(at - HALF <= start + n - 1, of(at, high) >> np.uint64(32) | np.uint64(1), np.uint64(0))
        out.append((start + base, n, runs[at], text, before << np.uint64(32) | after))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pieces(batch: pa.RecordBatch) -> dict | None:
    found = words(column(batch, "text"))
    hashes = found.hashes()
    ids = column(batch, "doc_id").to_pylist()
    rows: list[tuple[np.ndarray, ...]] = []
    for i, doc in enumerate(ids):
        own = hashes[found.first[i] : found.first[i + 1]]
        if len(own) >= WINDOW:
            start, n, *hashed = pieces(own)
            rows.append((np.full(len(n), doc, dtype=np.int64), start, n, *(x.view(np.int64) for x in hashed)))
    if not rows:
        return None
    return dict(zip(COLUMNS, (np.concatenate(x) for x in zip(*rows, strict=True)), strict=True))


def _digest(found: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(found), digest_size=16).digest()


def _utf8(text: str | None) -> list[bytes]:
    """The words; ``bytes.split`` parts at exactly the six separators."""
    return (text or "").encode().split()


def _read_sources(batch: pa.RecordBatch) -> dict:
    """Digests of paths, and of every window of the pieces at branches."""
    doc_id, start, n, path, digest = [], [], [], [], []
    for doc, text, wanted in zip(
        column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), column(batch, "wanted").to_pylist(), strict=True
    ):
        own = _utf8(text)
        for w in wanted:
            for first, count in [(w["start"], w["n"])] if w["path"] else [(w["start"] + i, 1) for i in range(w["n"])]:
                if first + count + WINDOW - 1 <= len(own):
                    doc_id.append(doc)
                    start.append(first)
                    n.append(count)
                    path.append(w["path"])
                    digest.append(_digest(own[first : first + count + WINDOW - 1]))
    return {
        "doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64()),
        "path": pa.array(path, pa.bool_()), "digest": pa.array(digest, pa.binary()),
    }


def _remove(batch: pa.RecordBatch) -> dict:
    texts, spans = column(batch, "text").to_pylist(), column(batch, "spans").to_pylist()
    total, removed, kept = [], [], []
    for text, own_spans in zip(texts, spans, strict=True):
        own = _utf8(text)
        total.append(len(own))
        keep = np.ones(len(own), dtype=bool)
        for s in own_spans or ():
            end = s["start"] + s["n"] + WINDOW - 1
            if end <= len(own) and keep[s["start"] : end].any() and _digest(own[s["start"] : end]) == s["digest"]:
                keep[s["start"] : end] = False
        if not keep.all():
            own = [own[i] for i in np.flatnonzero(keep)]
        removed.append(total[-1] - len(own))
        kept.append(b" ".join(own).decode())
    return {
        "doc_id": column(batch, "doc_id"), "n_words": pa.array(total, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()),
    }


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``doc_id, start, n, digest``: ``n`` windows from word ``start`` on that a smaller id is said to hold.

    ``digest`` is that of the words ``start`` to ``start + n + 48`` where they first occur.
    """
    found = materialize(by_batch(texts.where("doc_id is not null"), PIECES, _pieces), "pieces")
    piece = ["anchor", "words", "n"]

    # pieces whose anchor is in two documents or more; of each, the first document and how often it occurs
    anchors = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    anchors = materialize(anchors.where("low < high").select("anchor"), "anchors")
    shared = materialize(found.join(anchors, "anchor"), "shared")
    distinct = shared.groupBy(*piece).agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("times"),
        F.min("sides").alias("sides"),
    )
    distinct = materialize(distinct, "distinct")
    # branches: different pieces that may share a window, as they agree on the anchor and the words on one side
    half = F.explode(F.array(F.shiftright("sides", 32), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 33)))
    halves = distinct.select(*piece, half.alias("half")).where(~F.col("half").isin(0, 1 << 33))
    met = halves.groupBy("anchor", "half").agg(F.count("*").alias("pieces")).where("pieces > 1").drop("pieces")
    branches = halves.join(materialize(met, "met"), ["anchor", "half"]).select(*piece, F.lit(True).alias("branch")).distinct()
    distinct = materialize(distinct.drop("sides").join(materialize(branches, "branches"), piece, "left"), "known")
    at = materialize(shared.drop("sides").join(distinct, piece), "occurrences")

    # links: all occurrences of one piece lead to the other, and all of the other come from it
    many = at.where("source < last")
    after = many.select("doc_id", "start", *[F.col(c).alias(f"next_{c}") for c in piece], F.col("times").alias("next_times"))
    steps = many.withColumn("start", F.col("start") + F.col("n")).join(after, ["doc_id", "start"])
    steps = steps.groupBy(*piece, "times", *[f"next_{c}" for c in piece], "next_times").agg(F.count("*").alias("both"))
    linked = steps.where("both = times and both = next_times").select(*[F.col(f"next_{c}").alias(c) for c in piece])
    linked = materialize(linked.withColumn("linked", F.lit(True)), "linked")

    # a path lies in one stretch of its source; its head is the last piece there that nothing links to
    first = many.where("doc_id = source").groupBy(*piece, "source").agg(F.min("start").alias("start"))
    first = first.join(linked, piece, "left")
    along = Window.partitionBy("source").orderBy("start")
    head = F.when(F.col("linked").isNull(), F.col("start"))
    first = first.withColumn("head", F.last(head, ignorenulls=True).over(along))
    lengths = first.groupBy("source", "head").agg(F.sum("n").alias("path_n"))
    heads = first.where("linked is null").select(*piece, "source", F.col("start").alias("head"))
    paths = materialize(heads.join(lengths, ["source", "head"]), "paths")

    wanted = paths.select(
        F.col("source").alias("doc_id"), F.col("head").alias("start"), F.col("path_n").alias("n"), F.lit(True).alias("path")
    ).unionByName(
        at.where("branch and doc_id = source").select("doc_id", "start", "n", F.lit(False).alias("path"))
    )
    wanted = materialize(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "path")).alias("wanted")), "wanted")
    digests = by_batch(
        texts.join(wanted, "doc_id"), "doc_id long, start long, n long, path boolean, digest binary", _read_sources
    )
    digests = materialize(digests, "digests")

    known = digests.where("path").select(
        F.col("doc_id").alias("source"), F.col("start").alias("head"), F.col("n").alias("path_n"), "digest"
    )
    known = materialize(known.join(paths, ["source", "head", "path_n"]), "known")
    later = many.where("doc_id > source").join(known.drop("source"), piece)
    later = later.select("doc_id", "start", F.col("path_n").alias("n"), "digest")
    single = digests.where("not path")
    earliest = materialize(single.groupBy("digest").agg(F.min("doc_id").alias("low")), "earliest")
    edited = single.join(earliest, "digest").where("doc_id > low").select("doc_id", "start", "n", "digest")
    return later.unionByName(edited)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for each row of ``docs``.

    Removed is each word covered by a run of 50 words that also starts in a document with a smaller id, as
    both stand in the input; ``kept_text`` is the rest joined by single spaces. Null and empty texts, and
    texts of fewer than 50 words, lose nothing. Rows that share an id are no repeats of each other; rows
    without an id neither lose words nor cause losses. Other columns are ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(texts).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "digest")).alias("spans"))
    joined = texts.join(materialize(spans, "spans"), "doc_id", "left")
    return by_batch(joined, "doc_id long, n_words long, n_removed long, kept_text string", _remove)
