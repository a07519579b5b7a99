"""Spelling variants: words one edit apart, found by dynamic programming along the sorted vocabulary.

A word and its near word share the first half of the shorter one, or its second half. So the vocabulary is
sorted twice, as it is and with every word reversed, and cut into ranges that share such a half.

Within a range each word is held against the sorted list as follows. Its edit matrix against a listed word has one row per
letter of that word, three cells wide, as cells further from the diagonal exceed one edit. Listed words that follow
each other share the rows of their common prefix (LCP), so a row is computed once for the whole stretch of the list
that shares its prefix. A stretch whose row exceeds one edit in every cell is skipped with all its words.
The rows of all words and stretches of equal depth are numpy arrays, many ranges at a time.

Tasks give, per word and range, the number of near words and the most frequent one: pairs are never listed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.text import column, prepare
from batchkeeper.session import materialize

# fixed values: runs of letters, which of them lose a letter, and which words count
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
ONE_IN = 31
LETTERS = 7
LEAST = 2
TIMES = 10

#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17
#: Words of the ranges that are worked on at once, and of either side of a block of a crowded range.
UNIT = 1 << 15
CROWD = 1 << 13
#: Pairs of a word and a stretch that are worked on at once.
PAIRS = 1 << 18
#: Any number of edits above one.
MANY = 2


def words_of(doc_id: int | None, text: str) -> Counter[str]:
    """Counted words of one document, each run that draws it without one of its letters."""
    out: Counter[str] = Counter()
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    folded: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        if len(run) >= LETTERS:
            folded[run if run.islower() else run.translate(FOLD)] += n
    for run, n in folded.items():
        h = zlib.crc32(run.encode(), begin)
        if h % ONE_IN == 0:
            h %= len(run)
            run = run[:h] + run[h + 1 :]
        if len(run) >= LETTERS:
            out[run] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            if text:
                held.update(words_of(doc_id, text))
            if len(held) >= HELD:
                yield handed()
                held.clear()
    yield handed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words that count, from ``doc_id, text``."""
    counted = docs.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST)


class Sorted:
    """Words in ranges: the ranges follow each other, and the words of each are sorted. One byte is one letter."""

    def __init__(self, words: list[str], ranges: np.ndarray, shared: np.ndarray) -> None:
        coded = [w.encode("latin-1") for w in words]
        self.length = np.array([len(c) for c in coded], dtype=np.int64)
        self.data = np.frombuffer(b"".join(coded) + b"\0", dtype=np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.ranges, self.shared = ranges, shared
        self.lcp = self._adjacent()

    def letter(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """0, which is no letter, outside the word."""
        inside = (place >= 0) & (place < self.length[word])
        return np.where(inside, self.data[np.where(inside, self.start[word] + place, -1)], 0)

    def _adjacent(self) -> np.ndarray:
        """How many letters each word shares with the one before it; -1 at the begin of a range."""
        out = np.full(len(self.length), -1, dtype=np.int64)
        at = np.flatnonzero(self.ranges[1:] == self.ranges[:-1]) + 1
        depth = self.shared[at].copy()
        going = np.arange(len(at))
        while len(going):
            a, d = at[going], depth[going]
            same = (self.letter(a, d) == self.letter(a - 1, d)) & (d < self.length[a])
            going = going[same]
            depth[going] += 1
        out[at] = depth
        return out


def near(asks: np.ndarray, stands: np.ndarray, listed: Sorted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(asking word, listed word)`` exactly one edit apart, depth by depth, within ranges.

    Only words in ``asks`` ask; only those with ``stands`` answer.
    """
    size = len(listed.length)
    first = np.flatnonzero(listed.lcp < 0)
    after = np.append(first[1:], size)
    which = np.cumsum(listed.lcp < 0) - 1
    begins: dict[int, np.ndarray] = {}  # by depth: where stretches of words begin that share one letter more

    def work(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, rows: np.ndarray) -> Iterator:
        stack = [(q, lo, hi, depth, rows)]
        while stack:
            q, lo, hi, depth, rows = stack.pop()
            # a listed word that ends here is the first of its stretch
            ends = listed.length[lo] == depth
            beside = listed.length[q] - depth + 1
            at = np.flatnonzero(ends & (beside >= 0) & (beside <= 2) & stands[lo])
            at = at[rows[at, beside[at]] == 1]
            if len(at):
                yield q[at], lo[at]
            lo = lo + ends
            left = np.flatnonzero(lo < hi)
            if not len(left):
                continue
            q, lo, hi, rows = q[left], lo[left], hi[left], rows[left]
            # the stretch falls apart where neighbours differ in the next letter
            if depth not in begins:
                begins[depth] = np.flatnonzero(listed.lcp <= depth)
            cuts = begins[depth]
            a, b = np.searchsorted(cuts, lo, side="right"), np.searchsorted(cuts, hi)
            n = b - a + 1
            if n.sum() > PAIRS and len(q) > 1:
                half = len(q) // 2
                # as they stand now: no word that has ended is met again
                stack += [(q[:half], lo[:half], hi[:half], depth, rows[:half]), (q[half:], lo[half:], hi[half:], depth, rows[half:])]
                continue
            owner = np.repeat(np.arange(len(q)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            lead = place == 0
            spot = a[owner] + place
            start = np.where(lead, lo[owner], cuts[np.minimum(spot - 1, len(cuts) - 1)])
            stop = np.where(place == n[owner] - 1, hi[owner], cuts[np.minimum(spot, len(cuts) - 1)])
            q, lo, hi, old = q[owner], start, stop, rows[owner]
            c = listed.letter(lo, np.full(len(lo), depth))
            edits = [old[:, k] + (listed.letter(q, np.full(len(q), depth - 1 + k)) != c) for k in range(3)]
            new = np.empty_like(old)
            new[:, 0] = np.minimum(edits[0], old[:, 1] + 1)
            new[:, 1] = np.minimum(np.minimum(edits[1], old[:, 2] + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(edits[2], new[:, 1] + 1)
            depth = depth + 1
            for k in range(3):  # no cell behind the word's end
                new[depth - 1 + k > listed.length[q], k] = MANY
            new = np.minimum(new, MANY)
            alive = np.flatnonzero(new.min(axis=1) <= 1)
            if len(alive):
                stack.append((q[alive], lo[alive], hi[alive], depth, new[alive]))

    for shared in np.unique(listed.shared[asks]).tolist():
        own = asks[listed.shared[asks] == shared]
        # the first ``shared`` letters are equal: no edit on the diagonal, one beside it
        rows = np.tile(np.array([1, 0, 1], dtype=np.int8), (len(own), 1))
        yield from work(own, first[which[own]], after[which[own]], shared, rows)


def _answers(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Per asking word of whole ranges: how many near words it met, and the most frequent of them."""
    words = rows.column("word").to_pylist()
    turned = rows.column("turned").to_numpy()
    shared = rows.column("shared").to_numpy().astype(np.int64)
    asks, stands = rows.column("asks").to_numpy(), rows.column("stands").to_numpy()
    n = rows.column("n").to_numpy()
    key = rows.column("range").to_numpy().astype(np.int64)
    listed = Sorted(words, key, shared)
    found_q, found_w = [], []
    for q, w in near(np.flatnonzero(asks), stands, listed):
        shorter = np.minimum(listed.length[q], listed.length[w])
        own = shorter // 2 == shared[q]  # others meet in the range of their own half
        q, w = q[own], w[own]
        # found in the forward list too, if the first half is equal: that is the end of a reversed word
        both = np.flatnonzero(turned[q])
        if len(both):
            half = shorter[own][both] // 2
            a, b = q[both], w[both]
            same = np.array([words[x][len(words[x]) - k :] == words[y][len(words[y]) - k :] for x, y, k in zip(a.tolist(), b.tolist(), half.tolist(), strict=True)], dtype=bool)
            keep = np.ones(len(q), dtype=bool)
            keep[both[same]] = False
            q, w = q[keep], w[keep]
        found_q.append(q)
        found_w.append(w)
    if not found_q:
        return
    q, w = np.concatenate(found_q), np.concatenate(found_w)
    if not len(q):
        return
    # the most frequent first, then the smallest word
    plain = np.array([x[::-1] if t else x for x, t in zip(words, turned.tolist(), strict=True)], dtype=object)
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.lexsort((np.argsort(np.argsort(plain, kind="stable"), kind="stable"), -n))] = np.arange(len(words))
    order = np.lexsort((rank[w], q))
    q, w = q[order], w[order]
    top = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    count = np.diff(np.append(top, len(q)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(plain[q[top]], pa.string()), pa.array(count, pa.int64()), pa.array(plain[w[top]], pa.string()), pa.array(n[w[top]])],
        names=["word", "n_near", "peer", "peer_n"],
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and word: works on whole ranges, many small ones at a time."""
    names = ["turned", "half", "a", "b"]
    held: list[pa.RecordBatch] = []
    rows = 0

    def numbered(table: pa.Table) -> pa.Table:
        number = np.zeros(table.num_rows, dtype=np.int64)
        for c in names:
            own = table.column(c).combine_chunks()
            if c == "turned":
                own = own.cast(pa.int8())
            values = own.to_numpy(zero_copy_only=False)
            number[1:] |= (values[1:] != values[:-1]).astype(np.int64)
        return table.append_column("range", pa.array(np.cumsum(number)))

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < UNIT:
            continue
        table = numbered(pa.Table.from_batches(held))
        key = table.column("range").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last range may go on
        if cut:
            yield from _answers(table.slice(0, cut))
        held = table.slice(cut).drop_columns(["range"]).to_batches()
        rows = table.num_rows - cut
    if rows:
        yield from _answers(numbered(pa.Table.from_batches(held)))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, peer, peer_n`` for each word of ``word, n`` that has one one edit apart."""
    letters = F.length("word")
    halves = F.array_distinct(F.array(F.floor(letters / 2), F.floor((letters - 1) / 2)))
    both = F.array(F.struct(F.lit(False).alias("turned"), F.col("word").alias("w")), F.struct(F.lit(True).alias("turned"), F.reverse("word").alias("w")))
    rows = words.select("n", F.explode(both).alias("side"), halves.alias("halves")).select("n", "side.*", F.explode("halves").alias("shared"))
    rows = rows.select("turned", F.expr("substring(w, 1, cast(shared as int))").alias("half"), F.col("shared").cast("int").alias("shared"), F.col("w").alias("word"), "n")
    crowd = rows.groupBy("turned", "half").agg(F.count("*").alias("size")).where(F.col("size") > CROWD)
    crowd = materialize(crowd.select("turned", "half", F.ceil(F.col("size") / CROWD).cast("int").alias("chunks")), "crowd")
    # a crowded range is dealt out by its asking and by its listed words: each word asks in one row of blocks,
    # and stands in one column
    rows = rows.join(crowd, ["turned", "half"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    asking = F.expr("transform(sequence(0, chunks - 1), k -> named_struct('a', own, 'b', k, 'asks', true, 'stands', k = own))")
    standing = F.expr(
        "transform(filter(sequence(0, chunks - 1), k -> k <> own), k -> named_struct('a', k, 'b', own, 'asks', false, 'stands', true))"
    )
    rows = rows.withColumn("block", F.explode(F.concat(asking, standing)))
    rows = rows.select("turned", "half", "block.*", "shared", "word", "n")
    block = ["turned", "half", "a", "b"]
    dealt = rows.repartition(*block).sortWithinPartitions(*block, "word")
    met = dealt.mapInArrow(_meet, "word string, n_near long, peer string, peer_n long")
    best = F.min(F.struct((-F.col("peer_n")).alias("k"), F.col("peer").alias("peer"))).alias("best")
    met = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return met.select("word", "n_near", F.col("best.peer").alias("peer"), (-F.col("best.k")).alias("peer_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: each chain of forms followed to its last, twice as far in each round."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(ahead, "root", "left_semi").isEmpty():
            return at
        step = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        at = materialize(step, "roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of at least 7 letters and 2 occurrences in ``docs``.

    Words are runs of letters, A to Z folded; one run in 31, chosen by id and run, loses a letter. ``form`` is the most
    frequent word one edit away (ties: the smallest in code-point order) if it is ten times as frequent, else null;
    ``form_n`` is its count. ``root`` follows forms to the last; a word without form is its own root.
    Null and empty texts hold no words; a row without an id draws letters as if its id were empty.
    Repeated rows, and rows that share an id, count each. Whole texts count, however long, and words of any length.
    Other columns are ignored, whatever their names; an empty table gives none.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = materialize(vocabulary(source), "words")
    peers = neighbours(words)
    joined = words.join(peers, "word", "left")
    has = F.col("peer_n") >= TIMES * F.col("n")
    joined = materialize(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("peer")).alias("form"), F.when(has, F.col("peer_n")).alias("form_n"),
        ),
        "forms",
    )
    out = joined.join(roots(joined.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
