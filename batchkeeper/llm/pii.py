"""Personal data in texts: four fixed patterns, and identifiers that their contexts give away.

The fixed patterns (mail addresses, IP addresses, card numbers, phone numbers) are always reported, and are the
seeds. Identifiers of other spellings (a phone number without its country, an address without a domain) are
candidates. What stands before a seed or a candidate, the last word or the last two, is a lexical pattern.

1. One pass over the texts writes the fixed matches, the candidates and the patterns of both.
2. Patterns that stand before enough different identifiers are counted in all texts, whatever follows them there:
   a fixed-size filter finds their places, a join counts them.
3. The graph of patterns and identifiers is scored in rounds. A pattern's confidence for a kind is the share of its
   uses that identifiers of the kind follow, each counted with its own confidence; a candidate's confidence is what
   its trusted patterns leave of doubt. Seeds stay certain. So a pattern that seeds induce vouches for candidates,
   and these for further patterns.
4. Candidates that are trusted in the end are reported wherever they stand, as kind ``context``.

The graph, its scores and the joins are Spark's; neither texts, patterns nor identifiers reach the driver, but for
the filter's bits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.text import BYTE_STEP, LOWER, WORD_STEP, Words, by_batch, column, mix, prepare, runs, utf8
from batchkeeper.session import materialize

# fixed values: the patterns of the base, and when a match counts
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IP_PARTS, IP_MOST = 4, 255
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)
KINDS = ("email", "ip", "card", "phone", "context")
EMAIL_KIND, IP_KIND, CARD_KIND, PHONE_KIND, CONTEXT = range(5)

#: Candidates: numbers in groups, addresses without a domain or with a spelt at sign, groups of hexadecimal digits.
NUMBER = re.compile(r"(?<![0-9A-Za-z@._+-])\(?[0-9][0-9\x20().\-/]{5,}[0-9](?![0-9A-Za-z@])")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
SPELT = re.compile(r"\x20?[\[(]at[\])]\x20?")
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f:]{7,}(?![0-9A-Za-z:])")
#: Digits a candidate number must have to pass as a phone or a card number.
LIKE_PHONE, LIKE_CARD = (7, 15), (12, 19)

LETTERS = re.compile("[A-Za-z\u0080-\U0010ffff]+")
IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[ord("A") : ord("Z") + 1] = IS_LETTER[ord("a") : ord("z") + 1] = True
IS_LETTER[128:] = True

#: Characters between a pattern's last word and the identifier.
GAP = 4
#: Different identifiers that a pattern needs before it.
SUPPORT = 3
TRUSTED = 0.7
ROUNDS = 3
#: No pattern vouches for a candidate altogether.
SUREST = 0.999
FILTER_BITS = 24

Span = tuple[int, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _left(text: str, at: int, floor: int) -> int:
    """Where the run of mailbox characters before ``at`` begins, not before ``floor``."""
    while at > floor and text[at - 1] in LOCAL:
        at -= 1
    return at


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a mailbox run holds no at sign, so each at sign has one place where its match can begin."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = _left(text, at, end)
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches lie in the maximal runs of dotted numbers, four parts at a time."""
    for run in DOTTED.finditer(text):
        if run[0].count(".") < IP_PARTS - 1:
            continue
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - IP_PARTS + 1, IP_PARTS):
            own = parts[i : i + IP_PARTS]
            size = len(".".join(own))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_MOST for p in own):
                yield at, at + size
            at += size + 1


def base_spans(text: str, numbers: bool = True) -> list[Span]:
    """``start, kind, end`` of the fixed patterns, leftmost and not overlapping within a kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, EMAIL_KIND, b) for a, b in emails(text)]
    if numbers:
        found += [(a, IP_KIND, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= CARD_DIGITS[0]:
                digits = _digits(m[0])
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    found.append((m.start(), CARD_KIND, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]:
                    found.append((m.start(), PHONE_KIND, m.end()))
    return sorted(found)


def candidates(text: str, known: list[Span], numbers: bool = True) -> list[tuple[int, int, list[int]]]:
    """``start, end, kinds`` of what may be an identifier of one of the kinds, clear of the known spans."""
    found: list[tuple[int, int, list[int]]] = []
    if numbers:
        for m in NUMBER.finditer(text):
            n = len(_digits(m[0]))
            fits = [k for k, (a, b) in ((CARD_KIND, LIKE_CARD), (PHONE_KIND, LIKE_PHONE)) if a <= n <= b]
            if fits:
                found.append((m.start(), m.end(), fits))
    if "@" in text or "at" in text:
        marks = [(m.start(), m.end()) for m in re.finditer("@", text)] + [m.span() for m in SPELT.finditer(text)]
        floor = 0
        for at, after in sorted(marks):
            begin = _left(text, at, floor)
            host = HOST.match(text, after) if begin < at else None
            if host:
                found.append((begin, host.end(), [EMAIL_KIND]))
                floor = host.end()
    if ":" in text:
        for m in COLONS.finditer(text):
            parts = m[0].split(":")
            if len(parts) >= 4 and all(len(p) <= 4 for p in parts) and len(parts) <= 8:
                found.append((m.start(), m.end(), [IP_KIND]))
    if not known:
        return found
    known = sorted((a, b) for a, _, b in known)
    ends = np.maximum.accumulate([b for _, b in known])
    out = []
    for a, b, fits in found:
        i = bisect_right(known, (b - 1, len(text) + 1))  # the known spans that begin before the end
        if not i or ends[i - 1] <= a:
            out.append((a, b, fits))
    return out


def words(texts: pa.Array) -> Words:
    """Runs of letters of each text, A to Z folded."""
    data, offsets = utf8(texts)
    inside = IS_LETTER[data]
    starts, ends = runs(inside, offsets)
    return Words(np.where(inside, LOWER[data], np.uint8(32)), offsets, starts, ends, np.searchsorted(starts, offsets))


def pattern_keys(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per word the key of it alone and of it with the one before it (0: the first of its text), as 64-bit hashes."""
    own = found.hashes(21)
    one = mix(own + np.uint64(BYTE_STEP))
    two = np.zeros(len(own), dtype=np.uint64)
    two[1:] = mix(own[:-1] * np.uint64(WORD_STEP) + own[1:])
    two[found.first[:-1][np.diff(found.first) > 0]] = 0
    return one, two


def contexts(text: str, starts: list[int]) -> list[str]:
    """The last two words before each start (or the only one), if the last is near enough; else an empty text."""
    if not starts:
        return []
    at = [m.span() for m in LETTERS.finditer(text)]
    ends = [e for _, e in at]
    out = []
    for s in starts:
        i = bisect_right(ends, s) - 1
        near = i >= 0 and s - ends[i] <= GAP and not any("0" <= c <= "9" for c in text[ends[i] : s])
        out.append(" ".join(text[a:b] for a, b in at[max(i - 1, 0) : i + 1]) if near else "")
    return out


FIND = "struct<start: long, end: long, kind: int, fits: array<int>, name: string, patterns: array<long>>"
FOUND = f"line long, doc_id long, spans array<struct<kind: int, start: long, end: long>>, finds array<{FIND}>"
FIND_TYPE = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("fits", pa.list_(pa.int32())),
            ("name", pa.string()), ("patterns", pa.list_(pa.int64())),
        ]
    )
)
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def named(text: str, kind: int) -> str:
    """One name for all spellings of an identifier."""
    if kind in (CARD_KIND, PHONE_KIND):
        return _digits(text)
    return SPELT.sub("@", text.lower())


def _find(batch: pa.RecordBatch) -> dict:
    texts = column(batch, "text")
    data, offsets = utf8(texts)
    digit = (data >= ord("0")) & (data <= ord("9"))
    sums = np.concatenate(([0], np.cumsum(digit)))[offsets]
    spans, finds, said = [], [], []
    for text, n in zip(texts.to_pylist(), np.diff(sums).tolist(), strict=True):
        if not text:
            spans.append([])
            finds.append([])
            continue
        base = base_spans(text, n >= IP_PARTS)
        more = candidates(text, base, n >= LIKE_PHONE[0])
        spans.append([{"kind": k, "start": a, "end": b} for a, k, b in base])
        all_of = [(a, b, k, [k], named(text[a:b], k)) for a, k, b in base]
        all_of += [(a, b, -1, fits, named(text[a:b], fits[0])) for a, b, fits in more]
        said += contexts(text, [f[0] for f in all_of])
        finds.append([{"start": a, "end": b, "kind": k, "fits": fits, "name": name} for a, b, k, fits, name in all_of])
    found = words(pa.array(said, pa.string()))
    one, two = (x.view(np.int64) for x in pattern_keys(found))
    last = found.first[1:] - 1
    held = np.diff(found.first)
    i = 0
    for row in finds:
        for f in row:
            f["patterns"] = [int(one[last[i]])] + ([int(two[last[i]])] if held[i] > 1 else []) if held[i] else []
            i += 1
    return {
        "line": column(batch, "line"), "doc_id": column(batch, "doc_id"),
        "spans": pa.array(spans, SPAN_TYPE), "finds": pa.array(finds, FIND_TYPE),
    }


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's set bits, as pairs of a 64-bit cell and its bits."""
    cells = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for batch in batches:
        keys = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        np.bitwise_or.at(cells, (keys >> np.uint64(6)).astype(np.int64), np.uint64(1) << (keys & np.uint64(63)))
    full = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(cells[full].view(np.int64))], names=["cell", "bits"])


def uses(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, uses``: how often each of ``patterns`` stands in the texts, whatever follows it."""
    # at most 2**18 rows, whatever the number of patterns
    bits = patterns.select("pattern").mapInArrow(_bits, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    cells[bits.column("cell").to_numpy()] = bits.column("bits").to_numpy()
    cells = cells.view(np.uint64)

    def count(batch: pa.RecordBatch) -> dict:
        keys = np.concatenate(pattern_keys(words(column(batch, "text"))))
        top = keys >> np.uint64(64 - FILTER_BITS)
        maybe = (cells[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1)
        pattern, n = np.unique(keys[maybe > 0], return_counts=True)
        return {"pattern": pattern.view(np.int64), "n": n}

    counted = by_batch(texts, "pattern long, n long", count).groupBy("pattern").agg(F.sum("n").alias("uses"))
    return counted.join(patterns.select("pattern"), "pattern", "left_semi")


def scored(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confidences of patterns (``pattern, kind, confidence``) and of candidates (``name, kind, confidence``).

    ``edges`` has ``pattern, name, kind`` (-1: a candidate), ``fits``, ``n`` (occurrences) and ``uses`` (of the pattern).
    """
    seeds = edges.where("kind >= 0").select("name", "kind").distinct().withColumn("confidence", F.lit(1.0))
    seeds = materialize(seeds, "seeds")
    # a candidate that is spelt as a seed elsewhere counts as one from the start
    links = materialize(edges.groupBy("pattern", "uses", "name").agg(F.sum("n").alias("n")), "links")
    open_ = edges.where("kind < 0").select("pattern", "name", F.explode("fits").alias("kind")).distinct()
    open_ = materialize(open_.join(seeds, ["name", "kind"], "left_anti"), "open")
    certain = seeds
    patterns = found = None
    for _ in range(rounds):
        told = links.join(certain, "name")
        share = F.least(F.sum(F.col("n") * F.col("confidence")) / F.max("uses"), F.lit(SUREST))
        support = F.sum((F.col("confidence") >= TRUSTED).cast("int")).alias("support")
        patterns = told.groupBy("pattern", "kind").agg(share.alias("confidence"), support)
        patterns = materialize(patterns.where((F.col("confidence") >= TRUSTED) & (F.col("support") >= SUPPORT)), "patterns")
        doubt = open_.join(patterns.select("pattern", "kind", "confidence"), ["pattern", "kind"])
        found = doubt.groupBy("name", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("confidence"))
        found = materialize(found, "candidates")
        certain = seeds.unionByName(found)
    return patterns.drop("support"), found


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for each row of ``docs``: ``spans`` by start, then kind as listed in ``KINDS``.

    Places are code points, ends exclusive; ``context`` marks what only its context gives away, clear of the others.
    Null and empty texts have no spans. Repeated rows, and rows that share an id, are searched each by itself; a row
    without an id too. Whole texts count, however long: each fixed pattern takes time in proportion to
    the text. Other columns are ignored, whatever their names; an empty table gives none.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(by_batch(texts.withColumn("line", F.monotonically_increasing_id()), FOUND, _find), "found")

    finds = found.select("line", F.explode("finds").alias("f")).select("line", "f.*")
    edges = finds.select("name", "kind", "fits", F.explode("patterns").alias("pattern"))
    # each (pattern, name, kind) once: how often it occurs
    edges = materialize(edges.groupBy("pattern", "name", "kind").agg(F.count("*").alias("n"), F.first("fits").alias("fits")), "edges")
    names = edges.select("pattern", "name").distinct().groupBy("pattern").agg(F.count("*").alias("support"))
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    patterns = materialize(names.where(F.col("support") >= SUPPORT).join(total, "pattern"), "induced")
    used = uses(texts.select("text"), patterns).join(patterns.select("pattern", "total"), "pattern")
    # a pattern cannot be trusted where too few of its uses are followed by anything like an identifier
    used = materialize(used.where(F.col("total") >= TRUSTED * F.col("uses")), "uses")
    graph = materialize(edges.join(used.select("pattern", "uses"), "pattern"), "graph")
    _, trusted = scored(graph)
    trusted = materialize(trusted.where(F.col("confidence") >= TRUSTED).select("name", "kind").distinct(), "trusted")

    open_ = finds.where("kind < 0").select("line", "start", "end", "name", F.explode("fits").alias("kind"))
    more = open_.join(trusted, ["name", "kind"], "left_semi").select("line", "start", "end").distinct()
    span = F.struct(F.lit(CONTEXT).alias("kind"), F.col("start"), F.col("end"))
    more = more.groupBy("line").agg(F.collect_list(span).alias("more"))
    out = found.select("line", "doc_id", "spans").join(more, "line", "left")
    every = F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind: int, start: long, end: long>>")))
    every = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("k"), s["end"].alias("end"))))

    def spelt(s: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1)
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    return out.select("doc_id", F.transform(every, spelt).alias("spans"))
