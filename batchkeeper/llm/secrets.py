"""Secrets in texts: three fixed patterns, and windows of high entropy per character class.

The fixed patterns (assigned passwords and tokens, access keys, long hexadecimal strings) are always reported.
Beyond them, every run of hexadecimal or of base-64 characters is a candidate: a window of 20 characters slides
over it, and its Shannon entropy follows from counts that change by one character in and one out. Windows that
reach their class's limit merge into a span. Allow-listed strings (addresses, UUIDs, plain words, placeholders)
are suppressed, fixed patterns never. Of an address only host and path are allowed: not the user's part before
the host, not a query, and nothing of an address that names a hook, as those paths are credentials. A placeholder
allows the candidate that holds it, and nothing beside it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchkeeper.llm.text import by_batch, column, prepare, runs, utf8

# fixed values: the patterns of the base, and how long a match must be to count
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_CHARS = 8
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 16
HEX = re.compile(r"[0-9a-f]+")
HEX_CHARS = 32
KINDS = ("assign", "access", "hex", "entropy")
REPLACEMENT = "[secret]"

WINDOW = 20
#: Bits a character in a window. 20 random hexadecimal digits have about 3.4, 20 random base-64 ones about 4.1;
#: 20 letters of running words stay under 3.6.
CLASSES = {"hex": (re.compile(r"[0-9a-fA-F]+"), 3.0), "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 3.8)}
# what no address holds, and where its host and path end
_NO_USER = r"""\s"'`,;<>()\[\]{}|\\^/?#@"""
_PATH = r"""[^\s"'`,;<>()\[\]{}|\\^?#&]*"""
_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]{0,30}:"
#: Strings that look random and are no secret: a candidate inside one of them, or inside its group, is suppressed.
ALLOWED = (
    re.compile(rf"{_SCHEME}(//(?![^{_NO_USER}]*@)(?!{_PATH}(?i:hook)){_PATH})"),  # addresses of pages
    re.compile(rf"{_SCHEME}//[^{_NO_USER}]+@(?!{_PATH}(?i:hook))({_PATH})"),  # and of those with a user's part
    # addresses of people; behind : or / it may be the user's part of an address of a page
    re.compile(r"(?:(?<=mailto:)|(?<![A-Za-z0-9._%+:/-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"),
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[A-Za-z]+(?:[-_/=+][A-Za-z]+)*"),  # words and words joined by marks
    re.compile(r"[0-9]+(?:[-_/=+.][0-9]+)*"),  # numbers and dates
    # placeholders, with a short name before them
    re.compile(
        r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z_-]{1,19}=)?(?=[A-Za-z0-9+/_-]*(?:EXAMPLE|example|0123456789|abcdefgh|ABCDEFGH))[A-Za-z0-9+/_-]+=*"
    ),
)

IS_CANDIDATE = np.zeros(256, dtype=bool)
IS_CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

Span = tuple[int, int, int]
_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def entropy_windows(text: str, limit: float, size: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy reaches ``limit`` bits a character."""
    if len(text) < size:
        return []
    counts: dict[str, int] = {}
    total = 0.0  # the sum of n * log2(n) over the counts; the entropy is log2(size) - total / size
    out: list[tuple[int, int]] = []
    most = (math.log2(size) - limit) * size + 1e-9
    for i, c in enumerate(text):
        if i >= size:
            gone = text[i - size]
            n = counts[gone]
            counts[gone] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i >= size - 1 and total <= most:
            if out and out[-1][1] >= i - size + 1:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - size + 1, i + 1))
    return out


def base_spans(text: str, assigned: bool = True, candidates: bool = True) -> list[Span]:
    """``start, kind, end`` of the fixed patterns, leftmost and not overlapping within a kind."""
    found: list[Span] = []
    if assigned:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if candidates:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_CHARS]
    return sorted(found)


def entropy_spans(text: str, known: list[Span], allowed: tuple[re.Pattern, ...] = ALLOWED) -> list[Span]:
    """Spans of high entropy that no known span holds and no allowed string explains."""
    found: set[tuple[int, int]] = set()
    for pattern, limit in CLASSES.values():
        for m in pattern.finditer(text):
            if m.end() - m.start() >= WINDOW:
                found |= {(m.start() + a, m.start() + b) for a, b in entropy_windows(m[0], limit)}
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    out = []
    end, spared = 0, []
    # of the known spans that begin at a place or before it, how far the longest reaches
    begins = sorted((s, e) for s, _, e in known)
    reach = list(accumulate((e for _, e in begins), max))
    for a, b in merged:
        before = bisect_right(begins, (a, len(text) + 1))
        if before and b <= reach[before - 1]:
            continue
        if a >= end:
            begin, end = a, b  # the whole string between white space, for the allow list
            while begin and not text[begin - 1].isspace():
                begin -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            spared = [[m.span(m.lastindex or 0) for m in p.finditer(text, begin, end)] for p in allowed]
        # of each pattern the last match that begins at the span or before it
        last = (x[i - 1] for x in spared if (i := bisect_right(x, (a, len(text) + 1))))
        if not any(b <= e for _, e in last):
            out.append((a, 3, b))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], REPLACEMENT]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _suspects(texts: pa.Array) -> np.ndarray:
    """Which texts have a run of candidate characters as long as the shortest pattern that needs one."""
    data, offsets = utf8(texts)
    starts, ends = runs(IS_CANDIDATE[data], offsets)
    long_ones = starts[ends - starts >= min(WINDOW, ACCESS_CHARS, HEX_CHARS)]
    return np.diff(np.searchsorted(long_ones, offsets)) > 0


def scan(texts: pa.Array) -> list[list[Span]]:
    """All spans of each text, by start and then kind; null is an empty text."""
    out = []
    for text, suspect in zip(texts.to_pylist(), _suspects(texts), strict=True):
        if not text:
            out.append([])
            continue
        folded = text.lower() if ":" in text or "=" in text else ""
        spans = base_spans(text, any(w in folded for w in ASSIGN_WORDS), bool(suspect))
        if suspect:
            spans = sorted(spans + entropy_spans(text, spans))
        out.append(spans)
    return out


SPAN = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
SPAN_FIELDS = [T.StructField("secret_spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())]
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans`` (by start, then kind as listed) and ``redacted`` (the text without them).

    Places are code points, ends exclusive. The kinds are assign, access, hex and entropy. Null and empty texts
    have no spans, and are returned as they are. Very long texts are scanned whole. Repeated rows and rows without an id
    are scanned each by itself; an empty table gives none. Columns of ``docs`` that bear the new names give way.
    """
    prepare(docs.sparkSession)
    source = docs.drop("secret_spans", "redacted").withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*source.schema, *SPAN_FIELDS])

    def rows(batch: pa.RecordBatch) -> dict:
        texts = column(batch, text_col)
        found = scan(texts)
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found]
        clean = [redacted(t, x) if x else t for t, x in zip(texts.to_pylist(), found, strict=True)]
        return {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {
            "secret_spans": pa.array(spans, SPAN_TYPE), "redacted": pa.array(clean, pa.string())
        }

    return by_batch(source, schema, rows)
