"""Language of texts as a mixture: each document's language proportions by expectation-maximisation.

A model is the frequency of letter trigrams (hashed to 32,768 places; word borders count as a letter) per language,
counted over all training documents. A document is taken as drawn from a mixture of these models; EM finds the
proportions. Its language set grows from the likeliest language on, in order of proportion, while the
likelihood of the smaller mixture, less a charge for each language, still rises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.text import by_batch, column, mix, prepare

PLACES = 1 << 15
STEPS, SET_STEPS = 15, 8
SMOOTH = 0.5
#: What a further language must add to the log-likelihood, times log(trigrams): trigrams overlap threefold.
CHARGE = 3 * 0.5
UNKNOWN = "und"
FOLDS = 5
#: Trigrams times languages held at once.
CHUNK = 1 << 22

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every letter of every text the place of it and its neighbours, and where each text's places begin."""
    plain = [(t or "").lower() + "\n" for t in texts]
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in plain])
    letter = letters()[points]
    code = np.where(letter, points, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    # every text ends in a line end, so neighbours never come from another text
    before = np.where(at > 0, code[at - 1], np.uint64(0))
    after = code[np.minimum(at + 1, len(code) - 1)]
    key = (before << np.uint64(42)) | (code[at] << np.uint64(21)) | after
    return (mix(key) >> np.uint64(64 - 15)).astype(np.int64), np.searchsorted(at, np.concatenate(([0], ends)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language, one set for each task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        places, first = trigrams(column(batch, "text").to_pylist())
        for i, lang in enumerate(column(batch, "lang").to_pylist()):
            own = totals.setdefault(lang, np.zeros(PLACES, dtype=np.int64))
            own += np.bincount(places[first[i] : first[i + 1]], minlength=PLACES)
    for lang, own in totals.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "place", "n"]
        )


def fit(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and, per place, each one's probability. The driver gets these counts only."""
    counts = training.mapInArrow(_counts, "lang string, place long, n long").groupBy("lang", "place")
    found = counts.agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(names)}
    table = np.full((PLACES, len(names)), SMOOTH)
    of = np.array([number[lang] for lang in found.column("lang").to_pylist()], dtype=np.int64)
    table[found.column("place").to_numpy(), of] += found.column("n").to_numpy()
    return names, table / table.sum(axis=0)


def _mixture(p: np.ndarray, n: np.ndarray, start: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some EM steps, and each document's log-likelihood under them."""
    sizes = np.diff(np.append(start, len(n)))
    total = np.add.reduceat(n, start)
    for step in range(steps + 1):
        each = p * np.repeat(share, sizes, axis=0)
        whole = each.sum(axis=1)
        if step < steps:
            share = np.add.reduceat(each * (n / whole)[:, None], start, axis=0) / total[:, None]
    return share, np.add.reduceat(n * np.log(whole), start)


def proportions(places: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents that all have trigrams: proportions over all languages, and over each one's chosen set."""
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key, n = np.unique(docs * PLACES + places, return_counts=True)
    doc, n = key // PLACES, n.astype(np.float64)
    p = table[key % PLACES]
    start = np.searchsorted(doc, np.arange(len(first) - 1))
    sizes = np.diff(np.append(start, len(n)))
    langs = table.shape[1]
    full, _ = _mixture(p, n, start, np.full((len(start), langs), 1 / langs), STEPS)
    order = np.argsort(-full, axis=1, kind="stable")
    # the first set: the language under which the document is likeliest
    alone = np.add.reduceat(n[:, None] * np.log(p), start, axis=0)
    likeliest = alone.argmax(axis=1)
    order = np.array([[b, *[x for x in o if x != b]] for b, o in zip(likeliest, order, strict=True)]).reshape(len(start), langs)
    rows = np.arange(len(start))
    best = alone[rows, likeliest]
    chosen = np.zeros_like(full)
    chosen[rows, likeliest] = 1
    open_ = rows
    for k in range(2, langs + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        begin = allowed * np.maximum(full[open_], 1e-3)
        begin /= begin.sum(axis=1, keepdims=True)
        part = np.isin(doc, open_)
        at = np.cumsum(np.concatenate(([0], sizes[open_][:-1])))
        share, value = _mixture(p[part], n[part], at, begin, SET_STEPS)
        value = value - CHARGE * (k - 1) * np.log(np.add.reduceat(n[part], at))
        better = value > best[open_] + 1e-9
        best[open_[better]] = value[better]
        chosen[open_[better]] = share[better]
        open_ = open_[better]
    return full, chosen


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages, shares`` for each row of ``docs``.

    Learned from all rows whose crc32 of the id, as text, is no multiple of 5, and whose language is not null;
    the others, and rows without an id, teach nothing (``held_out`` is false for these). ``lang_pred`` has the
    largest proportion in the chosen set, ``score`` is its proportion among all languages, and the last two
    columns are the set. A null text, or one without a letter, is ``und`` with the score 0 and an empty set; so is
    every text if there is nothing to learn from. Rows that share an id are judged apart. Other columns are
    ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS
    names, table = fit(source.where((fold != 0) & F.col("lang").isNotNull()).select("text", "lang"))

    def rows(batch: pa.RecordBatch) -> dict:
        texts = column(batch, "text").to_pylist()
        places, first = trigrams(texts)
        pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        sets: list[list[str]] = [[] for _ in texts]
        shares: list[list[float]] = [[] for _ in texts]
        some = np.flatnonzero(np.diff(first)) if names else np.zeros(0, dtype=np.int64)
        upto = np.cumsum((first[1:] - first[:-1])[some]) * len(names) // CHUNK
        for part in (some[upto == c] for c in np.unique(upto)):
            own = np.concatenate([places[first[i] : first[i + 1]] for i in part])
            borders = np.concatenate(([0], np.cumsum((first[1:] - first[:-1])[part])))
            full, chosen = proportions(own, borders, table)
            for i, f, c in zip(part, full, chosen, strict=True):
                top = int(c.argmax())
                pred[i], score[i] = names[top], min(1.0, f[top])
                members = np.flatnonzero(c)
                members = members[np.argsort(-c[members], kind="stable")]
                sets[i], shares[i] = [names[m] for m in members], c[members].tolist()
        return {
            "doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "lang_pred": pa.array(pred, pa.string()),
            "score": score, "languages": pa.array(sets, pa.list_(pa.string())), "shares": pa.array(shares, pa.list_(pa.float64())),
        }

    held = F.coalesce(fold == 0, F.lit(False))
    schema = (
        "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
    )
    return by_batch(source.select("doc_id", "text", held.alias("held_out")), schema, rows)
