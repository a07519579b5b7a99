"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other.

Good is a document labelled of quality 1 and not toxic. Each view is a logistic regression: hashed words and
document statistics of the whole text, and source, language, their pair and the document's length. In each
round both score all unlabelled documents, and each hands its most confident labels to the other, whose fit then
goes on with them. A held-out part of the labelled rows calibrates both views and weighs them in the joint score.

The driver holds at most ``MAX_LABELLED`` labelled documents, those with the lowest hash of their id. The unlabelled
ones stay in Spark, all of them: their views are written once, beside those of the labelled, the confident share is found from a histogram of
their scores, and the gradients of the handed rows are summed per place. Sums are of whole numbers, so they do not
depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.quality import statistics
from batchkeeper.llm.text import by_batch, column, mix, prepare, table, words
from batchkeeper.session import materialize, new_scratch

MAX_LABELLED = 8_000
ROUNDS = 4
#: Share of the unlabelled documents that a view labels in a round, in the proportion of good and bad among the labelled.
HANDED = 0.05
CONFIDENT = 0.9
WORD_PLACES = 1 << 18
#: A word counts from so many labelled documents on.
LEAST_DOCS = 3
META_PLACES = 1 << 9
CALIBRATION = 5  # every fifth labelled document
STEPS = 120
#: Steps of a round, each a pass over the handed rows; a round goes on from the weights before it.
ROUND_STEPS = 10
RIDGE = 1e-4
#: Cells of the histogram: log odds beyond ``CONFIDENT`` in steps of 1/64, and in these by a hash, for equal scores.
BINS, TIES = 1 << 10, 1 << 6
CELLS = BINS * TIES
#: Gradients are summed in whole multiples of 1 / SCALE.
SCALE = 1 << 24
FAR = (1 << 16) - 1


@dataclass
class Sparse:
    """Rows of a sparse matrix: row i has ``places[first[i]:first[i + 1]]`` with their values."""

    places: np.ndarray
    values: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        first = np.concatenate(([0], np.cumsum([len(p) for p, _ in rows]))).astype(np.int64)
        empty = np.zeros(0)
        return cls(
            np.concatenate([empty.astype(np.int64), *[p for p, _ in rows]]),
            np.concatenate([empty, *[v for _, v in rows]]), first,
        )

    def take(self, rows: np.ndarray) -> Sparse:
        return Sparse.of([(self.places[self.first[i] : self.first[i + 1]], self.values[self.first[i] : self.first[i + 1]]) for i in rows])

    def within(self, known: np.ndarray) -> Sparse:
        """Only the places that ``known`` marks."""
        keep = known[self.places]
        kept = np.concatenate(([0], np.cumsum(keep)))
        return Sparse(self.places[keep], self.values[keep], kept[self.first])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.values * weights[self.places])))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.places, self.values * np.repeat(errors, np.diff(self.first)), size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Fit:
    """Full-batch Adam steps, which later rows can carry on; rows carry a constant feature as their intercept."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    t: int = 0

    @classmethod
    def new(cls, size: int) -> Fit:
        return cls(np.zeros(size), np.zeros(size), np.zeros(size))

    def step(self, gradient: np.ndarray, ridge: float) -> None:
        g = gradient + ridge * self.w
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        self.w = self.w - 0.15 * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def logistic(x: Sparse, y: np.ndarray, size: int, ridge: float = RIDGE) -> Fit:
    fit = Fit.new(size)
    for _ in range(STEPS):
        fit.step(x.back(sigmoid(x.dot(fit.w)) - y, size) / len(y), ridge)
    return fit


TEXT_SIZE = WORD_PLACES + 16
META_SIZE = META_PLACES + 2


def text_view(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashed words, the statistics, and the constant."""
    found = words(texts, lower=True)
    places = (found.hashes() >> np.uint64(64 - 18)).astype(np.int64)
    stats = statistics(texts)["features"]
    stats[:, 0] /= 10  # log of the words, and word length and words a line, to the scale of the shares
    stats[:, 1] /= 20
    stats[:, -1] = np.log1p(stats[:, -1]) / 10
    rows = []
    extra = np.concatenate((WORD_PLACES + np.arange(stats.shape[1]), [TEXT_SIZE - 1]))
    for i in range(len(texts)):
        own = np.unique(places[found.first[i] : found.first[i + 1]])
        rows.append((np.concatenate((own, extra)), np.concatenate((np.full(len(own), 0.5), 4 * stats[i], [1.0]))))
    return rows


def _place(value: str) -> int:
    data = np.frombuffer(value.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = (table(7)[data] * mix(np.arange(1, len(data) + 1, dtype=np.uint64))).sum(dtype=np.uint64)
    return int(mix(np.array([total], dtype=np.uint64))[0] % np.uint64(META_PLACES))


def metadata_view(lang: list, source: list, n_chars: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Source, language, source with language, and the record's length as classes and as a number."""
    rows = []
    for a, b, n in zip(lang, source, n_chars, strict=True):
        size = np.log2(max(n or 0, 0) + 1)
        marks = [f"lang={a}", f"source={b}", f"both={a},{b}", f"size={int(size)}"]
        rows.append((np.array([*map(_place, marks), META_PLACES, META_PLACES + 1]), np.array([1.0, 1.0, 1.0, 1.0, size / 10, 1.0])))
    return rows


@dataclass
class Entries:
    """A sparse matrix by entries; sums of a row do not depend on the rows beside it."""

    rows: np.ndarray
    places: np.ndarray
    values: np.ndarray
    n: int

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.places], self.n)

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.places, np.rint(self.values * errors[self.rows] * SCALE), size)


@dataclass
class Vocabulary:
    """The words that count, numbered anew, and how both views of a document are written."""

    often: np.ndarray  # marks places of the text view; those behind the words are always marked

    @property
    def n_words(self) -> int:
        return int(self.often[:WORD_PLACES].sum())

    def write(self, text: list[tuple[np.ndarray, np.ndarray]], meta: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        number = np.cumsum(self.often) - 1
        known = [p[self.often[p] & (p < WORD_PLACES)] for p, _ in text]
        return {
            "words": pa.array([_steps(number[p]).tobytes() for p in known], pa.binary()),
            "stats": pa.array([v[p >= WORD_PLACES].astype("<f4").tobytes() for p, v in text], pa.binary()),
            "marks": pa.array([p.astype("<u4").tobytes() for p, _ in meta], pa.binary()),
            "sizes": pa.array([v.astype("<f4").tobytes() for _, v in meta], pa.binary()),
        }

    def read(self, batch: pa.RecordBatch) -> tuple[Entries, Entries]:
        n = batch.num_rows
        steps, each = _numbers(column(batch, "words"), "<u2")
        sums = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
        full = steps < FAR
        words = (sums[1:] - np.repeat(sums[np.cumsum(each) - each], each))[full]
        each = np.bincount(np.repeat(np.arange(n), each)[full], minlength=n)
        stats, wide = _numbers(column(batch, "stats"), "<f4")
        # the last of a row's is the constant, at the last place of the view
        k = int(wide.max()) if n else 0
        behind = self.n_words + np.append(np.arange(k - 1), TEXT_SIZE - WORD_PLACES - 1)
        full = np.flatnonzero(wide)
        text = Entries(
            np.concatenate((np.repeat(np.arange(n), each), np.repeat(full, k))),
            np.concatenate((words, np.tile(behind, len(full)) if k else words[:0])),
            np.concatenate((np.full(len(words), 0.5), stats.astype(np.float64))), n,
        )
        marks, each = _numbers(column(batch, "marks"), "<u4")
        sizes, _ = _numbers(column(batch, "sizes"), "<f4")
        return text, Entries(np.repeat(np.arange(n), each), marks.astype(np.int64), sizes.astype(np.float64), n)


VIEWS = "words binary, stats binary, marks binary, sizes binary"


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Ascending numbers in two bytes each: the distance from the one before, a long one after as many ``FAR`` as it holds."""
    far, rest = np.divmod(np.diff(numbers, prepend=0), FAR)
    out = np.full(len(numbers) + int(far.sum()), FAR, dtype="<u2")
    out[np.arange(len(numbers)) + np.cumsum(far)] = rest
    return out


def _numbers(cells: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the cells in a row, and how many each cell has."""
    found = [c or b"" for c in cells.to_pylist()]
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(found), dtype=kind), np.array([len(c) // width for c in found], dtype=np.int64)


@dataclass
class Turn:
    """One round: both views' weights, and by learner and label the lowest cell that is handed over."""

    text: np.ndarray
    meta: np.ndarray
    least: np.ndarray


def cells(z: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and cell of each score, the surest highest; -1 where it is not confident."""
    over = np.abs(z) - np.log(CONFIDENT / (1 - CONFIDENT))
    bins = np.minimum(over * 64, BINS - 1).astype(np.int64)
    return (z > 0).astype(np.int64), np.where(over >= 0, bins * TIES + tie, -1)


def told(text: Entries, meta: Entries, tie: np.ndarray, turns: list[Turn]) -> np.ndarray:
    """What the text view (row 0) and the metadata view (row 1) were told of each document; -1 for nothing."""
    out = np.full((2, text.n), -1)
    for turn in turns:
        for learner, z in ((1, text.dot(turn.text)), (0, meta.dot(turn.meta))):
            label, cell = cells(z, tie)
            new = (out[learner] < 0) & (cell >= 0) & (cell >= turn.least[learner][label])
            out[learner][new] = label[new]
    return out


def summed(df: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``add`` over all batches: whole numbers by place, within tasks and then in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(batch)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places].astype(np.int64))], names=["place", "n"])

    found = df.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


def exchange(pool: DataFrame, known: Vocabulary, text: Sparse, meta: Sparse, y: np.ndarray, by_text: Fit, by_meta: Fit) -> None:
    """The rounds: both fits go on with what they are told of ``pool``, which has ``tie`` and the written views."""
    spark, size = pool.sparkSession, pool.count()
    width = known.n_words + TEXT_SIZE - WORD_PLACES
    turns: list[Turn] = []
    paths: list[str] = []
    for _ in range(ROUNDS if size else 0):
        turn = Turn(by_text.w[known.often], by_meta.w.copy(), np.zeros((2, 2), dtype=np.int64))
        before, upto = list(turns), [*turns, turn]

        def count(batch: pa.RecordBatch, turn: Turn = turn, before: list[Turn] = before) -> np.ndarray:
            a, b = known.read(batch)
            tie = column(batch, "tie").to_numpy()
            had = told(a, b, tie, before)
            out = np.zeros(4 * CELLS)
            for learner, z in ((1, a.dot(turn.text)), (0, b.dot(turn.meta))):
                label, cell = cells(z, tie)
                free = (had[learner] < 0) & (cell >= 0)
                out += np.bincount((2 * learner + label[free]) * CELLS + cell[free], minlength=4 * CELLS)
            return out

        found = summed(pool, count, 4 * CELLS).reshape(2, 2, CELLS)
        for learner in (0, 1):
            for label in (0, 1):
                want = np.ceil(HANDED * size * (y.mean() if label else 1 - y.mean()))
                reached = np.flatnonzero(np.cumsum(found[learner][label][::-1]) >= want)
                turn.least[learner][label] = CELLS - 1 - reached[0] if len(reached) else 0

        def handed(batch: pa.RecordBatch, before: list[Turn] = before, upto: list[Turn] = upto) -> dict | None:
            a, b = known.read(batch)
            tie = column(batch, "tie").to_numpy()
            now = np.where(told(a, b, tie, before) < 0, told(a, b, tie, upto), -1)
            rows = np.flatnonzero(now.max(axis=0) >= 0)
            if not len(rows):
                return None
            out = {"told_text": now[0][rows], "told_meta": now[1][rows]}
            for learner, names in enumerate((("words", "stats"), ("marks", "sizes"))):
                for name in names:  # a row has only the views that it teaches
                    values = column(batch, name).take(pa.array(rows)).to_pylist()
                    out[name] = pa.array([v if t >= 0 else b"" for v, t in zip(values, now[learner][rows], strict=True)], pa.binary())
            return out

        schema = f"told_text long, told_meta long, {VIEWS}"
        paths.append(new_scratch(spark, "handed"))
        by_batch(pool, schema, handed).write.option("compression", "zstd").parquet(paths[-1])
        turns.append(turn)
        rows = spark.read.schema(schema).parquet(*paths)
        for _ in range(ROUND_STEPS):

            def gradient(batch: pa.RecordBatch, w: np.ndarray = by_text.w[known.often], u: np.ndarray = by_meta.w) -> np.ndarray:
                a, b = known.read(batch)
                parts, numbers = [], []
                for x, weights, name in ((a, w, "told_text"), (b, u, "told_meta")):
                    label = column(batch, name).to_numpy()
                    parts.append(x.back(np.where(label >= 0, sigmoid(x.dot(weights)) - label, 0.0), len(weights)))
                    numbers.append((label >= 0).sum())
                return np.concatenate((*parts, numbers))

            total = summed(rows, gradient, width + META_SIZE + 2)
            more = np.zeros(TEXT_SIZE)
            more[known.often] = total[:width] / SCALE
            n = len(y) + total[-2:]
            by_text.step((text.back(sigmoid(text.dot(by_text.w)) - y, TEXT_SIZE) + more) / n[0], RIDGE)
            by_meta.step((meta.back(sigmoid(meta.dot(by_meta.w)) - y, META_SIZE) + total[width:-2] / SCALE) / n[1], RIDGE)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, text_score, metadata_score, kept`` for each row of ``docs``.

    ``docs`` has ``lang``, ``source`` and ``n_chars``, any of them null; ``labels`` has the id, ``quality`` and
    ``toxic`` (null: 0). Rows of ``labels`` with a null id or quality teach nothing. ``score`` is the probability
    of a good document, ``kept`` whether it is one half or more; the views' scores are before calibration. Null
    and empty texts are scored as empty ones. Without labels of both kinds scores are null, and all rows kept.
    Rows that share an id are scored each by its own text; an empty table gives none. Whole texts count, however long;
    other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    known = known.select(F.col(id_col).cast("long").alias("doc_id"), good.cast("double").alias("y"))
    # as a table its size is known: ids that fit a broadcast meet the views without a shuffle of these
    known = materialize(known.groupBy("doc_id").agg(F.min("y").alias("y")), "labelled")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.join(source.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(MAX_LABELLED)
    # a table of at most MAX_LABELLED rows
    sample = materialize(chosen, "sample")

    def views(batch: pa.RecordBatch) -> tuple[list, list]:
        meta = metadata_view(*(column(batch, c).to_pylist() for c in ("lang", "source", "n_chars")))
        return text_view(column(batch, "text")), meta

    def describe(batch: pa.RecordBatch) -> dict:
        text, meta = views(batch)
        ints, reals = pa.list_(pa.int64()), pa.list_(pa.float64())
        return {
            "doc_id": column(batch, "doc_id"), "y": column(batch, "y"),
            "tp": pa.array([p for p, _ in text], ints), "tv": pa.array([v for _, v in text], reals),
            "mp": pa.array([p for p, _ in meta], ints), "mv": pa.array([v for _, v in meta], reals),
        }

    schema = "doc_id long, y double, tp array<long>, tv array<double>, mp array<long>, mv array<double>"
    taught = by_batch(source.join(sample, "doc_id"), schema, describe)
    taught = taught.dropDuplicates(["doc_id"]).orderBy(*order).toArrow()

    def sparse(rows: pa.Table, places: str, values: str) -> Sparse:
        pairs = zip(rows.column(places).to_numpy(), rows.column(values).to_numpy(), strict=True)
        return Sparse.of([(np.asarray(p, dtype=np.int64), np.asarray(v)) for p, v in pairs])

    y = taught.column("y").to_numpy()
    text, meta = sparse(taught, "tp", "tv"), sparse(taught, "mp", "mv")
    rest = np.arange(len(y)) % CALIBRATION == 0
    if len(y) < 2 or y.min() == y.max() or y[~rest].min() == y[~rest].max():
        nothing = (F.lit(None).cast("double").alias(c) for c in ("score", "text_score", "metadata_score"))
        return source.select("doc_id", *nothing, F.lit(True).alias("kept"))
    fitting, held = np.flatnonzero(~rest), np.flatnonzero(rest)
    # words of a document or two would only be learned by heart
    vocabulary = Vocabulary(np.bincount(text.take(fitting).places, minlength=TEXT_SIZE) >= LEAST_DOCS)
    vocabulary.often[WORD_PLACES:] = True
    text_fit, meta_fit = text.take(fitting).within(vocabulary.often), meta.take(fitting)
    by_text, by_meta = logistic(text_fit, y[fitting], TEXT_SIZE), logistic(meta_fit, y[fitting], META_SIZE)

    def written(batch: pa.RecordBatch) -> dict:
        return {"doc_id": column(batch, "doc_id"), "tie": column(batch, "tie")} | vocabulary.write(*views(batch))

    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 58)
    described = by_batch(source.withColumn("tie", tie), f"doc_id long, tie long, {VIEWS}", written)
    flagged = described.join(known.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    flagged = flagged.withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    # the views of all rows, once; a folder for those without a label
    path = new_scratch(docs.sparkSession, "views")
    flagged.write.option("compression", "zstd").partitionBy("labelled").parquet(path)
    described = docs.sparkSession.read.schema(flagged.schema).parquet(path)
    pool = described.where(~F.col("labelled")).drop("doc_id", "labelled")
    exchange(pool, vocabulary, text_fit, meta_fit, y[fitting], by_text, by_meta)

    a, b, target = text.take(held).dot(by_text.w), meta.take(held).dot(by_meta.w), y[held]
    joint = np.array([1.0, 0.0, 0.0])
    if len(target) and target.min() < target.max():
        both = Sparse.of([(np.arange(3), np.array([p, q, 1.0])) for p, q in zip(a, b, strict=True)])
        joint = logistic(both, target, 3, 1e-3).w
    w, u = by_text.w[vocabulary.often], by_meta.w

    def rows(batch: pa.RecordBatch) -> dict:
        a, b = (x.dot(v) for x, v in zip(vocabulary.read(batch), (w, u), strict=True))
        score = sigmoid(joint[0] * a + joint[1] * b + joint[2])
        return {
            "doc_id": column(batch, "doc_id"), "score": score, "text_score": sigmoid(a), "metadata_score": sigmoid(b),
            "kept": pa.array(score >= 0.5),
        }

    return by_batch(described, "doc_id long, score double, text_score double, metadata_score double, kept boolean", rows)
