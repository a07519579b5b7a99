"""Words of whole batches of texts as numpy arrays, and 64-bit hashes of words and word windows.

A word is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``. In UTF-8 these six
are single bytes that occur in no other character, so words are found on the bytes.
Hashes wrap modulo 2**64 and depend on nothing but the bytes, on whatever executor they are computed.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from batchkeeper.session import configure

# fixed values: white space that parts words, and the odd multipliers of the hashes
SEPARATORS = b" \t\n\x0b\x0c\r"
BYTE_STEP = 0x9E3779B97F4A7C15
WORD_STEP = 0xD6E8FEB86659FD93

MASK = (1 << 64) - 1
SETTINGS = {
    # a batch holds at most so many texts and about so many bytes; a longer text is a batch of its own
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the corpus operators rely on; memory, cores and shuffle partitions stay with the cluster.

    Python workers get this package's sources from the driver, so nothing need be installed on executors.
    """
    configure(spark)
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if package.is_dir() and context.applicationId not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="sources-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(step: int, n: int) -> np.ndarray:
    """``step`` to the powers 0 to n - 1, modulo 2**64."""
    steps = np.full(max(n, 1), step & MASK, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def table(seed: int) -> np.ndarray:
    """256 fixed pseudo-random values, one for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_STEP) + np.uint64(seed))


IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """All words of a batch of texts: where they lie in ``data``, and ``first[i]:first[i + 1]`` are text i's."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lens = self.ends - self.starts
        inside = IS_WORD[self.data]
        word_bytes = self.data[inside]
        at = np.cumsum(lens) - lens
        place = np.arange(len(word_bytes), dtype=np.int64) - np.repeat(at, lens)
        values = table(seed)[word_bytes] * powers(BYTE_STEP, int(lens.max()))[place]
        return mix(np.add.reduceat(values, at) + lens.astype(np.uint64) * np.uint64(WORD_STEP))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each begins and the last ends; null is an empty text."""
    filled = texts.cast(pa.large_string()).fill_null("")
    _, ends, content = filled.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(content, dtype=np.uint8)[offsets[0] : offsets[-1]] if content else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values that stay within one text."""
    borders = offsets[(offsets > 0) & (offsets < len(inside))]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[borders] = inside[borders]
    stops[:-1] &= ~inside[1:]
    stops[borders - 1] = inside[borders - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; null is an empty text. ``lower`` folds A to Z, and no other letter."""
    data, offsets = utf8(texts)
    if lower:
        data = LOWER[data]
    starts, ends = runs(IS_WORD[data], offsets)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, n: int, step: int = WORD_STEP) -> np.ndarray:
    """A hash of each run of ``n`` consecutive values; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for j, power in enumerate(powers(step, n)):
        total += hashes[j : j + count] * power
    return mix(total)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def by_batch(
    df: DataFrame, schema: str | StructType, rows: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array] | None]
) -> DataFrame:
    """``rows`` turns each Arrow batch into columns of ``schema``; None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out)
                    )

    return df.mapInArrow(run, schema)
