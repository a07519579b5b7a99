"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own.

A document of n tokens is cut into pieces of 1,024 tokens and, for the rest, one piece for each binary digit
of its length. Pieces of one length form a bucket, so a training batch draws sequences of equal length,
nothing is padded, and no sequence crosses documents. A map over the texts is all it takes: no shuffle.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.text import by_batch, column, prepare

SEQUENCE = 1024
END = 0
# fixed value: how byte-level BPE parts a text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """Powers of two, none above ``longest`` (itself one), that add up to ``n``; the largest come first."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers.

    A byte-level BPE file of the common form runs on ``tiktoken``, which gives the same ids four times faster.
    Files of another form, and texts that hold one of the file's special tokens, run on ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = byte_pairs(self.tokenizer)

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # a run of white space too long for its pattern matcher
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def byte_pairs(tokenizer):
    """A ``tiktoken`` encoding of a byte-level BPE of the common form; None for other files.

    The form: no normaliser, the pattern below, merges that make ids in ascending order.
    """
    import tiktoken

    found = json.loads(tokenizer.to_str())
    model, cut = found["model"], found.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or found.get("normalizer") or cut.get("type") != "ByteLevel":
        return None
    if cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("byte_fallback") or model.get("dropout"):
        return None
    # byte-level files write each byte as a printable character: itself, or the next code points from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
    vocabulary, special = model["vocab"], {t["content"] for t in found.get("added_tokens", [])}
    merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    return tiktoken.Encoding("byte_pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, tokens, bucket, sequence_id, offset``.

    ``tokens`` holds the ids as little-endian unsigned 32-bit numbers, ``bucket`` is the sequence's length, and
    ``offset`` is 0, as a piece fills its sequence. Each document ends with the id 0; null and empty texts consist
    of it. Rows that share an id, or have none, are documents of their own. ``sequence_id`` is unique in the
    result. Other columns are ignored; an empty table gives none. ``tokenizer`` is the path of a tokenizer file
    that every executor can read.
    """
    prepare(docs.sparkSession)

    def rows(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        encode = encoder(tokenizer)
        ids = [encode(t) + END.to_bytes(4, "little") for t in texts]
        parts = [lengths(len(e) // 4) for e in ids]
        of = np.repeat(np.arange(len(ids)), [len(p) for p in parts])
        length = np.array([n for p in parts for n in p], dtype=np.int64)
        start = np.concatenate([np.cumsum([0, *p[:-1]]) for p in parts]).astype(np.int64)
        return {
            "doc_id": column(batch, "doc_id").take(pa.array(of)),
            "start": start,
            "length": length,
            "doc_tokens": np.array([len(e) // 4 for e in ids], dtype=np.int64)[of],
            "tokens": pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(of, start, length, strict=True)], pa.binary()),
        }

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = by_batch(texts, "doc_id long, start long, length long, doc_tokens long, tokens binary", rows)
    return pieces.select(
        "*", F.col("length").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
