"""What the operators share: the shared folder, tables written there, and a cache in the worker."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or (sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return at if "://" in at else at.replace("file:", "file://", 1) if at.startswith("file:") else f"file://{at}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there, whatever executors are lost."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def text_slices(column: pa.Array, most_chars: int):
    """(from, to, texts) for stretches of a text column of about most_chars characters, nulls as empty texts.

    Only one stretch at a time is in Python strings. A text longer than that is a stretch of its own.
    """
    length = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(length)])
    at = 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most_chars, side="right")) - 1)
        yield at, to, [t or "" for t in column.slice(at, to - at).to_pylist()]
        at = to


def byte_slices(column: pa.Array, most: int):
    """(from, to) for stretches of a text column of about most bytes; a longer text is a stretch of its own."""
    upto, at = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))], 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield at, to
        at = to


def utf8_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, an Arrow array or a list, one after the other, and where each begins, with the end of the last. Nulls are empty."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts (see utf8_of) begin and end, and how many each text has."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(len(at) - 1, np.int64),)
    word, new = ~SPACE[data], np.zeros(len(data) + 1, bool)
    new[at] = True
    first = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | new[:-1]))
    last = np.flatnonzero(word & (np.r_[~word[1:], True] | new[1:])) + 1
    return first, last, np.diff(np.r_[0, np.searchsorted(first, at[1:])])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD1342543DE82EF95
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLY)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
WINDOW = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hashes of the spans [first, last) of bytes, which are in order and don't overlap.

    A hash is a sum over the bytes of random numbers times powers of a step, so that those of all spans come from one
    running sum. It is made by windows of about WINDOW bytes that end where a span does.
    """
    up, down = in_worker("powers", lambda: (powers(STEP, 2 * WINDOW), powers(pow(STEP, -1, 1 << 64), 2 * WINDOW)))
    out, done = [np.zeros(0, np.uint64)], 0
    while done < len(first):
        to = max(done + 1, int(np.searchsorted(last, first[done] + WINDOW, side="right")))
        a, b = int(first[done]), int(last[to - 1])
        if b - a > len(up):
            up, down = powers(STEP, b - a), powers(pow(STEP, -1, 1 << 64), b - a)
        total = np.r_[np.uint64(0), np.cumsum(byte[data[a:b]] * up[: b - a], dtype=np.uint64)]
        f, e = first[done:to] - a, last[done:to] - a
        out.append(mixed((total[e] - total[f]) * down[f] + (e - f).astype(np.uint64) * MULTIPLY))
        done = to
    return np.concatenate(out)


def in_worker(key, make, large: bool = False):
    """make() once in each Python worker. Of what is large only the last is kept: workers go on from stage to stage."""
    kept = sys.__dict__.setdefault("_lectern_kept", {})
    if key not in kept:
        if large:
            for other in [k for k, (_, was_large) in kept.items() if was_large]:
                del kept[other]
            gc.collect()
            pa.default_memory_pool().release_unused()
        kept[key] = make(), large
    return kept[key][0]
