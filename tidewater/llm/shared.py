"""Helpers that the text operators share: shared folders, Arrow batches, byte-level word spans.

A *word* is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; only A-Z are
lower-cased.  All span arithmetic is done on slices of at most ``SLICE_BYTES`` of text, so the
memory of a task follows its longest document, not its partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
PART_ROWS = 512

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and the session
    runs on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are removed at the end: what is wanted must have been written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``shared_dir`` made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame, what: str, with_path: bool = False) -> DataFrame | tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back: the lineage ends there, and executors
    that are lost later do not cause earlier stages to run again.  On demand with its folder."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return (read, path) if with_path else read


def row_of(names: list[str]) -> Column:
    """The columns of these names, whatever they hold, as one struct ``row``: a frame that carries it beside the few
    columns an operator uses has no names that could meet those the operator makes; ``row.*`` unpacks it."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in names]).alias("row")


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def parts(batch: pa.RecordBatch, rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that Python holds the texts of a few hundred rows at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each; one long text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class Spans:
    """Words of some texts: ``data[start[i]:end[i]]`` is a word of text ``row[i]``."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        self.bytes = joined
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.row = np.searchsorted(self.offset, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=len(texts))


_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(SLICE_BYTES + (1 << 16), n + n // 4)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span from one running sum (arithmetic modulo 2**64)."""
    power, inverse = _power_tables(len(data) + 1)
    running = np.empty(len(data) + 1, np.uint64)
    running[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=running[1:])
    h = (running[end] - running[start]) * inverse[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
