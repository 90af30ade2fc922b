"""Shared pieces: whole-text word splitting and hashing in numpy, and scratch tables.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  No byte of a multi-byte UTF-8
character lies in that set, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1  # odd, hence invertible modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD1342543DE82EF95
_QINV = pow(_Q, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
U64 = np.uint64


class _Powers:
    """Powers of a base modulo 2**64, extended as longer inputs arrive."""

    def __init__(self, base: int) -> None:
        self.base, self.have = base, np.ones(1, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            step = np.full(max(n, 2 * len(self.have), 4096), self.base, dtype=U64)
            step[0] = 1
            self.have = np.multiply.accumulate(step)
        return self.have[:n]


_POW, _IPOW, _WPOW, _WIPOW = _Powers(_P), _Powers(_PINV), _Powers(_Q), _Powers(_QINV)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of UTF-8 text."""
    if not data:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, dtype=U64)
    n = len(data)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(U64) + U64(1)) * _POW.upto(n), out=total[1:])
    h = (total[ends] - total[starts]) * _IPOW.upto(n)[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0xA0761D6478BD642F)))


class WindowHash:
    """Hashes of any word range of one text, from prefix sums.  salt gives independent hashes."""

    def __init__(self, words: np.ndarray, salt: int = 0) -> None:
        n = len(words)
        self.total = np.zeros(n + 1, dtype=U64)
        keyed = mix(words + U64((salt * 0x9E3779B97F4A7C15) & _M)) if salt else words
        np.cumsum(keyed * _WPOW.upto(n), out=self.total[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _WIPOW.upto(len(self.total))
        return mix((self.total[end] - self.total[start]) * inv[start] ^ (end - start).astype(U64))

    def windows(self, w: int) -> np.ndarray:
        n = len(self.total) - w
        if n <= 0:
            return np.zeros(0, dtype=U64)
        at = np.arange(n)
        return self.ranges(at, at + w)


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only in a single process without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")

        where = f"file://{tempfile.gettempdir()}/latticeflow-scratch"
    return where.rstrip("/")


def hand_back() -> None:
    """Gives freed memory back to the machine; the allocators of a worker that is used again and again
    would keep what large arrays took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(work):
    """The batch function with its freed memory handed back at the end of each task: workers outlive
    a step, and what one step left would add to what the next one needs."""

    def run(batches):
        yield from work(batches)
        hand_back()

    return run


def tidy_session(spark: SparkSession) -> SparkSession:
    """A session of the same settings that drops an execution's shuffle files when it has ended.

    For steps that write their result and are not run again; the caller's session stays as it is.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut within the block are deleted at its end, but for those that stay."""
    here = f"{_FOLDER.get() or scratch_dir(spark) + '/tables'}/{uuid.uuid4().hex}"
    token = _FOLDER.set(here)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        delete(spark, here)


def cut(df: DataFrame, name: str = "t", reader: SparkSession | None = None, stays: bool = False) -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it back, in another session if given.

    Lost executors cost a rerun of tasks, never of the steps before, and no plan grows with the
    rounds of a loop.  A table that stays outlives the block of ``passing`` that it is cut in.
    """
    spark, here = df.sparkSession, _FOLDER.get()
    if here and stays:
        here = here.rsplit("/", 1)[0]
    path = f"{here or scratch_dir(spark) + '/tables'}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return (reader or spark).read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of frames from ``cut`` that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
