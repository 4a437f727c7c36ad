"""Shared helpers: scratch tables, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step looks at; a longer text is one step of its own.
SLICE_BYTES = 1 << 20

#: Texts, and bytes of them, that go to Python in one batch (a longer text is a batch of its own).
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20

#: Bytes that separate words in the white-space convention: space and 0x09 to 0x0D.
SPACE = bytes([0x20, *range(0x09, 0x0E)])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="habitat-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives its memory back to the system when its task ends, as workers live on."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
    return wrapped


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, nulls as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about SLICE_BYTES of text; every row is in exactly one run."""
    if not batch.num_rows:
        return
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        cut = offsets[first : last + 1]
        yield batch.slice(first, last - first), data[cut[0] : cut[-1]], cut - cut[0]
        first = last


def lower_table(separators: bytes) -> np.ndarray:
    """Byte map: A-Z to a-z, separators to 0, others to themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of mask that stay inside one row."""
    if not mask.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(mask.size + 1, bool)
    edge[offsets] = True
    begins, finishes = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:-1]
    finishes[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    key = str(base)
    if key not in _powers or _powers[key].size < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span [start, end), the same for equal bytes anywhere."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, data.size), out=sums[1:])
    spans = (sums[ends] - sums[starts]) * _power(_INVERSE, data.size)[starts]
    return mix(spans + (ends - starts).astype(np.uint64))


def row_counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted starts fall in each row; the running sum gives the rows' first ones."""
    return np.diff(np.searchsorted(starts, offsets))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; windows that run over the end are left out."""
    count = words.size - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i : i + count]
    return mix(total)


def large_strings(df: DataFrame) -> None:
    """Let very long texts pass through Arrow in batches bounded by bytes, and let workers of this checkout import the package.

    These are settings of the session: plans read them when they run, so they can't be put back before.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = f"{root}:{environment.get('PYTHONPATH', '')}".rstrip(":")


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as compressed byte planes; rising ones as their differences."""
    values = np.asarray(values).astype(np.int64)
    if rising and values.size:
        values = np.diff(values, prepend=0)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, rising: bool = False) -> np.ndarray:
    """What squeeze was given, as 64-bit integers."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.int64).ravel()
    return np.cumsum(values) if rising else values


def run_number() -> int:
    """A number for what a task makes, other than any other task's; the low 31 bits are free for the task."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 31
