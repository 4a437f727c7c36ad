"""Token ids in files of byte planes.

A file row is a segment: whole documents in ascending doc_id order, and their ids as one stream, cut into blocks
of BLOCK ids. A block's ids are transposed into byte planes (all lowest bytes, then the next, ...), each plane is
compressed with zstandard, and an index ahead of the planes has each one's length, so a reader can open single
blocks. Spark writes the segments (a binary column of a Parquet table in the shared folder), sorted by range, so
a lost executor's files are written again by another, and reads them back.

Null texts are empty: the end id alone. Null doc_ids come first. Rows with equal doc_id stand by text; other
columns are ignored. No rows give an empty table. A text of any length is encoded whole; a segment ends with the
document that fills it, so a very long text is a segment of its own.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import pieces_of
from .common import large_strings, scratch_path, tidy

BLOCK = 16_384
#: Ids after which a segment ends with the current document.
SEGMENT = 1 << 18
END = 2
#: zstandard level of a plane: the fastest; higher ones make files a little smaller.
LEVEL = 1
#: Pieces in each half of a process's memory, and texts in one call of the library.
MEMORY = 600_000
TOGETHER = 8192
#: Words of letters alone that are encoded as one line; they don't touch each other's ids.
LINE = 512
_LETTERS, _SIGNS = r"[^\W\d_]+", r"[!-&(-/:-@\[-`{-~]+"
_LETTERS_AND_SIGNS = re.compile(rf"({_LETTERS})({_SIGNS})(?:(\n{_LETTERS})({_SIGNS})?)?\Z")
_MAGIC = b"TOKP"


def pack(ids: np.ndarray, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """Bytes of one segment of unsigned 32-bit ids."""
    press = zstandard.ZstdCompressor(level=level)
    sizes, planes = [], []
    for first in range(0, ids.size, block):
        rows = np.ascontiguousarray(ids[first : first + block].astype("<u4").view(np.uint8).reshape(-1, 4).T)
        for plane in rows:
            planes.append(press.compress(plane.tobytes()))
            sizes.append(len(planes[-1]))
    return b"".join([_MAGIC, struct.pack("<QI", ids.size, block), np.array(sizes, "<u4").tobytes(), *planes])


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first to last of a segment; only the blocks that hold them are decompressed."""
    if data[:4] != _MAGIC:
        raise ValueError("not a segment")
    count, block = struct.unpack_from("<QI", data, 4)
    last = count if last is None else min(last, count)
    blocks = -(-count // block)
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", 4 * blocks, 16).astype(np.int64))]) + 16 + 16 * blocks
    out = []
    for b in range(first // block, -(-last // block)):
        planes = [np.frombuffer(zstandard.ZstdDecompressor().decompress(data[ends[4 * b + p] : ends[4 * b + p + 1]]), np.uint8) for p in range(4)]
        ids = np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()
        out.append(ids[max(0, first - b * block) : last - b * block])
    return np.concatenate(out) if out else np.zeros(0, "<u4")


class Encoder:
    """Ids of texts by a byte-level tokenizer of the tokenizers library, with a memory of the pieces met."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives out the cores
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(source)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the half before; what is met again moves up

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, TOGETHER texts at a time."""
        out: list[bytes] = []
        for i in range(0, len(texts), TOGETHER):
            out += [array("I", e.ids).tobytes() for e in self.own.encode_batch_fast(texts[i : i + TOGETHER], add_special_tokens=False)]
        return out

    def lines(self, names: list[str]) -> list[bytes]:
        """Packed ids of each name after a space; names are of letters alone, so each is one word of its line."""
        out: list[bytes] = []
        for i in range(0, len(names), 16 * LINE):
            cut = [names[j : j + LINE] for j in range(i, min(i + 16 * LINE, len(names)), LINE)]
            for some, e in zip(cut, self.own.encode_batch([" " + " ".join(x) for x in cut], add_special_tokens=False)):
                starts = np.flatnonzero(np.diff(np.array(e.word_ids, np.int64), prepend=-1))
                if starts.size == len(some):
                    ids = array("I", e.ids).tobytes()
                    bounds = [*(4 * starts).tolist(), len(ids)]
                    out += [ids[a:b] for a, b in zip(bounds, bounds[1:])]
                else:  # a letter to Python that is none to the library
                    out += self.encoded([" " + p for p in some])
        return out

    def learn(self, new: set[str]) -> None:
        """Put the ids of these pieces, each after a space, into memory."""
        letters, others, ended = set(), [], []
        for p in new:
            ids = self.older.get(p)
            if ids is not None:
                self.memory[p] = ids
            elif p.isalpha():
                letters.add(p)
            elif m := _LETTERS_AND_SIGNS.match(p):  # letters, signs and line ends never share a token
                core, *rest = m.groups("")
                ended.append((p, core, rest))
                if core not in self.memory:
                    if (ids := self.older.get(core)) is not None:
                        self.memory[core] = ids
                    else:
                        letters.add(core)
            else:
                others.append(p)
        names = list(letters)
        self.memory.update(zip(names, self.lines(names)))
        self.memory.update(zip(others, self.encoded([" " + p for p in others])))
        tails = list({x for _, _, rest in ended for x in rest})
        tail = dict(zip(tails, self.encoded(tails)))
        for p, core, (signs, line, more) in ended:
            self.memory[p] = self.memory[core] + tail[signs] + tail[line] + tail[more]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.memory) > MEMORY:
            self.older, self.memory = self.memory, {}
        # pieces know nothing of added tokens
        cut = [[x] if any(t in x for t in self.special) else pieces_of(x) for x in texts]
        heads = iter(self.encoded([pieces.pop(0) for pieces in cut]))
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        self.learn(new.difference(self.memory))
        return [next(heads) + b"".join(map(self.memory.__getitem__, pieces)) for pieces in cut]


@functools.lru_cache(1)
def encoder(source: str) -> Encoder:
    """One for each process, so tasks that follow in it know the pieces met before."""
    return Encoder(source)


def write(documents: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Encode and write all documents' ids at path. tokenizer: the library's JSON."""
    large_strings(documents)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = documents.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    source = sorted_.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    key = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(key)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("segment", T.BinaryType())])
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(shared.value)
        before, shard, held, names, kind = 0, 0, [], [], None

        def segment():
            sizes = [len(x) // 4 for x in held]
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([ids.size], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(ids)], pa.large_binary())], names=schema.names)

        size = 0
        for batch in batches:
            kind = batch.column(0).type
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                shard = part.column(2)[0].as_py()
                for doc, ids in zip(part.column(0), encode([x or "" for x in part.column(1).to_pylist()])):
                    held.append(ids + tail)
                    names.append(doc.as_py())
                    size += len(held[-1]) // 4
                    if size >= SEGMENT:
                        yield segment()
                        before += size
                        held, names, size = [], [], 0
        if held:
            yield segment()

    source.mapInArrow(tidy(run), schema).write.option("compression", "none").parquet(path)


def _read(spark, path: str, name: str, kind: T.DataType, made) -> DataFrame:
    """Per document: doc_id, start, n_tokens, and a column of what made gives for the segment's id bytes and each document's bounds in them."""
    table = spark.read.parquet(path)
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row for each part written
    offsets = shards.select(F.col("shard").alias("of"), (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("offset"))
    rows = table.join(F.broadcast(offsets), table["shard"] == offsets["of"]).select((F.col("offset") + F.col("before")).alias("start"), "doc_ids", "sizes", "segment")
    schema = T.StructType([T.StructField("doc_id", table.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start, names, sizes, segment in zip(*batch.columns):
                ids = memoryview(unpack(segment.as_py()).tobytes())
                bounds = np.cumsum([0, *sizes.as_py()])
                yield pa.RecordBatch.from_arrays([names.values, pa.array(bounds[:-1] + start.as_py(), pa.int64()), sizes.values, made(ids, (4 * bounds).tolist())], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)


def read(spark, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit little-endian)."""
    return _read(spark, path, "ids", T.BinaryType(), lambda ids, at: pa.array([bytes(ids[a:b]) for a, b in zip(at, at[1:])], pa.large_binary()))


def checksums(spark, path: str) -> DataFrame:
    """The same with ids_crc32 (unsigned crc32 of the ids' bytes) in place of the ids, which stay in their tasks."""
    return _read(spark, path, "ids_crc32", T.LongType(), lambda ids, at: pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])], pa.int64()))


def packed(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write and read back; per document: doc_id, start, n_tokens, ids_crc32."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()
    path = scratch_path(documents.sparkSession, "token-planes")
    write(documents, tokenizer, path)
    return checksums(documents.sparkSession, path)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
