"""Byte-level BPE encoding and decoding by a file of ranks.

Texts are cut into words by a pattern; words into single bytes; then the neighbours whose joined bytes have the
least rank are joined, the leftmost first, until none have a rank.

Spark higher-order functions do this fold for the corpus' most frequent distinct words, over arrays of byte
strings with a literal rank map (spread over buckets, because a map literal is searched from end to end). The
result, VOCABULARY words at most, goes to every task. The fold takes about 0.3 ms a word there, so the long tail
of rare words is folded by the same steps inside the tasks that meet them (the README has the figures).
Decoding concatenates the ids' binary pieces, with higher-order functions over the array of ids.

Null texts are empty and give no ids. Repeated rows, ties in frequency and other columns have no influence. A text of
any length is encoded whole; a word of over 256 bytes is folded with a heap.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import large_strings, stored, tidy

#: Distinct words whose ids go to every task: the most frequent ones, up to WORD_BYTES long. Others are folded on sight.
VOCABULARY = 60_000
WORD_BYTES = 40
#: Entries of a task's own memories of pieces and of rare words; one is emptied when full.
MEMORY = 150_000
BUCKETS = 8192
_NONE = 2**31 - 1

_SPACE_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from lines of base64 token, space, rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def pieces_of(text: str) -> list[str]:
    """Cut before each space that a visible character follows, and drop that space: no word spans such a cut."""
    return _CUT.split(text) if _SPACE_BEFORE_SPACE.search(text) else text.split(" ")


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 256:
        return _fold_long(word, ranks)
    rank = ranks.get
    cut = list(range(len(word) + 1))  # the parts' edges
    scores = [rank(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while scores and (least := min(scores)) != _NONE:
        i = scores.index(least)
        del cut[i + 1], scores[i]
        if i < len(scores):
            scores[i] = rank(word[cut[i] : cut[i + 2]], _NONE)
        if i:
            scores[i - 1] = rank(word[cut[i - 1] : cut[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a word of any length, with a heap of neighbours."""
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j >= n or part[i] + part[j] != joined:
            continue
        part[i], part[j] = joined, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(joined + part[k])) is not None:
                heapq.heappush(heap, (r, i, joined + part[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(part[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, part[h] + joined))
    return [ranks[p] for p in part if p is not None]


def fold_column(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids (array of int) of a binary column of words, by higher-order functions."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for key, rank in ranks.items():
        text = key.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")  # folded to a literal when planned

    def let(value, body):
        return F.element_at(F.transform(F.array(value), body), 1)

    empty = F.array().cast("array<int>")
    text = F.decode(word, "ISO-8859-1")
    parts = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(text, i, F.lit(1)))

    def fold_with(table):
        def rank(text):
            return F.coalesce(F.element_at(F.get(table, (F.crc32(text.cast("binary")) % BUCKETS).cast("int")), text), F.lit(_NONE))

        start = let(parts, lambda p: F.struct(p.alias("p"), F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda a, i: rank(F.concat(a, F.get(p, i + 1)))).alias("r")))

        def join(s, q, w):
            return F.struct(
                F.concat(F.slice(s["p"], F.lit(1), q - 1), F.array(w), F.slice(s["p"], q + 2, F.size(s["p"]))).alias("p"),
                F.concat(
                    F.slice(s["r"], F.lit(1), F.greatest(q - 2, F.lit(0))),
                    F.when(q > 1, F.array(rank(F.concat(F.get(s["p"], q - 2), w)))).otherwise(empty),
                    F.when(q < F.size(s["r"]), F.array(rank(F.concat(w, F.get(s["p"], q + 1))))).otherwise(empty),
                    F.slice(s["r"], q + 2, F.size(s["p"])),
                ).alias("r"),
            )

        def step(s, _):
            merged = lambda m: let(F.array_position(s["r"], m).cast("int"), lambda q: let(F.concat(F.get(s["p"], q - 1), F.get(s["p"], q)), lambda w: join(s, q, w)))
            return F.when(F.size(s["r"]) == 0, s).otherwise(let(F.array_min(s["r"]), lambda m: F.when(m == _NONE, s).otherwise(merged(m))))

        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step, lambda s: F.transform(s["p"], rank))

    # the map stands in the plan once
    return F.when(F.octet_length(word) == 0, empty).otherwise(let(literal, fold_with))


def _frequent_words(documents: DataFrame, pattern: str, most: int) -> DataFrame:
    """(word as binary, n) of the most frequent words over all documents.

    Each task passes on its own most frequent words only; which words are kept decides speed, never ids.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        find = regex.compile(pattern).findall
        words: Counter[str] = Counter()
        seen: Counter[str] = Counter()  # pieces after a cut

        def spread():
            for piece, n in seen.items():
                if n > 1:  # what is met once can't be frequent
                    for w in find(" " + piece):
                        words[w] += n
            seen.clear()

        for batch in batches:
            for value in batch.column(0):
                pieces = pieces_of(value.as_py() or "")
                words.update(find(pieces[0]))
                del pieces[0]
                seen.update(pieces)
                if len(seen) > MEMORY:
                    spread()
            spread()
            if len(words) > 4 * MEMORY:
                words = Counter(dict(words.most_common(MEMORY)))
        top = [(w.encode(), n) for w, n in words.most_common(2 * most) if n > 1 and len(w.encode()) <= WORD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def vocabulary(documents: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = VOCABULARY) -> dict[str, bytes]:
    """Ids (32-bit little-endian) of the corpus' most frequent words, most of them, from the higher-order fold."""
    words = stored(_frequent_words(documents, pattern, most), "bpe-words").repartition(2 * documents.sparkSession.sparkContext.defaultParallelism)
    folded = words.select("word", fold_column(F.col("word"), ranks).alias("ids"))
    return {w.as_py().decode(): np.array(ids.as_py(), "<i4").tobytes() for w, ids in zip(*folded.toArrow().columns)}  # most rows of WORD_BYTES at most


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = VOCABULARY) -> DataFrame:
    """The documents with a column ids (array of int)."""
    large_strings(documents)
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((vocabulary(documents, ranks, pattern, most), ranks))
    source = documents.withColumn("text", F.col("text").cast("string")).drop("ids")
    at = source.columns.index("text")
    schema = T.StructType([*source.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        words, table = shared.value
        find = regex.compile(pattern).findall
        memory: dict[str, bytes] = {}
        rare: dict[str, bytes] = {}

        def folded(word: str) -> bytes:
            found = rare.get(word)
            if found is None:
                if len(rare) > MEMORY:
                    rare.clear()
                found = fold(word.encode(), table)
                found = pack(f"<{len(found)}i", *found)
                if len(word) <= WORD_BYTES:
                    rare[word] = found
            return found

        def ids(piece: str) -> bytes:
            return b"".join([words.get(w) or folded(w) for w in find(piece)])

        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = []
                for value in part.column(at):
                    pieces = pieces_of(value.as_py() or "")
                    head = ids(pieces[0])
                    del pieces[0]
                    if len(memory) > MEMORY:
                        memory.clear()
                    for p in set(pieces).difference(memory):
                        memory[p] = ids(" " + p)
                    rows.append(head + b"".join(map(memory.__getitem__, pieces)))
                bounds = np.cumsum([0, *(len(r) // 4 for r in rows)])
                flat = pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32())
                lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), flat) if bounds[-1] >= 2**31 else pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "ids"])

    return source.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows with a column decoded (binary): the ids' binary pieces, concatenated.

    Each byte of a piece stands as the character of its number, as only strings can be joined in time linear in their
    length.
    """
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")  # folded to a literal when planned
    return encoded.withColumn("decoded", F.encode(F.array_join(F.transform("ids", lambda i: F.get(literal, i)), ""), "ISO-8859-1"))


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = load_ranks(path)
    rows = decode(encode(documents.select("doc_id", "text"), ranks, pattern).select("doc_id", "ids"), ranks)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
