"""Benchmark decontamination by winnowing.

Words are maximal runs of bytes outside ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F`` after A-Z are lower-cased.
Of each 13 consecutive words, the smallest 8-word hash is kept, by documents and items alike, so every
shared 13-word span has a shared fingerprint. Fingerprints are joined and each hit is extended to the
windows over it, compared as text: with each distinct window of the benchmark once, which knows its items. Items of 1 to 12 words are one window: their own whole hash is kept.

Nulls and texts without words: no words, not contaminated; such items match nothing. Repeated rows are
judged one by one (rows are told apart by an internal number, not by doc_id). Other columns are ignored. Texts of
any length are looked at whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gram_hashes, hash_spans, large_strings, lower_table, row_counts, runs, slices, stored, tidy

WINDOW = 13
GRAM = 8
#: Size of the filter of benchmark fingerprints that every task gets, whatever the benchmark's size.
FILTER_BITS = 1 << 23

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = lower_table(bytes(b for b in _SEPARATORS if not 65 <= b <= 90))

_MARK = T.StructType([T.StructField("fp", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("lead", T.IntegerType()), T.StructField("span", T.StringType())])


def _windows(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Word numbers at which a kept 8-word hash begins. first, last: bounds of the row of each word."""
    grams = gram_hashes(words, GRAM)
    if grams.size < WINDOW - GRAM + 1:
        return np.zeros(0, np.int64)
    wide = WINDOW - GRAM + 1
    count = grams.size - wide + 1
    least = grams[:count].copy()
    for i in range(1, wide):
        np.minimum(least, grams[i : i + count], out=least)
    least[np.arange(count) + WINDOW > last[:count]] = 0  # the window leaves its row
    best = np.zeros(grams.size, np.uint64)
    for i in range(wide):
        np.maximum(best[i : i + count], least, out=best[i : i + count])
    return np.flatnonzero((best == grams) & (best > 0))


def _marks(batches: Iterator[pa.RecordBatch], key: str, schema: pa.Schema, lengths: list[int], keep) -> Iterator[pa.RecordBatch]:
    """Rows (uid, key, n_words, marks); keep filters hashes; lengths are those of short items (None: the row's own)."""
    for batch in batches:
        for part, data, offsets in slices(batch, "text"):
            low = _LOWER[data]
            starts, ends = runs(low > 0, offsets)
            words = hash_spans(low, starts, ends)
            counts = row_counts(starts, offsets)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            row = np.repeat(np.arange(counts.size), counts)
            first, last = bounds[:-1][row], bounds[1:][row]
            found = []  # word number, words before it, words from it on, hash
            at = _windows(words, first, last)
            prints = gram_hashes(words, GRAM)[at] if at.size else np.zeros(0, np.uint64)
            hit = keep(prints)
            at, prints = at[hit], prints[hit]
            lead = np.minimum(at - first[at], WINDOW - GRAM) if at.size else at
            tail = np.minimum(last[at] - at, WINDOW) if at.size else at
            found.append((at, lead, tail, prints))
            for n in lengths if lengths is not None else range(1, WINDOW):
                prints = gram_hashes(words, n)
                at = np.flatnonzero(np.arange(prints.size) + n <= last[: prints.size]) if prints.size else np.zeros(0, np.int64)
                if lengths is None:  # an item of n words: its only window
                    at = at[counts[row[at]] == n] if at.size else at
                prints = prints[at] ^ np.uint64(n)
                hit = keep(prints)
                at, prints = at[hit], prints[hit]
                found.append((at, np.zeros_like(at), np.full_like(at, n), prints))
            at, lead, tail, prints = (np.concatenate(x) for x in zip(*found))
            marks: list[list] = [[] for _ in range(counts.size)]
            for a, b, t, h in zip(at.tolist(), lead.tolist(), tail.tolist(), prints.view(np.int64).tolist()):
                span = b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(a - b, a + t)).decode("utf-8", "replace")
                marks[row[a]].append({"fp": h, "pos": int(a - first[a]), "lead": b, "span": span})
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(marks, schema.field(3).type)], schema=schema)


def _fingerprinted(df: DataFrame, key: str, lengths: list[int] | None, bits) -> DataFrame:
    source = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key), F.col("text").cast("string").alias("text"))
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField(key, source.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("marks", T.ArrayType(_MARK))])
    arrow = pa.struct([("fp", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("span", pa.string())])

    def run(batches):
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)

        def keep(prints):
            if table is None:
                return np.ones(prints.size, bool)
            slot = (prints % np.uint64(FILTER_BITS)).astype(np.int64)
            return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("uid", pa.int64()), (key, batch.column(1).type), ("n_words", pa.int64()), ("marks", pa.list_(arrow))])
            yield from _marks(iter([batch]), key, schema, lengths, keep)

    return source.mapInArrow(tidy(run), out)


def _filter_of(items: DataFrame):
    """Bits of the fingerprints present, FILTER_BITS of them at most, as a broadcast."""
    slot = F.expr(f"pmod(fp, {FILTER_BITS})")
    cells = items.select(F.explode("marks.fp").alias("fp")).select(F.shiftright(slot, 3).alias("cell"), F.expr(f"shiftleft(1, cast(pmod(fp, {FILTER_BITS}) & 7 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bit"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for cell, bit in cells.collect():  # FILTER_BITS / 8 rows at most, however large the benchmark
        table[cell] = bit
    return items.sparkSession.sparkContext.broadcast(table.tobytes())


def contaminated_windows(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents as uid, doc_id, n_words; found windows as uid, window_id, start, size in words; window_id, item_id of the benchmark's)."""
    large_strings(documents)
    items = stored(_fingerprinted(benchmark, "item_id", None, None), "decontaminate-items")
    lengths = [r[0] for r in items.filter(F.col("n_words").between(1, WINDOW - 1)).select("n_words").distinct().collect()]
    docs = stored(_fingerprinted(documents, "doc_id", lengths, _filter_of(items)), "decontaminate-docs")
    theirs = _spread(items, "item_id")
    # each distinct window of the benchmark once, whatever number of items has it
    distinct = stored(theirs.select("fp", "before", "window").distinct().withColumn("window_id", F.monotonically_increasing_id()), "decontaminate-windows")
    members = theirs.join(distinct, ["fp", "before", "window"]).select("window_id", "item_id").distinct()
    hits = _spread(docs.filter(F.size("marks") > 0), "uid").join(distinct, ["fp", "before", "window"]).select("uid", "window_id", "start", "size")
    return docs.drop("marks"), hits, members


def _spread(marked: DataFrame, key: str) -> DataFrame:
    """(key, fp, before, window, start, size): each hash extended to the windows over it, as words.

    A window of WINDOW words begins up to WINDOW - GRAM words before the hash; of a short item there is one.
    """
    words = F.split("m.span", " ")
    rows = marked.select(key, F.explode("marks").alias("m")).select(key, F.col("m.fp").alias("fp"), "m.pos", "m.lead", words.alias("words"), F.least(F.size(words), F.lit(WINDOW)).alias("size"))
    rows = rows.withColumn("before", F.explode(F.sequence(F.lit(0), F.least("lead", F.lit(WINDOW - GRAM))))).filter(F.col("lead") - F.col("before") + F.col("size") <= F.size("words"))
    window = F.array_join(F.slice("words", F.col("lead") - F.col("before") + 1, F.col("size")), " ")
    return rows.select(key, "fp", "before", window.alias("window"), (F.col("pos") - F.col("before")).alias("start"), "size")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: some words are hit, and they are at least a twentieth of the document's words.
    """
    docs, hits, members = contaminated_windows(documents, benchmark)
    hits = stored(hits, "decontaminate-hits")
    words = hits.select("uid", F.explode(F.expr("sequence(start, start + size - 1)")).alias("w")).distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    # documents that met the same windows share their items: each such set is made out once
    sets = stored(hits.groupBy("uid").agg(F.array_sort(F.collect_set("window_id")).alias("windows")), "decontaminate-sets")
    some = sets.select("windows").distinct()
    named = some.select("windows", F.explode("windows").alias("window_id")).join(members, "window_id").select("windows", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("windows").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    items = sets.join(named, "windows").select("uid", "n_items", "items_sha256")
    joined = docs.join(words, "uid", "left").join(items, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                         F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
