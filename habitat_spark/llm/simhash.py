"""SimHash near-duplicate groups with a Gray-order hierarchical index.

Fingerprint: majority bits of the XXH64 hashes (seed 42) of a text's word shingles, after A-Z are lower-cased;
words are separated by white space (0x20, 0x09-0x0D); a text of fewer words than a shingle is one shingle, and
one without words (nulls too) has fingerprint zero, linked like any other. Fingerprints link at 3 or fewer
differing bits. A text of any length is hashed whole, some shingles at a time.

Only distinct fingerprints are compared:

1. They are sorted by Gray rank into range partitions, the groups, of about MEMBERS each. What the members of a group
   have in common (a mask of bits and their values) is its pattern.
2. The patterns are the leaves of the upper index. Each group asks it, for all its members at once, which other groups
   they may link into: upper nodes hold the bits common to the nodes below, differences add up on the way down, and
   whole subtrees go when more than 3 have added up. A pair of groups is asked for in one direction only.
3. Where members of one group meet another group (or their own), an index of the same kind over that group's
   fingerprints finds the links. What links inside one such meeting is joined up there, so that it gives an edge for
   each member at most, never all pairs.
4. Components come from alternating large-star and small-star rounds over these edges.

The upper index has GROUPS patterns at most and goes to every task; everything else stays in Spark's tables, and no
task holds more than two groups. Repeated doc_ids are rows of their own; ties have no influence, the smallest doc_id
names a component; a component whose rows have no doc_id has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, large_strings, stored, tidy

SHINGLE = 3
DISTANCE = 3
#: Fingerprints of a group, as far as that gives at most GROUPS groups; larger groups beyond that.
MEMBERS = 1 << 15
GROUPS = 20_000
#: Children of a node of the index.
FAN = 4
#: (query, node) pairs that a search holds on one level; more are searched in parts.
FRONTIER = 1 << 17


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a whole list of 64-bit hashes."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > hashes.size).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text's UTF-8 bytes, as an unsigned 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingle = min(shingle, len(words))
    total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for first in range(0, total, 1 << 16):
        last = min(total, first + (1 << 16))
        part = list(map(b" ".join, zip(*(words[first + i : last + i] for i in range(shingle)))))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp as the signed reading of the 64 bits."""
    large_strings(documents)
    source = documents.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            prints = np.array([simhash(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return source.mapInArrow(tidy(run), schema)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _rank(fp: Column) -> Column:
    """The same for a signed column, in the order of signed numbers."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


class GrayIndex:
    """Masked bit patterns in Gray order, with levels of nodes over runs of FAN children.

    A fingerprint is a pattern whose mask has all bits. A node has a mask of the bits on which all below it agree, and
    their values; each level's own mask leaves out what its parent has, so differences add up along a path.
    """

    def __init__(self, values: np.ndarray, masks: np.ndarray | None = None):
        self.size = values.size
        levels = [(np.full(values.size, ~np.uint64(0)) if masks is None else masks, values)]
        while levels[-1][0].size > 1:
            mask, value = levels[-1]
            heads = np.arange(0, mask.size, FAN)
            every, some = np.bitwise_and.reduceat(value, heads), np.bitwise_or.reduceat(value, heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~(every ^ some)
            levels.append((shared, every & shared))
        self.values = [value for _, value in levels[::-1]]
        masks_down = [mask for mask, _ in levels[::-1]]
        self.own = [masks_down[0], *(lower & ~np.repeat(upper, FAN)[: lower.size] for upper, lower in zip(masks_down, masks_down[1:]))]

    def search(self, queries: np.ndarray, distance: int = DISTANCE, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, places of leaves within the distance), in parts. after: only leaves beyond this place of each query."""
        if not self.size:
            return
        for first in range(0, queries.size, FRONTIER):
            q = np.arange(first, min(queries.size, first + FRONTIER))
            spent = np.bitwise_count((queries[q] ^ self.values[0][0]) & self.own[0][0])
            near = spent <= distance
            yield from self._below(queries, q[near], np.zeros(int(near.sum()), np.int64), spent[near], 0, distance, after)

    def _below(self, queries, q, node, spent, level, distance, after):
        while level < len(self.values) - 1 and q.size:
            if q.size > FRONTIER:
                for part in range(0, q.size, FRONTIER):
                    cut = slice(part, part + FRONTIER)
                    yield from self._below(queries, q[cut], node[cut], spent[cut], level, distance, after)
                return
            level += 1
            value, own = self.values[level], self.own[level]
            child = node[:, None] * FAN + np.arange(FAN)
            there = np.minimum(child, value.size - 1)
            spent = spent[:, None] + np.bitwise_count((queries[q][:, None] ^ value[there]) & own[there])
            near = (spent <= distance) & (child < value.size)
            if after is not None:
                below = FAN ** (len(self.values) - 1 - level)
                near &= (child + 1) * below - 1 > after[q][:, None]
            row, column = np.nonzero(near)
            q, node, spent = q[row], child[row, column], spent[row, column]
        if q.size:
            yield q, node


def joined(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """top (the root of each node) after the links (a, b): the least node of each linked set is its root."""
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return top
        a, b = a[apart], b[apart]
        np.minimum.at(top, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            higher = top[top]
            if (higher == top).all():
                break
            top = higher


def links(members: np.ndarray, queries: np.ndarray | None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root of its linked set) among members and queries; without queries among the members alone.

    members: in Gray order. Links are between queries and members.
    """
    index = GrayIndex(members)
    nodes = members if queries is None else np.concatenate([members, queries])
    asked = nodes[members.size :] if queries is not None else members
    shift = members.size if queries is not None else 0
    top = np.arange(nodes.size)
    for q, leaf in index.search(asked, distance, np.arange(members.size) if queries is None else None):
        top = joined(top, q + shift, leaf)
    moved = np.flatnonzero(top != np.arange(nodes.size))
    return nodes[moved], nodes[top[moved]]


def _packed(prints: DataFrame, members: int) -> DataFrame:
    """(group, size, every, some, members): distinct fingerprints in Gray order, a row for each range partition."""
    n = prints.count()
    groups = max(1, min(GROUPS, -(-n // members)))

    def pack(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        parts = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if parts:
            fps = np.concatenate(parts).view(np.uint64)
            fps = fps[np.argsort(gray_rank(fps), kind="stable")]
            ends = [int(x.view(np.int64)) for x in (np.bitwise_and.reduce(fps), np.bitwise_or.reduce(fps))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([fps.size], pa.int64()), pa.array(ends[:1], pa.int64()), pa.array(ends[1:], pa.int64()), pa.array([fps.tobytes()], pa.large_binary())],
                names=["group", "size", "every", "some", "members"])

    ranged = prints.select("fp", _rank(F.col("fp")).alias("rank")).repartitionByRange(groups, "rank").select("fp")
    return ranged.mapInArrow(tidy(pack), "group int, size long, every long, some long, members binary")


def edges_of(prints: DataFrame, distance: int = DISTANCE, members: int = MEMBERS) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) that connect all that link."""
    large_strings(prints)
    spark = prints.sparkSession
    groups = stored(_packed(prints, members), "simhash-groups")
    patterns = groups.select("group", "every", "some").toArrow()  # GROUPS rows at most
    numbers, every, some = (patterns.column(c).to_numpy() for c in ("group", "every", "some"))
    order = np.argsort(gray_rank(every.view(np.uint64)), kind="stable")
    numbers, every, some = numbers[order], every.view(np.uint64)[order], some.view(np.uint64)[order]
    shared = spark.sparkContext.broadcast((numbers, every, ~(every ^ some)))

    def route(batches: Iterator[pa.RecordBatch]):
        """Each group's members to the groups that may hold a link of theirs, and the group to itself."""
        number, value, mask = shared.value
        upper = GrayIndex(value & mask, mask)
        for batch in batches:
            for group, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                fps = np.frombuffer(packed.as_py(), np.uint64)
                targets: dict[int, list[np.ndarray]] = {}
                for q, leaf in upper.search(fps, distance):
                    to = number[leaf]
                    # a pair of groups meets once, in the one or the other by turns
                    ours = (to != group) & ((to > group) == ((to + group) % 2 == 0))
                    q, to = q[ours], to[ours]
                    by = np.argsort(to, kind="stable")
                    cut = np.flatnonzero(np.diff(to[by], prepend=-1))
                    for t, part in zip(to[by][cut].tolist(), np.split(by, cut[1:])):
                        targets.setdefault(t, []).append(q[part])
                asked = {group: None} | {t: fps[np.concatenate(found)] for t, found in targets.items()}
                sizes = [fps.size if x is None else x.size for x in asked.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(asked), pa.int32()), pa.array(sizes, pa.int64()), pa.array([None if x is None else x.tobytes() for x in asked.values()], pa.large_binary())], names=["group", "n", "queries"])

    def link(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for queries, packed in zip(batch.column(0), batch.column(1)):
                a, b = links(np.frombuffer(packed.as_py(), np.uint64), None if queries.as_py() is None else np.frombuffer(queries.as_py(), np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    meetings = stored(groups.select("group", "members").mapInArrow(tidy(route), "group int, n long, queries binary"), "simhash-meetings")
    count, total = meetings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n = max(1, min(count, GROUPS, -(-total // members)))  # a task for each so many queries
    met = meetings.join(groups.select("group", "members"), "group").select("queries", "members").repartition(n)
    return met.mapInArrow(tidy(link), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b) by alternating large-star and small-star rounds."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    edges = stored(edges.filter("a <> b").distinct(), "components")
    mark = None
    while True:
        before, edges = edges, stored(star(star(edges, True), False), "components")
        discard(before)
        # both stars leave the edges as they were once every node points at its root
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(documents, shingle), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = components(edges_of(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "simhash-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
