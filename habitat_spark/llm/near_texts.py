"""Near-duplicate texts by SimHash and exact Jaccard similarity of their word shingles, for a stage of the corpus pipeline.

A text's set holds the hashes of its 5-word shingles, after A-Z are lower-cased; words are separated by white space
(0x20, 0x09-0x0D); a text of fewer words is one shingle, one without words (nulls too) has an empty set. Texts with
the same set are one node; nodes link if SimHash fingerprints of their sets differ by 3 bits or fewer, as operator 6's
Gray-order index tells, or at a Jaccard similarity of 0.8 or more. Most fingerprints of texts that similar are more
than 3 bits apart, and some of less similar ones aren't, so neither way gives all links of the other. The pairs at a
similarity of 0.8 are found in an exact way:

1. Two such sets share a hash among the first n - ceil(0.8 n) + 1 of each, in any order that all texts use. Here
   hashes met in many texts come last, so a common line is no key of texts that have enough of their own.
2. Under each key every node is compared with the smallest one, under its most common key, if CROWD nodes or more have
   it, with about PIVOTS of them, and components are taken of what links: a large group of near copies grows together
   here, though not all of it links to one text.
3. Under keys whose nodes are still in several components, nodes of other components are compared, if the key leads
   in the smaller one: of a pair that links, the first hash that both have is among the first n - ceil(8 n / 9) + 1 of
   the smaller set. A group of near copies is one component by then, so it never makes all its pairs; texts that share
   a common passage but have as much as a ninth of their own don't have it lead. Keys of the same nodes are one group.
4. A pair is dropped early only by bounds that hold for sure: its sizes, and the bits in which the parities of the
   sets' hashes differ, as they can't be more than the elements that differ. What is left is confirmed on the texts.

Keys go to buckets as packed, sorted arrays, BUCKET_KEYS of them on average, where all but those in several nodes end.
The list of common hashes is cut at COMMON entries: it decides the order, so the cost, and never the result. Common
keys, which may be those of a third of all texts, don't go to buckets: Spark aggregates and joins their rows.
Texts of any length are looked at whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, discard, expand, gram_hashes, hash_spans, large_strings, lower_table, mix, row_counts, runs, slices, squeeze, stored, tidy
from .simhash import components, edges_of, majority

SHINGLE = 5
#: A hash in more texts than this comes last in the order, counted in one of SAMPLE texts: the order is only a matter of cost.
OFTEN = 32
SAMPLE = 16
#: Most hashes in the list of common ones, a broadcast.
COMMON = 1_000_000
#: Nodes that all others of their most common key are compared with, where so many have it.
PIVOTS = 64
CROWD = 512
#: Bits of the parity sketch.
BITS = 1024
#: Most ids that go to every task to pick texts by; more of them meet the texts by a shuffle.
PICKED = 1_000_000
#: Keys of a bucket on average.
BUCKET_KEYS = 1 << 20
_LOWER = lower_table(SPACE)


def sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted shingle hashes of each text of a run."""
    low = _LOWER[data]
    starts, ends = runs(low > 0, offsets)
    words, counts = hash_spans(low, starts, ends), row_counts(starts, offsets)
    grams = gram_hashes(words, SHINGLE)
    out, first = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(grams[first : first + n - SHINGLE + 1]))
        else:
            out.append(mix(gram_hashes(words[first : first + n], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
        first += n
    return out


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def lead_size(n: int) -> int:
    """Of two sets that link, the smaller one, of n, has their first common hash among so many."""
    return n - (8 * n + 8) // 9 + 1 if n else 0


def _sketch(found: np.ndarray) -> list[int]:
    """Parity of the number of hashes at each of BITS places."""
    place = (found & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=BITS) & 1).astype(np.uint8)).view(np.int64).tolist()


def _node(found: np.ndarray) -> int:
    """One number for equal sets."""
    if not found.size:
        return 0
    place = np.arange(1, found.size + 1, dtype=np.uint64)
    return int(mix(np.array([mix(found + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)]))[0].view(np.int64))


def _common(source: DataFrame) -> np.ndarray:
    """Sorted hashes that are in more than OFTEN texts, by a sample of them."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                keys, n = np.unique(np.concatenate(sets(data, offsets)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    met = source.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = met.filter(F.col("n") * SAMPLE > OFTEN).orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow()  # COMMON at most
    return np.sort(rows.column("key").to_numpy().view(np.uint64))


def _nodes(source: DataFrame, common: np.ndarray) -> DataFrame:
    """(id, node, size, fp, sketch, rare, often) of every row; rare and often: its first hashes, packed."""
    shared = source.sparkSession.sparkContext.broadcast(common)
    longs, binaries = ([T.StructField(c, kind) for c in names] for kind, names in ((T.LongType(), ("node", "size", "fp")), (T.BinaryType(), ("rare", "often"))))
    schema = T.StructType([source.schema["id"], *longs, T.StructField("sketch", T.ArrayType(T.LongType())), *binaries])

    def run(batches: Iterator[pa.RecordBatch]):
        list_ = shared.value
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                found = sets(data, offsets)
                rare, often = [], []
                for s in found:
                    last = list_[np.minimum(np.searchsorted(list_, s), list_.size - 1)] == s if list_.size else np.zeros(s.size, bool)
                    n, own = prefix_size(s.size), s[~last]
                    rare.append(own[:n].tobytes())
                    often.append(s[last][: max(0, n - own.size)].tobytes())
                prints = np.array([majority(s) for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([_node(s) for s in found], pa.int64()), pa.array([s.size for s in found], pa.int64()), pa.array(prints),
                    pa.array([_sketch(s) for s in found], pa.list_(pa.int64())), pa.array(rare, pa.binary()), pa.array(often, pa.binary())], names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, size, whether the key leads) of each packed hash of a batch of (node, size, skipped, packed)."""
    node, size, skipped = (batch.column(i).to_numpy() for i in range(3))
    packed = batch.column(3).to_pylist()
    n = np.array([len(x) // 8 for x in packed])
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(skipped, n)
    leads = np.array([lead_size(x) for x in size.tolist()])
    return np.frombuffer(b"".join(packed), np.int64), np.repeat(node, n), np.repeat(size, n), place < np.repeat(leads, n)


_MEMBER = "key long, node long, size long, leads boolean"


def _often(rows: DataFrame) -> DataFrame:
    """(key, node, size, leads, head, n) of the common keys that are in several nodes; head: the smallest of them, n: how many."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = _unpacked(batch)
            for i in range(0, columns[0].size, 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in columns], names=["key", "node", "size", "leads"])

    keyed = rows.filter(F.octet_length("often") > 0).select("node", "size", (F.octet_length("rare") / 8).cast("long").alias("skipped"), "often").mapInArrow(tidy(run), _MEMBER)
    one = keyed.distinct()
    groups = one.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    return one.join(groups, "key")


def _rare(rows: DataFrame, buckets: int) -> DataFrame:
    """The same of the other keys."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys, node, size, leads = _unpacked(batch)
            bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((keys, bucket))
            keys, node, size, leads = (x[order] for x in (keys, node, size, leads))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[b], cut[b + 1])
                some, first, at = np.unique(node[own], return_index=True, return_inverse=True)
                rows.append((b, squeeze(keys[own], True), some.tobytes(), size[own][first].tobytes(), squeeze(2 * at + leads[own])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], names=["bucket", "keys", "nodes", "sizes", "at"])

    def shared(table: pa.Table) -> pa.Table:
        keys = np.concatenate([expand(x.as_py(), True) for x in table.column("keys")])
        at = [expand(x.as_py()) for x in table.column("at")]
        node, size = (np.concatenate([np.frombuffer(x.as_py(), np.int64)[a >> 1] for x, a in zip(table.column(c), at)]) for c in ("nodes", "sizes"))
        leads = np.concatenate(at) & 1 == 1
        order = np.lexsort((node, keys))
        keys, node, size, leads = (x[order] for x in (keys, node, size, leads))
        new = np.ones(keys.size, bool)
        new[1:] = (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])
        keys, node, size, leads = (x[new] for x in (keys, node, size, leads))
        head = np.ones(keys.size, bool)
        head[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(head) - 1
        several = np.bincount(group, minlength=group.size and group[-1] + 1)[group] > 1
        return pa.table({"key": keys[several], "node": node[several], "size": size[several], "leads": leads[several], "head": node[head][group][several]})

    packed = rows.filter(F.octet_length("rare") > 0).select("node", "size", F.lit(0).cast("long").alias("skipped"), "rare").mapInArrow(tidy(run), "bucket int, keys binary, nodes binary, sizes binary, at binary")
    return packed.groupBy("bucket").applyInArrow(shared, f"{_MEMBER}, head long").withColumn("n", F.lit(None).cast("long"))


def _beside_pivots(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of crowded keys with some nodes of their most common one, the same ones for all."""
    crowd = members.filter(F.col("n") >= CROWD)
    own = crowd.groupBy("node").agg(F.max_by(F.struct("key", "size", "leads"), F.struct("leads", "n", "key")).alias("x")).select("node", "x.*")
    pivots = crowd.filter(F.pmod(F.xxhash64("node"), F.col("n")) < PIVOTS).select("key", F.col("node").alias("p"), F.col("size").alias("p_size"), F.col("leads").alias("p_leads"))
    fits = "node <> p and ((leads and size <= p_size and 5 * size >= 4 * p_size) or (p_leads and p_size <= size and 5 * p_size >= 4 * size))"
    return own.join(pivots, "key").filter(fits).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))


def _alike(nodes: DataFrame) -> DataFrame:
    """Links of nodes (a, b) that connect all whose SimHash fingerprints link."""
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-prints")
    side = lambda c: prints.select(F.col("fp").alias(c), F.col("head").alias(f"node_{c}"))
    linked = edges_of(prints.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    same = nodes.select("fp", "node").join(prints, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return linked.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _possible(n: str, m: str, one: str, other: str) -> Column:
    """Whether the sizes and sketches of two sets allow them to link: at 0.8 and more, at most a ninth of both sizes differs."""
    differ = sum((F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(1, BITS // 64)), F.bit_count(F.get(one, F.lit(0)).bitwiseXOR(F.get(other, F.lit(0)))))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * differ <= F.col(n) + F.col(m))


def _possible_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(_possible("size_a", "size_b", "sketch_a", "sketch_b")).select("a", "b")


def _confirmed(pairs: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a Jaccard similarity of at least 0.8."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = {}
                for c in ("text_a", "text_b"):
                    found[c] = [s for _, data, offsets in slices(part, c) for s in sets(data, offsets)]
                keep = []
                for x, y in zip(found["text_a"], found["text_b"]):
                    same = np.intersect1d(x, y, assume_unique=True).size
                    keep.append(5 * same >= 4 * (x.size + y.size - same))
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    asked = stored(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "id"), "near-asked")
    few = asked.limit(PICKED + 1).count() <= PICKED
    texts = stored(source.join(F.broadcast(asked) if few else asked, "id").select("node", "text"), "near-texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")
    edges = stored(both, "near-edges")
    discard(texts, asked)
    return edges


def _several(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(group, node, leads, root, size, m) of the keys whose m nodes are in several components.

    Keys of the same nodes are one group; should two groups have one number, they only make needless pairs.
    """
    placed = stored(members.join(roots, "node", "left").select("key", "node", "size", "leads", F.coalesce("root", "node").alias("root")), "near-placed")
    marks = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    groups = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *marks).filter("low < high").select("key", F.xxhash64("m", "x", "y").alias("group"), "m")
    several = stored(placed.join(groups, "key").groupBy("group", "node").agg(F.max("leads").alias("leads"), *[F.first(c).alias(c) for c in ("root", "size", "m")]), "near-several")
    discard(placed)
    return several


def near_texts(documents: DataFrame, id_column: str, fingerprints: bool = True) -> DataFrame:
    """(id_column, node, root) per row: rows with one root are one component of near copies. The ids are unique and not null.

    fingerprints: whether SimHash links count, or those of a Jaccard similarity of 0.8 alone.
    """
    large_strings(documents)
    source = documents.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    rows = stored(_nodes(source, _common(source)), "near-rows")
    nodes = stored(rows.groupBy("node").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("size", "fp", "sketch")]), "near-nodes")
    total = rows.agg(F.sum(F.octet_length("rare"))).first()[0] or 0
    members = stored(_rare(rows, max(16, -(-total // 8 // BUCKET_KEYS))).unionByName(_often(rows)), "near-members")
    headed = members.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    first = headed.unionByName(_beside_pivots(members)).distinct()
    pairs = stored(_possible_of(first, nodes), "near-pairs")
    edges = _confirmed(pairs, nodes, source)
    if fingerprints:
        edges = edges.unionByName(stored(_alike(nodes), "near-alike"))
    roots = components(edges)
    discard(pairs)
    several = _several(members, roots)
    several = stored(several.join(nodes.select("node", "sketch"), "node"), "near-sketched")
    smaller = several.filter("leads").select("group", F.col("node").alias("x"), F.col("root").alias("of"), F.col("size").alias("n"), F.col("sketch").alias("own"))
    # the smaller set of a pair, of equal ones either; pairs that can't link aren't made
    fits = (F.col("root") != F.col("of")) & (F.col("n") <= F.col("size")) & _possible("n", "size", "own", "sketch")
    second = smaller.join(several.select("group", "node", "root", "size", "sketch"), "group").filter(fits).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
    pairs = stored(second.distinct(), "near-pairs")
    discard(members, several)
    roots = components(edges.unionByName(_confirmed(pairs, nodes, source)))
    discard(pairs, nodes)
    return rows.select("id", "node").join(roots, "node", "left").select(F.col("id").alias(id_column), "node", F.coalesce("root", "node").alias("root"))
