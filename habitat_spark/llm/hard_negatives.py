"""Hard negatives of anchors by a blocked matrix multiply in two dimensions.

Scores are whole numbers: components are floored after a scaling, and a score is an inner product. Anchors are cut
into blocks of ANCHORS rows, all rows into blocks of ROWS, and both into chunks of WIDTH dimensions. A task multiplies
one chunk of an anchor block with the same chunk of a row block; the partial tiles of 64-bit integers are shuffled by
their tile and added. Each whole tile then gives its best rows of the anchor's label, and of the others what a window
can reach; top lists of the tiles are reduced to those of the anchor, and of each window of an anchor and a positive.

What a tile leaves out can't be in a result: scores under the window of the tile's own last positive (the anchor's
last is no less), and among other labels' rows of equal score those after the first few by id (a window holds all of
a score or none). So ties and copies don't pile up, whatever share of the rows they are.

The anchors are a stated query set, met by all rows in blocks; both sides are dealt to a grid of tasks, where an
anchor block is copied once for each column of the grid, and neither side is broadcast.

Rows with a null label or vector, or a null, infinite or NaN component, take no part. Vectors of unequal length score
by their common components; an empty one scores 0. Null ids are never anchors, keep their label and come last in
ties. Repeated rows are rows of their own. An anchor without positives, or without rows in a window, gives no rows,
and neither does an empty table. Components beyond 64 bits are held at the ends of that range, and sums wrap around.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, expand, large_strings, squeeze, stored, tidy

#: Rows of a block of anchors and of a block of all rows, and dimensions of a chunk.
ANCHORS = 512
ROWS = 2048
WIDTH = 32
_LAST = np.iinfo(np.int64).max


def quantised(rows: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """The rows that take part: vec_id, label (long), q (array of long)."""
    usable = F.col("label").isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    # floor of a double is held at the ends of the 64-bit range
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("q"))


def _blocks(rows: DataFrame, count: int, width: int, chunks: int, name: str) -> DataFrame:
    """(block, chunk, uids, ids, labels, cells): rows dealt to blocks by a hash of uid, their chunk of dimensions end to end."""
    block = F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int").alias("block")
    at = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    cut = F.slice("q", F.col("chunk") * width + 1, F.lit(width))
    padded = F.concat(cut, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(cut)))
    parts = rows.select(block, "uid", "vec_id", "label", "q", at).select("block", "chunk", F.struct("uid", "vec_id", "label", padded.alias("cells")).alias("row"))
    held = parts.groupBy("block", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return held.select(
        F.col("block").alias(name), "chunk", F.col("rows")["uid"].alias(f"{name}_uids"), F.col("rows")["vec_id"].alias(f"{name}_ids"),
        F.col("rows")["label"].alias(f"{name}_labels"), F.flatten(F.col("rows")["cells"]).alias(f"{name}_cells"),
    )


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of two integer matrices: by doubles where they are exact, else modulo 2 ** 64."""
    most = float(max(abs(float(a.min(initial=0))), abs(float(a.max(initial=0))))) * float(max(abs(float(b.min(initial=0))), abs(float(b.max(initial=0))))) * a.shape[1]
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def tile_lists(scores: np.ndarray, anchors: tuple, rows: tuple, positives: int, negatives: int, low: int, high: int):
    """Of each anchor of a whole tile: its best rows of the same label, and the other rows that its windows can reach.

    anchors and rows: (uids, ids, labels). Yields (anchor, True, places) and (anchor, False, places), by score and id.
    """
    uids, ids, labels = rows
    for i in range(len(anchors[0])):
        s = scores[i]
        mine = np.flatnonzero((labels == anchors[2][i]) & (uids != anchors[0][i]))
        if mine.size > positives:  # all ties of the last place stay for the sort
            mine = mine[s[mine] >= np.partition(s[mine], mine.size - positives)[mine.size - positives]]
        mine = mine[np.lexsort((ids[mine], -s[mine]))][:positives]
        least = int(s[mine[-1]]) if mine.size == positives and positives else 0
        least = max(0, -(-low * least // high))  # windows of negative positives are empty
        other = np.flatnonzero((labels != anchors[2][i]) & (s >= least))
        other = other[np.lexsort((ids[other], -s[other]))]
        if other.size > negatives:
            value = s[other]
            later = np.zeros(other.size, bool)
            later[negatives:] = value[negatives:] == value[:-negatives]
            other = other[~later]
        yield i, True, mine
        yield i, False, other


def hard_negatives(
    vectors: DataFrame, vector: str = "embedding", anchor: Column | None = None, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: int = 256, anchor_rows: int = ANCHORS, block_rows: int = ROWS, width: int = WIDTH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors; label: their labels for all that follows; both over vec_id and label. Of each
    anchor and positive the first negatives of other labels with low * positive_score <= high * negative_score <=
    high * positive_score.
    """
    if not 0 <= low <= high:
        raise ValueError("0 <= low <= high must hold")
    large_strings(vectors)
    spark = vectors.sparkSession
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    label = F.col("label") if label is None else label
    rows = quantised(vectors, vector, scale).withColumn("label", label.cast("long")).withColumn("uid", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))), "negatives-rows")
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    chunks, ours, theirs = max(1, math.ceil(dims / width)), max(1, math.ceil(n_anchors / anchor_rows)), max(1, math.ceil(n / block_rows))
    columns = min(theirs, max(1, math.ceil(4 * spark.sparkContext.defaultParallelism / (ours * chunks))))  # of the grid of tasks

    a = _blocks(rows.filter("anchor"), ours, width, chunks, "a").withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    b = _blocks(rows, theirs, width, chunks, "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(ours - 1)))).withColumn("column", F.col("b") % columns)
    meet = a.join(b, ["a", "chunk", "column"]).select("a", "b", "a_cells", "b_cells")

    def multiplied(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (np.asarray(batch.column(c)[k].values, np.int64).reshape(-1, width) for c in (2, 3))
                part = squeeze(product(x, y).ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([part], pa.large_binary())], names=["a", "b", "part"])

    parts = meet.mapInArrow(tidy(multiplied), "a int, b int, part binary")
    # the tile's rows come with it once, from the first chunk
    who = lambda x, name: x.filter("chunk = 0").select(name, f"{name}_uids", f"{name}_ids", f"{name}_labels")
    heads = who(_blocks(rows.filter("anchor"), ours, width, 1, "a"), "a"), who(_blocks(rows, theirs, width, 1, "b"), "b")
    found = "anchor long, anchor_id long, mate boolean, ids array<long>, scores array<long>"
    arrow = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("mate", pa.bool_()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])

    def added(tiles: pa.Table) -> pa.Table:
        head = next(r for r in range(tiles.num_rows) if tiles.column("a_uids")[r].is_valid)
        column = lambda name: np.array([_LAST if v is None else v for v in tiles.column(name)[head].as_py()], np.int64)
        ours, theirs = ([column(f"{x}_{y}") for y in ("uids", "ids", "labels")] for x in "ab")
        scores = np.zeros(ours[0].size * theirs[0].size, np.int64)
        for part in tiles.column("part"):
            if part.is_valid:
                scores += expand(part.as_py())
        scores = scores.reshape(ours[0].size, -1)
        lists = tile_lists(scores, ours, theirs, positives, negatives, low, high)
        out = [(int(ours[0][i]), int(ours[1][i]), mate, theirs[1][at], scores[i, at]) for i, mate, at in lists if at.size]
        return pa.Table.from_arrays([pa.array([x[k] for x in out], arrow.types[k]) for k in range(5)], schema=arrow)

    # uids and labels travel with one row for each tile: partial tiles and that row meet in the group
    tiles = heads[0].withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1)))).join(heads[1], "b").withColumn("part", F.lit(None).cast("binary"))
    lists = stored(parts.unionByName(tiles, allowMissingColumns=True).groupBy("a", "b").applyInArrow(added, found), "negatives-lists")

    null = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    mates = lists.filter("mate").select("anchor", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("anchor", "x.*")
    best = W.partitionBy("anchor").orderBy(F.desc("scores"), "ids")
    mates = mates.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).filter("scores >= 0")
    windows = mates.groupBy("anchor").agg(F.collect_list(F.struct("place", "ids", "scores")).alias("windows"))  # positives at most
    reach = lists.filter("not mate").join(windows, "anchor").withColumn("w", F.explode("windows"))
    floor = F.ceil(F.col("w")["scores"].cast("decimal(20,0)") * low / high)
    inside = F.filter(F.arrays_zip("ids", "scores"), lambda x: (x["scores"] >= floor) & (x["scores"] <= F.col("w")["scores"]))
    near = reach.select("anchor", "anchor_id", "w", F.explode(F.slice(inside, 1, negatives)).alias("x"))
    first = W.partitionBy("anchor", "w.place").orderBy(F.desc("x.scores"), "x.ids")
    near = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives).select("anchor_id", F.col("w.ids").alias("positive"), "rank", F.col("x.ids").alias("negative"), F.col("w.scores").alias("positive_score"), F.col("x.scores").alias("negative_score"))
    return near.select("anchor_id", null("positive").alias("positive_id"), "rank", null("negative").alias("negative_id"), "positive_score", "negative_score")


def mined(vectors: DataFrame, **settings) -> DataFrame:
    """The contract's query: ids divisible by 100 are anchors, ids divisible by 7 have the next label modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, label=label, **settings)
