"""Spelling variants: words that differ by one code point, found by range reporting in two dimensions.

Words of one length, and those one shorter, stand in two orders: by their code points forward, and backward. A word
and an edit position ask for the words that share what is before the position (an interval of the forward order) and
what is after it (an interval of the backward order); a wavelet tree over the backward ranks in forward order reports
the words in both. One search with equal lengths finds replaced code points, one from shorter to longer words finds
inserted and deleted ones. Positions at which either interval holds the word alone are never asked for.

Words are dealt to tasks by what they must share. A pair's edit lies in the first or the second half of the word, so
both share the other half, and each word goes to the groups of its two halves (for its own length and the next one).
A group of over HOT words is cut again: half of its range of positions in each part, with more of the word shared. It
ends at a single position, where words differ in one code point only, so a group is as large as the alphabet at most.

Null texts have no words; a null doc_id counts as an empty one; repeated rows count again; other columns are ignored;
a text of any length is read whole. No words give an empty table.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, large_strings, stored, tidy

#: Fixed values of the contract.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Words of a group beyond which it is cut again, and bytes of the words that a task searches together.
HOT = 20_000
TOGETHER = 4 << 20
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000


def words(documents: DataFrame, least: int = 7, damage: int = 31) -> DataFrame:
    """(word, n) of all runs of letters, counted over all documents, some with a code point deleted by the contract's rule."""
    large_strings(documents)

    def run(batches: Iterator[pa.RecordBatch]):
        held: Counter[str] = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                found = Counter(x for x in _RUN.findall(value.as_py() or "") if len(x) >= least)
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for run, n in found.items():
                    run = run.translate(_LOWER)
                    h = zlib.crc32(run.encode(), start)
                    if not h % damage:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    texts = documents.select(F.col("doc_id").cast("string").alias("doc"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """Positions of a sequence of distinct numbers 0 to n - 1, by ranges of places and of numbers."""

    def __init__(self, numbers: np.ndarray):
        self.levels = max(1, int(numbers.size - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        now = numbers.astype(np.int64)
        for level in reversed(range(self.levels)):
            low = (now >> level & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            now = np.concatenate([now[low], now[~low]])

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) of all numbers in [low, high) that stand in places [first, last), for many queries at once."""
        query, value = np.arange(first.size), np.zeros(first.size, np.int64)
        for depth, zeros in enumerate(self.zeros):
            level = self.levels - 1 - depth
            a, b, total = zeros[first], zeros[last], zeros[-1]
            query, value = np.concatenate([query, query]), np.concatenate([value, value | 1 << level])
            first, last = np.concatenate([a, first - a + total]), np.concatenate([b, last - b + total])
            # what is left spans value to value + 2 ** level - 1
            keep = (first < last) & (value < high[query]) & (value + (1 << level) > low[query])
            query, value, first, last = query[keep], value[keep], first[keep], last[keep]
        return query, value


class _Order:
    """Words (rows of bytes) in order, with what neighbours share, and intervals of words that share so much."""

    def __init__(self, cells: np.ndarray):
        n, width = cells.shape
        self.order = np.argsort(np.ascontiguousarray(cells).view(f"S{width}").ravel(), kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        sorted_ = cells[self.order]
        same = sorted_[1:] == sorted_[:-1]
        shared = np.where(same.all(axis=1), width, np.argmin(same, axis=1)) if n > 1 else np.zeros(0, np.int64)
        self.least = [shared.astype(np.int32)]  # of 1, 2, 4, ... neighbours from each place on
        while 2 << len(self.least) - 1 <= shared.size:
            half, now = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(now[:-half], now[half:]))
        ends = np.concatenate([[0], shared, [0]])
        self.most = np.maximum(ends[:-1], ends[1:])[self.rank]  # shared with the nearer neighbour, of each word

    def interval(self, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) places of the words that share the first size bytes with each word."""
        first, last = self.rank[word].copy(), self.rank[word].copy()
        for k in reversed(range(len(self.least))):
            least, step = self.least[k], 1 << k
            can = last + step <= self.least[0].size
            last = np.where(can & (least[np.minimum(last, least.size - 1)] >= size), last + step, last)
            at = first - step
            can = at >= 0
            first = np.where(can & (least[np.maximum(at, 0)] >= size), at, first)
        return first, last + 1


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for each number from low to high (exclusive) of each row."""
    size = np.maximum(high - low, 0)
    row = np.repeat(np.arange(size.size), size)
    return row, np.arange(row.size) - np.repeat(np.cumsum(size) - size, size) + low[row]


def near_in_group(cells: np.ndarray, short: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows that are near by an edit at a position from low to high (exclusive) of the longer word.

    cells: code points of distinct words, one a row; short: rows of one code point less, ended by 0. j is never short.
    Each pair of two long words comes in both directions, each pair of a short and a long word once, at its leftmost
    position: where the inserted code point isn't the one before it.
    """
    n, width = cells.shape
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    size = width - short.astype(np.int64)
    back = cells[:, ::-1].copy()
    back[short] = np.concatenate([back[short, 1:], np.zeros((int(short.sum()), 1), cells.dtype)], axis=1)  # the end mark last again
    forth, back = _Order(cells), _Order(back)
    # before position p, p code points are shared; after it, width - 1 - p, as the edit takes one of the longer word
    at, p = _ranges(np.maximum(low, width - 1 - back.most), np.minimum(high, forth.most + 1))
    if not at.size:
        return none, none
    inserted = short[at]
    first, last = forth.interval(at, p)
    under, over = back.interval(at, width - 1 - p)
    # places and ranks among long words only
    long_forth = np.concatenate([[0], np.cumsum(~short[forth.order])])
    long_back = np.concatenate([[0], np.cumsum(~short[back.order])])
    first, last, under, over = long_forth[first], long_forth[last], long_back[under], long_back[over]
    some = np.flatnonzero((last - first > ~inserted) & (over - under > ~inserted))  # more than the word itself
    if not some.size:
        return none, none
    longs_forth, longs_back = forth.order[~short[forth.order]], back.order[~short[back.order]]
    tree = WaveletTree(long_back[back.rank[longs_forth]])
    found_i, found_j = [], []
    for part in np.array_split(some, -(-some.size // 100_000)):
        query, rank = tree.report(first[part], last[part], under[part], over[part])
        q, j = part[query], longs_back[rank]
        i, place = at[q], p[q]
        new = cells[j, place]
        leftmost = (place == 0) | (cells[j, np.maximum(place - 1, 0)] != new)
        good = np.where(short[i], leftmost, new != cells[i, np.minimum(place, width - 1)])
        found_i.append(i[good])
        found_j.append(j[good])
    return np.concatenate(found_i), np.concatenate(found_j)


_ENTRY = ("word", "n", "size", "low", "high")


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry once for either half of its range of positions."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))).alias("half")
    return entries.select("word", "n", "size", halves).select("word", "n", "size", "half.low", "half.high")


def _keyed(entries: DataFrame) -> DataFrame:
    """Entries with a key: the longer word's length, the range, and what is shared on either side of it."""
    after = F.col("size") - F.col("high")
    key = F.xxhash64("size", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.when(after > 0, F.substring("word", -after, after)).otherwise(""))
    return entries.select(*_ENTRY, key.alias("key"))


def near_words(vocabulary: DataFrame, hot: int = HOT, together: int = TOGETHER) -> DataFrame:
    """(word, other, n): each word with each near one and that one's n. vocabulary: distinct words (code points under 256) and n."""
    length = F.length("word")
    ranges = F.explode(F.array(length, length + 1)).alias("size")
    todo = vocabulary.select("word", "n", ranges).withColumns({"low": F.lit(0), "high": F.col("size")})
    ready, scratch = [], []
    while True:
        keyed = stored(_keyed(_halved(todo)), "spelling-entries")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.max(F.col("high") - F.col("low")).alias("span"))
        large = stored(sizes.filter((F.col("members") > hot) & (F.col("span") > 1)).select("key"), "spelling-large")
        scratch += [keyed, large]
        if large.isEmpty():
            ready.append(keyed)
            break
        ready.append(keyed.join(large, "key", "left_anti"))
        todo = keyed.join(large, "key", "left_semi")
    ready = functools.reduce(DataFrame.unionByName, ready)
    total = ready.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // together))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("word", "ascending")])
        sizes = table.column("size").to_numpy()
        text = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        n, low, high = (table.column(c).to_numpy() for c in ("n", "low", "high"))
        out = []
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), sizes.size]
        for a, b in zip(cuts, cuts[1:]):
            distinct = [a, *(k for k in range(a + 1, b) if text[k] != text[k - 1])]
            if len(distinct) < 2:
                continue
            width = int(sizes[a])
            cells = np.array([text[k] for k in distinct], f"S{width}").view(np.uint8).reshape(len(distinct), width)
            owner = np.repeat(np.arange(len(distinct)), np.diff([*distinct, b]))
            short = np.array([len(text[k]) < width for k in distinct])
            for x, y in sorted(set(zip(low[a:b].tolist(), high[a:b].tolist()))):  # each range is searched alone
                mine = np.flatnonzero((low[a:b] == x) & (high[a:b] == y))
                rows = owner[mine]
                i, j = near_in_group(cells[rows], short[rows], x, y)
                out.append((mine[i] + a, mine[j] + a, short[rows[i]]))
        empty = np.zeros(0, np.int64)
        i, j = (np.concatenate([o[k] for o in out]) if out else empty for k in (0, 1))
        both = np.concatenate([o[2] for o in out]) if out else np.zeros(0, bool)
        left, right = np.concatenate([i, j[both]]), np.concatenate([j, i[both]])  # a shorter word's pair stands both ways
        names = table.column("word").combine_chunks()
        return pa.table({"word": names.take(pa.array(left)).cast(pa.string()), "other": names.take(pa.array(right)).cast(pa.string()), "n": pa.array(n[right], pa.int64())})

    pairs = ready.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(run, "word string, other string, n long")
    pairs.scratch_tables = scratch
    return pairs


def variants(vocabulary: DataFrame, times: int = 10, **settings) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n. The form is the near word of largest n, if that is times the word's."""
    pairs = near_words(vocabulary, **settings)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "other")).alias("best"))
    form = F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best.other"))
    rows = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.minus")).alias("form_n"))
    rows = stored(rows, "spelling-forms")
    discard(*pairs.scratch_tables)
    # follow forms, twice as far each time; n grows by the factor at every step, so this ends
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    old = None
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        grown = stored(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if old is not None:
            discard(old)
        old = grown
        if grown.filter("moved").isEmpty():
            break
        links = grown.select("word", "root")
    return rows.join(grown.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, **settings) -> DataFrame:
    """The contract's query: words of 7 code points and 2 occurrences or more, and forms of ten times their n."""
    vocabulary = stored(words(documents).filter("n >= 2"), "spelling-words")
    return variants(vocabulary, **settings)
