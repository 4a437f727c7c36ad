"""Language-model scoring by Katz backoff: bigrams with Good-Turing discounts over smoothed unigrams.

Words are separated by white space (0x20, 0x09-0x0D), A-Z are lower-cased; each text ends with one end token, which
is also the history of its first token. Unigrams: every training token's exact count, add 0.1, with room for one
unknown token. Bigrams: all of every training text. A bigram seen r times has Katz's discount for r <= 5; the mass that
a history leaves goes to its unseen words in proportion to their unigrams, with the backoff weight that makes all sum
to one; a history never seen has the unigrams themselves. Words are told apart by 63 bits of a hash.

The VOCABULARY most frequent words are *listed*: their counts and, as histories, their backoff weights go to every
task. That decides where a number is looked up, never what it is. Tables, each in buckets of about BUCKET_BYTES of
text, packed and sorted:

- pairs of a listed word after any history, by history (histories among the FREQUENT most frequent are spread by word
  too, so no bucket grows with one history), the HOT most frequent of them also in every task;
- pairs of an unlisted word after any history, by word, which also gives the word's own count;
- counts and backoff weights of unlisted histories, by history.

A text's tokens ask the buckets in packed runs of texts, each for what isn't in the task: a pair's count, its word's
count, its history's count and weight. An unlisted word after an unlisted history asks for its pair first and then for
the history. The answers are sums for each text of a run, added up where the run's texts are together again.

Null texts are empty: one end token. A null doc_id counts as empty text in the split. Repeated rows are scored and
counted one by one; other columns are ignored. With no training text every token has the same unigram probability.
Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SPACE, discard, expand, hash_spans, large_strings, lower_table, mix, row_counts, run_number, runs, slices, squeeze, stored, tidy
from .quality_classifier import remainder

VOCABULARY = 400_000
HOT = 200_000
FREQUENT = 256
ADD = 0.1
KATZ = 5
#: Distinct keys that a counting task holds before it passes them on.
HELD = 2_000_000
#: Text for each bucket, as long as there are no more than MANY; then buckets grow, up to LARGE_BYTES.
BUCKET_BYTES = 6 << 20
MANY = 4096
LARGE_BYTES = 24 << 20
#: Both grow with the buckets, so that a row for a bucket stays worth its cost: text behind one at least and text of a
#: run at most; pairs held for one, and pairs held at most.
SHARE, RUN_BYTES = 8 << 10, 24 << 20
HELD_SHARE, HELD_MOST = 1000, 6_000_000
_LOWER = lower_table(SPACE)
_END = 0  # ids of listed words are 1 and on; unlisted ones are -1 - hash
_SHIFT = 32
_MASK = (1 << _SHIFT) - 1
#: Kinds of rows: pairs of listed words, of a listed word after an unlisted one, of an unlisted word; of a history's sums, and frequent pairs.
_LISTED, _AFTER_RARE, _RARE, _SUMS, _TOP = range(5)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (63 bits) of a run of texts and the number of words of each."""
    low = _LOWER[data]
    starts, ends = runs(low > 0, offsets)
    return (hash_spans(low, starts, ends) >> np.uint64(1)).astype(np.int64), row_counts(starts, offsets)


def _summed(keys: list[tuple[np.ndarray, ...]], counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys (of one or two columns, in order of the first) and the sum of the counts of each."""
    columns, n = [np.concatenate(x) for x in zip(*keys)], np.concatenate(counts)
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns, n = [c[order] for c in columns], n[order]
    heads = _heads(*columns)
    return *(c[heads] for c in columns), np.add.reduceat(n, heads) if n.size else n


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places at which a run of equal values of sorted columns begins."""
    new = np.ones(columns[0].size, bool)
    if new.size:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _find(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted table, whether it is there)."""
    if not table.size:
        return np.zeros(asked.size, np.int64), np.zeros(asked.size, bool)
    at = np.minimum(np.searchsorted(table, asked), table.size - 1)
    return at, table[at] == asked


def _pairs_in(first: np.ndarray, second: np.ndarray, asked_first: np.ndarray, asked_second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs; the table is sorted by first and then second."""
    a, b = np.unique(first), np.unique(second)
    (at_a, in_a), (at_b, in_b) = _find(a, asked_first), _find(b, asked_second)
    at, there = _find(np.searchsorted(a, first) * max(b.size, 1) + np.searchsorted(b, second), at_a * max(b.size, 1) + at_b)
    return at, there & in_a & in_b


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _unigrams(source: DataFrame) -> DataFrame:
    """(hash, n) of all training words."""
    def run(batches: Iterator[pa.RecordBatch]):
        keys: list = []
        counts: list = []

        def give():
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][0]), pa.array(counts[0])], names=["hash", "n"])

        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                words, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
                if words.size:
                    keys.append((words,))
                    counts.append(n)
            if keys:
                k, n = _summed(keys, counts)
                keys[:], counts[:] = [(k,)], [n]
                if k.size > HELD:
                    yield from give()
                    keys.clear(), counts.clear()
        if keys:
            yield from give()

    counted = source.filter("not held_out").select("text").mapInArrow(tidy(run), "hash long, n long")
    return counted.groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The listed words: sorted hashes with ids, and training counts by id."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    total: float

    def chain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(histories, words, row of each token), end tokens included."""
        hashes, counts = _tokens(data, offsets)
        at, there = _find(self.hashes, hashes)
        sizes = counts + 1
        tokens = np.full(sizes.sum(), _END, np.int64)
        place = np.ones(tokens.size, bool)
        place[np.cumsum(sizes) - 1] = False
        tokens[place] = np.where(there, self.ids[at], -1 - hashes) if self.ids.size else -1 - hashes
        return np.concatenate([[_END], tokens[:-1]]), tokens, np.repeat(np.arange(sizes.size), sizes)


def _spread(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _history_bucket(history: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    # ids are in order of frequency, so the most frequent histories have the least ids
    return _spread(history + np.where((history >= 0) & (history < FREQUENT), word << 24, 0), buckets)


def _dealt(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' parts in each bucket, in the order they had."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, [c[order[cut[b] : cut[b + 1]]] for c in columns]


_PACKED = "kind int, bucket int, x1 binary, x2 binary, x3 binary, x4 binary, x5 binary, n_r array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (kind, bucket, up to five packed columns, numbers of pairs seen 1 to KATZ + 1 times or None)."""
    packed = [[*r[2], *[None] * (5 - len(r[2]))] for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([x[i] for x in packed], pa.binary()) for i in range(5)), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
        names=["kind", "bucket", "x1", "x2", "x3", "x4", "x5", "n_r"])


def _sums(history: np.ndarray, counts: np.ndarray, weights: np.ndarray, buckets: int) -> list[tuple]:
    """Packed rows of each history's sums, by its bucket: tokens, pairs seen 1 to KATZ times, weights of its words."""
    if not history.size:
        return []
    order = np.argsort(history, kind="stable")
    history, counts, weights = history[order], counts[order], weights[order]
    heads = _heads(history)
    columns = [np.add.reduceat(x, heads) for x in (counts, *((counts == r).astype(np.int64) for r in range(1, KATZ + 1)))]
    mass = np.add.reduceat(weights, heads)
    return [(_SUMS, b, [squeeze(h, True), b"".join(x.tobytes() for x in ints), m.tobytes()], None) for b, (h, *ints, m) in _dealt(_spread(history[heads], buckets), buckets, history[heads], *columns, mass)]


def _pair_tables(source: DataFrame, shared, buckets: int) -> DataFrame:
    """Packed rows of all training bigrams: one for each bucket of listed and of unlisted words, and histories' sums."""
    def run(batches: Iterator[pa.RecordBatch]):
        words = shared.value
        held: dict[str, list] = {"listed": [], "n": [], "rare": [], "m": []}

        def give():
            rows = []
            if held["listed"]:
                keys, counts = _summed(held["listed"], held["n"])
                for b, (k, c) in _dealt(_history_bucket(keys >> _SHIFT, keys & _MASK, buckets), buckets, keys, counts):
                    rows.append((_LISTED, b, [squeeze(k, True), squeeze(c)], None))
            if held["rare"]:
                history, word, counts = _summed(held["rare"], held["m"])
                some = word >= 0
                for b, (h, w, c) in _dealt(_spread(history[some], buckets), buckets, history[some], word[some], counts[some]):
                    rows.append((_AFTER_RARE, b, [squeeze(h, True), squeeze(w), squeeze(c)], None))
                history, word, counts = history[~some], word[~some], counts[~some]
                for b, (h, w, c) in _dealt(_spread(word, buckets), buckets, history, word, counts):
                    by = np.argsort(w, kind="stable")
                    rows.append((_RARE, buckets + b, [squeeze(w[by], True), squeeze(h[by]), squeeze(c[by])], None))
            for x in held.values():
                x.clear()
            for i in range(0, len(rows), 256):
                yield _rows(rows[i : i + 256])

        size, most = 0, min(max(HELD, buckets * HELD_SHARE), HELD_MOST)
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                history, word, _ = words.chain(data, offsets)
                both = (history >= 0) & (word >= 0)
                keys, n = np.unique(history[both] << _SHIFT | word[both], return_counts=True)
                held["listed"].append((keys,))
                held["n"].append(n)
                rare = history[~both], word[~both]
                held["rare"].append(rare)
                held["m"].append(np.ones(rare[0].size, np.int64))
                size += keys.size + rare[0].size
                if size > most:
                    keys, n = _summed(held["listed"], held["n"])
                    held["listed"], held["n"] = [(keys,)], [n]
                    *rare, m = _summed(held["rare"], held["m"])
                    held["rare"], held["m"] = [tuple(rare)], [m]
                    size = keys.size + m.size
                    if size > most // 2:
                        yield from give()
                        size = 0
        yield from give()

    def merge(table: pa.Table) -> pa.Table:
        words = shared.value
        weights = words.counts + ADD
        place = table.column("bucket")[0].as_py()
        get = lambda kind, *rising: [[expand(r[f"x{i + 1}"], up) for i, up in enumerate(rising)] for r in rows if r["kind"] == kind]
        rows = table.to_pylist()
        out = []
        numbers = np.zeros(KATZ + 1, np.int64)
        if place < buckets:
            keys = counts = top = np.zeros(0, np.int64)
            if parts := get(_LISTED, True, False):
                keys, counts = _summed([(k,) for k, _ in parts], [c for _, c in parts])
                out += _sums(keys >> _SHIFT, counts, weights[keys & _MASK], buckets)
                numbers += [(counts == r).sum() for r in range(1, KATZ + 2)]
                top = np.sort(np.argsort(-counts, kind="stable")[: max(1, 2 * HOT // buckets)])
                out.append((_TOP, place, [squeeze(keys[top], True), squeeze(counts[top])], None))
            h = w = c = np.zeros(0, np.int64)
            if parts := get(_AFTER_RARE, True, False, False):
                h, w, c = _summed([(h, w) for h, w, _ in parts], [c for *_, c in parts])
                out += _sums(h, c, weights[w], buckets)
                numbers += [(c == r).sum() for r in range(1, KATZ + 2)]
            out.append((_LISTED, place, [squeeze(keys, True), squeeze(counts), squeeze(h, True), squeeze(w), squeeze(c)], numbers.tolist()))
        else:
            parts = get(_RARE, True, False, False)
            w, h, c = _summed([(w, h) for w, h, _ in parts], [c for *_, c in parts])
            heads = _heads(w)
            of = np.repeat(np.add.reduceat(c, heads), np.diff(np.append(heads, w.size)))
            out += _sums(h, c, of + ADD, buckets)
            numbers += [(c == r).sum() for r in range(1, KATZ + 2)]
            out.append((_RARE, place - buckets, [squeeze(w, True), squeeze(h), squeeze(c)], numbers.tolist()))
        return pa.Table.from_batches([_rows(out)])

    counted = source.filter("not held_out").select("text").mapInArrow(tidy(run), _PACKED)
    return counted.groupBy("bucket").applyInArrow(merge, _PACKED)


def discounts(n_r: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 to KATZ (0 unused) from the numbers of bigrams seen r times; 0.5 less where they don't exist."""
    out = np.ones(KATZ + 1)
    common = (KATZ + 1) * n_r[KATZ] / n_r[0] if n_r[0] else 1.0
    for r in range(1, KATZ + 1):
        turing = (r + 1) * n_r[r] / (r * n_r[r - 1]) if n_r[r - 1] else 0.0
        d = (turing - common) / (1 - common) if common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Backoff:
    """By id of a listed history: how often it was one (one more if it has no discounted bigram), and its weight."""

    seen: np.ndarray
    weight: np.ndarray
    discount: np.ndarray
    hot_keys: np.ndarray
    hot_counts: np.ndarray

    def higher(self, counts: np.ndarray) -> np.ndarray:
        return self.discount[np.minimum(counts, KATZ + 1)] * counts

    def log_probability(self, words: Words, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of P(word | history), both listed: the bigram's if it was seen, else the backed-off unigram's."""
        history, word = keys >> _SHIFT, keys & _MASK
        return np.log10(np.where(counts > 0, self.higher(counts) / self.seen[history], self.weight[history] * (words.counts[word] + ADD) / words.total))


def _histories(tables: DataFrame, d: np.ndarray, total: float) -> DataFrame:
    """(bucket, and packed and sorted: listed histories, how often, weights; the same of unlisted ones)."""
    def weigh(table: pa.Table) -> pa.Table:
        parts = [(expand(a.as_py(), True), np.frombuffer(b.as_py(), np.int64).reshape(1 + KATZ, -1), np.frombuffer(c.as_py())) for a, b, c in zip(*(table.column(f"x{i}") for i in (1, 2, 3)))]
        history, numbers, mass = np.concatenate([x for x, _, _ in parts]), np.concatenate([x for _, x, _ in parts], axis=1), np.concatenate([x for _, _, x in parts])
        order = np.argsort(history, kind="stable")
        heads = _heads(history[order])
        history, numbers, mass = history[order][heads], np.add.reduceat(numbers[:, order], heads, axis=1), np.add.reduceat(mass[order], heads)
        left = sum(numbers[r] * r * (1 - d[r]) for r in range(1, KATZ + 1))
        plain = left <= 0
        seen = numbers[0] + plain
        weight = np.where(plain, 1.0, left) / seen / np.maximum(1 - mass / total, 1e-300)
        rare = history < 0
        cell = lambda x: pa.array([x], pa.binary())
        both = [(squeeze(history[at], True), squeeze(seen[at]), weight[at].tobytes()) for at in (~rare, rare)]
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), **{f"{a}{i}": cell(x) for a, part in zip("xy", both) for i, x in enumerate(part)}})

    sums = tables.filter(F.col("kind") == _SUMS).select("bucket", "x1", "x2", "x3")
    return sums.groupBy("bucket").applyInArrow(weigh, "bucket int, x0 binary, x1 binary, x2 binary, y0 binary, y1 binary, y2 binary")


def _backoff(tables: DataFrame, histories: DataFrame, d: np.ndarray, listed: int) -> Backoff:
    seen, weight = np.ones(listed, np.int64), np.ones(listed)
    for h, s, w in histories.select("x0", "x1", "x2").collect():  # an entry for each listed history
        at = expand(bytes(h), True)
        seen[at], weight[at] = expand(bytes(s)), np.frombuffer(bytes(w))
    hot = [(expand(bytes(k), True), expand(bytes(c))) for k, c in tables.filter(F.col("kind") == _TOP).select("x1", "x2").collect()]  # about 2 * HOT bigrams
    keys, counts = _summed([(k,) for k, _ in hot], [c for _, c in hot]) if hot else (np.zeros(0, np.int64),) * 2
    return Backoff(seen, weight, np.append(d, 1.0), keys, counts)


_ASKED = "run long, bucket int, kind int, x1 binary, x2 binary, docs binary"
_ANSWER = "run long, docs binary, katz binary, base binary, known binary"


def _answers(rows: list[tuple]) -> dict:
    """Sums for the texts of each run: (run, docs, katz, base or None, known or None)."""
    out: dict[str, list] = {"run": [], "docs": [], "katz": [], "base": [], "known": []}
    for run, docs, *sums in rows:
        some, of = np.unique(docs, return_inverse=True)
        out["run"].append(run)
        out["docs"].append(squeeze(some, True))
        for name, x in zip(("katz", "base", "known"), sums):
            out[name].append(None if x is None else np.bincount(of, x, some.size).astype("<f8").tobytes())
    return {"run": pa.array(out["run"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("docs", "katz", "base", "known")}}


def score(documents: DataFrame, held_out_of: int = 10, vocabulary: int = VOCABULARY) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    large_strings(documents)
    spark = documents.sparkSession
    source = documents.select("doc_id", (remainder("doc_id", held_out_of) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    unigrams = stored(_unigrams(source), "lm-unigrams")
    n_words, n_types = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends, size = source.filter("not held_out").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(16, min(-(-int(size) // BUCKET_BYTES), max(MANY, -(-int(size) // LARGE_BYTES))))
    top = unigrams.orderBy(F.desc("n"), "hash").limit(vocabulary).toArrow()  # vocabulary rows at most
    discard(unigrams)
    train_tokens, types = int(n_words) + ends, int(n_types) + (ends > 0)
    total = train_tokens + ADD * (types + 1)
    hashes = top.column("hash").to_numpy()
    order = np.argsort(hashes)
    words = Words(hashes[order], order + 1, np.concatenate([[ends], top.column("n").to_numpy()]).astype(np.int64), total)
    shared = spark.sparkContext.broadcast(words)
    tables = stored(_pair_tables(source, shared, buckets), "lm-pairs")
    n_r = tables.agg(*[F.coalesce(F.sum(F.get("n_r", F.lit(i))), F.lit(0)) for i in range(KATZ + 1)]).first()
    d = discounts([int(x) for x in n_r])
    histories = stored(_histories(tables, d, total), "lm-histories")
    model = spark.sparkContext.broadcast(_backoff(tables, histories, d, words.counts.size))

    def scan(batches: Iterator[pa.RecordBatch]):
        """For each run of texts, one row with the texts' own sums and one for each bucket with what must be looked up."""
        words, backoff = shared.value, model.value
        number = run_number()
        log_weight = np.log10(words.counts + ADD)
        held: list[tuple] = []  # of each slice: its texts' ids, and history, word and text of each token
        size = 0

        def rows():
            nonlocal number
            first = np.cumsum([0, *(len(x[0]) for x in held)])
            n = int(first[-1])
            ids, out = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
            history, word = (np.concatenate([x[i] for x in held]) for i in (2, 3))
            doc = np.concatenate([x[4] + k for x, k in zip(held, first)])
            held.clear()
            listed = word >= 0
            own = np.where(listed, word, 0)
            base = np.bincount(doc, np.where(listed, log_weight[own], 0.0), n)
            known = np.bincount(doc, listed & (words.counts[own] > 0), n).astype(np.int64)
            both = np.flatnonzero(listed & (history >= 0))
            keys = history[both] << _SHIFT | word[both]
            at, hot = _find(backoff.hot_keys, keys)
            katz = np.bincount(doc[both[hot]], backoff.log_probability(words, keys[hot], backoff.hot_counts[at[hot]]) if hot.any() else np.zeros(0), n)
            found = []
            order = np.argsort(keys[~hot], kind="stable")
            keys, of = keys[~hot][order], doc[both[~hot]][order]
            for b, (k, docs) in _dealt(_history_bucket(keys >> _SHIFT, keys & _MASK, buckets), buckets, keys, of):
                found.append((b, _LISTED, squeeze(k, True), None, squeeze(docs)))
            after = np.flatnonzero(listed & (history < 0))
            for b, (h, w, docs) in _dealt(_spread(history[after], buckets), buckets, history[after], word[after], doc[after]):
                found.append((b, _AFTER_RARE, squeeze(h), squeeze(w), squeeze(docs)))
            rare = np.flatnonzero(~listed)
            for b, (h, w, docs) in _dealt(_spread(word[rare], buckets), buckets, history[rare], word[rare], doc[rare]):
                found.append((b, _RARE, squeeze(w), squeeze(h), squeeze(docs)))
            values = pa.StructArray.from_arrays([ids, out, pa.array(np.bincount(doc, minlength=n)), pa.array(known), pa.array(base.astype(float)), pa.array(katz.astype(float))], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "katz"])
            found.append((-1, -1, None, None, None))
            for i in range(0, len(found), 1024):
                part = found[i : i + 1024]
                last = i + 1024 >= len(found)
                lists = pa.ListArray.from_arrays(pa.array([0] * len(part) + [n if last else 0], pa.int32()), values if last else values[:0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), number)), pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), *(pa.array([r[k] for r in part], pa.large_binary()) for k in (2, 3, 4)), lists],
                    names=["run", "bucket", "kind", "x1", "x2", "docs", "own"])
            number += 1

        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                held.append((part.column(0), part.column(1), *words.chain(data, offsets)))
                size += data.size
                if size >= min(max(SLICE_BYTES, buckets * SHARE), RUN_BYTES):
                    yield from rows()
                    size = 0
        if held:
            yield from rows()

    own = f"own array<struct<doc_id:{source.schema['doc_id'].dataType.simpleString()},held_out:boolean,n_tokens:bigint,n_known:bigint,base:double,katz:double>>"
    scanned = stored(source.mapInArrow(tidy(scan), f"{_ASKED}, {own}"), "lm-scan")
    asked = scanned.drop("own")

    def rare_words(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of unlisted words; after an unlisted history only the word's part, and a question about the history."""
        words, backoff = shared.value, model.value
        w, h, c = [expand(right.column(f"x{i}")[0].as_py(), i == 1) for i in (1, 2, 3)] if right.num_rows else [np.zeros(0, np.int64)] * 3
        heads = _heads(w)
        names, of = w[heads], np.add.reduceat(c, heads) if w.size else c
        # all runs' pairs at once; each row of left is one run's
        rows = list(zip(*(left.column(k).to_pylist() for k in ("run", "x1", "x2", "docs"))))
        word, history, docs = (_joined([expand(r[i]) for r in rows]) for i in (1, 2, 3))
        cut = np.cumsum([0, *(expand(r[3]).size for r in rows)])
        at, there = _find(names, word)
        n = np.where(there, of[at], 0) if names.size else np.zeros(word.size, np.int64)
        at, there = _pairs_in(w, h, word, history)
        counts = np.where(there, c[at], 0) if c.size else np.zeros(word.size, np.int64)
        met, id_ = history >= 0, np.maximum(history, 0)
        part = np.where(counts > 0, backoff.higher(counts), (n + ADD) / words.total)
        part = np.log10(part * np.where(met, np.where(counts > 0, 1 / backoff.seen[id_], backoff.weight[id_]), 1.0))
        base, known = np.log10(n + ADD), (n > 0).astype(float)
        answers = [(r[0], docs[i:j], part[i:j], base[i:j], known[i:j]) for r, i, j in zip(rows, cut, cut[1:])]
        # questions about histories that aren't listed are plain rows: their number is that of the pairs, however many buckets there are
        open_ = np.flatnonzero(~met)
        runs_ = np.repeat(np.array([r[0] for r in rows], np.int64), np.diff(cut))[open_]
        texts, histories_, seen = docs[open_], history[open_], (counts[open_] > 0).astype(np.int64)
        made, m, k = _answers(answers), len(answers), runs_.size
        empty = {"bucket": pa.int32(), "kind": pa.int32(), "h": pa.int64(), "doc": pa.int64(), "seen": pa.int64()}
        first = {**made, **{x: pa.nulls(m, kind) for x, kind in empty.items()}}
        second = {"run": pa.array(runs_), **{x: pa.nulls(k, pa.binary()) for x in ("docs", "katz", "base", "known")},
                  "bucket": pa.array(_spread(histories_, buckets).astype(np.int32)), "kind": pa.array(np.full(k, _SUMS, np.int32)), "h": pa.array(histories_), "doc": pa.array(texts), "seen": pa.array(seen)}
        return pa.concat_tables([pa.table(first), pa.table(second)])

    columns = ["bucket", "x1", "x2", "x3", "x4", "x5"]
    rare_tables = tables.filter(F.col("kind") == _RARE).select(*columns)
    first = stored(asked.filter(F.col("kind") == _RARE).groupBy("bucket").cogroup(rare_tables.groupBy("bucket")).applyInArrow(rare_words, f"{_ANSWER}, bucket int, kind int, h long, doc long, seen long"), "lm-rare")

    def listed_words(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of listed words, and what a history that isn't listed adds to those of unlisted ones."""
        words, backoff = shared.value, model.value
        empty = np.zeros(0, np.int64)
        keys = counts = h = w = c = names = seen = empty
        weight = np.zeros(0)
        for r in right.to_pylist():
            if r["x5"] is not None:
                keys, counts, h, w, c = (expand(r[f"x{i}"], i in (1, 3)) for i in (1, 2, 3, 4, 5))
            else:
                names, seen, weight = expand(r["x1"], True), expand(r["x2"]), np.frombuffer(r["x3"])
        answers = []
        plain = left.filter(pc.equal(left.column("kind"), _SUMS))
        if plain.num_rows:
            run, doc, history, met = (plain.column(x).to_numpy() for x in ("run", "doc", "h", "seen"))
            order = np.argsort(run, kind="stable")
            at, there = _find(names, history[order])
            times, share = (np.where(there, x[at], 1) if names.size else np.ones(history.size) for x in (seen, weight))
            part = np.log10(np.where(met[order] > 0, 1 / times, share))
            cut = np.append(_heads(run[order]), run.size)
            answers += [(int(run[order[a]]), doc[order[a:b]], part[a:b], None, None) for a, b in zip(cut, cut[1:])]
        rows = list(zip(*(left.filter(pc.equal(left.column("kind"), _LISTED)).column(k).to_pylist() for k in ("run", "x1", "docs"))))
        for run, x1, docs in rows:
            asked = expand(x1, True)
            at, there = _find(keys, asked)
            answers.append((run, expand(docs), backoff.log_probability(words, asked, np.where(there, counts[at], 0) if keys.size else np.zeros(asked.size, np.int64)), None, None))
        rows = list(zip(*(left.filter(pc.equal(left.column("kind"), _AFTER_RARE)).column(k).to_pylist() for k in ("run", "x1", "x2", "docs"))))
        history, word, docs = (_joined([expand(r[i]) for r in rows]) for i in (1, 2, 3))
        at, there = _find(names, history)
        times, share = (np.where(there, x[at], 1) if names.size else np.ones(history.size) for x in (seen, weight))
        at, there = _pairs_in(h, w, history, word)
        n = np.where(there, c[at], 0) if c.size else np.zeros(history.size, np.int64)
        part = np.log10(np.where(n > 0, backoff.higher(n) / times, share * (words.counts[word] + ADD) / words.total))
        cut = np.cumsum([0, *(expand(r[3]).size for r in rows)])
        answers += [(r[0], docs[i:j], part[i:j], None, None) for r, i, j in zip(rows, cut, cut[1:])]
        return pa.table(_answers(answers))

    none = F.lit(None).cast("binary")
    by_history = tables.filter(F.col("kind") == _LISTED).select(*columns).unionByName(histories.select("bucket", F.col("y0").alias("x1"), F.col("y1").alias("x2"), F.col("y2").alias("x3"), none.alias("x4"), none.alias("x5")))
    questions = asked.filter(F.col("kind").isin(_LISTED, _AFTER_RARE)).unionByName(first.filter("kind is not null").select("run", "bucket", "kind", "h", "doc", "seen"), allowMissingColumns=True)
    second = questions.groupBy("bucket").cogroup(by_history.groupBy("bucket")).applyInArrow(listed_words, _ANSWER)

    def added(table: pa.Table) -> pa.Table:
        """Each text's parts, added in a fixed order."""
        rows = table.to_pylist()
        texts = next(table.column("own")[i].values for i, r in enumerate(rows) if r["docs"] is None)
        sums = {k: texts.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("katz", "base")} | {"known": texts.field("n_known").to_numpy().astype(float)}
        for r in sorted((r for r in rows if r["docs"] is not None), key=lambda r: (r["docs"], r["katz"])):
            docs = expand(r["docs"], True)
            for k, x in sums.items():
                if r[k] is not None:
                    x[docs] += np.frombuffer(r[k])
        return pa.table({"doc_id": texts.field("doc_id"), "held_out": texts.field("held_out"), "n_tokens": texts.field("n_tokens"), "n_known": sums["known"].astype(np.int64), "base": sums["base"], "katz": sums["katz"]})

    answered = first.filter("kind is null").select("run", "docs", "katz", "base", "known").unionByName(second)
    own_rows = scanned.filter("kind < 0").select("run", *[none.alias(c) for c in ("docs", "katz", "base", "known")], "own")
    together = own_rows.unionByName(answered.withColumn("own", F.lit(None).cast(scanned.schema["own"].dataType)))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, katz double"
    rows = together.groupBy("run").applyInArrow(added, schema)
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total)))).alias("base_score"), F.col("katz").alias("score"))
