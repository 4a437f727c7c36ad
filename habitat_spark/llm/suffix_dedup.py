"""Exact removal of repeated byte spans with suffix arrays.

A byte goes if a SPAN-byte string over it also starts in a document with a smaller doc_id. Any two equal strings of
SPAN bytes pick the same GRAM-byte anchor in them (the least hash), so equal strings meet at a shared anchor:

1. Every anchor's hash and the hash of its context (all strings around it) go to a bucket, once for each context in a
   run of texts. A bucket knows which anchors are in several documents, which contexts are whole repeats of one in a
   smaller document, and which first ones of different contexts must be compared.
2. These contexts' texts are grouped by anchor and the half of it that the string must hold too, and a suffix array
   over each group (linear grouping) puts equal strings side by side; each run of equal ones has its smallest doc_id.
3. Each document drops the bytes of its repeated strings.

Equal contexts are one entry, so thousands of copies are no more than one; whole contexts are equal if 64 bits of
their hash, 32 more of their anchor's and its bucket are. There is a bucket for each BUCKET_BYTES of text (more in large inputs),
and runs of texts grow with the number of buckets, so that a run's row for a bucket stays worth its cost. An anchor of
more than HOT contexts, as at the ends of a passage that very many documents share, isn't brought together: the strings
over it are halved into ranges, and in each range contexts are grouped by the bytes that all its strings hold, until
groups are small. Contexts of groups that stay large are dealt to parts, and each part's distinct strings, with the
smallest doc_id of each, meet by their bytes.

Null texts are empty. Rows with one doc_id are one document to each other (no repeats of their own); a null doc_id
comes after all others. Repeated rows have the same result; other columns are ignored. doc_ids are numbers (those of
other types that can't be read as such are an error). Texts of any length are compared whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE, _BYTE, _INVERSE, SLICE_BYTES, _power, discard, expand, hash_spans, large_strings, mix, run_number, slices, squeeze, stored, tidy
from .suffix_arrays import suffix_array, suffix_arrays

SPAN = 50
GRAM = 24
SIDE = SPAN - GRAM
HALF = SIDE // 2
#: Contexts of a group up to which many groups' suffix arrays are built together.
TOGETHER = 6
#: Text for each bucket, as long as there are no more than MANY; then buckets grow, up to LARGE_BYTES.
BUCKET_BYTES = 8 << 20
MANY = 4096
LARGE_BYTES = 32 << 20
#: Text behind a row that a run of texts gives a bucket, at least, and text of a run at most.
SHARE = 16 << 10
RUN_BYTES = 64 << 20
#: Contexts of an anchor beyond which they are taken apart by what their strings hold, and of a part of what is left.
HOT = 4096
#: Halvings of the strings over an anchor, up to ranges of 3 or 4 strings.
NARROW = 3
_LAST = 2**63 - 1


def _sliding(values: np.ndarray, width: int, f) -> np.ndarray:
    """f over each width neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = f(values[:-done], values[done:])
        done *= 2
    return f(values[: values.size - (width - done)], values[width - done :]) if done < width else values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in data) and hashes of the grams that some SPAN-byte string of their text picks."""
    count = data.size - GRAM + 1
    width = SPAN - GRAM + 1
    if count < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, data.size), out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * _power(_INVERSE, data.size)[:count])
    least = _sliding(grams, width, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: least.size]
    least[np.arange(least.size) + SPAN > ends] = 0  # a string over the edge of its text picks nothing
    edge = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero((best == grams) & (best > 0))
    return at, grams[at]


def _contexts(at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each anchor's context: SIDE bytes to both sides, inside its text."""
    row = np.searchsorted(offsets, at, "right") - 1
    return row, np.maximum(at - SIDE, offsets[row]), np.minimum(at + GRAM + SIDE, offsets[row + 1])


def _heads(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(keys[0].size, bool)
    if new.size:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def bucket_count(size: int) -> int:
    """Buckets for so much text: of BUCKET_BYTES each, and of more once there are MANY, up to LARGE_BYTES."""
    return max(16, min(-(-size // BUCKET_BYTES), max(MANY, -(-size // LARGE_BYTES))))


def run_bytes(buckets: int) -> int:
    """Text of a run: it grows with the buckets, so that each of its rows has SHARE bytes of text or more behind it."""
    return min(max(SLICE_BYTES, buckets * SHARE), RUN_BYTES)


def _scan(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per run of texts: a row for each bucket with its anchors, and one with what is needed to read the answer."""
    names = ["run", "bucket", "docs", "counts", "grams", "contexts", "hashes"]
    number = run_number()
    held: list[tuple[np.ndarray, ...]] = []  # of each slice: documents, their hashes, and of each anchor its document, gram and context
    size = 0

    def rows():
        nonlocal number
        docs, hashes = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        first = np.cumsum([0, *(x[0].size for x in held)])
        of = np.concatenate([x[2] + n for x, n in zip(held, first)])
        grams, around = (np.concatenate([x[i] for x in held]) for i in (3, 4))
        held.clear()
        # within the run, only the smallest document's own copies of a context are sent
        order = np.lexsort((docs[of], around, grams))
        new = _heads(grams[order], around[order])
        least = docs[of][order][np.maximum.accumulate(np.where(new, np.arange(order.size), 0))]
        state = np.zeros(of.size, np.int64)
        state[order] = docs[of][order] > least
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        found = [(buckets + number % buckets, squeeze(docs), squeeze(np.bincount(of, minlength=docs.size)), squeeze(bucket), squeeze(state), squeeze(hashes))]
        send = np.flatnonzero(state == 0)
        send = send[np.argsort(bucket[send], kind="stable")]
        cut = np.searchsorted(bucket[send], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            mine = send[cut[b] : cut[b + 1]]
            own, counts = np.unique(of[mine], return_counts=True)
            found.append((b, squeeze(docs[own]), squeeze(counts), squeeze((grams[mine] >> np.uint64(32)).astype(np.int64)), squeeze(around[mine]), None))
        for i in range(0, len(found), 1024):
            part = found[i : i + 1024]
            binary = [pa.array([x[k] for x in part], pa.large_binary()) for k in range(1, 6)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(part), pa.int64()), pa.array([x[0] for x in part], pa.int32()), *binary], names=names)
        number += 1

    for batch in batches:
        for part, data, offsets in slices(batch, "text"):
            at, grams = anchors(data, offsets)
            size += data.size
            if at.size:
                of, start, end = _contexts(at, offsets)
                around = hash_spans(data, start, end) + (at - start).astype(np.uint64)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), of, grams, mix(around).view(np.int64)))
            if held and size >= run_bytes(buckets):
                yield from rows()
                size = 0
    if held:
        yield from rows()


def _resolve(table: pa.Table, buckets: int) -> pa.Table:
    """States of one bucket's anchors: 0 nothing to do, 1 a whole repeat, 3 to be compared."""
    rows = table.to_pylist()
    if rows[0]["bucket"] >= buckets:
        out = {k: [r[k] for r in rows] for k in ("run", "bucket", "docs", "counts", "grams", "contexts", "hashes")}
        return pa.table({"run": pa.array(out["run"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in ("docs", "counts", "grams", "contexts", "hashes")}})
    docs = np.concatenate([np.repeat(expand(r["docs"]), expand(r["counts"])) for r in rows])
    parts = [expand(r["grams"]) for r in rows]
    grams, around = np.concatenate(parts), np.concatenate([expand(r["contexts"]) for r in rows])
    order = np.lexsort((docs, around, grams))
    d, g, c = docs[order], grams[order], around[order]
    new_gram, new_context = _heads(g), _heads(g, c)
    group, context = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
    starts = np.flatnonzero(new_gram)
    shared = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
    several = np.bincount(group[new_context]) > 1
    first = d[np.flatnonzero(new_context)][context]
    state = np.empty(order.size, np.int64)
    state[order] = np.where(~shared[group], 0, np.where(d > first, 1, np.where(several[group], 3, 0)))
    cuts = np.cumsum([0, *(p.size for p in parts)])
    answers = [squeeze(state[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    none = pa.array([None] * len(rows), pa.binary())
    return pa.table({"run": pa.array([r["run"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "docs": none, "counts": none, "grams": none, "contexts": pa.array(answers, pa.binary()), "hashes": none})


def _assemble(table: pa.Table, buckets: int) -> pa.Table:
    """States of each document of one run, for those with anything to do."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["bucket"] >= buckets)
    docs, counts, hashes = expand(own["docs"]), expand(own["counts"]), expand(own["hashes"])
    bucket, state = expand(own["grams"]), expand(own["contexts"])
    order = np.flatnonzero(state == 0)
    order = order[np.argsort(bucket[order], kind="stable")]
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for r in rows:
        if r["bucket"] < buckets:
            state[order[cut[r["bucket"]] : cut[r["bucket"] + 1]]] = expand(r["contexts"])
    cuts = np.cumsum([0, *counts])
    some = [i for i in range(docs.size) if state[cuts[i] : cuts[i + 1]].any()]
    return pa.table({"k": pa.array(docs[some]), "h": pa.array(hashes[some]), "states": pa.array([squeeze(state[cuts[i] : cuts[i + 1]]) for i in some], pa.binary())})


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; touching ones are one."""
    if not starts.size:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(starts.size, bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:] - 1, starts.size - 1)]


def _kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


_CONTEXT = "array<struct<gram:bigint,pos:bigint,lead:binary,tail:binary>>"
_DONE = "doc_id {0}, k long, h long, text binary, spans array<struct<start:bigint,stop:bigint>>, contexts " + _CONTEXT + ", kept binary"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Known spans of each document, and the contexts to compare; documents with none are done."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    context_type = pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int64()), ("lead", pa.binary()), ("tail", pa.binary())]))
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts, spans, contexts, kept = [], [], [], []
            for value, states in zip(part.column(3), part.column(4)):
                data = value.as_py() or b""
                if states.as_py() is None:
                    starts = ends = np.zeros(0, np.int64)
                    asked: list[dict] = []
                else:
                    flat = np.frombuffer(data, np.uint8)
                    at, grams = anchors(flat, np.array([0, flat.size]))
                    state = expand(states.as_py())
                    full = at[state == 1]
                    low, high = np.maximum(full - SIDE, 0), np.minimum(full + GRAM + SIDE, flat.size)
                    starts, ends = _merged(low, high)
                    asked = [{"gram": int(g), "pos": int(p), "lead": data[max(0, p - SIDE) : p], "tail": data[p + GRAM : p + SPAN]} for p, g in zip(at[state == 3].tolist(), grams[state == 3].view(np.int64).tolist())]
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(starts, ends)])
                contexts.append(asked)
                texts.append(data if asked else None)
                kept.append(None if asked else _kept(data, starts, ends))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(texts, pa.large_binary()), pa.array(spans, span_type), pa.array(contexts, context_type), pa.array(kept, pa.large_binary())], names=["doc_id", "k", "h", "text", "spans", "contexts", "kept"])


def _sides(lead: list[bytes], tail: list[bytes]) -> np.ndarray:
    """Contexts as symbols: SIDE bytes before the anchor and SIDE after it, with a sign of its own beyond the text's edge."""
    out = np.empty((len(lead), 2 * SIDE), np.int32)
    out[:] = 300 + np.arange(len(lead))[:, None]
    text = b"".join(a.rjust(SIDE, b"\0") + b.ljust(SIDE, b"\0") for a, b in zip(lead, tail))
    symbols = np.frombuffer(text, np.uint8).reshape(-1, 2 * SIDE).astype(np.int32) + 3
    column = np.arange(2 * SIDE)
    a, b = (np.array([len(x) for x in side])[:, None] for side in (lead, tail))
    return np.where((column >= SIDE - a) & (column < SIDE + b), symbols, out)


def _equal_strings(parts: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which of the HALF + 1 strings of each entry also are in an entry of its group with a smaller document.

    parts: (entries, 2 * HALF) symbols to both sides of the core; groups: sorted group numbers. Strings have HALF + 1
    symbols, the core among them.
    """
    width = 2 * HALF + 2
    hit = np.zeros((docs.size, HALF + 1), bool)
    heads = np.flatnonzero(_heads(groups))
    sizes = np.diff(np.append(heads, groups.size))
    line = np.empty((docs.size, width), np.int32)
    line[:, :HALF], line[:, HALF], line[:, HALF + 1 : -1], line[:, -1] = parts[:, :HALF], 2, parts[:, HALF:], 1

    def judged(entries: np.ndarray, order: np.ndarray) -> None:
        """entries: (groups, m) entry numbers; order: suffix arrays over their concatenated lines."""
        g, m = entries.shape
        place, which = order % width, order // width
        row, at = np.nonzero(place <= HALF)
        place, entry = place[row, at], entries[row, which[row, at]]
        window = np.lib.stride_tricks.sliding_window_view(line, HALF + 1, axis=1)[entry, place]
        new = np.ones(row.size, bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1]).any(axis=1)
        least = np.minimum.reduceat(docs[entry], np.flatnonzero(new))[np.cumsum(new) - 1]
        repeated = docs[entry] > least
        hit[entry[repeated], place[repeated]] = True

    for m in np.unique(sizes).tolist():
        if m < 2:
            continue
        entries = heads[sizes == m][:, None] + np.arange(m)
        step = max(1, 400_000 // (m * width)) if m <= TOGETHER else 1
        for i in range(0, len(entries), step):
            some = entries[i : i + step]
            texts = line[some].reshape(len(some), m * width)
            texts[:, -1] = 0  # the only least symbol ends the text
            order = suffix_arrays(texts) if m <= TOGETHER else np.array([suffix_array(texts[0].tolist())])
            judged(some, order)
    return hit


def _compare(table: pa.Table) -> pa.Table:
    """Repeated spans of the contexts of one bucket."""
    docs, hashes, grams, pos = (table.column(c).to_numpy() for c in ("k", "h", "gram", "pos"))
    sides = _sides(table.column("lead").to_pylist(), table.column("tail").to_pylist())
    # a document's own copies of a context are judged once
    alike = mix(grams.view(np.uint64)) ^ mix(docs.view(np.uint64) + np.uint64(1))
    for c in range(2 * SIDE):
        alike = alike * np.uint64(0xD6E8FEB86659FD93) + sides[:, c].astype(np.uint64)
    _, one, copies = np.unique(alike, return_index=True, return_inverse=True)
    all_docs = docs
    docs, grams, sides = docs[one], grams[one], sides[one]
    hits = np.zeros((docs.size, SIDE + 1), bool)
    # a string over the anchor also holds the HALF bytes before it, or the HALF bytes after it
    for near, rest, shift in ((slice(HALF, SIDE), np.r_[0:HALF, SIDE : SIDE + HALF], 0), (slice(SIDE, SIDE + HALF), np.r_[HALF:SIDE, SIDE + HALF : 2 * SIDE], HALF)):
        key = np.zeros(docs.size, np.uint64)
        for c in range(near.start, near.stop):
            key = key * np.uint64(1_000_003) + sides[:, c].astype(np.uint64)
        key = mix(key)
        order = np.lexsort((key, grams))
        group = np.cumsum(_heads(grams[order], key[order])) - 1
        alone = np.bincount(group)[group] < 2
        order, group = order[~alone], group[~alone]
        if order.size:
            hits[order, shift : shift + HALF + 1] |= _equal_strings(sides[order][:, rest], docs[order], group)
    docs, hits = all_docs, hits[copies.ravel()]
    entry, at = np.nonzero(hits)
    start = pos[entry] - SIDE + at
    # neighbouring strings of one context are one span
    new = np.ones(entry.size, bool)
    new[1:] = (entry[1:] != entry[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], entry.size)[: first.size] - 1 if first.size else first
    return pa.table({"k": pa.array(docs[entry[first]]), "h": pa.array(hashes[entry[first]]), "start": pa.array(start[first]), "stop": pa.array(start[last] + SPAN)})


_FOUND = "k long, h long, start long, stop long"


_STRINGS = "bucket long, string binary, k long, h long, start long, stop long, hs array<long>, starts array<long>"


def _spans(k, h, start, stop) -> pa.Table:
    return pa.table({"k": pa.array(k, pa.int64()), "h": pa.array(h, pa.int64()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})


def _part(table: pa.Table, buckets: int) -> pa.Table:
    """Of a part of one anchor's contexts: spans of strings that a smaller document has in this part, and each distinct
    string once, with its smallest document and where that has it."""
    docs, hashes, pos = (table.column(c).to_numpy() for c in ("k", "h", "pos"))
    gram = table.column("gram")[0].as_py()
    lead, tail = table.column("lead").to_pylist(), table.column("tail").to_pylist()
    text = np.frombuffer(b"".join(a.rjust(SIDE, b"\0") + b.ljust(SIDE, b"\0") for a, b in zip(lead, tail)), np.uint8).reshape(-1, 2 * SIDE)
    before, after = (np.array([len(x) for x in side]) for side in (lead, tail))
    hits = np.zeros((docs.size, SIDE + 1), bool)
    found = []
    for at in range(SIDE + 1):
        some = np.flatnonzero((before >= SIDE - at) & (after >= at))
        if not some.size:
            continue
        symbols = np.zeros((some.size, 32), np.uint8)
        symbols[:, :SIDE] = text[some, at : at + SIDE]
        symbols[:, SIDE] = at
        words = symbols.view(np.uint64)
        order = np.lexsort((hashes[some], docs[some], *words.T))
        some, words = some[order], words[order]
        new = _heads(*words.T)
        least = docs[some][new][np.cumsum(new) - 1]
        hits[some, at] = docs[some] > least
        first = docs[some] == least
        key = np.full(int(new.sum()), gram, np.int64).view(np.uint64)
        for c in words[new].T:
            key = mix(key ^ c)
        cut = np.append(0, np.cumsum(np.add.reduceat(first.astype(np.int64), np.flatnonzero(new))))
        found.append(((key % np.uint64(buckets)).astype(np.int64), symbols[order][new][:, : SIDE + 1], docs[some][new], cut, hashes[some][first], pos[some][first] - SIDE + at))
    entry, at = np.nonzero(hits)
    new = np.ones(entry.size, bool)
    new[1:] = (entry[1:] != entry[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], entry.size)[: heads.size] - 1
    start = pos[entry] - SIDE + at
    names = [c.split()[0] for c in _STRINGS.split(", ")]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
    n = heads.size
    parts = [pa.table([pa.array(docs[entry[heads]] % buckets), pa.nulls(n, kinds[1]), pa.array(docs[entry[heads]]), pa.array(hashes[entry[heads]]), pa.array(start[heads]), pa.array(start[last] + SPAN), pa.nulls(n, kinds[6]), pa.nulls(n, kinds[7])], names=names)]
    core = int(gram).to_bytes(8, "little", signed=True)
    for bucket, strings, k, cut, hs, starts in found:
        flat = strings.tobytes()
        own = pa.array([core + flat[i : i + SIDE + 1] for i in range(0, len(flat), SIDE + 1)], pa.binary())
        lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64())) for x in (hs, starts)]
        parts.append(pa.table([pa.array(bucket), own, pa.array(k), *[pa.nulls(k.size, pa.int64())] * 3, *lists], names=names))
    return pa.concat_tables(parts)


def _meet(table: pa.Table) -> pa.Table:
    """Spans known already, and those of the parts' strings that another part has in a smaller document."""
    is_string = table.column("string").is_valid()
    known, rows = table.filter(table.column("string").is_null()), table.filter(is_string)
    done = known.select(["k", "h", "start", "stop"])
    if not rows.num_rows:
        return done
    width = 8 + SIDE + 1
    symbols = np.zeros((rows.num_rows, -(-width // 8) * 8), np.uint8)
    symbols[:, :width] = np.frombuffer(b"".join(rows.column("string").to_pylist()), np.uint8).reshape(-1, width)
    words, docs = symbols.view(np.uint64), rows.column("k").to_numpy()
    order = np.lexsort((docs, *words.T))
    new = _heads(*words[order].T)
    least = docs[order][new][np.cumsum(new) - 1]
    later = rows.take(pa.array(order[docs[order] > least]))
    hs, starts = later.column("hs").to_pylist(), later.column("starts").to_pylist()
    k = np.repeat(later.column("k").to_numpy(), [len(x) for x in hs])
    start = np.array([x for some in starts for x in some], np.int64)
    return pa.concat_tables([done, _spans(k, [x for some in hs for x in some], start, start + SPAN)])


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """stored, with the files of its shuffles removed when it is written, not at some collection of the driver's garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(_CLEANUP, before)


_LEVEL = ["gram", "low", "core"]


def _halved(contexts: DataFrame) -> DataFrame:
    """Each context once for either half of its range low to high of strings, cut to what that half's strings hold, with
    the core that all strings of the half hold. Strings are numbered by their bytes after the anchor."""
    half = F.explode(F.expr("array(struct(low, (low + high) div 2 AS high), struct((low + high) div 2 + 1 AS low, high))"))
    cut = contexts.withColumn("half", half).select("gram", "k", "h", "pos", "lead", "tail", "half.low", "half.high")
    some = cut.filter(f"octet_length(lead) >= {SIDE} - high AND octet_length(tail) >= low")
    last = "substring(lead, greatest(octet_length(lead) - ({side} - {at}), 0) + 1, {side} - {at})"
    core = F.expr(f"concat({last.format(side=SIDE, at='high')}, substring(tail, 1, low))")
    return some.select("gram", "k", "h", "pos", F.expr(last.format(side=SIDE, at="low")).alias("lead"), F.expr("substring(tail, 1, high)").alias("tail"), "low", "high", core.alias("core"))


def _narrowed(contexts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Contexts of hot anchors, taken apart by the strings that they can share: spans found on the way, contexts whose
    core has HOT contexts at most, those of hot cores of NARROW halvings (n: how many of the core), and stored tables.

    Contexts cut to the same bytes have the same strings: where these are more than HOT, only the smallest document's go
    on, and the others' spans are found. So an edge of a passage leaves each context in one half of each range.
    """
    tables, found, few = [], [], []
    for _ in range(NARROW):
        halves = _halved(contexts)
        alike = _stored(halves.groupBy("gram", "low", "lead", "tail").agg(F.count("*").alias("n"), F.min("k").alias("least")).filter(F.col("n") > HOT).drop("n"), "spans-alike")
        cut = _stored(halves.join(alike, ["gram", "low", "lead", "tail"], "left"), "spans-cut")
        first = F.expr(f"pos - {SIDE} + greatest(low, {SIDE} - octet_length(lead))")
        last = F.expr(f"pos - {SIDE} + least(high, octet_length(tail))")
        found.append(cut.filter("k > least").select("k", "h", first.cast("long").alias("start"), (last + SPAN).cast("long").alias("stop")))
        left = cut.filter("least IS NULL OR k = least").drop("least")
        cores = _stored(left.groupBy(_LEVEL).agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "spans-cores")
        few.append(left.join(cores, _LEVEL, "left_anti").select(*_LEVEL, "k", "h", "pos", "lead", "tail"))
        contexts = left.join(cores, _LEVEL)
        tables += [alike, cut, cores]
    return functools.reduce(DataFrame.unionByName, found), functools.reduce(DataFrame.unionByName, few), contexts, tables


def _compared_in_parts(many: DataFrame, buckets: int) -> DataFrame:
    """What _compare gives, for contexts of hot cores: dealt to parts of about HOT, whose distinct strings meet. A string
    goes on once from each part, so no step grows with the square of its documents."""
    parts = many.withColumn("part", F.pmod(F.xxhash64("k", "h", "pos"), F.ceil(F.col("n") / HOT)))
    strings = parts.select(*_LEVEL, "part", "k", "h", "pos", "lead", "tail").groupBy(*_LEVEL, "part").applyInArrow(lambda t: _part(t, buckets), _STRINGS)
    return strings.groupBy("bucket").applyInArrow(_meet, _FOUND)


def _compared(asked: DataFrame, buckets: int) -> tuple[DataFrame, list[DataFrame]]:
    """Repeated spans of all contexts asked for, and stored tables that they are read from."""
    hot = _stored(asked.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "spans-hot")
    near = ["bucket", "k", "h", "gram", "pos", "lead", "tail"]
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets))
    if not hot.limit(1).count():  # a gram for each HOT contexts at most
        return asked.withColumn("bucket", bucket).select(near).groupBy("bucket").applyInArrow(_compare, _FOUND), [hot]
    contexts = asked.join(hot.select("gram"), "gram").withColumns({"low": F.lit(0), "high": F.lit(SIDE)})
    found, few, many, tables = _narrowed(contexts)
    # a core's contexts are a group as an anchor's are
    single = asked.join(hot, "gram", "left_anti").select(near[1:]).unionByName(few.withColumn("gram", F.xxhash64(*_LEVEL)).select(near[1:]))
    compared = single.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_compare, _FOUND)
    return compared.unionByName(found).unionByName(_compared_in_parts(many, buckets)), [hot, *tables]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            kept, spans = [], []
            for text, known, more in zip(part.column(1), part.column(2), part.column(3)):
                pairs = [(x["start"], x["stop"]) for x in (known.as_py() or []) + (more.as_py() or [])]
                starts, ends = _merged(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))
                kept.append(_kept(text.as_py(), starts, ends))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(starts, ends)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.large_binary())], names=["doc_id", "spans", "kept"])


def without_repeats(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, spans (removed byte ranges) and kept (the bytes left)."""
    large_strings(documents)
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = bucket_count(size)
    kind = documents.schema["doc_id"].dataType
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    keyed = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k"), F.xxhash64(F.col("text").cast("string")).alias("h"), text.alias("text"))
    packed = "run long, bucket int, docs binary, counts binary, grams binary, contexts binary, hashes binary"
    source = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    answers = source.mapInArrow(tidy(lambda b: _scan(b, buckets)), packed).groupBy("bucket").applyInArrow(lambda t: _resolve(t, buckets), packed)
    states = answers.groupBy("run").applyInArrow(lambda t: _assemble(t, buckets), "k long, h long, states binary")
    states = _stored(states, "spans-states")
    found = keyed.join(states.dropDuplicates(["k", "h"]), ["k", "h"], "left").select("doc_id", "k", "h", "text", "states")
    known = _stored(found.mapInArrow(tidy(_extract), _DONE.format(kind.simpleString())), "spans-known")
    discard(states)
    more, tables = _compared(known.select("k", "h", F.explode("contexts").alias("c")).select("k", "h", "c.*"), buckets)
    more = _stored(more.distinct(), "spans-more")
    discard(*tables)
    more = more.groupBy("k", "h").agg(F.collect_list(F.struct("start", "stop")).alias("more"))  # bounded by its document
    schema = T.StructType([T.StructField("doc_id", kind), known.schema["spans"], T.StructField("kept", T.BinaryType())])
    open_ = known.filter(F.col("kept").isNull()).join(more, ["k", "h"], "left").select("doc_id", "text", "spans", "more").mapInArrow(tidy(_finish), schema)
    return known.filter(F.col("kept").isNotNull()).select("doc_id", "spans", "kept").unionByName(open_)


def deduplicated(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    rows = without_repeats(documents).select("doc_id", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept")
    return rows.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
