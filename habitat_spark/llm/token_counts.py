"""Token counts by a tokenizer that is compiled into a deterministic transducer.

A state stands for all that matters of the text read so far: the kind of piece that is open, the places in it at
which a later token may still begin (a node of the trie of tokens, the token that ends there, and the count there),
and how much of a special string has been read. Each transition carries the change of the text's token count, which
may fall when tokens join, so the sum along a text is its number of tokens at every place. States are made when first
reached (a subset construction over the trie) and shared by all texts that lead to the same one.

The rule that makes states finite: an encoding's tokens are those of its neighbours alone. The encoding of a prefix
ends with the one token that may stand after the encoding of what is before it, and two tokens may stand side by
side if the merges leave their joined bytes as these two.

Texts of over CHUNK characters are cut into chunks, and each chunk's map of states is made on its own. White space
after a visible character always begins a piece, whatever the state before, so all entry states agree from the first
such place on: the map is what must be read up to there, the count from there to the last such place, and what is
left open. Maps compose associatively, in a prefix scan of two rounds over groups of FAN chunks.

Null texts are empty and have no tokens. Repeated rows and doc_ids are counted one by one, null doc_ids too; other
columns are ignored; no rows give an empty table. Special strings inside texts are one token each, as is the
library's default. Tokenizers of another kind than byte-level BPE without a normaliser are refused.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pieces_of
from .common import large_strings, tidy

#: Characters of a chunk; longer texts are cut.
CHUNK = 1 << 20
#: Chunk maps composed by one task in one round; two rounds are beyond the longest string.
FAN = 64
#: States of a process after which it starts anew, and entries in each half of its memory of pieces.
STATES = 150_000
MEMORY = 300_000

_OPEN, _LETTERS, _NUMBERS, _SIGNS, _SPACES, _QUOTE, _QUOTED = range(7)
_KIND = [(regex.compile(p), k) for p, k in ((r"\p{L}", _LETTERS), (r"\p{N}", _NUMBERS), (r"\s", _SPACES))]
#: The short forms that the pattern of the tokenizer keeps whole.
_ONE, _TWO = "stmd", ("re", "ve", "ll")
_NEVER = 1 << 40
_WORD = regex.compile(r"\p{L}+")
_SYNC = regex.compile(r"(?<=\S)\s")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class State(dict):
    """Transitions: character to (state, change of the count); missing ones are made on sight."""

    __slots__ = ("key", "own")

    def __missing__(self, c: str):
        found = self[c] = self.own.step(self.key, c)
        return found


class Transducer:
    """Counts tokens of texts by one walk over their characters."""

    def __init__(self, source: str, states: int = STATES):
        made = json.loads(source)
        model, before = made["model"], made["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or made["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE without normaliser and prefix space can be compiled")
        self.special = [t["content"] for t in made["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]) or any(a != b and b.startswith(a) for a in self.special for b in self.special):
            raise ValueError("added tokens must be plain strings, none the start of another")
        table = byte_of()
        to_bytes = lambda s: bytes(table[c] for c in s)
        special = set(self.special)
        self.tokens = [to_bytes(s) for s in model["vocab"] if s not in special]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.ranks: dict[int, int] = {}  # a << 32 | b to the rank of joining tokens a and b
        self.parts: dict[int, tuple[int, int, int]] = {}  # token to the two that make it, and the rank
        for rank, m in enumerate(model["merges"]):
            a, b = (to_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            if a + b not in number or number[a + b] in self.parts:
                raise ValueError("each merge must make a token of its own")
            self.ranks[number[a] << 32 | number[b]] = rank
            self.parts[number[a + b]] = (number[a], number[b], rank)
        self.child: dict[int, int] = {}  # node << 8 | byte to node
        self.token = [-1]  # of each node
        self.inner: set[int] = set()
        for i, t in enumerate(self.tokens):
            node = 0
            for b in t:
                self.inner.add(node)
                node = self.child.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.beside: dict[int, bool] = {}
        self.starts = {s[0] for s in self.special}
        self.memory: dict[str, int] = {}
        self.older: dict[str, int] = {}  # the half before; what is met again moves up
        self.most = states
        self.fresh = ((0, -1, 0),)
        self.kinds: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.known: dict[tuple, State] = {}
        self.root = self._state((_OPEN, self.fresh, None, "", ()))

    def _state(self, key: tuple) -> State:
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = State()
            found.key, found.own = key, self
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that takes it up) along the left (0) or right (1) edge, from the single byte to the token."""
        found = self.edges.get((token, side))
        if found is None:
            found, up = [], _NEVER
            while True:
                found.append((token, up))
                if token not in self.parts:
                    break
                *two, up = self.parts[token]
                token = two[side]
            found.reverse()
            self.edges[found[-1][0], side] = found
        return found

    def _fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart side by side (b alone after -1, the start of a piece).

        Of the two edges that meet, the merge of least rank comes first, and of equal ones the left one: either one
        edge grows, or a merge crosses.
        """
        if a < 0:
            return True
        found = self.beside.get(a << 32 | b)
        if found is None:
            left, right = self._edge(a, 1), self._edge(b, 0)
            i = j = 0
            found = True
            while found:
                (x, up), (y, over) = left[i], right[j]
                across = self.ranks.get(x << 32 | y, _NEVER)
                if across < up and across <= over and across < _NEVER:
                    found = False
                elif up <= over:
                    if up == _NEVER:
                        break
                    i += 1
                else:
                    j += 1
            if len(self.beside) > 8 * self.most:
                self.beside.clear()
            self.beside[a << 32 | b] = found
        return found

    def _read(self, cuts: tuple, data: bytes) -> tuple[tuple, int]:
        """Places of an open piece after more bytes, and the change of its count."""
        total = 0
        for b in data:
            last, count, moved = -1, 0, []
            for node, before, at in cuts:
                after = self.child.get(node << 8 | b)
                if after is None:
                    continue
                if after in self.inner:
                    moved.append((after, before, at))
                t = self.token[after]
                if last < 0 and t >= 0 and self._fits(before, t):
                    last, count = t, at + 1
            cuts = (*((n, x, at - count) for n, x, at in moved), (0, last, 0))
            total += count
        return cuts, total

    def _kind(self, c: str) -> int:
        found = self.kinds.get(c)
        if found is None:
            found = self.kinds[c] = next((k for p, k in _KIND if p.match(c)), _SIGNS)
        return found

    def _begin(self, c: str, kind: int, change: int) -> tuple[tuple, int]:
        """A new piece's first character, after a change of the count."""
        cuts, d = self._read(self.fresh, c.encode("utf-8", "surrogatepass"))
        if kind == _SPACES:
            return (kind, cuts, (c, -d)), change + d
        return (_QUOTE if c == "'" else kind, cuts, None), change + d

    def _core(self, kind: int, cuts: tuple, extra, c: str) -> tuple[tuple, int]:
        """The open piece after one more character, and the change of the count."""
        now, data = self._kind(c), c.encode("utf-8", "surrogatepass")
        if kind == _SPACES:
            last, back = extra  # without its last character, the count is less by that
            if now == _SPACES:
                cuts, d = self._read(cuts, data)
                return (kind, cuts, (c, -d)), d
            if last == " ":
                cuts, d = self._read(self.fresh, b" " + data)
                return (now, cuts, None), back + d
            return self._begin(c, now, back + self._read(self.fresh, last.encode())[1])
        if kind == _QUOTE:
            alone = self._read(self.fresh, b"'")[1]
            if c in _ONE:
                return (_OPEN, self.fresh, None), self._read(self.fresh, b"'" + data)[1] - alone
            if any(x[0] == c for x in _TWO):
                cuts, d = self._read(self.fresh, data)
                return (_QUOTED, cuts, (c, -d - alone)), d
            kind = _SIGNS
        elif kind == _QUOTED:
            letter, back = extra
            if letter + c in _TWO:
                return (_OPEN, self.fresh, None), back + self._read(self.fresh, ("'" + letter + c).encode())[1]
            kind = _LETTERS
        if kind != now:
            return self._begin(c, now, 0)
        cuts, d = self._read(cuts, data)
        return (kind, cuts, None), d

    def step(self, key: tuple, c: str) -> tuple[State, int]:
        """The state after one more character, and the change of the count."""
        kind, cuts, extra, part, backs = key
        core, d = self._core(kind, cuts, extra, c)
        if len(self.known) > self.most:
            self._restart()
        if not part and c not in self.starts:
            return self._state((*core, part, backs)), d
        part, backs = part + c, (*(b - d for b in backs), -d)  # counts before each character of part
        for i in range(len(part) + 1):
            rest = part[i:]
            if rest in self.special:
                core, d, part, backs = (_OPEN, self.fresh, None), d + backs[i] + 1, "", ()
                break
            if any(s.startswith(rest) for s in self.special) or not rest:
                part, backs = rest, backs[i:]
                break
        return self._state((*core, part, backs)), d

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        state, total = self.root, 0
        for c in text:
            state, d = state[c]
            total += d
        return total

    def counted(self, text: str) -> int:
        """The same, with a memory of the pieces met."""
        pieces = pieces_of(text)
        total = self.count(pieces[0])
        del pieces[0]
        if len(self.memory) > MEMORY:
            self.older, self.memory = self.memory, {}
        self.learn(set(pieces).difference(self.memory))
        return total + sum(map(self.memory.__getitem__, pieces))

    def learn(self, pieces: set[str]) -> None:
        """Put the counts of these pieces, each after a space, into memory; letters and what follows them are apart."""
        for p in pieces:
            n = self.older.get(p)
            if n is None:
                word = _WORD.match(p)
                if word and word.end() < len(p):
                    core = word.group()
                    n = self.memory.get(core)
                    if n is None:
                        n = self.memory[core] = self.older.get(core) or self.count(" " + core)
                    n += self.count(p[word.end() :])
                else:
                    n = self.count(" " + p)
            self.memory[p] = n


class ChunkMap(tuple):
    """(head, count, tail) of a chunk; a count of None if no place in it makes all states agree (then head is all of it)."""

    @classmethod
    def of(cls, chunk: str, count) -> ChunkMap:
        first = _SYNC.search(chunk)
        if not first:
            return cls((chunk, None, ""))
        at, last = first.start(), len(chunk) - 1
        while not (chunk[last].isspace() and _SYNC.match(chunk, last)):
            last -= 1
        return cls((chunk[:at], count(chunk[at:last]), chunk[last:]))

    def then(self, other: ChunkMap, count) -> ChunkMap:
        """This map and then the other one."""
        if self[1] is None:
            return ChunkMap((self[0] + other[0], other[1], other[2]))
        if other[1] is None:
            return ChunkMap((self[0], self[1], self[2] + other[0]))
        return ChunkMap((self[0], self[1] + count(self[2] + other[0]) + other[1], other[2]))

    def total(self, count) -> int:
        """The number of tokens if the text starts with this map and ends with it."""
        return count(self[0]) + (self[1] or 0) + count(self[2])


@functools.lru_cache(2)
def transducer(source: str) -> Transducer:
    """One transducer for each process and tokenizer."""
    return Transducer(source)


def _short(texts: DataFrame, shared) -> DataFrame:
    """doc_id, n_bytes, n_tokens of texts that aren't cut."""
    def run(batches: Iterator[pa.RecordBatch]):
        own = transducer(shared.value)
        for batch in batches:
            out = []
            for value in batch.column(2):
                out.append(own.counted(value.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(tidy(run), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


_MAP = "uid long, at long, head string, n long, tail string"
_ARROW = pa.schema([("uid", pa.int64()), ("at", pa.int64()), ("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())])


def _long(texts: DataFrame, shared, chunk: int, fan: int) -> DataFrame:
    """The same for texts that are cut into chunks."""
    rows = texts.withColumn("uid", F.monotonically_increasing_id())
    chunks = rows.select("uid", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("text") - 1).cast("int"), F.lit(chunk)), lambda i: F.substring("text", i + 1, F.lit(chunk)))).alias("at", "chunk"))
    chunks = chunks.select("uid", F.col("at").cast("long").alias("at"), "chunk").repartition("uid", "at")

    def mapped(batches: Iterator[pa.RecordBatch]):
        count = transducer(shared.value).count
        for batch in batches:
            maps = [ChunkMap.of(c.as_py(), count) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[i] for m in maps], _ARROW.types[i + 2]) for i in range(3))], schema=_ARROW)

    def composed(table: pa.Table) -> pa.Table:
        count = transducer(shared.value).count
        table = table.sort_by("at")
        maps = [ChunkMap(x) for x in zip(*(table.column(k).to_pylist() for k in ("head", "n", "tail")))]
        whole = functools.reduce(lambda a, b: a.then(b, count), maps)
        return pa.table([table.column("uid")[:1], pa.array([table.column("at")[0].as_py() // fan], pa.int64()), *(pa.array([whole[i]], _ARROW.types[i + 2]) for i in range(3))], schema=_ARROW)

    def ended(batches: Iterator[pa.RecordBatch]):
        count = transducer(shared.value).count
        for batch in batches:
            maps = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ChunkMap(m).total(count) for m in maps], pa.int64())], names=["uid", "n_tokens"])

    maps = chunks.mapInArrow(tidy(mapped), _MAP)
    for _ in range(2):
        maps = maps.groupBy("uid", F.floor(F.col("at") / fan)).applyInArrow(composed, _MAP)
    return rows.select("uid", "doc_id", "n_bytes").join(maps.mapInArrow(tidy(ended), "uid long, n_tokens long"), "uid").drop("uid")


def token_counts(documents: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens)."""
    large_strings(documents)
    with open(path, encoding="utf-8") as file:
        source = file.read()
    Transducer(source)  # refuses what can't be compiled before any task runs
    shared = documents.sparkSession.sparkContext.broadcast(source)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    # rows of short and of long texts, in two reads: long ones are dealt out by chunk
    counted = _short(texts.filter(F.length("text") <= chunk), shared).unionByName(_long(texts.filter(F.length("text") > chunk), shared, chunk, fan))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
