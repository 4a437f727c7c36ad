"""Secret scans with one deterministic automaton for all rules.

Rule regexes become one nondeterministic automaton over bytes, then by subset construction and minimisation one
transition array. A single pass over a text's bytes tells where some rule's match ends; the rule's reversed
automaton gives the leftmost start, its own automaton the longest end. Matches of a rule don't overlap, and one
that is too short for its rule is dropped after it has used up its text, as a leftmost scan would do.

Nulls are empty texts; repeated rows are scanned one by one; other columns are ignored. A text of any length is
scanned whole, in time linear in its length: no byte is walked more than a few times for each rule.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import large_strings, tidy


@dataclass(frozen=True)
class Rule:
    """kind, regex over ASCII, least length of the match, or of what follows the prefix regex if there is one."""

    kind: str
    regex: str
    least: int
    prefix: str = ""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: The first three are the base kinds; an in-text order of kinds, used to sort equal starts.
RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 8, _ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(([\r\n]+[A-Za-z0-9+/=]+)+[\r\n]+-----END [A-Z ]*PRIVATE KEY-----|([\r\n]+[A-Za-z0-9+/=]{20,})*)", 27),
)
BASE = 3


class Nfa:
    """Byte automaton with empty moves, grown from regexes over ASCII.

    A regex has literals, classes, groups (also ``(?:`` and ``(?i:``), ``|`` and the repeats ``? * + {n} {n,} {n,m}``.
    """

    def __init__(self):
        self.empty: list[set[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append(set())
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int, reverse: bool) -> int:
        """Append what a parsed regex matches after start; gives the last state."""
        kind = node[0]
        if kind == "bytes":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "row":
            for part in reversed(node[1]) if reverse else node[1]:
                start = self.add(part, start, reverse)
            return start
        if kind == "either":
            end = self.state()
            for part in node[1]:
                self.empty[self.add(part, start, reverse)].add(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start, reverse)
        end = self.state()
        self.empty[start].add(end)
        if high is None:
            self.empty[self.add(inner, end, reverse)].add(end)
        else:
            for _ in range(high - low):
                start = self.add(inner, start, reverse)
                self.empty[start].add(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)


class _Regex:
    """Parts of a regex, read from left to right: bytes, row, either and repeat nodes."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.node = self.either(False)
        if self.at < len(text):
            raise ValueError(f"rules can't use {text[self.at :]!r}")

    def next(self, some: str = "") -> str:
        """The next character, used up if it is one of some (or in any case)."""
        c = self.text[self.at : self.at + 1]
        if not c or some and c not in some:
            return ""
        self.at += 1
        return c

    def either(self, fold: bool):
        parts = [self.row(fold)]
        while self.next("|"):
            parts.append(self.row(fold))
        return parts[0] if len(parts) == 1 else ("either", parts)

    def row(self, fold: bool):
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            part = self.one(fold)
            if sign := self.next("?*+{"):
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign, (0, None))
                if sign == "{":
                    first, comma, last = self.text[self.at : self.text.index("}", self.at)].partition(",")
                    self.at = self.text.index("}", self.at) + 1
                    low, high = int(first), int(last) if last else None if comma else int(first)
                part = ("repeat", part, low, high)
            parts.append(part)
        return ("row", parts)

    def one(self, fold: bool):
        c = self.next()
        if c == "(":
            if self.text.startswith(("?:", "?i:"), self.at):
                fold |= self.text[self.at + 1] == "i"
                self.at = self.text.index(":", self.at) + 1
            inner = self.either(fold)
            if not self.next(")"):
                raise ValueError(f"a group of {self.text!r} isn't closed")
            return inner
        if c == "[":
            negate, found = bool(self.next("^")), set()
            while not self.next("]"):
                low = self.letter(self.next())
                high = low
                if self.text.startswith("-", self.at) and not self.text.startswith("-]", self.at):
                    self.at += 1
                    high = self.letter(self.next())
                found.update(range(low, high + 1))
        else:
            if c in ".^$?*+{":
                raise ValueError(f"rules can't use {c}")
            negate, found = False, {self.letter(c)}
        if fold:
            found |= {b ^ 32 for b in found if chr(b).isalpha()}
        return ("bytes", frozenset(range(256)) - found if negate else frozenset(found))

    def letter(self, c: str) -> int:
        if c == "\\":
            c = self.next()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if c.isalnum() and c not in "trnfv":
                raise ValueError(f"rules can't use \\{c}")
            c = {"t": "\t", "r": "\r", "n": "\n", "f": "\f", "v": "\v"}.get(c, c)
        if not c or ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)


@dataclass
class Dfa:
    """next: (states, 256) transition array, state 0 is the start; accepts: bit set of rules at each state."""

    next: np.ndarray
    accepts: np.ndarray


def determinised(regexes: list[str], search: bool, reverse: bool = False) -> Dfa:
    """Subset construction of all regexes at once, then minimisation. search: a match may begin at any byte."""
    nfa = Nfa()
    start = nfa.state()
    finals: dict[int, int] = {}
    for i, text in enumerate(regexes):
        first = nfa.state()
        nfa.empty[start].add(first)
        last = nfa.add(_Regex(text).node, first, reverse)
        finals[last] = finals.get(last, 0) | 1 << i
    if search:
        nfa.moves[start].append((frozenset(range(256)), start))
    # bytes that no rule tells apart share a column
    sets = list({s for moves in nfa.moves for s, _ in moves})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    classes = {g: i for i, g in enumerate(dict.fromkeys(signature))}
    column = np.array([classes[g] for g in signature])
    example = [signature.index(g) for g in classes]
    number = {nfa.closure([start]): 0}
    order = list(number)
    rows: list[list[int]] = []
    for states in order:
        row = []
        moves = [m for s in states for m in nfa.moves[s]]
        for byte in example:
            target = nfa.closure([t for on, t in moves if byte in on])
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([functools.reduce(lambda a, s: a | finals.get(s, 0), states, 0) for states in order])
    table, accepts = _minimised(table, accepts)
    return Dfa(table[:, column], accepts)


def _minimised(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart, by refining the split by accepted rules."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer.ravel()
    shown: dict[int, int] = {}
    for b in block.tolist():  # the start state stays number 0
        shown.setdefault(b, len(shown))
    block = np.array([shown[b] for b in block.tolist()])
    heads = np.array([int(np.flatnonzero(block == i)[0]) for i in range(len(shown))])
    return block[table[heads]], accepts[heads]


class Scanner:
    """Finds all rules' spans in a text's bytes."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        together = determinised([r.prefix + r.regex for r in rules], search=True)
        quiet = np.argsort(together.accepts > 0, kind="stable")  # accepting states last; the start isn't one
        place = np.empty_like(quiet)
        place[quiet] = np.arange(quiet.size)
        self.table = _flat(place[together.next[quiet]])
        self.loud = int((together.accepts == 0).sum()) * 256
        self.hits = [[i for i in range(len(rules)) if a >> i & 1] for a in together.accepts[quiet].tolist()]
        whole = [r.prefix + r.regex for r in rules]
        self.back = [self._one(x, reverse=True) for x in whole]
        self.forth = [self._one(x) for x in whole]
        self.alone = [self._one(x, search=True) for x in whole]
        self.lead = [self._one(r.prefix) if r.prefix else None for r in rules]

    @staticmethod
    def _one(regex: str, reverse: bool = False, search: bool = False):
        d = determinised([regex], search=search, reverse=reverse)
        dead = [i for i in range(len(d.accepts)) if not d.accepts[i] and (d.next[i] == i).all()]
        return _flat(d.next), {i * 256 for i in np.flatnonzero(d.accepts).tolist()}, dead[0] * 256 if dead else -1

    @staticmethod
    def _furthest(machine, data, at: int, stop: int, step: int) -> int:
        """The furthest place at which the machine accepts on its way from at to stop; -1 if none."""
        table, good, dead = machine
        state, best = 0, at if 0 in good else -1
        while at != stop:
            state = table[state + data[at if step > 0 else at - 1]]
            at += step
            if state == dead:
                break
            if state in good:
                best = at
        return best

    def _next_end(self, r: int, data: bytes, at: int) -> int:
        """The first place at which a match of rule r that begins at or after `at` ends; 0 if there is none."""
        table, good, _ = self.alone[r]
        state = 0
        for i in range(at, len(data)):
            state = table[state + data[i]]
            if state in good:
                return i + 1
        return 0

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule number, start, end) in bytes, by start and rule.

        Each walk back stops at the rule's last match, and so does each walk of a rule's own search; the walks of one
        rule never overlap by more than one match.
        """
        found = []
        done = [0] * len(self.rules)
        table, loud, state = self.table, self.loud, 0
        for i, byte in enumerate(data):
            state = table[state + byte]
            if state >= loud:
                for r in self.hits[state >> 8]:
                    if i < done[r]:
                        continue
                    last = i + 1
                    start = self._furthest(self.back[r], data, last, done[r], -1)
                    if start < 0:  # it would begin inside the match before: search anew from that one's end
                        last = self._next_end(r, data, done[r])
                        if not last:
                            done[r] = len(data)
                            continue
                        start = self._furthest(self.back[r], data, last, done[r], -1)
                    end = self._furthest(self.forth[r], data, start, len(data), 1)
                    done[r] = end
                    body = self._furthest(self.lead[r], data, start, end, 1) if self.lead[r] else start
                    if end - body >= self.rules[r].least:
                        found.append((r, start, end))
        return sorted(found, key=lambda x: (x[1], x[0]))


def _flat(table: np.ndarray) -> list[int]:
    """Rows one after another, each entry the place of the next state's row."""
    places = [i * 256 for i in range(len(table))]
    return [places[s] for s in table.ravel().tolist()]


@functools.lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One scanner for each process; it is made from the rules alone."""
    return Scanner(rules)


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, found: array of (kind, start, end) in code points, end exclusive, by start and kind."""
    large_strings(documents)
    source = documents.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("found", T.ArrayType(_SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        find = scanner(rules)
        for batch in batches:
            out = []
            for value in batch.column(1):
                data = value.as_py() or b""
                spans, seen, points = [], 0, 0
                marks = {}
                hits = find.spans(data)
                for at in sorted({x for _, s, e in hits for x in (s, e)}):
                    points += len(data[seen:at].decode("utf-8", "replace"))
                    seen, marks[at] = at, points
                for r, s, e in hits:
                    spans.append({"kind": rules[r].kind, "start": marks[s], "end": marks[e]})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], names=["doc_id", "found"])

    return source.mapInArrow(tidy(run), schema)


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret (a rule's whole span) replaced by the mark; overlapping spans by one mark.

    Texts without one are as they were; null texts stay null; all columns stay.
    """
    large_strings(documents)
    source = documents
    at = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        find = scanner(rules)
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                data = text.encode("utf-8", "surrogatepass") if text else b""
                pieces, last = [], 0
                for _, s, e in find.spans(data):
                    if s >= last:
                        pieces += [data[last:s], mark.encode()]
                    last = max(last, e)
                texts.append(b"".join([*pieces, data[last:]]).decode("utf-8", "surrogatepass") if pieces else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return source.mapInArrow(tidy(run), source.schema)


def secret_scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    base = [r.kind for r in rules[:BASE]]
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(documents, rules).select("doc_id", *[count(k) for k in base], F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined("found").alias("spans"))
