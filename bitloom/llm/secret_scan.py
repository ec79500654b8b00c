"""Secret scans: all rules in one pass over the bytes, by combined deterministic automata.

The rules' expressions are compiled to two minimal automata for all of them (automaton.py). The first finds, anywhere, the opening of each rule:
the sequences of one width each that every match begins with, as far as they are needed to be rare. The one pass
over a text steps through its transition array, byte by byte; its accepting states name rules and widths, so the pass itself gives the
bytes at which matches of all rules may begin. The second automaton, of the whole expressions, goes on from such a byte, and only as long as a match of
that rule can follow, to the longest match. Nothing else of the text is read again. Where many openings of a rule lead nowhere in one text (more bytes than a few
times the text were read in vain), that rule's starts are told by its reversed automaton, in one pass backwards, so time stays linear.

Matches are leftmost, longest and non-overlapping within a rule; a rule's tests drop matches afterwards, and
dropped ones still use up their text. Rules don't disturb each other.

Defined results: null counts as empty and has no secrets; positions are code points, ends exclusive; repeated rows are
scanned each; other columns pass through untouched, whatever their names, but ``secrets``, which is replaced; overlapping spans of several rules are redacted
as one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .automaton import anchored, longest, opening_automaton, reaching, rule_automata
from .common import as_bytes, prepare


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least characters of the match, or of what follows ``prefix`` in it.
    least: int = 0
    prefix: str = ""


_BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: White space, or line ends as they are written in quoted texts.
_BREAK = r"(?:[\x20\t\r\n]|\\[nr])+"
#: Base64, white space and header signs up to the END line, or without one: headers, base64 runs of 16 or more, and what is left of the last.
_BODY = rf"""(?:(?:[A-Za-z0-9+/=\x20\t\r\n\\:,.()"'>]|-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----|(?:{_BREAK}(?:Proc-Type|DEK-Info):\x20*[A-Za-z0-9,-]+)*(?:{_BREAK}[A-Za-z0-9+/]{{16,}}=*)+(?:{_BREAK}[A-Za-z0-9+/]+=*)?)"""

#: The base rules, in their order. A run of hexadecimal digits is maximal, so its length can stand in the expression.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Public formats of tokens and keys beyond the base.
ADDED = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]+", 60),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", 26),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]+", 20),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("npm", r"npm_[A-Za-z0-9]+", 40),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", 40),
    Rule("url_login", r"://[A-Za-z0-9._~%!$&*+-]+:[^\x20\t\r\n/@:\"'<>]+@", 8),
    Rule("bearer", r"(?i:authorization:\x20*bearer)\x20+[A-Za-z0-9._~+/-]+=*", 20, r"(?i:authorization:\x20*bearer)\x20+"),
    Rule("private_key", rf"{_BEGIN}{_BODY}?"),
)
RULES = BASE + ADDED


#: How many times a text's length (and bytes beside) may be read from openings that lead nowhere, for each rule.
_VAIN, _VAIN_BYTES = 4, 10_000


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        patterns = tuple(r.pattern for r in rules)
        self.dfa, self.ways = opening_automaton(patterns)
        # each entry is the offset of the next state's row, so a step is one addition and one look-up
        self.moves = (self.dfa.moves.astype(np.int64) * 256).tolist()
        self.first, self.accepting = self.dfa.start * 256, self.dfa.accepting * 256
        self.whole = anchored(patterns)
        self.steps = (self.whole.moves.astype(np.int64) * 256).tolist()
        self.reach = [reaching(self.whole, rule) for rule in range(len(rules))]
        # ends of openings come in the order of their starts where all are of one width
        self.steady = [len({w for r, w in self.ways if r == rule}) == 1 for rule in range(len(rules))]
        self.single: dict[str, tuple] = {}

    def _automata(self, pattern: str):
        if pattern not in self.single:
            forward, backward = rule_automata(pattern)
            self.single[pattern] = forward, forward.moves.tolist(), backward, (backward.moves.astype(np.int64) * 256).tolist()
        return self.single[pattern]

    def _end(self, rule: int, data: bytes, start: int) -> tuple[int, int]:
        """(end of the rule's longest match from start, or -1; bytes read beyond it)."""
        state, steps, reach, end, at = self.whole.start * 256, self.steps, self.reach[rule], -1, start
        for at in range(start, len(data)):
            state = steps[state + data[at]]
            found = reach[state >> 8]
            if found == 2:
                end = at + 1
            elif not found:
                break
        return end, at + 1 - (end if end >= 0 else start)

    def _backwards(self, rule: int, data: bytes) -> list[tuple[int, int]]:
        """All matches of a rule with starts told by its reversed automaton."""
        forward, moves, backward, back = self._automata(self.rules[rule].pattern)
        state, least, starts = backward.start * 256, backward.accepting * 256, []
        at = len(data)
        for byte in reversed(data):
            state = back[state + byte]
            at -= 1
            if state >= least:
                starts.append(at)
        found, after = [], 0
        for start in reversed(starts):
            if start >= after:
                after = longest(moves, forward, data, start)
                found.append((start, after))
        return found

    def _all(self, data: bytes) -> list[list[tuple[int, int]]]:
        """The one pass: the matches of each rule, before its tests."""
        n = len(self.rules)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        later: list[list[int]] = [[] for _ in range(n)]
        after, vain, limit = [0] * n, [0] * n, _VAIN * len(data) + _VAIN_BYTES

        def take(rule: int, start: int) -> None:
            if start < after[rule] or vain[rule] > limit:
                return
            end, read = self._end(rule, data, start)
            vain[rule] += read
            after[rule] = end if end >= 0 else start + 1
            if end >= 0:
                found[rule].append((start, end))

        state, moves, accepting, labels, ways, at = self.first, self.moves, self.accepting, self.dfa.labels, self.ways, 0
        for byte in data:
            at += 1
            state = moves[state + byte]
            if state >= accepting:
                for way in labels[state >> 8]:
                    rule, width = ways[way]
                    if self.steady[rule]:
                        take(rule, at - width)
                    else:
                        later[rule].append(at - width)
        for rule in range(n):
            for start in sorted(later[rule]):
                take(rule, start)
            if vain[rule] > limit:
                found[rule] = self._backwards(rule, data)
        return found

    def matches(self, rule: Rule, data: bytes) -> list[tuple[int, int]]:
        return [x for x in self._all(data)[self.rules.index(rule)] if self._passes(rule, data, *x)]

    def _passes(self, rule: Rule, data: bytes, start: int, end: int) -> bool:
        if rule.prefix:
            forward, moves, _, _ = self._automata(rule.prefix)
            start = longest(moves, forward, data[start:end], 0) + start
        return end - start >= rule.least

    def spans(self, data: bytes) -> list[tuple[int, int, str]]:
        """(start, end, kind) in bytes, by start, then in the rules' order."""
        every = self._all(data)
        if not any(every):
            return []
        found = [(start, end, i) for i, some in enumerate(every) for start, end in some if self._passes(self.rules[i], data, start, end)]
        return [(start, end, self.rules[i].kind) for start, end, i in sorted(found, key=lambda x: (x[0], x[2]))]


def code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans or data.isascii():
        return spans
    upto = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(upto[a]), int(upto[b]), kind) for a, b, kind in spans]


def redacted(data: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [data[at:start], f"[{kind.upper()}]".encode()]
        at = max(at, end)
    return b"".join([*out, data[at:]])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _scan(rules: tuple[Rule, ...], redact: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            spans, texts = [], []
            for text, known in zip(as_bytes(batch.column(0)), batch.column(0).is_valid().to_pylist(), strict=True):
                found = scanner.spans(text)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in code_points(text, found)])
                if redact:
                    texts.append(redacted(text, found).decode() if known else None)
            columns = [*batch.columns[1:], *([pa.array(texts, pa.string())] if redact else []), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return scan


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """The columns in ``keep`` (default: all) and ``secrets``; with redact, ``text`` has [KIND] in place of each span."""
    prepare(documents.sparkSession)
    kept = [c for c in (documents.columns if keep is None else keep) if c != "secrets" and not (redact and c == "text")]
    added = [*(["text"] if redact else []), "secrets"]
    # by place, so that no name can clash with one of ours
    rows = documents.select("text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    shape = rows.drop("text").schema
    for i, name in enumerate(added, len(kept)):
        shape = shape.add(f"c{i}", DataType.fromDDL("string" if name == "text" else "array<struct<start:long,end:long,kind:string>>"))
    return rows.mapInArrow(_scan(rules, redact), shape).toDF(*kept, *added)
