"""Secret scans with a trigram inverted index.

From each rule's parsed expression a Boolean trigram query is derived: a conjunction of the trigrams that every match
must hold, or disjunctions over the alternatives of a rule (Python's own expression parser gives the tree). Each Arrow
batch of documents is a segment with its own inverted index over the trigrams that any query names: posting lists of
documents, found in one vectorised pass over the batch's bytes. A query's postings are intersected and united, and only
the documents left are searched with the expression. Rules without a mandatory trigram scan every document.

Matching is leftmost and non-overlapping for each kind; matches whose value is too short are dropped after matching.
Letter case: trigrams are looked up in ASCII lower case, so they never lose a match; the expressions decide.

Null and empty texts have no secrets. Positions are code points, ends exclusive. Repeated rows give repeated rows;
a null doc_id stays null; columns besides doc_id and text are ignored here and kept by redact().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: How many strings an exact set may hold while a query is derived, and how long they may be.
_SET, _LONG = 64, 12


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    #: A faster expression with the same matches of `least` characters or more, where there is one.
    scan: str | None = None

    def compiled(self, fast: bool = False) -> re.Pattern:
        return re.compile((fast and self.scan) or self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The three base rules, then the further ones; spans that start together come in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24, r"[0-9a-f]{24,}"),
)
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE + FURTHER

#: A query: True (no trigram is mandatory), a trigram, or ("and" | "or", queries).


def _both(kind: str, parts: list):
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(s: str):
    grams = [s[i : i + 3] for i in range(len(s) - 2)]
    return _both("and", grams)


def _of_set(strings: set[str]):
    return _both("or", [_of_string(s) for s in sorted(strings)])


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all strings that the tree matches, or None if too many; the query of its matches)."""
    run: set[str] | None = {""}
    asked: list = []
    for op, arg in tree:
        exact, query = _one(op, arg)
        if exact is not None and run is not None and len(run) * len(exact) <= _SET and all(len(a) + len(b) <= _LONG for a in run for b in exact):
            run = {a + b for a in run for b in exact}
            continue
        if run is not None:
            asked.append(_of_set(run))
        asked.append(query)
        run = exact
        if exact is None:
            run = {""}
            asked.append(True)
    whole = run if not asked else None
    if run is not None:
        asked.append(_of_set(run))
    return whole, _both("and", asked)


def _one(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        c = chr(arg).lower()
        return {c if c.isascii() else chr(arg)}, True
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower() if x < 128 else chr(x))
            elif kind is C.RANGE and x[1] - x[0] < 8:
                chars |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        parts = [_walk(t) for t in arg[1]]
        exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        if exact is not None and len(exact) <= _SET:
            return exact, _of_set(exact)
        return None, _both("or", [p[1] if p[0] is None else _of_set(p[0]) for p in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, query = _walk(inner)
        if low == 0:
            return ({"", *exact}, True) if high == 1 and exact is not None else (None, True)
        if low == high == 1:
            return exact, query
        return None, query if exact is None else _of_set(exact)
    if op is C.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str):
    """The Boolean trigram query, in lower case, that every match of the expression fulfils; True: none."""
    exact, query = _walk(parser.parse(pattern))
    return _of_set(exact) if exact is not None else query


def _grams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_grams, query[1:]))


class Index:
    """The inverted index of a segment: documents by trigram, for the trigrams (ASCII, lower case) that are asked."""

    def __init__(self, grams: list[str]):
        self.grams = [g for g in grams if g.isascii()]
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        #: Five bits of each byte make a slot; what shares a slot with a trigram is told apart afterwards.
        self.slot = np.zeros(1 << 15, bool)
        self.codes = {self._code(g): g for g in self.grams}
        for g in self.grams:
            a, b, c = g.encode()
            self.slot[(a & 31) << 10 | (b & 31) << 5 | c & 31] = True

    @staticmethod
    def _code(g: str) -> int:
        a, b, c = g.encode()
        return a << 16 | b << 8 | c

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """data: the bytes of the segment's texts; offsets: where each text starts, and the end."""
        out: dict[str, list] = {g: [] for g in self.grams}
        step = 1 << 20
        for s in range(0, max(0, len(data) - 2), step):
            part = self.lower[data[s : s + step + 2]]
            low = (part & 31).astype(np.uint16)
            at = np.flatnonzero(self.slot[low[:-2] << 10 | low[1:-1] << 5 | low[2:]])
            code = part[at].astype(np.int32) << 16 | part[at + 1].astype(np.int32) << 8 | part[at + 2]
            order = np.argsort(code, kind="stable")
            code, at = code[order], at[order] + s
            edges = [*np.flatnonzero(np.diff(code, prepend=-1)), len(code)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if g := self.codes.get(int(code[lo])):
                    where = at[lo:hi]
                    doc = np.searchsorted(offsets, where, "right") - 1
                    out[g].append(np.unique(doc[where + 3 <= offsets[doc + 1]]))
        return {g: np.unique(np.concatenate(v)) if v else np.empty(0, np.int64) for g, v in out.items()}


def candidates(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings[query] if query in postings else np.arange(n)
    parts = [candidates(q, postings, n) for q in query[1:]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    found = parts[0]
    for p in parts[1:]:
        found = np.intersect1d(found, p, assume_unique=True)
    return found


def _segment(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_spans(column: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int, int]]]:
    """For each text of a segment its spans (start, rule number, end, number of the rule's group start)."""
    asked = [trigram_query(r.pattern) for r in rules]
    index = Index(sorted(set().union(*map(_grams, asked))))
    data, offsets = _segment(column)
    postings = index.postings(data, offsets)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(column))]
    texts = column.to_pylist()
    for k, (rule, query) in enumerate(zip(rules, asked, strict=True)):
        scan = rule.compiled(fast=True)
        for i in candidates(query, postings, len(column)).tolist():
            text = texts[i]
            if not text:
                continue
            for m in scan.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), k, m.end(), m.start(rule.group)))
    for spans in out:
        spans.sort()
    return out


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = find_spans(batch.column(1), rules)
            counts = [[sum(s[1] == k for s in spans) for spans in rows] for k in range(3)]
            said = [[(k, f"{rules[k].kind}:{a}:{b}") for a, k, b, _ in spans] for spans in rows]
            sha = [hashlib.sha256(",".join(s for k, s in x if k < 3).encode()).hexdigest() for x in said]
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([",".join(s for _, s in x) for x in said], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans). rules: BASE first, then any further ones."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(rules), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(rules: tuple[Rule, ...], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(find_spans(batch.column(at), rules)):
                out, done = [], 0
                for start, k, end, value in spans:
                    if end <= done:
                        continue
                    out += [texts[i][done : max(done, value)], f"[REDACTED {rules[k].kind}]"] if value >= done else []
                    done = end
                if spans:
                    texts[i] = "".join(out) + texts[i][done:]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.record_batch(cols, schema=batch.schema)

    return run


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the value of every secret in its text replaced by a mark; other columns and rows stay."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redacted(rules, docs.columns.index("text")), docs.schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
