"""Secret scans behind a trigram inverted index.

A Boolean query over trigrams is derived from the parsed form of each rule's regular expression: a text that matches must satisfy it.
For each run of rows an inverted index is built for the trigrams that some rule mentions (posting = set of rows), each rule's
query intersects and unites postings, and only the candidates are scanned by the expression. A rule whose expression has no
mandatory trigram scans every row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Chunk, chunks, column, raw, release

#: ("all",) is satisfied by every text; ("and" | "or", parts) combine; a string is a trigram.
Query = tuple | str
EVERY: Query = ("all",)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    min_chars: int = 0
    #: The group that ``min_chars`` measures and that redaction replaces.
    group: int = 0

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: Kinds whose spans the base report counts, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=20),
    Rule("hex", r"[0-9a-f]+", min_chars=24),
)
#: Further kinds that only trigram queries make cheap.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def _both(a: Query, b: Query) -> Query:
    return b if a == EVERY else a if b == EVERY or a == b else ("and", (a, b))


def _either(parts: list[Query]) -> Query:
    return EVERY if EVERY in parts else parts[0] if len(set(parts)) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _trigrams(words: set[str]) -> Query:
    """What a text holds if it holds one of the words. Only trigrams of ASCII characters are indexed; others ask for nothing."""
    found = []
    for w in sorted(words):
        query = EVERY
        for k in range(len(w) - 2):
            if w[k : k + 3].isascii():
                query = _both(query, w[k : k + 3])
        found.append(query)
    return _either(found) if found else EVERY


def _known(node) -> tuple[set[str] | None, Query]:
    """(the finite set of strings that a parsed expression can match, or None; a query that its matches satisfy)."""
    words: set[str] | None = {""}
    query: Query = EVERY

    def flush() -> None:
        nonlocal words, query
        query = _both(query, _trigrams(words or {""}))
        words = {""}

    whole = True
    for op, arg in node:
        part: set[str] | None = None
        below: Query = EVERY
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            part = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            part, below = _known(arg[3])
        elif op is sre.BRANCH:
            both = [_known(x) for x in arg[1]]
            if all(w is not None for w, _ in both):
                part = set().union(*(w for w, _ in both))
            else:
                below = _either([q if w is None else _trigrams(w) for w, q in both])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            some, deep = _known(inner)
            if most == 1 and some is not None:
                part = some | ({""} if least == 0 else set())
            elif least > 0:
                below = deep if some is None else _trigrams(some)
        elif op is sre.AT:
            part = {""}
        if part is not None and len(words) * len(part) <= 64:
            words = {w + p for w in words for p in part}
        else:
            whole = False
            flush()
            query = _both(query, below if part is None else _trigrams(part))
    if whole:
        return words, EVERY
    flush()
    return None, query


def trigram_query(pattern: str) -> Query:
    """The Boolean query of a pattern, over lower-cased trigrams."""
    words, query = _known(_parser.parse(pattern))
    return _trigrams(words) if words is not None else query


def _leaves(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query == EVERY else set().union(*map(_leaves, query[1]))


class Index:
    """Postings of the wanted trigrams in some rows."""

    def __init__(self, c: Chunk, wanted: dict[str, int], number: np.ndarray):
        low = np.where((c.data >= 65) & (c.data <= 90), c.data + 32, c.data).astype(np.int32)
        self.rows, self.wanted = c.rows, wanted
        self.postings = np.zeros((len(wanted), c.rows), dtype=bool)
        if len(low) > 2:
            code = number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(code)
            row, last = c.row_of(at), c.row_of(at + 2)
            within = row == last
            self.postings[code[at[within]] - 1, row[within]] = True

    def rows_of(self, query: Query) -> np.ndarray:
        if query == EVERY:
            return np.ones(self.rows, dtype=bool)
        if isinstance(query, str):
            return self.postings[self.wanted[query]]
        parts = [self.rows_of(q) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def find_spans(rules: tuple[Rule, ...], batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, int, list[list[tuple[int, int, int, int, int]]]]]:
    """For runs of rows: each row's spans (start, rule number, end, start and end of the secret part) in order."""
    asked = [trigram_query(r.pattern) for r in rules]
    compiled = [r.regex for r in rules]
    wanted = {t: k for k, t in enumerate(sorted(set().union(*map(_leaves, asked))))}
    number = np.zeros(1 << 24, dtype=np.uint16)
    for t, k in wanted.items():
        a, b, c = t.encode("utf-8")
        number[(a << 16) | (b << 8) | c] = k + 1
    for batch in batches:
        texts = column(batch, text_col)
        data, at = raw(texts)
        for lo, hi in chunks(at):
            index = Index(Chunk(data, at, lo, hi), wanted, number)
            some = texts[lo:hi].to_pylist()
            spans: list[list[tuple[int, int, int, int, int]]] = [[] for _ in some]
            for k, rule in enumerate(rules):
                for row in np.flatnonzero(index.rows_of(asked[k])).tolist():
                    for m in compiled[k].finditer(some[row]):
                        a, b = m.span(rule.group)
                        if b - a >= rule.min_chars:
                            spans[row].append((m.start(), k, m.end(), a, b))
            for s in spans:
                s.sort()
            yield batch, lo, spans
    release()


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>): every row's findings in code points, end exclusive, by start and then order of rules.

    Matches of a rule are leftmost and don't overlap; too short ones are dropped. Null text counts as empty and has none.
    """

    def run(batches):
        for batch, lo, spans in find_spans(rules, batches, text_col):
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b, _, _ in s] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([column(batch, id_col)[lo : lo + len(spans)].cast(pa.int64()), pa.array(found, kind)], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, spans array<struct<kind: string, start: long, end: long>>")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings as counts of the base kinds, a digest of the base spans, and all spans in one string."""
    rules = BASE_RULES + MORE_RULES

    def run(batches):
        for batch, lo, spans in find_spans(rules, batches, text_col):
            told = [[(k, f"{rules[k].kind}:{a}:{b}") for a, k, b, _, _ in s] for s in spans]
            counts = [pa.array([sum(k == n for k, _ in s) for s in told], pa.int64()) for n in range(len(BASE_RULES))]
            base = [hashlib.sha256(",".join(x for k, x in s if k < len(BASE_RULES)).encode()).hexdigest() for s in told]
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col)[lo : lo + len(spans)].cast(pa.int64()), *counts, pa.array(base, pa.string()), pa.array([",".join(x for _, x in s) for s in told], pa.string())],
                [id_col, *(f"n_{r.kind}" for r in BASE_RULES), "base_sha256", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with the secret part of every finding replaced; overlapping parts are replaced as one."""

    def clean(text: str, spans: list[tuple[int, int, int, int, int]]) -> str:
        out, done = [], 0
        for a, b in sorted((s[3], s[4]) for s in spans):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch, lo, spans in find_spans(rules, batches, text_col):
            part = batch.slice(lo, len(spans))
            hit = [k for k, s in enumerate(spans) if s]
            if hit:
                texts = part.column(text_col).to_pylist()
                for k in hit:
                    texts[k] = clean(texts[k], spans[k])
                part = part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
            yield part

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out


#: DuckDB SQL for the counts of the base kinds.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
       len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM d
"""
