"""Packing token sequences as a cutting-stock problem, solved by column generation.

The lengths of all documents' remainders (their tokens beyond whole sequences) go into a histogram of ``length / unit`` classes, whose size is
fixed by the parameters; only it reaches the driver. The linear program over patterns (how many pieces of each class
fill one sequence) is solved by revised simplex, and a knapsack dynamic program over the duals prices new columns.
Each task rounds the patterns down to its share, assigns them to its documents, ranked by id within their class, then uses what
patterns still fit. The few documents that are left follow each other and are cut where a sequence is full; a last, shorter run is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column, release
from .bpe import encoded
from .graph import ensure_checkpoint_dir


@dataclass(frozen=True)
class PackParams:
    sequence: int = 4096
    #: Tokens in one step of the length histogram.
    unit: int = 16
    end_id: int = 2
    #: How far above a proven bound, as a share of it, the linear program may end.
    gap: float = 5e-4
    #: Tokens that a task packs at a time.
    group_tokens: int = 16 << 20


#: A pattern: pieces of each class, as ((class, pieces), ...), and how many sequences the linear program gives it.
Pattern = tuple[tuple[tuple[int, int], ...], float]


def _knapsack(value: np.ndarray, classes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size up to ``room`` the value of the most valuable multiset of classes that fits, and the class that it takes last (-1: one unit stays empty)."""
    best = np.zeros(room + 1)
    taken = np.full(room + 1, -1, dtype=np.int64)
    ends = np.searchsorted(classes, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w], n = best[w - 1], ends[w]
        if n:
            gain = best[w - classes[:n]] + value[:n]
            k = int(np.argmax(gain))
            if gain[k] > best[w] + 1e-12:
                best[w], taken[w] = gain[k], k
    return best, taken


def _pieces(taken: np.ndarray, classes: np.ndarray, w: int, first: int) -> dict[int, int]:
    """The multiset that fills ``w``, and one piece of class ``first`` besides."""
    pieces = {first: 1}
    while w > 0:
        k = int(taken[w])
        if k < 0:
            w -= 1
        else:
            pieces[k] = pieces.get(k, 0) + 1
            w -= int(classes[k])
    return pieces


def _first_fit(classes: np.ndarray, need: np.ndarray, room: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """As many patterns as classes, and how often each is used: the largest classes that are left fill a pattern, which is used until a class is exhausted.

    A pattern's exhausted class is in no later pattern, so the patterns are a basis.
    """
    left, columns, x = need.copy(), [], []
    open_ = list(range(len(classes) - 1, -1, -1))
    while open_:
        space, pieces = room, {}
        for k in open_:
            n = min(space // int(classes[k]), max(1, int(left[k])))
            if n:
                pieces[k] = n
                space -= n * int(classes[k])
        out = min(pieces, key=lambda k: left[k] / pieces[k])
        times = left[out] / pieces[out]
        for k, n in pieces.items():
            left[k] = max(0.0, left[k] - times * n)
        columns.append(pieces)
        x.append(times)
        open_.remove(out)
    return columns, np.array(x)


def _matrix(columns: list[dict[int, int]]) -> np.ndarray:
    out = np.zeros((len(columns), len(columns)))
    for j, pieces in enumerate(columns):
        out[list(pieces), j] = list(pieces.values())
    return out


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, element by element: a threaded library that hangs in the driver would hang the job."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        top = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        rest = np.flatnonzero(both[:, k])
        rest = rest[rest != k]
        both[rest] -= both[rest, k, None] * both[k]
    return both[:, n:]


def solve(demand: dict[int, int], p: PackParams = PackParams()) -> tuple[list[Pattern], np.ndarray]:
    """(patterns that use the fewest sequences for the pieces of each class, fractions allowed, the most used first; duals by class in order, which prove how few
    there can be: no pattern's pieces are worth more than 1).

    It ends at the optimum, or within ``gap`` of a proven bound: duals over the best pattern's worth are duals that no pattern beats. Columns are priced
    at a mean of the basis's duals and those of the best bound so far, which begin as the sizes themselves, and each pricing gives a
    column for every class; that keeps dense histograms from many small steps. There is no other end.
    """
    room = p.sequence // p.unit
    classes = np.array(sorted(c for c, n in demand.items() if n > 0), dtype=np.int64)
    if not len(classes):
        return [], np.zeros(0)
    need = np.array([demand[int(c)] for c in classes], dtype=np.float64)
    need *= 1 + 1e-9 * np.random.default_rng(1).random(len(need))  # no two ratios are the same, so no step is empty
    columns, x = _first_fit(classes, need, room)
    inverse = _inverse(_matrix(columns))
    centre = classes / room
    bound, lean, steps = float((centre * need).sum()), 0.8, 0
    while x.sum() > bound * (1 + p.gap):
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        price = lean * centre + (1 - lean) * dual
        best, taken = _knapsack(price, classes, room)
        proven = float((price * need).sum()) / max(1e-12, best[room])
        if proven > bound:
            bound, centre = proven, price / best[room]
        worth = price + best[room - classes]
        moved = False
        for k in np.argsort(-worth, kind="stable").tolist():
            pieces = _pieces(taken, classes, room - int(classes[k]), k)
            at, many = list(pieces), np.array(list(pieces.values()), dtype=np.float64)
            if float((dual[at] * many).sum()) <= 1 + 1e-9:
                continue
            step = (inverse[:, at] * many).sum(axis=1)
            up = np.flatnonzero(step > 1e-9)
            ratio = x[up] / step[up]
            out = int(up[np.argmin(ratio)])
            t = float(ratio.min())
            x = np.maximum(x - t * step, 0)
            x[out] = t
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            columns[out] = pieces
            dual = inverse.sum(axis=0)
            moved, steps = True, steps + 1
            if steps % 400 == 0:
                inverse = _inverse(_matrix(columns))
                x = np.maximum((inverse * need).sum(axis=1), 0)
                dual = inverse.sum(axis=0)
        if moved:
            lean = 0.8
        elif lean > 0:  # nothing is worth its place at the mean: nearer to the basis's own duals
            lean = lean / 2 if lean > 0.05 else 0.0
        else:
            break
    plans = [(tuple((int(classes[k]), n) for k, n in sorted(c.items())), float(v)) for c, v in zip(columns, x) if v > 1e-9]
    return sorted(plans, key=lambda plan: (-plan[1], plan[0])), centre


def solve_patterns(demand: dict[int, int], p: PackParams = PackParams()) -> list[Pattern]:
    return solve(demand, p)[0]


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_group(keys: list[int | None], tokens: list[np.ndarray], patterns: list[Pattern], total: int, p: PackParams) -> list[tuple[int, int, int, int, int]]:
    """Pieces (position of the document, start, length, sequence, offset) of some documents; sequences count from 0.

    ``total`` is how many pieces the patterns were made for.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    queues: dict[int, list[int]] = {}
    for k in sorted(range(len(keys)), key=lambda k: (keys[k] is None, keys[k] or 0, k), reverse=True):
        size = len(tokens[k])
        for a in range(0, size - p.sequence + 1, p.sequence):
            out.append((k, a, p.sequence, sequence, 0))
            sequence += 1
        if size % p.sequence:
            queues.setdefault(-(-(size % p.sequence) // p.unit), []).append(k)  # the end of the list is taken first
    pieces = sum(map(len, queues.values()))
    for limited in (True, False):
        for pattern, x in patterns:
            if any(c not in queues for c, _ in pattern):
                continue
            times = min(len(queues[c]) // n for c, n in pattern)
            full = sum(c * n for c, n in pattern) * p.unit == p.sequence
            if limited or not full:
                times = min(times, int(x * pieces / max(total, 1)))
            for _ in range(times):
                at = 0
                for c, n in pattern:
                    for _ in range(n):
                        k = queues[c].pop()
                        size = len(tokens[k])
                        rest = size % p.sequence
                        out.append((k, size - rest, rest, sequence, at))
                        at += rest
                sequence += 1
            if not limited and not full:
                break
    left = sorted((k for q in queues.values() for k in q), key=lambda k: (keys[k] is None, keys[k] or 0, k))
    waiting = sum(len(tokens[k]) % p.sequence for k in left)
    rooms = [p.sequence] * (waiting // p.sequence) + _powers(waiting % p.sequence)
    room, at = (rooms.pop(0), 0) if rooms else (0, 0)
    for k in left:
        size = len(tokens[k])
        start = size - size % p.sequence
        while start < size:
            n = min(size - start, room - at)
            out.append((k, start, n, sequence, at))
            start, at = start + n, at + n
            if at == room:
                sequence += 1
                room, at = (rooms.pop(0), 0) if rooms else (0, 0)
    return out


def tokenised(docs: DataFrame, tokenizer: str, p: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids binary of little-endian unsigned 16-bit numbers, 32-bit where the vocabulary needs them, wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, e in encoded(batches, tokenizer, id_col, text_col):
            ids, at = e.ids()
            wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
            kind = "<u4" if wide else "<u2"
            end = np.array([p.end_id], kind).tobytes()
            ids = ids.astype(kind)
            body = [ids[a:b].tobytes() + end for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at) + 1), pa.array(body, pa.binary()), pa.array([wide] * len(body))], [id_col, "n", "ids", "wide"])
        release()

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n long, ids binary, wide boolean")


def pack(docs: DataFrame, tokenizer: str, p: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are their end id alone. Repeated rows are packed each. Other columns are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    tokens = tokenised(docs, tokenizer, p, id_col, text_col).checkpoint()
    rest = F.col("n") % p.sequence
    counts = tokens.where(rest > 0).groupBy(F.ceil(rest / p.unit).cast("int").alias("class")).count().collect()
    demand = {r[0]: r[1] for r in counts}
    patterns, total = solve_patterns(demand, p), sum(demand.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def flush(keys: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal first
            pieces = pack_group(keys, arrays, patterns, total, p)
            crc = [zlib.crc32(arrays[k][a : a + n].astype("<u4").tobytes()) for k, a, n, _, _ in pieces]
            columns = [
                [keys[x[0]] for x in pieces],
                [x[1] for x in pieces],
                [x[2] for x in pieces],
                crc,
                [len(arrays[x[0]]) for x in pieces],
                [first + x[3] for x in pieces],
                [x[4] for x in pieces],
            ]
            first += 1 + max((x[3] for x in pieces), default=-1)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        keys: list = []
        arrays: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, body, wide in zip(column(batch, id_col).to_pylist(), column(batch, "ids").to_pylist(), column(batch, "wide").to_pylist()):
                keys.append(key)
                arrays.append(np.frombuffer(body, "<u4" if wide else "<u2"))
                held += len(arrays[-1])
                if held >= p.group_tokens:
                    yield flush(keys, arrays)
                    keys, arrays, held = [], [], 0
        if keys:
            yield flush(keys, arrays)
        release()

    return tokens.mapInArrow(run, f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
