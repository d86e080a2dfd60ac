"""Removal of repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``width`` bytes that covers it also starts earlier. Sorting the suffix at every byte would exchange the text
a hundredfold, so the suffixes are chosen by content: in each window of ``width`` bytes the gram with the least hash is its anchor, equal
windows have equal anchors, and consecutive windows with one anchor form a span. One suffix stands for each span, and these passes decide:

1. *Filter.* Blocks (ranges of ids, so that block order is document order) send fingerprints of their spans, and of their anchors with two
   spans for each at most. The answers tell for each span whether its content occurs in other blocks, and whether its anchor has
   other surroundings. Spans with neither are done: nothing in them repeats. An anchor that is everywhere sends two entries a block.
2. *Merge sort.* Each block sorts the suffixes of its repeated spans, front-codes the run (length of the common prefix with the one before, and
   the rest), and cuts it into shards. A shard merges its runs with a loser tree that keeps, for every waiting suffix, the prefix that it
   shares with the last winner, so known prefixes are never compared again. Equal neighbours are repeats; the one of the first block stays.
   Where an anchor occurs with different surroundings, windows can repeat while their spans do not. Of these spans, the windows whose
   fingerprints occur twice (a second filter) are sorted and merged in the same way, as 128-bit digests of their suffixes.
3. *Removal.* Blocks mark what the answers say and cut the text.

Repeats inside a block are found by fingerprint and confirmed by their bytes. Blocks and shards have bounded size, and a block sends equal strings
once, so frequent passages do not gather anywhere. The rows of one id, or of none, are spread over blocks by a hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrowtext import Chunk, chunks, column, mix, raw, release
from .lm_score import pack, pack_sorted, unpack, unpack_sorted


#: Bytes of text whose windows are hashed at a time; the arrays then stay in a core's cache.
_SPAN_CHUNK = 1 << 16


@dataclass(frozen=True)
class RepeatParams:
    width: int = 100
    gram: int = 32
    #: Bytes of text in a block: at least, and at most. Between them it grows with the root of the input, so that blocks times shards grow
    #: no faster than the input.
    block_bytes: int = 4 << 20
    most_block_bytes: int = 16 << 20
    #: Blocks whose text the spans of a shard come from, about.
    shard_blocks: int = 4


# -- strings in order --------------------------------------------------------------------------------------------


def front_code(strings: list[bytes]) -> bytes:
    """A sorted run: for each string the length it shares with the one before, the length of its rest, and the rests."""
    if not strings:
        return b""
    size = np.array([len(s) for s in strings], dtype=np.int64)
    wide = int(size.max())
    shared = np.zeros(len(strings), dtype=np.int64)
    for lo in range(0, len(strings), 8192):
        part = strings[max(lo - 1, 0) : lo + 8192]
        rows = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in part), np.uint8).reshape(len(part), wide)
        same = np.cumprod(rows[1:] == rows[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        first = max(lo, 1)
        shared[first : first + len(same)] = np.minimum(same, np.minimum(size[first : first + len(same)], size[first - 1 : first - 1 + len(same)]))
    rests = b"".join([s[n:] for s, n in zip(strings, shared.tolist())])
    head = np.array([len(strings)], "<u4").tobytes() + shared.astype("<u2").tobytes() + (size - shared).astype("<u2").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + rests)


def front_decode(body: bytes) -> tuple[list[bytes], list[int]]:
    """The strings of a run and the lengths of their prefixes shared with the one before."""
    if not body:
        return [], []
    flat = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(flat, "<u4", 1)[0])
    shared = np.frombuffer(flat, "<u2", n, 4).tolist()
    rest = np.frombuffer(flat, "<u2", n, 4 + 2 * n).tolist()
    at, out, last = 4 + 4 * n, [], b""
    for k, m in zip(shared, rest):
        last = last[:k] + flat[at : at + m]
        at += m
        out.append(last)
    return out, shared


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> list[bytearray]:
    """For each sorted run of distinct strings, a flag for every string: whether an earlier run has it too.

    A loser tree over the runs' heads. Each head knows how long a prefix it shares with the string put out last. Of two heads,
    the one that shares more is the smaller and nothing is compared; with equal lengths, comparison starts behind the known prefix.
    """
    flags = [bytearray(len(r[0])) for r in runs]
    count = len(runs)
    if not count:
        return flags
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs]
    known = [0] * count
    place = [0] * count
    leaves = 1 << max(0, (count - 1).bit_length())

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then the one shared with the winner."""
        if b >= count or head[b] is None:
            return a, b
        if a >= count or head[a] is None:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = head[a], head[b]
        n = min(len(x), len(y))
        k = ka
        if x[k:n] == y[k:n]:
            k = n
        else:
            while x[k] == y[k]:
                k += 1
        if k < n:
            first = x[k] < y[k]
        else:
            first = len(x) < len(y) or len(x) == len(y) and a < b
        if first:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    losers = [0] * leaves
    winners = list(range(leaves))
    while len(winners) > 1:  # the first round, from the leaves to the root
        half = len(winners) // 2
        games = [play(winners[2 * k], winners[2 * k + 1]) for k in range(half)]
        for k, (_, loser) in enumerate(games):
            losers[half + k] = loser
        winners = [w for w, _ in games]
    top = winners[0]
    last = -1  # length of the string put out last
    while top < count and head[top] is not None:
        if known[top] == len(head[top]) == last:
            flags[top][place[top]] = 1
        last = len(head[top])
        place[top] += 1
        strings, shared = runs[top]
        if place[top] < len(strings):
            head[top], known[top] = strings[place[top]], shared[place[top]]
        else:
            head[top] = None
        node = (leaves + top) >> 1
        while node:
            other = losers[node]
            # most games end here: an exhausted run loses, and so does the head that shares less
            if other < count and head[other] is not None:
                if head[top] is None or known[other] > known[top]:
                    top, losers[node] = other, top
                elif known[other] == known[top]:
                    top, losers[node] = play(top, other)
            node >>= 1
    return flags


# -- spans of a block --------------------------------------------------------------------------------------------


class Spans:
    """The spans of some rows in order: first and last window start, row, and 64-bit hashes of anchor and content."""

    def __init__(self, texts: pa.Array, p: RepeatParams):
        release()
        self.data, self.at = raw(texts)
        parts = [self._of(Chunk(self.data, self.at, lo, hi), int(self.at[lo]), p) for lo, hi in chunks(self.at, _SPAN_CHUNK)]
        parts.append((np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2)
        self.first, self.last, gram, content = (np.concatenate(x) for x in zip(*parts))
        self.gram, self.content = gram >> np.uint64(24), content >> np.uint64(8)
        order = np.lexsort((self.content, self.gram))
        g, c = self.gram[order], self.content[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        body, again = self.data.tobytes(), np.flatnonzero(~new)
        a, b, c, d = (x.tolist() for x in (self.first[order[again]], self.last[order[again]] + p.width, self.first[lead[again]], self.last[lead[again]] + p.width))
        new[again[[body[i:j] != body[k:m] for i, j, k, m in zip(a, b, c, d)]]] = True  # equal fingerprints of other bytes
        #: The span of each class's first occurrence; the order is that of the classes' hashes.
        self.lead = order[new]
        self.repeats = order[~new]

    @staticmethod
    def _of(c: Chunk, base: int, p: RepeatParams) -> tuple[np.ndarray, ...]:
        windows, w = len(c.data) - p.width + 1, p.width - p.gram + 1
        if windows <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        bits = np.uint64(max(18, len(c.data).bit_length()))
        key = c.rolling(p.gram)
        key >>= bits
        key <<= bits
        key |= np.arange(len(key), dtype=np.uint64)  # equal grams: the first one
        least, span = key, 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        whole = np.ones(windows, dtype=bool)
        for a, b in zip(c.at.tolist(), c.at[1:].tolist()):
            whole[max(a, b - p.width + 1) : b] = False
        change = np.ones(windows, dtype=bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        edge = np.flatnonzero(change)
        last = np.append(edge[1:], windows) - 1
        kept = whole[edge]
        first, last = edge[kept], last[kept]
        own = anchor[first]
        content = mix(c.hashes(first, last + p.width) + (own - first).astype(np.uint64))
        return first + base, last + base, c.hashes(own, own + p.gram), content


def _cuts(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(keys, np.array([(k << bits) // shards for k in range(1, shards)], dtype=np.uint64)), [len(keys)]])


class Windows:
    """The distinct windows of the spans with ``code & 2``, in the order of their hashes, and the starts of their repeats in the block."""

    def __init__(self, s: Spans, code: np.ndarray, p: RepeatParams):
        spans = np.sort(s.lead[(code & 2) > 0])
        many = s.last[spans] - s.first[spans] + 1
        start = np.repeat(s.first[spans] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        parts = []
        for lo, hi in chunks(s.at):
            own = start[np.searchsorted(start, s.at[lo]) : np.searchsorted(start, s.at[hi])] - s.at[lo]
            if len(own):
                parts.append(Chunk(s.data, s.at, lo, hi).hashes(own, own + p.width))
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        h, start = h[order], start[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        again, step = np.flatnonzero(~new), np.arange(p.width)
        for lo in range(0, len(again), 8192):
            some = again[lo : lo + 8192]
            new[some[(s.data[start[some, None] + step] != s.data[start[lead[some], None] + step]).any(axis=1)]] = True
        self.hash, self.start, self.again = h[new], start[new], start[~new]
        self.mark = self.hash >> np.uint64(24)


def _anchors(s: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchors of a block in order, with the least and the greatest content of their spans."""
    gram, content = s.gram[s.lead], s.content[s.lead]  # by anchor, then by content
    if not len(gram):
        return gram, content, content
    new = np.ones(len(gram), dtype=bool)
    new[1:] = gram[1:] != gram[:-1]
    start = np.flatnonzero(new)
    return gram[start], content[start], content[np.append(start[1:], len(gram)) - 1]


def _lead_codes(s: Spans, content_code: np.ndarray, gram_code: np.ndarray) -> np.ndarray:
    """For each lead span: 1 if other blocks have its content; 2 if its block is the first that has it and its anchor has others."""
    content, gram = s.content[s.lead], s.gram[s.lead]
    back = np.empty(len(content), dtype=np.int64)
    back[np.argsort(content, kind="stable")] = np.arange(len(content))
    own = content_code[back] if len(content) else content_code
    mixed = gram_code[np.searchsorted(_anchors(s)[0], gram)] if len(gram) else gram_code
    return (own & 1) | (((own >> 1) & mixed) << 1)


def _span_strings(s: Spans, code: np.ndarray, shards: int, p: RepeatParams) -> tuple[list[list[bytes]], list[list[int]]]:
    """Sorted suffixes of the spans with ``code & 1`` by shard, and the span of each."""
    body = s.data.tobytes()
    found: list[list[tuple[bytes, int]]] = [[] for _ in range(shards)]
    whole = s.lead[(code & 1) > 0]
    shard = s.content[whole] % np.uint64(shards)
    for k, h, a, b in zip(whole.tolist(), shard.tolist(), s.first[whole].tolist(), s.last[whole].tolist()):
        found[h].append((body[a : b + p.width], k))
    for x in found:
        x.sort()  # two spans with the same bytes would differ only in their anchors, which the bytes fix
    return [[x for x, _ in f] for f in found], [[k for _, k in f] for f in found]


def _window_strings(s: Spans, w: Windows, repeated: np.ndarray, shards: int, p: RepeatParams) -> list[list[bytes]]:
    """128-bit digests of the repeated windows by shard, sorted as their hashes are."""
    body, digest = s.data.tobytes(), hashlib.blake2b
    use = np.flatnonzero(repeated)
    head = w.hash[use].astype(">u8").tobytes()
    out = [head[8 * k : 8 * k + 8] + digest(body[a : a + p.width], digest_size=8).digest() for k, a in enumerate(w.start[use].tolist())]
    cuts = np.searchsorted(use, _cuts(w.mark, 40, shards)).tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def _joined(answers: pa.Table, name: str) -> np.ndarray:
    """A block's codes from all shards, in order."""
    parts = [unpack(x, np.uint8) for x in column(answers.sort_by("shard"), name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def removed_bytes(s: Spans, flags: pa.Table, shards: int, p: RepeatParams) -> np.ndarray:
    """Which bytes of the block's rows go."""
    edge = np.zeros(len(s.data) + 1, dtype=np.int64)

    def drop(first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(edge, first, 1)
        np.add.at(edge, last + p.width, -1)

    flags = flags.sort_by("shard")
    code = _joined(flags, "code")
    drop(s.first[s.repeats], s.last[s.repeats])
    told = np.frombuffer(b"".join(column(flags, "span_flags").to_pylist()), np.uint8) > 0
    order = np.array([k for x in _span_strings(s, code, shards, p)[1] for k in x], dtype=np.int64)[told]
    drop(s.first[order], s.last[order])
    w = Windows(s, code, p)
    drop(w.again, w.again)
    told = np.frombuffer(b"".join(column(flags, "window_flags").to_pylist()), np.uint8) > 0
    start = w.start[_joined(flags, "window_code") > 0][told]
    drop(start, start)
    return np.cumsum(edge[:-1]) > 0


# -- the distributed passes --------------------------------------------------------------------------------------


def _array(values: list[int], suffix: str = "") -> str:
    return f"array({','.join(f'{v}{suffix}' for v in values)})"


def _range_of(id_col: str, bounds: list[int]) -> Column:
    """The number of bounds up to the id, by binary search; 0 for a null id."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.expr(
        f"aggregate({_array(steps)}, 0, (lo, step) -> if(lo + step <= {len(bounds)} and {_array(bounds, 'L')}[lo + step - 1] <= coalesce(`{id_col}`, {-(1 << 63) + 1}L), lo + step, lo))"
    )


def _dealt(docs: DataFrame, p: RepeatParams, block_bytes: int, blocks: int, id_col: str, text_col: str) -> DataFrame:
    """The rows with their block, whose numbers are in document order, and a hash that orders rows with one id.

    Ranges of ids come from quantiles over rows, and neighbouring ranges make a block by their bytes. Where the rows with a range's least id, or those
    without an id, are more than a block, ranges of the hash spread them over several.
    """
    bounds: list[int] = []
    if blocks > 1:
        found = docs.select(F.col(id_col).cast("double").alias("id")).approxQuantile("id", [k / (2 * blocks) for k in range(1, 2 * blocks)], 0.1 / blocks)
        bounds = sorted({int(x) for x in found})
    ranged = docs.withColumn("_range", _range_of(id_col, bounds).cast("int")).withColumn("_order", F.xxhash64(text_col))
    least = F.when(F.col("_range") > 0, F.expr(f"{_array(bounds, 'L')}[_range - 1]")) if bounds else F.lit(None).cast("long")
    own, size = F.col(id_col).cast("long").eqNullSafe(least), F.coalesce(F.octet_length(text_col), F.lit(0))
    sums = {r["_range"]: (r["own"], r["all"]) for r in ranged.groupBy("_range").agg(F.sum(F.when(own, size).otherwise(0)).alias("own"), F.sum(size).alias("all")).collect()}
    number, hot, last, held = [], {}, -1, 2 * block_bytes
    for k in range(len(bounds) + 1):
        alone, every = sums.get(k, (0, 0))
        if alone > block_bytes:
            hot[k] = last + 1, -(-alone // block_bytes)
            last, held, every = last + hot[k][1], 2 * block_bytes, every - alone
        if held + every > block_bytes * 5 // 4:
            last, held = last + 1, 0
        number.append(last)
        held += every
    block = F.expr(f"{_array(number)}[_range]") if bounds else F.lit(number[0])
    share = F.shiftrightunsigned("_order", 33) / float(1 << 31)
    for k, (first, many) in hot.items():
        block = F.when((F.col("_range") == k) & own, first + F.floor(share * many)).otherwise(block)
    return ranged.withColumn("_block", block.cast("int")).drop("_range")


def _ordered(table: pa.Table, id_col: str, text_col: str) -> pa.Table:
    top = pc.shift_right(table.column("_order").cast(pa.uint64(), safe=False), pa.scalar(33, pa.uint64()))
    keys = pa.table([table.column(id_col), top, table.column(text_col)], names=["id", "top", "text"])
    return table.take(pc.sort_indices(keys, sort_keys=[(k, "ascending") for k in keys.column_names], null_placement="at_start"))


def remove_repeats(docs: DataFrame, output: Callable[[pa.Table, pa.Array, np.ndarray, np.ndarray], pa.Table], schema: StructType | str, p: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``output(rows, texts, offsets of the texts' bytes, removed flag of each byte)`` for blocks of rows.

    Order is that of ids; rows without an id come first, and a hash of the text orders rows with one id. Null text is empty.
    """
    clash = {"_block", "_order", "_range"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are needed here")
    size, rows = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    size = size or 0
    block_bytes = max(p.block_bytes, min(p.most_block_bytes, int(64 * size**0.5)))
    blocks = max(1, min(-(-size // block_bytes), rows))
    shards = -(-size // (p.shard_blocks * block_bytes)) or 1
    names = docs.columns
    dealt = _dealt(docs, p, block_bytes, blocks, id_col, text_col)

    def propose(table: pa.Table) -> pa.Table:
        block = column(table, "_block")[0].as_py()
        s = Spans(column(_ordered(table, id_col, text_col), text_col), p)
        content, (gram, low, high) = np.sort(s.content[s.lead]), _anchors(s)
        cuts, gram_cuts = _cuts(content, 56, shards), _cuts(gram, 40, shards)
        parts, gram_parts = ([slice(a, b) for a, b in zip(x, x[1:])] for x in (cuts, gram_cuts))
        several = low != high
        return pa.table(
            {
                "shard": pa.array(range(shards), pa.int32()),
                "_block": pa.array([block] * shards, pa.int32()),
                "contents": pa.array([pack_sorted(content[x]) for x in parts], pa.binary()),
                "grams": pa.array([pack_sorted(gram[x]) for x in gram_parts], pa.binary()),
                "lows": pa.array([pack(low[x]) for x in gram_parts], pa.binary()),
                "severals": pa.array([pack(several[x].astype(np.uint8)) for x in gram_parts], pa.binary()),
            }
        )

    def judge(table: pa.Table) -> pa.Table:
        """For each content whether other blocks have it, and whether this is the first that does; for each anchor whether it has several contents."""
        table = table.sort_by("_block")
        out = {}
        contents = [unpack_sorted(x) for x in column(table, "contents").to_pylist()]
        at, c = np.concatenate([[0], np.cumsum([len(x) for x in contents])]), np.concatenate(contents)
        order = np.argsort(c, kind="stable")  # blocks stay in order
        c, code = c[order], np.zeros(len(c), dtype=np.uint8)
        new = np.ones(len(c), dtype=bool)
        new[1:] = c[1:] != c[:-1]
        kind = np.cumsum(new) - 1
        code[order] = (np.bincount(kind)[kind] > 1).astype(np.uint8) | (new.astype(np.uint8) << 1) if len(c) else code
        out["content_code"] = [pack(code[a:b]) for a, b in zip(at, at[1:])]
        grams = [unpack_sorted(x) for x in column(table, "grams").to_pylist()]
        at, g = np.concatenate([[0], np.cumsum([len(x) for x in grams])]), np.concatenate(grams)
        low = np.concatenate([unpack(x, np.uint64) for x in column(table, "lows").to_pylist()])
        several = np.concatenate([unpack(x, np.uint8) for x in column(table, "severals").to_pylist()]) > 0
        order = np.argsort(g, kind="stable")
        g, low = g[order], low[order]
        mixed = np.zeros(len(g), dtype=np.uint8)
        if len(g):
            new = np.ones(len(g), dtype=bool)
            new[1:] = g[1:] != g[:-1]
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            differs = np.logical_or.reduceat(several[order], start) | (np.minimum.reduceat(low, start) != np.maximum.reduceat(low, start))
            mixed[order] = differs[group]
        out["gram_code"] = [pack(mixed[a:b]) for a, b in zip(at, at[1:])]
        return pa.table({"_block": table.column("_block"), "shard": table.column("shard")} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    def nothing(*binary: str) -> pa.Table:
        return pa.table({"shard": pa.array([], pa.int32()), "_block": pa.array([], pa.int32())} | {x: pa.array([], pa.binary()) for x in binary})

    def suspect(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return nothing("code", "marks")
        s = Spans(column(_ordered(texts, id_col, text_col), text_col), p)
        answers = answers.sort_by("shard")
        code = _lead_codes(s, _joined(answers, "content_code"), _joined(answers, "gram_code"))
        w = Windows(s, code, p)
        cuts = _cuts(w.mark, 40, shards)
        marks = [pack_sorted(w.mark[a:b]) for a, b in zip(cuts, cuts[1:])]
        codes = [pack(code) if k == 0 else b"" for k in range(shards)]
        return pa.table({"shard": answers.column("shard"), "_block": answers.column("_block"), "code": pa.array(codes, pa.binary()), "marks": pa.array(marks, pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        marks = [unpack_sorted(x) for x in column(table, "marks").to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(m) for m in marks])])
        _, which, count = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
        repeated = (count[which] > 1).astype(np.uint8)
        out = [pack(repeated[a:b]) for a, b in zip(at, at[1:])]
        return pa.table({"_block": table.column("_block"), "shard": table.column("shard"), "code": table.column("code"), "window_code": pa.array(out, pa.binary())})

    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return nothing("code", "window_code", "spans", "windows")
        s = Spans(column(_ordered(texts, id_col, text_col), text_col), p)
        answers = answers.sort_by("shard")
        code = _joined(answers, "code")
        windows = _window_strings(s, Windows(s, code, p), _joined(answers, "window_code"), shards, p)
        return pa.table(
            {
                "shard": answers.column("shard"),
                "_block": answers.column("_block"),
                "code": answers.column("code"),
                "window_code": answers.column("window_code"),
                "spans": pa.array([front_code(x) for x in _span_strings(s, code, shards, p)[0]], pa.binary()),
                "windows": pa.array([front_code(x) for x in windows], pa.binary()),
            }
        )

    def merge(table: pa.Table) -> pa.Table:
        release()
        table = table.sort_by("_block")
        flags = {name: [bytes(x) for x in merge_runs([front_decode(x) for x in column(table, name).to_pylist()])] for name in ("spans", "windows")}
        return pa.table(
            {
                "_block": table.column("_block"),
                "shard": table.column("shard"),
                "code": table.column("code"),
                "window_code": table.column("window_code"),
                "span_flags": pa.array(flags["spans"], pa.binary()),
                "window_flags": pa.array(flags["windows"], pa.binary()),
            }
        )

    def cut(texts: pa.Table, flags: pa.Table) -> pa.Table:
        texts = _ordered(texts, id_col, text_col)
        body = column(texts, text_col)
        if not len(texts):
            return output(texts.select(names), body, np.zeros(1, np.int64), np.zeros(0, bool))
        s = Spans(body, p)
        gone = removed_bytes(s, flags, shards, p)
        return output(texts.select(names), body, s.at, gone)

    proposed = dealt.groupBy("_block").applyInArrow(propose, "shard int, _block int, contents binary, grams binary, lows binary, severals binary")
    judged = proposed.groupBy("shard").applyInArrow(judge, "_block int, shard int, content_code binary, gram_code binary")
    suspected = dealt.groupBy("_block").cogroup(judged.groupBy("_block")).applyInArrow(suspect, "shard int, _block int, code binary, marks binary")
    compared = suspected.groupBy("shard").applyInArrow(compare, "_block int, shard int, code binary, window_code binary")
    sent = dealt.groupBy("_block").cogroup(compared.groupBy("_block")).applyInArrow(send, "shard int, _block int, code binary, window_code binary, spans binary, windows binary")
    merged = sent.groupBy("shard").applyInArrow(merge, "_block int, shard int, code binary, window_code binary, span_flags binary, window_flags binary")
    return dealt.groupBy("_block").cogroup(merged.groupBy("_block")).applyInArrow(cut, schema)


def digests(docs: DataFrame, p: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""

    def output(rows: pa.Table, texts: pa.Array, at: np.ndarray, gone: np.ndarray) -> pa.Table:
        c = Chunk(raw(texts)[0], at, 0, len(texts))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = at[:-1][at[:-1] < len(gone)]
        opens[edge] = gone[edge]
        kept, body = ~gone, c.data
        sha = [hashlib.sha256(body[a:b][kept[a:b]].tobytes()).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())]
        return pa.table([column(rows, id_col).cast(pa.int64()), pa.array(np.diff(at)), pa.array(c.per_row(gone)), pa.array(c.per_row(opens)), pa.array(sha, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove_repeats(docs.select(id_col, text_col), output, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", p, id_col, text_col)


def cut_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same columns with repeated passages cut from the text. Rows of which nothing is left go; a character that a cut splits goes whole.

    Null and empty texts stay as they are, equal rows are cut like any others (the first stays whole), an empty table has no rows, and columns may have any
    names. A text is held whole in one task, with some 40 bytes for each of its own; the length column, if there is one, is counted anew.
    """
    names = docs.columns
    docs = docs.toDF(*(f"in{k}" for k in range(len(names))))  # no name of the input meets one that is used here
    id_col, text_col = f"in{names.index(id_col)}", f"in{names.index(text_col)}"
    length_col = f"in{names.index(length_col)}" if length_col in names else None

    def output(rows: pa.Table, texts: pa.Array, at: np.ndarray, gone: np.ndarray) -> pa.Table:
        body = raw(texts)[0]
        touched = np.add.reduceat(gone, at[:-1]) > 0 if len(gone) and (np.diff(at) > 0).all() else [gone[a:b].any() for a, b in zip(at, at[1:])]
        text = rows.column(text_col).to_pylist()
        for k, hit in enumerate(touched):
            if hit:
                a, b = at[k], at[k + 1]
                text[k] = body[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore")
        place = rows.schema.get_field_index(text_col)
        rows = rows.set_column(place, text_col, pa.array(text, pa.string()))
        return rows.filter(pa.array([not hit or bool(t) for hit, t in zip(touched, text)], pa.bool_()))

    out = remove_repeats(docs, output, docs.schema, p, id_col, text_col)
    return (out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out).toDF(*names)
