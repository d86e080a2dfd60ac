"""Near copies by SimHash and anchors: sets of five words whose Jaccard similarity is at least 0.8.

Equal sets are collapsed first. A set's fingerprint is a SimHash of ``SEGMENTS`` segments of 31 bits: a bit is 1 if set in over half the
hashes of its shingles and of one constant, which is in every set and steadies sets of a few shingles. Two sets of similarity 0.8
differ in 15 or 16 of 100 bits, too many for one radius over all bits, so every segment has the anchors of op6 to itself (``simhash.anchors_of``,
the Hamming code over 31 bits): sets that differ in two bits at most of any segment meet at one of its anchors. At similarity 0.8 that
misses a pair with a chance of 3e-5 at most, a more similar one less often. Every pair that meets is decided by the exact similarity of its two texts.
Groups are the connected components of the pairs found.

A segment has up to 16 anchors, so sets that cannot have a near copy are not sent to anchors: a near copy shares at least four fifths of a set's
shingles. First a set stays if two fifths of some ``SAMPLE`` of its shingles, those of least hash, are in another set too (at similarity
0.8 that fails with a chance below 4e-6, and never for sets of up to ``SAMPLE`` shingles, which are looked at whole); then
if four fifths of all its shingles are in other sets that stayed, which loses nothing.

A third of all sets can meet at an anchor, and sets just below the limit meet there as well, so its pairs are never formed as rows. First neighbours
in the order (nearest anchor, next segment) are compared, which are the most alike; they join nearly all of a large group. Then components that
meet at anchors are joined to families, by a forest of links for each bucket of anchors: two sets count if they differ little in their first
segments, or whatever they are where an anchor has over ``SMALL`` sets. In a family each set outside its largest component meets
the sets of other components: both sides are cut into blocks of bounded size, and each pair of blocks is compared in a task, from fingerprints and then from the
shingles themselves. Only links leave the task, fewer than its components. What is not compared is joined already, so the
components are at least those of all pairs that meet. A set has one row for each pair of blocks that it is in, however many anchors it
shares; only a family of more sets than a block holds costs rows, and any family comparisons, by the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .arrowtext import Chunk, chunks, column, mix, raw, release, whole_groups
from .graph import connected_components, ensure_checkpoint_dir

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Segments of a fingerprint, and the bits of each that the code covers.
SEGMENTS, BITS = 84, 31
#: Segments whose nearest anchors give neighbours.
NEIGHBOURS = 20
#: Pairs with more differing bits of all 2,604 are dropped unread: at similarity 0.8 a chance below 1e-6.
MOST_DIFFER = 500
#: Segments looked at first, and most differing bits of their 496 (at similarity 0.8 a chance below 1e-8 to differ in more).
HEAD, MOST_DIFFER_HEAD = 16, 128
#: Shingles of a set that are looked for in others, and the most of them, as a fraction, that no other set has.
SAMPLE, MOST_ALONE = 32, (3, 5)
#: Segments whose anchors are dealt together, and rows (anchor, set) that are looked at together, but that those of one anchor stay together.
TOGETHER, BUCKET = 4, 1 << 21
#: Sets of an anchor that are looked at pair by pair; those of larger ones are one family.
SMALL = 64
#: Sets, and shingles, in a block of those outside their family's largest component, and in one of the others.
BLOCK_OUT, BLOCK_IN = (1024, 1 << 19), (4096, 1 << 20)

_RNG = np.random.default_rng(20250501)
_TIMES = _RNG.integers(1, 2**63, SEGMENTS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(1, 2**63, SEGMENTS // 2, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: In every set when its fingerprint is made.
_CONSTANT = _RNG.integers(1, 2**63, 1, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, hashes): for runs of rows the sorted distinct hashes of each row's shingles; a shorter text is one shingle."""
    data, at = raw(texts)
    for lo, hi in chunks(at):
        c = Chunk(_LOWER[data[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo], 0, hi - lo)
        start, end, row = c.words()
        w = c.hashes(start, end)
        n = np.bincount(row, minlength=c.rows)
        last = np.cumsum(n)
        left = last[row] - np.arange(len(row))
        code = np.minimum(left, SHINGLE).astype(np.uint64)
        for k in range(min(SHINGLE, len(w))):
            code[: len(w) - k] += np.where(left[: len(w) - k] > k, w[k:] * _PLACE[k], np.uint64(0))
        use = (left >= SHINGLE) | (left == n[row])
        h, row = mix(code[use]), row[use]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield lo, np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=c.rows))]), h[new]


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The segments of a set's SimHash, 31 bits of a uint32 each."""
    h = np.concatenate([h, _CONSTANT])
    ones = np.zeros(SEGMENTS * 32, np.int64)
    for k in range(0, len(h), 255):
        words = mix(h[k : k + 255, None] * _TIMES + _PLUS)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u4") & np.uint32((1 << BITS) - 1)


def _signatures(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo, at, h in shingle_sets(column(batch, "text")):
        size = np.diff(at)
        some = np.flatnonzero(size)
        sid = np.zeros(len(size), np.uint64)
        if len(some):
            sid[some] = mix(np.add.reduceat(mix(h ^ _PLUS[0]), at[some]) + size[some].astype(np.uint64))
        least = [x[: np.searchsorted(x, np.uint64(SAMPLE * 2**64 // len(x)))] if len(x) > SAMPLE else x for x in (h[a:b] for a, b in zip(at[:-1], at[1:]))]
        rest = batch.slice(lo, len(size))
        yield pa.RecordBatch.from_arrays(
            [rest.column("id"), rest.column("text_hash"), rest.column("row"), pa.array(sid.view(np.int64)), pa.array(size, pa.int64()), pa.array([x.tobytes() for x in least], pa.binary())],
            ["id", "text_hash", "row", "sid", "n", "least"],
        )


def _sampled(batches):
    for batch in batches:
        least = [np.frombuffer(x, np.int64) for x in column(batch, "least").to_pylist()]
        sid = np.repeat(column(batch, "sid").to_numpy(zero_copy_only=False), [len(x) for x in least])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*least, np.zeros(0, np.int64)])), pa.array(sid)], ["h", "sid"])


def _fingerprints(batches):
    for batch in batches:
        for lo, at, h in shingle_sets(column(batch, "text")):
            prints = [fingerprint(h[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "sid").slice(lo, len(prints)), pa.array(np.diff(at), pa.int64()), pa.array(prints, pa.binary())], ["sid", "n", "print"])
    release()


def segments(values: pa.Array, n: int = SEGMENTS) -> np.ndarray:
    """A row of segments for each fingerprint, or for its first ``n`` segments."""
    return np.frombuffer(b"".join(values.to_pylist()), "<u4").reshape(-1, n)


def _nearest(batches):
    for batch in batches:
        prints = segments(column(batch, "print"))
        some, follow = (np.ascontiguousarray(x).ravel().astype(np.uint64) for x in (prints[:, :NEIGHBOURS], prints[:, 1 : NEIGHBOURS + 1]))
        place = np.tile(np.arange(NEIGHBOURS, dtype=np.uint64), len(prints)) << np.uint64(BITS)
        sid = np.repeat(column(batch, "sid").to_numpy(zero_copy_only=False), NEIGHBOURS)
        yield pa.RecordBatch.from_arrays([pa.array((simhash.nearest_anchor(some, BITS) | place).view(np.int64)), pa.array(follow.view(np.int64)), pa.array(sid)], ["anchor", "next", "sid"])


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) for the anchors of every segment of each row, in order of rows; an anchor begins with its segment's number."""
    anchor, index = simhash.anchors_of(prints.ravel().astype(np.uint64), BITS)
    row, segment = np.divmod(index, prints.shape[1])
    order = np.argsort(row, kind="stable")
    return (anchor.view(np.int64) | segment << BITS)[order], row[order]


def _binary(values: np.ndarray) -> pa.Array:
    """A row of bytes for each row of a matrix."""
    values = np.ascontiguousarray(values)
    at = np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.itemsize * values.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(at), pa.py_buffer(values)])


def _dealt(batches, parts: int):
    """Each set's segments, ``TOGETHER`` in a row, for every bucket that has anchors of them; a bucket is one of ``parts`` by a hash of the anchor."""
    kinds = SEGMENTS // TOGETHER
    for batch in batches:
        for lo in range(0, len(batch), 100):
            some = batch.slice(lo, 100)
            prints, c = segments(column(some, "print")), column(some, "c").to_numpy(zero_copy_only=False)
            anchor, row = anchors(prints)
            bucket = (anchor >> BITS) // TOGETHER * parts + (mix(anchor.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            row, bucket = np.divmod(np.unique(row * (kinds * parts) + bucket), kinds * parts)
            values = prints.reshape(-1, kinds, TOGETHER)[row, bucket // parts]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(c[row]), _binary(values), _binary(prints[row, :HEAD])], ["group", "c", "segments", "head"])


def _loosely_linked(batches, parts: int, small: int):
    """For each bucket a forest of links between components whose sets meet at its anchors."""
    for table in whole_groups(batches, "group"):
        for part in _parts(table):
            bucket = part.column("group")[0].as_py()
            nodes, c = np.unique(column(part, "c").to_numpy(zero_copy_only=False), return_inverse=True)
            head = segments(column(part, "head"), HEAD).view("<u8")
            anchor, row = anchors(segments(column(part, "segments"), TOGETHER))
            whole = (anchor + (bucket // parts * TOGETHER << BITS)).view(np.uint64)
            own = np.flatnonzero(mix(whole) % np.uint64(parts) == bucket % parts)
            own = own[np.argsort(anchor[own], kind="stable")]
            anchor, row = anchor[own], row[own]
            size = np.diff(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])))
            size = np.repeat(size, size)
            place = np.flatnonzero((size[:-1] > small) & (anchor[1:] == anchor[:-1]))
            parent = simhash.joined(np.arange(len(nodes)), c[row[place]], c[row[place + 1]])
            place, step = np.flatnonzero(size <= small), 1
            while len(place):
                place = place[place < len(anchor) - step]
                place = place[anchor[place] == anchor[place + step]]
                x, y = row[place], row[place + step]
                apart = parent[c[x]] != parent[c[y]]
                x, y = x[apart], y[apart]
                near = np.bitwise_count(head[x] ^ head[y]).sum(axis=1, dtype=np.int64) <= MOST_DIFFER_HEAD
                parent = simhash.joined(parent, c[x[near]], c[y[near]])
                step += 1
            moved = np.flatnonzero(parent != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[parent[moved]])], ["u", "v"])
    release()


def _neighbours(batches):
    parts = [[column(b, k).to_numpy(zero_copy_only=False) for k in ("anchor", "next", "sid")] for b in batches]
    if parts:
        anchor, follow, sid = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((sid, follow, anchor))
        anchor, sid = anchor[order], sid[order]
        pair = np.flatnonzero((anchor[1:] == anchor[:-1]) & (sid[1:] != sid[:-1]))
        u, v = np.maximum(sid[pair], sid[pair + 1]), np.minimum(sid[pair], sid[pair + 1])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _alike(batches):
    for batch in batches:
        a, b = (segments(column(batch, k)) for k in ("print_u", "print_v"))
        yield batch.select(["u", "v"]).filter(pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= MOST_DIFFER))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes have the least similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * common >= LEAST[0] * (len(a) + len(b) - common)


def _verified(batches):
    for batch in batches:
        for lo in range(0, len(batch), 500):
            some = batch.slice(lo, 500)
            u, v = ([h[a:b] for _, at, h in shingle_sets(column(some, k)) for a, b in zip(at[:-1], at[1:])] for k in ("text_u", "text_v"))
            yield some.select(["u", "v"]).filter(pa.array([similar(a, b) for a, b in zip(u, v)], pa.bool_()))
    release()


def _confirm(pairs: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets that have the least similarity."""
    for k in ("u", "v"):
        pairs = pairs.join(prints.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("print").alias(f"print_{k}")), k)
    near = LEAST[1] * F.least("n_u", "n_v") >= LEAST[0] * F.greatest("n_u", "n_v")
    pairs = pairs.where(near).select("u", "v", "print_u", "print_v").mapInArrow(_alike, "u long, v long")
    for k in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("sid").alias(k), F.col("text").alias(f"text_{k}")), k)
    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(_verified, "u long, v long").checkpoint()


def _shingles(batches):
    for batch in batches:
        for lo, at, h in shingle_sets(column(batch, "text")):
            rows = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("sid").slice(lo, len(rows)), pa.array(rows, pa.binary())], ["sid", "shingles"])
    release()


def _parts(table: pa.Table) -> Iterator[pa.Table]:
    group = column(table, "group").to_numpy(zero_copy_only=False)
    cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
    yield from (table.slice(a, b - a) for a, b in zip(cut, cut[1:]))


def links_in_group(sid: np.ndarray, c: np.ndarray, block: np.ndarray, prints: np.ndarray, shingles: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets of different components, as many as join all that a pair joins.

    Sets outside their family's largest component are compared with those of the other block, or with each other where there is one block; the
    largest component's have a block below 0.
    """
    n, c, links = np.array([len(x) for x in shingles]), c.copy(), []
    out, one = block >= 0, (block == block[0]).all()
    prints = prints.view("<u8")
    for o in np.flatnonzero(out):
        far = (c != c[o]) & (one | (block != block[o])) & (~out | (sid > sid[o])) & (LEAST[1] * np.minimum(n, n[o]) >= LEAST[0] * np.maximum(n, n[o]))
        rows = np.flatnonzero(far)
        rows = rows[np.bitwise_count(prints[rows] ^ prints[o]).sum(axis=1, dtype=np.int64) <= MOST_DIFFER]
        if not len(rows):
            continue
        own, h = shingles[o], np.concatenate([shingles[k] for k in rows])
        at = np.cumsum(n[rows]) - n[rows]
        common = np.add.reduceat(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h, at, dtype=np.int64)
        near = rows[LEAST[1] * common >= LEAST[0] * (n[rows] + n[o] - common)]
        parts, first = np.unique(c[near], return_index=True)
        links += [(int(max(sid[o], sid[k])), int(min(sid[o], sid[k]))) for k in near[first]]
        c[np.isin(c, parts)] = c[o]
    return links


def _compared(batches):
    for table in whole_groups(batches, "group"):
        links = []
        for part in _parts(table):
            sid, c, block = (column(part, k).to_numpy(zero_copy_only=False) for k in ("sid", "c", "block"))
            links += links_in_group(sid, c, block, segments(column(part, "print")), [np.frombuffer(x, np.uint64) for x in column(part, "shingles").to_pylist()])
        u, v = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    release()


def _across(prints: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between sets of one family that are in different components so far."""
    placed = prints.join(members, prints["sid"] == members["node"], "left").select("sid", "n", "print", F.coalesce("component", "sid").alias("c")).checkpoint()
    parts, small = max(1, -(-placed.count() * 16 * TOGETHER // BUCKET)), SMALL
    dealt = placed.select("print", "c").mapInArrow(lambda batches: _dealt(batches, parts), "group long, c long, segments binary, head binary")
    loose = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: _loosely_linked(batches, parts, small), "u long, v long")
    families = connected_components(loose).select("node", F.col("component").alias("family"))
    held = placed.join(families, placed["c"] == families["node"]).select("family", "sid", "c", "n", "print").checkpoint()
    by_part = held.groupBy("family", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    tops = by_part.groupBy("family").agg(F.max(F.struct("k", "c", "n")).alias("top"), F.sum("k").alias("k"), F.sum("n").alias("n"))

    def blocks(k, n, most):
        return F.greatest(F.ceil(k / most[0]), F.ceil(n / most[1])).cast("long")

    shape = tops.select("family", F.col("top.c").alias("top"), blocks(F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n"), BLOCK_OUT).alias("outs"), blocks(F.col("top.k"), F.col("top.n"), BLOCK_IN).alias("ins"))
    out = F.col("c") != F.col("top")
    rows = held.join(shape, "family").withColumn("out", out).withColumn("block", F.pmod(F.xxhash64("sid"), F.when(out, F.col("outs")).otherwise(F.col("ins"))))
    pair = lambda kind, x, y: F.xxhash64("family", F.lit(kind), x, y)
    with_in = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ins") - 1), lambda y: pair(0, F.col("block"), y))
    with_out = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1), lambda x: pair(1, F.least(x, F.col("block")), F.greatest(x, F.col("block"))))
    as_in = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1), lambda x: pair(0, x, F.col("block")))
    rows = rows.withColumn("groups", F.when(F.col("out"), F.concat(with_in, with_out)).otherwise(as_in)).withColumn("block", F.when(F.col("out"), F.col("block")).otherwise(F.lit(-1)).cast("long"))
    rows = rows.join(texts.mapInArrow(_shingles, "sid long, shingles binary"), "sid").select("sid", "c", "block", "print", "shingles", F.explode("groups").alias("group"))
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_compared, "u long, v long").distinct().checkpoint()


def _sharing(sets: DataFrame) -> DataFrame:
    """The sets of which enough sampled shingles are in another set too. A shingle of one set alone names that set, so no set's rows meet at a frequent shingle."""
    some = sets.where("n > 0")
    held = some.select("sid", "least").mapInArrow(_sampled, "h long, sid long").groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("sid").alias("of"))
    alone = held.where("k = 1").groupBy("of").agg(F.count(F.lit(1)).alias("alone"))
    return some.join(alone, some["sid"] == alone["of"], "left").where(MOST_ALONE[1] * F.coalesce("alone", F.lit(0)) <= MOST_ALONE[0] * F.length("least") / 8).select("sid", "n", "head")


def _whole(batches):
    for batch in batches:
        for lo, at, h in shingle_sets(column(batch, "text")):
            sid = column(batch, "sid").to_numpy(zero_copy_only=False)[lo : lo + len(at) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(sid, np.diff(at)))], ["h", "sid"])
    release()


def _nearly_shared(texts: DataFrame) -> DataFrame:
    """The texts whose sets have no more shingles that no other one has than a near copy leaves."""
    held = texts.select("sid", "text").mapInArrow(_whole, "h long, sid long").groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("sid").alias("of"))
    alone = held.where("k = 1").groupBy("of").agg(F.count(F.lit(1)).alias("alone"))
    left = texts.select("sid", "n").join(alone, texts["sid"] == alone["of"], "left").where(LEAST[1] * F.coalesce("alone", F.lit(0)) <= (LEAST[1] - LEAST[0]) * F.col("n"))
    return texts.join(left.select("sid").checkpoint(), "sid", "left_semi")


def _groups(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component): components of near copies among distinct sets; sets without a near copy are left out."""
    wanted = _sharing(sets).select("sid", "n", F.col("head.id").alias("head_id"), F.col("head.row").alias("head_row"))
    found = keyed.join(wanted, keyed["id"].eqNullSafe(wanted["head_id"]) & (keyed["row"] == wanted["head_row"]))
    texts = _nearly_shared(found.select("sid", "n", "text").dropDuplicates(["sid"]).checkpoint()).select("sid", "text")
    prints = texts.mapInArrow(_fingerprints, "sid long, n long, print binary").checkpoint()

    nearest = prints.select("sid", "print").mapInArrow(_nearest, "anchor long, next long, sid long")
    first = nearest.repartitionByRange("anchor", "next", "sid").mapInArrow(_neighbours, "u long, v long").distinct().checkpoint()
    links = _confirm(first, prints, texts)
    members = connected_components(links)

    more = _across(prints, members, texts)
    return members if more.isEmpty() else connected_components(links.union(more))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, row, component) for each input row: ``row`` is a hash of all its columns, component the same for rows of one group.

    Null and empty texts have the empty set and form one group.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["id"].dataType.simpleString()
    rows = keyed.mapInArrow(lambda batches: (x for b in batches for x in _signatures(b)), f"id {kind}, text_hash long, row long, sid long, n long, least binary").checkpoint()
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head")
    sets = rows.groupBy("sid").agg(F.first("n").alias("n"), F.first("least").alias("least"), head).checkpoint()
    groups = _groups(keyed, sets)
    return rows.join(groups, rows["sid"] == groups["node"], "left").select("id", "text_hash", "row", F.coalesce("component", "sid").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group: the least id, nulls last, then the least hashes of text and row. Equal rows are one.

    Null and empty texts are one group, an empty table has no rows, and columns may have any names. A text's set of shingles is held in one task while
    it is made and compared, some 30 bytes for each of its words.
    """
    names = docs.columns
    docs = docs.toDF(*(f"in{k}" for k in range(len(names))))  # no name of the input meets one that is used here
    id_col, text_col = f"in{names.index(id_col)}", f"in{names.index(text_col)}"
    rows = labelled(docs, id_col, text_col)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "row")
    best = rows.groupBy("component").agg(F.min(rank).alias("best")).select(F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row"))
    copies = rows.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n_rows"))
    best = best.join(copies, best["best_id"].eqNullSafe(copies["id"]) & (best["best_row"] == copies["row"])).select("best_id", "best_row", (F.col("n_rows") > 1).alias("again")).checkpoint()
    row_hash = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))

    def taken(some: DataFrame) -> DataFrame:
        return docs.join(some, docs[id_col].eqNullSafe(some["best_id"]) & (row_hash == some["best_row"]), "left_semi")

    again = best.where("again")
    return (taken(best) if again.isEmpty() else taken(best.where("NOT again")).unionByName(taken(again).dropDuplicates())).toDF(*names)
