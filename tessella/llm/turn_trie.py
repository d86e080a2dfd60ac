"""The prefix trie of rebuilt conversations, from composable fingerprints.

A sequence of turns has the fingerprint ``f(a b) = f(a) * B^|b| + f(b)`` modulo 2^64, in two lanes: a monoid, whose elements also
subtract. A conversation is rebuilt from the head of its base and its own turns behind its own head, so the fingerprint of each of its
prefixes is the base's product at the border combined with a difference of two of its own products. No rebuilt text is ever put
together: a prefix row carries fingerprints, the class of its last turn's content and a reference to that turn.

Equality is proven, not assumed. Turns of one class are compared by role and text; rows of one prefix group must agree in the class of the
turn they refer to and in the group of the prefix before, so by induction in all turns. Where a proof fails, all is done again
with other hashes.

Subtree sums need no walk over the tree. The smallest member of a node represents it; along a conversation, once it represents a node it
represents all deeper ones. So a subtree's leaves are counted at the conversations that represent leaves, and what a conversation
shares with smaller ones is a prefix of known bytes: both are sums over the members of a node.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import ensure_checkpoint_dir

#: Odd multipliers of the two lanes, and their inverses.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_KEY = ["depth", "f1", "f2"]


@dataclass(frozen=True)
class Rebuild:
    """Conversation c takes its head from conversation c - c % ``family``: CRC-32 of its decimal id modulo ``most_head`` + 1 turns."""

    family: int = 5
    most_head: int = 8
    #: Rows of one conversation that meet its facts in one task.
    block_rows: int = 1024
    #: Bits of the content hashes in the first attempt; fewer only to make clashes in tests.
    first_mask: int = -1

    def base(self, conv: Column) -> Column:
        return conv - conv % self.family

    def head(self, conv: Column) -> Column:
        return F.crc32(conv.cast("string")) % (self.most_head + 1)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base^n modulo 2^64, element by element."""
    out, square, n = np.ones(len(n), np.uint64), base, n.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), out * np.uint64(square), out)
        square, n = square * square % (1 << 64), n >> np.uint64(1)
    return out


def _running(base: int, e: np.ndarray, first: np.ndarray, carried: int) -> np.ndarray:
    """Products of each row's segment up to it; ``first`` is the first row of its segment, and a segment at -1 goes on from ``carried``."""
    at = np.arange(len(e), dtype=np.uint64)
    up, down = _power(base, at), _power(pow(base, -1, 1 << 64), at)
    total = np.zeros(len(e) + 1, np.uint64)
    np.cumsum(e * down, out=total[1:])
    begin = np.maximum(first, 0)
    out = (total[1:] - total[begin]) * up
    return out + np.where(first < 0, _power(base, at + np.uint64(1)) * np.uint64(carried), np.uint64(0))


def _scan(batches: Iterator[pa.RecordBatch], state: tuple) -> Iterator[tuple]:
    """(batch, place, products, bytes, state after) for sorted turns, where ``state`` (conv, turns, f1, f2, bytes) may hold the begin of the first conversation."""
    for batch in batches:
        if not len(batch):
            continue
        conv = batch.column("conv").to_numpy(zero_copy_only=False)
        e = [_unsigned(batch.column(c)) for c in ("e1", "e2")]
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = state[0] is None or conv[0] != state[0]
        first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
        goes_on = first < 0
        place = np.arange(len(conv)) - np.maximum(first, 0) + np.where(goes_on, state[1], 0)
        f = [_running(b, x, first, c) for b, x, c in zip(_BASES, e, state[2:4])]
        total = np.concatenate([[0], np.cumsum(batch.column("bytes").to_numpy(zero_copy_only=False), dtype=np.int64)])
        so_far = total[1:] - total[np.maximum(first, 0)] + np.where(goes_on, state[4], 0)
        state = (int(conv[-1]), int(place[-1]) + 1, int(f[0][-1]), int(f[1][-1]), int(so_far[-1]))
        yield batch, new, place, f, so_far, state


_NOTHING = (None, 0, 0, 0, 0)


def _numbered(turns: DataFrame) -> DataFrame:
    """Each turn's place in its conversation, with the product and the bytes of all turns up to it.

    Turns lie range-sorted, so a conversation may span parts. Each part tells the products of its first and its last conversation; these
    few rows are combined into what each part begins with, and a second pass writes the running products.
    """

    def edges(batches):
        part, first, last, many = None, None, None, 0
        for batch, new, place, f, so_far, state in _scan(batches, _NOTHING):
            part = batch.column("part")[0].as_py()
            starts = np.flatnonzero(new)
            if many < 2:  # the first conversation goes on until a second one starts
                others = starts[1:] if many == 0 else starts
                k = (int(others[0]) if len(others) else len(place)) - 1
                if k >= 0:
                    first = (batch.column("conv")[k].as_py(), int(place[k]) + 1, int(f[0][k]), int(f[1][k]), int(so_far[k]))
            many += len(starts)
            last = state
        if part is not None:
            rows = [(part, many == 1, k, *x) for k, x in enumerate((first, last))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
                + [pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in (5, 6)]
                + [pa.array([r[7] for r in rows], pa.int64())],
                ["part", "single", "edge", "conv", "turns", "f1", "f2", "bytes"],
            )

    found = turns.mapInArrow(edges, "part int, single boolean, edge int, conv long, turns long, f1 long, f2 long, bytes long")
    rows = {(r.part, r.edge): (r.conv, r.turns, r.f1 % 2**64, r.f2 % 2**64, r.bytes, r.single) for r in found.collect()}  # two rows a part
    begins, state = {}, _NOTHING
    for part in sorted({p for p, _ in rows}):
        first, last = rows[part, 0], rows[part, 1]
        if state[0] == first[0]:
            begins[part] = state
        if last[5] and state[0] == first[0]:
            f = [(a * pow(b, last[1], 1 << 64) + x) % (1 << 64) for a, b, x in zip(state[2:4], _BASES, last[2:4])]
            state = (last[0], state[1] + last[1], f[0], f[1], state[4] + last[4])
        else:
            state = last[:5]

    def number(batches):
        batches = iter(batches)
        head = next((b for b in batches if len(b)), None)
        if head is None:
            return
        begin = begins.get(head.column("part")[0].as_py(), _NOTHING)
        for batch, _, place, f, so_far, _ in _scan(itertools.chain([head], batches), begin):
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv", "e1", "e2", "bytes")] + [pa.array(place, pa.int64()), *(pa.array(x.view(np.int64)) for x in f), pa.array(so_far, pa.int64())],
                ["conv", "e1", "e2", "bytes", "place", "p1", "p2", "so_far"],
            )

    return turns.mapInArrow(number, "conv long, e1 long, e2 long, bytes long, place long, p1 long, p2 long, so_far long")


def _compose(rows: DataFrame) -> DataFrame:
    """Fingerprints of prefixes: own product p, less the own head's product o, with the base head's product h before it; ``behind`` turns lie behind the head."""
    names = ["conv", "depth", "length", "e1", "e2", "bytes", "before", "ref_conv", "ref_place"]

    def run(batches):
        for batch in batches:
            behind = batch.column("behind").to_numpy(zero_copy_only=False)
            lanes = []
            for k, (base, inverse) in enumerate(zip(_BASES, _INVERSES), 1):
                p, o, h, e = (_unsigned(batch.column(f"{c}{k}")) for c in "pohe")
                f = p + (h - o) * _power(base, behind)
                lanes.append((f, (f - e) * np.uint64(inverse)))
            arrays = [pa.array(x.view(np.int64)) for x in (lanes[0][0], lanes[1][0], lanes[0][1], lanes[1][1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], [*names, "f1", "f2", "g1", "g2"])

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "f1", "f2", "g1", "g2"]))


def _blocks(facts: DataFrame, rows: Column, p: Rebuild) -> DataFrame:
    """One row for each block of a conversation's rows, so that a long conversation meets its facts in many tasks."""
    return facts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(rows / p.block_rows))))


def _prefixes(turns: DataFrame, p: Rebuild) -> tuple[DataFrame, DataFrame]:
    """(facts of the conversations, rows of all prefixes of at least one turn)."""
    own = _numbered(turns).checkpoint()
    head = p.head(F.col("conv"))
    at_border = lambda c: F.max(F.when(F.col("place") == head - 1, F.col(c)))
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"), *(F.coalesce(at_border(c), F.lit(0)).alias(o) for c, o in (("p1", "o1"), ("p2", "o2"), ("so_far", "own_head")))).withColumn("head", head).withColumn("base", p.base(F.col("conv")))
    turn = F.struct("place", "e1", "e2", "bytes", "p1", "p2", "so_far")
    bases = own.where((F.col("place") < p.most_head) & (p.base(F.col("conv")) == F.col("conv"))).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("first"))
    facts = convs.join(bases, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<place:bigint,e1:bigint,e2:bigint,bytes:bigint,p1:bigint,p2:bigint,so_far:bigint>>")), F.lit(1), F.col("head").cast("int")))
    border = lambda c: F.when(F.size("first") > 0, F.try_element_at("first", F.lit(-1))[c]).otherwise(F.lit(0))
    facts = facts.withColumn("taken", F.size("first").cast("long")).withColumns({"h1": border("p1"), "h2": border("p2"), "base_head": border("so_far")})
    facts = facts.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("head"))).checkpoint()

    zero = F.lit(0).cast("long")
    heads = facts.select("conv", "length", "base", F.explode("first").alias("t")).select(
        "conv", (F.col("t.place") + 1).alias("depth"), "length", "t.e1", "t.e2", "t.bytes", (F.col("t.so_far") - F.col("t.bytes")).alias("before"), F.col("base").alias("ref_conv"), F.col("t.place").alias("ref_place"),
        "t.p1", "t.p2", zero.alias("o1"), zero.alias("o2"), zero.alias("h1"), zero.alias("h2"), zero.alias("behind"),
    )
    tails = own.where(F.col("place") >= head).withColumn("block", F.floor(F.col("place") / p.block_rows)).join(_blocks(facts.where(F.col("turns") > F.col("head")), F.col("turns"), p).drop("bytes"), ["conv", "block"])
    behind = F.col("place") - F.col("head") + 1
    tails = tails.select(
        "conv", (F.col("taken") + behind).alias("depth"), "length", "e1", "e2", "bytes", (F.col("base_head") + F.col("so_far") - F.col("own_head") - F.col("bytes")).alias("before"), F.col("conv").alias("ref_conv"), F.col("place").alias("ref_place"),
        "p1", "p2", "o1", "o2", "h1", "h2", behind.alias("behind"),
    )
    return facts.select("conv", "length"), _compose(heads.union(tails)).checkpoint()


def _proven(contents: DataFrame, nodes: DataFrame) -> bool:
    """Whether turns of one class have one role and text, and rows of one group one last class and one group before."""
    same = contents.groupBy("e1", "e2", "role", "text").count().groupBy("e1", "e2").count().where("count > 1")
    mixed = nodes.where(" OR ".join(f"least_{c} <> most_{c}" for c in ("e1", "e2", "g1", "g2")))
    return not same.limit(1).count() and not mixed.limit(1).count()


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each node's whole conversations, which stream through a task in sorted runs of some 4,096 ids."""
    runs = rows.groupBy(*_KEY, F.shiftright("conv", 12).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in [*_KEY, "ids"])):
                if now == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [*_KEY, "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*_KEY, "ends"])

    return runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "run").mapInArrow(digest, "depth long, f1 long, f2 long, ends string")


def prefix_trie(conversations: DataFrame, p: Rebuild = Rebuild(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over its subtree:
    UTF-8 bytes of last texts that members beyond the first need not store), ends_sha256, and ``node`` (the two lanes of the fingerprint).

    Turns are ordered by turn, null first, then by role and by hash of role and text, so repeated rows are turns of their own. Null role or text is
    the empty text. Rows without a conversation id belong to none and are left out; an empty table has no rows. Other columns are ignored.
    A conversation of any length spans tasks; of a node's ids, only the digest, sequential by nature, passes through one task as a stream.
    """
    ensure_checkpoint_dir(conversations.sparkSession)
    plain = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for attempt in itertools.count():
        mask = F.lit(p.first_mask if attempt == 0 else -1)
        contents = plain.withColumns({f"e{k}": F.xxhash64(F.lit(2 * attempt + k), "role", "text").bitwiseAND(mask) for k in (1, 2)})
        order = ["conv", F.col("turn").asc_nulls_first(), "role", "e1", "e2"]
        turns = contents.select("conv", "turn", "role", "e1", "e2", F.octet_length("text").cast("long").alias("bytes")).repartitionByRange(*order).sortWithinPartitions(*order)
        facts, rows = _prefixes(turns.select("conv", "e1", "e2", "bytes", F.spark_partition_id().alias("part")).checkpoint(), p)
        edges = [x for c in ("e1", "e2", "g1", "g2") for x in (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"))]
        nodes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"), F.min(F.struct("conv", "before")).alias("least"), *edges).checkpoint()
        if _proven(contents, nodes):
            break
    nodes = nodes.select(*_KEY, F.col("least_g1").alias("g1"), F.col("least_g2").alias("g2"), "n_convs", "n_ends", F.col("least.conv").alias("conv"), F.col("least.before").alias("before"))
    zero = F.lit(0).cast("long")
    root = facts.agg(F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends"), F.min("conv").alias("conv")).where("n_convs > 0")

    # since which depth a conversation represents its nodes, what it shares before that, and whether it represents a leaf
    own = nodes.groupBy("conv").agg(F.min(F.struct("depth", "before")).alias("since"), F.max(F.col("n_convs") == F.col("n_ends")).alias("leaf"))
    whole = rows.where(F.col("depth") == F.col("length")).select("conv", (F.col("before") + F.col("bytes")).alias("all_bytes"))
    facts = facts.join(whole, "conv", "left").join(own, "conv", "left").select(
        "conv", "length",
        F.coalesce(F.col("since.depth"), F.col("length") + 1).alias("since"),
        F.coalesce(F.col("since.before"), F.col("all_bytes"), zero).alias("shared"),
        F.coalesce(F.col("leaf"), F.lit(False)).cast("long").alias("leaf"),
    ).checkpoint()
    members = rows.select("conv", *_KEY, "before", F.floor(F.col("depth") / p.block_rows).alias("block")).join(_blocks(facts, F.col("length"), p).drop("length"), ["conv", "block"])
    shares = members.select(*_KEY, "leaf", F.when(F.col("depth") < F.col("since"), F.col("shared") - F.col("before")).otherwise(zero).alias("saved"), (F.col("depth") > F.col("since")).cast("long").alias("follows"), zero.alias("child"))
    top = facts.select(zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "leaf", F.col("shared").alias("saved"), zero.alias("follows"), zero.alias("child"))
    children = nodes.select((F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2"), zero.alias("leaf"), zero.alias("saved"), zero.alias("follows"), F.lit(1).cast("long").alias("child"))
    sums = shares.union(top).union(children).groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("follows").alias("follows"), F.sum("child").alias("n_children"))
    every = nodes.select(*_KEY, "g1", "g2", "n_convs", "conv").union(root.select(zero, zero, zero, zero, zero, "n_convs", "conv")).join(sums, _KEY)
    ends = _ends(rows.where(F.col("depth") == F.col("length")).select(*_KEY, "conv").union(facts.where("length = 0").select(zero, zero, zero, "conv")))
    every = every.join(ends, _KEY, "left").checkpoint()

    # a node's parent has another smallest member only where that conversation begins to represent nodes
    salts = 8
    above = every.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("conv").alias("parent")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    turning = every.where("follows = 0 AND depth > 0").withColumn("salt", F.pmod("f1", F.lit(salts)).cast("int")).join(above, ["depth", "g1", "g2", "salt"]).drop("salt")
    settled = every.where("follows = 1 OR depth = 0").withColumn("parent", F.when(F.col("depth") > 0, F.col("conv")))
    return turning.select(settled.columns).union(settled).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.struct("f1", "f2").alias("node"),
    )


#: DuckDB SQL for the rows of the query: rebuilt turns, prefixes as lists, and subtrees by the smallest members of nodes. CRC-32 bit by bit.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
               lambda u, i: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END)), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.k AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, t.k - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h LEFT JOIN c AS b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, d, strlen(text) AS bytes, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
  UNION ALL
  SELECT conv_id, 0, 0, [] FROM c),
m AS (
  SELECT conv_id, d, bytes, path, lag(path) OVER w AS above, max(d) OVER (PARTITION BY conv_id) AS length FROM p
  WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
g AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, any_value(above) AS above,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = length), '')) AS ends_sha256
  FROM m GROUP BY path, d),
k AS (SELECT above AS path, count(*) AS n FROM g WHERE d > 0 GROUP BY above),
gk AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.path = g.path),
s AS (
  SELECT m.path, sum((u.n_convs - 1) * u.bytes) AS saved_tokens, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves
  FROM gk AS u JOIN m ON m.conv_id = u.conv_id AND m.d <= u.d GROUP BY m.path)
SELECT v.conv_id, v.d::BIGINT AS depth, a.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM gk AS v JOIN s ON s.path = v.path LEFT JOIN g AS a ON v.d > 0 AND a.path = v.above
"""
