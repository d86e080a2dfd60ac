"""Cross-entropy difference between a target and a background n-gram model.

Both models are word bigrams, interpolated with unigrams over one vocabulary: all words of the corpus. The background model counts every
text of the corpus, the target model those of the target. A text never scores itself: its own counts are taken off each model that has
them, so a text that stands alone in the corpus and one that occurs again score apart. The models are matched: unseen words have one share in both, whatever
the models' sizes, and a bigram counts where both know its context; otherwise the smaller model would take every rare word for its own. Texts are dealt
to blocks by hash of their id, and those of heavy ids by hash of their text too. Each block sends its distinct n-grams with their counts, sorted by hash and cut into hash
ranges (shards), so an n-gram is sent once for each block, however common it is. A shard adds the counts up over all blocks and answers each
block's list in the order in which it came. So every block gets the corpus-wide counts of just the n-grams that it holds, and no
model has to fit in one task or the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Chunk, chunks, column, mix, raw
from .graph import ensure_checkpoint_dir

_TEXT_START = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class LmParams:
    #: Bytes of text in a block: at least, and at most. Between them it grows with the root of the input, so that blocks times shards do
    #: not grow with its square.
    block_bytes: int = 4 << 20
    most_block_bytes: int = 16 << 20
    #: Bytes of text for each shard, in blocks.
    shard_blocks: int = 4
    #: The ids whose texts have more than a block's bytes over this are spread over all blocks.
    hot_share: int = 4
    #: What all unseen words together have, as a share of all seen ones, in either model: so an unseen word tells nothing for or against a text.
    unseen: float = 0.1
    #: Weight of the bigram estimate against the unigram one.
    bigram_weight: float = 0.6


def pack(values: np.ndarray) -> bytes:
    """Compressed unsigned numbers, bytes of equal rank together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()) if len(values) else b""


def unpack(body: bytes, kind: type) -> np.ndarray:
    if not body:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(body: bytes) -> np.ndarray:
    return np.cumsum(unpack(body, np.uint64), dtype=np.uint64)


class BlockGrams:
    """Words and bigrams of a block: distinct keys and which of them each token has."""

    def __init__(self, texts: pa.Array):
        data, at = raw(pc.utf8_lower(texts))
        word, row = [], []
        for lo, hi in chunks(at):
            c = Chunk(data, at, lo, hi)
            start, end, r = c.words()
            word.append(c.hashes(start, end))
            row.append(r + lo)
        w = np.concatenate(word) if word else np.zeros(0, np.uint64)
        self.row = np.concatenate(row) if row else np.zeros(0, np.int64)
        first = np.ones(len(w), dtype=bool)
        first[1:] = self.row[1:] != self.row[:-1]
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[first] = _TEXT_START
        # the start of a text counts as a word, so that it has a count as a context
        self.words, index = np.unique(np.concatenate([w, np.full(int(first.sum()), _TEXT_START)]), return_inverse=True)
        self.word, self.counted = index[: len(w)], index
        self.context = np.searchsorted(self.words, before)
        self.pairs, self.pair = np.unique(mix(before * np.uint64(0x9E3779B97F4A7C15) + w), return_inverse=True)


def _shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    bounds = np.array([(k << 64) // shards for k in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


_SENT = "shard int, block long, aimed binary, words binary, word_all binary, word_target binary, pairs binary, pair_all binary, pair_target binary"
_ANSWER = "block long, shard int, aimed binary, word_all binary, word_target binary, pair_all binary, pair_target binary, vocabulary long, all_tokens long, target_tokens long"
_SCORES_NAMES = ("n_tokens", "target_loss", "background_loss", "score", "in_target")
_SCORES = "{} long, n_tokens long, target_loss double, background_loss double, score double, in_target boolean"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.table([pa.array([r[k] for r in rows], types[kind]) for k, kind in enumerate(kinds)], names=list(names))


def _among(ids: pa.Array, chosen: np.ndarray) -> np.ndarray:
    return pc.is_in(ids, value_set=pa.array(chosen, pa.int64())).to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)


def _own(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each token, how often its row has its key."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(r), dtype=np.int64)
    out[order] = np.bincount(group)[group] if len(r) else 0
    return out


def _limit(scored: DataFrame, rejected: DataFrame | None, id_col: str) -> float | None:
    """The score up to which rows are selected: with rejected rows the least one where the shares of target rows and of rejected rows up to it are furthest
    apart. All labelled rows count: scores are counted, and running counts go by thousandths of a score, of which there are no more than scores
    in nats have, and then by score within each.
    """
    exact, some = F.col("score").cast("decimal(28,9)"), F.col("n_tokens") > 0
    if rejected is not None:
        bad = rejected.select(F.col(id_col).cast("long").alias(id_col)).distinct().withColumn("bad_", F.lit(True))
        kinds = scored.where(some).join(bad, id_col, "left").select(exact.alias("s"), F.col("in_target").cast("long").alias("g"), (~F.col("in_target") & F.coalesce("bad_", F.lit(False))).cast("long").alias("b"))
        counts = kinds.where("g + b > 0").groupBy("s").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).withColumn("slot", F.floor(F.col("s") * 1000))
        sums = lambda window: (F.sum(c).over(window) for c in ("g", "b"))
        g0, b0 = sums(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
        slots = counts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
        n_good, n_bad = slots.agg(F.sum("g"), F.sum("b")).first()
        if n_good and n_bad:
            g1, b1 = sums(Window.partitionBy("slot").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
            upto = counts.select("slot", "s", g1.alias("g1"), b1.alias("b1")).join(slots.select("slot", g0.alias("g0"), b0.alias("b0")), "slot")
            of = lambda c, n: (F.coalesce(F.col(f"{c}0"), F.lit(0)) + F.col(f"{c}1")).cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)")
            gain = of("g", n_bad) - of("b", n_good)
            return float(upto.agg(F.max_by("s", F.struct(gain, -F.col("s")))).first()[0])
    aim, rest = scored.agg(*(F.avg(F.when(some & hit, exact)) for hit in (F.col("in_target"), ~F.col("in_target")))).first()
    return None if aim is None or rest is None else float(aim + rest) / 2


def cross_entropy_difference(docs: DataFrame, target: DataFrame, p: LmParams = LmParams(), rejected: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score, in_target, selected) for each row; target has the ids of the target texts.

    Losses are nats per token; score is target_loss - background_loss, so lower is more like the target. A row is selected if its score is
    at most the limit that tells target rows and rows of ``rejected`` (ids of texts known to be bad) apart best, by the difference of the shares it selects, over all of
    them. Without such rows the limit is the mean of the target rows' mean score and the other rows' one (over rows with words, in billionths); none is
    selected where either has no rows. A text without words has zeros and is not selected. Null text is empty, repeated rows count each time and only a row
    itself is taken off, a null id is in no target, and without target texts the target model is uniform. A block is held in one task, with some 60 times its bytes; so is
    a text that is longer than a block, and rows that repeat both id and text.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    block_bytes = max(p.block_bytes, min(p.most_block_bytes, int(128 * size**0.5)))
    blocks = -(-size // block_bytes) or 1
    shards = -(-blocks // p.shard_blocks)
    place = lambda salt: F.pmod(F.xxhash64(id_col, salt), F.lit(blocks)).alias("block")
    plain = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    # ids with more than a part of a block: at most hot_share for each block, whatever the rows
    hot = plain.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sum(F.octet_length(text_col)).alias("bytes")).where(F.col("bytes") * p.hot_share > block_bytes).select(F.col(id_col).alias("hot_"))
    marked = lambda rows: rows.join(F.broadcast(hot), F.col(id_col) == F.col("hot_"), "left")
    spread = F.col(id_col).isNull() | F.col("hot_").isNotNull()
    dealt = marked(plain).select(id_col, text_col, place(F.when(spread, F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))))
    wanted = marked(target.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col)).distinct())
    everywhere = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    wanted = wanted.select(id_col, F.explode(F.when(F.col("hot_").isNotNull(), everywhere).otherwise(F.array(place(F.lit(0).cast("long"))))).alias("block"))

    def send(key, texts: pa.Table, chosen: pa.Table) -> pa.Table:
        g = BlockGrams(column(texts, text_col))
        ids, chosen_ids = column(texts, id_col), column(chosen, id_col).to_numpy(zero_copy_only=False)
        aimed = _among(ids, chosen_ids)
        token = aimed[g.row] if len(g.row) else np.zeros(0, bool)
        starts = np.unique(g.row)
        counted = np.concatenate([token, aimed[starts]]) if len(starts) else token
        parts = []
        for keys, index, hit in ((g.words, g.counted, counted), (g.pairs, g.pair, token)):
            parts.append((keys, np.bincount(index, minlength=len(keys)).astype(np.uint32), np.bincount(index[hit], minlength=len(keys)).astype(np.uint32), _shard_cuts(keys, shards)))
        b = key[0].as_py() if len(texts) else -1
        out = []
        for s in range(shards):
            row = [s, b, pack(ids.filter(pa.array(aimed)).unique().to_numpy(zero_copy_only=False)) if s == 0 else None]
            for keys, every, some, cuts in parts:
                cut = slice(cuts[s], cuts[s + 1])
                row += [pack_sorted(keys[cut]), pack(every[cut]), pack(some[cut])]
            out.append(tuple(row))
        return _table(out if b >= 0 else [], _SENT)

    def answer(table: pa.Table) -> pa.Table:
        rows, out, told = table.num_rows, [[] for _ in range(table.num_rows)], []
        for kind in ("word", "pair"):
            keys = [unpack_sorted(x) for x in column(table, f"{kind}s").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
            for name in ("all", "target"):
                own = np.concatenate([unpack(x, np.uint32) for x in column(table, f"{kind}_{name}").to_pylist()])
                total = np.bincount(which, own, len(distinct)).astype(np.uint64)  # exact up to 2^53
                for k in range(rows):
                    out[k].append(pack(total[which[at[k] : at[k + 1]]]))
                if kind == "word":
                    told.append(int(total[distinct != _TEXT_START].sum()))
            if kind == "word":
                told.insert(0, int((distinct != _TEXT_START).sum()))
        blocks_, shards_ = column(table, "block").to_pylist(), column(table, "shard").to_pylist()
        return _table([(b, s, hit, *o, *told) for b, s, hit, o in zip(blocks_, shards_, column(table, "aimed").to_pylist(), out)], _ANSWER)

    def score(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return _table([], _SCORES.format(id_col))
        answers = answers.sort_by("shard")
        g, n_rows = BlockGrams(column(texts, text_col)), len(texts)
        aimed = _among(column(texts, id_col), unpack(column(answers, "aimed")[0].as_py(), np.int64))
        n = np.bincount(g.row, minlength=n_rows)
        vocabulary = sum(answers.column("vocabulary").to_pylist())
        # the context's count less the row's own: as a context every word of a row counts once for each time it stands in it
        own = {"word": _own(g.row, g.word), "pair": _own(g.row, g.pair)}
        first = np.ones(len(g.row), dtype=bool)
        first[1:] = g.row[1:] != g.row[:-1]
        own["context"] = np.where(first, 1, np.concatenate([[0], own["word"][:-1]])[: len(first)])
        loss, parts, seen = {}, {}, np.ones(len(g.row), bool)
        for name in ("target", "all"):
            words, pairs = (np.concatenate([unpack(x, np.uint64) for x in column(answers, f"{kind}_{name}").to_pylist()]).astype(np.int64) for kind in ("word", "pair"))
            less = aimed[g.row].astype(np.int64) if name == "target" else np.ones(len(g.row), np.int64)
            tokens = sum(answers.column(f"{name}_tokens").to_pylist()) - less * n[g.row]
            floor = p.unseen * np.maximum(tokens, 1) / vocabulary if vocabulary else 1.0
            one = (words[g.word] - less * own["word"] + floor) / (tokens + floor * vocabulary)
            context = words[g.context] - less * own["context"]
            seen &= context > 0
            parts[name] = one, (pairs[g.pair] - less * own["pair"]) / np.maximum(context, 1)
        weight = np.where(seen, p.bigram_weight, 0.0)  # where either model lacks the context, both go by the word alone
        for name, (one, two) in parts.items():
            loss[name] = np.bincount(g.row, -np.log(weight * two + (1 - weight) * one), n_rows) / np.maximum(n, 1)
        return pa.table([column(texts, id_col), pa.array(n, pa.int64()), pa.array(loss["target"]), pa.array(loss["all"]), pa.array(loss["target"] - loss["all"]), pa.array(aimed)], names=[id_col, *_SCORES_NAMES])

    sent = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(send, _SENT)
    answers = sent.groupBy("shard").applyInArrow(answer, _ANSWER)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORES.format(id_col)).checkpoint()
    limit = _limit(scored, rejected, id_col)
    return scored.withColumn("selected", F.lit(False) if limit is None else (F.col("n_tokens") > 0) & (F.col("score").cast("decimal(28,9)") <= F.lit(limit).cast("decimal(28,9)")))
