"""Exact ranked lexical search over posting lists in geometric blocks.

A document is a sparse vector: for each term, what one unit of the term's weight adds to its score. Every term's posting list is clustered by
the similarity of its documents, and each block of the list stores the coordinatewise maximum of their vectors. A query opens its
terms' lists from the rarest on. A block's summary bounds what its documents can score by this term and the terms still to
come (documents with an earlier term have been met in that term's list), so a block whose bound is below the k-th best score so far
cannot hold a better document and is skipped; the documents of all other blocks are scored in full. All bounds and scores are whole numbers, so the
result is exact.

The queries are taken in waves of bounded vocabulary. For one wave, a pass over the texts keeps of each document its length and its counts
of the wave's terms; documents are dealt to shards of bounded size by these counts; each shard blocks its lists, when a query first
opens them, and answers all queries of the wave with k rows each, which Spark ranks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Chunk, chunks, column, mix, raw, release
from .graph import ensure_checkpoint_dir

#: Bytes of terms: ASCII digits and letters, and all bytes of other characters.
_IN_TERM = np.ones(256, dtype=bool)
_IN_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class LexicalParams:
    k: int = 10
    #: Terms, with repeats, and queries of one wave; a query alone may have more terms.
    wave_terms: int = 1 << 19
    wave_queries: int = 4096
    #: Counts (of a document and a term) in one shard, on average.
    shard_counts: int = 1 << 20
    block_docs: int = 48
    #: Most blocks of one list, and numbers of a document's sketch, by which a list is clustered.
    most_blocks: int = 192
    sketch: int = 16
    #: Cells of summaries that a shard keeps; lists beyond are blocked again when a query opens them.
    kept_cells: int = 1 << 23


def terms_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk of lower-cased texts and (start, end, row) of its terms."""
    c = Chunk(data, offsets, lo, hi)
    c.data = _LOWER[c.data]
    inside = _IN_TERM[c.data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = c.at[1:-1]
    before[edge[edge < len(inside)]] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return c, start, end, c.row_of(start)


@dataclass
class Vocabulary:
    """Terms sorted by hash, with their bytes: a word is taken for a term only if its bytes are equal."""

    terms: list[str]
    hashes: np.ndarray = field(init=False)
    data: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)

    def __post_init__(self):
        data, at = raw(pa.array(self.terms, pa.large_string()))
        hashes = Chunk(data, at, 0, len(self.terms)).hashes(at[:-1], at[1:])
        order = np.argsort(hashes, kind="stable")
        self.terms = [self.terms[k] for k in order]
        self.hashes = hashes[order]
        self.data, self.at = raw(pa.array(self.terms, pa.large_string()))

    def find(self, c: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's number in ``terms``, or -1. Terms with one hash are tried in turn."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.terms):
            return out
        h = c.hashes(start, end)
        k = np.searchsorted(self.hashes, h)
        open_ = np.flatnonzero((k < len(self.hashes)) & (self.hashes[np.minimum(k, len(self.hashes) - 1)] == h))
        while len(open_):
            term = k[open_]
            size = end[open_] - start[open_]
            good = size == self.at[term + 1] - self.at[term]
            same, term_at, word_at, size = open_[good], self.at[term[good]], start[open_[good]], size[good]
            row = np.repeat(np.arange(len(same)), size)
            step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            differ = np.bincount(row, self.data[term_at[row] + step] != c.data[word_at[row] + step], len(same)) > 0
            out[same[~differ]] = k[same[~differ]]
            k[open_] += 1
            open_ = open_[(out[open_] < 0) & (k[open_] < len(self.hashes))]
            open_ = open_[self.hashes[k[open_]] == h[open_]]
        return out


def query_terms(text: str | None) -> list[str]:
    data, at = raw(pa.array([text or ""], pa.large_string()))
    c, start, end, _ = terms_of(data, at, 0, 1)
    body = c.data.tobytes()
    return [body[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]


def counted(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, numbers, counts): all terms of each document, and how often it has each of ``terms`` that it has."""
    words = Vocabulary(terms)
    many = max(1, len(words.terms))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = raw(column(batch, text_col))
            for lo, hi in chunks(at):
                c, start, end, row = terms_of(data, at, lo, hi)
                number = words.find(c, start, end)
                known = number >= 0
                key, tf = np.unique(row[known] * many + number[known], return_counts=True)
                held = np.bincount(key // many, minlength=c.rows)
                lists = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, id_col)[lo:hi].cast(pa.int64()), pa.array(np.bincount(row, minlength=c.rows), pa.int64()), pa.ListArray.from_arrays(pa.array(lists), pa.array(key % many, pa.int32())), pa.ListArray.from_arrays(pa.array(lists), pa.array(tf, pa.int32()))],
                    ["doc_id", "n", "numbers", "counts"],
                )
        release()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "doc_id long, n long, numbers array<int>, counts array<int>")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of many runs, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Shard:
    """Documents of one shard as sparse rows, and their posting lists, blocked when first opened.

    Terms are numbered from the rarest on. Documents are numbered by id, null last.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, x: np.ndarray, docs: int, terms: int, p: LexicalParams):
        by_row = np.lexsort((term, doc))
        self.p, self.docs = p, docs
        self.term, self.x = term[by_row].astype(np.int32), x[by_row].astype(np.int32)  # x is below 1,000,000
        self.at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])
        owner = doc[by_row].astype(np.int32)
        by_list = np.argsort(self.term, kind="stable")
        self.list_docs = owner[by_list]
        self.list_at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])
        self.most = np.zeros(terms, np.int64)
        np.maximum.at(self.most, self.term, self.x)
        way = mix(np.arange(terms * p.sketch, dtype=np.uint64) + np.uint64(1)).reshape(terms, p.sketch).astype(np.float32) / np.float32(2**63) - 1
        self.sketches = np.zeros((docs, p.sketch), np.float32)
        for k in range(p.sketch):
            self.sketches[:, k] = np.bincount(owner, self.x * way[self.term, k], docs)
        self.sketches /= np.maximum(np.sqrt((self.sketches**2).sum(axis=1, keepdims=True)), 1e-9)
        self._blocked: dict[int, tuple] = {}
        self._cells = 0
        #: Documents scored, blocks met and blocks skipped so far.
        self.scored = self.met = self.skipped = 0

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents by block, first of each block, terms of the summary, block of each, maximum): the summary has t and commoner terms only."""
        made = self._blocked.pop(t, None)
        if made is None:
            made = self._block(t)
            self._cells += len(made[2])
            while self._cells > self.p.kept_cells and self._blocked:
                self._cells -= len(self._blocked.pop(next(iter(self._blocked)))[2])
        self._blocked[t] = made  # the list opened last goes last
        return made

    def _block(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        docs = self.list_docs[self.list_at[t] : self.list_at[t + 1]]
        many = min(self.p.most_blocks, -(-len(docs) // self.p.block_docs))
        first = np.zeros(1, np.int64)
        if many > 1:
            seeds = docs[np.unique(np.linspace(0, len(docs) - 1, many).astype(np.int64))]
            near = np.concatenate([np.argmax(self.sketches[docs[k : k + 4096]] @ self.sketches[seeds].T, axis=1) for k in range(0, len(docs), 4096)])
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
            # copies of one document fill one cluster; it is cut, so that a block stays small
            most = 4 * self.p.block_docs
            first = np.unique(np.concatenate([first, *(np.arange(a, b, most) for a, b in zip(first, np.append(first[1:], len(docs))) if b - a > most)]))
        many = len(first)
        block = np.repeat(np.arange(many), np.diff(np.append(first, len(docs))))
        sizes = self.at[docs + 1] - self.at[docs]
        at = _ragged(self.at[docs], sizes)
        block = np.repeat(block, sizes)
        later = self.term[at] >= t
        at, block = at[later], block[later]
        key = (self.term[at] - t).astype(np.int64) * many + block
        span = int(key.max()) + 1
        if span <= 1 << 22:
            dense = np.zeros(span, np.int32)
            np.maximum.at(dense, key, self.x[at])
            cells = np.flatnonzero(dense)
            values = dense[cells]
        else:
            order = np.argsort(key, kind="stable")
            cells, begin = np.unique(key[order], return_index=True)
            values = np.maximum.reduceat(self.x[at][order], begin)
        return docs, first, (cells // many + t).astype(np.int32), (cells % many).astype(np.int32), values

    def score(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Whole scores of documents, of which each has a term at least."""
        sizes = self.at[docs + 1] - self.at[docs]
        at = _ragged(self.at[docs], sizes)
        self.scored += len(docs)
        return np.add.reduceat(dense[self.term[at]] * self.x[at], np.cumsum(sizes) - sizes)

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best: larger scores, then smaller documents, scores above 0 only. ``terms`` rise; ``dense`` has their
        weights by term, ``seen`` is false for all documents, before and after."""
        k = self.p.k
        gains = weights * self.most[terms]
        rest = np.cumsum(gains[::-1])[::-1]
        best, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        touched = []
        for i, t in enumerate(terms.tolist()):
            if rest[i] < least:
                break
            if self.list_at[t] == self.list_at[t + 1]:
                continue
            docs, first, s_term, s_block, s_max = self.blocks(t)
            bound = np.zeros(len(first), np.int64)
            lo, hi = np.searchsorted(s_term, terms[i:]), np.searchsorted(s_term, terms[i:], side="right")
            at = _ragged(lo, hi - lo)
            np.add.at(bound, s_block[at], s_max[at].astype(np.int64) * np.repeat(weights[i:], hi - lo))
            order = np.argsort(-bound, kind="stable")
            self.met += len(order)
            ends = np.append(first[1:], len(docs))
            done, step = 0, 1
            while done < len(order):
                take = order[done : done + step]
                take = take[bound[take] >= least]
                if not len(take):
                    break
                members = docs[_ragged(first[take], ends[take] - first[take])]
                members = members[~seen[members]]
                if len(members):
                    seen[members] = True
                    touched.append(members)
                    own = self.score(members, dense)
                    good = own >= least
                    best, scores = np.concatenate([best, members[good]]), np.concatenate([scores, own[good]])
                    top = np.lexsort((best, -scores))[:k]
                    best, scores = best[top], scores[top]
                    if len(best) == k:
                        least = max(1, int(scores[-1]))
                done += step
                step *= 2
            self.skipped += len(order) - min(done, len(order))
        for members in touched:
            seen[members] = False
        return best, scores


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _wave(docs: DataFrame, queries: list[tuple], p: LexicalParams, id_col: str, text_col: str) -> DataFrame:
    """The k best of each shard for each query (item_id, number of the query, terms with their counts)."""
    forward = counted(docs, sorted({t for *_, terms in queries for t in terms}), id_col, text_col).checkpoint()
    names = Vocabulary(sorted({t for *_, terms in queries for t in terms})).terms
    number = {t: k for k, t in enumerate(names)}
    n_docs, n_terms, held = (int(x or 0) for x in forward.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("numbers"))).first())
    if not held:
        return docs.sparkSession.createDataFrame([], "query long, item_id long, doc_id long, score long")
    many = len(names)

    def frequency(batches):
        total = np.zeros(many, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("numbers")), minlength=many)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["number", "df"])

    df = np.zeros(many, np.int64)
    for row in forward.select("numbers").mapInArrow(frequency, "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row.number] = row.df  # at most one row for each term of the wave
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
    rarest = np.lexsort((np.arange(many), -weight))
    place = np.empty(many, np.int64)
    place[rarest] = np.arange(many)
    asked = []
    for q, item, terms in queries:
        own = sorted((int(place[number[t]]), n * int(weight[number[t]])) for t, n in terms.items() if df[number[t]] and weight[number[t]] > 0)
        asked.append((q, item, np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    shards = max(1, -(-held // p.shard_counts))
    schema = pa.schema([("query", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def answer(table: pa.Table) -> pa.Table:
        ids = column(table, "doc_id")
        order = np.array(pc.sort_indices(ids, null_placement="at_end"))
        table = table.take(pa.array(order))
        ids, n = column(table, "doc_id"), column(table, "n").to_numpy()
        numbers, counts = column(table, "numbers"), _flat(column(table, "counts")).astype(np.int64)
        row = np.repeat(np.arange(len(table)), numbers.value_lengths().to_numpy(zero_copy_only=False))
        wide = 75 * int(n.max()) * n_docs >= 2**63
        m = 25 + (np.array([75 * int(v) * n_docs // n_terms for v in n], np.int64) if wide else (75 * n * n_docs) // n_terms)
        x = (1_000_000_000 * counts) // (1000 * counts + 8 * m[row])
        shard = Shard(row, place[_flat(numbers)], x, len(table), many, p)
        dense, seen = np.zeros(many, np.int64), np.zeros(len(table), bool)
        found = []
        for q, item, terms, weights in asked:
            dense[terms] = weights
            best, scores = shard.search(terms, weights, dense, seen)
            dense[terms] = 0
            found.append((np.full(len(best), q), [item] * len(best), best, scores))
        best = np.concatenate([f[2] for f in found])
        items = pa.array([i for f in found for i in f[1]], pa.int64())
        out = pa.table([pa.array(np.concatenate([f[0] for f in found])), items, ids.take(pa.array(best)), pa.array(np.concatenate([f[3] for f in found]))], schema=schema)
        release()
        return out

    dealt = forward.where(F.size("numbers") > 0).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "numbers", "counts"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(answer, "query long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, p: LexicalParams = LexicalParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items``, the k documents of highest score above 0, equal scores by ascending id.

    Null text has no terms; documents with a null id rank behind all of equal score, rows that repeat an id are each a document, and rows
    that repeat an item's id are each a query. Items without a term that some document has give no rows, as do empty tables. Other
    columns are ignored. A long text is one chunk of the counting pass: memory is some 60 times its bytes.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).withColumn("query", F.monotonically_increasing_id()).checkpoint()
    size = F.octet_length(F.coalesce("text", F.lit("")))
    many, terms = asked.agg(F.count(F.lit(1)), F.sum(size / 2 + 1)).first()
    waves = max(1, -(-many // p.wave_queries), math.ceil((terms or 0) / p.wave_terms))
    found = []
    for wave in range(waves):
        queries = [(r.query, r.item, Counter(query_terms(r.text))) for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(waves)) == wave).orderBy("query").toLocalIterator()]
        part = _wave(docs, queries, p, id_col, text_col)
        found.append(part.checkpoint() if waves > 1 else part)
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", rank).where(F.col("rank") <= p.k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL for the rows of the query.
ORACLE_SQL = r"""
WITH a AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
c AS (SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS docs, sum(len(terms))::BIGINT AS words FROM a),
t AS (SELECT doc, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM a),
f AS (SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, docs),
x AS (SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS part FROM f JOIN w USING (term), c),
s AS (SELECT item_id, doc, doc_id, sum(part)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY item_id, doc, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
