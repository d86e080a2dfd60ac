"""Quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over the same hash buckets of byte n-grams are counted: one over the trusted target rows, one over
the whole raw corpus. A text's score is the mean, over its n-grams, of the logarithm of the ratio of their smoothed
probabilities, and a fixed threshold decides on every text.

Counting is one pass that keeps a vector of ``buckets`` counts for each task; the vectors are summed by Spark and only the
sum (a size fixed by the parameter) reaches the driver. Scoring is a second pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Chunk, chunks, column, mix, raw

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_ROW = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class QualityParams:
    """``trusted_rows`` bounds the labelled rows whose texts define the target (those first by hash of their id)."""

    ngram: int = 4
    buckets: int = 1 << 16
    smoothing: float = 0.5
    threshold: float = -0.3
    trusted_rows: int = 20_000
    min_words: int = 50
    max_repeat_percent: int = 50


def base_features(c: Chunk) -> dict[str, np.ndarray]:
    """The five counts of the base rules for each row of a chunk. Texts are compared by 64-bit hashes."""
    start, end, row = c.words()
    n_words = np.bincount(row, minlength=c.rows)
    first_byte = (c.data & 0xC0) != 0x80
    inside = np.zeros(len(c.data) + 1, dtype=np.int8)
    inside[start] += 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(c.data) else inside[:0].astype(bool)
    # where a row ends right before a word of the next one, +1 and -1 cancel and the run goes on: still inside
    word = c.hashes(start, end)
    ls, le, lrow = c.lines()
    held = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, lrow = ls[held], le[held], lrow[held]
    keys = mix(c.hashes(ls, le) + lrow.astype(np.uint64) * _ROW)
    _, one = np.unique(keys, return_index=True)
    n_dup_lines = np.bincount(lrow, minlength=c.rows) - np.bincount(lrow[one], minlength=c.rows)
    covered = np.zeros(len(word), dtype=bool)
    if len(word) > 2:
        at = np.flatnonzero(row[2:] == row[:-2])
        key = mix(word[at] + mix(word[at + 1] + mix(word[at + 2] + row[at].astype(np.uint64) * _ROW)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            covered[at[again] + k] = True
    return {
        "n_words": n_words,
        "word_chars": c.per_row(first_byte & inside),
        "n_symbols": c.per_row(SYMBOLS[c.data]),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": np.bincount(row[covered], minlength=c.rows),
    }


def ngram_buckets(c: Chunk, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of bytes that lies within one row."""
    n = len(c.data) - p.ngram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(p.ngram):
        code = code * np.uint64(257) + c.data[k : k + n]
    row = np.repeat(np.arange(c.rows), np.diff(c.at))
    within = row[:n] == row[p.ngram - 1 :]
    return (mix(code[within]) % np.uint64(p.buckets)).astype(np.int64), row[:n][within]


def _chunks_of(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, Chunk, slice]]:
    for batch in batches:
        data, at = raw(column(batch, text_col))
        for lo, hi in chunks(at):
            yield batch, Chunk(data, at, lo, hi), slice(lo, hi)


def trusted_ids(labels: DataFrame, p: QualityParams, id_col: str = "doc_id", label_col: str = "quality") -> np.ndarray:
    """At most ``trusted_rows`` ids labelled 1, the first by hash."""
    rows = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    return np.array(sorted(r[0] for r in rows.orderBy(F.xxhash64(id_col), id_col).limit(p.trusted_rows).collect()), dtype=np.int64)


def fit_ratio(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """The log ratio of each bucket, or None where the target or the corpus is empty."""
    trusted = pa.array(trusted_ids(labels, p, id_col), pa.int64())

    def count(batches):
        total = np.zeros((2, p.buckets), dtype=np.int64)
        for batch, c, rows in _chunks_of(batches, text_col):
            bucket, row = ngram_buckets(c, p)
            ids = column(batch, id_col)[rows].cast(pa.int64())
            chosen = pc.is_in(ids, value_set=trusted).to_numpy(zero_copy_only=False)  # a null id is never among them
            total[0] += np.bincount(bucket, minlength=p.buckets)
            total[1] += np.bincount(bucket[chosen[row]], minlength=p.buckets)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[0][seen]), pa.array(total[1][seen])], ["bucket", "corpus", "target"])

    counts = (
        docs.select(id_col, text_col)
        .mapInArrow(count, "bucket long, corpus long, target long")
        .groupBy("bucket")
        .agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target"))
        .toPandas()
    )
    corpus, target = np.zeros(p.buckets), np.zeros(p.buckets)
    corpus[counts["bucket"]], target[counts["bucket"]] = counts["corpus"], counts["target"]
    if not corpus.sum() or not target.sum():
        return None
    a = p.smoothing
    return np.log((target + a) / (target.sum() + a * p.buckets)) - np.log((corpus + a) / (corpus.sum() + a * p.buckets))


def score_quality(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base counts, base_failed, the length-normalised score and the verdict.

    Null text counts as empty. A text too short for one n-gram has score 0. Without trusted rows every score is 0, so
    that only the base rules decide. Repeated rows give repeated results, null ids are never trusted, other columns of ``docs`` are ignored.
    A very long text is one chunk: memory is some 60 times its bytes.
    """
    ratio = fit_ratio(docs, labels, p, id_col, text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches):
        for batch, c, rows in _chunks_of(batches, text_col):
            f = base_features(c)
            mean = np.zeros(c.rows)
            if ratio is not None:
                bucket, row = ngram_buckets(c, p)
                mean = np.bincount(row, ratio[bucket], c.rows) / np.maximum(np.bincount(row, minlength=c.rows), 1)
            failed = (f["n_words"] < p.min_words) | (100 * f["n_repeat_words"] > p.max_repeat_percent * f["n_words"])
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col)[rows].cast(pa.int64()), *(pa.array(f[n], pa.int64()) for n in names), pa.array(failed), pa.array(~failed & (mean >= p.threshold)), pa.array(mean)],
                [id_col, *names, "base_failed", "kept", "score"],
            )

    schema = f"{id_col} long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, score double"
    return docs.select(id_col, text_col).mapInArrow(score, schema)


#: DuckDB SQL for the base counts.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT k, unnest(list_transform(range(1, len(words) - 1), lambda i: {'p': i, 'w': [words[i], words[i + 1], words[i + 2]]})) AS x FROM d WHERE len(words) > 2),
m AS (SELECT k, x.p AS p FROM w QUALIFY count(*) OVER (PARTITION BY k, x.w) > 1),
r AS (SELECT k, count(DISTINCT p + o.o) AS n FROM m, (SELECT unnest(range(3)) AS o) o GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
       len(words) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(words) AS base_failed
FROM d JOIN l USING (k) LEFT JOIN r USING (k)
"""
