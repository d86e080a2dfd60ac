"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams (letters lower-cased, everything else a space). Each language
has a few centroids, clustered from its training texts; a text takes the language of the most similar centroid by cosine and is rejected
where even that one is too far.

Cosines grow with length, so how far is too far depends on language and length: the limit is a share of a low quantile of the
cosines that all training rows of that length class have to their own language. Length classes double in n-grams; a class with few
rows takes its neighbours' in. Texts under ``LangParams.short_ngrams`` are too short to tell by distance and are not rejected for it.

Document frequencies are counted over all training rows. Clustering uses a bounded sample for each language, chosen by
hash of id and text; the bound is ``LangParams.sample_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Chunk, chunks, column, mix, raw, release

UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    ngram: int = 3
    buckets: int = 1 << 13
    clusters: int = 3
    rounds: int = 8
    #: Training texts for each language that are clustered, about.
    sample_rows: int = 1500
    #: Texts whose best cosine is under this share of this quantile of its language and length class are rejected.
    limit_share: float = 0.7
    limit_quantile: float = 0.01
    #: Rows that a quantile is taken of, at least, where there are as many.
    limit_rows: int = 50
    #: Shorter texts are not rejected for their distance.
    short_ngrams: int = 31


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    #: The language of each centroid, as a position in ``langs``.
    lang_of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    params: LangParams
    #: The least cosine by language and length class.
    limits: np.ndarray


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4. A row without an id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def _counts(texts: pa.Array, p: LangParams) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of n-gram counts) for runs of rows."""
    lower = pc.utf8_lower(texts)
    data, at = raw(lower)
    for a, b in chunks(at):
        for lo in range(a, b, 128):
            hi = min(b, lo + 128)
            c = Chunk(data, at, lo, hi)
            text = _LETTER[c.data]
            n = len(text) - p.ngram + 1
            out = np.zeros(c.rows * p.buckets, dtype=np.float32)
            if n > 0:
                code = np.zeros(n, dtype=np.uint64)
                for k in range(p.ngram):
                    code = code * np.uint64(257) + text[k : k + n]
                row = np.repeat(np.arange(c.rows), np.diff(c.at))
                blank = (text[:n] == 0x20) & (text[1 : n + 1] == 0x20)
                use = (row[:n] == row[p.ngram - 1 :]) & ~blank
                out = np.bincount(row[:n][use] * p.buckets + (mix(code[use]) % np.uint64(p.buckets)).astype(np.int64), minlength=c.rows * p.buckets).astype(np.float32)
            yield lo, out.reshape(c.rows, p.buckets)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _cluster(x: np.ndarray, p: LangParams) -> np.ndarray:
    """Unit centroids by spherical k-means; it starts from the text most like the mean and texts far from those chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(p.clusters, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen]
    for _ in range(p.rounds):
        own = np.argmax(x @ centre.T, axis=1)
        for k in range(len(centre)):
            if (own == k).any():
                mean = x[own == k].mean(axis=0)
                centre[k] = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
    return centre


_CLASSES, _BINS = 32, 1000


def _length_class(ngrams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(ngrams + 1).astype(np.int64), _CLASSES - 1)


def limits_of(rows: np.ndarray, p: LangParams) -> np.ndarray:
    """The limits by language and length class, from counts of rows by language, length class and cosine in thousandths."""
    out = np.zeros(rows.shape[:2])
    for lang in range(len(rows)):
        for c in range(_CLASSES):
            d = next((d for d in range(_CLASSES) if rows[lang, max(0, c - d) : c + d + 1].sum() >= p.limit_rows), _CLASSES)
            below = np.cumsum(rows[lang, max(0, c - d) : c + d + 1].sum(axis=0))
            out[lang, c] = p.limit_share * np.searchsorted(below, p.limit_quantile * below[-1], side="right") / _BINS if below[-1] else 0
    return out


def fit(train: DataFrame, p: LangParams = LangParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Centroids from the rows with text and language. Without any, the model has no language and ``classify`` rejects all."""
    train = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    rows = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}
    langs = sorted(rows)

    def frequencies(batches):
        df, n = np.zeros(p.buckets, dtype=np.int64), 0
        for batch in batches:
            for _, counts in _counts(column(batch, text_col), p):
                df += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.buckets), pa.int64()), pa.array(df)], ["bucket", "df"])

    found = train.select(text_col).mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(p.buckets)
    df[found["bucket"]] = found["df"]
    idf = (np.log((1 + sum(rows.values())) / (1 + df)) + 1).astype(np.float32)
    if not langs:
        return LangModel([], np.zeros(0, np.int64), np.zeros((0, p.buckets), np.float32), idf, p, np.zeros((0, _CLASSES)))

    def centroids(table: pa.Table) -> pa.Table:
        table = table.sort_by([(id_col, "ascending"), (text_col, "ascending")])
        x = np.concatenate([_vectors(m, idf) for _, m in _counts(column(table, text_col), p)])
        x = x[(x != 0).any(axis=1)]  # texts without a letter point nowhere
        out = _cluster(x, p).astype(np.float32) if len(x) else x
        return pa.table({"lang": pa.array([table.column(lang_col)[0].as_py()] * len(out), pa.string()), "k": pa.array(range(len(out)), pa.int64()), "centroid": pa.array([c.tobytes() for c in out], pa.binary())})

    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int((1 << 30) * min(1.0, p.sample_rows / rows[lang])))])
    sample = train.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < share[F.col(lang_col)])
    parts = sorted(sample.groupBy(lang_col).applyInArrow(centroids, "lang string, k long, centroid binary").collect())
    lang_of = np.array([langs.index(r[0]) for r in parts], dtype=np.int64)
    centre = np.array([np.frombuffer(r[2], np.float32) for r in parts], dtype=np.float32).reshape(len(parts), p.buckets)

    def own_cosines(batches):
        rows = np.zeros(len(langs) * _CLASSES * _BINS, dtype=np.int64)
        for batch in batches:
            own = np.array([langs.index(x) for x in column(batch, lang_col).to_pylist()], dtype=np.int64)
            for lo, counts in _counts(column(batch, text_col), p):
                lang = own[lo : lo + len(counts)]
                cosine = np.where(lang_of == lang[:, None], _vectors(counts, idf) @ centre.T, 0).max(axis=1, initial=0)
                at = (lang * _CLASSES + _length_class(counts.sum(axis=1))) * _BINS + np.minimum((cosine * _BINS).astype(np.int64), _BINS - 1)
                rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some])], ["at", "n"])

    seen = train.select(text_col, lang_col).mapInArrow(own_cosines, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    rows = np.zeros(len(langs) * _CLASSES * _BINS, dtype=np.int64)
    rows[seen["at"]] = seen["n"]
    return LangModel(langs, lang_of, centre, idf, p, limits_of(rows.reshape(len(langs), _CLASSES, _BINS), p))


def _judge(texts: pa.Array, model: LangModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the language or -1, best cosine, whether rejected) of each text."""
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    pred, score, far = np.full(len(texts), -1, dtype=np.int64), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    if len(model.lang_of):
        for lo, counts in _counts(texts, model.params):
            cosine = _vectors(counts, model.idf) @ model.centroids.T
            best = np.argmax(cosine, axis=1)
            ngrams = counts.sum(axis=1)
            here = slice(lo, lo + len(best))
            pred[here] = model.lang_of[best]
            score[here] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
            far[here] = (ngrams >= model.params.short_ngrams) & (score[here] < model.limits[pred[here], _length_class(ngrams)])
    pred[~letters], score[~letters] = -1, 0
    return pred, score, far | (pred < 0)


def classify(docs: DataFrame, model: LangModel, keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The id and ``keep`` columns with lang_pred, score (the best cosine) and rejected, for each row.

    Null texts and texts without a letter are ``und`` with score 0, and rejected. Ties go to the language first in order. A kept column named like a
    result is called ``<name>_kept``.
    """
    keep = list(dict.fromkeys([id_col, *(keep or [])]))
    called = [f"{k}_kept" if k in ("lang_pred", "score", "rejected") else k for k in keep]

    def run(batches):
        for batch in batches:
            pred, score, rejected = _judge(column(batch, text_col), model)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array([UNKNOWN if k < 0 else model.langs[k] for k in pred.tolist()], pa.string()), pa.array(score), pa.array(rejected)],
                [*called, "lang_pred", "score", "rejected"],
            )

    types = "".join(f"`{c}` {docs.schema[k].dataType.simpleString()}, " for c, k in zip(called, keep))
    return docs.select(*dict.fromkeys([text_col, *keep])).mapInArrow(run, f"{types}lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``classify`` does not reject."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_judge(column(batch, text_col), model)[2]))
        release()

    return docs.mapInArrow(run, docs.schema)
