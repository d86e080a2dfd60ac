"""Stages that keep all columns, on a table whose extra columns have the names that the operators use themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, near_copies, secrets, suffix_dedup

NAMES = "best_id best_row component again id row text_hash sid node head n_rows _block _order _range shard code marks contents score rejected lang_pred size name hash block band u v in0 in1 in9 spans".split()
R = random.Random(2)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma".split()


@pytest.fixture(scope="module")
def plain(spark):
    passage = " ".join(R.choices(WORDS, k=80))
    base = " ".join(R.choices(WORDS, k=120))
    texts = [base, base, base + " end", passage + " one", "two " + passage, "", None, None, "short", "password = hunter2hunter2"]
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def clashing(plain):
    out = plain
    for k, name in enumerate(NAMES):
        out = out.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")) if k % 2 else F.col("doc_id") + k)
    return out


def same(got, want, columns):
    """The stage gives the rows that it gives without the extra columns, and these as they came."""
    own = plain_columns = want.columns
    assert got.columns == columns
    key = lambda rows: sorted(map(repr, rows))
    assert key(map(tuple, got.select(*own).collect())) == key(map(tuple, want.select(*plain_columns).collect()))
    for r in got.collect():
        assert all(r[n] == (f"{n}-{r.doc_id}" if k % 2 else r.doc_id + k) for k, n in enumerate(NAMES))


@pytest.mark.parametrize("stage", [near_copies.one_of_each, suffix_dedup.cut_repeats, secrets.redact])
def test_stages_keep_columns_of_any_name(plain, clashing, stage):
    same(stage(clashing), stage(plain), clashing.columns)


def test_language_keeps_columns_of_any_name(spark, clashing):
    train = spark.createDataFrame([(k, f"{w} {x} {w}{x}", lang) for lang, words in (("en", WORDS), ("xx", [w[::-1] for w in WORDS])) for k, (w, x) in enumerate(zip(words, words[1:]))], "doc_id long, text string, lang string")
    model = langid.fit(train)
    got = langid.classify(clashing, model, keep=["score", "rejected", "component"])
    assert got.columns == ["doc_id", "score_kept", "rejected_kept", "component", "lang_pred", "score", "rejected"] and got.count() == 10
    assert {r.score_kept for r in got.collect()} == {r.score for r in clashing.collect()}
    assert langid.accepted(clashing, model).columns == clashing.columns
