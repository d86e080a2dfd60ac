"""Null and repeated ids, repeated rows, very long texts and clashing columns in the operators that take documents; scores recomputed plainly."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessella.llm import bpe, langid, packing, quality, secrets, simhash
from tessella.llm.arrowtext import mix

R = random.Random(21)
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()
LONG = " ".join(R.choices(WORDS, k=250_000)) + " password=hunter2hunter2 ü"
TEXTS = [LONG, None, "", "one two three", "one two three", " ".join(R.choices(WORDS, k=80)), "deadbeef" * 4 + "中文"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "x", 1, True) for i, t in zip((None, None, 5, 5, 5, 2**60 + 1, 2**60), TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, score string, n_words int, kept boolean").repartition(3)


def test_quality_scores(spark, table):
    labels = spark.createDataFrame([(5, 1), (2**60, 1), (None, 1), (7, 1)], "doc_id long, quality int")
    p = quality.QualityParams()
    rows = [(r.doc_id, r.text or "") for r in table.collect()]

    def grams(text: str) -> Counter:
        b = text.encode()
        codes = np.zeros(max(0, len(b) - 3), np.uint64)
        for k in range(4):
            codes = codes * np.uint64(257) + np.frombuffer(b, np.uint8)[k : k + len(codes)]
        return Counter((mix(codes) % np.uint64(p.buckets)).tolist())

    corpus, target = Counter(), Counter()
    for i, t in rows:
        g = grams(t)
        corpus.update(g)
        if i in (5, 2**60):  # not 2**60 + 1, which is the same double
            target.update(g)
    ratio = {k: math.log((target[k] + 0.5) / (target.total() + 0.5 * p.buckets)) - math.log((corpus[k] + 0.5) / (corpus.total() + 0.5 * p.buckets)) for k in corpus}
    want = sorted((str(i), round(sum(ratio[k] * n for k, n in grams(t).items()) / max(1, grams(t).total()), 9)) for i, t in rows)
    got = quality.score_quality(table, labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want
    long = next(r for r in got if r.n_words > 1000)
    assert (long.n_words, long.word_chars) == (250_002, sum(map(len, LONG.split()))) and long.doc_id is None


def test_secrets_and_further_rules(spark, table):
    found = {"private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a1B2" * 9, "slack": "xoxb-" + "1234567890-ab", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "google": "AIza" + "Sy_x-" * 7}
    rows = [(k, f"before é {text} after", kind) for k, (kind, text) in enumerate(found.items())]
    docs = spark.createDataFrame(rows + [(99, "ghp_short eyJ.eyJ. AIza -----BEGIN KEY-----", "none")], "doc_id long, text string, kind string")
    for r in secrets.scan(docs).collect():
        own = [s for s in r.spans if s.kind in found]
        want = [] if r.doc_id == 99 else [(rows[r.doc_id][2], 9, 9 + len(found[rows[r.doc_id][2]]))]
        assert [(s.kind, s.start, s.end) for s in own] == want
    got = sorted((str(r.doc_id), r.n_assign, r.n_hex) for r in secrets.digests(table).collect())
    assert got == sorted([("None", 1, 0), ("None", 0, 0), ("5", 0, 0), ("5", 0, 0), ("5", 0, 0), ("5", 0, 0), (str(2**60 + 1), 0, 0), (str(2**60), 0, 1)])
    odd = (secrets.Rule("odd", "straße [a-z]+ 中文abc"),)
    street = spark.createDataFrame([(1, "die straße hier 中文abc"), (2, "strasse")], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in secrets.scan(street, odd).collect()} == {1: 1, 2: 0}
    cleaned = [r.text for r in secrets.redact(table).collect() if r.text and len(r.text) > 1000]
    assert cleaned == [LONG.replace("hunter2hunter2", "[SECRET]")]


def test_fingerprints_and_components(table):
    def plain(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, plain(r.text)) for r in table.collect()]
    near = lambda a, b: (a ^ b).bit_count() <= 2
    want = sorted((str(i), f"{f:016x}", str(min((j for j, g in rows if near(f, g) and j is not None), default=None))) for i, f in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(table).collect()) == want


def test_encoding_and_packing(table):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in table.collect()]
    want = sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.token_digests(table, "word_bpe_49k.json").collect()) == want
    pieces = packing.pack(table, "word_bpe_49k.json").collect()
    told = Counter()
    for r in pieces:
        told[str(r.doc_id)] += r.length
    every = Counter()
    for i, x in ids:
        every[i] += len(x) + 1
    assert told == every
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in places.values():
        rows.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and rows[0][0] == 0 and sum(n for _, n in rows) <= 4096


def test_centroids_recomputed(spark):
    stock = {"aa": "katu mira solen dova pelu".split(), "bb": "grosz tchwik przad szklo wprad".split()}
    rows = [(k if k % 4 else None, " ".join(R.choices(stock[lang], k=30)), lang) for k in range(120) for lang in [("aa", "bb")[k % 2]]]
    rows += [(500, " ".join(R.choices(stock["aa"], k=200_000)), "aa"), (501, None, "aa"), (502, "katu", None), (503, "12 34", "bb"), (5, rows[5][1], rows[5][2])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(table.where("NOT held_out"))
    p, train = model.params, [r for r in table.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL").collect()]

    def counts(text: str) -> np.ndarray:
        b = np.frombuffer(text.lower().encode(), np.uint8).copy()
        b[[x < 128 and not chr(x).isalpha() for x in b]] = 32
        code = np.zeros(max(0, len(b) - 2), np.uint64)
        for k in range(3):
            code = code * np.uint64(257) + b[k : k + len(code)]
        use = ~((b[: len(code)] == 32) & (b[1 : len(code) + 1] == 32))
        return np.bincount((mix(code[use]) % np.uint64(p.buckets)).astype(int), minlength=p.buckets)

    df = sum((counts(r.text) > 0).astype(int) for r in train)
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    assert np.allclose(model.idf, idf, rtol=1e-5) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    for r in langid.classify(table, model, keep=["text", "held_out"]).collect():
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        x = np.log1p(counts(r.text)) * idf
        cosine = model.centroids @ (x / np.linalg.norm(x))
        best = int(np.argmax(cosine))
        assert r.lang_pred == model.langs[model.lang_of[best]] and abs(r.score - cosine[best]) < 1e-4
        assert r.lang_pred == ("aa" if r.text.split()[0] in stock["aa"] else "bb") and isinstance(r.held_out, bool)


def test_limit_counts_every_labelled_row(spark):
    """Before, 20,000 rows of either kind were taken at most."""
    import numpy as np
    from pyspark.sql import functions as F
    from tessella.llm import lm_score

    n = 60_000
    scored = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("n_tokens"), (F.pmod(F.col("id") * 7919, F.lit(10007)) / 500.0 - F.when(F.col("id") % 2 == 0, 3.0).otherwise(0.0)).alias("score"), (F.col("id") % 2 == 0).alias("in_target"))
    bad = spark.range(n).where("id % 2 = 1 AND id % 3 > 0").withColumnRenamed("id", "doc_id")
    rows = np.array(sorted({(round(r.score, 9), r.in_target, r.doc_id) for r in scored.collect() if r.in_target or r.doc_id % 3}))
    at = np.unique(rows[:, 0])
    good, rest = np.sort(rows[rows[:, 1] == 1, 0]), np.sort(rows[rows[:, 1] == 0, 0])
    gain = np.searchsorted(good, at, "right").astype(int) * len(rest) - np.searchsorted(rest, at, "right").astype(int) * len(good)
    assert len(good) > 20_000 and lm_score._limit(scored, bad, "doc_id") == at[int(np.argmax(gain))]
