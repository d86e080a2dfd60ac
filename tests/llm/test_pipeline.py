"""Stages of the corpus pipeline against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import langid, near_copies, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts: list) -> list[int]:
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(texts))]


def near_texts() -> list:
    r = random.Random(11)
    stock = [f"w{k}" for k in range(3000)]
    text = lambda n: r.choices(stock, k=n)
    out = [None, "", "one", "ONE", "a few words", "A few  words"]
    for n in (40, 80, 200, 900):
        for _ in range(6):
            base = text(n)
            out.append(" ".join(base))
            for share in (0.01, 0.02, 0.03, 0.1):
                copy = list(base)
                for k in r.sample(range(n), max(1, int(n * share))):
                    copy[k] = r.choice(stock)
                out.append(" ".join(copy))
    base = text(60)  # a large group that only chains connect
    out += [" ".join(base[:k] + [r.choice(stock)] + base[k + 1 :]) for k in range(60) for _ in range(3)]
    line = text(12)  # one line in many texts
    out += [" ".join(line + text(25)) for _ in range(60)]
    loose = text(200)  # a group around the limit: some are linked, some are not
    for _ in range(50):
        copy = list(loose)
        for k in r.sample(range(200), r.randint(2, 9)):
            copy[k] = r.choice(stock)
        out.append(" ".join(copy))
    return out


def same_parts(a: list, b: list) -> bool:
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("blocks", [None, ((3, 500), (5, 900))])
def test_near_copies_of_five_words_and_four_fifths(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(near_copies, "BLOCK_OUT", blocks[0])
        monkeypatch.setattr(near_copies, "BLOCK_IN", blocks[1])
    texts = near_texts()
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r.id: r.component for r in near_copies.labelled(docs).collect()}
    want = groups(texts)
    assert same_parts([got[k] for k in range(len(texts))], want)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({want.index(w) for w in want})
    assert near_copies.labelled(docs.where("false")).count() == 0


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{k}" for k in range(80))
    other, third, fourth = (long.replace("w", x) for x in "xyz")
    near = long.replace("w40 ", "changed ")
    rows = [(None, other, "a"), (None, third, "b"), (5, long, "c"), (5, long, "c"), (5, long, "c"), (3, fourth, "d"), (3, near, "e"), (None, long, "f"), (3, fourth, "z"), (None, other, "a"), (8, None, "g"), (7, "", "h")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert len(got) == 5
    by_text = {r.text: r for r in got}
    assert by_text[near].doc_id == 3 and by_text[other].doc_id is None and by_text[third].doc_id is None
    assert by_text[fourth].doc_id == 3 and by_text[""].doc_id == 7


def removed(texts: dict) -> dict:
    """Each text without the bytes covered by a string of 100 bytes that starts earlier too; ids in order. A character that a cut splits goes."""
    seen, out = set(), {}
    for k in sorted(texts):
        b = texts[k].encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        left = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if left or not gone.any():
            out[k] = left
    return out


def test_run_against_plain_stages(spark, tmp_path):
    r = random.Random(31)
    stock = {"aa": ["katu", "mira", "solen", "dova", "pelu", "rinka", "tavo"], "bb": ["grosz", "tchwik", "przad", "szklo", "wprad", "krzew", "zboz"]}
    text = lambda lang, n: " ".join(w + r.choice("aeiou") * r.randint(0, 3) for w in r.choices(stock[lang], k=n))
    passage = text("aa", 40)
    rows = [(k, text(lang, r.choice([15, 60, 200])), lang) for k in range(160) for lang in [("aa", "bb")[k % 2]]]
    rows += [(200 + k, f"{text('aa', 30)} {passage} {text('aa', 20)}", "aa") for k in range(4)]
    rows += [(300, rows[5][1], "bb"), (300, rows[5][1], "bb"), (301, rows[6][1] + " katu", "aa"), (302, passage, "aa"), (303, text("bb", 30) + " password = abc123secret", "bb"), (304, None, None), (305, "12 34 56", "aa"), (306, " ".join("".join(r.choices("qxjvy", k=6)) for _ in range(200)), None)]
    documents = spark.createDataFrame([(*x, "s", len(x[1] or "")) for x in rows], SCHEMA)
    documents.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        got.setdefault(x.doc_id, []).append((x.start, x.length, x.ids_crc32, x.doc_tokens))

    model = langid.fit(documents.where(~langid.held_out("doc_id")))
    judged = langid.classify(documents, model, keep=["text"]).where("NOT rejected").select("doc_id", "text").distinct().collect()
    kept = {}
    for x in judged:
        kept.setdefault(x.doc_id, x.text)
    assert {304, 305, 306}.isdisjoint(kept) and len(kept) > 160  # no letters, and noise
    ids = sorted(kept)
    root = groups([kept[i] for i in ids])
    firsts = {i: kept[i] for k, i in enumerate(ids) if root.index(root[k]) == k}
    assert 300 not in firsts and 301 not in firsts
    assign = re.compile(secrets.BASE_RULES[0].pattern, re.A | re.I)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in removed(firsts).items():
        for m in reversed(list(assign.finditer(t))):
            if len(m[2]) >= 6:
                t = t[: m.start(2)] + "[SECRET]" + t[m.end(2) :]
        want[i] = [*library.encode(t, add_special_tokens=False).ids, 2]
    assert set(got) == set(want) and 302 not in want
    for i, tokens in want.items():
        at = 0
        for start, length, crc, size in got[i]:
            assert (start, size) == (at, len(tokens)) and crc == zlib.crc32(np.array(tokens[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(tokens)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_meet_at_anchors_of_their_fingerprints():
    r = np.random.default_rng(5)
    some = lambda n: r.integers(0, 2**64, n, dtype=np.uint64)
    for n, m, both in [(4, 5, 4), (5, 6, 5), (9, 9, 8), (40, 50, 40), (90, 90, 80), (450, 450, 400)]:  # similarity 0.8, or the next above
        for _ in range(40):
            shared = some(both)
            prints = np.stack([near_copies.fingerprint(np.concatenate([shared, some(k - both)])) for k in (n, m)])
            anchor, row = near_copies.anchors(prints)
            differ = np.bitwise_count(prints[0] ^ prints[1])
            met = {int(a) >> 31 for a in np.intersect1d(anchor[row == 0], anchor[row == 1])}
            assert met >= set(np.flatnonzero(differ <= 2).tolist()) and met and differ.sum() <= near_copies.MOST_DIFFER
    unlike = np.stack([near_copies.fingerprint(some(300)) for _ in range(30)])
    anchor, row = near_copies.anchors(unlike)
    assert len(np.unique(anchor)) == len(anchor) and np.bitwise_count(unlike[0] ^ unlike[1]).sum() > 1000


def test_near_copies_of_large_groups_are_compared_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", 1)
    monkeypatch.setattr(near_copies, "BLOCK_OUT", (3, 500))
    monkeypatch.setattr(near_copies, "BLOCK_IN", (5, 900))
    texts = near_texts()
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {x.id: x.component for x in near_copies.labelled(docs).collect()}
    assert same_parts([got[k] for k in range(len(texts))], groups(texts))


@pytest.mark.parametrize("parts, small", [(1, 64), (3, 64), (1, 2)])
def test_a_group_of_texts_that_meet_makes_links_and_no_pairs(parts, small):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**64, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(120) > r.choice([0.01, 0.03, 0.2])], r.integers(0, 2**64, 6, dtype=np.uint64)])) for _ in range(150)]
    prints = np.stack([near_copies.fingerprint(x) for x in sets])
    c = np.arange(len(sets))
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in prints]), pa.array(c)], ["print", "c"])
    dealt = pa.Table.from_batches(near_copies._dealt([batch], parts)).sort_by("group").combine_chunks()
    assert len(dealt) <= len(sets) * near_copies.SEGMENTS // near_copies.TOGETHER * parts
    loose = [(u, v) for b in near_copies._loosely_linked(dealt.to_batches(), parts, small) for u, v in zip(*(b.column(k).to_pylist() for k in "uv"))]
    assert len(loose) < len(sets) * near_copies.SEGMENTS // near_copies.TOGETHER * parts  # a forest for each bucket

    def parted(links):
        root = list(range(len(sets)))
        for u, v in links:
            root = [root[v] if x == root[u] else x for x in root]
        return root

    near = [(i, j) for i in range(len(sets)) for j in range(i) if near_copies.similar(sets[i], sets[j])]
    family = parted(loose)
    assert len(near) > 3 * len(sets) and all(family[i] == family[j] for i, j in near)
    for block in (np.zeros(len(sets), np.int64), np.where(c < 5, -1, 0)):
        links = near_copies.links_in_group(c, np.where(block < 0, 0, c), block, prints, sets)
        assert len(links) < len(sets) and set(links) <= set(near)
    links = near_copies.links_in_group(c, c, np.zeros(len(sets), np.int64), prints, sets)
    assert same_parts(parted(links), parted(near))
