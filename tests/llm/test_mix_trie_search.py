"""op11, op12 and op13 against DuckDB on the given tables and against brute force on small ones: nulls, ties, repeats, clashes, long texts, empty tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import curriculum, lexical, queries, turn_trie

DATA = "/root/testdata/sf0.001"
R = random.Random(5)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota Größe 中文 x9".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(plain(v) for v in r) for r in want), key=repr)


# --- op11


def brute_trie(turns: list[tuple], p: turn_trie.Rebuild = turn_trie.Rebuild()) -> set:
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(rows)] for c, rows in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % (p.most_head + 1)
        base = c - int(math.fmod(c, p.family))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, rows in rebuilt.items():
        for d in range(len(rows) + 1):
            members[tuple(rows[:d])].append(c)
    below = Counter(n[:-1] for n in members if n)
    saved, leaves = Counter(), Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += below[n] == 0
    out = set()
    for n, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(n))))
        out.add((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), below[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_turns() -> list[tuple]:
    turns = []
    for c in [*range(-12, 30), 500, 503]:
        for t in range(R.randrange(0, 9)):
            turns.append((c, t, R.choice(["user", "assistant", None]), R.choice(["hi", "yes", "", None, "größe"])))
    turns += [(40, t, "user", "same") for t in range(30)] + [(c, t, "user", "same") for c in range(41, 46) for t in range(12)]
    turns += [(7, None, "system", "first"), (7, None, "system", "first"), (7, 3, "user", "tie"), (None, 1, "user", "nobody"), (2**60, 0, "user", "far"), (60, 0, "user", "long " * 100_000), (61, 0, "user", "long " * 100_000)]
    return turns


def trie_rows(frame):
    return [tuple(r) for r in frame.drop("node").collect()]


def conversations(spark, turns):
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return table.withColumns({"conv": F.lit(1), "e1": F.lit("x"), "depth": F.lit(None).cast("int"), "place": F.lit(2), "f1": F.lit(True)}).repartition(3)


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_equals_brute_force(spark, parts):
    turns = some_turns()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = trie_rows(turn_trie.prefix_trie(conversations(spark, turns), turn_trie.Rebuild(block_rows=8)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(set(got)) and set(got) == brute_trie(turns)


def test_trie_with_clashing_hashes_and_one_long_conversation(spark):
    turns = some_turns()[:120]
    got = trie_rows(turn_trie.prefix_trie(conversations(spark, turns), turn_trie.Rebuild(first_mask=1)))
    assert set(got) == brute_trie(turns)
    long = [(c, t, "user", f"turn {t % 7} {c * (t > 900)}") for c in (0, 5, 10) for t in range(1000)] + [(1, 0, "user", "a")]
    p = turn_trie.Rebuild(block_rows=64)
    got = trie_rows(turn_trie.prefix_trie(conversations(spark, long), p))
    assert len(got) == len(set(got)) and set(got) == brute_trie(long, p)


def test_trie_of_empty_tables(spark):
    assert trie_rows(turn_trie.prefix_trie(conversations(spark, some_turns()).where("false"))) == []
    assert trie_rows(turn_trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")]))) == []
    # 1 has one turn, loses it to its head, and its base is absent: it is rebuilt without turns
    lonely = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert trie_rows(turn_trie.prefix_trie(conversations(spark, [(lonely, 1, "user", "x")]))) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


# --- op12


def brute_targets(sizes: dict, p: curriculum.MixParams) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: p.schedules[k % len(p.schedules)].total for k, s in enumerate(names)}
    words, cut = p.share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in cut]
        level = (words - sum(p.most_repeats * sizes[s] for s in cut)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > p.most_repeats * sizes[s]}
        if not over:
            return {s: p.most_repeats * sizes[s] if s in cut else weight[s] * level for s in names}
        cut |= over


def some_docs(spark, n=900):
    rows = []
    for k in range(n):
        source = R.choice(["hot"] * 12 + ["b", "B", "é", "", None, "zz", "small"])
        rows.append((k, " ".join(R.choices(WORDS, k=R.randrange(0, 40 if source != "small" else 2))), source))
    rows += [(k, t, s) for k, t, s in rows[:30]] + [(None, None, None), (None, "two words", None), (-1, "word " * 30_000, "giant"), (3, "", "nothing")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return rows, table.withColumns({"size": F.lit("x"), "name": F.lit(1), "null": F.lit(2), "hash": F.lit(3), "target": F.lit(None).cast("int"), "block": F.lit(4), "doc": F.lit(5)}).repartition(4)


def test_mix_targets_and_repeats(spark):
    rows, table = some_docs(spark)
    p = curriculum.MixParams(block_rows=16)
    got = curriculum.mix(table, p, keep=("size", "target", "source", "text")).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = brute_targets(sizes, p)
    assert sorted((str(r.doc_id), str(r.doc.source), r.size, r.doc.text or "") for r in got) == sorted((str(k), str(s), count(t), t or "") for k, t, s in rows)
    taken = Counter()
    for r in got:
        assert (r.source_size, round(r.target, 6)) == (sizes[r.doc.source], round(want[r.doc.source], 6))
        assert r.taken == sum(x.words for x in r.places) <= 2 * r.size and all(0 < x.words <= r.size and 0 <= x.position <= 1 for x in r.places)
        taken[r.doc.source] += r.taken
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s]) for s in sizes}
    again = curriculum.mix(table.repartition(7), p).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken, [tuple(x) for x in r.places]) for r in rs)
    assert key(again) == key(got)


def test_positions_follow_the_schedules(spark):
    """By each moment, what a source has given is its schedule's running integral, give or take a document."""
    p = curriculum.MixParams((curriculum.Schedule(((0, 0), (0.25, 0), (1, 3))), curriculum.Schedule(((0, 2), (0.5, 0), (0.75, 0), (1, 1)))), block_rows=32)
    docs = spark.createDataFrame([(k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(800)], "doc_id long, text string, source string")
    order = curriculum.training_order(docs, p, keep=("source",)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and len(order) > 800
    target = {r.source: r.target for r in curriculum.mix(docs, p, keep=("source",)).select("doc.source", "target").distinct().collect()}
    grid = np.linspace(0, 1, 20001)
    for source, s in zip("ab", p.schedules):
        due = np.cumsum(np.interp(grid, *zip(*s.knots))) / len(grid) / s.total * target[source]
        given = 0
        for r in order:
            if r.doc.source == source:
                assert abs(np.interp(r.position, grid, due) - given) < 2 + 1e-3 * target[source]
                given += r.words
        assert given == math.floor(target[source])


def test_mix_edges(spark):
    _, table = some_docs(spark, 5)
    assert curriculum.mix(table.where("false")).collect() == []
    assert curriculum.training_order(table.where("false")).collect() == []
    wordless = curriculum.mix(table.where("text = ''")).collect()
    assert wordless and all((r.size, r.target, r.taken, r.places) == (0, 0.0, 0, []) for r in wordless)
    for bad in (((0, 1),), ((0, 1), (0.5, 1)), ((0, 0), (1, 0)), ((0, -1), (1, 3)), ((0, 1), (0.5, 1), (0.5, 2), (1, 1))):
        with pytest.raises(ValueError):
            curriculum.Schedule(bad)


# --- op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, words = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if b[t]:
                    m = 25 + 75 * b.total() * n_docs // words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n: int, vocabulary: int) -> list[tuple]:
    r = random.Random(11)
    words = [f"w{k}" for k in range(vocabulary)]
    common = [1 / (k + 1) for k in range(vocabulary)]
    docs = []
    for k in range(n):
        topic = words[(k % 9) * 7 :][: vocabulary // 3]
        docs.append((k * 3 - 50, " ".join([*r.choices(words, common, k=r.randrange(30)), *r.choices(topic, k=r.randrange(20))])))
    return docs


def test_search_equals_brute_force(spark):
    docs = corpus(700, 60)
    docs += [(9000 - k, docs[5][1]) for k in range(200)] + [docs[7], docs[7], (None, docs[9][1]), (None, None), (1, ""), (2, "W1, w2;W3\x7f größe GRÖßE 中文 x"), (4, "w1 " * 200_000)]
    items = [(k, docs[k * 17][1]) for k in range(30)] + [(3, "w1 w1 w1 w59"), (None, "w7 W7 größe"), (50, None), (51, "?"), (52, "unknown words")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "numbers": F.lit(1), "counts": F.lit(2), "shard": F.lit(3), "score": F.lit(4)}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"query": F.lit(1), "rank": F.lit("r"), "item": F.lit(0)})
    want = brute_search(docs, items)
    for p in (lexical.LexicalParams(), lexical.LexicalParams(shard_counts=2000, wave_queries=8, wave_terms=150, block_docs=4, most_blocks=12)):
        assert sorted((tuple(r) for r in lexical.ranked_search(table, asked, p).collect()), key=repr) == want
    assert lexical.ranked_search(table.where("false"), asked).collect() == []
    assert lexical.ranked_search(table, asked.where("false")).collect() == []
    assert lexical.ranked_search(table.where("text = ''"), asked).collect() == []


def test_blocks_bound_and_skip():
    """Summaries are the coordinatewise maxima of their blocks, lists are whole, and blocks that cannot win are skipped."""
    r = np.random.default_rng(3)
    docs, terms, p = 4000, 300, lexical.LexicalParams(block_docs=16, k=5)
    topic = r.integers(0, 30, docs)
    pairs = np.unique(np.concatenate([np.arange(docs).repeat(12) * terms + (topic.repeat(12) * 10 + r.integers(0, 10, docs * 12)), r.integers(0, docs, 20000) * terms + r.integers(0, terms, 20000)]))
    doc, term = pairs // terms, pairs % terms
    df = np.bincount(term, minlength=terms)
    order = np.argsort(df, kind="stable")
    place = np.empty(terms, np.int64)
    place[order] = np.arange(terms)
    x = r.integers(1, 1000, len(doc))
    shard = lexical.Shard(doc, place[term], x, docs, terms, p)
    full = np.zeros((docs, terms), np.int64)
    full[doc, place[term]] = x
    for t in (0, 100, 299):
        members, first, s_term, s_block, s_max = shard.blocks(t)
        assert sorted(members) == sorted(np.flatnonzero(full[:, t])) and (np.diff(np.append(first, len(members))) > 0).all()
        for b, (lo, hi) in enumerate(zip(first, np.append(first[1:], len(members)))):
            top = full[members[lo:hi]].max(axis=0)
            top[:t] = 0
            mine = np.zeros(terms, np.int64)
            mine[s_term[s_block == b]] = s_max[s_block == b]
            assert (mine == top).all()
    seen = np.zeros(docs, bool)
    for k in range(25):
        own = np.unique(full[k * 7].nonzero()[0])
        weights = r.integers(1, 50, len(own)) + 300 * (terms - own) // terms
        dense = np.zeros(terms, np.int64)
        dense[own] = weights
        score = full @ dense
        best, scores = shard.search(own, weights, dense, seen)
        assert best.tolist() == np.lexsort((np.arange(docs), -score))[:5].tolist() and scores.tolist() == score[best].tolist() and not seen.any()
    assert shard.skipped > 0.5 * shard.met and shard.scored < 0.5 * 25 * docs


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical.Chunk, "hashes", lambda self, start, end: np.zeros(len(start), np.uint64))
    words = lexical.Vocabulary(["one", "two", "six", "three"])
    data, at = lexical.raw(lexical.pa.array(["six one four", "THREE two"], lexical.pa.large_string()))
    c, start, end, row = lexical.terms_of(data, at, 0, 2)
    assert [words.terms[k] if k >= 0 else None for k in words.find(c, start, end)] == ["six", "one", None, "three", "two"] and row.tolist() == [0, 0, 0, 1, 1]
