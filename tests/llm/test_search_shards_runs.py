"""Lexical search, sharding and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isopleth.llm import lexical, periodic, sharding

# --- lexical search


def _scores(docs, item):
    """(score, id) of every document with a score, best first; ids may be null."""
    held = [(i, Counter(lexical.terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, tokens = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for i, c in held:
        m = 75 + 25 * sum(c.values()) * n // tokens
        score = sum(
            lexical.term_weight(n, df[t]) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in lexical.terms_of(item) if t in c
        )
        if score > 0:
            out.append((score, i))
    return sorted(out, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _texts(rng, n, vocabulary=60):
    return [" ".join(f"w{min(int(rng.expovariate(0.08)), vocabulary)}" for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_search_equals_scoring_every_document(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    monkeypatch.setattr(lexical, "ITEMS_PER_PASS", 4)
    rng = random.Random(3)
    texts = _texts(rng, 300)
    texts[40:140] = [texts[40]] * 100  # a third are copies: ties beyond k
    docs = list(enumerate(texts)) + [(7, texts[7]), (None, texts[3]), (None, texts[40]), (900, None), (901, ""), (902, " .\n")]
    docs.append((903, "w1 " * 30_000 + "rare"))
    items = [(i, t) for i, t in enumerate(_texts(rng, 9))] + [(9, texts[40]), (10, "rare W1-w1"), (11, None), (12, "absent"), (10, "w2")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, score int").repartition(3)
    found = lexical.search(table, spark.createDataFrame(items, "item_id long, text string"), k=5).collect()
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found)
    want = Counter((i, rank + 1, doc, score) for i, t in items for rank, (score, doc) in enumerate(_scores(docs, t or "")[:5]))
    assert got == want


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0
    assert lexical.search(spark.createDataFrame([("x", "a")], "doc_id string, text string"), items.limit(0)).count() == 0
    assert lexical.search(spark.createDataFrame([("x", "a"), ("y", "c")], "doc_id string, text string"), items).first()["doc_id"] == "x"


def test_terms():
    assert lexical.terms_of("Ab-c_É1ß\x00x|Y") == ["ab".encode(), b"c", "É1ß".encode(), b"x", b"y"]


def test_packed_treap_is_the_treap():
    rng = np.random.default_rng(5)
    cells = np.unique(rng.integers(0, 100 * 37, 900))
    treap = lexical.Treap.build(cells // 37, cells % 37, rng.integers(1, 10**6, len(cells)))
    again = lexical.Treap.unpack(treap.pack())
    for a, b in zip([*treap.masks, *treap.first, *treap.largest], [*again.masks, *again.first, *again.largest], strict=True):
        assert (a == b).all()


def test_search_opens_a_part_of_the_ranges():
    """Where a few documents stand out, most ranges stay closed."""
    rng = np.random.default_rng(7)
    row, col = np.divmod(np.unique(rng.integers(0, 64 * 4096, 20_000)), 4096)
    value = rng.integers(1, 1000, len(row))
    value[:40] = 10**6
    treap = lexical.Treap.build(row, col, value)
    opened = []
    down = treap.down
    treap.down = lambda level, node, *a: (opened.append(len(node)), down(level, node, *a))[1]
    rows = [[(r, 5) for r in range(4)]]
    q, c, s = lexical.best_of_block(treap, rows, np.arange(1 << treap.height), np.ones(1, dtype=np.int64), 5)
    want = np.bincount(col[row < 4], weights=5 * value[row < 4], minlength=4096).astype(int)
    order = np.lexsort((np.arange(4096), -want))[:5]
    assert c.tolist() == order.tolist() and s.tolist() == want[order].tolist()
    assert sum(opened) < 2 * (row < 4).sum()


# --- sharding


def _sharded(rows, shards, slack=1 / 32):
    """Shard of each (key, id, size) by the rule, the whole order at hand."""
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    order = sorted((number(k or ""), number("" if i is None else str(i)), i, k, n) for k, i, n in rows)
    total, at, out = sum(r[-1] for r in order), 0, Counter()
    size, begin, count = Counter(), {}, Counter()
    for r in order:
        begin.setdefault(r[0], at)
        size[r[0]] += r[-1]
        count[r[0]] += 1
        at += r[-1]
    at = 0
    slots = Counter()
    for k, _, i, key, n in order:
        together = count[k] > 1 and size[k] * shards <= slack * total
        middle = 2 * begin[k] + size[k] if together else 2 * at + n
        shard = min(shards - 1, middle * shards // (2 * total))
        out[key, i, n, shard, slots[shard]] += 1
        slots[shard] += 1
        at += n
    return out


@pytest.mark.parametrize(("ranges", "bucket_rows"), [(1024, 8192), (8, 32), (1, 16), (5, 1)])
def test_shards_do_not_depend_on_the_samples(spark, ranges, bucket_rows):
    rng = random.Random(1)
    rows = [(f"k{i}", i, rng.randint(8, 60)) for i in range(300)]
    rows += [("hot", i, 20) for i in range(1000, 1150)] + [("pair", 5000, 30), ("pair", 5001, 30), (None, None, 9)]
    rows += [("same", 1, 11)] * 80  # alike in everything
    data = spark.createDataFrame([(*r, 0, "s") for r in rows], "key string, id long, n long, shard int, _k string").repartition(3)
    found = sharding.place(data, F.col("n"), F.col("key"), F.col("id"), 6, ranges=ranges, sample_rows=400, bucket_rows=bucket_rows)
    got = Counter((r["key"], r["id"], r["n"], r["shard"], r["slot"]) for r in found.collect())
    assert got == _sharded(rows, 6)
    assert found.columns == ["key", "id", "n", "_k", "shard", "slot"]


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "x" * rng.randint(0, 300), "copy" * 50])) for i in range(3000)] + [(9999, "y" * 4000)]
    out = sharding.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    bytes_of, slots = Counter(), {}
    for r in out:
        bytes_of[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(bytes_of.values()) / 24
    assert all(abs(n - mean) <= mean / 32 + 4008 for n in bytes_of.values())
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}


def test_shards_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.digest(none).count() == 0
    one = spark.createDataFrame([("a", 1, None)], "key string, id long, n long")
    assert [(r["shard"], r["slot"]) for r in sharding.place(one, F.col("n"), F.col("key"), F.col("id"), 3).collect()] == [(0, 0)]


def test_splitters_follow_the_weights():
    sample = [((i, 0, 0), 1 + 9 * (i == 50)) for i in range(100)]
    cuts = sharding.splitters(sample, 10)
    assert cuts == sorted(set(cuts)) and (50, 0, 0) in cuts and len(cuts) <= 9
    assert sharding.splitters([], 10) == []


# --- periodic runs


def _brute_runs(words, times=4, least=6):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i = max(i, start + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=8), st.integers(1, 9)), max_size=6), st.integers(2, 5), st.integers(2, 8))
def test_runs_are_those_of_every_period_tried(parts, times, least):
    words = [x for part, n in parts for x in part * n]
    codes = np.array(words, dtype=np.int64)
    want = _brute_runs(words, times, least)
    assert periodic.runs_of([codes, codes[:0], codes], times, least) == [want, [], want]


def test_long_runs():
    assert periodic.runs_of([np.zeros(50_000, dtype=np.int64)]) == [[(0, 50_000, 1)]]
    line = np.random.default_rng(1).permutation(4000)
    assert periodic.runs_of([np.concatenate([[9999], np.tile(line, 5), [9998]])]) == [[(1, 20_000, 4000)]]


def test_collapsed_texts(spark):
    again = "to be or not to be"  # a no-break space separates nothing
    texts = [None, "", " \t\n", "a", "no no no no no no more", " ".join([again] * 5) + "\x0bend", "x y " * 40_000, "a b a b a b"]
    rows = [(i, t, "kept", [1]) for i, t in enumerate(texts)] + [(4, texts[4], "kept", [2])]
    data = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, runs array<int>")
    out = periodic.collapse(data).collect()
    assert data.columns[:2] + ["runs", "collapsed"] == list(out[0].asDict())
    got = {(r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in out}
    want = set()
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        runs = _brute_runs(words) if len(words) < 1000 else [(0, 80_000, 2)]
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        want.add((i, tuple(runs), " ".join(w for j, w in enumerate(words) if j not in gone)))
    assert got == want and len(out) == len(rows)
    assert periodic.collapse(data.limit(0)).count() == 0


def test_planted_periods_and_digest(spark):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 50))) for i in range(300)] + [(None, "a b"), (3, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in periodic.digest(periodic.collapse(periodic.planted(data))).collect()}
    strong = 0
    for i, t in rows[:-1]:
        words, h = (t or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = _brute_runs(words) if i != 3 else []
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = out[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        strong += len(runs)
    assert strong > 10
