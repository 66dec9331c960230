"""URL filters, mixing, Jaccard join, neighbours, WARC and packing: brute force and edge cases."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isopleth import session
from isopleth.llm import ann, graph, jaccard, mixture, packing, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# URL filters


def brute_host_path(url):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def brute_rule(host, path):
    fits = [r for r in urls.STATED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


URLS = [
    None,
    "",
    "no scheme.example.com/en/",
    "http://EXAMPLE.com/en/x",
    "https://www.Example.com/en/",
    "https://a.www.example.com/en/y?z=1#t",
    "https://badexample.com/en/",
    "http://x.net/es/1",
    "http://x.net/ES/1",
    "http://net/fr/",
    "http://x.net?/fr/",
    "ftp://Ü.ORG://x.com/a",
    "http://" + "a." * 5000 + "com/" + "p/" * 5000,
]


def test_stated_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:5])] + [(None, "http://x.com/", "c")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.judge(pages, labels).collect()
    assert len(got) == len(URLS) + 6
    for r in got:
        if r.page_id is None:
            assert (r.host, r.verdict) == ("x.com", "allow")
            continue
        url = (URLS + URLS[:5])[r.page_id]
        host, path = brute_host_path(url)
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.host + rule.path, rule.verdict if rule else "allow")
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_equal_exhaustive_search(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(400):
        spam, promo = rng.random() < 0.4, rng.random() < 0.5
        rows.append((i, f"http://{'spam' if spam else 'fine'}.example.org/{'promo' if promo else 'news'}/{i}"))
        if i % 2 == 0:
            labels.append((i, 0 if spam and promo else 1, 0))
    labels += [(1, None, None), (None, 0, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    items = {r[0]: frozenset(r[1]) for r in pages.select("page_id", urls.tokens(F.col("url"))).collect()}
    bad = {i: q == 0 for i, q, _ in labels if i is not None and q is not None}
    joined = pages.join(known.withColumnRenamed("doc_id", "page_id"), "page_id")
    held = urls.mine(joined, F.col("url"), F.col("quality") == 0, min_bad=10, min_confidence=0.9).collect()
    assert held
    for r in held:
        covered = [i for i in bad if set(r.antecedent) <= items[i]]
        assert (r.n, r.n_bad) == (len(covered), sum(bad[i] for i in covered)) and r.confidence == pytest.approx(r.n_bad / r.n)
        assert r.confidence >= 0.9 and r.n_bad >= 10 and r.key in r.antecedent
    # Every set of up to three tokens that meets the limits is a rule or fits wherever a rule does.
    base, every = sum(bad.values()) / len(bad), sorted(set().union(*(items[i] for i in bad)))
    for size in (1, 2, 3):
        for a in combinations(every, size):
            covered = [i for i in bad if set(a) <= items[i]]
            n, k = len(covered), sum(bad[i] for i in covered)
            if k >= 10 and k / n >= 0.9 and wilson(k, n, 3.0) > base:
                assert any(set(r.antecedent) <= items[i] for r in held for i in covered[:1])
                assert all(any(set(r.antecedent) <= items[i] for r in held) for i in covered)
    judged = {r.page_id: r for r in urls.judge(pages, known, min_bad=10, min_confidence=0.9).collect()}
    for i, own in items.items():
        blocked = any(set(r.antecedent) <= own for r in held)
        assert (judged[i].verdict == "block") == blocked == (judged[i].mined is not None)
    assert all((judged[i].verdict == "block") == ("spam" in u and "promo" in u) for i, u in rows)


def wilson(k, n, z):
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def planted_urls(n):
    """One URL in ten is of a bad host on a fine domain; of the others one in ten is bad by chance."""
    rng = random.Random(n)
    for i in range(n):
        spam = i % 10 == 0
        yield i, f"https://{'evil' if spam else 'h' + chr(97 + i % 7)}.example.org/{rng.choice(['en', 'de'])}/{i}", int(not (spam or rng.random() < 0.1)), 0


@pytest.mark.parametrize("n", [200, 20_000])
def test_the_same_rule_is_found_at_any_size(spark, n):
    df = spark.createDataFrame(list(planted_urls(n)), "page_id long, url string, quality int, toxic int")
    assert [r.antecedent for r in urls.mine(df, F.col("url"), F.col("quality") == 0).collect()] == [["host=evil"]]


def test_few_bad_urls_among_very_many_make_a_rule_and_fewer_do_not(spark):
    rows = [(f"http://h{chr(97 + i % 20)}.org/{chr(97 + i % 3)}", False) for i in range(4000)]
    rows += [("http://bad.org/a", True)] * 3 + [("http://bad.org/b", True)] * 2 + [("http://four.org/a", True)] * 4
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert [r.antecedent for r in urls.mine(df, F.col("url"), F.col("bad")).collect()] == [["host=bad"]]


def test_long_urls_are_mined_and_matched(spark):
    words = [a + b for a in "abcdefgh" for b in "vwxyz"]
    rng = random.Random(9)
    deep = ["http://deep.org/" + "/".join(w for w in words if rng.random() < 0.9) for _ in range(12)]
    rows = [(i, u, 0, 0) for i, u in enumerate(deep + ["http://same.org/" + "/".join(f"x{w}" for w in words)] * 6)]
    rows += [(100 + 8 * i + j, f"http://fine.org/{w}/{j}", 1, 0) for i, w in enumerate(words) for j in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, quality int, toxic int")
    # Each token of the long URLs but their hosts also occurs in fine ones, or in the same URLs as the host.
    rules = {tuple(r.antecedent) for r in urls.mine(df, F.col("url"), F.col("quality") == 0).collect()}
    assert ("host=deep",) in rules and ("host=same",) in rules
    got = {r.page_id: r.verdict for r in urls.judge(df.select("page_id", "url"), df.select(F.col("page_id").alias("doc_id"), "quality", "toxic")).collect()}
    assert all((v == "block") == (i < 100) for i, v in got.items())


def test_baskets_hold_every_triple(spark):
    for size in (1, 12, 13, 14, 23):
        own = [f"t{i:02d}" for i in range(size)]
        made = spark.createDataFrame([(own,)], "own array<string>").select(urls._baskets("own")).first()[0]
        assert all(len(b) <= 12 for b in made)
        assert all(any(set(c) <= set(b) for b in made) for c in combinations(own, min(3, size)))


# Mixing


def brute_shares(budget, children):
    """children: name -> (weight, cap).  Repeated rounds over those that are not full."""
    given, left, open_ = {c: 0.0 for c in children}, float(budget), set(children)
    while open_ and left > 1e-9:
        weights = sum(children[c][0] for c in open_)
        if not weights:
            break
        full = {c for c in open_ if given[c] + left * children[c][0] / weights >= children[c][1] - 1e-9}
        if not full:
            for c in open_:
                given[c] += left * children[c][0] / weights
            break
        for c in full:
            left -= children[c][1] - given[c]
            given[c] = children[c][1]
        open_ -= full
    return given


def test_shared_out_equals_rounds(spark):
    rng = random.Random(4)
    for _ in range(6):
        children = {f"c{i}": (rng.choice([0.0, 0.5, 1.0, 3.0]), rng.randint(0, 500)) for i in range(7)}
        budget = rng.randint(0, 2500)
        rows = [(c, w, cap, budget) for c, (w, cap) in children.items()]
        df = spark.createDataFrame(rows, "name string, _weight double, _cap long, _budget long")
        got = {r["name"]: r["_given"] for r in mixture.shared_out(df, [], "name").collect()}
        want = brute_shares(budget, children)
        assert all(abs(got[c] - want[c]) <= 1 for c in children) and sum(got.values()) <= budget


def mixing_rows():
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["en", "de", None]), rng.choice(["src0", "s1", "s2"])) for i in range(300)]
    return rows + [(7, None, "en", "s1"), (None, "x y z", "fr", None), (None, "x y z", "fr", None), (400, "long " * 50_000, "de", "s2")]


def test_mixture_takes_prefixes_of_epochs(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("mix_epoch", F.lit("clash"))
    domain = F.when(F.col("source") == "src0", "crawl").otherwise("curated")
    weights = {"domain": {"crawl": 0.4, "curated": 0.6}, "lang": {"en": 3.0}, "source": {}}
    got = mixture.mix(df, weights, domain, budget=6000, max_epochs=3, seed=1, bucket_rows=16).collect()
    leaf = lambda r: ("crawl" if r[3] == "src0" else "curated", r[2] or "", r[3] or "")
    held = defaultdict(list)
    for r in rows:
        held[leaf(r)].append((f"{r[0]}|" if r[0] is not None else "", hashlib.md5((r[1] or "").encode()).hexdigest(), len((r[1] or "").split())))
    tokens = {k: sum(n for *_, n in v) for k, v in held.items()}
    caps = lambda depth: Counter()

    def level(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        cap = Counter()
        for k, t in tokens.items():
            if t and k[:depth] == prefix:
                cap[k[depth]] += 3 * t
        w = [weights["domain"], weights["lang"], {}][depth]
        shares = brute_shares(budget, {c: (w.get(c, 1.0), n) for c, n in cap.items()})
        out = {}
        for c, b in shares.items():
            out |= level((*prefix, c), b)
        return out

    want = level((), 6000)
    used = Counter()
    for r in got:
        used[(r.mix_domain, r.lang or "", r.source or "")] += r.mix_used
    for k, b in want.items():
        assert abs(used[k] - b) <= 8, k
    # Whole epochs come before the partial one, and that is a prefix of its order.
    for k, docs in held.items():
        mine = [r for r in got if (r.mix_domain, r.lang or "", r.source or "") == k]
        per = Counter(r.mix_epoch for r in mine)
        last = max(per, default=-1)
        assert all(per[e] == len(docs) for e in range(last))
        keys = sorted(hashlib.md5(f"1|{last}|{a}{h}".encode()).hexdigest() for a, h, _ in docs)
        taken = sorted(
            hashlib.md5(f"1|{last}|{'' if r.doc_id is None else str(r.doc_id) + '|'}{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()
            for r in mine
            if r.mix_epoch == last
        )
        assert taken == keys[: len(taken)]
    assert mixture.mix(df.limit(0), weights, domain).count() == 0


# Jaccard join and components


def brute_groups(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def jaccard_texts():
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts = [None, "", " \n", "a", "A", "a b", "a b c", "A B c", "É é", "é é"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    crowd = [word() for _ in range(120)]  # near copies of each other, more than a crowded key needs
    for i in range(45):
        copy = list(crowd)
        for _ in range(i % 5):
            copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    line = "the same opening line that very many documents share word for word here"
    texts += [line + " " + " ".join(word() for _ in range(40)) for _ in range(40)]
    texts.append("long text " * 40_000)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_equals_brute_force(spark, width, percent):
    texts = jaccard_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("f", F.lit("clash"))
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(df, width=width, percent=percent, hot_df=8).collect()}
    assert got == brute_groups(texts, width, percent)


def test_jaccard_null_and_repeated_ids(spark):
    t = " ".join(f"x{i}" for i in range(30))
    rows = [(5, t), (5, t), (None, t), (None, "lonely one two three four five six"), (3, t + " y"), (9, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    got = Counter((r[0], r[2]) for r in jaccard.near_duplicates(df).collect())
    assert got == Counter({(5, 3): 2, (None, 3): 1, (None, None): 2, (3, 3): 1, (9, 9): 1})
    kept = jaccard.representatives(df).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(3, t + " y"), (None, rows[3][1]), (9, None), (None, "")])
    again = spark.createDataFrame([(5, t, "a"), (5, t, "b"), (8, t, "c")], "doc_id long, text string, _words string")
    assert [(r.doc_id, r.text) for r in jaccard.representatives(again).collect()] == [(5, t)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0 and jaccard.representatives(df.limit(0)).count() == 0


def test_components_of_chain_star_and_ring(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (None, 4)]
    rng = random.Random(1)
    rng.shuffle(links)
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]} | {i: 300 for i in (300, 301, 302)}
    assert got == want


def test_components_in_few_shuffles(spark):
    """Stars and their tails take two groupings in all, whatever the number of partitions; the results are right."""
    rng = random.Random(5)
    names = rng.sample(range(10**6), 700)
    links = [(names[i], names[0]) for i in range(1, 400)] + [(names[i], names[400]) for i in range(401, 650)]
    links += [(names[i], names[rng.randrange(1, 400)]) for i in range(650, 700)]
    held = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc, group = spark.sparkContext, "components in few shuffles"
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long").coalesce(2)).collect()))
        sizes = {}
        for job in sc.statusTracker().getJobIdsForGroup(group):
            for stage in sc.statusTracker().getJobInfo(job).stageIds:
                if info := sc.statusTracker().getStageInfo(stage):
                    sizes[stage] = info.numTasks if info.numCompletedTasks else 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    one, two = {*names[:400], *names[650:]}, {*names[400:650]}
    assert got == dict.fromkeys(one, min(one)) | dict.fromkeys(two, min(two))
    assert 1 <= sum(n >= 101 for n in sizes.values()) <= 6, sizes


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    for nodes, many in ((300, 200), (300, 330), (60, 400)):
        names = rng.sample(range(-1000, 1000), nodes)
        links = [(rng.choice(names), rng.choice(names)) for _ in range(many)]
        root = {x: x for x in names}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            low, high = sorted((top(a), top(b)))
            root[high] = low
        want = {x: top(x) for a, b in links if a != b for x in (a, b)}
        assert dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect())) == want


# Neighbours


def test_chi_square():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert float(ann.chi_square_cdf(np.array(8.0), 8)) == pytest.approx(0.5665, abs=1e-4)


def exact_nearest(rows, k):
    out = {}
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            by = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in by]
    return out


def test_neighbours_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.standard_normal((3000, 24))).astype(np.float32)
    x[1000:1900] = x[1000]  # a third of all rows is one vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("p", F.lit("clash"))
    got = defaultdict(list)
    for r in sorted(ann.nearest(ann.vectors(df), F.col("id") % 100 == 0, leaf_rows=64, block_rows=32, query_block=4).collect()):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact_nearest([(i, np.array(v)) for i, v in rows], 10)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    for q in want:
        scores = dict(want[q])
        assert all(s == pytest.approx(scores[j], rel=1e-14) for j, s in got[q] if j in scores)


def test_neighbours_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (9, [2.0, 0.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(ann.vectors(df), F.col("id") % 100 == 0).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 9, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 9, 1.0)]
    assert ann.nearest(ann.vectors(df.limit(0)), F.col("id") % 100 == 0).count() == 0


def test_a_vector_that_many_rows_share(spark):
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(6).tolist()
    rows = [(i, hot if i % 3 else rng.standard_normal(6).tolist()) for i in range(3000)]
    df = ann.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    # The hot vector's 2,000 rows are k + 1 in the index, and no result needs another.
    held = ann.build(df, copies=6).blocks.select(F.explode("ids").alias("id")).collect()
    assert len(held) == 1000 + 6
    assert {r.id for r in held} >= {1, 2, 4, 5, 7, 8}
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 100 == 0, k=5, probability=0.999999).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    all_v = np.array([v for _, v in rows])
    for q in range(0, 3000, 100):
        score = np.sqrt(((all_v - all_v[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3000), score)) if i != q][:5]
        assert [i for i, _ in got[q]] == best
        assert [s for _, s in got[q]] == pytest.approx(score[best], rel=1e-12)


# WARC


PAGES = [(1, "http://a/", "same"), (2, "http://b/ ü\n", "same"), (3, None, None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "n", "same"), (None, "n", "alone"), (6, "r", "twice"), (6, "r", "twice"), (7, "m", "\x1f\x8b\x08 é ß \r\n\r\n")]


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


@pytest.mark.parametrize("split_bytes", [37, 1000, 8 << 20])
def test_warc_round_trip(spark, split_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write_archives(warc.with_revisits(pages), session.scratch(spark, "warc"))
    records = warc.read_archives(manifest, split_bytes)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(records, files=manifest).collect())
    assert warc.losses(manifest, records).count() == 0
    last = {"same": 2, "": 4, "alone": None, "twice": 6}
    want = Counter()
    for i, _, html in PAGES:
        h = html or ""
        to = last.get(h, i)
        revisit = to is not None and to != i
        want[(i, len(h.encode()), sha(h), "revisit" if revisit else "response", to if revisit else None)] += 1
    assert got == want
    assert {(r.id, r.url) for r in records.collect()} == {(None if i is None else str(i), u) for i, u, _ in PAGES}


def test_small_payloads_and_empty_tables(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert warc.with_revisits(pages, min_bytes=1000).where("revisit").count() == 0
    none = warc.write_archives(warc.with_revisits(pages.limit(0)), session.scratch(spark, "warc"))
    assert warc.resolved(warc.read_archives(none)).count() == 0


def test_ranges_own_each_record_once():
    rng = random.Random(6)
    made = [warc.record(str(i), None, None, False, sha(t), t.encode()) for i, t in enumerate("".join(rng.choices("ab\x1f\x8b", k=rng.randint(0, 900))) for _ in range(60))]
    data = b"".join(made)
    whole = list(warc.records_in_range(io.BytesIO(data), len(data), 0, len(data)))
    assert len(whole) == 60
    for size in (1, 13, 500, 4096):
        cut = []
        for start in range(0, len(data), size):
            cut += warc.records_in_range(io.BytesIO(data), len(data), start, min(len(data), start + size))
        assert cut == whole
    # Magic in stored bytes and garbage between members is no record.
    noise = warc.MAGIC + b"\x00" * 40
    mixed = noise + made[0] + noise + made[1]
    assert len(list(warc.records_in_range(io.BytesIO(mixed), len(mixed), 0, len(mixed)))) == 2


def member(text, level=6):
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text if isinstance(text, bytes) else text.encode()) + packer.flush()


def foreign(kind, block, *more, uri="<urn:uuid:1>"):
    head = ["WARC/1.0", f"warc-type: {kind}", f"WARC-RECORD-ID:{uri}", *more, f"content-length:  {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
FOREIGN = [
    foreign("warcinfo", b"software: x\r\n"),
    foreign("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
    foreign("response", HTTP + b"body", "Content-Type: application/http;", " msgtype=response", "WARC-Target-URI: <http://a/\r\n\tb>", uri="<urn:uuid:2>"),
    foreign("metadata", b"a: b\r\n", "no colon here", "WARC-Concurrent-To: <urn:uuid:2>"),
    foreign("resource", b"plain", "WARC-Payload-Digest: SHA1:" + base64.b32encode(hashlib.sha1(b"plain").digest()).decode().lower()),
    foreign("response", HTTP + b"hashed", "Content-Type: application/http", "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"hashed").hexdigest()),
    foreign("revisit", HTTP, "WARC-Refers-To: <urn:uuid:2>", "WARC-Payload-Digest: sha1:X"),
    foreign("later-type", b"\xff\xfe"),
]
PAYLOADS = [b"software: x\r\n", b"", b"body", b"a: b\r\n", b"plain", b"hashed", None, b"\xff\xfe"]


def archive(spark, data):
    from pyarrow import fs

    folder = session.scratch(spark, "foreign")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/a.warc.gz", compression=None) as out:
        out.write(data)
    return spark.createDataFrame([(f"{folder}/a.warc.gz", len(data))], "file string, bytes long")


@pytest.mark.parametrize("split_bytes", [61, 8 << 20])
def test_archives_of_other_writers(spark, split_bytes):
    files = archive(spark, b"".join(map(member, FOREIGN)) + member(b"".join(FOREIGN)))
    rows = warc.read_archives(files, split_bytes).orderBy("offset", "number").collect()
    assert [r.payload and bytes(r.payload) for r in rows] == [p and bytes(p) for p in PAYLOADS * 2]
    assert [r.record_type for r in rows[:8]] == ["warcinfo", "request", "response", "metadata", "resource", "response", "revisit", "later-type"]
    assert all(r.problem is None for r in rows)
    assert (rows[2].id, rows[2].url) == ("<urn:uuid:2>", "http://a/ b") and rows[6].refers_to == "<urn:uuid:2>"
    assert rows[5].payload_digest == base64.b32encode(hashlib.sha1(b"hashed").digest()).decode() and rows[6].payload_digest == "X"
    assert warc.losses(files, spark.createDataFrame(rows, warc.RECORDS)).count() == 0


@pytest.mark.parametrize("split_bytes", [61, 8 << 20])
def test_damaged_archives_are_noticed(spark, split_bytes):
    good = [member(foreign("resource", bytes([97 + i]) * 50)) for i in range(3)]
    cut = {
        "flipped": good[0] + good[1][:20] + bytes([good[1][20] ^ 255]) + good[1][21:] + good[2],
        "truncated": good[0] + good[1] + good[2][:-9],
        "between": good[0] + b"noise" + good[1] + good[2],
    }
    for name, data in cut.items():
        files = archive(spark, data)
        records = warc.read_archives(files, split_bytes)
        lost = warc.losses(files, records).collect()
        assert len(lost) == 1 and lost[0].records == (3 if name == "between" else 2), name
        with pytest.raises(ValueError, match="a.warc.gz"):
            warc.resolved(records, "string", files)
    wrong = [
        foreign("resource", b"x", "WARC-Payload-Digest: sha1:" + "A" * 32),
        b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nxyz",
        foreign("resource", b"long").replace(b"content-length:  4", b"content-length:  9999"),
        foreign("resource", b"long").replace(b"content-length:  4", b"content-length:  minus"),
    ]
    files = archive(spark, b"".join(map(member, wrong)) + good[0])
    rows = warc.read_archives(files, split_bytes).orderBy("offset").collect()
    assert [r.problem is None for r in rows] == [False] * 4 + [True]
    assert warc.losses(files, spark.createDataFrame(rows, warc.RECORDS)).first().problems == 4
    # A manifest that names more records than there are.
    more = archive(spark, good[0]).withColumn("records", F.lit(2).cast("long"))
    assert warc.losses(more, warc.read_archives(more)).count() == 1


# Packing


def test_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    own = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["", " ", "a <|endoftext|> b", "I'll we've 'S 123 4 \n\n\t x", "ñandú 😀 ß​\u0000", "a" * 5000, *["".join(rng.choices("ab1 .,\n'sé字", k=80)) for _ in range(200)]]
    for t in texts:
        assert packing.token_ids(t, path).tolist() == own.encode(t, add_special_tokens=False).ids + [0]


def test_packed_pieces_rebuild_the_documents(spark):
    rng = random.Random(7)
    texts = [None, "", "x", *[" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 60))) for _ in range(200)], "long text " * 4000]
    rows = [(i + (1 << 60), t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    length, path = 64, packing.public_tokenizer()
    got = packing.pack(df, length=length, group_rows=90, keep_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length <= length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        by[r.doc_id].append(r)
    for i, t in rows:
        ids = packing.token_ids(t, path).tolist()
        mine = sorted(by[i], key=lambda r: r.piece)
        if i != 5:
            assert [x for r in mine for x in r.ids] == ids
            assert [r.start for r in mine] == [sum(m.length for m in mine[:j]) for j in range(len(mine))]
            assert len(mine) == math.ceil(len(ids) / length) and all(r.length == length for r in mine[1:])
    assert len(by[5]) == 2
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / length * 1.03) + 3
    assert packing.pack(df.limit(0)).count() == 0


def test_ids_stay_out_of_the_groups(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), int(id % 40)) AS text")
    kind, seen = type(df.groupBy("doc_id")), []
    apply = kind.applyInPandas
    monkeypatch.setattr(kind, "applyInPandas", lambda self, f, schema: seen.append(schema.names) or apply(self, f, schema))
    packed = packing.pack(df, length=32, group_rows=100, keep_ids=True)
    got, path = packed.collect(), packing.public_tokenizer()
    assert packed.schema["ids"].dataType.simpleString() == "array<bigint>"
    assert seen and not any("ids" in names for names in seen)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        by[r.doc_id] += r.ids
    assert dict(by) == {r.doc_id: packing.token_ids(r.text, path).tolist() for r in df.collect()}
    places = Counter((r.sequence_id, r.offset + i) for r in got for i in range(r.length))
    assert max(places.values()) == 1 and max(at for _, at in places) < 32


def test_sum_of_squares_choices_equal_brute_force():
    rng = random.Random(11)
    sizes = [rng.randint(1, 20) for _ in range(300)]
    where, offset = packing.sum_of_squares(np.array(sizes), 20)
    gaps: dict[int, int] = {}
    for s, w, o in zip(sizes, where.tolist(), offset.tolist()):
        count = Counter(g for g in gaps.values() if g)
        if w in gaps:
            assert o == 20 - gaps[w]

            def squares(gap, count=count, s=s):
                after = count.copy()
                after[gap] -= 1
                after[gap - s] += 1
                after[0] = 0
                return sum(n * n for n in after.values())

            fits = {g for g in count if g >= s}
            assert squares(gaps[w]) == min(map(squares, fits))
        else:
            assert not any(g >= s for g in count) and o == 0
        gaps[w] = 20 - o - s


def test_jaccard_groups_of_near_copies(spark):
    """Copies 82 to 95 percent like a base that is or is not there, two chained bases, and texts that share a passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(25)]
    rows = []
    for at, (n, with_base) in enumerate(((120, True), (100, False))):
        base = [word() for _ in range(n)]
        middle = [w if i >= 6 else word() for i, w in enumerate(base)]
        members = [base, middle] if with_base else []
        for source in (base, middle, [*middle[:-5], *(word() for _ in range(5))]):
            for _ in range(45):
                copy = list(source)
                for i in rng.sample(range(n), rng.choice([1, 1, 2, 3, 4, 6, 8])):
                    copy[i] = rng.choice([word(), copy[i] + "x", passage[i % 25]])
                members.append(copy)
        rows += [(1000 * at + i, " ".join(m)) for i, m in enumerate(members)]
    rows += [(5000 + i, " ".join([*passage, *(word() for _ in range(rng.choice([0, 1, 2, 3, 40])))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for width, percent, hot_df in ((3, 90, 3), (5, 80, 24)):
        want = {i: g for i, (_, g) in brute_groups(dict(rows), width, percent).items()}
        got = jaccard.near_duplicates(docs, width=width, percent=percent, hot_df=hot_df).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_mixture_spends_exactly_on_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(10))
    same = [(1, text, "en", "a")] * 50
    some = [(i, " ".join(["x"] * (i % 7 + 1)), "en", "a") for i in range(2, 80)]
    for rows, budget in ((same, 100), (same, 95), (same, 500), (same, 1234), (same + some, 333)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
        weights = {"domain": {}, "lang": {}, "source": {}}
        taken = mixture.mix(docs, weights, F.lit("d"), budget=budget, max_epochs=4, seed=3).collect()
        assert sum(r["mix_used"] for r in taken) == budget
        assert all(0 < r["mix_used"] <= r["mix_tokens"] for r in taken)
        assert sum(r["mix_used"] < r["mix_tokens"] for r in taken) <= 1


def test_jaccard_bound_keeps_every_link():
    """The test on two orders loses no link, and drops most pairs that are none."""
    rng = random.Random(3)
    lost = links = dropped = others = 0
    for percent in (90, 80, 50):
        for _ in range(300):
            n = rng.choice([1, 2, 5, 20, 60, 300])
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, n // 12, n // 6, n])):
                copy[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
            token, begins = jaccard.token_sets(pa.array([" ".join(base), " ".join(copy)]), 1)
            size = np.diff(begins)
            keys = [jaccard.first_keys(token, begins, jaccard._LISTS[k][1](size, percent), jaccard._LISTS[k][0]) for k in ("k1", "k2")]
            a, b = (jaccard._Keyed(int(size[i]), *(k[i].values.to_numpy() for k in keys), percent) for i in (0, 1))
            x, y = (set(token[begins[i] : begins[i + 1]].tolist()) for i in (0, 1))
            if 100 * len(x & y) >= percent * len(x | y):
                links, lost = links + 1, lost + (not jaccard._agree(a, b, percent))
            else:
                others, dropped = others + 1, dropped + (not jaccard._agree(a, b, percent))
    assert links > 200 and lost == 0 and 2 * dropped > others


def test_parity_maps_lose_no_link_and_drop_most_others():
    rng = random.Random(6)
    links = lost = others = dropped = 0
    for percent in (80, 90):
        for _ in range(300):
            n = rng.choice([1, 2, 5, 20, 60, 300, 700])
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            copy = base + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, n // 8, n]))]
            for _ in range(rng.choice([0, 1, 2, 3, n // 12, n // 6, n])):
                copy[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
            token, begins = jaccard.token_sets(pa.array([" ".join(base), "", " ".join(copy)]), 1)
            x, y = (set(token[begins[i] : begins[i + 1]].tolist()) for i in (0, 2))
            a, none, b = jaccard.parity_maps(token, begins).to_pylist()
            assert not any(none) and jaccard.least_apart(a, a) == 0
            assert jaccard.least_apart(a, b) == jaccard.least_apart(b, a) <= len(x ^ y)
            pair = pd.DataFrame({"a": [1], "b": [2], "na": [len(x)], "nb": [len(y)], "ma": [a], "mb": [b]})
            gone = next(jaccard._near(percent)(iter([pair]))).empty
            if 100 * len(x & y) >= percent * len(x | y):
                links, lost = links + 1, lost + gone
            else:
                others, dropped = others + 1, dropped + gone
    assert links > 150 and lost == 0 and 10 * dropped > 9 * others
