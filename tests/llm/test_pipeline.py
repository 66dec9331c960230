"""The pipeline stage by stage on a small table, and the registry of queries."""

import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from isopleth.llm import packing
from tests.llm.test_table_operators import brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    letters = {"en": "abcdefgh", "de": "mnopqrsü"}
    text = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(n))
    out = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        out.append((i, text(lang, rng.randint(20, 90)), lang, "src0" if i % 2 else f"s{i % 5}"))
    out += [(200 + i, out[i][1], out[i][2], "s9") for i in range(10)]  # copies
    out += [(300 + i, out[i][1] + " zz", out[i][2], "s9") for i in range(10)]  # near copies
    out += [(400, out[5][1][:60] + " password=abcdefgh12 end " + text("en", 40), "en", "s1"), (401, None, "en", "s1"), (402, "12 34", "en", None)]
    return [(*r[:2], *r[2:], len(r[1] or "")) for r in out]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()
    by = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert list(by) == ["language_id", "near_duplicates", "secret_scan", "mixing", "best_fit_packing"]

    kept = by["language_id"](spark, docs, "").cache()
    assert kept.columns == COLUMNS
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {401, 402}
    assert all(r.lang == ("de" if r.doc_id < 120 and r.doc_id % 3 == 0 else r.lang) for r in kept.collect())

    one = by["near_duplicates"](spark, kept, "").cache()
    groups = brute_groups({r[0]: r[1] for r in rows if r[0] not in (401, 402)}, 5, 80)
    assert one.columns == COLUMNS
    assert Counter(r.doc_id for r in one.collect()) == Counter(i for i, (_, g) in groups.items() if g == i)

    clean = by["secret_scan"](spark, one, "").cache()
    before, after = {r.doc_id: r for r in one.collect()}, {r.doc_id: r for r in clean.collect()}
    assert clean.columns == COLUMNS and set(before) == set(after)
    for i, r in after.items():
        want = re.sub(r"password=\S+", "[assign]", before[i].text)
        assert r.text == want and r.n_chars == len(want)

    mixed = by["mixing"](spark, clean, "").cache()
    assert mixed.columns == COLUMNS
    got = [r.doc_id for r in mixed.collect()]
    assert len(got) == len(set(got)) and set(got) <= set(after)
    tokens = lambda ids: sum(len(after[i].text.split()) for i in ids)
    total = tokens(after)
    # Whole documents: each leaf may end in the middle of one.
    assert 0.9 * total - 20 <= tokens(got) <= 0.9 * total + 12 * 90

    packed = by["best_fit_packing"](spark, mixed, "").collect()
    length = defaultdict(int)
    for r in packed:
        length[r.doc_id] += r.length
    path = packing.public_tokenizer()
    assert dict(length) == {i: len(packing.token_ids(after[i].text, path)) for i in got}


def test_every_operator_is_registered_once():
    names = [re.match(r"op(\d+)_", n)[1] for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(map(int, names)) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
