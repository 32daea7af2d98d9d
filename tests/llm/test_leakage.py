from __future__ import annotations

import random

import pytest

from tideline.llm import leakage
from tideline.llm.canonical import words


def _brute(docs, items, n=12):
    out = []
    for d, text in docs:
        grams = {tuple(w[k : k + n]) for w in [words(text)] for k in range(len(w) - n + 1)}
        out += [(d, i) for i, t in items if d is not None and i is not None and any(tuple(v[k : k + n]) in grams for v in [words(t)] for k in range(len(v) - n + 1))]
    return sorted(out)


@pytest.fixture
def data():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 12, 30])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, items[1][1]), (None, items[2][1]), (53, "straße " * 12)]
    docs = []
    for d in range(80):
        w = [rng.choice(vocabulary + ["other"]) for _ in range(rng.randrange(40))]
        source = (items[rng.randrange(12)][1]).split()
        at = rng.randrange(len(source))
        w[len(w) // 2 : len(w) // 2] = source[at : at + rng.choice([5, 11, 12, 20])]
        docs.append((d, rng.choice([" ", ", ", "\n<b>"]).join(w).upper()))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "STRASSE-" * 12), (1, docs[1][1])]
    return docs, items


@pytest.mark.parametrize("set_grams", [3, 2_000_000])
def test_leaks_equal_brute_force(spark, data, set_grams):
    docs, items = data
    left = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, item_id string").repartition(3)
    right = spark.createDataFrame(items, "item_id bigint, text string")
    got = leakage.leaks(left, right, set_grams=set_grams).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == _brute(docs, items)
    clean = leakage.cleaned(left, right, set_grams=set_grams).collect()
    assert len(clean) == len(docs)
    texts = dict(docs)
    leaked = {d for d, _ in _brute(docs, items)}
    for r in clean:
        if r.doc_id in leaked:
            assert r.leaked_spans > 0 and len(r.text) < len(texts[r.doc_id])
        elif r.doc_id is not None:
            assert r.leaked_spans == 0 and r.text == texts[r.doc_id]


def test_cleaned_span():
    grams = leakage.Grams(3)
    grams.add(1, "b c d e")
    text, spans = leakage._cleaned("A  b, C (d) e! f  b c x", grams)
    assert spans == 1 and " ".join(text.split()) == "A f b c x"


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a " * 12)], "item_id bigint, text string")
    assert leakage.leaks(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a " * 12)], "doc_id bigint, text string")
    assert leakage.leaks(docs, items.limit(0)).collect() == []
