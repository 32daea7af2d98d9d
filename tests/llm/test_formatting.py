from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tideline.llm import canonical, formatting
from tideline.llm.canonical import kind, words

SCHEMA = "seq bigint, original_text string, key string, rep int, members string"


def _copies(rows):
    first, out = {}, set()
    for seq, text in sorted((s, t) for s, t in rows if s is not None and t is not None):
        k = kind(text)
        if k in first:
            out.add((first[k], seq))
        first.setdefault(k, seq)
    return out


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Straße — 5", "STRASSE 5", True), ("5.5", "55", False), ("5,5", "5.5", False), ("a. b", "ab", True), ("éa", "éa", True), ("in­ter", "inter", True),
        ("５ km", "5KM", True), ("a 5. b", "a5b", True), ("1​.5", "1.5", True), ("", " \n…", True), ("abc", "abd", False),
        ("Speaker: A b | Quote: C.", '{"quote": "c", "speaker": "A  B"}', True), ("* SPEAKER - a\n* QUOTE - c", "Quote: C\r\nspeaker: A", True),
        ("Speaker: A | Quote: C", "Speaker: C | Quote: A", False), ('{"a": "x\\"y", "b": "z"}', 'b: z | a: xy', True), ("a: x | free text", "free text a: x", False),
    ],
)
def test_kind(a, b, same):
    assert (kind(a) == kind(b)) is same


@given(st.text())
def test_kind_ignores_layout(s):
    assert kind(s) == kind(s + " ​!") or "\n" in s or "|" in s or "{" in s
    assert all(w.isalnum() for w in words(s))


@given(st.lists(st.binary(max_size=20)))
def test_trie_counts(keys):
    trie, want = formatting.Trie(), defaultdict(list)
    at = [trie.add(k, i) for i, k in enumerate(keys)]
    for i, k in enumerate(keys):
        want[k].append(i)
    assert [trie.first[x] for x in at] == [min(want[k]) for k in keys]
    assert [trie.count[x] for x in at] == [len(want[k]) for k in keys]


@pytest.mark.parametrize("bucket_rows", [1, 7, 20000])
def test_copies_with_hot_text_and_nulls(spark, sentence, bucket_rows):
    rng = random.Random(5)
    texts = [sentence(rng) for _ in range(40)] + [None, "", "!!", "x" * 20000]
    rows = [(i, rng.choice([texts[0], texts[0].upper(), *rng.sample(texts, 2)])) for i in range(300)] + [(None, texts[0])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1, "m") for r in rows], SCHEMA).repartition(5)
    want = _copies(rows)
    got = [(r.first_seq, r.copy_seq) for r in formatting.copies(df, bucket_rows=bucket_rows).collect()]
    assert len(got) == len(want) and set(got) == want
    kinds = defaultdict(int)
    for s, t in rows:
        if s is not None and t is not None:
            kinds[kind(t)] += 1
    assert sorted(r.copies for r in formatting.records(df, bucket_rows=bucket_rows).collect()) == sorted(kinds.values())


def test_hot_text_over_many_blocks(spark, monkeypatch):
    """A third of all rows has one text, in 40 blocks, and the text's bucket is dealt into parts."""
    rows = [(i, "The HOT text" if i % 3 == 0 else f"text {i // 6}", "c") for i in range(600)]
    df = spark.createDataFrame(rows, "seq bigint, original_text string, text string").repartition(40)
    got = {(r.first_seq, r.copy_seq) for r in formatting.copies(df, bucket_rows=5).collect()}
    firsts: dict[str, int] = {}
    assert got == {(firsts[t], i) for i, t, _ in rows if firsts.setdefault(t, i) != i}
    counted = {r.first_seq: r.copies for r in formatting.records(df, bucket_rows=5).collect()}
    assert counted[0] == 200 and sum(counted.values()) == 600
    monkeypatch.setattr(formatting, "BLOCK_BYTES", 400)  # ids count towards a block
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["hot"] * 600)], ["id", "text"])
    sizes = [len(m) for b in formatting._groups(iter([batch])) for m in b.column(2).to_pylist()]
    assert max(sizes) <= 50 and sum(sizes) == 600


LAYOUTS = [
    "Name: Ann\nAge: 5\nCity of first residence: Rome", "City of first residence = Rome; Age = 5; Name = Ann", "Name: Ann\tAge: 5\tCity of first residence: Rome",
    "Age: 5, Name: Ann, City of first residence: Rome", '{"age": 5, "name": "Ann", "city of first residence": "Rome"}', "• Name - Ann | • Age - 5 | • City of first residence - Rome",
]


def test_layouts_of_fields():
    assert len({canonical.kind(t) for t in LAYOUTS}) == 1
    assert canonical.kind("He said: no, she said yes") == canonical.kind("he said no she said YES")


def test_empty(spark):
    assert formatting.copies(spark.createDataFrame([], SCHEMA)).collect() == []


@given(st.text(st.sampled_from("aÉß1.,5 \n|:{}-\"é​Ａ")))
def test_kind_and_words_is_both(s):
    from tideline.llm.canonical import kind_and_words

    assert kind_and_words(s) == (kind(s), words(s))
