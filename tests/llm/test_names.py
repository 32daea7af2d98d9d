from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from tideline.llm import names

SCHEMA = "author_id string, author_display_name string, author_handle string, name string, node string"


@pytest.mark.parametrize(
    ("display", "want"),
    [("Dr. Ann B. Lee, PhD", "ann b lee"), ("ØRSTAD  Éva", "orstad eva"), ("JaskoCoastLedger", "jasko coast ledger"), ("The X & Sons Dept. (official)", "x sons department"), ("Lee, KF", "lee k f"), (None, ""), ("🔥", "")],
)
def test_spelling(display, want):
    assert names.spelling(display) == want


@pytest.mark.parametrize(
    ("variant", "canon", "links"),
    [
        ("pascoe haskingwick", "pascoe haskingwick", True), ("haskingwick pascoe", "pascoe c haskingwick", True), ("p haskingwick", "pascoe haskingwick", True),
        ("pascoe haskngwick", "pascoe haskingwick", True), ("bob ruskerez", "robert ruskerez", True), ("jcsa", "jaskav coast savings association", True),
        ("mona haskingwick", "pascoe haskingwick", False), ("pascoe ruskerez", "pascoe haskingwick", False), ("jaskav harbor savings association", "jaskav coast savings association", False),
        ("mictael trouvlport", "michael t trovulport", True), ("t h caldembvale", "thandeka c harvollova", False),
    ],
)
def test_channel(variant, canon, links):
    assert (names.channel(variant, canon) <= names.LIMIT) is links


def test_entities(spark):
    people = {
        "a": [("a1", "Pascoe Haskingwick", "pascoehaskingwick"), ("a2", "HASKINGWICK, P.", "notes_123"), ("a3", "Pascoe Haskingwcik", None), ("a4", "Dr. Pascoe C. Haskingwick", "@p_haskingwick")],
        "b": [("b1", "Mona Haskingwick", "mona.haskingwick"), ("b2", "M. Haskingwick", None)],
        "c": [("c1", "Jaskav Coast Savings Association", None), ("c2", "JCSA", "jaskavcoastsavingsassociation"), ("c3", "Coast Savings Assn., Jaskav", None)],
        "d": [("d1", None, None)], "e": [("e1", None, "ines_marvez"), ("e2", "Ines Marvez", None)], "f": [("f1", "🔥", "daily_1")],
    }
    rows = [(*x, "clash", "clash") for v in people.values() for x in v for _ in range(3)] + [(None, "Pascoe Haskingwick", None, "c", "c")]
    rows += [("a1", "PASCOE  haskingwick", None, "c", "c"), ("a1", "Pasoce Haskingwick", None, "c", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = defaultdict(set)
    for r in names.entities(df).collect():
        found[r.entity].add(r.author_id)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x[0] for x in v) for v in people.values())
    pairs = [(r.author_id_a, r.author_id_b) for r in names.pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) == 6 + 1 + 3 + 1 and all(a < b and a[0] == b[0] for a, b in pairs)


def test_hot_author_and_surname(spark):
    rows = [("hot", f"Ann Leestad{'x' * (i % 2)}", "annleestad", "", "") for i in range(500)]
    rows += [(f"s{i}", f"{chr(97 + i % 26) * 4}{chr(97 + i // 26) * 3} Leestad", None, "", "") for i in range(120)] + [("t1", "Aaaaaaa Leestda", None, "", "")]
    found = {r.author_id: r.entity for r in names.entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["t1"] == found["s0"] and found["hot"] == "hot" and len(found) == 122


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert names.entities(df).collect() == [] and names.pairs(df).collect() == []


def test_edits():
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("abcd", "", 2) == 3 and names.edits("kitten", "sitting", 3) == 3
    assert names.channel("x", "y") == math.inf


def _linked(spark, rows):
    found = {r.author_id: r.entity for r in names.entities(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    return lambda a, b: found[a] == found[b]


def test_frequent_tokens_keep_their_candidates(spark):
    rows = [(f"s{i}", f"{chr(97 + i % 25) * 4}{chr(97 + i // 25) * 3} Smithson", None) for i in range(60)]
    rows += [(f"m{i}", f"Maren {chr(97 + i % 25) * 4}{chr(97 + i // 25) * 3}", None) for i in range(60)]
    rows += [("a", "Zebedee Smithson", None), ("b", "Z. Smithson", None), ("c", "Smithson, Z", "zsmithson"), ("d", "Maren Zyskowitz", None), ("e", "Maren Z.", None)]
    same = _linked(spark, rows)
    assert same("a", "b") and same("a", "c") and same("d", "e") and not same("a", "d") and not same("a", "s0")


def _misspell(rng, t):
    i = rng.randrange(len(t) - 1)
    return rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice("aeknz") + t[i:], t[:i] + "q" + t[i + 1 :], t[:i] + t[i + 1] + t[i] + t[i + 2 :]])


def test_accepted_pairs_share_a_key():
    rng = random.Random(5)
    first, last = ["ann", "alexander", "maren", "robert", "john", "zebedee", "chris"], ["lee", "smith", "berg", "pascoe", "ormerson", "haskingwick", "association", "coast"]
    accepted = 0
    for _ in range(20000):
        name = [rng.choice(first), *rng.choice([[], [], ["q"], ["coast"]]), rng.choice(last)]
        other = [rng.choice([t, t, t[0], t[:4], rng.choice(names._NICKNAMES.get(t, t).split()), _misspell(rng, t) if len(t) > 3 else t]) for t in name]
        rng.shuffle(other)
        if names.channel(" ".join(other), " ".join(name)) <= names.LIMIT:
            accepted += 1
            assert names.keys(" ".join(other), "") & names.keys(" ".join(name), ""), (name, other)
    assert accepted > 5000


def test_names_in_one_word_meet_in_spite_of_an_edit(spark):
    rng = random.Random(6)
    for name in ("anna berg", "pascoe ormerson", "bram q caldan", "jaskav coast savings association"):
        tokens = name.split()
        for _ in range(300):
            k = rng.randrange(len(tokens))
            word = _misspell(rng, "".join(tokens[k:] + tokens[:k]))
            assert names.channel(word, name) > names.LIMIT or names.keys(word, "") & names.keys(name, ""), (word, name)
    same = _linked(spark, [("a", "Pascoe Ormerson", None), ("b", "pascoeormarson", None), ("c", "Anna Berg", None), ("d", "annaberg", None), ("e", "bergaena", "notes_12"), ("f", "Anna Borgman", None)])
    assert same("a", "b") and same("c", "d") and same("c", "e") and not same("a", "c") and not same("c", "f")


def test_names_of_one_short_word(spark):
    rows = [("a", "Reuters", "reuters"), ("b", "Reuters", None), ("c", "Reuters", "reutersworld"), ("d", "Rueters", None), ("e", "Reuters", "mariasilva")]
    rows += [("f", "Zaz", "zazmusic"), ("g", "ZAZ", None), ("h", "Zak", None), ("i", "JCSA", None), ("j", "JCSA", "jcsa"), ("k", "Jaskav Coast Savings Association", None)]
    same = _linked(spark, rows)
    assert same("a", "b") and same("a", "c") and same("a", "d") and not same("a", "e")
    assert same("f", "g") and not same("f", "h") and same("i", "k") and same("j", "k")
