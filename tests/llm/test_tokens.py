from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import pieces, tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary")
# Fixed value: the pre-token pattern of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIGNS = st.text(st.sampled_from("ab'strelvmd  \n\t\r.,1²Ⅷ٣!…\x85​日😀　ſ’_-"), max_size=40)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokens.encoder(PATH).ranks, special_tokens={})


def _ids(texts):
    ids, at = tokens.encoder(PATH).encode_batch(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(SIGNS)
def test_equal_to_reference(reference, text):
    assert _ids([text, None, "", text]) == [reference.encode_ordinary(text), [], [], reference.encode_ordinary(text)]


def test_forgetting_and_blocks(reference, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(f"{rng.choice('abc')}{rng.randrange(10**6)}" for _ in range(50)) for _ in range(60)] + ["a" * 5000, "<|endoftext|>"]
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    monkeypatch.setattr(tokens, "CUT_CHARS", 1000)
    replay = tokens.MergeReplay(PATH)
    for k in range(0, len(texts), 7):
        ids, at = replay.encode_batch(texts[k : k + 7])
        replay.rest()
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in texts[k : k + 7]]


def test_encode_query(spark, reference):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "Hello  world", "x"), (4, "<|endoftext|>", "x")]
    got = sorted((r.doc_id or 0, r.ids) for r in tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect())
    assert got == sorted((i or 0, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def _text(rng, n):
    return "".join(rng.choice(["Some words here. ", "More of it, then! ", "a line\n", "\n\n", "日本語のテキスト", "x" * rng.randrange(80), "  ", "it's "]) for _ in range(n))


def _check(texts, limit=512, overlap=64, least=224):
    replay = tokens.encoder(PATH)
    found = dict(pieces.split_texts(replay, texts, limit, overlap, least))
    for i, text in enumerate(texts):
        n = len(_ids([text])[0])
        assert (i in found) == (n > limit)
        if i not in found:
            continue
        cut = found[i]
        assert "".join(text[new:end] for _, new, end, _ in cut) == text
        whole, shared = [], []
        for k, (start, new, end, count) in enumerate(cut):
            assert start <= new < end and (k == 0 or new == cut[k - 1][2]) and (k > 0 or start == 0)
            whole.append(text[start:end])
            shared.append(text[start:new])
            assert len(_ids([whole[-1]])[0]) == count <= limit
        assert all(len(x) <= overlap for x in _ids(shared))
    return found


def test_words_with_one_hash_stay_apart():
    """A Thue-Morse word and its complement have equal polynomial hashes modulo a power of two."""
    for n in (512, 1024, 2048, 4096):
        morse = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = morse.translate(str.maketrans("ab", "ba"))
        texts = [morse, other, f"{other} {morse} {other}", morse]
        replay = tokens.MergeReplay(PATH)
        for some in (texts, texts[::-1]):  # within a block and against those remembered
            flat, where = replay.encode_batch(some)
            assert [flat[a:b].tolist() for a, b in zip(where, where[1:], strict=False)] == _ids(some)


def test_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [_text(rng, rng.randrange(400)) for _ in range(60)] + [None, "", "x" * 9000, "😀" * 2000, " " * 4000, "\n" * 3000, "ab " * 3000, "日本" * 1500, "- " * 2000]
    _check(texts)
    _check(texts, 64, 8, 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(SIGNS, max_size=30))
def test_pieces_of_anything(parts):
    _check(["".join(parts)], 32, 6, 10)


def test_edit_moves_only_neighbours():
    """A sentence put into a text of some 40 pieces changes two of them on average at most."""
    rng = random.Random(8)
    replay = tokens.encoder(PATH)
    changed = []
    for _ in range(30):
        text = " ".join(f"Sentence {rng.randrange(10**5)} tells of {rng.choice('abcdefgh') * 3} and {rng.choice('uvwxyz') * 2} more." for _ in range(900))
        at = text.index(". ", rng.randrange(len(text) * 9 // 10)) + 2
        texts = text, text[:at] + "A new sentence comes in here. " + text[at:]
        one, two = ({t[s:e] for s, _, e, _ in dict(pieces.split_texts(replay, [t], 512, 64, 224))[0]} for t in texts)
        assert len(two) > 20
        changed.append(len(two - one))
    assert np.mean(changed) <= 2, changed


def test_long_words_are_cut_between_graphemes():
    replay = tokens.encoder(PATH)
    family, marked = "\U0001f469\u200d\U0001f469\u200d\U0001f467", "e\u0301\u0323"
    for sign in (family, marked):
        text = sign * 1500
        cut = dict(pieces.split_texts(replay, [text], 512, 64, 224))[0]
        assert all(s % len(sign) == 0 and n % len(sign) == 0 for s, n, _, _ in cut)
    assert _check(["a" + "\u0301" * 9000])  # one grapheme beyond all bounds


def test_split_query(spark):
    rows = [(1, "A sentence of words. " * 400, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (None, "More words. " * 500, "x"), (1, "A sentence of words. " * 400, "x")]
    got = pieces.split(spark.createDataFrame(rows, "doc_id bigint, text string, piece string")).collect()
    assert {r.doc_id for r in got} == {1, None}
    assert all(r.n_tokens <= 512 and r.char_end - r.char_start == len(r.piece) for r in got)
    assert np.mean([r.piece.rstrip().endswith(".") for r in got]) > 0.9
    assert pieces.split(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
