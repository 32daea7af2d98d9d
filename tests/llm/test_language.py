from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from tideline.llm import language

SF = Path("/root/testdata/sf0.001/radar_events.parquet")
TEXTS = {
    "de": "Die nationale Schachliga kämpft jeden Tag mit den vergessenen Lehrlingen und der Verlag wird sich nie erholen von der Reparatur der Brücke.",
    "en": "The youth orchestra has always depended on the winter fuel shortage and every small publisher keeps ignoring the promised bridge repairs.",
    "es": "La panadería de mi abuela no puede vivir lejos del tercer recorte del presupuesto y la cosecha de este año ya no quiere hablar de las quejas.",
    "ru": "Шахматная лига устало ждёт поспешного обновления после множества жалоб и никогда не оправится от пустых улиц января.",
}


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("en-US", "en"), ("eng", "en"), ("German", "de"), ("pt_BR", "pt"), ("", None), (None, None), ("und", None), ("nl", None), ("n/a", None), (" fre ", "fr")])
def test_named(label, code):
    assert language.named(label) == code


def _rows():
    rows = [(i, t, c, "x") for c, t in TEXTS.items() for i in range(ord(c[0]) * 1000 + ord(c[1]) * 10, ord(c[0]) * 1000 + ord(c[1]) * 10 + 30)]
    return rows + [
        (1, TEXTS["de"], "en", "x"), (2, TEXTS["es"], None, "x"), (3, TEXTS["en"] + " / " + TEXTS["de"], "en", "x"), (4, TEXTS["en"] + " (Kindergarten) @straßenbahn", "English", "x"),
        (5, None, "en", "x"), (6, " \n", None, "x"), (None, TEXTS["de"], "en", "x"), (7, (TEXTS["ru"] + " ") * 200, "ru", "x"),
    ]


def test_labels_and_segments(spark):
    df = spark.createDataFrame(_rows(), "seq bigint, original_text string, language string, text string")
    got = sorted((r.seq, r.lang) for r in language.mislabelled(df).collect())
    assert got == [(1, "de"), (2, "es"), (3, "de"), (3, "en")]
    segments = {(r.seq, r.segment_no): r for r in language.labelled(df).collect() if r.seq is not None and r.seq < 10}
    assert [segments[(3, i)].lang for i in range(2)] == ["en", "de"] and all(0 < r.confidence <= 1 for r in segments.values())
    assert not any(s in (5, 6) for s, _ in segments)


NOTHING = ["12345 67.8", "🔥🔥 https://a.example/the-story-of-the-day", "@anna_lena #dertag @theman", "日本の新しい図書館は今日開きました。", "Η νέα βιβλιοθήκη άνοιξε σήμερα στην πόλη.", "...", "١٢٣"]


def test_no_evidence_no_language(spark):
    rows = _rows() + [(100 + i, t, None, "x") for i, t in enumerate(NOTHING)]
    df = spark.createDataFrame(rows, "seq bigint, original_text string, language string, text string")
    assert not [r for r in language.mislabelled(df).collect() if 100 <= r.seq < 200]
    segments = [r for r in language.labelled(df).collect() if r.seq is not None and 100 <= r.seq < 200]
    assert len(segments) >= len(NOTHING) and all(r.lang is None and r.confidence == 0 for r in segments)


def test_many_letters():
    profiles = language.Profiles("".join(map(chr, range(0x4E00, 0x4E00 + 200))))
    texts = ["".join(chr(0x4E00 + (k * 7 + i) % 100 + 100 * h) for i in range(60)) for h in (0, 1) for k in range(30)]
    profiles.train(texts, ["en"] * 30 + ["ru"] * 30)
    assert (profiles.cosines(texts)[0].argmax(axis=1) == [1] * 30 + [6] * 30).all()


def test_empty(spark):
    df = spark.createDataFrame([], "seq bigint, original_text string, language string")
    assert language.mislabelled(df).collect() == [] and language.labelled(df).collect() == []


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_held_out_accuracy_and_confidence(spark):
    """Against labels of the other half that the text's best language does not deny, and of all; confidences as often right as they say."""
    df = spark.read.parquet(str(SF))
    profiles = language.fit(df.where("pmod(seq, 2) = 0"))
    rows = [(r.original_text, language.named(r.language)) for r in df.where("pmod(seq, 2) = 1").select("original_text", "language").collect()]
    rows = [(t, c) for t, c in rows if c]
    _, ways, _, _, _ = language.label_texts(profiles, [t for t, _ in rows])
    right = sum(language.LANGUAGES.index(c) in way for (_, c), way in zip(rows, ways, strict=True))
    assert right / len(rows) > 0.93
    parts = [(language._plain(p), c) for (t, c), way in zip(rows, ways, strict=True) if set(way) == {language.LANGUAGES.index(c)} for p in language.segments(t)]
    cosines, norms, _ = profiles.cosines([p for p, _ in parts])
    share = profiles.confidence(cosines[norms > 0])
    hit = share.argmax(axis=1) == np.array([language.LANGUAGES.index(c) for (_, c), n in zip(parts, norms, strict=True) if n > 0])
    assert abs(share.max(axis=1).mean() - hit.mean()) < 0.05
