"""Evaluation texts in training text: a broadcast set of the items' word n-grams, scanned by token windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.canonical import words

#: Words in a row that make a leak.
GRAM = 12
#: n-grams of items in one broadcast set; further items are scanned for in further passes, so none is left out.
SET_GRAMS = 2_000_000


class Grams:
    """The n-grams of some items over their own vocabulary; 0 is every other word."""

    def __init__(self, gram: int) -> None:
        self.gram = gram
        self.vocabulary: dict[str, int] = {}
        self.items: dict[tuple[int, ...], tuple[int, ...]] = {}

    def add(self, item: int, text: str | None) -> int:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
        for at in range(len(ids) - self.gram + 1):
            key = tuple(ids[at : at + self.gram])
            held = self.items.get(key, ())
            if item not in held:
                self.items[key] = (*held, item)
        return max(0, len(ids) - self.gram + 1)

    def scan(self, texts: list[list[str]]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """Number of text, first word of the window, items, for each window of texts (as words) that is an item's."""
        get, n = self.vocabulary.get, self.gram
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter((get(w, 0) for t in texts for w in (*t, "")), np.int64, int(lengths.sum()) + len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        unknown = np.concatenate([[-1], np.flatnonzero(ids == 0)])
        for i in np.flatnonzero(np.diff(unknown) > n):
            low, high = int(unknown[i]) + 1, int(unknown[i + 1])
            run = ids[low:high].tolist()
            of = -1
            for at in range(len(run) - n + 1):
                if found := self.items.get(tuple(run[at : at + n])):
                    if of < 0:
                        of = int(np.searchsorted(begins, low, side="right")) - 1
                    yield of, low + at - int(begins[of]), found


def _passes(items: DataFrame, id_col: str, text_col: str, gram: int, most: int) -> Iterator[Grams]:
    grams, size = Grams(gram), 0
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for row in rows.toLocalIterator():
        size += grams.add(row.i, row.t)
        if size >= most:
            yield grams
            grams, size = Grams(gram), 0
    yield grams


def leaks(docs: DataFrame, items: DataFrame, *, gram: int = GRAM, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", set_grams: int = SET_GRAMS) -> DataFrame:
    """doc_id, item_id: the document contains at least gram consecutive words of the item; each pair once for a row.

    A word is a run of letters or digits, without case and in NFKC.  Items shorter than gram words and null or empty
    texts leak nowhere; rows with a null id are left out.  The broadcast set holds at most set_grams n-grams and one
    item: a larger benchmark is scanned for in several passes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for grams in _passes(items, item_id, item_text, gram, set_grams):
        held = docs.sparkSession.sparkContext.broadcast(grams)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                names = pdf["doc_id"].tolist()
                found = {(i, item): None for i, _, some in held.value.scan([words(t) for t in pdf["text"]]) for item in some}
                yield pd.DataFrame({"doc_id": [names[i] for i, _ in found], "item_id": [x for _, x in found]}, dtype="int64")

        part = rows.mapInPandas(run, "doc_id bigint, item_id bigint")
        out = part if out is None else out.union(part)
    return out


def _cleaned(text: str, grams: Grams) -> tuple[str, int]:
    """text without the spans of leaked windows, and the number of spans.

    The text is taken in chunks between white space, which fold by themselves; a span ends with a chunk.
    """
    chunks: list[tuple[int, int]] = []
    at = 0
    for part in text.split():
        at = text.index(part, at)
        chunks.append((at, at + len(part)))
        at += len(part)
    whose: list[int] = []
    found: list[str] = []
    for k, (a, b) in enumerate(chunks):
        w = words(text[a:b])
        found += w
        whose += [k] * len(w)
    bad = sorted({(whose[at], whose[at + grams.gram - 1]) for _, at, _ in grams.scan([found])})
    out, last, spans, reach = [], 0, 0, -1
    for a, b in bad:
        if a > reach:
            out.append(text[last : chunks[a][0]])
            spans += 1
        reach = max(reach, b)
        last = chunks[reach][1]
    out.append(text[last:])
    return "".join(out), spans


def cleaned(docs: DataFrame, items: DataFrame, *, gram: int = GRAM, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", set_grams: int = SET_GRAMS) -> DataFrame:
    """doc_id, text, leaked_spans: every row of docs, its text without the leaked spans.

    Null and empty texts stay as they are with 0 spans; a null id stays null.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"), F.lit(0).cast("int").alias("leaked_spans"))
    for grams in _passes(items, item_id, item_text, gram, set_grams):
        held = docs.sparkSession.sparkContext.broadcast(grams)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts, spans = pdf["text"].tolist(), pdf["leaked_spans"].tolist()
                for i in sorted({i for i, _, _ in held.value.scan([words(t) for t in texts])}):
                    texts[i], n = _cleaned(texts[i], held.value)
                    spans[i] += n
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "leaked_spans": spans})

        rows = rows.mapInPandas(run, "doc_id bigint, text string, leaked_spans int")
    return rows
