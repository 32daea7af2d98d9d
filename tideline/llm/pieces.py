"""Splitting of oversized texts at natural boundaries by content-defined chunking."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.tokens import TOKENIZERS, VOCABULARY, MergeReplay, encoder

#: Tokens of a piece at most, of the overlap at most, and of new text in a piece at least (but for the last one).
LIMIT, OVERLAP, LEAST = 512, 64, 224
#: Pre-tokens of the rolling hash, and pre-tokens from landmark to landmark on average.
WINDOW, SPACING = 8, 48
#: A pre-token of more tokens than this is taken in parts of PART code points or little more, whole graphemes; one of
#: more than GRAPHEME code points is cut itself.
LONG, PART, GRAPHEME = 48, 12, 48

_CLUSTER = regex.compile(r"\X")

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ENDER, _CLOSER, _LINE, _BLANK, _MARK = 1, 2, 4, 8, 16
# Signs that end a sentence, that may follow them, that end a line, that are white space.
_SIGNS = {
    _ENDER: ".!?…。！？",
    _CLOSER: "\"'»”’)]",
    _LINE: "\n\r\u2028\u2029\x85",
    _BLANK: "\t\n\v\f\r \x85\xa0\u2028\u2029\u202f\u3000" + "".join(map(chr, range(0x2000, 0x200B))),
}
_FLAGS = np.zeros(0x110000, np.uint8)
for _flag, _chars in _SIGNS.items():
    _FLAGS[[ord(c) for c in _chars]] |= _flag
_FLAGS[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"]] |= _MARK


def _hashes(first_id: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rolling hash over the WINDOW units before each unit."""
    x = (first_id.astype(np.uint64) + np.uint64(1)) * _BASE ^ (size.astype(np.uint64) << np.uint64(32))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros(len(x) + 1, np.uint64)
    power = np.uint64(1)
    for k in range(1, WINDOW + 1):
        out[k:] += x[: len(x) + 1 - k] * power
        power = np.uint64(int(power) * int(_BASE) % (1 << 64))
    return out ^ (out >> np.uint64(29))


def _near(sorted_at: np.ndarray, target: int, low: int, high: int) -> int:
    """The element nearest to target within low..high, -1 if there is none; the earlier at a tie."""
    a, b = np.searchsorted(sorted_at, low), np.searchsorted(sorted_at, high, side="right")
    if a >= b:
        return -1
    k = int(np.searchsorted(sorted_at, target))
    found = [int(sorted_at[i]) for i in (k - 1, k) if a <= i < b]
    if not found:
        return int(sorted_at[a]) if k <= a else int(sorted_at[b - 1])
    return min(found, key=lambda v: (abs(v - target), v))


def plan(text: str, starts: np.ndarray, tokens: np.ndarray, ids: np.ndarray, limit: int, overlap: int, least: int) -> list[tuple[int, int, int]]:
    """(start, new, end) of each piece as code points: the piece is text[start:end], its own part text[new:end].

    starts, tokens, ids: where each unit begins, how many tokens it has and the first of them.  Cuts lie between
    units, never inside or behind white space that the pre-token rule would then read otherwise.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(starts)
    total = np.concatenate([[0], np.cumsum(tokens)])
    flags = _FLAGS[codes]
    here = flags[starts]
    blank = (here & _BLANK) > 0
    single = np.diff(np.append(starts, len(codes))) == 1
    whole_blank = blank & (single | ((flags[np.minimum(starts + 1, len(codes) - 1)] & _BLANK) > 0))
    can = np.ones(n, bool)
    can[0] = False
    can[1:] &= ~whole_blank[:-1]
    before = flags[starts - 1]
    can &= ~(((here & _MARK) > 0) & ((before & _MARK) == 0))  # a mark stays with its letter
    ended = (before & _ENDER) | (((before & _CLOSER) >> 1) & flags[np.maximum(starts - 2, 0)])
    sentence = np.flatnonzero(can & ((blank & (ended > 0)) | ((here & _LINE) > 0)))
    word = np.flatnonzero(can & blank)
    other = np.flatnonzero(can)
    hashes = _hashes(ids, tokens)[:n]
    landmarks = np.flatnonzero(hashes % np.uint64(SPACING) == 0)
    out: list[tuple[int, int, int]] = []
    begin = new = 0  # units
    while total[n] - total[begin] > limit:
        high = int(np.searchsorted(total, total[begin] + limit, side="right")) - 1
        low = min(int(np.searchsorted(total, total[new] + least)), high)
        k = int(np.searchsorted(landmarks, low))
        at = int(landmarks[k]) if k < len(landmarks) and landmarks[k] <= high else low + int(np.argmin(hashes[low : high + 1]))
        end = -1
        for natural, floor in ((sentence, low), (sentence, new + 1), (word, low), (other, low), (other, new + 1)):
            if (end := _near(natural, at, max(floor, new + 1), high)) >= 0 and (floor == low or total[end] - total[new] >= least // 4 or natural is other):
                break
            end = -1
        if end < 0:
            end = max(high, new + 1)
        out.append((begin, new, end))
        reach = int(np.searchsorted(total, total[end] - overlap))
        again = _near(word, reach, reach, min(end - 1, int(np.searchsorted(total, total[end] - overlap * 3 // 4))))
        k = int(np.searchsorted(other, reach))
        reach = int(other[k]) if k < len(other) and other[k] < end else reach
        begin, new = max(again if again >= 0 else reach, begin + 1) if end > begin + 1 else end, end
        begin = min(begin, new)
    out.append((begin, new, n))
    edge = np.append(starts, len(codes))
    return [(int(edge[a]), int(edge[b]), int(edge[c])) for a, b, c in out]


def _part_edges(word: str) -> list[int]:
    """Where the parts of a long pre-token begin."""
    if word.isascii():
        return list(range(0, len(word), PART))
    out, at = [0], 0
    for m in _CLUSTER.finditer(word):
        if m.start() - at >= PART:
            at = m.start()
            out.append(at)
        for inside in range(m.start() + GRAPHEME, m.end(), GRAPHEME):
            at = inside
            out.append(at)
    return out


def _units(replay: MergeReplay, text: str, starts: np.ndarray, stops: np.ndarray, tokens: np.ndarray, ids: np.ndarray, by_bytes: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pre-tokens with the long ones in parts; a part counts as its own encoding, in those of by_bytes as its bytes."""
    long = np.flatnonzero(tokens > LONG)
    parts = []
    for i in long.tolist():
        edge = [*_part_edges(text[starts[i] : stops[i]]), int(stops[i] - starts[i])]
        parts += [(i, int(starts[i]) + a, int(starts[i]) + b) for a, b in zip(edge, edge[1:], strict=False)]
    texts = [text[a:b] for _, a, b in parts]
    flat, where = replay.encode_batch(texts)
    count = [len(t.encode("utf-8", "replace")) if i in by_bytes else n for (i, _, _), t, n in zip(parts, texts, np.diff(where).tolist(), strict=True)]
    keep = np.ones(len(starts), bool)
    keep[long] = False
    s = np.concatenate([starts[keep], [a for _, a, _ in parts]]).astype(np.int64)
    order = np.argsort(s)
    return s[order], np.concatenate([tokens[keep], count]).astype(np.int64)[order], np.concatenate([ids[keep], flat[where[:-1]]])[order]


def split_texts(replay: MergeReplay, texts: list[str | None], limit: int, overlap: int, least: int) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """Number of text, and (start, new, end, tokens) of its pieces, for each text of more than limit tokens."""
    numbers, starts, stops, per_text = replay.numbers(texts)
    replay.learn()
    first = replay.start[numbers]
    tokens = replay.start[numbers + 1] - first
    ids = replay.flat[first]
    edge = np.concatenate([[0], np.cumsum(per_text)])
    total = np.concatenate([[0], np.cumsum(tokens)])
    for i in np.flatnonzero(total[edge[1:]] - total[edge[:-1]] > limit).tolist():
        a, b = edge[i], edge[i + 1]
        own = starts[a:b].astype(np.int64), tokens[a:b], ids[a:b]
        if (own[1] > LONG).any():
            # parts together may have more tokens than each by itself; where that breaks a bound, bytes count, which no
            # encoding exceeds, in the pre-tokens of that piece only
            by_bytes: set[int] = set()
            while True:
                cut = plan(texts[i], *_units(replay, texts[i], own[0], stops[a:b], own[1], own[2], by_bytes), limit, overlap, least)
                counts = np.diff(replay.encode_batch([texts[i][s:e] for s, _, e in cut])[1])
                shared = np.diff(replay.encode_batch([texts[i][s:m] for s, m, _ in cut])[1])
                bad = [cut[k] for k in np.flatnonzero((counts > limit) | (shared > overlap)).tolist()]
                more = {j for s, _, e in bad for j in np.flatnonzero((own[1] > LONG) & (own[0] < e) & (stops[a:b] > s)).tolist()} - by_bytes
                if not more:
                    assert not bad, "a piece is over its bounds"
                    break
                by_bytes |= more
            yield i, [(*p, int(n)) for p, n in zip(cut, counts, strict=True)]
        else:
            cut = plan(texts[i], *own, limit, overlap, least)
            at = np.searchsorted(own[0], [p[0] for p in cut])
            to = np.append(np.searchsorted(own[0], [p[2] for p in cut[:-1]]), b - a)
            base = total[a:]
            yield i, [(*p, int(base[y] - base[x])) for p, x, y in zip(cut, at, to, strict=True)]


def split(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The pieces of each text of more than limit tokens: doc_id, piece_no, piece, n_tokens, overlap_chars, char_start, char_end.

    Pieces have at most limit tokens and follow one another; each after the first begins with overlap_chars code
    points from the end of the one before, at most overlap tokens.  Without them the pieces give the text again.
    From a piece's start the first landmark of a rolling hash beyond least tokens is taken and moved to the nearest
    end of a sentence or line, else of a word, else of a pre-token; inside a pre-token only where it is too long by
    itself.  Null, empty and smaller texts give no row; a null id stays null.  Needs no shuffle.
    """
    path = f"{tokenizers}/{VOCABULARY}"
    schema = "doc_id bigint, piece_no int, piece string, n_tokens int, overlap_chars int, char_start bigint, char_end bigint"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [
                    (ids[i], k, texts[i][s:e], n, new - s, s, e)
                    for i, cut in split_texts(replay, texts, limit, overlap, least)
                    for k, (s, new, e, n) in enumerate(cut)
                ]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                replay.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    return rows.mapInArrow(run, schema)
