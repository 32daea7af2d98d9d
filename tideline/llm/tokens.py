"""Encoding with a public byte-level BPE vocabulary by corpus-level merge replay.

A block of texts is cut into pre-tokens with array operations over code points; the distinct new ones are laid out as
one array of symbols, and an inverted index from token pair to positions replays the merges in rank order over all of
them at once, updating only the neighbours of merged positions.  A text is the concatenation of its pre-tokens' ids.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie: a parameter of every operator here, this is its default.
TOKENIZERS = os.environ.get("TIDELINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points cut at once, pre-tokens held before their ids are made, distinct pre-tokens a worker remembers.
#: None changes a result; they bound memory.
CUT_CHARS = 2 << 20
HELD_TOKENS = 8 << 20
REMEMBERED = 2_000_000

_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)
# The code points with the White_Space property.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        names = {"L": _LETTER, "N": _NUMBER}
        t = np.frombuffer(bytes(names.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8).copy()
        t[_WHITE] = _SPACE
        _classes.append(t)
    return _classes[0]


def cut(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in codes, in which each position of ends closes a text.

    The rule is that of the vocabulary: a contraction; letters, numbers or other signs with at most one space before
    them; white space, of which the last before a sign stands alone.
    """
    c = _class_table()[codes]
    c[ends] = _END
    last = np.empty_like(c)
    last[0], last[1:] = _END, c[:-1]
    following = np.empty_like(c)
    following[-1], following[:-1] = _END, c[1:]
    begin = c != last
    begin |= (c == _SPACE) & (following != _SPACE) & (following != _END)
    spaced = np.zeros(len(c), bool)
    spaced[1:] = (codes[:-1] == 32) & (last[1:] == _SPACE)
    begin &= ~(spaced & (c != _SPACE) & (c != _END))
    quote = np.flatnonzero((codes == 39) & (last != _OTHER) & ~spaced & (following == _LETTER))
    if len(quote):
        padded = np.concatenate([codes[: quote[-1] + 3], np.zeros(2, codes.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        begin[quote[one | two] + 1] = False
        for at in (quote[one] + 2, quote[two] + 3):
            begin[at[c[at] == _LETTER]] = True
    starts = np.flatnonzero(begin)
    stops = np.append(starts[1:], len(codes))
    real = c[starts] != _END
    return starts[real], stops[real]


class MergeReplay:
    """Encoder over one vocabulary; remembers the ids of pre-tokens it has met."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        ranks = self.ranks
        pairs = {(ranks[t[:i]] << 17) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        codes = np.array(sorted(pairs), np.int64)
        self.pair_codes, self.pair_ranks = codes, np.array([pairs[c] for c in codes.tolist()], np.int64)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            self.lengths[r] = len(t)
        rng = np.random.default_rng(7)
        self.sign = rng.integers(1, 1 << 63, (2, 1 << 16), np.uint64)
        base = 0x9E3779B97F4A7C15
        size = CUT_CHARS * 2
        self.power = np.cumprod(np.full(size, base, np.uint64))
        self.inverse = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.key_number = np.zeros(0, np.int64)
        self.pending: list[bytes] = []
        self.codes = np.zeros(1 << 16, np.uint32)  # the code points of all pre-tokens in a row, and where each begins
        self.code_start = np.zeros(1, np.int64)
        self.apart: dict[str, int] = {}  # those whose hash another one has
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1, np.int64)
        self.words = 0

    def _ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair code, -1 for none."""
        at = np.searchsorted(self.pair_codes, pairs)
        at[at == len(self.pair_codes)] = 0
        return np.where(self.pair_codes[at] == pairs, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in a row, and the number of ids of each."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(lens + 1) - 1
        sym = self.byte_ids[raw]
        sym[ends] = -1
        n = len(sym)
        following = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray) -> None:
            """Enter the pairs that begin at places into the index."""
            left, right = sym[places], sym[following[places]]
            real = (left >= 0) & (right >= 0)
            places = places[real]
            if not len(places):
                return
            rank = self._ranks((left[real] << 17) | right[real])
            real = rank >= 0
            places, rank = places[real], rank[real]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], edges])].tolist(), np.split(places, edges), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(sym[:-1] >= 0))
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            left = sym[at]
            nxt = following[at]
            right = sym[nxt]
            live = (left >= 0) & (right >= 0)
            if not live.all():
                at, left, nxt, right = at[live], left[live], nxt[live], right[live]
            live = self._ranks((left << 17) | right) == rank
            if not live.all():
                at, nxt = at[live], nxt[live]
            if not len(at):
                continue
            at = np.sort(at)
            nxt = following[at]
            if (nxt[:-1] == at[1:]).any():  # overlapping places: the leftmost first
                keep, taken = [], -1
                for i, (a, b) in enumerate(zip(at.tolist(), nxt.tolist(), strict=True)):
                    if a != taken:
                        keep.append(i)
                        taken = b
                at, nxt = at[keep], nxt[keep]
            sym[at] = rank
            sym[nxt] = -2
            after = following[nxt]
            following[at] = after
            before[after] = at
            prev = before[at]
            prev = prev[prev >= 0]
            add(np.concatenate([at, prev[sym[prev] >= 0]]))
        alive = sym >= 0
        counts = np.diff(np.concatenate([[0], np.cumsum(alive)[ends]]))
        return sym[alive].astype(np.int32), counts

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of each pre-token, its start and end as code points of its text, pre-tokens of each text.

        A pre-token is looked up by a 64-bit hash and then compared by its code points; one whose hash belongs to
        another is kept apart by itself.
        """
        return _joined([self._numbers(part) for part in _parts(texts)])

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        whole = "\0".join([t or "" for t in texts]) + "\0"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))) - 1
        if len(codes) + 1 > len(self.power):
            more = len(codes) + 1 - len(self.power)
            self.power = np.concatenate([self.power, self.power[-1] * np.cumprod(np.full(more, self.power[0], np.uint64))])
            self.inverse = np.concatenate([self.inverse, self.inverse[-1] * np.cumprod(np.full(more, self.inverse[0], np.uint64))])
        starts, stops = cut(codes, ends)
        low = codes & 0xFFFF
        sums = np.zeros(len(codes) + 1, np.uint64)
        signs = self.sign[0][low] if codes.max() < 0x10000 else self.sign[0][low] + self.sign[1][codes >> 16]
        np.cumsum(signs * self.power[: len(codes)], out=sums[1:])
        keys = (sums[stops] - sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64)
        keys ^= keys >> np.uint64(29)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        number = np.where(known, self.key_number[at] if len(self.keys) else 0, 0)
        fresh = np.flatnonzero(~known)
        length = stops - starts
        if len(fresh):
            at = first[fresh]
            number[fresh] = self._enter([whole[i:j] for i, j in zip(starts[at].tolist(), stops[at].tolist(), strict=True)])
            self.keys = np.concatenate([self.keys, distinct[fresh]])
            self.key_number = np.concatenate([self.key_number, number[fresh]])
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.key_number = self.keys[order], self.key_number[order]
        found = number[which]
        for i in np.flatnonzero(~_alike(codes, starts, length, self.codes, self.code_start[found], np.diff(self.code_start)[found])).tolist():
            word = whole[starts[i] : stops[i]]
            if word not in self.apart:
                self.apart[word] = self._enter([word])[0]
            found[i] = self.apart[word]
        per_text = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
        base = np.repeat(np.concatenate([[0], ends[:-1] + 1]), per_text)
        return found.astype(np.int32), (starts - base).astype(np.int32), (stops - base).astype(np.int32), per_text

    def _enter(self, words: list[str]) -> np.ndarray:
        """Numbers of new pre-tokens."""
        self.pending += [w.encode("utf-8", "replace") for w in words]
        ends = self.code_start[-1] + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        while ends[-1] > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.codes[self.code_start[-1] : ends[-1]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.code_start = np.concatenate([self.code_start, ends])
        self.words += len(words)
        return np.arange(self.words - len(words), self.words)

    def learn(self) -> None:
        """Make the ids of all pending pre-tokens."""
        if self.pending:
            ids, counts = self.replay(self.pending)
            self.pending = []
            used = int(self.start[-1])
            while used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[used : used + len(ids)] = ids
            self.start = np.concatenate([self.start, used + np.cumsum(counts)])

    def ids(self, numbers: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and where each text's begin (one more than texts)."""
        self.learn()
        begin = self.start[numbers]
        length = self.start[numbers + 1] - begin
        where = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(begin - where[:-1], length) + np.arange(where[-1])
        return self.flat[at], where[np.concatenate([[0], np.cumsum(per_text)])]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        numbers, _, _, per_text = self.numbers(texts)
        return self.ids(numbers, per_text)

    def rest(self) -> None:
        """Call between blocks: forgets when too many pre-tokens are remembered."""
        if self.words > REMEMBERED:
            self.forget()


def _alike(a: np.ndarray, start_a: np.ndarray, length_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Whether the stretches of a and b (none empty) have the same length and code points."""
    out = length_a == length_b
    at = np.flatnonzero(out)
    n = length_a[at]
    if len(at):
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum()))
        same = a[np.repeat(start_a[at] - begin, n) + inner] == b[np.repeat(start_b[at] - begin, n) + inner]
        out[at] = np.logical_and.reduceat(same, begin)
    return out


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "") + 1
        if size >= CUT_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3 + (np.zeros(0, np.int64),)


_encoders: dict[str, MergeReplay] = {}


def encoder(path: str) -> MergeReplay:
    """One encoder for each vocabulary file and Python process."""
    if path not in _encoders:
        _encoders[path] = MergeReplay(path)
    return _encoders[path]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids (array of int): the ids of each text, without special tokens, one row for each row of docs.

    A string that looks like a special token is ordinary text.  A null and an empty text have the empty list; a null
    id stays null; a lone surrogate counts as "?".  Needs no shuffle; texts are whole whatever their length.
    """
    path = f"{tokenizers}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = encoder(path)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for names, numbers, per_text in held:
                ids, offsets = replay.ids(numbers, per_text)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([names, lists], ["doc_id", "ids"])
            held.clear()
            replay.rest()

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                numbers, _, _, per_text = replay.numbers(part.column(1).to_pylist())
                held.append((part.column(0), numbers, per_text))
                size += len(numbers)
                if size > HELD_TOKENS:
                    yield from out()
                    size = 0
        yield from out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")
