"""Language of texts and of their segments by hyperdimensional profiles.

Every letter has a random vector of signs.  A letter n-gram is the product (binding) of its letters' vectors, each
permuted by its place; a profile is a weighted sum (bundle) of n-gram vectors.  A segment goes to the language
prototype of greatest cosine; in a text of several segments each cosine counts by the segment's length (norm), and a
change of language has a price.  The prototypes have length one.  Since a bundle is a sum, the cosine's dot product
is the sum of those of its n-grams, which a worker makes once for each distinct n-gram.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.canonical import folded

# Two-letter code, three-letter codes and English name of each language.
NAMES = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish"),
    "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
}
LANGUAGES = tuple(NAMES)
_CODE = {n: code for code, names in NAMES.items() for n in (code, *names)}

#: Width of a hypervector; rows that the prototypes are made of, at most.
DIMENSIONS = 8192
TRAINING_ROWS = 12_000
#: What a change of language inside a text costs, in nats of evidence, and the letters of the language that it takes to.
SWITCH = 14.0
SENTENCE_LETTERS = 24
#: Every letter is in three trigrams, so this share of their evidence counts.
SHARE = 1 / 3
#: A text whose n-grams speak for its best language less than this share of what labelled texts' do has no language.
FLOOR = 0.25
#: Letters with a vector of their own; no union of the alphabets in question has as many.
ALPHABET = 254

#: Words of a segment at most; a longer one, in which nothing ends a sentence, is taken in parts of PART_WORDS.
SEGMENT_WORDS, PART_WORDS = 40, 12

_TAG = re.compile(r"https?://\S+|[@#]\w+")
_SEGMENT = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|[\r\n]+|\s[|/—–]\s|(?<=[\"»”])\s+(?=[—–/|])")
_FIELD = re.compile(r"^[\s*•\-{\"',]*[^\W\d_]{2,14}\"?\s*(?::|\s-)\s")


def named(label: str | None) -> str | None:
    """Two-letter code of what label names, None if it names none of the seven languages.

    Case, region and notation do not count.
    """
    if not label:
        return None
    return _CODE.get(re.split(r"[-_]", label.strip().lower())[0])


def segments(text: str) -> list[str]:
    """Sentences, lines and parts of a text, without the labels of fields."""
    out = []
    for part in _SEGMENT.split(text):
        if not part or part.isspace():
            continue
        part = _FIELD.sub("", part, count=1)
        if part.count(" ") >= SEGMENT_WORDS:
            w = part.split(" ")
            out += [" ".join(w[i : i + PART_WORDS]) for i in range(0, len(w), PART_WORDS)]
        else:
            out.append(part)
    return out or [text]


def _plain(part: str) -> str:
    """What counts of a segment: no links, mentions or tags."""
    return folded(_TAG.sub(" ", part) if "@" in part or "#" in part or "://" in part else part)


class Profiles:
    """Letters, prototypes and the scores of n-grams.  Pickled with the prototypes only."""

    def __init__(self, letters: str, seed: int = 11) -> None:
        self.letters = letters[:ALPHABET]
        self.seed = seed
        self.prototypes = np.zeros((len(LANGUAGES), DIMENSIONS), np.float32)
        self.nats, self.floor, self.sharpness = 1.0, 0.0, 40.0
        self.gain = np.ones(len(LANGUAGES))
        self._prepare()

    def _prepare(self) -> None:
        self.table = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(self.letters):
            self.table[ord(c)] = i + 2
        self.known_letters = self.table > 0
        for low, high in ((0x61, 0x7B), (0xC0, 0x250), (0x370, 0x530)):  # a letter of no vector of its own
            span = self.table[low:high]
            span[span == 0] = 1
        for c in (0xD7, 0xF7):
            self.table[c] = 0
        rng = np.random.default_rng(self.seed)
        self.vectors = (rng.integers(0, 2, (256, DIMENSIONS), np.int8) * 2 - 1).astype(np.int8)
        self.places = np.full(1 << 24, -1, np.int32)
        self.scores = np.zeros((0, len(LANGUAGES)), np.float32)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("letters", "seed", "prototypes", "nats", "floor", "sharpness", "gain")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def vector(self, grams: np.ndarray) -> np.ndarray:
        """The n-gram vectors: letters' vectors permuted by place and bound."""
        v = self.vectors
        return np.roll(v, 2, axis=1)[grams >> 16] * np.roll(v, 1, axis=1)[(grams >> 8) & 255] * v[grams & 255]

    def grams(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigrams of all parts, the number of part of each, and the letters of each part; folded text in."""
        codes = np.frombuffer("\0\0".join([*parts, ""]).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        whose = np.repeat(np.arange(len(parts)), lengths + 2)
        x = self.table[codes].astype(np.int32)
        letters = np.bincount(whose[x > 0], minlength=len(parts))
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] > 0) | (x[:-1] > 0)
        x, whose = x[keep], whose[keep]
        if len(x) < 3:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), letters
        g = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        real = x[1:-1] > 0
        return g[real], whose[1:-1][real], letters

    def cosines(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosines of each part's bundle with the prototypes, its norm (n-gram vectors are all but orthogonal), its letters.

        Each language's cosines are relative to those that its own texts have, since a prototype of more texts has more
        n-grams and smaller cosines.
        """
        g, whose, letters = self.grams(parts)
        new = np.unique(g[self.places[g] < 0])
        if len(new):
            made = [self.vector(new[i : i + 512]).astype(np.float32) @ self.prototypes.T for i in range(0, len(new), 512)]
            self.places[new] = len(self.scores) + np.arange(len(new))
            self.scores = np.concatenate([self.scores, *made])
        at = self.places[g]
        dots = np.stack([np.bincount(whose, self.scores[at, k], len(parts)) for k in range(len(LANGUAGES))], axis=1)
        norms = np.sqrt(np.bincount(whose, minlength=len(parts)) * float(DIMENSIONS))
        return dots / np.maximum(norms, 1)[:, None] * self.gain, norms, letters

    def confidence(self, cosines: np.ndarray) -> np.ndarray:
        """Cosines as shares of one; sharpness makes them fit how often labelled segments are right."""
        e = np.where(self.prototypes.any(axis=1), np.exp((cosines - cosines.max(axis=1, keepdims=True)) * self.sharpness), 0)
        return e / np.maximum(e.sum(axis=1, keepdims=True), 1e-30)

    def train(self, texts: list[str], labels: list[str], rounds: int = 3) -> Profiles:
        """Prototypes from labelled texts; texts whose label the last round's prototypes deny are left out of the next."""
        parts = [folded(t) for t in texts]
        y = np.array([LANGUAGES.index(x) for x in labels])
        g, whose, _ = self.grams(parts)
        distinct, which = np.unique(g, return_inverse=True)
        keep = np.ones(len(parts), bool)
        for k in range(rounds):
            use = keep[whose]
            counts = np.zeros((len(LANGUAGES), len(distinct)))
            for i in range(len(LANGUAGES)):
                counts[i] = np.bincount(which[use & (y[whose] == i)], minlength=len(distinct))
            share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * len(distinct))
            some = counts.sum(axis=1) > 0  # a language without texts has no prototype
            weight = np.log(share) - np.log(share[some]).mean(axis=0)
            weight[:, counts.sum(axis=0) < 3] = 0
            weight[~some] = 0
            made = np.zeros((len(LANGUAGES), DIMENSIONS), np.float32)
            for at in range(0, len(distinct), 512):
                made += weight[:, at : at + 512].astype(np.float32) @ self.vector(distinct[at : at + 512]).astype(np.float32)
            size = np.linalg.norm(made, axis=1, keepdims=True)
            self.prototypes = made / np.maximum(size, 1e-9)
            self.gain = np.ones(len(LANGUAGES))
            self.nats = float(size[some].mean()) / DIMENSIONS  # a dot product in nats
            self.places[:] = -1
            self.scores = np.zeros((0, len(LANGUAGES)), np.float32)
            cosines, norms, _ = self.cosines(parts)
            best = np.where(some, cosines, -np.inf).argmax(axis=1)
            keep = best == y
        strength = cosines[np.arange(len(y)), y] / np.maximum(norms, 1)
        own = np.array([np.median(strength[keep & (y == k)]) if (keep & (y == k)).any() else 0.0 for k in range(len(LANGUAGES))])
        if (own > 0).any():
            typical = float(own[own > 0].mean())
            self.gain = np.where(own > 0, typical / np.maximum(own, 1e-12), 1.0)
            self.floor = FLOOR * typical
        return self

    def calibrate(self, texts: list[str], labels: list[str]) -> Profiles:
        """Set the sharpness under which the segments of labelled texts are most likely; texts of another best language are wrongly labelled."""
        y = np.array([LANGUAGES.index(x) for x in labels], np.int64)
        if not len(y):
            return self
        right = self.cosines([_plain(t) for t in texts])[0].argmax(axis=1) == y
        parts = [(p, k) for t, k, ok in zip(texts, y.tolist(), right, strict=True) if ok for s in segments(t) if (p := _plain(s)).strip()]
        if not parts:
            return self
        cosines, norms, _ = self.cosines([p for p, _ in parts])
        of = np.array([k for _, k in parts])
        best = -np.inf
        for sharpness in np.geomspace(4, 400, 40):
            self.sharpness, before = float(sharpness), self.sharpness
            fit = float(np.log(np.maximum(self.confidence(cosines)[np.arange(len(of)), of], 1e-12))[norms > 0].mean())
            if fit <= best:
                self.sharpness = before
                break
            best = fit
        return self


def _path(gains: np.ndarray) -> list[int]:
    """The best language of each segment when every change costs SWITCH."""
    best, back = gains[0].copy(), []
    for row in gains[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back.append(np.where(stay, np.arange(len(row)), top))
        best = np.where(stay, best, best[top] - SWITCH) + row
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def label_texts(profiles: Profiles, texts: list[str]) -> tuple[list[list[str]], list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Segments and language numbers (-1 for none) of each text; cosines, norms and where each text's segments begin."""
    parts = [segments(t) for t in texts]
    cosines, norms, letters = profiles.cosines([_plain(p) for ps in parts for p in ps])
    gains = cosines * norms[:, None] * (profiles.nats * SHARE)
    if (some := profiles.prototypes.any(axis=1)).any():
        gains[:, ~some] = -1e9
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    top = gains.argmax(axis=1)
    summed = np.add.reduceat(gains, begin[:-1]) if len(parts) else gains
    overall = summed.argmax(axis=1)
    squares = np.add.reduceat(norms**2, begin[:-1]) if len(parts) else norms
    best = cosines.max(axis=1, initial=0) * norms  # of each segment by itself: two languages speak against each other
    dots = np.add.reduceat(best, begin[:-1]) if len(parts) else best
    spoken = (squares > 0) & (dots > profiles.floor * squares)
    apart = np.bincount(np.repeat(np.arange(len(parts)), np.diff(begin)), (top != np.repeat(overall, np.diff(begin))) & (norms > 0), len(parts)) > 0
    out: list[list[int]] = []
    for i in range(len(parts)):
        a, b = begin[i], begin[i + 1]
        if not spoken[i]:
            out.append([-1] * int(b - a))
            continue
        if not apart[i]:
            out.append([int(overall[i])] * int(b - a))
            continue
        way = _path(gains[a:b])
        size: Counter[int] = Counter()
        for k, n in zip(way, letters[a:b].tolist(), strict=True):
            size[k] += n
        kept = {k for k, n in size.items() if n >= SENTENCE_LETTERS} or {int(overall[i])}
        strongest = max(kept, key=lambda k: size[k])
        out.append([k if k in kept else strongest for k in way])
    return parts, out, cosines, norms, begin


def fit(rows: DataFrame, *, id_col: str = "seq", text_col: str = "original_text", label_col: str = "language", training_rows: int = TRAINING_ROWS) -> Profiles:
    """Profiles from about training_rows labelled rows, chosen by a hash of their id; wrong labels are outvoted."""
    labels = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("l")).where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    every = max(1, rows.count() // training_rows)
    sample = labels.where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0).select("t", "l").limit(2 * training_rows).collect()
    known = [(r.t, code) for r in sample if (code := named(r.l))]
    letters = Counter(c for t, _ in known for c in folded(t) if c.isalpha())
    profiles = Profiles("".join(c for c, n in letters.most_common() if n >= 3))
    if not known:
        return profiles
    held = known[::5] if len(known) >= 50 else known  # the sharpness is found on texts apart, if there are enough
    learnt = [x for i, x in enumerate(known) if i % 5] if len(known) >= 50 else known
    return profiles.train(*map(list, zip(*learnt, strict=True))).calibrate(*map(list, zip(*held, strict=True)))


def _read(rows: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    rows = rows.select(F.col(id_col).cast("long").alias("seq"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("language"))
    return rows.where("text IS NOT NULL").where(F.col("text").rlike(r"\S"))


def labelled(rows: DataFrame, *, id_col: str = "seq", text_col: str = "original_text", label_col: str = "language", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """seq, language, segment_no, segment, lang, confidence: the segments of every row with a text.

    Null and blank texts give no segment; a null id stays null.  Adjacent segments of one language are one.  language
    is the row's label, confidence the share of lang among the cosines with all prototypes.  A text without letters,
    or in letters or a language of no prototype, has a null lang with confidence 0.  Needs no shuffle.
    """
    held = rows.sparkSession.sparkContext.broadcast(fit(rows, id_col=id_col, text_col=text_col, label_col=label_col, training_rows=training_rows))
    names = ["seq", "language", "segment_no", "segment", "lang", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = held.value
        for pdf in batches:
            if not len(pdf):
                continue
            ids, said = pdf["seq"].tolist(), pdf["language"].tolist()
            parts, way, cosines, norms, begin = label_texts(profiles, pdf["text"].tolist())
            out: list[tuple] = []
            edges: list[tuple[int, int]] = []
            for i, ks in enumerate(way):
                a = n = 0
                for j in range(1, len(ks) + 1):
                    if j == len(ks) or ks[j] != ks[a]:
                        out.append((ids[i], said[i], n, " ".join(parts[i][a:j]), ks[a]))
                        edges.append((int(begin[i]) + a, int(begin[i]) + j))
                        a, n = j, n + 1
            low, high = np.array(edges).T
            sums = np.concatenate([np.zeros((1, cosines.shape[1])), np.cumsum(cosines * norms[:, None], axis=0)])
            squares = np.concatenate([[0], np.cumsum(norms**2)])
            share = profiles.confidence((sums[high] - sums[low]) / np.sqrt(np.maximum(squares[high] - squares[low], 1))[:, None])
            known = [(None, 0.0) if r[4] < 0 else (LANGUAGES[r[4]], round(float(share[k, r[4]]), 6)) for k, r in enumerate(out)]
            yield pd.DataFrame([(*r[:4], *x) for r, x in zip(out, known, strict=True)], columns=names)

    return _read(rows, id_col, text_col, label_col).mapInPandas(run, "seq bigint, language string, segment_no int, segment string, lang string, confidence double")


def mislabelled(rows: DataFrame, *, id_col: str = "seq", text_col: str = "original_text", label_col: str = "language", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """seq, lang: each language of each text whose label is absent, names none of its languages, or is one of several.

    Rows with a null id are left out, and null and blank texts and those of no language as in labelled().  Needs no shuffle.
    """
    held = rows.sparkSession.sparkContext.broadcast(fit(rows, id_col=id_col, text_col=text_col, label_col=label_col, training_rows=training_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            _, way, _, _, _ = label_texts(held.value, pdf["text"].tolist())
            for seq, said, ks in zip(pdf["seq"].tolist(), pdf["language"].tolist(), way, strict=True):
                found = sorted({LANGUAGES[k] for k in ks if k >= 0})
                if len(found) > 1 or (found and named(said) != found[0]):
                    out += [(seq, lang) for lang in found]
            yield pd.DataFrame(out, columns=["seq", "lang"])

    return _read(rows.where(F.col(id_col).isNotNull()), id_col, text_col, label_col).mapInPandas(run, "seq bigint, lang string")
