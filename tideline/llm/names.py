"""Variant spellings of names by noisy-channel attribution.

Each author id has its most frequent spelling and handle.  Fuller and more frequent spellings are the candidate
canonical forms; a variant goes to the candidate of maximal posterior: the candidate's frequency as prior, and what
typos, abbreviations, initials, nicknames, reordering and handle habits cost as likelihood.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import materialize

# Titles and additions that are no part of a name, joining words, abbreviations that are no prefix,
# handle words that say nothing, and nicknames.
_ADDED = {"dr", "prof", "mr", "mrs", "ms", "mx", "sir", "phd", "official", "reporter", "desk", "news", "inc", "llc", "the"}
_JOINING = {"and", "of", "the"}
_SHORT = {"bcast": "broadcasting", "co": "company", "dept": "department", "assn": "association", "intl": "international", "ltd": "limited", "lab": "laboratory", "natl": "national"}
_SILENT_HANDLE = re.compile(r"(?:daily|notes|live|press|newsdesk)_?\d+")
_NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex sasha sandy", "anthony": "tony", "augustus": "gus", "benjamin": "ben benny",
    "charlotte": "lottie charlie", "christopher": "chris kit", "daniel": "dan danny", "dorothea": "dora thea dot dottie", "edward": "ed eddie ted ned",
    "elizabeth": "liz beth betty eliza lizzie", "florian": "flo", "francesca": "fran frankie chess", "frederick": "fred freddie", "gabrielle": "gabby gabi",
    "gregory": "greg", "isabella": "bella izzy isa", "jennifer": "jen jenny", "jonathan": "jon jonny", "joseph": "joe joey",
    "josephine": "jo josie", "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len leo lenny",
    "madeline": "maddie", "margaret": "maggie meg peggy marge", "matthew": "matt", "michael": "mike mick", "nathaniel": "nate nat nathan",
    "nicholas": "nick nicky", "patricia": "pat patty trish", "philippa": "pip pippa", "raymond": "ray", "rebecca": "becky becca",
    "robert": "bob rob bobby robbie", "samuel": "sam sammy", "stephen": "steve", "susanna": "sue susie", "theodore": "ted theo teddy",
    "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori", "walter": "walt wally", "wilhelmina": "mina billie willa",
    "william": "bill will billy liam", "vincent": "vince vinny", "zachary": "zach zack", "andrew": "andy drew", "james": "jim jimmy",
    "john": "jack johnny", "richard": "dick rick rich", "charles": "charlie chuck", "deborah": "deb debbie", "barbara": "barb babs",
}
_FORMAL = {(n, full) for full, short in _NICKNAMES.items() for n in short.split()}
_STANDS_FOR: dict[str, set[str]] = {full: {full} for full in _NICKNAMES}  # the formal names of a formal name or nickname
for _nick, _full in _FORMAL:
    _STANDS_FOR.setdefault(_nick, set()).add(_full)

_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_RUN_ON = re.compile(r"(?<=\w{3})and( sons\b)|(?<=ment)of\b()")
_DEGREE = re.compile(r"\bph\.?d\b", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+")

#: Costs in nats of the channel, and the most that still makes a link.
COST = {"typo": 1.8, "typos": 6.5, "initial": 1.0, "short": 1.0, "nickname": 1.0, "middle": 0.5, "reordered": 0.3, "missing": 7.0, "other_middle": 5.0, "acronym": 2.0, "compact": 0.5}
HANDLE_FITS, HANDLE_DIFFERS, LIMIT = -4.0, 0.5, 6.0
#: Two spellings that both have a second author or a handle of their own are hardly one and a typo of it.
BOTH_KNOWN = 5.0
#: A name in one word of at most so many letters says less: those of SHORT_WORD are linked when equal only, at a cost
#: that leaves a longer spelled form the first choice; the others may have one typo, at a further cost.
WORD, SHORT_WORD, WORD_TYPO = 9, 5, 2.0
#: Weight of the logarithm of a candidate's frequency.
PRIOR = 0.25
#: A handle that spells a whole name, against one that spells all but an initial.
WHOLE = 1000


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("æ", "ae").replace("ł", "l"))
    return "".join(c for c in text if not unicodedata.combining(c))


def spelling(display: str | None) -> str:
    """Tokens of a displayed name in lower case, without accents, titles and additions; "" for none."""
    if not display:
        return ""
    display = _DEGREE.sub(" ", display)
    mixed = any(c.islower() for c in display) and sum(c.isupper() for c in display) <= 8
    tokens = _TOKEN.findall(_plain(_CAMEL.sub(" ", display) if mixed else display).lower().replace("&", " "))
    tokens = [_SHORT.get(t, t) for t in tokens if t not in _JOINING]
    named = [t for t in tokens if t not in _ADDED] or tokens
    joined = " ".join(" ".join(t) if len(t) == 2 else t for t in named)  # two letters are two initials
    return _RUN_ON.sub(r"\1", joined) if " sons" in joined or "mentof" in joined else joined


def handle_spelling(handle: str | None) -> str:
    """Letters of a handle in lower case, parts divided by a space; "" for one that says nothing."""
    if not handle:
        return ""
    handle = _plain(handle).lower().lstrip("@")
    if _SILENT_HANDLE.fullmatch(handle):
        return ""
    return " ".join(t for t in re.findall(r"[a-z]+", handle) if t not in _JOINING)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b, most + 1 when more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(1 << 17)
def _token_cost(v: str, c: str) -> float:
    if v == c:
        return 0.0
    if (v, c) in _FORMAL or (c, v) in _FORMAL:
        return COST["nickname"]
    if len(v) == 1 or len(c) == 1:
        return COST["initial"] if v[0] == c[0] else math.inf
    if 3 <= min(len(v), len(c)) <= 5 and (c.startswith(v) or v.startswith(c)):
        return COST["short"]
    if min(len(v), len(c)) >= 4:
        n = edits(v, c, 2 if min(len(v), len(c)) >= 6 else 1)
        if n <= 1:
            return COST["typo"]
        if n == 2 and min(len(v), len(c)) >= 6:
            return COST["typos"]
    return math.inf


@lru_cache(1 << 17)  # blocks of like keys follow each other and hold the same pairs
def channel(variant: str, canon: str) -> float:
    """What it costs that a name written as canon appears as variant; inf when it cannot."""
    if variant == canon:
        return 0.0
    v, c = variant.split(), canon.split()
    if len(v) == 1 and len(c) > 1:
        return _single(v[0], c)
    if len(c) == 1:
        return _single(c[0], v) if len(v) > 1 else _token_cost(variant, canon)
    taken: dict[int, int] = {}
    cost, solid = 0.0, False
    for initials in (False, True):  # whole words first, or an initial would take the place of one
        for i in sorted(set(range(len(v))) - set(taken.values()), key=lambda i: (-len(v[i]), i)):
            best, at = math.inf, -1
            for j in range(len(c)):
                if j not in taken and (initials or len(v[i]) > 1 < len(c[j])) and (x := _token_cost(v[i], c[j]) + 0.01 * abs(i - j)) < best:
                    best, at = x, j
            if at >= 0:
                taken[at] = i
                cost += best
                solid |= len(v[i]) > 3 and len(c[at]) > 3
    if any(len(v[i]) > 1 for i in set(range(len(v))) - set(taken.values())):
        return math.inf
    if any(len(v[i]) == 1 < len(c[j]) for j, i in taken.items()) and any(len(c[j]) == 1 < len(v[i]) for j, i in taken.items()):
        return math.inf
    lost_v = [x for i, x in enumerate(v) if i not in taken.values()]
    lost_c = [x for j, x in enumerate(c) if j not in taken]
    if not solid or any(len(x) > 1 for x in lost_c):
        return math.inf
    if len(taken) < 2:
        return math.inf
    cost += COST["other_middle"] if lost_v and lost_c else COST["middle"] * (len(lost_v) + len(lost_c))
    order = [taken[j] for j in sorted(taken)]
    return cost + (COST["reordered"] if order != sorted(order) else 0)


def _run_together(tokens: list[str]) -> list[str]:
    """What the tokens, with and without initials, give in one word in any rotation; a bare surname is not all of a name."""
    full = [t for t in tokens if len(t) > 1]
    joined = ["".join(some[k:] + some[:k]) for some in ((tokens, full) if len(full) > 1 else (tokens,)) for k in range(len(some))]
    return list(dict.fromkeys(f for j in joined for f in (j, j.replace("sons", "andsons"), j.replace("department", "departmentof"))))


def _single(word: str, tokens: list[str]) -> float:
    """A name in one word: all tokens run together in some rotation, or their initials."""
    full = [t for t in tokens if len(t) > 1]
    if word == "".join(t[0] for t in full) and len(full) > 1:
        return COST["acronym"]
    n = min((edits(word, form, 2) for form in _run_together(tokens)), default=3) if len(word) > 7 else 3
    return COST["compact"] + (0, COST["typo"], COST["typos"])[n] if n <= 2 else math.inf


@lru_cache(1 << 14)
def handles(name: str) -> set[str]:
    """Handles that the owner of a name may choose, without separators."""
    full = [t for t in name.split() if len(t) > 1]
    if len(full) < 2:
        return set()
    out = set()
    for tokens in (full, full[1:] + full[:1], full[-1:] + full[:-1]):
        out |= {"".join(tokens), tokens[0][0] + "".join(tokens[1:]), tokens[-1][:5] + tokens[0][:3], tokens[0][:5] + tokens[-1][:3]}
    return out


def spelling_handles(name: str) -> list[str]:
    """The handles that spell the whole name, and those that spell it but for an initial, marked by a dot."""
    full = [t for t in name.split() if len(t) > 1]
    if len(full) < 2:
        return []
    turns = (full, full[1:] + full[:1], full[-1:] + full[:-1])
    return sorted({"".join(t) for t in turns} | {"." + t[0][0] + "".join(t[1:]) for t in turns})


def _squeezed(handle: str) -> str:
    h = handle.replace(" ", "")
    return h.replace("andsons", "sons").replace("departmentof", "department")


def _misspelt(variant: str, canon: str) -> bool:
    """Whether variant has a long token that is neither one of canon's nor shorter for one."""
    c = canon.split()
    return any(len(t) > 5 and t not in c and not any((t, x) in _FORMAL or (x, t) in _FORMAL or x.startswith(t) or t.startswith(x) for x in c) for t in variant.split())


def cost_of(variant: str, handle: str, canon: str, canon_handles: set[str], both_known: bool) -> float:
    cost = channel(variant, canon)
    if both_known and cost < math.inf and len(variant.split()) > 1 < len(canon.split()) and _misspelt(variant, canon) and _squeezed(handle) not in canon_handles:
        cost += BOTH_KNOWN
    if handle:
        fits = _squeezed(handle) in canon_handles
        if cost == math.inf and fits and len(variant.split()) == 1 and len(variant) <= 5:
            cost = COST["acronym"] + COST["typo"]
        cost += HANDLE_FITS if fits else HANDLE_DIFFERS
    if len(variant.split()) == 1 and len(variant) <= 5 and not (handle and _squeezed(handle) in canon_handles):
        cost += 3.0  # initials alone fit many
    return cost


def contradict(a: str, b: str) -> bool:
    """Whether two handles both say something and neither holds the other."""
    a, b = _squeezed(a), _squeezed(b)
    return bool(a and b) and a not in b and b not in a


def word_cost(variant: str, handle: str, canon: str, canon_handle: str) -> float:
    """What it costs that a name in one short word stands for another; inf when their handles contradict each other."""
    if contradict(handle, canon_handle):
        return math.inf
    if min(len(variant), len(canon)) <= SHORT_WORD:
        return LIMIT if variant == canon else math.inf
    n = edits(variant, canon, 1)
    return (0.0, COST["typo"] + WORD_TYPO, math.inf)[n]


def _shortened(t: str) -> set[str]:
    return {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}


def _halves(t: str) -> set[str]:
    """Both ends of a word: of two words that one edit parts, one end of the shorter's half length, less the middle, is the same."""
    return {x for h in {(len(t) - 1) // 2, (len(t) - 2) // 2} for x in ("<" + t[:h], ">" + t[-h:])}


@lru_cache(1 << 16)
def marks(t: str) -> frozenset[str]:
    """Two tokens have a mark in common if the channel takes one for the other without a handle's help, initials aside."""
    out = {"<" + t[:3]} | {"N" + full for full in _STANDS_FOR.get(t, ())}
    if 4 <= len(t) <= 6:
        out |= _shortened(t)
    if len(t) >= 6:
        out |= _halves(t)
    return frozenset(out)


def keys(name: str, handle: str) -> set[str]:
    """Blocks in which a node meets its candidates; they do not depend on how many nodes there are.

    Two names of several tokens that the channel accepts have two pairs of words that fit (key P), or one of them has a
    single word, the other's remaining words being initials there (key I), or the handle of one is what the other may
    choose (key H).  A name in one word of eight letters or more meets what is run together to it but for one edit by
    either half (key C), any by its letters as an acronym (key A), and other names in one word like two tokens (key S).
    """
    tokens = name.split()
    full = [t for t in tokens if len(t) > 1]
    initials = {t for t in tokens if len(t) == 1}
    out: set[str] = set()
    for s, t in combinations(full, 2):
        out |= {"P" + "|".join(sorted((x, y))) for x in marks(s) for y in marks(t)}
    if len(tokens) > 1:
        for i, t in enumerate(full):
            others = {min(o[0] for o in full[:i] + full[i + 1 :])} if len(full) > 1 else initials
            out |= {f"I{x}|{o}" for x in marks(t) for o in others}
        if not full:
            out.add("I" + name)
    if len(full) > 2:  # two initials are a person's, not an acronym
        out.add("A" + "".join(t[0] for t in full))
    if len(full) > 1:
        out |= {"H" + h for h in handles(name)}
    if len(tokens) > 1:
        out |= {"C" + x for form in _run_together(tokens) if len(form) > 6 for x in _halves(form)}
    elif tokens:
        out |= {"A" + name} | {"S" + x for x in marks(name)}
        if len(name) > 7:
            out |= {"C" + x for x in _halves(name)}
    if handle:
        out.add("H" + _squeezed(handle))
    return out


def attributed(group: list, key: str = "") -> Iterator[tuple[str, str, float]]:
    """(variant node, parent node, log posterior) within one block of rows with node, name, handle, n, authors, spelt.

    Fuller spellings come first, then those that more handles spell and that have more authors and rows, so that
    parents never form a cycle (of one word's nodes those with a handle come first); these numbers are those of the name over all data, hence the same in every block.
    What the block's key is there for tells which pairs need a look: the others meet elsewhere.
    """
    group = sorted(group, key=lambda r: (-sum(len(t) > 1 for t in r.name.split()), -r.spelt, -r.authors, -r.n, r.name, " " not in r.name and not r.handle, r.node))
    heads: dict[str, str] = {}
    known = {r.name: r.authors + (r.spelt >= WHOLE) for r in group}
    kind = key[:1]
    own: list[tuple[str, set[str], str, int, str]] = []
    words: list[tuple[str, set[str], str, int, str]] = []  # those of own that one word is looked up among
    for r in group:
        several = " " in r.name
        if r.name in heads and several:
            yield r.node, heads[r.name], 50.0 + math.log1p(r.n)
            continue
        best, parent = -math.inf, ""
        one = sum(len(t) > 1 for t in r.name.split()) < 2
        if kind == "H":
            among = own if r.handle and _squeezed(r.handle) == key[1:] else ()
        elif kind == "I" and not one:
            among = words
        elif kind in ("A", "C") and several:
            among = words
        else:
            among = own
        for canon, theirs, node, n, canon_handle in among:
            if kind == "H" and key[1:] not in theirs:
                continue
            if not several and " " not in canon and min(len(r.name), len(canon)) <= WORD:
                cost = word_cost(r.name, r.handle, canon, canon_handle)
            else:
                cost = cost_of(r.name, r.handle, canon, theirs, known[r.name] > 1 < known[canon])
            if cost <= LIMIT and (p := math.log1p(n) * PRIOR - cost) > best:
                best, parent = p, node
        if parent:
            yield r.node, parent, best
        if r.name not in heads or (not several and len(r.name) <= WORD):
            heads.setdefault(r.name, r.node)
            own.append((r.name, handles(r.name), r.node, r.n, r.handle))
            if one:
                words.append(own[-1])


def entities(rows: DataFrame, *, author_col: str = "author_id", name_col: str = "author_display_name", handle_col: str = "author_handle") -> DataFrame:
    """author_id, entity: the author ids with the representative of their person or organisation.

    Rows without author_id are left aside.  An author without a name is known by the handle; one without either is an
    entity of its own.  Spellings are counted before any shuffle, so a hot author costs one row per distinct spelling.
    """
    rows = rows.select(F.col(author_col).cast("string").alias("author_id"), F.col(name_col).alias("name"), F.col(handle_col).alias("handle")).where("author_id IS NOT NULL")
    clean = F.pandas_udf(lambda s: s.map(spelling), "string")
    clean_handle = F.pandas_udf(lambda s: s.map(handle_spelling), "string")

    def most(col: str, udf) -> DataFrame:  # noqa: ANN001
        counted = rows.groupBy("author_id", col).agg(F.count("*").alias("n")).withColumn(col, udf(col))
        counted = counted.groupBy("author_id", col).agg(F.sum("n").alias("n"))
        rank = Window.partitionBy("author_id").orderBy((F.length(col) == 0), F.desc("n"), col)
        return counted.withColumn("total", F.sum("n").over(Window.partitionBy("author_id"))).withColumn("k", F.row_number().over(rank)).where("k = 1")

    authors = most("name", clean).select("author_id", "name", F.col("total").alias("n")).join(most("handle", clean_handle).select("author_id", "handle"), "author_id")
    authors = authors.withColumn("name", F.when(F.length("name") > 0, F.col("name")).otherwise(F.col("handle")))
    authors = materialize(authors, "authors")
    known = authors.where("length(name) > 0")
    per_name = known.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("authors"))
    forms = F.pandas_udf(lambda s: s.map(spelling_handles), "array<string>")
    squeezed = F.pandas_udf(lambda s: s.map(_squeezed), "string")
    spelt = per_name.select("name", F.explode(forms("name")).alias("form"))
    spelt = spelt.select("name", F.ltrim("form", F.lit(".")).alias("form"), F.when(F.col("form").startswith("."), 1).otherwise(WHOLE).alias("weight"))
    used = known.where("length(handle) > 0").groupBy(squeezed("handle").alias("form")).agg(F.count("*").alias("k"))
    spelt = spelt.join(used, "form").groupBy("name").agg(F.sum(F.col("k") * F.col("weight")).alias("spelt"))
    per_name = per_name.join(spelt, "name", "left").fillna(0, ["spelt"])
    nodes = materialize(known.groupBy("name", "handle").agg(F.min("author_id").alias("node")).join(per_name, "name"), "nodes")

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *r) for r in pdf.itertuples(index=False) for k in keys(r.name, r.handle)]
            yield pd.DataFrame(out, columns=["key", "node", "name", "handle", "n", "authors", "spelt"])

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, str, float]] = []
        group: list[tuple] = []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if group and group[0].key != row.key:
                    out += attributed(group, group[0].key)
                    group = []
                group.append(row)
            yield pd.DataFrame(out, columns=["node", "parent", "score"])
            out = []
        yield pd.DataFrame(list(attributed(group, group[0].key if group else "")), columns=["node", "parent", "score"])

    blocks = nodes.select("node", "name", "handle", "n", "authors", "spelt").mapInPandas(block, "key string, node string, name string, handle string, n bigint, authors bigint, spelt bigint")
    shared = blocks.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1").drop("size")
    links = shared.sortWithinPartitions("key").mapInPandas(attribute, "node string, parent string, score double")
    best = links.groupBy("node").agg(F.max(F.struct("score", "parent")).alias("b")).select("node", F.col("b.parent").alias("parent"))
    tree = nodes.select("node").join(best, "node", "left").select("node", F.coalesce("parent", "node").alias("parent"))
    tree = materialize(tree, "tree")
    while True:  # a parent comes before its variant, so the tree has no cycle and its height halves each time
        up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        tree = materialize(tree.join(up, "parent").select("node", "parent", "up"), "tree")
        moved = tree.where("parent <> up").limit(1).count()
        tree = tree.select("node", F.col("up").alias("parent"))
        if not moved:
            break
    roots = nodes.select("name", "handle", "node").join(tree, "node").select("name", "handle", F.col("parent").alias("entity"))
    found = known.join(roots, ["name", "handle"]).select("author_id", "entity")
    return found.union(authors.where("length(name) = 0").select("author_id", F.col("author_id").alias("entity")))


def pairs(rows: DataFrame, *, author_col: str = "author_id", name_col: str = "author_display_name", handle_col: str = "author_handle") -> DataFrame:
    """author_id_a, author_id_b: all pairs of author ids of one entity, the smaller first, as the result is defined."""
    found = materialize(entities(rows, author_col=author_col, name_col=name_col, handle_col=handle_col), "entities")
    a = found.select("entity", F.col("author_id").alias("author_id_a"))
    b = found.select("entity", F.col("author_id").alias("author_id_b"))
    return a.join(b, "entity").where("author_id_a < author_id_b").select("author_id_a", "author_id_b")
