"""Canonical forms of a text: the word sequence, the kind and the labelled fields.

Shared by the duplicate operators.  Pure Python, so that one definition serves the Arrow
workers, the tests and the brute-force checks.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

_INVISIBLE = regex.compile(r"\p{Cf}+")
_WORD = re.compile(r"[^\W_]+")
#: What a kind keeps: letters, digits and a point or comma between two digits.
_KEPT = re.compile(r"[^\W_]+(?:[.,](?<=[0-9][.,])(?=[0-9])[^\W_]+)*")
_POINT = re.compile(r"[0-9][.,][0-9]")
#: What may stand between fields, and the least number of fields that it takes there.
_SPLITS = ((re.compile(r"[|\r\n]+"), 2), (re.compile(r"\t+"), 2), (re.compile(r";+"), 2), (re.compile(r",+"), 3))
_LABEL = r"[^\W\d_][\w'/]*(?:[^\S\r\n]+[\w'/]+){0,3}"
_FIELD_COLON = re.compile(rf"[^\w\"{{]*({_LABEL})\s*[:=]\s*(.*\w.*)", re.DOTALL)
_FIELD_DASH = re.compile(rf"[^\w\"{{]*({_LABEL})\s+[-–—]\s+(.*\w.*)", re.DOTALL)
_OBJECT = re.compile(r"\{.*\}", re.DOTALL)
_JSON_FIELD = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|(-?\d[\d.e+-]*|true|false|null))')
_JSON_REST = re.compile(r"[\s,{}]*")


def folded(text: str) -> str:
    """Without invisible characters, in NFKC and without case; NFKC again since folding may undo it."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold())


def words(text: str | None) -> list[str]:
    """Runs of letters or digits without case and in NFKC; empty for null."""
    return _WORD.findall(folded(text)) if text else []


def _letters(flat: str) -> str:
    return "".join(_KEPT.findall(flat))


def fields(text: str) -> list[tuple[str, str]] | None:
    """Label and value pairs of a text that only lists labelled fields, else None.

    Layouts: one flat JSON object; parts divided by bars or line ends, tabs, semicolons or (three at least) commas,
    each ``label: value``, ``label = value`` or ``label - value``, with or without a bullet.  At least two fields.
    """
    if '":' in text or '" :' in text:
        if inner := _OBJECT.search(text):
            around = text[: inner.start()] + text[inner.end() :]
            if not _WORD.search(around):
                found = _JSON_FIELD.findall(inner.group())
                if len(found) > 1 and _JSON_REST.fullmatch(_JSON_FIELD.sub("", inner.group())):
                    return [(_unescaped(a), _unescaped(b) or c) for a, b, c in found]
    for split, least in _SPLITS:
        parts = [p for p in split.split(text) if _WORD.search(p)]
        if len(parts) >= least:
            found = [_FIELD_COLON.fullmatch(p) or _FIELD_DASH.fullmatch(p) for p in parts]
            if all(found):
                return [(m[1], m[2]) for m in found]
    return None


def _may_list(flat: str) -> bool:
    """Whether a look for fields pays: two signs that stand behind labels, or lines and bars."""
    return "|" in flat or "\n" in flat or "\r" in flat or flat.count(":") + flat.count("=") > 1


def _unescaped(body: str) -> str:
    if "\\" not in body:
        return body
    try:
        return json.loads(f'"{body}"', strict=False)
    except ValueError:
        return body


def kind_and_words(text: str) -> tuple[str, list[str]]:
    """kind() and words() with one folding."""
    flat = folded(text)
    found = _WORD.findall(flat)
    if _may_list(flat):
        return _kind(flat), found
    return (_letters(flat) if _POINT.search(flat) else "".join(found)), found


def kind(text: str | None) -> str | None:
    """Equal for texts that differ in formatting only; None for null.

    A field list is its sorted ``label=value`` pairs; other texts are their letters and digits.  A text
    without a letter or digit has the kind "".
    """
    return None if text is None else _kind(folded(text))


def _kind(flat: str) -> str:
    if _may_list(flat) and (found := fields(flat)):
        return "\x1d" + "\x1e".join(sorted(f"{_letters(a)}={_letters(b)}" for a, b in found))
    return _letters(flat)
