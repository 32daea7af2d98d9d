"""Source lists and settings, checked when they are made (SRC-21, SRC-22)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from tideline.functions.urls import handle_key

_NAME = re.compile(r"[a-z0-9_]{1,40}")


def _unique(what: str, values: Iterable[str]) -> tuple[str, ...]:
    values = tuple(values)
    if len(set(values)) != len(values):
        raise ValueError(f"{what} repeat")
    return values


@dataclass(frozen=True)
class SourceList:
    """Handles, named queries and feeds to read, and block lists; handles are compared without @ and case."""

    accounts: tuple[str, ...] = ()
    queries: Mapping[str, str] = field(default_factory=dict)
    feeds: Mapping[str, str] = field(default_factory=dict)
    blocked_authors: tuple[str, ...] = ()
    blocked_terms: tuple[str, ...] = ()

    @classmethod
    def of(cls, raw: Mapping[str, Any]) -> SourceList:
        """From a parsed document; unknown keys, repeated names and feeds and malformed names are errors."""
        if extra := set(raw) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys {sorted(extra)}")
        queries, feeds = dict(raw.get("queries") or {}), dict(raw.get("feeds") or {})
        if bad := [n for n in (*queries, *feeds) if not _NAME.fullmatch(n)]:
            raise ValueError(f"malformed names {bad}")
        _unique("feeds", feeds.values())
        return cls(
            _unique("accounts", map(handle_key, raw.get("accounts") or ())), queries, feeds,
            tuple(sorted({handle_key(a) for a in raw.get("blocked_authors") or ()})), tuple(sorted({t.casefold() for t in raw.get("blocked_terms") or ()})),
        )


@dataclass(frozen=True)
class Settings:
    """Bounds of the collection; out-of-range values and contradictions are errors."""

    lookback_minutes: int = 60
    lag_minutes: int = 2
    most_minutes: int = 1440
    max_age_hours: int = 72
    least_length: int = 20
    languages: tuple[str, ...] | None = ("english",)

    def __post_init__(self) -> None:
        for name, low, high in (("lookback_minutes", 1, 10_080), ("lag_minutes", 0, 60), ("most_minutes", 1, 10_080), ("max_age_hours", 1, 8760), ("least_length", 0, 10_000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.most_minutes < self.lookback_minutes:
            raise ValueError("most_minutes must cover the lookback")
