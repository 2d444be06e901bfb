"""A list of sources and profiles to load from: small configuration, checked as a whole."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from bomweave.sources.record import record, records, text, texts

#: How much a catalogue may list.
MAX_SOURCES, MAX_URLS, MAX_PROFILES = 100, 50, 20


@dataclass(frozen=True)
class Source:
    name: str
    urls: tuple[str, ...]


@dataclass(frozen=True)
class Catalogue:
    sources: tuple[Source, ...] = field(default_factory=tuple)
    profiles: tuple[str, ...] = field(default_factory=tuple)


def allowed(url: str) -> bool:
    """Relative, or over http."""
    scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", url)
    return not url.startswith("//") and (scheme is None or scheme[0].lower() in ("http:", "https:"))


def read(raw: object) -> Catalogue:
    """The catalogue that a JSON value describes; entries beyond the bounds or with other URLs are left out."""
    root = record(raw)
    sources = [Source(n, tuple(u for u in texts(s.get("urls"))[:MAX_URLS] if allowed(u))) for s in records(root.get("sources"))[:MAX_SOURCES] if (n := text(s.get("name")))]
    return Catalogue(tuple(s for s in sources if s.urls), tuple(u for u in texts(root.get("profiles"))[:MAX_PROFILES] if allowed(u)))
