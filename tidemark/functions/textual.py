"""Text functions of the search layer: query parsing, snippets, HTML to text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

#: Longest query in characters, most units of one.
MAX_QUERY, MAX_UNITS = 300, 20
_TOKEN = re.compile(r"[^\W_]+")


class SearchError(ValueError):
    pass


@dataclass(frozen=True)
class Unit:
    text: str
    prefix: bool = False

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(tokens(self.text))

    def __str__(self) -> str:
        quoted = self.text.replace('"', '""')
        return f'"{quoted}"*' if self.prefix else f'"{quoted}"'


@dataclass(frozen=True)
class Parsed:
    units: tuple[Unit, ...]

    @property
    def title(self) -> str:
        return " ".join(u.text for u in self.units)

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(w for u in self.units for w in _TOKEN.findall(u.text))

    @property
    def expression(self) -> str:
        return " AND ".join(map(str, self.units))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _scan_units(text: str) -> Iterator[Unit]:
    """Units from left to right. A quotation mark that starts a unit and is closed with something between makes a phrase;
    any other unit goes on to the next white space, and quotation marks in it mean nothing."""
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        close = text.find('"', at + 1) if text[at] == '"' else -1
        if close > at + 1:
            yield Unit(text[at + 1 : close].rstrip("*"))
            at = close + 1
            continue
        stop = next((i for i in range(at, len(text)) if text[i].isspace()), len(text))
        word = text[at:stop]
        yield Unit(word.replace('"', "").rstrip("*"), word.endswith("*"))
        at = stop


def parse_query(text: str) -> Parsed:
    """Quoted phrases and words; a trailing * of a bare word asks for a prefix; units without letters or digits go."""
    text = text.strip()
    if len(text) > MAX_QUERY:
        raise SearchError(f"a query has {MAX_QUERY} characters at most")
    units = tuple(u for u in _scan_units(text) if u.words)
    if not 0 < len(units) <= MAX_UNITS:
        raise SearchError(f"a query has {MAX_UNITS} terms at most" if units else "a query needs a word or a phrase")
    return Parsed(units)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()


#: Characters of an excerpt, of what it shows before a hit, and of a cut word that is given up at its edges.
LENGTH, LEAD, SLACK = 300, 80, 40
#: What a different term adds to an excerpt's score, and the most that the number of hits adds.
PER_TERM, HIT_CAP = 100, 20
#: Fixed value: terms from so many characters on also match as prefixes.
MIN_PREFIX = 3


class _Hit(NamedTuple):
    start: int
    end: int
    term: int


def _find_hits(text: str, terms) -> list[_Hit]:
    wanted = list(dict.fromkeys(fold(t) for t in terms))
    known: dict[str, int | None] = {}
    hits = []
    for m in _TOKEN.finditer(text):
        word = m[0]
        if word not in known:
            plain = fold(word)
            known[word] = next((i for i, w in enumerate(wanted) if plain == w or (len(w) >= MIN_PREFIX and plain.startswith(w))), None)
        if known[word] is not None:
            hits.append(_Hit(m.start(), m.end(), known[word]))
    return hits


def _best_window(hits: list[_Hit], n: int, length: int) -> int:
    """Start of the best window. Windows open LEAD before a hit, so they move to the right with the hits: both ends are
    walked once, with a count of each term between them."""
    inside: Counter = Counter()
    low = high = 0
    best = (0.0, 0)
    for hit in hits:
        start = max(0, hit.start - LEAD)
        while high < len(hits) and hits[high].end <= start + length:
            inside[hits[high].term] += 1
            high += 1
        while low < high and hits[low].start < start:
            inside[hits[low].term] -= 1
            low += 1
        score = PER_TERM * sum(c > 0 for c in inside.values()) + min(max(0, high - low), HIT_CAP) - start / n
        if score > best[0]:
            best = (score, start)
    return best[1]


def snippet(text: str | None, terms, length: int = LENGTH) -> dict:
    """The excerpt of a text that covers most different terms, then most hits, then is nearest to the start: text,
    whether something stands before and after it, and (start, end) of each hit inside."""
    text = " ".join((text or "").split())
    hits = _find_hits(text, terms)
    start = _best_window(hits, max(1, len(text)), length)
    if start > 0 and (gap := text.find(" ", start, start + SLACK)) >= 0:
        start = gap + 1
    end = min(len(text), start + length)
    if end < len(text) and (gap := text.rfind(" ", max(0, end - SLACK + 1), end + 1)) >= 0:
        end = gap
    return {"text": text[start:end], "before": start > 0, "after": end < len(text), "hits": [(h.start - start, h.end - start) for h in hits if h.start >= start and h.end <= end]}


#: Elements whose content is no text, and elements that end a word.
DROPPED = ("script", "style", "nav", "iframe", "object", "embed")
BLOCKS = ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "br")
#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []
        self.body_only = True

    @property
    def silent(self) -> bool:
        return any(s for _, s in self.open)

    def handle_starttag(self, tag, attrs):
        gone = tag in DROPPED or tag in ("head", "title") or any(k == "hidden" for k, _ in attrs)
        if tag in BLOCKS and tag in VOID:
            self.out.append(" ")
        if tag not in VOID:
            self.open.append((tag, gone))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag in BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def html_text(html: str | bytes | None) -> str:
    if html is None:
        return ""
    p = _Text()
    p.feed(html.decode("utf-8", "replace") if isinstance(html, (bytes, bytearray)) else html)
    p.close()
    return re.sub(r"\s+", " ", "".join(p.out)).strip()
