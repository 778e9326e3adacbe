"""The query language: from a query string to a tree.

Parts are separated by a space (same document), a dot (next word), two dots (nearby), an equals
sign (same place) or a flexible run like ``.,,.`` (so many words on) and ``.;;.`` (so many back).
Separators bind from left to right; ``|`` (or) and ``[q1#q2]`` (value join) bind more tightly.
A last part ``-w`` excludes, ``(w)`` is optional. ``w*`` is a prefix, ``a--b`` a range of words,
``w~`` fuzzy, ``w^`` synonyms; ``"..."`` takes separators literally.
"""

from __future__ import annotations

import re
import urllib.parse
from dataclasses import dataclass, field

from ..functions.text import normal_form


@dataclass(frozen=True)
class Word:
    text: str
    prefix: bool = False
    fuzzy: bool = False
    synonyms: bool = False


@dataclass(frozen=True)
class Range:
    low: str
    high: str
    high_prefix: bool = False


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Join:
    queries: tuple


@dataclass(frozen=True)
class And:
    first: object
    last: object


@dataclass(frozen=True)
class Near:
    first: object
    last: object
    low: int
    high: int


@dataclass(frozen=True)
class Not:
    first: object
    last: object


@dataclass(frozen=True)
class Optional:
    first: object
    last: object


class QueryError(ValueError):
    """The query string has no meaning; the message says why."""


_SEPARATOR = re.compile(r"\.,+\.|\.;+\.|\.\.|\.|=| +")
_SPECIAL = ' .=|#[]()"~^,;'


def quoted(q: str) -> str:
    """Separators between double quotes as %hh, quotes off; an open quote runs to the end."""
    parts = q.split('"')
    return "".join(p if k % 2 == 0 else "".join(f"%{ord(c):02X}" if c in _SPECIAL + "%*-" else c for c in p) for k, p in enumerate(parts))


def _plain(w: str) -> str:
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), w)


def cleaned(q: str) -> str:
    """Suffix signs without a word and operators after a separator go; suffixes come in the order * ^ ~."""
    q = re.sub(r"(?<=[ |#])[*^~#|]+(?=\S)|(?<=[ |#])[*^~]+$", "", q.strip())
    return re.sub(r"(?<=\w)[*^~]{2,}", lambda m: "".join(c for c in "*^~" if c in m[0]), q)


def _word_part(parts: list[str]) -> int | None:
    """Which part of a word with separators is a word of text, so that its normal form counts."""
    n, led = len(parts), parts[0] != ""
    last = None if "facet" in parts[:2] else n - 1
    if n == 4 and led:  # word:C:7:* of a cluster; else a field's value with something before it, which stays
        return 0 if parts[1] in ("C", "S") else None
    return {1: 0, 2: 0 if led else None, 3: None, 4: last, 5: 3, 6: last, 7: 5}.get(n)


def normalised_part(part: str) -> str:
    """A word or range of a query; of special words (``:filter:F:w``, ``w:*``, ``:filter:F:w:*``) only w takes its
    normal form, names of fields, cluster numbers and facet values stay."""
    out = []
    for side in part.split("--", 1):
        parts = side.split(":")
        at = _word_part(parts)
        out.append(":".join(normal_form(p) if k == at else p for k, p in enumerate(parts)))
    return "--".join(out)


_NORMALISED = re.compile(r"[\w:%]+\*?--[\w:%]+\*?|(?<![\w:|~^%])(?<!\S-)([\w:%]+)(\*?)(?![\w:~^*|%-])")


def normalised(q: str) -> str:
    """Each plain word w also as its normal form's range: ``norm:w:*|w``; of special words and ranges the part that is a word."""
    def turn(m):
        w, star = m[1], m[2]
        if w is None or ":" in w:
            return normalised_part(m[0])
        return f"norm:{normal_form(w)}{star}|{w}{star}" if star else f"norm:{normal_form(w)}:*|{w}"
    return _NORMALISED.sub(turn, quoted(q))


def _top_level(q: str) -> list[tuple[str, str]]:
    """(separator before, part) of each part; nothing inside brackets separates."""
    out, depth, part, sep, i = [], 0, "", "", 0
    while i < len(q):
        c = q[i]
        depth += (c in "[(") - (c in "])")
        m = _SEPARATOR.match(q, i) if depth <= 0 else None
        if m and part:
            out.append((sep, part))
            part, sep = "", m[0]
        elif m:
            sep = m[0] if not sep or m[0].strip() else sep
        else:
            part += c
        i = m.end() if m else i + 1
    return [*out, (sep, part)] if part else out


def parse(q: str, window: tuple[int, int] = (-10, 10)):
    """The tree of a query, or None for the empty query."""
    tree = None
    for sep, part in _top_level(quoted(q.strip())):
        if part.startswith("-") and len(part) > 1:
            if tree is None or sep.strip():
                raise QueryError("exclusion needs a part before it, in the same document")
            tree = Not(tree, _part(part[1:], window))
        elif part.startswith("(") and part.endswith(")") and "|" not in part:
            if sep.strip():
                raise QueryError("an optional part takes no position")
            inner = parse(part[1:-1], window)
            tree = inner if tree is None else Optional(tree, inner)
        else:
            last = _part(part, window)
            if tree is None:
                tree = last
            elif not sep.strip():
                tree = And(tree, last)
            elif sep == ".":
                tree = Near(tree, last, 1, 1)
            elif sep == "..":
                tree = Near(tree, last, *window)
            elif sep == "=":
                tree = Near(tree, last, 0, 0)
            else:
                n = (len(sep) - 2) * (1 if "," in sep else -1)
                tree = Near(tree, last, n, n)
    return tree


def _part(part: str, window):
    if part.startswith("[") and part.endswith("]"):
        inner = _split(part[1:-1], "#")
        if len(inner) < 2:
            raise QueryError("a join needs two queries or more")
        return Join(tuple(parse(x, window) for x in inner))
    if part.startswith("(") and part.endswith(")"):
        part = part[1:-1]
    some = [_word(w) for w in _split(part, "|") if w]
    if not some:
        raise QueryError(f"no word in {part!r}")
    return some[0] if len(some) == 1 else Or(tuple(some))


def _split(s: str, by: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in s:
        depth += (c in "[(") - (c in "])")
        if c == by and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def _word(w: str):
    body = w.rstrip("*^~")
    signs = w[len(body) :]
    if not body:
        raise QueryError("a bare * matches everything")
    if "--" in body and not body.startswith("--"):
        low, _, high = body.partition("--")
        return Range(_plain(low.rstrip("*")), _plain(high), "*" in signs)
    return Word(_plain(body), "*" in signs, "~" in signs, "^" in signs)


@dataclass
class Parameters:
    """What a request asks for beside the query; see from_url for the letters."""

    query: str = ""
    completions: int = 10
    hits: int = 20
    first_hit: int = 0
    excerpts: int = 5
    excerpt_radius: int = 5
    rank_docs: str = "0d"
    rank_words: str = "0d"
    window: tuple[int, int] = (-10, 10)
    fuzzy_dampening: float = 1.0
    aggregation: str = "SSSS"
    part: int = 0
    format: str = "xml"
    callback: str = ""
    extra: dict = field(default_factory=dict)

    #: The largest number of hits, completions, excerpts and excerpt words a request may ask for (fixed values).
    MOST = (10000, 1000, 1000, 1000)

    @classmethod
    def from_url(cls, url: str) -> "Parameters":
        """q query, c completions, h hits, f first hit, en and er excerpts and radius, rd and rw ranking of documents
        and words, n window as low,high, fd dampening, s aggregation letters, p info part, format, callback."""
        got = dict(urllib.parse.parse_qsl(url.partition("?")[2], keep_blank_values=True, errors="replace"))
        number = lambda k, old, most: min(most, max(0, int(got[k]))) if got.get(k, "").lstrip("-").isdigit() else old
        p = cls(query=got.get("q", ""))
        p.hits, p.completions = number("h", p.hits, cls.MOST[0]), number("c", p.completions, cls.MOST[1])
        p.excerpts, p.excerpt_radius = number("en", p.excerpts, cls.MOST[2]), number("er", p.excerpt_radius, cls.MOST[3])
        p.first_hit, p.part = number("f", 0, 1 << 31), number("p", 0, 1 << 31)
        p.rank_docs, p.rank_words = got.get("rd", p.rank_docs), got.get("rw", p.rank_words)
        if m := re.fullmatch(r"(-?\d+),(-?\d+)", got.get("n", "")):
            low, high = int(m[1]), int(m[2])
            p.window = (low, high) if low <= high else p.window
        try:
            fd = float(got.get("fd", p.fuzzy_dampening))
            p.fuzzy_dampening = fd if 0.01 <= fd <= 1 else p.fuzzy_dampening
        except ValueError:
            pass
        p.aggregation = got["s"].upper() if re.fullmatch("[SMBsmb]{4}", got.get("s", "")) else p.aggregation
        p.format, p.callback = got.get("format", p.format), got.get("callback", "")
        p.extra = {k: v for k, v in got.items() if k in ("exe", "_")}
        return p

    @property
    def k_hits(self) -> int:
        return max(self.first_hit + self.hits, 100)

    @property
    def k_words(self) -> int:
        return max(self.completions, 100)


def separators_mapped(q: str, frontend: str = ":", backend: str = "!") -> str:
    """The separator of artificial words as the index has it."""
    return q.replace(frontend, backend)
