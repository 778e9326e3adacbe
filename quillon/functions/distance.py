"""Edit distances between words as column expressions, thresholds, and word normal forms for fuzzy search."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def threshold(length: int) -> int:
    """Errors allowed for a query word of this length; words of fewer than four letters are not fuzzy."""
    return 0 if length < 4 else 1 if length <= 5 else 2 if length <= 10 else 3


def threshold_col(word: Column) -> Column:
    n = F.char_length(word)
    return F.when(n < 4, 0).when(n <= 5, 1).when(n <= 10, 2).otherwise(3)


def edit_distance(a: Column, b: Column, cutoff: int) -> Column:
    """Levenshtein distance, -1 beyond the cutoff."""
    return F.levenshtein(a, b, cutoff)


def prefix_distance(query: str, word: Column, cutoff: int) -> Column:
    """Least edit distance between ``query`` and a prefix of ``word``; cutoff + 1 beyond the cutoff."""
    q = F.lit(query)
    found = []
    for n in range(max(0, len(query) - cutoff), len(query) + cutoff + 1):
        d = F.levenshtein(q, F.substring(word, 1, n), cutoff)
        found.append(F.when(d >= 0, d))
    return F.coalesce(F.least(*found) if len(found) > 1 else found[0], F.lit(cutoff + 1))


def normalised_score(distance: Column, query_length: int, word_length: Column, completion: bool) -> Column:
    """100 * (1 - distance / length), at least 1: by the shorter length for completions, else the longer."""
    n = F.least(F.lit(query_length), word_length) if completion else F.greatest(F.lit(query_length), word_length)
    return F.greatest(F.lit(1), F.floor(100 * (1 - F.least(F.lit(1.0), distance / n)))).cast("int")


#: Spellings that fuzzy search takes as one (fixed values); beside them, a letter that stands twice counts once, and of sch the s is taken for the sc.
SPELLINGS = [("ue", "u"), ("ae", "a"), ("oe", "o"), ("th", "t"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("ph", "f"), ("y", "i")]
_TAKEN = r"sc(?=h)|(.)\1|" + "|".join(a for a, _ in SPELLINGS) + r"|[\s\S]"


def fuzzy_form(word: str) -> str:
    """One spelling for several: from left to right the first rule that fits takes its letters, once."""
    by = dict(SPELLINGS)
    return "".join(by.get(m[0], m[0][:1]) for m in re.finditer(_TAKEN, word))


def fuzzy_form_col(word: Column) -> Column:
    """fuzzy_form as a column expression."""
    to = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    taken = F.regexp_extract_all(word, F.lit(_TAKEN), F.lit(0))
    return F.array_join(F.transform(taken, lambda t: F.coalesce(F.try_element_at(to, t), F.substring(t, 1, 1))), "")


def ruled_distance(a: str, b: str, rules: list[tuple[str, str, float]], cutoff: float) -> float:
    """Edit distance in which a rule (from, to, cost) may rewrite a whole group of letters; cutoff + 1 beyond the cutoff."""
    m, n = len(a), len(b)
    d = [[float(i + j) if i * j == 0 else 0.0 for j in range(n + 1)] for i in range(m + 1)]
    by_end: dict[str, list[tuple[str, str, float]]] = {}
    for x, y, c in rules:
        by_end.setdefault(x[-1:], []).append((x, y, c))
    for i in range(m + 1):
        for j in range(n + 1):
            best = d[i][j] if i * j == 0 else min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i and j:
                for x, y, c in by_end.get(a[i - 1], ()):
                    if a.endswith(x, 0, i) and b.endswith(y, 0, j):
                        best = min(best, d[i - len(x)][j - len(y)] + c)
            d[i][j] = best
    return d[m][n] if d[m][n] <= cutoff else cutoff + 1


def most_edits(a: str, rules: list[tuple[str, str, float]], cutoff: float) -> int:
    """The largest Levenshtein distance from ``a`` of a word within the cutoff of ``ruled_distance``.

    A rule saves at most what its letters would cost in single edits, and applies at most as often as its letters stand apart in ``a``.
    """
    saved = sum(a.count(x) * max(0.0, ruled_distance(x, y, [], float(len(x) + len(y))) - c) for x, y, c in rules if x)
    return int(cutoff + saved + 1e-9)


def ruled_distances(a: str, words: list[str], rules: list[tuple[str, str, float]], cutoff: float) -> np.ndarray:
    """``ruled_distance`` of ``a`` and each word, a cell of the table for all words at once."""
    out, most, m = np.full(len(words), float(cutoff + 1)), most_edits(a, rules, cutoff), len(a)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.flatnonzero(np.abs(sizes - m) <= most)
    if not len(at):
        return out
    n = int(sizes[at].max())
    letters = np.array([words[k] for k in at], f"U{max(n, 1)}").view(np.uint32).reshape(len(at), -1).T
    d: list[list[np.ndarray]] = []
    for i in range(m + 1):
        d.append([])
        for j in range(n + 1):
            if i * j == 0:
                d[i].append(np.full(len(at), float(i + j)))
                continue
            best = np.minimum(np.minimum(d[i - 1][j], d[i][j - 1]) + 1, d[i - 1][j - 1] + (letters[j - 1] != ord(a[i - 1])))
            for x, y, c in rules:
                if x and len(y) <= j and a.endswith(x, 0, i):
                    fits = np.logical_and.reduce([letters[j - len(y) + k] == ord(z) for k, z in enumerate(y)]) if y else True
                    best = np.where(fits, np.minimum(best, d[i - len(x)][j - len(y)] + c), best)
            d[i].append(best)
    found = np.stack(d[m])[sizes[at], np.arange(len(at))]
    out[at] = np.where(found <= cutoff, found, cutoff + 1)
    return out


def ruled_distance_col(query: str, rules: list[tuple[str, str, float]], cutoff: float):
    @F.pandas_udf(DoubleType())
    def distance(word: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, word.index)
        known = word.notna()
        out[known] = ruled_distances(query, word[known].tolist(), rules, cutoff)
        return out.astype("Float64")

    return distance
