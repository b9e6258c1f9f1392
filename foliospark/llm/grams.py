"""Character n-gram naive Bayes with a background that all classes share.

A class's n-grams are mixed with those of all classes, so an n-gram that a class lacks tells against it, but one that no
class has tells nothing: unfamiliar text is no evidence, and what stays below the background is of no class.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np

#: Length of the longest n-grams, and the part of the background in a class.
LONGEST, BACKGROUND = 4, 0.1
DIGITS, SPACES = re.compile(r"\d"), re.compile(r"\s+")


def folded(s: str) -> str:
    """Lower case, plain forms, digits and white space as one character each, a blank on either end."""
    return f" {SPACES.sub(' ', DIGITS.sub('0', unicodedata.normalize('NFKC', s).lower())).strip()} "


def hashes(s: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a folded text as numbers, and where each begins."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, at = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        out.append(h.copy())
        at.append(np.arange(m))
    return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


#: The n-grams of some texts, in order, and how often each occurs.
Counts = tuple[np.ndarray, np.ndarray]


def counted(texts: Iterable[str]) -> Counts:
    parts = [hashes(folded(t))[0] for t in texts if t]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def summed(parts: Sequence[Counts]) -> Counts:
    every, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(every), np.int64)
    np.add.at(n, where, np.concatenate([n for _, n in parts]))
    return every, n


class Bayes:
    """Naive Bayes of the classes' texts, or of their counts; n-grams met fewer than `least` times in all are left out."""

    def __init__(self, texts: dict[str, Sequence[str] | Counts], least: int = 1):
        self.classes = list(texts)
        counts = [t if isinstance(t, tuple) else counted(t) for t in texts.values()]
        every, where = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
        share, total = np.zeros((len(every), len(counts)), np.float64), np.zeros(len(every))
        at = 0
        for k, (g, n) in enumerate(counts):
            rows = where[at : at + len(g)]
            at += len(g)
            share[rows, k] = n / max(1, n.sum())
            total[rows] += n
        kept = total >= least
        share = share[kept]
        mean = share.mean(axis=1, keepdims=True)
        self.grams = every[kept]
        self.ratio = np.log((1 - BACKGROUND) * share / mean + BACKGROUND).astype(np.float32)

    def rows(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        """The log-ratios of the known n-grams of a folded text, and where each begins."""
        g, at = hashes(s)
        if not len(self.grams):
            return np.zeros((0, len(self.classes)), np.float32), at[:0]
        i = np.searchsorted(self.grams, g)
        i[i == len(self.grams)] = 0
        known = self.grams[i] == g
        return self.ratio[i[known]], at[known]

    def scores(self, text: str) -> np.ndarray:
        """Log-likelihood of each class over the background's."""
        return self.rows(folded(text))[0].sum(axis=0)

    def parts(self, texts: Sequence[str]) -> np.ndarray:
        """The scores of each of the texts, found in one go."""
        pieces = [folded(t) for t in texts]
        bounds = np.cumsum([0, *map(len, pieces)])
        rows, at = self.rows("".join(pieces))
        out = np.zeros((len(pieces), len(self.classes)), np.float32)
        np.add.at(out, np.searchsorted(bounds, at, "right") - 1, rows)
        return out
