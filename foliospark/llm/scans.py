"""Text extracted from scanned pages: broken words, misread characters, running headers and page numbers.

Pass one counts the words of all texts, with map-side combining. The commonest words (a bounded number, a parameter)
and a character model of them form the language model that each worker gets.

Pass two reads each text once. Lines that are page numbers or running headers are set aside; the others form one
de-lined stream of characters in which words are decoded by a noisy channel: a word stays as it is, or was read through
one or two confusions, or goes on after a hyphen at a line's end, or fell apart or together. Each distinct word is decoded once per worker and
remembered. Paragraph boundaries are chosen by dynamic programming over the lines.

Null texts give no rows, empty ones one empty paragraph. Repeated rows give equal results, kept once per key.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.corpus import Words, built, common_words
from foliospark.llm.forms import FOREIGN, LETTERS, one_script
from foliospark.session import once, spread, table

# What is printed and what is read for it, in any scan. The corpus's own confusions are learned besides.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("t", "f"), ("n", "ri"), ("i", "j"), ("o", "0"), ("d", "cl"), ("s", "5"), ("l", "I"), ("l", "1"),
    ("h", "b"), ("u", "ii"), ("m", "rn"), ("g", "9"), ("v", "y"), ("in", "m"), ("w", "vv"), ("b", "6"), ("li", "h"), ("rn", "m"),
    ("O", "0"), ("S", "5"), ("I", "l"), ("I", "1"), ("B", "8"), ("G", "6"), ("ni", "m"),
)
# Digits and the letters read for them.
DIGITS = {"l": "1", "I": "1", "O": "0", "o": "0", "B": "8", "S": "5", "Z": "2", "|": "1"}
#: A word is read in place of another that is so many times as frequent.
RATIO = 40
#: A capitalised word is read for another such only if that has this share of all words: names resemble each other.
NAMED = 2e-5
#: Words in the language model, the commonest of the corpus. Bounds what is sent to the workers.
VOCABULARY = 200_000
#: What a confusion costs in an unknown word, in nats of the character model.
CONFUSION_COST, DIGIT_GAIN = 3.0, 4.0
#: What a letter of an unknown word, a blank lost between words and a blank too many in a word cost, in nats; letters of
#: the longest known word in a run without blanks; letters of a run that can't be one word, and the part of it that known
#: words must make.
UNKNOWN_COST, MERGED_COST, SPLIT_COST, LONGEST, RUN, KNOWN = 3.0, 3.0, 3.0, 24, 40, 0.8
FLUSH = 300_000
#: Rare words that must differ from common ones by a confusion for it to be learned, and their part of all such words.
LEARNED, LEARNED_SHARE = 8, 0.005

# Weights of characters for which a word's sum stays the same through every confusion.
SUMS = {c: (ord(c) * 0x9E3779B97F4A7C15) % (1 << 40) for c in "aceotsvkpqxz237"}
SUMS |= {"c": SUMS["e"], "f": SUMS["t"], "d": SUMS["e"] + 1, "0": SUMS["o"], "5": SUMS["s"], "4": 4 << 41, "y": SUMS["v"], "w": 2 * SUMS["v"]} | dict.fromkeys("ijlr1", 1) | dict.fromkeys("nuhb689g", 2) | {"m": 3}


def confusion_sum(w: str) -> int:
    """Equal for words of which one may be read for the other: what to look for before trying every confusion."""
    return sum(SUMS.get(c) or ord(c) << 42 for c in w.lower())


EDGES = re.compile(r"^[^\w]+|[^\w]+$")
IGNORABLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
JAPANESE = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ]")
HYPHENS = "-¬=‐"
PAGE_NUMBER = re.compile(r"^[\W_]*(?:(?:page|p\.|pag\.|seite)\s*)?([0-9lIOoBSZ|]{1,5}|[ivxlcdmIVXLCDM1]{1,12})[\W_]*$", re.I)
ROMAN = re.compile(r"^m{0,4}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})$")
NUMBER = r"(?:[0-9lIOoBSZ]{1,4}|[ivxlcdm]{1,9})"
NUMBERED = re.compile(rf"^(?:{NUMBER}\s{{2,}}(?P<a>\S.*)|(?P<b>.*\S)\s{{2,}}{NUMBER})$")
SMALL = frozenset("of the and in on a an to for from by at with de la le und der die das et".split())
JOURNAL = re.compile(r"^(.*[^\W\d].*?)\s+[0-9lIOoBSZ]{1,3}\s*\([0-9lIOoBSZ]{1,3}\)$")


def plain(token: str) -> str:
    """The token without punctuation around it and without invisible characters, in composed and plain forms."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", IGNORABLE.sub("", token))
        if FOREIGN.search(token):
            token = LETTERS.sub(lambda m: one_script(m[0], None), token)
    return EDGES.sub("", token)


def count_words(text: str, counts: Counter) -> None:
    """Adds the words of a text. Broken words and what follows them are left out."""
    for line in text.split("\n"):
        words = line.split()
        if words and words[-1][-1] in HYPHENS:
            words.pop()
        counts.update(words)


def learned(words: dict[str, int]) -> set[tuple[str, str]]:
    """(printed, read) of the confusions in which rare words differ from words RATIO times as common: one or two
    characters for one or two. Linear in the words' characters, by the places that both have around the difference."""
    total = sum(words.values())
    around: dict[tuple[str, str], list[str]] = {}
    holes = lambda w: ((w[:i], w[i : i + k], w[i + k :]) for k in (1, 2) for i in range(len(w) - k + 1))
    usable = {w: n for w, n in words.items() if len(w) > 4 and w.isalnum() and w[0].islower() and not JAPANESE.search(w)}
    for w, n in usable.items():
        if n >= max(RATIO * 2, NAMED * total) and w.isalpha() and len(w) > 5:
            for a, x, b in holes(w):
                around.setdefault((a, b), []).append(x)
    counts: Counter = Counter()
    for w, n in usable.items():
        met = {(x, y) for a, y, b in holes(w) for x in around.get((a, b), ()) if len(x) + len(y) < 4 and words[a + x + b] >= RATIO * n}
        counts.update(met)
    least = max(LEARNED, LEARNED_SHARE * sum(counts.values()))
    return {pair for pair, n in counts.items() if n >= least}


class Cell:
    """A word of the de-lined stream: its line, what was read, that without punctuation, what was printed, the defects in
    it, and its joints: lines that end in it with a hyphen, and where in the core."""

    __slots__ = ("line", "raw", "core", "text", "found", "joints")

    def __init__(self, line: int, raw: str, core: str, text: str, found: list[tuple[int, str, str]], joints: tuple[tuple[int, int], ...] = ()):
        self.line, self.raw, self.core, self.text, self.found, self.joints = line, raw, core, text, found, joints


class Language:
    """Word counts, and a character model of the words that no count is known of."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.unknown = n if (n := getattr(words, "left_out", 1)) > 1 else 0  # what the count of a word left out may be
        self.total = math.log(sum(words.values()) + 1)
        self.least = max(RATIO, NAMED * sum(words.values()))
        grams: Counter = Counter()
        for w, n in words.items():
            if w.isalpha() and not JAPANESE.search(w):
                s, weight = f"\x02\x02{w.lower()}\x03", 1 + math.log(n)
                for i in range(2, len(s)):
                    grams[s[i - 1 : i + 1]] += weight
                    grams[s[i - 2 : i + 1]] += weight
        first: Counter = Counter()
        for g, n in grams.items():
            first[g[:-1]] += n
        self.grams, self.first = grams, first
        self.inverse, self.by_first = {}, {}
        for printed, read in sorted({*CONFUSIONS, *learned(words)}):
            self.inverse.setdefault(read, []).append(printed)
            self.by_first.setdefault(printed[0], []).append((printed, read))
        self.lengths = sorted({len(r) for r in self.inverse}, reverse=True)
        self.costs: dict[str, float] = {}
        self.known: dict[str, str | None] = {}
        self.tokens: dict[str, tuple[str, str] | None] = {}
        self.joined: dict[tuple[str, str], str] = {}
        self.automaton: ahocorasick.Automaton | None = None
        self.cuts: dict[str, tuple[float, list[str], list[str]] | None] = {}
        self.odds: dict[str, bool] = {}
        self.most = max(words.values(), default=1)
        self.heads = self.fallen()
        self.sums = {confusion_sum(w) for w in words}

    def count(self, w: str) -> int:
        """How often a word occurs; one in capitals, or at a sentence's start, as its small form too."""
        n = self.words.get(w, 0)
        if w[:1].isupper():
            low = w.lower()
            n = max(n, self.words.get(low, 0), self.words.get(low.capitalize(), 0) if w.isupper() else 0)
        return n

    def fluency(self, w: str) -> float:
        """Log-probability of a word by its characters, trigrams backed off to bigrams."""
        s, costs, total = f"\x02\x02{w.lower()}\x03", self.costs, 0.0
        for i in range(3, len(s) + 1):
            gram = s[i - 3 : i]
            try:
                total += costs[gram]
            except KeyError:
                two = gram[1:]
                p2 = (self.grams.get(two, 0) + 0.01) / (self.first.get(two[0], 0) + 1)
                p3 = (self.grams.get(gram, 0) + 3 * p2) / (self.first.get(gram[:-1], 0) + 3)
                costs[gram] = math.log(p3)
                total += costs[gram]
        return total

    def unread(self, w: str) -> set[str]:
        """Words that are read as w through one confusion."""
        out = set()
        for i in range(len(w)):
            for k in self.lengths:
                for printed in self.inverse.get(w[i : i + k], ()) if i + k <= len(w) else ():
                    out.add(w[:i] + printed + w[i + k :])
        return out

    def decode(self, w: str) -> str | None:
        """The word that was printed where w was read, None if it is w itself."""
        if w in self.known:
            return self.known[w]
        if len(self.known) > FLUSH:
            self.known.clear()
        self.known[w] = v = self._decode(w)
        return v

    def _decode(self, w: str) -> str | None:
        if len(w) < 2 or len(w) > 40 or JAPANESE.search(w):
            return None
        number = "".join(DIGITS.get(c, c) for c in w)
        if any(c.isdigit() for c in w) and number.isdigit() and number != w:
            return number
        if number.isdigit() and len(w) >= 3 and number != w and not w.isalpha():
            return number
        if not any(c.isalpha() for c in w):
            return None
        if "-" in w:
            whole = max(((self.count(v), v) for v in self.unread(w)), default=(0, ""))
            if whole[0] > RATIO * max(self.count(w), 0.5 / RATIO):
                return whole[1]
            if self.count(w):
                return None
            parts = [self.decode(p) or p for p in w.split("-")]
            return v if (v := "-".join(parts)) != w else None
        n = self.count(w) or self.unknown
        ones = self.unread(w)
        best, v = max(((self.count(v), v) for v in ones), default=(0, ""))
        if best >= max(RATIO * n, self.least if w[:1].isupper() and v.lower() not in self.words else 4 if n == 0 else 0) and best > 0:
            return v
        odd = any(c.isdigit() for c in w) or not (w.islower() or w.isupper() or w[1:].islower())
        if n > 2 and not odd:
            return None
        if n == 0 or odd:  # two confusions in one word
            twos = {x for v in ones for x in self.unread(v)}
            best, v = max(((self.count(x), x) for x in twos if x != w), default=(0, ""))
            if best >= 4 * RATIO and len(w) > 4:
                return v
        if w[:1].isupper() or odd:  # a name: by its characters
            own = self.fluency(w) - (DIGIT_GAIN * 3 if odd else 0)
            best, v = max(((self.fluency(x) + 0.5 * math.log1p(self.count(x)), x) for x in ones if x.isalpha() and (x.isupper() or x[1:].islower())), default=(-1e9, ""))
            if best - CONFUSION_COST - (0 if odd else DIGIT_GAIN) > own:
                return v
        return None

    def join(self, a: str, b: str) -> str:
        """The word that a and b are the halves of; with its hyphen if the corpus writes it so."""
        if (v := self.joined.get((a, b))) is None:
            one, two = a + b, f"{a}-{b}"
            n1, n2 = self.count(one), self.count(two)
            if not n1 and not n2:
                d1, d2 = self.decode(one), self.decode(two)
                n1, n2 = self.count(d1) if d1 else 0, self.count(d2) if d2 else 0
                if not n1 and not n2:  # a compound not met before: both halves words of their own, the whole not fluent
                    n2 = int(min(self.count(a), self.count(b)) > 50 and len(b) > 3)
                one, two = d1 or one, (d2 or two) if n2 and d2 else two
            elif n1 >= n2 and (d := self.decode(one)):
                one = d
            v = two if n2 > n1 else one
            if len(self.joined) > FLUSH:
                self.joined.clear()
            self.joined[a, b] = v
        return v

    def cost(self, w: str) -> float:
        """What a word costs on a path through the stream: unknown ones by their length."""
        n = self.count(w)
        return self.total - math.log(n) if n else self.total + UNKNOWN_COST * len(w)

    def fallen(self) -> dict[str, set[str]]:
        """Known words that, put before what the set holds, are likelier one word that fell apart into known ones."""
        out: dict[str, set[str]] = {}
        words = self.words

        def ways(w: str, n: int) -> Iterator[tuple[str, float]]:  # first words, and what the cut into at most n costs
            for i in range(1, len(w)):
                if w[:i] in words:
                    rest = [self.cost(w[i:]) - SPLIT_COST] if w[i:] in words else []
                    if n > 2:
                        rest += [c - SPLIT_COST for _, c in ways(w[i:], n - 1)]
                    if rest:
                        yield w[:i], self.cost(w[:i]) + max(rest)

        for w in words:
            if w.islower() and w.isalpha() and not JAPANESE.search(w):
                own = self.cost(w)
                for a, cost in ways(w, 3):
                    if own < cost:
                        for x in (a, a.capitalize()):
                            out.setdefault(x, set()).add(w[len(a) :])
        return out

    def pieces(self) -> ahocorasick.Automaton:
        """All known words, and what may be read for them through one confusion, with (cost, word, length)."""
        if self.automaton is None:
            found: dict[str, tuple[float, str, int]] = {}
            for w, n in self.words.items():
                if w.islower() and len(w) <= LONGEST:
                    found[w] = (self.total - math.log(n), w, len(w))
            for w, n in self.words.items():
                if n >= RATIO and w.islower() and 2 < len(w) <= LONGEST:
                    cost = self.total - math.log(n) + CONFUSION_COST
                    for i in range(len(w)):
                        for printed, read in self.by_first.get(w[i], ()):
                            v = w[:i] + read + w[i + len(printed) :]
                            if w.startswith(printed, i) and v.islower() and v not in self.words and cost < found.get(v, (math.inf,))[0]:
                                found[v] = (cost, w, len(v))
            self.automaton = ahocorasick.Automaton()
            for v, x in found.items():
                self.automaton.add_word(v, x)
            if found:
                self.automaton.make_automaton()
        return self.automaton

    def cut(self, run: str) -> tuple[float, list[str], list[str]]:
        """The likeliest cut of a run of letters into words: its cost, the words, and what was read for each. Linear in
        the run's length: known words are met by one automaton, and of unknown ones only the best start is held."""
        words: list[list[tuple[float, str, int]]] = [[] for _ in range(len(run) + 1)]
        automaton = self.pieces()
        if len(automaton):
            for end, x in automaton.iter(run):
                words[end + 1].append(x)
        costs, back = [0.0], [(0, "")]
        start, at = 0.0, 0  # the least of costs[i] - UNKNOWN_COST * i, and its i
        for j in range(1, len(run) + 1):
            best = (start + self.total + UNKNOWN_COST * j + MERGED_COST, at, "")
            for cost, w, n in words[j]:
                if (c := costs[j - n] + cost + MERGED_COST) < best[0]:
                    best = (c, j - n, w)
            costs.append(best[0])
            back.append((best[1], best[2]))
            if best[0] - UNKNOWN_COST * j < start:
                start, at = best[0] - UNKNOWN_COST * j, j
        out, read, j = [], [], len(run)
        while j:
            i, w = back[j]
            read.append(run[i:j])
            out.append(w or run[i:j])
            j = i
        return costs[-1] - MERGED_COST, out[::-1], read[::-1]

    def apart(self, w: str) -> tuple[float, list[str], list[str]] | None:
        """The cut of a word that is likelier than the word itself, None if there is none. Names stay whole; a run that
        can't be a word may hold some."""
        if w not in self.cuts:
            cut = self.cut(w) if w.islower() and self.cost(w) > 2 * (self.total - math.log(self.most)) + MERGED_COST else None
            if len(self.cuts) > FLUSH:
                self.cuts.clear()
            known = cut and sum(len(r) for v, r in zip(cut[1], cut[2]) if self.count(v))
            self.cuts[w] = cut if cut and len(cut[1]) > 1 and cut[0] < self.cost(w) and (known == len(w) or len(w) > RUN and known >= KNOWN * len(w)) else None
        return self.cuts[w]

    def odd(self, w: str) -> bool:
        """Whether a word may be part of another, or more than one."""
        if (v := self.odds.get(w)) is None:
            if len(self.odds) > FLUSH:
                self.odds.clear()
            self.odds[w] = v = len(w) > 1 and w.isalnum() and not "".join(DIGITS.get(c, c) for c in w).isdigit() and not JAPANESE.search(w) and (not self.count(w) or self.apart(w) is not None)
        return v

    def whole(self, cells: list[Cell], odd: bool) -> tuple[float, Cell] | None:
        """The cells as one word that fell apart, where one is odd through a confusion too, and its cost."""
        cores = [c.core for c in cells]
        if not all(x.isalnum() for x in cores) or any(c.raw[-len(c.core) :] != c.core for c in cells[:-1]) or any(c.raw[: len(c.core)] != c.core for c in cells[1:]):
            return None
        w = "".join(cores)
        if not (w[1:].islower() or w.isupper()) or len(w) > 40:
            return None
        v, cost = w, SPLIT_COST * (len(cells) - 1)
        if not self.count(w):
            v, cost = self.decode(w) if odd and confusion_sum(w) in self.sums else None, cost + CONFUSION_COST
            if not v or not self.count(v):
                return None
        first, last = cells[0].raw, cells[-1].raw
        text = first[: first.find(cores[0])] + v + last[last.rfind(cores[-1]) + len(cores[-1]) :]
        lines = [k for c in cells for k, defect, _ in c.found if defect == "hyphen"]
        if not lines and v == w:  # broken at a line's end without a hyphen
            lines = [a.line for a, b in zip(cells, cells[1:]) if a.line < b.line]
        found = [(k, "hyphen", v) for k in lines] or ([(cells[0].line, "misread", v)] if v != w else [])
        return cost + self.cost(v), Cell(cells[0].line, "".join(c.raw for c in cells), w, text, found)

    def parts(self, cell: Cell) -> tuple[float, list[Cell]] | None:
        """The words that fell together in a cell, and their cost."""
        at = cell.raw.find(cell.core)
        if at < 0 or not (cut := self.apart(cell.core)):
            return None
        cost, words, read = cut
        out, end = [], 0
        for v, r in zip(words, read):
            v = r if len(cell.core) > RUN and len(v) < 5 else v  # beside unknown names short words say too little
            begin, end = end, end + len(r)
            if any(place == end for _, place in cell.joints):
                return None  # a hyphen says that the word goes on
            over = [k for k, place in cell.joints if begin < place < end]
            out.append(Cell(cell.line, r, r, v, [(k, "hyphen", v) for k in over] or ([(cell.line, "misread", v)] if v != r else [])))
        out[0].text, out[-1].text = cell.raw[:at] + out[0].text, out[-1].text + cell.raw[at + len(cell.core) :]
        return cost, out

    def path(self, cells: list[Cell]) -> list[Cell]:
        """The cheapest path through the de-lined stream, on which words stay as decoded, fall together with their
        neighbours, or come apart. Only next to odd words and those that make a word with the next ones is there more
        than one way, so the rest is passed over."""
        cores = [c.core for c in cells] + ["", ""]
        odds, heads, at = self.odds, self.heads, []
        for k in range(len(cells)):
            w = cores[k]
            if (odds[w] if w in odds else self.odd(w)) or (w in heads and (cores[k + 1] in heads[w] or cores[k + 1] + cores[k + 2] in heads[w])):
                at.append(k)
        if not at:
            return cells
        out, done, i = [], 0, 0
        while i < len(at):
            begin, end = max(done, at[i] - 2), at[i] + 3
            while i + 1 < len(at) and at[i + 1] - 2 < end:
                i += 1
                end = at[i] + 3
            end, i = min(end, len(cells)), i + 1
            out += cells[done:begin]
            out += self._path(cells[begin:end])
            done = end
        return out + cells[done:]

    def _path(self, cells: list[Cell]) -> list[Cell]:
        odd = [self.odd(c.core) for c in cells]
        best: list[tuple[float, int, list[Cell]]] = [(0.0, 0, [])]
        for k in range(1, len(cells) + 1):
            c = cells[k - 1]
            v = plain(c.text)
            options = [(best[k - 1][0] + self.cost(v) + (CONFUSION_COST if v != c.core else 0.0), k - 1, [c])]
            if odd[k - 1] and (made := self.parts(c)):
                options.append((best[k - 1][0] + made[0], k - 1, made[1]))
            for i in range(max(0, k - 3), k - 1):
                if one := self.whole(cells[i:k], any(odd[i:k])):
                    options.append((best[i][0] + one[0], i, [one[1]]))
            best.append(min(options, key=lambda o: o[0]))
        out, k = [], len(cells)
        while k:
            out.append(best[k][2])
            k = best[k][1]
        return [c for part in reversed(out) for c in part]

    def segmented(self, words: list[str]) -> list[str]:
        """The words of a stretch of the stream on its cheapest path."""
        return [c.text for c in self.path([Cell(0, w, plain(w), w, []) for w in words])]


def folded(s: str) -> str:
    """A line with all that scanning confuses made equal, for comparing headers."""
    s = unicodedata.normalize("NFKD", IGNORABLE.sub("", s)).lower()
    s = "".join(c for c in s if c.isalnum())
    for a, b in (("rn", "m"), ("vv", "w"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("1", "l"), ("i", "l"), ("j", "l"), ("0", "o"), ("c", "e"), ("f", "t"), ("h", "b"), ("6", "b"), ("5", "s"), ("9", "g"), ("y", "v"), ("8", "b"), ("in", "m"), ("ln", "m"), ("lb", "b")):
        s = s.replace(a, b)
    return s


def headed(s: str) -> bool:
    """title_like, also where a capital I was read as l."""
    return title_like(s) or (re.search(r"\bl[a-z]", s) is not None and title_like(re.sub(r"\bl(?=[a-z])", "I", s)))


def title_like(s: str) -> bool:
    """Whether every word but the small ones begins with a capital or is a number, and nothing ends the line."""
    if s[-1] in ".,;:?!-¬=" or len(s) > 90:
        return False
    words = s.split()
    if len(words) > 12:
        return False
    tall = 0
    for w in words:
        c = w.lstrip("(“\"'")[:1]
        if c.isupper() or c.isdigit() or (w[1:2].isupper() and len(w) > 1):
            tall += c.isalpha()
        elif w not in SMALL:
            return False
    return tall > 0 or any(w[1:2].isupper() for w in words)


HEAD = re.compile(r"^(?:chapter|part|section|book)\s+[\w]+\s*[:.\-]?\s*|^\s*[\dlIOivxIVX]+[.:]\s*", re.I)


def layout(lines: list[str], titles: list[str]) -> list[str]:
    """What each line is: "", "page_no" or "header", "blank" or "title" (that opens the text).

    A running header stands alone on its line, with or without a page number, is written like a title, and is known
    by the titles of the text, by coming again, by the page number in or beside it, or by a journal's issue."""
    n = len(lines)
    kinds = [""] * n
    bare: dict[int, tuple[str, bool]] = {}
    first = True
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            kinds[k] = "blank"
            continue
        if len(s) < 24 and (m := PAGE_NUMBER.match(s)) and not first:
            d = "".join(DIGITS.get(c, c) for c in m[1])
            low = m[1].lower()
            if d.isdigit() or ROMAN.match(low) or ROMAN.match(low.replace("1", "l")):
                if s[-1] not in ".,;?!" and not (s[:1] in "(\"" and not d.isdigit()):
                    kinds[k] = "page_no"
                    continue
        if len(s) <= 90:
            if m := NUMBERED.match(s):
                core = (m["a"] or m["b"]).strip()
                if headed(core):
                    bare[k] = (core, True)
            elif title_like(s):
                bare[k] = (s, False)
        if first:
            if headed(s) or (len(s) < 60 and JAPANESE.search(s) and "。" not in s):
                kinds[k] = "title"
            first = False
    if not bare:
        return kinds
    known = set()
    for t in titles:
        if t:
            known |= {folded(t), folded(HEAD.sub("", t))}
    opening = [lines[k].strip() for k in range(n) if kinds[k] != "blank"][:2]
    known |= {f for t in opening if len(t) < 90 and title_like(t) for f in (folded(t), folded(HEAD.sub("", t)))}
    known.discard("")
    seen: Counter = Counter()
    keys = {}
    for k, (core, _) in bare.items():
        m = JOURNAL.match(core)
        keys[k] = folded(m[1] if m else core)
        seen[keys[k]] += 1
    for k, (core, numbered) in bare.items():
        if kinds[k] == "title":
            continue
        beside = (k and kinds[k - 1] == "page_no") or (k + 1 < n and kinds[k + 1] == "page_no")
        if k < 3 and not numbered and not beside and all(kinds[i] in ("title", "blank") for i in range(k)):
            continue  # the author's line below the title
        words = core.split()
        if numbered or JOURNAL.match(core) or keys[k] in known or seen[keys[k]] > 1 or (beside and len(words) > 0):
            kinds[k] = "header"
    return kinds


def decoded(lines: list[str], kinds: list[str], language: Language) -> tuple[list[tuple[int, str, str]], list[tuple[int, list[str]]]]:
    """The defects (line_no, defect, word) of the lines, and the repaired words of each line: one decoding of the
    de-lined stream for misread, broken, fallen apart and fallen together words."""
    decode, known = language.decode, language.tokens
    found: list[tuple[int, str, str]] = []
    cells: list[Cell] = []
    held: list[int] = []  # the lines in the stream
    broken = None  # of the line before: its number, the last word without its hyphen, and the half of the word
    for k, line in enumerate(lines):
        kind = kinds[k]
        if kind in ("header", "page_no"):
            found.append((k, kind, ""))
            continue
        words = line.split()
        if not words:
            continue
        start = 0
        if broken:
            k0, half = broken
            rest = plain(words[0])
            if rest and rest[0].isalpha() and cells:
                last = cells.pop()
                word = language.join(half, rest)
                at = max(0, last.raw.rfind(half))
                lead, tail = last.raw[:at], words[0][words[0].rfind(rest) + len(rest) :] if rest in words[0] else ""
                cells.append(Cell(last.line, lead + half + rest + tail, half + rest, lead + word + tail, [(k0, "hyphen", word)], ((k0, len(half)),)))
                start = 1
            broken = None
        end = len(words)
        if end > start and words[-1][-1] in HYPHENS and words[-1][-2:-1].isalnum() and kind != "title":
            half = plain(words[-1])
            if half and half[-1].isalpha():
                broken = (k, half)
                end -= 1
        held.append(k)
        for i in range(start, len(words)):
            w = words[i]
            if i >= end or (kind == "title" and len(lines) > 1):
                cells.append(Cell(k, w, "" if kind == "title" else plain(w), w, []))
                continue
            try:
                v = known[w]
            except KeyError:
                if len(known) > FLUSH:
                    known.clear()
                p = plain(w)
                known[w] = v = (p, p, None) if not p or (d := decode(p)) is None else (p, d, w.replace(p, d) if p in w else d)
            cells.append(Cell(k, w, v[0], w, []) if v[2] is None else Cell(k, w, v[0], v[2], [(k, "misread", v[1])]))
    stream: dict[int, list[str]] = {k: [] for k in held}
    for c in language.path(cells):
        found += c.found
        stream[c.line].append(c.text)
    return found, [(k, ws) for n, (k, ws) in enumerate(stream.items()) if ws or not n]


def repaired(text: str, titles: list[str], language: Language) -> tuple[list[tuple[int, str, str]], list[str]]:
    """The defects (line_no, defect, word) of a text, and its paragraphs."""
    lines = text.split("\n")
    kinds = layout(lines, titles)
    found, stream = decoded(lines, kinds, language)
    return found, paragraphs(lines, kinds, stream)


def paragraphs(lines: list[str], kinds: list[str], stream: list[tuple[int, list[str]]]) -> list[str]:
    """Joins the lines of the stream into paragraphs, with the cheapest set of boundaries.

    A boundary costs by what stands before and after it: a sentence's end, a blank line or an indent make it cheap, a
    word in the midst of a sentence dear; so does a paragraph of one short line. Dynamic programming over the lines."""
    m = len(stream)
    if not m:
        return [""]
    width = max(len(lines[k]) for k, _ in stream)
    gap = [0.0] * m
    for i in range(1, m):
        (k0, a), (k1, b) = stream[i - 1], stream[i]
        before, after = (a[-1] if a else ""), (b[0] if b else "")
        cost = 0.5
        ended = before[-1:] in ".?!。:" or (len(before) > 1 and before[-1] in "\"'”’)」" and before[-2] in ".?!。")
        cost += -1.0 if ended else 3.0
        if any(kinds[k] == "blank" for k in range(k0 + 1, k1)):
            cost -= 1.5 if all(kinds[k] == "blank" for k in range(k0 + 1, k1)) else 0.25
        indent = len(lines[k1]) - len(lines[k1].lstrip())
        cost -= 1.5 if 1 <= indent <= 12 else 0.0
        cost += 1.0 if len(lines[k0].rstrip()) > 0.85 * width else -0.5
        cost += 2.0 if after[:1].islower() else 0.0
        if kinds[k0] == "title":
            cost = -3.0
        gap[i] = cost
    short = [0.3 if len(lines[k]) < 0.3 * width else 0.0 for k, _ in stream]
    best, back = [0.0] + [math.inf] * m, [0] * (m + 1)
    open_cost, open_at = 0.0, 0  # the cheapest paragraph that goes on
    for j in range(1, m + 1):
        here = open_cost + (short[j - 1] if open_at == j - 1 else 0.0)
        best[j], back[j] = here, open_at
        if j < m and here + gap[j] < open_cost:
            open_cost, open_at = here + gap[j], j
    cuts, j = [], m
    while j:
        cuts.append((back[j], j))
        j = back[j]
    japanese = JAPANESE.search(lines[stream[0][0]]) is not None
    return [("" if japanese else " ").join(w for _, ws in stream[a:b] for w in ws) for a, b in cuts[::-1]]


def texts(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """(src, row_id, title, text) of the scanned texts, on demand each chapter once."""
    chapters = table(spark, sf_dir, "chapters").select("chapter_id", "title", "raw_text")
    a = (once(chapters, "chapter_id") if single else chapters).select(F.lit("chapters").alias("src"), F.col("chapter_id").alias("row_id"), "title", F.col("raw_text").alias("text"))
    b = table(spark, sf_dir, "paper_pipeline").select(F.lit("paper_pipeline").alias("src"), F.col("paper_id").alias("row_id"), F.lit(None).cast("string").alias("title"), F.col("raw_text").alias("text"))
    return spread(a.unionByName(b).where("text is not null"))


def vocabulary(df: DataFrame, text: str = "text", size: int = VOCABULARY) -> Words:
    """The commonest words of all texts and their counts, at most `size`: the bounded model that workers get."""
    return common_words(df, [text], count_words, plain, size)


def repair(df: DataFrame, what: str, vocab: dict[str, int] | None = None) -> DataFrame:
    """what: "defects" (src, row_id, line_no, defect, word) or "paragraphs" (src, row_id, para_no, paragraph)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(df) if vocab is None else vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = built(shared, Language)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                src, key, title, text = (c.to_pylist() for c in batch.slice(start, 256).columns)
                rows: list[tuple] = []
                for s, i, h, t in zip(src, key, title, text):
                    if t is None:
                        continue
                    defects, paras = repaired(t, [h] if h else [], language)
                    rows += [(s, i, *d) for d in defects] if what == "defects" else [(s, i, k, p) for k, p in enumerate(paras)]
                columns = list(zip(*rows)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    names = [("line_no", pa.int32()), ("defect", pa.string()), ("word", pa.string())] if what == "defects" else [("para_no", pa.int32()), ("paragraph", pa.string())]
    schema = pa.schema([("src", pa.string()), ("row_id", pa.int64()), *names])
    ddl = "src string, row_id bigint, " + ("line_no int, defect string, word string" if what == "defects" else "para_no int, paragraph string")
    return df.select("src", "row_id", "title", "text").mapInArrow(run, ddl)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies give equal defects, so repeated keys are dropped after the texts are left behind."""
    return repair(texts(spark, sf_dir), "defects").groupBy("src", "row_id", "line_no", "defect", "word").agg(F.count("*").alias("n")).drop("n")


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = texts(spark, sf_dir)
    return repair(texts(spark, sf_dir, True), "paragraphs", vocabulary(every))


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
SQL: dict[str, str] = {}
