"""Evaluation texts that leak into a corpus of scanned pages, whole or in part.

Test items and pages are folded alike: letters and digits of any script, without case, width and marks, and what scanning
confuses made equal. All short pieces of all items go into one Aho-Corasick automaton; each page is scanned once. A hit
says which items may start where; from there each is followed through the page, over misread letters, broken words, and
lines of adverts or other columns in between, or on to the head of another column, and the words that it holds in a row
are counted, with offsets in the page. What items share is reported for each of them.

Null and empty texts and items hold nothing. A page that holds an item twice is one row. Repeated rows repeat as they come.
An item's first sentence (its instruction) and its last (its question) don't count where a share of all items that differ
beside it have it. In scripts that are written without blanks two characters are a word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.llm import corpus
from foliospark.session import spread, table

#: Words in a row that make a leak. A first or last sentence is common if this share of all items, and so many at least,
#: have it beside different sentences.
WORDS, COMMON, SHARE = 12, 3, 0.02
#: Characters of a seed, and from one seed to the next.
SEED, STEP = 12, 2
#: Lines after a line in which the text may go on, and characters that must agree there; those at the head of a column
#: anywhere else in the page.
NEXT_LINES, AGREE, AGREE_FAR = 15, 6, 8
#: Characters of items in one automaton: bounds what is broadcast. Longer test sets go in blocks, one scan each, with the
#: same rows, for items don't depend on each other.
BLOCK = 20_000_000

# Single characters that scanning confuses, made equal.
CONFUSED, EQUAL = "cfhy1ij05698", "etbvlllosbgb"
SAME = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + CONFUSED.encode(), b"abcdefghijklmnopqrstuvwxyz" + EQUAL.encode())
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LEFT_OUT = bytes(i for i in range(128) if not chr(i).isalnum() and i != 10)
SAME_TEXT, NO_LETTER = str.maketrans(CONFUSED, EQUAL), re.compile(r"[^\w\n]+|_+")
# Groups that scanning confuses, in folded form (n ri, d cl, u ii, m rn, in m, li h, w vv).
GROUPS = (("n", "rl"), ("d", "el"), ("u", "ll"), ("m", "rn"), ("ln", "m"), ("ll", "b"), ("w", "vv"), ("rn", "m"), ("nl", "m"))

# What ends in a full stop before a name, and letters of scripts without blanks between words.
ABBREVIATED = re.compile(r"(?:^|\W)(?:Mr|Mrs|Ms|Messrs|Mme|Dr|Prof|Rev|Hon|St|Capt|Col|Gen|Lt|Sgt|No|[A-HJ-Z])\.$")
UNSPACED = "\u3005\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
UNIT = re.compile(f"[{UNSPACED}]{{1,2}}|[^\\s{UNSPACED}]+")
STOP = re.compile(r"(?<=[.?!])\s+|(?<=[。！？])\s*")


def folded(text: str) -> str:
    """Letters and digits in their folded form, and line ends."""
    if text.isascii():
        return text.encode().translate(LOWER).translate(SAME, LEFT_OUT).decode()
    return NO_LETTER.sub("", unicodedata.normalize("NFKD", text).casefold()).translate(SAME_TEXT)


def sentences(text: str) -> list[str]:
    """Cut after full stops, but not after those of titles before names and of initials."""
    out: list[str] = []
    for s in STOP.split(text.strip()):
        if out and ABBREVIATED.search(out[-1]):
            out[-1] += " " + s
        elif s:
            out.append(s)
    return out


class Item:
    """The words of an item that count, in one row, folded, with their starts and ends."""

    def __init__(self, key: int, words: list[str]):
        self.key, self.starts, self.ends = key, [], []
        text = ""
        for w in words:
            if f := folded(w):
                self.starts.append(len(text))
                text += f
                self.ends.append(len(text))
        self.text, self.back = text, text[::-1]


def edges(text: str | None) -> list[tuple[str, str]]:
    """The first and the last sentence, each folded, with what stands beside it; of single sentences none."""
    x = sentences(text or "")
    return [("f" + folded(x[0]), folded(x[1])), ("l" + folded(x[-1]), folded(x[-2]))] if len(x) > 1 else []


def common_edges(rows: list[tuple[int, str | None]]) -> frozenset[str]:
    """What common_of gives, for a list."""
    beside: dict[str, set[str]] = {}
    for _, text in rows:
        for edge, other in edges(text):
            beside.setdefault(edge, set()).add(other)
    least = max(COMMON, math.ceil(SHARE * len(rows)))
    return frozenset(e for e, others in beside.items() if len(others) >= least)


def common_of(tests: DataFrame, text: str) -> frozenset[str]:
    """The first and last sentences that a share of all items have, beside different ones; at most 2 / SHARE, or the
    few of a small test set. Counted over all items, in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for t in batch.column(0).to_pylist() for e in edges(t)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.string()) for k in (0, 1)], names=["edge", "beside"])

    least = max(COMMON, math.ceil(SHARE * tests.count()))
    found = tests.select(text).mapInArrow(run, "edge string, beside string").groupBy("edge").agg(F.count_distinct("beside").alias("n"))
    return frozenset(r.edge for r in found.where(F.col("n") >= least).select("edge").collect())


def items_of(rows: list[tuple[int, str | None]], least: int = WORDS, common: frozenset[str] | None = None) -> list[Item]:
    """Items without the common instruction that opens them and the common question that ends them, and without items
    too short to leak. What stands between is in one row, whatever items share in it."""
    common = common_edges(rows) if common is None else common
    out = []
    for key, text in rows:
        x = sentences(text or "")
        if len(x) > 1 and len(UNIT.findall(x[0])) >= 4 and "f" + folded(x[0]) in common:
            x = x[1:]
        if x and len(UNIT.findall(x[-1])) >= 4 and "l" + folded(x[-1]) in common:
            x = x[:-1]
        item = Item(key, UNIT.findall(" ".join(x)))
        if len(item.ends) >= least:
            out.append(item)
    return out


#: Characters to either side of a seed that are compared at once for all its places; characters of pages in one go.
REACH, AT_ONCE = 24, 200_000
#: Between texts that are put in one row; more than any place looks ahead.
PAD = REACH + 16
#: How a text may go on after a character that differs: replaced, put in, left out; one for two, two for one.
SLIPS, TWOS = ((1, 1), (0, 1), (1, 0)), ((1, 2), (2, 1))


class Seeds:
    """One automaton of all seeds of all items, and the places that have them, in one row of all items' texts."""

    def __init__(self, items: list[Item]):
        self.found = ahocorasick.Automaton()
        where: dict[str, list[int]] = {}
        self.offsets, at = [], PAD
        for item in items:
            self.offsets.append(at)
            for p in range(0, max(1, len(item.text) - SEED + 1), STEP):
                where.setdefault(item.text[p : p + SEED], []).append(at + p)
            at += len(item.text) + PAD
        self.text = np.zeros(at, np.uint16)
        self.owner = np.zeros(at, np.int32)
        ended, begun = np.zeros(at + 1, np.int32), np.zeros(at + 1, np.int32)
        for i, (o, item) in enumerate(zip(self.offsets, items)):
            self.text[o : o + len(item.text)] = codes(item.text)
            self.owner[o : o + len(item.text)] = i
            ended[np.array(item.ends, np.int64) + o] = 1
            begun[np.array(item.starts, np.int64) + o + 1] = 1
        self.back = self.text[::-1].copy()
        self.ended, self.begun = np.cumsum(ended), np.cumsum(begun)  # words that end up to a place, and that begin before it
        places: list[int] = []
        self.first = [0]
        for seed, ps in where.items():
            if len(seed) == SEED:
                self.found.add_word(seed, len(self.first) - 1)
                places += ps
                self.first.append(len(places))
        self.places, self.first = np.array(places, np.int64), np.array(self.first, np.int64)
        self.found.make_automaton()

    def __len__(self) -> int:
        return len(self.found)

    def hits(self, pages: list[list[str]]) -> list[list[tuple[int, int, int, int, int]]]:
        """Of each page (place, item, place in it, where the item ends to agree, where it begins to) of the seeds on it
        that may be in a leak; -1 for an end that isn't known yet.

        All places of all seeds are compared at once with the pages, up to the first character that differs on either
        side. A place stays out only where the text can go on there on neither side, by no slip, confusion or other
        line, and has too few words by then: where following it would end at once as well."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in pages]
        met, starts, at = [], [], PAD
        for k, lines in enumerate(pages):
            whole = "".join(lines)
            starts.append(at)
            met += [(end + at, seed, k) for end, seed in self.found.iter(whole)] if len(self) else []
            at += len(whole) + PAD
        if not met:
            return out
        ends, ids, of_page = np.array(met).T
        n = self.first[ids + 1] - self.first[ids]
        of = np.repeat(np.arange(len(ids)), n)
        place = self.places[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[ids][of]]
        begin, of_page = ends[of] - SEED + 1, of_page[of]
        # seeds that follow each other at one distance are one stretch: the first stands for it
        order = np.lexsort((begin, begin - place))
        same = (np.diff(begin[order] - place[order]) == 0) & (np.diff(begin[order]) <= STEP)
        kept = np.sort(order[np.concatenate(([True], ~same))])
        begin, place, of_page = begin[kept], place[kept], of_page[kept]
        layout = Layout(pages, starts, at)
        right, alive = may_go_on(self.text, layout, begin, place, FIRST_FORWARD)
        n, m = len(self.text) - 1, len(layout.text) - 1
        left, more = may_go_on(self.back, layout.reverse(), m - (begin + SEED - 1), n - (place + SEED - 1), FIRST_BACKWARD)
        enough = self.ended[place + right] - self.begun[place + SEED - left] >= WORDS
        stops = np.where(alive | enough, -1, place + right), np.where(more | enough, -1, place + SEED - left)
        kept = alive | more | enough
        for b, p, q, low, k in zip(*(x[kept].tolist() for x in (begin, place, *stops, of_page))):
            i = int(self.owner[p])
            o = self.offsets[i]
            out[k].append((b - starts[k], i, p - o, q - o if q >= 0 else -1, low - o if low >= 0 else -1))
        return out


class Layout:
    """Pages in one row of characters, with the starts and lengths of their lines. Between pages stand empty lines, more
    than any place looks ahead."""

    def __init__(self, pages: list[list[str]], starts: list[int], size: int):
        self.text = np.ones(size, np.uint16)
        first, length, page = [], [], []
        for k, (lines, at) in enumerate(zip(pages, starts)):
            whole = "".join(lines)
            self.text[at : at + len(whole)] = codes(whole)
            blank = [0] * (NEXT_LINES + 1)
            lengths = [*blank, *map(len, lines), *blank]
            first += [at, *(np.cumsum(lengths[:-1]) + at).tolist()]
            length += lengths
            page += [k] * len(lengths)
        self.first, self.length, self.page = np.array(first), np.array(length), np.array(page)

    def reverse(self) -> Layout:
        out = object.__new__(Layout)
        out.text, out.length, out.page = self.text[::-1], self.length[::-1], self.page[::-1]
        out.first = (len(self.text) - (self.first + self.length))[::-1]
        return out

    def row(self, at: np.ndarray) -> np.ndarray:
        """The line of each place: the last that begins there or before; of places at a page's end an empty one."""
        return np.searchsorted(self.first, at, "right") - 1


def gram(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A number for the n characters from each place on."""
    out = np.zeros(at.shape, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B1) + text[np.minimum(at + k, len(text) - 1)]
    return out


def may_go_on(text: np.ndarray, layout: Layout, begin: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of the items' row from `place` agree with the pages from `begin`, and whether `onward` might
    go on after them; true rather too often than too seldom."""
    page, out, on = layout.text, np.full(len(begin), REACH + SEED), np.ones(len(begin), bool)
    at = np.arange(len(begin))
    for low, high in ((SEED, SEED + 4), (SEED + 4, SEED + REACH)):  # most differ soon
        if len(at):
            k = np.arange(low, high)
            same = page[begin[at][:, None] + k] == text[place[at][:, None] + k]
            ended = ~same.all(axis=1)
            out[at[ended]] = low + np.argmin(same[ended], axis=1)
            on[at[ended]] = False
            at = at[~ended]
    at = np.flatnonzero(~on)  # those that differ somewhere
    x, y = place[at] + out[at], begin[at] + out[at]
    go = text[x] != 0  # else the item ends there
    at, x, y = at[go], x[go], y[go]
    go = np.zeros(len(at), bool)
    for a, b in (*SLIPS, *TWOS):
        go |= gram(text, x + a, 3) == gram(page, y + b, 3)
    row = layout.row(y)
    confused = first[text[x] & 127, page[y] & 127]
    rest = layout.first[row] + layout.length[row] - y
    go |= confused & ((rest < 6) | (text[x + 6] == 0) | (text[x + 3] == 0))
    # where a line ended not long before, another line may begin with what follows in the item
    cut = layout.first[row]
    crossed = ~go & (cut > begin[at])
    before = layout.row(np.maximum(cut - 1, 0))
    go |= crossed & ((layout.first[before] > begin[at]) | (text[x - (y - cut) + 8] == 0))  # short lines between, or the item's end: look
    near = np.flatnonzero(crossed & ~go & (y - cut < 8))
    if len(near):
        c, r0 = x[near] - (y[near] - cut[near]), before[near]
        heads = gram(page, layout.first, AGREE_FAR) + layout.page.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        heads = heads[layout.length >= AGREE_FAR]
        found = np.isin(gram(text, c, AGREE_FAR) + layout.page[r0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), heads)
        rows = np.minimum(r0[:, None] + np.arange(1, NEXT_LINES + 1), len(layout.first) - 1)
        length = layout.length[rows]
        g3, g5 = ([gram(page, layout.first + o, n) for o in range(5)] for n in (3, 5))
        own = [gram(text, c + o, n) for n in (3, 5) for o in range(5)]
        same = (length > 0) & (g3[0][rows] == own[0][:, None])
        hit = same & ((length < AGREE) | (gram(page, layout.first, AGREE)[rows] == gram(text, c, AGREE)[:, None]))
        for j in range(3):
            for a, b in SLIPS:
                hit |= (g5[j + b][rows] == own[5 + j + a][:, None]) & (length >= j + b + 5)
                hit |= (length < j + b + 5) & (length >= j + b + 3) & (g3[j + b][rows] == own[j + a][:, None])
            two = first[(text[c + j] & 127)[:, None], (page[np.minimum(layout.first + j, len(page) - 1)] & 127)[rows]]
            for a, b in TWOS:
                hit |= two & (length > j) & ((g3[j + b][rows] == own[j + a][:, None]) | (length < j + b + 3))
        at_c, at_row = np.nonzero(same & ~hit)  # the first three agree: a slip or a confusion in the next ones?
        if len(at_c):
            x, r = c[at_c], rows[at_c, at_row]
            begin_of, size = layout.first[r], layout.length[r]
            later = np.zeros(len(x), bool)
            for j in range(3, AGREE):
                for a, b in SLIPS:
                    later |= (gram(text, x + j + a, 5) == gram(page, begin_of + j + b, 5)) | (size < j + b + 5) & (gram(text, x + j + a, 3) == gram(page, begin_of + j + b, 3))
                two = first[text[x + j] & 127, page[np.minimum(begin_of + j, len(page) - 1)] & 127]
                for a, b in TWOS:
                    later |= two & ((gram(text, x + j + a, 3) == gram(page, begin_of + j + b, 3)) | (size < j + b + 3))
            hit[at_c[later], at_row[later]] = True
        go[near] = found | hit.any(axis=1)
    on[at] = go
    return out, on


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint16)


def automaton(items: list[Item]) -> Seeds:
    return Seeds(items)


def by_first(groups) -> dict[str, tuple[tuple[str, str], ...]]:
    return {c: tuple(g for g in groups if g[0][0] == c) for c in {g[0][0] for g in groups}}


FORWARD = by_first(GROUPS)
BACKWARD = by_first([(a[::-1], b[::-1]) for a, b in GROUPS])
STRIDE = 8


def firsts(groups: dict) -> np.ndarray:
    """Whether a confused group may begin with a character where another one stands."""
    out = np.zeros((128, 128), bool)
    for c, pairs in groups.items():
        for _, b in pairs:
            out[ord(c), ord(b[0])] = True
    return out


FIRST_FORWARD, FIRST_BACKWARD = firsts(FORWARD), firsts(BACKWARD)


def follow(c: str, p: int, line: str, k: int, groups: dict) -> tuple[int, int]:
    """How far c from p and line from k go together: over equal characters, confused groups and single slips."""
    slips, nc, nl = 0, len(c), len(line)
    while p < nc and k < nl:
        if c[p] == line[k]:
            while p + STRIDE <= nc and k + STRIDE <= nl and c[p : p + STRIDE] == line[k : k + STRIDE]:
                p += STRIDE
                k += STRIDE
            while p < nc and k < nl and c[p] == line[k]:
                p += 1
                k += 1
            continue
        for a, b in groups.get(c[p], ()):
            if line.startswith(b, k) and c.startswith(a, p):
                x, y = p + len(a), k + len(b)
                n = min(3, nc - x, nl - y)
                if c[x : x + n] == line[y : y + n]:
                    p, k = x, y
                    break
        else:
            if slips == 2 or c[p].isdigit() or line[k].isdigit():
                break
            for da, db in ((1, 1), (0, 1), (1, 0)):
                x, y = p + da, k + db
                n = min(5, nc - x, nl - y)
                if n >= 3 and c[x : x + n] == line[y : y + n]:
                    p, k, slips = x, y, slips + 1
                    break
            else:
                break
    return p, k


class Page:
    """The lines of a page, folded, and where in it lines begin so."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.heads: tuple[dict[str, list[int]], ...] | None = None

    def indexed(self) -> tuple[dict[str, list[int]], ...]:
        """Lines by their first character, their first two, their first five, those after the first, and a far head."""
        out: tuple[dict[str, list[int]], ...] = ({}, {}, {}, {}, {})
        one, two, five, later, far = out
        for n, line in enumerate(self.lines):
            if line:
                one.setdefault(line[0], []).append(n)
                two.setdefault(line[:2], []).append(n)
                five.setdefault(line[:5], []).append(n)
                later.setdefault(line[1:6], []).append(n)
                far.setdefault(line[:AGREE_FAR], []).append(n)
        return out

    def next_lines(self, c: str, p: int, at: int, step: int, groups: dict) -> list[int]:
        """The NEXT_LINES lines after `at` that may begin with what follows in c, the nearest first: by an equal
        character, a confused group, or a slip in the first."""
        if self.heads is None:
            self.heads = self.indexed()
        one, two, five, later, _ = self.heads
        first, rest, low, high = c[p], c[p + 1 : p + 6], at + min(step, step * NEXT_LINES), at + max(step, step * NEXT_LINES)
        found = one.get(first, ())
        found = found[bisect_left(found, low) : bisect_right(found, high)] if found else []
        for rows in (later.get(rest, ()), later.get(c[p : p + 5], ()), five.get(rest, ()), *((one if len(b) == 1 else two).get(b, ()) for _, b in groups.get(first, ()))):
            for r in rows:
                if low <= r <= high and r not in found:
                    found.append(r)
        return sorted(found, reverse=step < 0) if len(found) > 1 else found

    def far(self, c: str, p: int) -> tuple[int, ...] | list[int]:
        """The lines anywhere that begin with what follows in c."""
        return self.heads[4].get(c[p : p + AGREE_FAR], ()) if p + AGREE_FAR <= len(c) else ()

    def onward(self, c: str, p: int, at: int, k: int, step: int, groups: dict) -> tuple[int, int, int, int, int]:
        """Follows c from p through the lines, from character k of line `at`: where it stops in c, line and character
        there, and the first and last line it came through."""
        lines, low, high = self.lines, at, at
        while True:
            p, k = follow(c, p, lines[at], k, groups)
            if p >= len(c) or k < len(lines[at]):
                return p, at, k, low, high
            found = None
            for nxt in self.next_lines(c, p, at, step, groups):
                line = lines[nxt]
                need = min(AGREE, len(c) - p, len(line))
                x, y = follow(c, p, line, 0, groups)
                if x - p >= need and (need >= 3 or len(c) - p < 3):
                    found = x, nxt, y
                    break
            if found is None:  # the head of another column, above or far below
                far = [(follow(c, p, lines[r], 0, groups), r) for r in self.far(c, p) if r != at]
                if not far:
                    return p, at, k, low, high
                (x, y), nxt = max(far, key=lambda f: (f[0][0], -abs(f[1] - at)))
                found = x, nxt, y
            p, at, k = found
            low, high = min(low, at), max(high, at)


def leaks(text: str, items: list[Item], seeds: Seeds, least: int = WORDS) -> list[tuple[int, int, int, int]]:
    """(item, words in a row, first and last place in the text) of each item that leaks into the text."""
    return all_leaks([text], items, seeds, least)[0]


def all_leaks(texts: list[str], items: list[Item], seeds: Seeds, least: int = WORDS) -> list[list[tuple[int, int, int, int]]]:
    """leaks of each of the texts, in bundles of bounded size."""
    out: list[list[tuple[int, int, int, int]]] = []
    bundle: list[list[str]] = []
    size = 0
    for text in texts:
        bundle.append(folded(text).split("\n"))
        size += len(text)
        if size > AT_ONCE or len(out) + len(bundle) == len(texts):
            base = len(out)
            out += [followed(texts[base + k], bundle[k], h, items, least) if h else [] for k, h in enumerate(seeds.hits(bundle))]
            bundle, size = [], 0
    return out


def followed(text: str, lines: list[str], hits: list[tuple[int, int, int, int, int]], items: list[Item], least: int) -> list[tuple[int, int, int, int]]:
    """The leaks among the hits, each followed through the page."""
    first = [0]
    for x in lines:
        first.append(first[-1] + len(x))
    page, back = Page(lines), Page([x[::-1] for x in lines])
    best: dict[int, tuple[int, tuple, tuple]] = {}
    done: dict[int, list[tuple[int, int, int, int]]] = {}
    reached: dict[tuple[int, int], int] = {}  # how far an item was followed, by where it would begin on the page
    for begin, i, p, q, low in hits:
        if reached.get((i, begin - p), -1) > p:
            continue
        row = bisect_right(first, begin) - 1
        if i in done and any(a <= p < b and r0 <= row <= r1 for a, b, r0, r1 in done[i]):
            continue
        k, item = begin - first[row], items[i]
        n, low0, high0, low1, high1 = len(item.text), row, row, row, row
        if q < 0:
            inside = min(SEED, len(lines[row]) - k)
            q, row1, k1, low1, high1 = page.onward(item.text, p + inside, row, k + inside, 1, FORWARD)
        else:
            row1 = -1
        if low < 0 or bisect_right(item.ends, q) - bisect_left(item.starts, low) >= least:
            rp, row0, k0, low0, high0 = back.onward(item.back, n - p, row, len(lines[row]) - k, -1, BACKWARD)
            low = n - rp
        reached[i, begin - p] = q
        done.setdefault(i, []).append((low, q, min(low0, low1), max(high0, high1)))
        words = bisect_right(item.ends, q) - bisect_left(item.starts, low)
        if words >= least and words > best.get(i, (0,))[0]:
            if row1 < 0:
                inside = min(SEED, len(lines[row]) - k)
                q, row1, k1, low1, high1 = page.onward(item.text, p + inside, row, k + inside, 1, FORWARD)
            best[i] = (words, (row0, len(lines[row0]) - k0), (row1, k1))
    out, raw = [], text.split("\n")
    for i, (n, a, b) in best.items():
        if n >= least:
            a, b = original(raw, *a), original(raw, *b)
            out.append((items[i].key, n, min(a, b), max(a, b)))
    return sorted(out)


def original(raw: list[str], row: int, k: int) -> int:
    """The offset in the text of folded character k of a line."""
    at = sum(len(x) + 1 for x in raw[:row])
    for i, c in enumerate(raw[row]):
        n = len(folded(c))
        if n > k:
            return at + i
        k -= n
    return at + len(raw[row])


def searched(value: tuple[list, frozenset[str]]) -> tuple[list[Item], Seeds]:
    """The items and the automaton of a broadcast block."""
    items = items_of(value[0], WORDS, value[1])
    return items, automaton(items)


def leaked(pages: DataFrame, key: str, text: str, tests: DataFrame, item: str, item_text: str) -> DataFrame:
    """(key, item, words, from, to) of each page and each item it holds, with the first and last place of it.

    Narrow over the pages; the items are broadcast, in blocks of bounded size that come to the driver one at a time, and
    each worker builds its automaton once."""
    spark = pages.sparkSession
    size = tests.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))
    common = common_of(tests, item_text)
    kind, kind2 = (df.schema[c].dataType.simpleString() for df, c in ((pages, key), (tests, item)))
    ids = tests.schema[item].dataType
    out = None
    for block in range(blocks):
        mine = tests.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == block) if blocks > 1 else tests
        shared = spark.sparkContext.broadcast(([(r[0], r[1]) for r in mine.select(item, item_text).collect()], common))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, seeds = corpus.built(shared, searched)
            for batch in batches:
                keys = batch.column(0)
                found = [(n, *x) for n, leaks_ in enumerate(all_leaks([t or "" for t in batch.column(1).to_pylist()], items, seeds)) for x in leaks_]
                at, ids, words, a, b = zip(*found) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(ids, id_type), pa.array(words, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=[key, item, "words", "from", "to"])

        id_type = to_arrow_type(ids)
        part = pages.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{item}` {kind2}, words int, `from` int, `to` int")
        out = part if out is None else out.unionByName(part)
    return out


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_passages(spark, sf_dir).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


QUERIES = {"p8_found": p8_found, "p8_passages": p8_passages}
SQL: dict[str, str] = {}
