"""Vectors in which English and Japanese sentences can be compared.

A sentence's vector has a coordinate for each number and each name in it, names by their romanised katakana, and a part
for its other words: Japanese sentences have the pieces of their words there, English ones the pieces that a lexicon
gives for their words. The lexicon is fitted on all text pairs, at first from sentences that share numbers and names; it
holds what occurs with a word more often than without it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.corpus import FLUSH
from foliospark.session import stage

#: Bounds of the lexicon: English words, pieces of Japanese words, and pieces per word.
WORDS, PIECES, PER_WORD = 4000, 3000, 14
#: Least count of a word or piece, least count of both together, and by how much a piece must be more frequent with a word.
LEAST, LEAST_BOTH, LEAST_GAIN = 3, 2, 0.12
#: Least similarity of sentences that the fit takes for each other's translation: by numbers and names alone, and later.
ALIKE_KEYS, ALIKE = 0.6, 0.3
#: Parts of one in which fractions are summed, so that their order plays no part.
EXACT = 1 << 40
#: Rounds of the fit, and sentences of either side that it compares at once.
ROUNDS, BLOCK = 3, 1000
#: Sentences whose cells are held before they are added, and the cells above the diagonal of small tables.
HELD, TRIANGLES = 1000, [np.triu_indices(k, 1) for k in range(100)]

NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
KANJI_NUMBER = re.compile("[〇一二三四五六七八九十百千]{2,}")
CAPITAL = re.compile(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)*\b")
WORD = re.compile(r"[a-z]+")
KATAKANA = re.compile("[ァ-ヴー]{2,}")
RUN = re.compile("[぀-ヿ㐀-鿿々]+")
# Kanji digits and units, and the sounds of katakana.
DIGIT = {c: i for i, c in enumerate("〇一二三四五六七八九")}
UNIT = {"十": 10, "百": 100, "千": 1000}
SOUNDS = dict(
    zip(
        "ア イ ウ エ オ カ キ ク ケ コ ガ ギ グ ゲ ゴ サ シ ス セ ソ ザ ジ ズ ゼ ゾ タ チ ツ テ ト ダ ヂ ヅ デ ド ナ ニ ヌ ネ ノ ハ ヒ フ ヘ ホ バ ビ ブ ベ ボ パ ピ プ ペ ポ マ ミ ム メ モ ヤ ユ ヨ ラ リ ル レ ロ ワ ヲ ン ヴ".split(),
        "a i u e o ka ki ku ke ko ga gi gu ge go sa si su se so za zi zu ze zo ta ti tu te to da di du de do na ni nu ne no ha hi fu he ho ba bi bu be bo pa pi pu pe po ma mi mu me mo ya yu yo ra ri ru re ro wa wo n vu".split(),
    )
)
SMALL = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "a", "ュ": "u", "ョ": "o"}
SAME_SOUND = (("shi", "si"), ("chi", "ti"), ("tsu", "tu"), ("hu", "fu"), ("ji", "zi"), ("l", "r"), ("ph", "f"))


def sentences_en(text: str) -> list[str]:
    """Sentences in order: headings and blank lines skipped, list marks dropped."""
    out = []
    for line in text.split("\n"):
        if not line.strip() or line.startswith("#"):
            continue
        line = line[2:] if line.startswith("- ") else line
        out += [s for s in re.split(r"(?<=[.?!])\s+", line.strip()) if s]
    return out


def sentences_ja(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        if not line.strip() or line.startswith("#"):
            continue
        line = line[2:] if line.startswith("- ") else line
        out += [s for s in re.findall("[^。]*。|[^。]+$", line.strip()) if s.strip()]
    return out


def romanised(run: str) -> str:
    out: list[str] = []
    for c in run:
        if c in SMALL and out:
            out[-1] = out[-1][:-1] + ("y" if c in "ャュョ" else "") + SMALL[c]
        elif c == "ー" and out:
            continue
        elif c == "ッ":
            continue
        else:
            out.append(SOUNDS.get(c, ""))
    return "".join(out)


def kanji_value(run: str) -> str:
    if not any(c in UNIT for c in run):
        return str(int("".join(str(DIGIT[c]) for c in run)))
    total, digit = 0, 0
    for c in run:
        if c in UNIT:
            total += (digit or 1) * UNIT[c]
            digit = 0
        else:
            digit = digit * 10 + DIGIT[c]
    return str(total + digit)


def number(s: str) -> str:
    s = s.replace(",", "")
    return s.rstrip("0").rstrip(".") if "." in s else s.lstrip("0") or "0"


def keys_en(s: str) -> set[str]:
    out = {number(x) for x in NUMBER.findall(s)}
    for w in CAPITAL.findall(s):
        w = w.lower()
        for a, b in SAME_SOUND:
            w = w.replace(a, b)
        out.add(w)
    return out


def keys_ja(s: str) -> set[str]:
    s = unicodedata.normalize("NFKC", s)
    return {number(x) for x in NUMBER.findall(s)} | {kanji_value(x) for x in KANJI_NUMBER.findall(s)} | {romanised(x) for x in KATAKANA.findall(s)}


def words_en(s: str) -> set[str]:
    return set(WORD.findall(s.lower()))


def pieces_ja(s: str) -> set[str]:
    """Pairs of neighbouring characters of each run of Japanese letters."""
    return {r[i : i + 2] for r in RUN.findall(s) for i in range(len(r) - 1)}


class Lexicon:
    """For each English word the pieces that go with it and how strongly; how much a piece says."""

    def __init__(self, words: dict[str, tuple[np.ndarray, np.ndarray]], pieces: dict[str, int], weights: np.ndarray):
        self.words, self.pieces, self.weights = words, pieces, weights

    def lexical(self, sentences: list[str], japanese: bool) -> np.ndarray:
        return self.of_tokens([(pieces_ja if japanese else words_en)(s) for s in sentences], japanese)

    def of_tokens(self, sentences: list[set[str]], japanese: bool) -> np.ndarray:
        """Rows of length 1. A piece that several words of a sentence ask for counts once."""
        out = np.zeros((len(sentences), len(self.pieces)), np.float32)
        words, pieces = self.words, self.pieces
        for i, tokens in enumerate(sentences):
            row = out[i]
            if japanese:
                at = [j for p in tokens if (j := pieces.get(p)) is not None]
                row[at] = self.weights[at]
            elif found := [t for w in tokens if (t := words.get(w)) is not None]:
                np.maximum.at(row, np.concatenate([t[0] for t in found]), np.concatenate([t[1] for t in found]))
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
        return out / np.maximum(norm, 1e-9)

    def similarity(self, en: list[str], ja: list[str], last: int = 0) -> np.ndarray:
        """Cosines of the sentences' vectors, shared numbers and names and words together; on demand of the last English
        sentences only."""
        (a, na), (b, nb) = keyed(en, ja)
        a, na = a[-last:], na[-last:]
        both = a @ b.T + self.lexical(en[-last:], False) @ self.lexical(ja, True).T
        return both / np.sqrt(np.outer(na + 1, nb + 1))

    def vectors(self, en: list[str], ja: list[str]) -> tuple[np.ndarray, np.ndarray]:
        (a, na), (b, nb) = keyed(en, ja)
        return tuple(np.hstack([k, v]) / np.sqrt(n + 1)[:, None] for k, v, n in ((a, self.lexical(en, False), na), (b, self.lexical(ja, True), nb)))


class Side:
    """The sentences of one side of a document: their keys, and their vectors block by block; without a lexicon the keys
    are all."""

    def __init__(self, words: Lexicon | None, sentences: list[str], japanese: bool):
        self.words, self.japanese = words, japanese
        self.tokens = [pieces_ja(s) if japanese else words_en(s) for s in sentences]
        self.keys = [keys_ja(s) if japanese else keys_en(s) for s in sentences]
        self.lengths = np.zeros(len(sentences))

    def keys_met(self) -> set[str]:
        return set().union(*self.keys)

    def count(self, shared: set[str]) -> None:
        """Keeps the keys that both sides have; numbers that one side lacks lengthen a vector, for they tell two
        sentences apart."""
        for k, ks in enumerate(self.keys):
            own = ks & shared
            self.lengths[k] = len(own) + 0.5 * sum(x[:1].isdigit() for x in ks - own) + 1
            self.keys[k] = own

    def block(self, start: int, end: int) -> tuple[list[set[str]], np.ndarray, np.ndarray]:
        if self.words is None:
            return self.keys[start:end], np.zeros((len(self.keys[start:end]), 0), np.float32), np.maximum(self.lengths[start:end] - 1, 1e-9)
        return self.keys[start:end], self.words.of_tokens(self.tokens[start:end], self.japanese), self.lengths[start:end]


def block_similarity(a: tuple[list[set[str]], np.ndarray, np.ndarray], b: tuple[list[set[str]], np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosines of the sentences of two blocks, shared numbers and names and words together."""
    index = {k: i for i, k in enumerate(sorted(set().union(*a[0]) & set().union(*b[0])))}
    both = []
    for keys, _, _ in (a, b):
        at = [(i, index[k]) for i, ks in enumerate(keys) for k in ks if k in index]
        m = np.zeros((len(keys), len(index)), np.float32)
        if at:
            m[tuple(np.array(at).T)] = 1.0
        both.append(m)
    return (both[0] @ both[1].T + a[1] @ b[1].T) / np.sqrt(np.outer(a[2], b[2]))


def keyed(en: list[str], ja: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of both sides the coordinates of shared numbers and names, and the squared lengths.

    Numbers without a counterpart anywhere lengthen a vector, for they tell two sentences apart."""
    k1, k2 = [keys_en(s) for s in en], [keys_ja(s) for s in ja]
    shared = set().union(*k1) & set().union(*k2)
    index = {k: i for i, k in enumerate(sorted(shared))}
    out = []
    for keys in (k1, k2):
        m, more = np.zeros((len(keys), len(index)), np.float32), np.zeros(len(keys), np.float32)
        for i, ks in enumerate(keys):
            for x in ks:
                if (k := index.get(x)) is not None:
                    m[i, k] = 1.0
                elif x[:1].isdigit():
                    more[i] += 0.5
        out.append((m, m.sum(axis=1) + more))
    return out[0], out[1]


def matches(en: list[str], ja: list[str], words: Lexicon | None) -> list[tuple[set[str], set[str]]]:
    """Words and pieces of the sentences that are each other's most similar ones and similar enough; block by block, for
    any length alike."""
    sides = Side(words, en, False), Side(words, ja, True)
    shared = sides[0].keys_met() & sides[1].keys_met()
    sides[0].count(shared), sides[1].count(shared)
    best = np.full(len(en), -1.0), np.full(len(ja), -1.0)
    at = np.zeros(len(en), np.int64), np.zeros(len(ja), np.int64)
    for i in range(0, len(en), BLOCK):
        own = sides[0].block(i, i + BLOCK)
        for j in range(0, len(ja), BLOCK):
            sim = block_similarity(own, sides[1].block(j, j + BLOCK)).round(4)  # equal ones are so on any machine
            for k, start, other, s in ((0, i, j, sim), (1, j, i, sim.T)):
                top = s.argmax(axis=1)
                most = s[np.arange(len(s)), top]
                more = np.flatnonzero(most > best[k][start : start + len(s)])
                best[k][start + more], at[k][start + more] = most[more], other + top[more]
    least = ALIKE_KEYS if words is None else ALIKE
    if not en or not ja:
        return []
    return [(sides[0].tokens[i], sides[1].tokens[j]) for i, j in enumerate(at[0].tolist()) if at[1][j] == i and best[0][i] > least]


class Counts:
    """How many matched sentences have each word of a vocabulary, each piece, both, and each two pieces, the first before
    the second."""

    def __init__(self, words: dict[str, int], pieces: dict[str, int]):
        self.words, self.pieces, self.n = words, pieces, 0
        self.w, self.p = np.zeros(len(words), np.int64), np.zeros(len(pieces), np.int64)
        self.co, self.both = np.zeros((len(words), len(pieces)), np.int32), np.zeros((len(pieces), len(pieces)), np.int32)
        self.cells: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, en: list[str], ja: list[str], lexicon: Lexicon | None) -> None:
        """Counts the matched sentences of a document."""
        for a, b in matches(en, ja, lexicon):
            i = np.array([k for x in a if (k := self.words.get(x)) is not None], np.int64)
            j = np.array(sorted([k for x in b if (k := self.pieces.get(x)) is not None]), np.int64)
            self.n += 1
            self.w[i] += 1
            self.p[j] += 1
            low, high = np.triu_indices(len(j), 1) if len(j) >= len(TRIANGLES) else TRIANGLES[len(j)]
            self.cells.append(((i[:, None] * len(self.pieces) + j).ravel(), j[low] * len(self.pieces) + j[high]))
        if len(self.cells) > HELD:
            self.sum()

    def sum(self) -> None:
        """Adds the cells that are held, in their order, which is faster than here and there."""
        for counts, cells in zip((self.co, self.both), zip(*self.cells)):
            at, n = np.unique(np.concatenate(cells), return_counts=True)
            counts.reshape(-1)[at] += n.astype(np.int32)
        self.cells.clear()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(kind, i, cells) of the rows of all tables: columns that are not zero, and their counts."""
        self.sum()
        for kind, counts in (("n", np.array([[self.n]])), ("w", self.w[None, :]), ("p", self.p[None, :]), ("co", self.co), ("both", self.both)):
            for start in range(0, len(counts), 100):
                cells = [packed(row) for row in counts[start : start + 100]]
                some = [k for k, c in enumerate(cells) if c is not None]
                columns = [pa.array([kind] * len(some), pa.string()), pa.array([start + k for k in some], pa.int32()), pa.array([cells[k] for k in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "i", "cells"])


def packed(row: np.ndarray) -> bytes | None:
    """The steps from one column that isn't zero to the next, and the counts; bytes of a rank stand together, as most are
    zero."""
    j = np.flatnonzero(row)
    return zlib.compress(np.array([np.diff(j, prepend=0), row[j]], "<i4").reshape(-1, 1).view(np.uint8).T.tobytes(), 1) if len(j) else None


def unpacked(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.frombuffer(zlib.decompress(cells), np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(2, -1)
    return np.cumsum(steps), n


def gains(co: np.ndarray, w: int, p: np.ndarray, n: int) -> list[tuple[int, float]]:
    """The best pieces of a word and by how much they are more frequent with it, of its row of counts."""
    gain = co / max(w, 1) - (p - co) / max(n - w, 1)
    gain[(co < LEAST_BOTH) | (gain < LEAST_GAIN) | (p < LEAST) | (w < LEAST)] = 0
    top = np.argsort(-gain, kind="stable")[:PER_WORD]
    return [(j, g) for j, g in zip(top.tolist(), gain[top].tolist()) if g > 0]


def alike(both: np.ndarray, i: int, p: np.ndarray) -> np.ndarray:
    """How much each piece says what the piece says whose row of counts this is, and that piece what all others say; in
    whole parts, so that their sum has no order."""
    part = np.rint(np.where((p >= LEAST) & (p[i] >= LEAST), both / np.maximum(p, 1) * (both / max(p[i], 1)), 0) * EXACT).astype(np.int64)
    part[i] += part.sum()
    return part


def numbered(names: list[str]) -> dict[str, int]:
    return {x: k for k, x in enumerate(names)}


def fit(pairs: list[tuple[str, str]], rounds: int = ROUNDS) -> Lexicon:
    """The lexicon of a list of (English, Japanese) texts."""
    docs = [(sentences_en(a), sentences_ja(b)) for a, b in pairs]
    met = Counter(w for a, _ in docs for s in a for w in words_en(s)), Counter(p for _, b in docs for s in b for p in pieces_ja(s))
    words, pieces = (numbered([x for x, n in sorted(c.items(), key=lambda xn: (-xn[1], xn[0]))[:most] if n >= LEAST]) for c, most in zip(met, (WORDS, PIECES)))
    lexicon = None
    for _ in range(rounds):
        counts = Counts(words, pieces)
        for a, b in docs:
            counts.add(a, b, lexicon)
        lexicon = associate(counts)
    return lexicon


def associate(counts: Counts) -> Lexicon:
    """Keeps what occurs far more often together than apart."""
    counts.sum()
    best = {i: gains(row, int(counts.w[i]), counts.p, counts.n) for i, row in enumerate(counts.co)}
    return made(counts.words, counts.pieces, counts.n, counts.p, sum((alike(row, i, counts.p) for i, row in enumerate(counts.both)), np.zeros(len(counts.p), np.int64)), best)


def made(words: dict[str, int], pieces: dict[str, int], n: int, count: np.ndarray, shared: np.ndarray, best: dict[int, list[tuple[int, float]]]) -> Lexicon:
    """The lexicon of the best pieces of each word and their gains, of the counts of pieces, and of what others say with
    them: pieces that always come together, those of a phrase, say together what one of them says."""
    weights = np.where(count >= LEAST, np.log(1 + n / (1 + count)) / np.sqrt(1 + shared / EXACT), 0).astype(np.float32)
    table = {w: (np.array([j for j, _ in best[i]]), np.array([g * weights[j] for j, g in best[i]], np.float32)) for w, i in words.items() if best.get(i)}
    return Lexicon(table, pieces, weights)


def fit_all(df: DataFrame, source: str, target: str, rounds: int = ROUNDS) -> Lexicon:
    """The lexicon of all pairs of texts of df, the same as `fit` of them in one list. Each round reads df once: each task
    counts in its rows, its tables are written and summed by row, and only what the lexicon holds comes to the driver."""
    spark = df.sparkSession
    words, pieces = vocabulary(df, source, target)
    lexicon = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((words, pieces, lexicon))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, pieces, lexicon = shared.value  # noqa: B023
            counts = Counts(words, pieces)
            for batch in batches:
                for a, b in zip(batch.column(0), batch.column(1)):
                    if (a := a.as_py()) and (b := b.as_py()):
                        counts.add(sentences_en(a), sentences_ja(b), lexicon)
            yield from counts.rows()

        lexicon = associate_all(stage(df.select(source, target).mapInArrow(run, "kind string, i int, cells binary"), "pairs"), words, pieces)
        shared.destroy()
    return lexicon


def vocabulary(df: DataFrame, source: str, target: str) -> tuple[dict[str, int], dict[str, int]]:
    """The commonest words and pieces of all sentences, numbered; ties by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counts in zip("wp", met):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(counts), pa.string()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["kind", "x", "n"])
                counts.clear()

        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                for s in sentences_en(a.as_py() or ""):
                    met[0].update(words_en(s))
                for s in sentences_ja(b.as_py() or ""):
                    met[1].update(pieces_ja(s))
                if max(map(len, met)) > FLUSH:
                    yield from flush()
        yield from flush()

    met = df.select(source, target).mapInArrow(run, "kind string, x string, n bigint").groupBy("kind", "x").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    met = stage(met, "vocabulary")
    words, pieces = (met.where(F.col("kind") == k).orderBy(F.desc("n"), "x").limit(most).toArrow().column("x").to_pylist() for k, most in (("w", WORDS), ("p", PIECES)))
    return numbered(words), numbered(pieces)


def associate_all(counts: DataFrame, words: dict[str, int], pieces: dict[str, int]) -> Lexicon:
    """What `associate` makes of the sums of all tasks' tables."""
    total = {"n": np.zeros(1, np.int64), "w": np.zeros(len(words), np.int64), "p": np.zeros(len(pieces), np.int64)}
    for kind, _, cells in counts.where("kind in ('n', 'w', 'p')").toLocalIterator():
        j, n = unpacked(cells)
        total[kind][j] += n
    n, w, p = int(total["n"][0]), total["w"], total["p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, int, float]] = []
        shared, row, at = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), None

        def done() -> None:
            nonlocal shared
            if at is not None and at[0] == "co":
                best.extend((at[1], j, g) for j, g in gains(row, int(w[at[1]]), p, n))
            elif at is not None:
                shared += alike(row, at[1], p)
            row[:] = 0

        for batch in batches:
            for kind, i, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (kind, i):
                    done()
                    at = kind, i
                j, x = unpacked(cells)
                row[j] += x
        done()
        some = np.flatnonzero(shared).tolist()
        columns = [[b[0] for b in best] + some, [b[1] for b in best] + [None] * len(some), [b[2] for b in best] + [None] * len(some), [None] * len(best) + shared[some].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["i", "j", "gain", "shared"])

    best: dict[int, list[tuple[int, float]]] = {}
    shared = np.zeros(len(pieces), np.int64)
    by_row = counts.where("kind in ('co', 'both')").repartition("kind", "i").sortWithinPartitions("kind", "i")
    for i, j, gain, x in by_row.mapInArrow(run, "i int, j int, gain double, shared bigint").collect():
        if j is None:
            shared[i] += x
        else:
            best.setdefault(i, []).append((j, gain))
    return made(words, pieces, n, p, shared, best)
