"""Visually identical text with different characters, brought to one consistent form.

The words of all texts that are in that form make a vocabulary trie. A word with any other character walks the trie, as it
is written, by a weighted edit automaton: look-alike letters, full-width letters, ligatures, separate marks and characters
without ink cost nothing, letters of other scripts that no table knows cost half an edit, and what looks different costs a
whole one. The budget grows with the word's length, and a spelling that looks different is taken for common words only. It
gets the cheapest, then the commonest spelling; what none is met for is rewritten by table, and so are spaces, digits and kana.

Null and empty values stay as they are. Japanese punctuation, whole Greek and Cyrillic words and line-end marks stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.corpus import built, common_words
from foliospark.session import once, table

#: Words in the trie, the commonest of the corpus: bounds what is sent to the workers.
VOCABULARY = 150_000
#: Cost of a letter that is replaced, left out or put in, and of a foreign letter read as some Latin one; letters of a word
#: for each UNKNOWN of its budget, up to one edit; how often a word occurs that is taken although it looks different.
EDIT, UNKNOWN, LETTERS_PER, COMMON = 1.0, 0.5, 3, 100
#: A word wholly in another script is a Latin one in disguise if its spelling occurs so often.
DISGUISED = 5

# Letters that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "к": "k", "ѐ": "è", "ё": "ë", "ї": "ï",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "ε": "e", "ω": "w", "η": "n", "τ": "t", "ό": "ó", "ά": "á", "έ": "é", "ί": "í", "ύ": "ú",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ᴏ": "o", "ꮯ": "C", "Տ": "S", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
}
# Characters without ink (but for a soft hyphen at a line's end), and spaces other than the plain one.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u206a\u206b\u206c\u206d\u206e\u206f\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

NO_INK = re.compile(f"(?!\u00ad\\s*(?:\n|$))[{IGNORABLE}]")
SPACE = re.compile(f"[{SPACES}]")
WIDTHS = re.compile("[０-９Ａ-Ｚａ-ｚﬀ-ﬆ]+|[ｦ-ﾟ]+")
#: Runs of letters of the scripts that look alike.
LETTERS = re.compile("[A-Za-zª-ɏɐ-ʯͰ-ϿЀ-ԯԱ-ևᴀ-ᵿḀ-῿ꬰ-ꮿ]+")
LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
FOREIGN = re.compile("[ɐ-ʯͰ-ϿЀ-ԯԱ-ևᴀ-ᵿꬰ-ꮿı]")
#: What may be out of form; texts without any such character need no look.
SUSPECT = "[\u00a0\u00ad\u0131\u0250-\u02af\u0300-\u036f\u034f\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u061c\u115f\u1160\u1680\u17b4\u17b5\u180e\u1d00-\u1d7f\u1e00-\u1fff\u2000-\u200f\u2010\u2011\u202a-\u202f\u205f-\u206f\u2126\u212a\u212b\u3000\u3099\u309a\uab30-\uabbf\uf900-\ufaff\ufb00-\ufb06\ufe00-\ufe0f\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f]"


#: A word as it is written: letters of any of these scripts and widths, marks, and characters without ink.
RAW_WORD = re.compile(f"(?:[A-Za-zªº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0300-\u036f\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u1d00-\u1d7f\u1e00-\u1fff\u2126\u212a\u212b\uab30-\uabbf\ufb00-\ufb06\uff21-\uff3a\uff41-\uff5a\U0001d400-\U0001d7ff]|(?!\u00ad\\s*(?:\n|$))[{IGNORABLE}])+")
BLANKS = re.compile(r"(\s+)")
PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏªº]+")


def letters_of(token: str) -> list[tuple[tuple[str, ...], bool]]:
    """The letters of a word as it is written, with marks and without what has no ink: of each the plain ways to write it
    that look the same, and whether it may be some Latin letter that no table knows."""
    out = []
    for m in re.finditer(".[\u0300-\u036f]*", re.sub(f"[{IGNORABLE}]", "", token)):
        c = m[0]
        ways = {unicodedata.normalize("NFC", c), unicodedata.normalize("NFC", unicodedata.normalize("NFKC", c))}
        ways |= {unicodedata.normalize("NFC", LOOKALIKES[w[0]] + w[1:]) for w in list(ways) + [c] if w[:1] in LOOKALIKES}
        out.append((tuple(sorted(ways)), c[0] not in LOOKALIKES and FOREIGN.match(c[0]) is not None))
    return out


def nodes(words: dict[str, int]) -> dict:
    """A vocabulary trie; nodes are dicts by character, "" holds the count of the word that ends there."""
    root: dict = {}
    for w, n in words.items():
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = n
    return root


class Trie:
    """Tries of all words, and of those that a spelling which looks different may be taken for."""

    def __init__(self, words: dict[str, int]):
        self.root = nodes(words)
        self.common = nodes({w: n for w, n in words.items() if n >= COMMON})
        self.known: dict[str, tuple[str, int] | None] = {}

    def spelling(self, token: str) -> tuple[str, int] | None:
        """The cheapest and then commonest word that the token may be, with its count."""
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self._spelling(token)
        return self.known[token]

    def _spelling(self, token: str) -> tuple[str, int] | None:
        letters = letters_of(token)
        if found := self._walk(letters, 0.0):  # looks the same
            return found
        scripts = {script(ways[0][0]) for ways, _ in letters if ways[0]}
        if len(scripts) == 1 and "latin" not in scripts:  # a word of another script
            return None
        budget = min(EDIT, UNKNOWN * (len(letters) // LETTERS_PER))
        if any(unknown for _, unknown in letters) and (found := self._walk(letters, budget, self.root, budget + 1)):
            return found
        return self._walk(letters, budget, self.common) if budget >= EDIT and not token[:1].isupper() else None

    def _walk(self, letters: list[tuple[tuple[str, ...], bool]], budget: float, root: dict | None = None, edit: float = EDIT) -> tuple[str, int] | None:
        best: tuple[float, int, str] | None = None
        todo, seen, n = [(0.0, 0, "", self.root if root is None else root)], {}, len(letters)
        while todo:
            cost, i, word, node = todo.pop()
            if cost > budget or seen.get((i, word), 1e9) <= cost:
                continue
            seen[i, word] = cost
            if i == n:
                if "" in node and (best is None or (cost, -node[""]) < (best[0], -best[1])):
                    best = (cost, node[""], word)
            else:
                ways, unknown = letters[i]
                for way in ways:
                    to = node
                    for d in way:
                        to = to.get(d) if to else None
                    if to is not None:
                        todo.append((cost, i + 1, word + way, to))
                step = UNKNOWN if unknown else edit
                if cost + step <= budget:
                    todo += [(cost + step, i + 1, word + d, child) for d, child in node.items() if d]
                if cost + edit <= budget:
                    todo.append((cost + edit, i + 1, word, node))
            if cost + edit <= budget:
                todo += [(cost + edit, i, word + d, child) for d, child in node.items() if d]
        return None if best is None else (best[2], best[1])


def script(c: str) -> str:
    return "latin" if LATIN_WORD.match(c) and c != "ı" else unicodedata.name(c, "?").split(" ")[0].lower()


def one_script(word: str, trie: Trie | None = None) -> str:
    """A run of letters in the letters of one script: by the vocabulary, else by table."""
    return canonical(word, trie) if FOREIGN.search(word) else word


def canonical(word: str, trie: Trie | None) -> str:
    """A word as it is written in its one form: the vocabulary's spelling, else by table."""
    found = trie.spelling(word) if trie else None
    plain = unicodedata.normalize("NFC", WIDTHS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), NO_INK.sub("", word)))
    scripts = {script(c) for c in plain if c.isalpha()}
    if len(scripts) == 1 and "latin" not in scripts:  # a word of its own, unless it spells a common Latin one
        return found[0] if found and found[1] >= DISGUISED else plain
    if found:
        return found[0]
    return "".join(LOOKALIKES.get(c, c) for c in plain) if "latin" in scripts else plain


def consistent(text: str | None, trie: Trie | None = None) -> str | None:
    """The text in its one form."""
    if not text or text.isascii():
        return text
    form = lambda m: m[0] if PLAIN_WORD.fullmatch(m[0]) else canonical(m[0], trie)
    text = "".join([t if t.isascii() else RAW_WORD.sub(form, t) for t in BLANKS.split(text)])
    text = SPACE.sub(" ", NO_INK.sub("", text))
    text = WIDTHS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return unicodedata.normalize("NFC", text)


def count_latin(text: str, counts: Counter) -> None:
    """Adds the words that are in form already; ones with marks or invisible characters beside them are none."""
    counts.update(LATIN_WORD.findall(text) if text.isascii() else [w for t in text.split() if t.isascii() or not FOREIGN.search(t) and not NO_INK.search(t) for w in LATIN_WORD.findall(unicodedata.normalize("NFC", t))])


def vocabulary(df: DataFrame, columns: list[str], size: int = VOCABULARY) -> dict[str, int]:
    """The commonest Latin words of all the columns."""
    return common_words(df, columns, count_latin, lambda w: w, size)


def unified(df: DataFrame, columns: list[str], words: dict[str, int] | None = None) -> DataFrame:
    """df with each of the columns in its consistent form. Narrow; only values with a suspect character go to Python."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(df, columns) if words is None else words)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = built(shared, Trie)
        for values in batches:
            yield values.map(lambda t: consistent(t, trie))

    return df.withColumns({c: F.when(F.col(c).rlike(SUSPECT), run(F.when(F.col(c).rlike(SUSPECT), F.col(c)))).otherwise(F.col(c)) for c in columns})


FIELDS = ["title", "start_snippet", "raw_text"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that their consistent form differs from. Copies of a row give equal results, kept once."""
    rows = table(spark, sf_dir, "chapters").select("chapter_id", *FIELDS)
    words = vocabulary(rows, FIELDS)
    long = rows.select("chapter_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS))).alias("x")).select("chapter_id", "x.field", "x.value")
    suspect = long.where(F.col("value").rlike(SUSPECT)).withColumn("before", F.col("value"))
    return unified(suspect, ["value"], words).where("value <> before").select("chapter_id", "field").distinct()


def p3_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chapters").select("chapter_id", *FIELDS)
    return unified(once(rows, "chapter_id"), FIELDS, vocabulary(rows, FIELDS))


QUERIES = {"p3_found": p3_found, "p3_consistent": p3_consistent}
SQL: dict[str, str] = {}
