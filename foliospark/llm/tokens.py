"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; the symbols of a word form a doubly linked list, and a
priority queue of merge ranks names the next pair to join. Entries whose symbols have changed meanwhile are stale
and skipped. Decoding concatenates the vocabulary's strings.

Null and empty texts have the empty list of ids. Ties of rank go to the leftmost pair. Rows repeat as they come.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import spread, table

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# The pattern that goes with the vocabulary, and the same for texts of Latin letters and common signs only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = r"[\x00-\u017f\u2010-\u2027\u2030-\u2043\u20ac]*"
LATIN_PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

#: Words remembered by a worker; the memory is emptied when full.
REMEMBERED = 400_000


class Encoder(dict):
    """Encodes and decodes by the ranks of a vocabulary file. As a dict it holds the ids of words met before, as bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.strings = {i: s for s, i in self.ranks.items()}
        self.split, self.split_latin, self.latin = regex.compile(PATTERN), re.compile(LATIN_PATTERN), re.compile(LATIN)

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.word(word.encode("utf-8"))).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids

    def word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        symbols = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not symbols[i] or j >= n or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue  # stale: one of the two was joined with another since
            symbols[i] += symbols[j]
            symbols[j] = b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (r := ranks.get(pair := symbols[left] + symbols[right])) is not None:
                    heapq.heappush(queue, (r, left, right, len(pair)))
        return [ranks[s] for s in symbols if s]

    def encode(self, text: str | None) -> bytes:
        """The ids as 32-bit integers of the machine's byte order."""
        if not text:
            return b""
        split = self.split_latin if text.isascii() or self.latin.fullmatch(text) else self.split
        try:
            return b"".join(map(self.__getitem__, split.findall(text)))
        except UnicodeEncodeError:  # a lone surrogate has no bytes of its own
            return self.encode(text.encode("utf-8", "replace").decode("utf-8"))

    def ids(self, text: str | None) -> list[int]:
        return array("i", self.encode(text)).tolist()

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str = f"{TOKENIZERS}/{VOCABULARY}") -> Encoder:
    """The encoder of a vocabulary file, loaded once in each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, key: str, text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, ids) of each row. Narrow: no shuffle, texts go to Python in Arrow batches, ids come back as one buffer."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            rows = batch.num_rows
            for start in range(0, rows, 512):  # the ids of a slice only are in memory
                part = batch.slice(start, 512)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """df with the column `decoded`: the text that the ids stand for; null for null ids."""
    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        e = encoder(path)
        return lists.map(lambda x: None if x is None else e.decode(x))

    return df.withColumn("decoded", run(F.col(ids)))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the text that its ids decode to, whether that is its own, and whether it has ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode_keep(docs), "ids")
    return both.select("doc_id", "decoded", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"), (F.size("ids") > 0).alias("any_ids"))


def encode_keep(docs: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """docs with the column `ids`, all other columns kept."""
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return texts.map(e.ids)

    return docs.withColumn("ids", run(F.col(text)))


QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip}
SQL = {"p7_round_trip": "select doc_id, coalesce(text, '') as decoded, true as same, coalesce(text, '') <> '' as any_ids from documents"}
