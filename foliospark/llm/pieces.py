"""Cutting oversized items at natural boundaries, with a stated overlap.

An item is a sequence of tokens (by default its characters) with prefix sums of their sizes; its boundaries are sorted
arrays of token positions, one per kind: paragraph, line, sentence, word. The last boundary under the limit is found by
binary search, the next piece steps back by the overlap, and where no boundary fits the cut is hard.

Items within the limit are one piece. Null items have no pieces, empty ones one empty piece. Ends of pieces depend only
on the item, so repeated rows give the same pieces; leaving the overlaps out, the pieces join to the item again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import once, table

LIMIT, OVERLAP = 4000, 200
#: Kinds of boundaries, the best first. A boundary is where the match ends.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"[.!?][\"')\]”’]*\s+|[。！？][」』）]*")),
    ("word", re.compile(r"\s+|[、，・]")),
)


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokens: Sequence[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut at the end) of each piece, in characters of text.

    tokens: the text cut into tokens; then limit and overlap count tokens. A piece keeps at least half the limit where
    a boundary of a lesser kind allows it, so that a far better boundary close to the start doesn't make crumbs."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    ends = list(accumulate(map(len, tokens))) if tokens is not None else range(1, len(text) + 1)
    n = len(ends)
    at = lambda k: ends[k - 1] if k else 0
    if n <= limit:
        return [(0, len(text), "end")]
    kinds = []
    for kind, pattern in BOUNDARIES:
        marks = (m.end() for m in pattern.finditer(text))
        kinds.append((kind, list(marks) if tokens is None else [k + 1 for m in marks if (k := bisect_right(ends, m) - 1) >= 0 and ends[k] == m]))
    out, start = [], 0
    while n - start > limit:
        high, chosen = start + limit, None
        for low in (start + max(overlap, limit // 2), start + overlap):
            for kind, marks in kinds:
                i = bisect_right(marks, high) - 1
                if i >= 0 and marks[i] > low:
                    chosen = (marks[i], kind)
                    break
            if chosen:
                break
        end, kind = chosen or (high, "hard")
        out.append((at(start), at(end), kind))
        start = end - overlap
    out.append((at(start), len(text), "end"))
    return out


def cut(df: DataFrame, keys: Sequence[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokenize: Callable[[str], Sequence[str]] | None = None) -> DataFrame:
    """(keys, piece_no, start, cut_at, piece) of each item.

    tokenize: cuts a text into tokens, none of them empty, that join to it; then limit and overlap count tokens. Only the texts over the limit go to Python, and only offsets come back; the JVM cuts the strings. Narrow."""

    @F.pandas_udf("array<struct<s:int,e:int,k:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [{"s": s, "e": e, "k": k} for s, e, k in spans(t, limit, overlap, tokenize(t) if tokenize else None)])

    run = run.asNondeterministic()  # else the plan asks for the offsets once more, to filter out items without any
    items = df.select(*keys, F.col(text).alias("_t")).where("_t is not null")
    whole = items.where(F.length("_t") <= limit).select(*keys, F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.lit("end").alias("cut_at"), F.col("_t").alias("piece"))
    big = items.where(F.length("_t") > limit).withColumn("_s", run("_t"))
    pieces = big.select(*keys, "_t", F.posexplode("_s").alias("piece_no", "_p")).select(
        *keys, "piece_no", F.col("_p.s").alias("start"), F.col("_p.k").alias("cut_at"), F.expr("substring(_t, _p.s + 1, _p.e - _p.s)").alias("piece")
    )
    return whole.unionByName(pieces)


def items(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """(src, row_id, text): raw_text of chapters, on demand each chapter once, and structured_md of papers."""
    chapters = table(spark, sf_dir, "chapters").select("chapter_id", "raw_text")
    chapters = once(chapters, "chapter_id") if single else chapters
    a = chapters.select(F.lit("chapters").alias("src"), F.col("chapter_id").alias("row_id"), F.col("raw_text").alias("text"))
    b = table(spark, sf_dir, "paper_pipeline").select(F.lit("paper_pipeline").alias("src"), F.col("paper_id").alias("row_id"), F.col("structured_md").alias("text"))
    return a.unionByName(b)


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each item, once whatever the number of delivered copies."""
    return cut(items(spark, sf_dir, True).where(F.length("text") > LIMIT), ["src", "row_id"], "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that were cut. Copies are cut alike, so it is enough to drop repeated keys, not texts."""
    return cut(items(spark, sf_dir), ["src", "row_id"], "text").where("piece_no = 1").select("src", "row_id").distinct()


def p6_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item that was cut: its pieces joined again without their overlaps, and whether all keep the limit and begin
    with the end of the one before. The pieces of one item, no more, meet in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("piece_no", "piece")))
    joined = p6_pieces(spark, sf_dir).groupBy("src", "row_id").agg(F.transform(ordered, lambda x: x["piece"]).alias("p"))
    own = F.transform("p", lambda x, i: F.when(i == 0, x).otherwise(F.substring(x, OVERLAP + 1, LIMIT)))
    kept = F.forall("p", lambda x: F.length(x) <= LIMIT)
    tails = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.right(a, F.lit(OVERLAP)) == F.left(b, F.lit(OVERLAP)))
    return joined.select("src", "row_id", F.array_join(own, "").alias("text"), kept.alias("within_limit"), F.forall(tails, lambda x: x).alias("overlapping"))


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_rejoined": p6_rejoined}
SQL = {
    "p6_rejoined": """select distinct src, row_id, t as text, true as within_limit, true as overlapping from (
  select 'chapters' as src, chapter_id as row_id, raw_text as t from chapters
  union all select 'paper_pipeline', paper_id, structured_md from paper_pipeline) where length(t) > 4000""",
    "p6_found": """select distinct src, row_id from (
  select 'chapters' as src, chapter_id as row_id, raw_text as t from chapters
  union all select 'paper_pipeline', paper_id, structured_md from paper_pipeline) where length(t) > 4000"""
}
