"""Splitters: one document to its chunks, as arrays. Narrow; `exploded` makes rows of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import HS, join, let, nn, scan, strip


def at_heading(text: Column, level: int) -> Column:
    """Cut before each line that begins with the marks of one level; the chunks join by \\n to the text."""
    return F.split(nn(text), rf"\n(?={'#' * level} )")


def packed(parts: Column, limit: int, by: str) -> Column:
    """Neighbouring parts together as long as their lengths, with separators, stay within the limit."""

    def step(n: Column, x: Column) -> Column:
        cost = F.length(x) + len(by)
        full = (n + cost > limit) & (n > 0)
        return F.struct(F.when(full | (n == 0), cost).otherwise(n + cost).alias("s"), (full | (n == 0)).alias("v"))

    def joined(p: Column, firsts: Column) -> Column:
        starts = F.filter(F.transform(firsts, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda s, k: F.array_join(F.slice(p, s + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - s), by)))

    return let(parts, lambda p: joined(p, scan(p, F.lit(0), step, "boolean")))


def by_paragraphs(text: Column, limit: int) -> Column:
    return packed(F.split(nn(text), "\n\n"), limit, "\n\n")


def by_length(text: Column, limit: int) -> Column:
    """Lines packed up to the limit; a text within it stays whole."""
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed(F.split(nn(text), "\n"), limit, "\n"))


def by_hierarchy(text: Column, limit: int) -> Column:
    """Cut at level two; what is over the limit at level three, then four, then between paragraphs."""
    out = at_heading(text, 2)
    for cut in (lambda c: at_heading(c, 3), lambda c: at_heading(c, 4), lambda c: by_paragraphs(c, limit)):
        out = F.flatten(F.transform(out, _oversize(cut, limit)))
    return out


def _oversize(cut: Callable[[Column], Column], limit: int) -> Callable[[Column], Column]:
    def one(c: Column) -> Column:
        return F.when(F.length(c) <= limit, F.array(c)).otherwise(cut(c))

    return one


def at_any_heading(text: Column, limit: int) -> Column:
    """Cut before every line that begins with #; what is over the limit between lines."""
    parts = F.split(nn(text), rf"(?U)\n(?={HS}*#)")
    return F.flatten(F.transform(parts, lambda c: by_length(c, limit)))


def fixed_size(text: Column, size: int, extension: int) -> Column:
    """Chunks of a size, each drawn out to the next line's end if that is near."""
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("out"), F.lit(0).alias("at"))

    def spans(t: Column, n: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            end = s["at"] + size
            found = F.call_function("locate", F.lit("\n"), t, end + 1)
            last = F.when(end >= n, n).when((found > 0) & (found - 1 - end < extension), found).otherwise(end)
            return F.when(s["at"] < n, F.struct(F.array_append(s["out"], F.struct(s["at"].alias("s"), last.alias("e"))).alias("out"), last.alias("at"))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(0), F.floor(n / size).cast("int")), start, step, lambda s: s["out"])

    return let(nn(text), lambda t: F.transform(let(F.length(t), lambda n: spans(t, n)), lambda x: F.substring(t, x["s"] + 1, x["e"] - x["s"])))


def chapters_at_h1(text: Column) -> Column:
    """Chapters (title, text) at level-one headings; untitled ones are numbered, a text without any is one."""
    parts = F.split(nn(text), r"(?U)\n(?=#\s+\S)")
    title = lambda p: strip(F.regexp_extract(p, r"(?U)^#\s+([^\n]+)", 1))
    return F.transform(parts, lambda p, i: F.struct(F.when(title(p) != "", title(p)).otherwise(F.concat(F.lit("Section "), (i + 1).cast("string"))).alias("title"), strip(p).alias("text")))


def exploded(df: DataFrame, chunks: Column, name: str = "chunk") -> DataFrame:
    """One row per chunk with its number; chunk_no keeps the order. Columns of these names are replaced."""
    return df.select(*(c for c in df.columns if c not in (name, f"{name}_no")), F.posexplode(chunks).alias(f"{name}_no", name))


def rejoined(df: DataFrame, keys: list[str], no: str, text: str, by: str = "\n\n") -> DataFrame:
    """Chunks back together in their order, one row per key. Pre-aggregated per task, then by key."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(no).alias("n"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(join(F.transform(ordered, lambda x: x["t"]), by).alias(text))
