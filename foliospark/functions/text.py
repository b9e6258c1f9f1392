"""Column functions on text: lines, white space, headings. All narrow, all inside the JVM.

Null columns are taken as the empty string by `nn`; everything else passes nulls through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line separators of str.splitlines, and white space as Python has it (Java's (?U)\s lacks \x1c-\x1f).
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WS = r"[\s\x1c-\x1f]"
# White space inside a line.
HS = r"[[^\S\n]\x1c-\x1f]"
INK = r"[^\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where lambdas below would compute it for each element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """What the states of a fold give for each item, in order, as an array of `kind`.

    step: from (state, item) to a struct of the next state `s` and the given value `v`. Works block by block, as an array
    is copied whenever one more value is put to it: the cost is the items times the block, not their square."""
    none = F.array().cast(f"array<{kind}>")

    def inner(state: Column, part: Column) -> Column:
        one = lambda a, x: let(step(a["s"], x), lambda y: F.struct(y["s"].alias("s"), F.array_append(a["v"], y["v"]).alias("v")))
        return F.aggregate(part, F.struct(state.alias("s"), none.alias("v")), one)

    def outer(state: Column, k: Column) -> Column:
        part = F.slice(items, k * block + 1, F.lit(block))
        return let(inner(state["s"], part), lambda y: F.struct(y["s"].alias("s"), F.array_append(state["v"], y["v"]).alias("v")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    whole = F.aggregate(blocks, F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("v")), outer, lambda s: F.flatten(s["v"]))
    return F.when(F.size(items) > 0, whole).otherwise(none)


def nn(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Both ends without white space of any script."""
    return F.regexp_replace(c, f"(?U)^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, ends stripped."""
    return strip(F.regexp_replace(c, f"(?U){WS}+", " "))


def escape_regex(c: Column) -> Column:
    """The text as a pattern that matches it."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def lines(c: Column, dialect: str = "python") -> Column:
    """The lines of a text. python: every separator counts, no empty line after the last; web: \\n and \\r\\n only."""
    if dialect == "web":
        return F.split(c, "\r?\n")
    return let(F.split(c, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def join(c: Column, by: str = "\n") -> Column:
    return F.array_join(c, by)


def starts_hash(line: Column) -> Column:
    """(a) The stripped line begins with #, tags included."""
    return F.startswith(strip(line), F.lit("#"))


def heading_level(line: Column) -> Column:
    """(b) The level 1 to 10 of a stripped heading, null for other lines."""
    return F.nullif(F.length(F.regexp_extract(strip(line), rf"(?U)^(#{{1,10}}){WS}", 1)), F.lit(0))


def heading_title(line: Column) -> Column:
    return F.regexp_extract(strip(line), rf"(?Us)^#{{1,10}}{WS}+(.*)", 1)


def flush_level(line: Column) -> Column:
    """(c) The level of a heading that begins in the first column, null for other lines."""
    return F.nullif(F.length(F.regexp_extract(line, rf"(?U)^(#{{1,10}}){WS}", 1)), F.lit(0))


def is_h1(line: Column) -> Column:
    """(e) The stripped line begins with one # and a blank."""
    return F.startswith(strip(line), F.lit("# "))


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def indent(c: Column, by: int, dialect: str = "python") -> Column:
    """Every line of a text behind `by` blanks."""
    return join(F.transform(lines(c, dialect), lambda x: F.concat(F.lit(" " * by), x)))
