"""Operators on the headings of a document: filters, levels, outlines.

A document is cut before its headings by one split; the parts are transformed as array elements. So each operator is a
projection: no row is exploded, nothing is shuffled, and a document costs time in proportion to its length. Null text is
the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import HS, INK, WS, contains_any, flush_level, heading_level, heading_title, is_h1, join, let, lines, nn, scan, starts_hash, strip
from foliospark.options import ANALYSIS_HEADINGS, EXCLUDED_SECTIONS, HINT_EXCLUDED, PROTECTED_SECTIONS


def heading_table(df: DataFrame, text: str = "md", dialect: str = "python") -> DataFrame:
    """df's other columns with (line_no, level, title) of each heading; columns of these names are replaced."""
    rest = [c for c in df.columns if c not in (text, "line_no", "level", "title", "_line")]
    exploded = df.select(*rest, F.posexplode(lines(nn(F.col(text)), dialect)).alias("line_no", "_line"))
    return exploded.withColumn("level", heading_level(F.col("_line"))).where("level is not null").select(*rest, "line_no", "level", strip(heading_title(F.col("_line"))).alias("title"))


def outline_hint(text: Column, dialect: str = "python") -> Column:
    """The headings of a summary, but for those of analysis and of sections without content."""
    heads = F.transform(lines(nn(text), dialect), strip)
    return join(F.filter(heads, lambda x: F.startswith(x, F.lit("#")) & ~contains_any(x, ANALYSIS_HEADINGS) & ~contains_any(F.lower(x), [w.lower() for w in HINT_EXCLUDED])))


def sections(text: Column) -> Column:
    """A text with \\n only, cut before each stripped heading; the pieces join by \\n to the text."""
    return F.split(text, rf"(?U)\n(?={HS}*#{{1,10}}{HS}+{INK})")


def _first_line(section: Column) -> Column:
    return F.substring_index(section, "\n", 1)


def remove_sections(text: Column, keywords=EXCLUDED_SECTIONS, protected=PROTECTED_SECTIONS, dialect: str = "python") -> Column:
    """Without the sections whose title has a keyword and no protected word, and stripped.

    Such a heading starts a skip at its level, or sets its level while one goes on; a heading of that level or above
    that is no such ends it."""
    whole = join(lines(nn(text), dialect))

    def described(s: Column) -> Column:
        head = strip(_first_line(s))
        level = heading_level(head)
        out = let(F.lower(heading_title(head)), lambda t: contains_any(t, [k.lower() for k in keywords]) & ~contains_any(t, protected))
        return F.struct(s.alias("s"), level.alias("level"), F.when(level.isNotNull(), out).otherwise(False).alias("out"))

    def step(skip: Column, x: Column) -> Column:
        leaves = x["level"].isNotNull() & x["out"]
        now = F.when(leaves, x["level"]).when((skip > 0) & x["level"].isNotNull() & (x["level"] <= skip), F.lit(0)).otherwise(skip)
        return F.struct(now.alias("s"), (now == 0).alias("v"))

    def kept(parts: Column) -> Column:
        return let(scan(parts, F.lit(0), step, "boolean"), lambda stays: join(F.transform(F.filter(parts, lambda x, i: F.get(stays, i)), lambda x: x["s"])))

    return strip(let(F.transform(sections(whole), described), kept))


def dedupe_headers(text: Column) -> Column:
    """Keeps the first level-one heading only, and no introduction after line 30 (counted from 0)."""
    late = lambda x: F.startswith(F.lower(strip(x)), F.lit("## introduction"))

    def cleaned(all_lines: Column) -> Column:
        first = F.array_position(F.transform(all_lines, is_h1), True)
        return let(first, lambda f: F.filter(all_lines, lambda x, i: F.when(is_h1(x), i == (f - 1).cast("int")).otherwise(~(late(x) & (i > 30)))))

    return join(let(F.split(nn(text), "\n"), cleaned))


def strip_headings(text: Column) -> Column:
    """Without heading lines, trimmed."""
    return strip(F.regexp_replace(nn(text), "(?m)^#+.*$", ""))


def shift_headings(text: Column, dialect: str = "python") -> Column:
    """All headings raised so that the highest is of level one; texts without a heading above level ten stay."""

    def moved(x: Column, top: Column) -> Column:
        own = flush_level(x)
        return F.when(own.isNotNull(), F.concat(F.repeat(F.lit("#"), own - top + 1), F.lit(" "), strip(F.regexp_replace(x, "^#{1,10}", "")))).otherwise(x)

    def shifted(all_lines: Column) -> Column:
        return let(F.array_min(F.transform(all_lines, flush_level)), lambda top: F.when((top > 1) & (top < 10), join(F.transform(all_lines, lambda x: moved(x, top)))).otherwise(nn(text)))

    return let(lines(nn(text), dialect), shifted)


def outline(text: Column, dialect: str = "python") -> Column:
    """The text as nested list lines: headings two blanks deeper per level, lists and text below their heading."""
    whole = join(lines(shift_headings(text, dialect), dialect))
    mark = rf"(?U)^(?:[-*+]|\d+\.){WS}+"

    def line(x: Column, depth: Column) -> Column:
        bare = F.regexp_replace(x, f"(?U)^{WS}+", "")
        return let(bare, lambda b: F.concat(F.repeat(F.lit(" "), depth * 2 + F.length(x) - F.length(b)), F.lit("- "), F.regexp_replace(strip(b), mark, "")))

    def section(s: Column) -> Column:
        return let(F.split(s, "\n"), lambda own: let(F.coalesce(heading_level(F.get(own, F.lit(0))), F.lit(0)), lambda level: listed(own, level)))

    def listed(own: Column, level: Column) -> Column:
        head = F.when(level > 0, F.array(F.concat(F.repeat(F.lit(" "), (level - 1) * 2), F.lit("- "), heading_title(F.get(own, F.lit(0)))))).otherwise(F.array().cast("array<string>"))
        rest = F.filter(F.when(level > 0, F.slice(own, 2, F.size(own))).otherwise(own), lambda x: strip(x) != "")
        return F.concat(head, F.transform(rest, lambda x: line(x, level)))

    return join(F.flatten(F.transform(sections(whole), section)))


def document_title(text: Column, default: Column, dialect: str = "python") -> Column:
    """The title of a structured text: its first line if that is a level-one heading, else the default."""
    first = _first_line(nn(text))
    if dialect == "web":
        return F.when(F.startswith(first, F.lit("# ")), F.trim(F.regexp_replace(first, "^# ", ""))).otherwise(default)
    return F.when(is_h1(first), F.replace(strip(first), F.lit("# "), F.lit(""))).otherwise(default)


def without_title(text: Column, dialect: str = "python") -> Column:
    """The body below a level-one heading in the first line. python: always stripped; web: only if a heading went."""
    first, rest = _first_line(nn(text)), F.when(F.contains(nn(text), F.lit("\n")), F.regexp_replace(nn(text), r"(?s)^[^\n]*\n", "")).otherwise("")
    if dialect == "web":
        return F.when(F.startswith(first, F.lit("# ")), strip(rest)).otherwise(nn(text))
    return strip(F.when(is_h1(first), rest).otherwise(nn(text)))


def only_headings(text: Column) -> Column:
    """Whether a chunk is blank or has heading lines only."""
    bare = strip(nn(text))
    return (bare == "") | F.forall(F.split(bare, "\n"), starts_hash)


def refused_to_empty(text: Column, phrases, limit: int = 500) -> Column:
    """Short answers with a phrase that declines become empty."""
    return F.when((F.length(text) < limit) & contains_any(text, phrases), F.lit("")).otherwise(text)
