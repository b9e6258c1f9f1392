"""Assembly of summaries and translations into indented outlines. Null parts are empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import indent, is_h1, join, lines, nn, strip
from foliospark.operators.structure import document_title, outline, without_title

# Labels of nodes, and notes for parts that are missing.
PAPER_SUMMARY, WEB_SUMMARY, CHAPTER_SUMMARY, BOOK_SUMMARY = "レジュメ (Resume)", "要約 (Summary)", "章レジュメ", "全体レジュメ"
NO_SUMMARY, NO_TRANSLATION = "(要約なし)", "(翻訳なし)"


def _node(label: str, depth: int) -> Column:
    return F.lit(" " * depth + "- " + label + "\n")


def _indented(text: Column, by: int, dialect: str = "python") -> Column:
    """An outline behind blanks; an empty one has no line, in the web dialect one of blanks."""
    made = outline(text, dialect)
    return F.when(made == "", F.lit(" " * by if dialect == "web" else "")).otherwise(indent(made, by, dialect))


def paper(default_title: Column, summary: Column, structured: Column, translated: Column, dialect: str = "python", label: str = PAPER_SUMMARY) -> Column:
    """The outline of a paper: its title, the summary under a label, the body."""
    return F.concat(
        F.lit("- "), document_title(structured, default_title, dialect), F.lit("\n"), _node(label, 2), _indented(summary, 4, dialect), F.lit("\n"), _indented(without_title(translated, dialect), 2, dialect)
    )


def chapter(title: Column, summary: Column, translated: Column) -> Column:
    """The node of a chapter: its summary under a label, its body below the title."""
    parts = lines(nn(translated))
    body = strip(join(F.when(is_h1(F.get(parts, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)))
    return F.concat(F.lit("  - "), nn(title), F.lit("\n"), _node(CHAPTER_SUMMARY, 4), _indented(summary, 6), F.lit("\n"), _indented(body, 4))


def _plain_lines(text: Column, by: int) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    return join(F.transform(kept, lambda x: F.concat(F.lit(" " * by), x)))


def _or(text: Column, default: str) -> Column:
    return F.when(nn(text) == "", F.lit(default)).otherwise(text)


def web_chapter(title: Column, summary: Column, translated: Column) -> Column:
    """A chapter with its summary and translation as two nodes; missing ones have a note."""
    return F.concat(
        F.lit("- "), nn(title), F.lit("\n  - Summary\n"), _plain_lines(_or(summary, NO_SUMMARY), 4), F.lit("\n  - Translation / Body\n"), _indented(_or(translated, NO_TRANSLATION), 4, "web")
    )


def simple_chapter(title: Column, summary: Column, translated: Column) -> Column:
    return F.concat(F.lit("- "), nn(title), F.lit("\n  - Summary\n"), _indented(summary, 4, "web"), F.lit("\n  - Full Text (Translation)\n"), _indented(translated, 4, "web"))


def _ordered(no: str, node: Column, by: str) -> Column:
    return join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), node.alias("node")))), lambda x: x["node"]), by)


def book(chapters: DataFrame, books: DataFrame, key: str, no: str, node: Column) -> DataFrame:
    """(key, outline): the book's name, its summary and its chapters in order. books has (key, name, summary).

    A book without chapters keeps its head. A book is the unit of work: its chapters meet in one row by design."""
    body = chapters.groupBy(key).agg(_ordered(no, node, "\n").alias("_body"))
    head = F.concat(F.lit("- "), F.col("name"), F.lit("\n"), _node(BOOK_SUMMARY, 2), _indented(F.col("summary"), 4), F.lit("\n"))
    return books.join(body, key, "left").select(key, F.concat(head, nn(F.col("_body"))).alias("outline"))


def web_book(chapters: DataFrame, books: DataFrame, key: str, no: str) -> DataFrame:
    """(key, outline) from chapters (key, no, title, summary, translated) and books (key, summary)."""
    body = chapters.groupBy(key).agg(_ordered(no, web_chapter(F.col("title"), F.col("summary"), F.col("translated")), "\n").alias("_body"))
    head = F.concat(F.lit("- Book Summary\n"), _plain_lines(nn(F.col("summary")), 2))
    return books.join(body, key, "left").select(key, F.concat_ws("\n", head, F.col("_body")).alias("outline"))


def simple_book(chapters: DataFrame, key: str, no: str) -> DataFrame:
    return chapters.groupBy(key).agg(_ordered(no, simple_chapter(F.col("title"), F.col("summary"), F.col("translated")), "\n").alias("outline"))


def joined_markdown(chapters: DataFrame, key: str, no: str, text: str) -> DataFrame:
    """Structured chapters with a rule between them."""
    return chapters.groupBy(key).agg(_ordered(no, F.col(text), "\n\n---\n\n").alias("markdown"))
