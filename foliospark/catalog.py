"""The queries of the core over the test tables, and the SQL that gives the same rows.

The pages in `documents` have no headings, so a fixture derives Markdown from them by line number."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalog_sql import SQL
from foliospark.functions.text import nn, squeeze
from foliospark.operators import anchors, assemble, chunks, model, structure
from foliospark.options import REFUSAL_PHRASES, Options
from foliospark.plans import pipelines
from foliospark.session import once, spread, table
from foliospark.sources import files

# Titles of the fixture, some kept, some excluded, one protected.
TITLES = ("Introduction", "References", "Methods", "Notes on contributors", "Index terms")
STUB = Options(first_delay_s=0.0, concurrency=32)


def fixture(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, text, md) and more columns of the pages: headings by line number, every sixth."""
    titles = ", ".join(f"'{t}'" for t in TITLES)
    md = rf"""array_join(transform(split(coalesce(text, ''), '\n'), (x, i) -> CASE
      WHEN i = 0 THEN concat('# ', x)
      WHEN i % 6 = 2 THEN concat('## ', element_at(array({titles}), cast((doc_id + i) % 5 + 1 as int)))
      WHEN i % 6 = 4 THEN concat('\n### ', x)
      WHEN i % 6 = 5 THEN concat('  - ', x)
      ELSE x END), '\n')"""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more)).select("doc_id", "text", F.expr(md).alias("md"), *more)


def _md(column):
    return lambda spark, sf: fixture(spark, sf).select("doc_id", column(F.col("md")))


def _chunks(cut):
    return lambda spark, sf: chunks.exploded(fixture(spark, sf).select("doc_id", "md"), cut(F.col("md"))).drop("md")


def _shifted():
    return F.expr(r"substr(replace(concat('\n', md), '\n#', '\n##'), 2)")


def heading_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of every level, counted by language; pages without a language count under null."""
    return structure.heading_table(fixture(spark, sf, "lang").select("doc_id", "md", "lang")).groupBy("level", "lang").agg(F.count("*").alias("n"))


def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return chunks.exploded(docs, chunks.fixed_size(F.col("text"), 600, 200)).drop("text")


def _toc(docs: DataFrame) -> DataFrame:
    """A table of contents from the page's own lines 0, 6, 12 ...; in every third anchor one character is another."""
    entry = r"""transform(filter(transform(split(coalesce(text, ''), '\n'), (x, i) -> struct(i as i, x as x)), e -> e.i % 6 = 0),
      e -> struct(concat('T', e.i) as chapter_title, if(e.i % 18 = 12, concat(substr(e.x, 1, 12), '~', substr(e.x, 14, 17)), substr(e.x, 1, 30)) as anchor_text))"""
    return docs.withColumn("toc", F.expr(entry))


def anchor_split(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters between anchors that are found exactly, by likeness, by their titles, or not at all; a null text is empty."""
    docs = _toc(spread(table(spark, sf, "documents").select("doc_id", "text")))
    placed = docs.select("doc_id", "text", anchors.toc_positions(F.col("text"), F.col("toc")).alias("p"))
    cut = placed.select("doc_id", F.posexplode(anchors.chapters_between(F.col("text"), F.col("p"))).alias("chapter_no", "c"))
    return cut.select("doc_id", "chapter_no", "c.title", "c.text", "c.start", "c.end")


def fuzzy_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Each page with an anchor from its middle whose 13th character is another, and where that is found. Null, empty and
    blank texts have an empty anchor and no position."""
    piece = F.expr("trim(lower(substr(text, cast(length(text) / 2 as int), 40)))")
    anchor = F.concat(F.substring(piece, 1, 12), F.lit("~"), F.substring(piece, 14, 40))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    docs = docs.withColumn("anchor", F.when(F.trim(nn(F.col("text"))) == "", "").otherwise(anchor))
    return docs.select("doc_id", "anchor", anchors.fuzzy_find(F.col("text"), F.col("anchor")).alias("pos"))


def web_anchor_split(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters of the fixture by its level-two titles and, of every second, the line below, in which every third entry's
    title is another."""
    entry = r"""transform(filter(transform(split(md, '\n'), (x, i) -> struct(i as i, x as x, get(split(md, '\n'), i + 1) as y)), e -> startswith(e.x, '## ')),
      (e, k) -> struct(if(k % 3 = 2, concat('No such ', substr(e.x, 4)), substr(e.x, 4)) as title, if(k % 2 = 0, '', coalesce(e.y, '')) as start_snippet))"""
    docs = fixture(spark, sf).select("doc_id", "md", F.expr(entry).alias("heads"))
    cut = docs.select("doc_id", F.explode(anchors.chapters_forward(F.col("md"), F.col("heads"))).alias("c"))
    return cut.select("doc_id", F.col("c.id").alias("chapter_no"), "c.title", "c.text")


def toc_json(spark: SparkSession, sf: str) -> DataFrame:
    """A fenced JSON table of contents made of the fixture's headings, read back: excluded titles and invalid entries go."""
    heads = structure.heading_table(fixture(spark, sf).select("doc_id", "md"))
    made = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "title"))).alias("h"))
    entries = F.transform("h", lambda h: F.to_json(F.struct(h["title"].alias("chapter_title"), F.concat(F.lit("line "), h["line_no"].cast("string")).alias("anchor_text"))))
    response = F.concat(F.lit("```json\n["), F.array_join(F.concat(entries, F.array(F.lit("7"), F.lit('{"chapter_title":"x"}'))), ","), F.lit("]\n```"))
    parsed = made.select("doc_id", F.posexplode(anchors.parse_toc(response)).alias("entry_no", "e"))
    return parsed.select("doc_id", "entry_no", "e.chapter_title", "e.anchor_text")


def web_toc_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "chapters").select("chapter_id", "chapter_no", "title"), "chapter_id")
    response = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.array(F.struct(F.col("chapter_no").alias("chapter_number"), "title")).alias("chapters"))), F.lit(" end"))
    return rows.select("chapter_id", F.explode(anchors.parse_web_toc(response)).alias("c")).select("chapter_id", "c.chapter_number", "c.title")


def refusal_filter(spark: SparkSession, sf: str) -> DataFrame:
    calls = once(table(spark, sf, "translation_chunks").select("call_id", "res_text"), "call_id")
    return calls.select("call_id", nn(structure.refused_to_empty(F.col("res_text"), REFUSAL_PHRASES)).alias("kept"))


def glossary_latest(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "glossary_sample").where("updated_at is not null").select("file_name", "entry_id", "updated_at")
    return files.latest(entries, "file_name", "updated_at")


def glossary_list(spark: SparkSession, sf: str) -> DataFrame:
    """The stored glossaries with a prefix, the newest first."""
    stored = table(spark, sf, "dictionary_files").select(F.concat(F.lit("dict_"), "file_name").alias("name"), "updated_at")
    return files.listed(stored, "name", "updated_at", "dict_h").select(F.substring("name", 6, 1000).alias("file_name"), "updated_at")


def glossary_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dictionary_files").select("file_name", files.glossary_text(F.col("content")).alias("glossary"))


def glossary_compiled(spark: SparkSession, sf: str) -> DataFrame:
    return files.compiled(table(spark, sf, "dictionary_files"), "file_name", "content", "updated_at")


def glossary_delete(spark: SparkSession, sf: str) -> DataFrame:
    store = table(spark, sf, "dictionary_files").select("file_name", "updated_at")
    return files.deleted(store, store.where("file_name like '%s.csv'"), "file_name")


def join_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each call's prompt: its chunk, its paper's name and a constant. AQE splits the skewed papers."""
    calls = once(table(spark, sf, "translation_chunks").select("call_id", "paper_id", "chunk_no", "clean_markdown"), "call_id")
    papers = table(spark, sf, "paper_pipeline").select("paper_id", "paper_name")
    prompt = model.filled("{{ctx}} {summary_content}\n{chunk_text}\n{glossary_content}", summary_content=F.col("paper_name"), chunk_text=F.col("clean_markdown"), glossary_content=F.lit("term: 訳"))
    return calls.join(papers, "paper_id").select("call_id", "chunk_no", prompt.alias("prompt"))


def ordered_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The last attempt's answer of each chunk, joined in order per paper."""
    calls = table(spark, sf, "translation_chunks").where("res_text is not null").select("paper_id", "chunk_no", "attempt", "call_id", "res_text")
    last = calls.groupBy("paper_id", "chunk_no").agg(F.max(F.struct("attempt", "call_id", "res_text")).alias("x")).select("paper_id", "chunk_no", F.col("x.res_text").alias("answer"))
    return chunks.rejoined(last, ["paper_id"], "chunk_no", "answer")


def title_and_body(spark: SparkSession, sf: str) -> DataFrame:
    title = structure.document_title(F.col("md"), F.lit("untitled"))
    return fixture(spark, sf).select("doc_id", title.alias("title"), structure.without_title(F.col("md")).alias("body"), F.substring(nn(F.col("text")), 1, 5000).alias("opening"))


def paper_outline(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: unwanted sections removed, the rest as an outline."""
    return fixture(spark, sf).select("doc_id", structure.outline(structure.remove_sections(F.col("md"))).alias("outline"))


def assemble_paper(spark: SparkSession, sf: str) -> DataFrame:
    made = assemble.paper(F.concat(F.lit("doc "), F.col("doc_id")), F.lit("# S\n- a\n- b"), F.col("md"), F.replace("md", F.lit("a"), F.lit("A")))
    return fixture(spark, sf).select("doc_id", made.alias("outline"))


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    cut = chunks.exploded(fixture(spark, sf).select("doc_id", "md"), chunks.at_heading(F.col("md"), 2), "chapter").drop("md")
    return cut.withColumns({"title": F.concat(F.lit("C"), F.col("chapter_no")), "summary": F.when(F.col("chapter_no") % 2 == 0, F.lit("- s")).otherwise(""), "translated": F.col("chapter")})


def assemble_book(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("book "), F.col("doc_id")).alias("name"), F.lit("- all").alias("summary"))
    return assemble.book(_chapters(spark, sf), books, "doc_id", "chapter_no", assemble.chapter(F.col("title"), F.col("summary"), F.col("translated")))


def assemble_web_book(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "documents").select("doc_id", F.lit("- all\n\n- of it").alias("summary"))
    return assemble.web_book(_chapters(spark, sf), books, "doc_id", "chapter_no")


def assemble_simple_book(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.simple_book(_chapters(spark, sf), "doc_id", "chapter_no")


def joined_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.joined_markdown(_chapters(spark, sf), "doc_id", "chapter_no", "chapter")


def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters with results by position, to the shorter of the two."""
    left = _chapters(spark, sf).select("doc_id", "chapter_no", "title")
    right = chunks.exploded(fixture(spark, sf).select("doc_id", "md"), chunks.at_heading(F.col("md"), 3), "chapter").select("doc_id", "chapter_no", "chapter")
    return left.join(right, ["doc_id", "chapter_no"])


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.counted(chunks.exploded(fixture(spark, sf).select("doc_id", "md"), chunks.by_paragraphs(F.col("md"), 300)).drop("md"), "doc_id")


def model_stub(spark: SparkSession, sf: str) -> DataFrame:
    """The stub's answer to each whole text."""
    docs = spread(table(spark, sf, "paper_pipeline").where("structured_md is not null").select("paper_id", "structured_md"))
    return model.called(docs, F.concat(F.lit("Translate:\n\n"), F.replace("structured_md", F.lit("\n\n"), F.lit(" "))), model.stub, STUB, "answer", keys=["paper_id"]).select("paper_id", "answer")


# The stub gives back what follows the form feed, so whole texts go through each pipeline.
ECHO = Options(first_delay_s=0.0, concurrency=32, chapter_concurrency=32, summary_prompt="S\f{text}", structuring_prompt="{summary_hint}\f{raw_text}", translation_prompt="{summary_content}{glossary_content}\f{chunk_text}", book_structuring_prompt="{overall_summary}\f{chapter_text}", book_summary_prompt="\f{text}", chapter_summary_prompt="C\f{text}", book_translation_prompt="{overall_summary}{chapter_summary}\f{chunk_text}", simple_translation_prompt="{chapter_summary}\f{chunk_text}", toc_prompt="TOC:{full_text}")
WEB_ECHO = replace(ECHO, dialect="web", on_error="passthrough")


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf).select("doc_id", F.concat(F.lit("doc "), F.col("doc_id")).alias("name"), F.col("md").alias("text"))


def pipeline_paper(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.paper(_keyed(spark, sf), model.echo, ECHO, "term: 訳", "doc_id").select("doc_id", "structured", "outline")


def pipeline_web_paper(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.paper(_keyed(spark, sf), model.echo, WEB_ECHO, key="doc_id").select("doc_id", "structured", "outline")


def pipeline_archived_web_paper(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.paper(_keyed(spark, sf), model.echo, WEB_ECHO, key="doc_id", label=assemble.WEB_SUMMARY, hinted=False).select("doc_id", "structured", "outline")


def toc_backend(prompt: str) -> str:
    """A stub that answers a table of contents of the text's level-two headings, else as echo."""
    import json

    if not prompt.startswith("TOC:"):
        return model.echo(prompt) or "-"
    heads = [x[3:] for x in prompt.split("\n") if x.startswith("## ")]
    return json.dumps([{"chapter_title": h, "anchor_text": f"## {h}"} for h in heads] or [{"chapter_title": "All", "anchor_text": prompt[4:24]}])


def pipeline_book(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.book(_keyed(spark, sf), toc_backend, replace(ECHO, excluded_sections=()), key="doc_id")


def _book_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return _chapters(spark, sf).select("doc_id", "chapter_no", "title", "chapter")


def pipeline_web_book(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.web_book(table(spark, sf, "documents").select("doc_id"), _book_chapters(spark, sf), model.echo, WEB_ECHO, key="doc_id")


def pipeline_simple_book(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.simple_book(_book_chapters(spark, sf), model.echo, WEB_ECHO, key="doc_id")


def queries() -> dict:
    return {
        "paper_outline": paper_outline,
        "heading_table": lambda s, d: structure.heading_table(fixture(s, d).select("doc_id", "md")),
        "heading_histogram": heading_histogram,
        "extract_outline": _md(lambda c: structure.outline_hint(c).alias("hint")),
        "remove_sections": _md(lambda c: structure.remove_sections(c).alias("kept")),
        "normalize_headings": lambda s, d: fixture(s, d).select("doc_id", structure.shift_headings(_shifted()).alias("shifted")),
        "to_outline": lambda s, d: fixture(s, d).select("doc_id", structure.outline(_shifted()).alias("outline")),
        "dedupe_h1": lambda s, d: fixture(s, d).select("doc_id", structure.dedupe_headers(F.replace("md", F.lit("\n### "), F.lit("\n# "))).alias("cleaned")),
        "strip_headings": _md(lambda c: structure.strip_headings(c).alias("body")),
        "squeeze": lambda s, d: table(s, d, "documents").select("doc_id", squeeze(nn(F.col("text"))).alias("line")),
        "title_and_body": title_and_body,
        "split_h2": _chunks(lambda c: chunks.at_heading(c, 2)),
        "split_h3": _chunks(lambda c: chunks.at_heading(c, 3)),
        "pack_paragraphs": _chunks(lambda c: chunks.by_paragraphs(c, 600)),
        "pack_lines": _chunks(lambda c: chunks.by_length(c, 600)),
        "hier_chunks": _chunks(lambda c: chunks.by_hierarchy(c, 150)),
        "heading_chunks": _chunks(lambda c: chunks.at_any_heading(c, 60)),
        "drop_heading_only": lambda s, d: _chunks(lambda c: chunks.at_heading(c, 2))(s, d).where(~structure.only_headings(F.col("chunk"))),
        "fixed_chunks": fixed_chunks,
        "chapters_h1": lambda s, d: chunks.exploded(fixture(s, d).select("doc_id", F.replace("md", F.lit("\n### "), F.lit("\n# ")).alias("md")), chunks.chapters_at_h1(F.col("md")), "c").select("doc_id", "c_no", "c.title", "c.text"),
        "chunk_counts": chunk_counts,
        "anchor_split": anchor_split,
        "fuzzy_anchor": fuzzy_anchor,
        "web_anchor_split": web_anchor_split,
        "toc_json": toc_json,
        "web_toc_json": web_toc_json,
        "refusal_filter": refusal_filter,
        "glossary_latest": glossary_latest,
        "glossary_list": glossary_list,
        "glossary_rows": glossary_rows,
        "glossary_compiled": glossary_compiled,
        "glossary_delete": glossary_delete,
        "join_context": join_context,
        "ordered_answers": ordered_answers,
        "positional_join": positional_join,
        "assemble_paper": assemble_paper,
        "assemble_book": assemble_book,
        "assemble_web_book": assemble_web_book,
        "assemble_simple_book": assemble_simple_book,
        "joined_markdown": joined_markdown,
        "model_stub": model_stub,
        "pipeline_paper": pipeline_paper,
        "pipeline_web_paper": pipeline_web_paper,
        "pipeline_archived_web_paper": pipeline_archived_web_paper,
        "pipeline_book": pipeline_book,
        "pipeline_web_book": pipeline_web_book,
        "pipeline_simple_book": pipeline_simple_book,
    }


def oracle_sql() -> dict[str, str]:
    return SQL

