"""Whole pipelines from documents to outlines, as functions from DataFrame to DataFrame.

Documents are told apart by a key, their name unless another column is given; names may then repeat. Sections are removed
before chunks are made, and blank or heading-only chunks before the model is called, for nothing moves filters across
model calls. Only keys and prompts go to the model; each stage's answers are a table, joined by the key.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import nn, squeeze, strip
from foliospark.operators import anchors, assemble, chunks, model, structure
from foliospark.options import REFUSAL_PHRASES, Options
from foliospark.session import stage

# What stands for a translation whose template lacks a variable, for parts of a chapter that failed, and
# what a chapter's call is told about its place.
UNFILLED = "[システムエラー: プロンプトの変数が一致しません: {error}]"
CHAPTER = "Current Chapter: %s\nSection Type: %s"


def translated(df: DataFrame, key: str, text: str, summary: str, glossary: Column, backend: model.Backend, options: Options, refusals: bool = False) -> DataFrame:
    """(key, translated): the text in chunks, each with its document's summary and the glossary, answers joined in order.

    python: heading-only chunks and empty answers are dropped; web: none. Documents without a chunk give empty text. With
    `refusals`, answers that decline are empty, and a template with a variable that isn't known gives a note."""
    web = options.dialect == "web"
    parts = chunks.exploded(df.select(key, summary, text), chunks.by_hierarchy(F.col(text), options.translation_chunk)).drop(text)
    if not web:
        parts = parts.where(~structure.only_headings(F.col("chunk")))
    try:
        prompt = model.filled(options.translation_prompt, summary_content=F.col(summary), chunk_text=F.col("chunk"), glossary_content=glossary, context_guide=F.lit(""))
    except KeyError as e:
        if not refusals:
            raise
        return df.select(key, F.lit(UNFILLED.format(error=e)).alias("translated"))
    answers = model.called(parts.select(key, "chunk_no", "chunk", summary), prompt, backend, options, "answer", "chunk", [key, "chunk_no"]).select(key, "chunk_no", "answer")
    if refusals:
        answers = answers.withColumn("answer", structure.refused_to_empty(F.col("answer"), REFUSAL_PHRASES, options.refusal_limit))
    if not web:
        answers = answers.where("answer <> ''")
    joined = chunks.rejoined(answers, [key], "chunk_no", "answer").withColumnRenamed("answer", "translated")
    return df.select(key).join(joined, key, "left").select(key, nn(F.col("translated")).alias("translated"))


def paper(docs: DataFrame, backend: model.Backend, options: Options = Options(), glossary: str = "", key: str = "name", label: str = assemble.PAPER_SUMMARY, hinted: bool = True) -> DataFrame:
    """(key, name, structured, outline) of documents (key, name, text): summary, structure, sections removed, translation,
    outline.

    `structured` is the text before sections are removed, as the intermediate sink has it. The archived web papers have
    another label, and are structured first, without a hint, and then summed up: hinted = False."""
    with_key = [key]
    if hinted:
        one = model.called(docs, model.filled(options.summary_prompt, text=F.col("text")), backend, options, "summary", keys=with_key)
        one = one.withColumn("hint", structure.outline_hint(F.col("summary"), options.dialect))
        two = model.called(one, model.filled(options.structuring_prompt, summary_hint=F.col("hint"), raw_text=F.col("text"), context_guide=F.lit("")), backend, options, "structured", keys=with_key)
        kept = two.withColumn("kept", structure.remove_sections(F.col("structured"), options.excluded_sections, dialect=options.dialect))
    else:
        one = model.called(docs, model.filled(options.structuring_prompt, summary_hint=F.lit(""), raw_text=F.col("text"), context_guide=F.lit("")), backend, options, "structured", keys=with_key)
        kept = model.called(one, model.filled(options.summary_prompt, text=F.col("structured")), backend, options, "summary", keys=with_key).withColumn("kept", F.col("structured"))
    done = translated(kept, key, "kept", "summary", F.lit(glossary), backend, options)
    body = structure.dedupe_headers(F.col("translated")) if options.dialect == "web" else F.col("translated")
    return kept.join(done, key).select(*dict.fromkeys((key, "name")), "structured", assemble.paper(F.col("name"), F.col("summary"), F.col("kept"), body, options.dialect, label).alias("outline"))


def chapters_of(docs: DataFrame, toc: Column, text: str = "text", key: str = "name") -> DataFrame:
    """(key, chapter_no, title, chapter, start, end) of each entry of a table of contents."""
    placed = docs.withColumn("_p", anchors.toc_positions(F.col(text), toc))
    cut = placed.select(key, F.posexplode(anchors.chapters_between(F.col(text), F.col("_p"))).alias("chapter_no", "c"))
    return cut.select(key, "chapter_no", "c.title", F.col("c.text").alias("chapter"), "c.start", "c.end")


def structured_in_parts(df: DataFrame, keys: list[str], text: str, hint: str, backend: model.Backend, options: Options, guide: Column | None = None) -> DataFrame:
    """(keys, structured): long texts in fixed-size parts, blank ones left out, answers joined in order. Each call's guide
    says which part of how many it is."""
    cut = df.select(*keys, hint, text, nn(F.lit("") if guide is None else guide).alias("_guide")).withColumn("_parts", chunks.fixed_size(F.col(text), options.structuring_chunk, options.structuring_extension))
    parts = chunks.exploded(cut.withColumn("_of", F.size("_parts")).drop(text), F.col("_parts")).drop("_parts").where(strip(F.col("chunk")) != "")
    place = F.concat("_guide", F.lit(" (Part "), F.col("chunk_no") + 1, F.lit("/"), F.col("_of"), F.lit(")"))
    prompt = model.filled(options.structuring_prompt, summary_hint=F.col(hint), raw_text=F.col("chunk"), context_guide=place)
    answers = model.called(parts, prompt, backend, options, "structured", "chunk", [*keys, "chunk_no"]).select(*keys, "chunk_no", "structured")
    return df.select(*keys).join(chunks.rejoined(answers, keys, "chunk_no", "structured"), keys, "left").select(*keys, nn(F.col("structured")).alias("structured"))


def book(docs: DataFrame, backend: model.Backend, options: Options = Options(), glossary: str = "", key: str = "name") -> DataFrame:
    """(key, outline) of books (key, name, text): summary of the opening, table of contents, chapters, each as a paper."""
    opening = F.substring("text", 1, options.introduction_chars)
    one = model.called(docs, model.filled(options.summary_prompt, text=opening, context_guide=F.lit("")), backend, options, "summary", keys=[key])
    two = model.called(one, model.filled(options.toc_prompt, full_text=F.col("text")), backend, options, "answer", keys=[key])
    many = replace(options, concurrency=options.chapter_concurrency)
    parts = chapters_of(two, anchors.parse_toc(F.col("answer"), options.excluded_sections), key=key)
    parts = stage(parts.withColumn("_part", F.concat_ws("\x1f", key, "chapter_no")), "chapters")  # dear to find, and read by each call
    guide = F.concat(F.lit("This text is Chapter "), F.col("chapter_no") + 1, F.lit(" '"), nn(F.col("title")), F.lit("' of the book."))
    summed = model.called(parts, model.filled(options.summary_prompt, text=F.col("chapter"), context_guide=guide), backend, many, "summary", keys=["_part"])
    summed = summed.withColumn("hint", structure.outline_hint(F.col("summary")))
    built = summed.join(structured_in_parts(summed.withColumn("guide", guide), ["_part"], "chapter", "hint", backend, many, F.col("guide")), "_part")
    kept = built.withColumn("kept", structure.remove_sections(F.col("structured"), options.excluded_sections))
    done = kept.join(translated(kept, "_part", "kept", "summary", F.lit(glossary), backend, many, refusals=True), "_part")
    heads = two.select(key, F.col("name").alias("_name"), "summary").withColumnRenamed("_name", "name") if key != "name" else two.select("name", "summary")
    return assemble.book(done, heads, key, "chapter_no", assemble.chapter(F.col("title"), F.col("summary"), F.col("translated")))


def web_chapters(docs: DataFrame, backend: model.Backend, options: Options, key: str = "name") -> DataFrame:
    """(key, chapter_no, title, section_type, chapter) of books by the model's table of contents; without a readable one
    the whole text is one chapter."""
    asked = model.called(docs, model.filled(options.web_toc_prompt, text=F.col("text")), backend, options, "answer", keys=[key])
    found = anchors.chapters_forward(F.col("text"), anchors.parse_web_toc(F.col("answer")), kinds=True)
    cut = asked.select(key, F.explode(found).alias("c")).select(key, F.col("c.id").alias("chapter_no"), "c.title", "c.section_type", F.col("c.text").alias("chapter"))
    return stage(cut, "chapters")  # dear to find, and read by each call


def web_book(docs: DataFrame, chapters: DataFrame | None, backend: model.Backend, options: Options = Options(dialect="web", on_error="passthrough"), glossary: str = "", key: str = "name") -> DataFrame:
    """(key, outline) of books (key, text): chapters by the model's table of contents, or as given (key, chapter_no, title,
    chapter); each structured, the book summed up from all of them, then each summed up and translated with both
    summaries. A chapter that can't be structured stays as it is."""
    parts = web_chapters(docs, backend, options, key) if chapters is None else chapters
    kind = F.col("section_type") if "section_type" in parts.columns else F.lit("body")
    parts = parts.withColumn("_part", F.concat_ws("\x1f", key, "chapter_no"))
    told = F.format_string(CHAPTER, nn(F.col("title")), F.when(nn(kind) == "", "body").otherwise(kind))
    built = model.called(parts, model.filled(options.book_structuring_prompt, overall_summary=told, chapter_text=F.col("chapter")), backend, replace(options, on_error="source"), "structured", "chapter", ["_part"]).drop("chapter")
    whole = assemble.joined_markdown(built, key, "chapter_no", "structured")
    summed = model.called(whole, model.filled(options.book_summary_prompt, text=F.col("markdown")), backend, options, "book_summary", keys=[key]).select(key, "book_summary")
    one = model.called(built, model.filled(options.chapter_summary_prompt, text=F.col("structured")), backend, options, "summary", keys=["_part"]).join(summed, key)
    prompt = model.filled(options.book_translation_prompt, overall_summary=F.col("book_summary"), chapter_summary=F.col("summary"), glossary_content=F.lit(glossary), chunk_text=F.col("structured"))
    done = model.called(one, prompt, backend, options, "answer", "structured", ["_part"]).withColumn("translated", structure.dedupe_headers(F.col("answer")))
    return assemble.web_book(done, docs.select(key).join(summed, key, "left").withColumnRenamed("book_summary", "summary"), key, "chapter_no")


def simple_book(chapters: DataFrame, backend: model.Backend, options: Options = Options(dialect="web", on_error="passthrough"), glossary: str = "", key: str = "name") -> DataFrame:
    """(key, outline) with whole chapters (key, chapter_no, title, chapter) summed up and translated, headings left out."""
    parts = chapters.withColumn("_part", F.concat_ws("\x1f", key, "chapter_no"))
    one = model.called(parts, model.filled(options.chapter_summary_prompt, text=F.col("chapter")), backend, options, "summary", keys=["_part"])
    prompt = model.filled(options.simple_translation_prompt, chapter_summary=F.col("summary"), chunk_text=F.col("chapter"), glossary_content=F.lit(glossary))
    done = model.called(one, prompt, backend, options, "answer", "chapter", ["_part"]).withColumn("translated", structure.strip_headings(F.col("answer")))
    return assemble.simple_book(done, key, "chapter_no")


def counted(chunked: DataFrame, key: str) -> DataFrame:
    """Progress: chunks per document, blank ones apart."""
    return chunked.groupBy(key).agg(F.count("*").alias("n_chunks"), F.count_if(squeeze(nn(F.col("chunk"))) == "").alias("n_blank"))
