"""Options of the pipelines, with defaults that a JSON file may override."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

# Title words whose sections are left out, and title words that protect a section.
EXCLUDED_SECTIONS = ("references", "bibliography", "conflict of interest", "funding", "acknowledgements", "keywords", "author contributions", "orcid", "affiliations", "notes on contributors", "index")
PROTECTED_SECTIONS = ("abstract", "notes", "注釈", "抄録")
# Headings of analysis, and of sections without content, that an outline hint leaves out.
ANALYSIS_HEADINGS = ("リサーチ・クエスチョン", "核心的主張", "中心的な主張", "論理展開")
HINT_EXCLUDED = ("References", "Bibliography", "Acknowledgements", "Index", "参考文献", "謝辞")
# Phrases of short answers that decline.
REFUSAL_PHRASES = ("申し訳ありませんが", "翻訳対象となる", "ご提示いただけますでしょうか", "プロンプトの指示", "AIとして", "I cannot translate", "context provided", "target text", "only the heading", "翻訳できません", "提供されたテキスト")

#: How texts are read: "lines" breaks at every line separator, "newline" at \n only.
DIALECTS = ("python", "web")


@dataclass(frozen=True)
class Options:
    """All settings. The chunk sizes without a file are the small ones; a file sets what its pipeline needs."""

    dialect: str = "python"
    translation_chunk: int = 4000
    structuring_chunk: int = 40_000
    structuring_extension: int = 2000
    concurrency: int = 3
    attempts: int = 3
    first_delay_s: float = 2.0
    on_error: str = "fail"
    refusal_limit: int = 500
    introduction_chars: int = 5000
    model: str = ""
    chapter_concurrency: int = 3
    excluded_sections: tuple[str, ...] = EXCLUDED_SECTIONS
    summary_prompt: str = "{text}"
    structuring_prompt: str = "{summary_hint}\n\n{raw_text}"
    translation_prompt: str = "{summary_content}\n\n{chunk_text}\n\n{glossary_content}"
    toc_prompt: str = "{full_text}"
    web_toc_prompt: str = "{text}"
    book_structuring_prompt: str = "{overall_summary}\n\n{chapter_text}"
    book_summary_prompt: str = "{text}"
    chapter_summary_prompt: str = "{text}"
    book_translation_prompt: str = "{overall_summary}\n\n{chapter_summary}\n\n{glossary_content}\n\n{chunk_text}"
    simple_translation_prompt: str = "{chapter_summary}\n\n{glossary_content}\n\n{chunk_text}"

    def __post_init__(self):
        if self.dialect not in DIALECTS or self.on_error not in ("fail", "passthrough", "source", "marker"):
            raise ValueError(f"unknown dialect or error mode: {self.dialect}, {self.on_error}")


# The keys of a settings file and the options they set.
FILE_KEYS = {"MAX_TRANSLATION_CHUNK_SIZE": "translation_chunk", "MAX_STRUCTURING_CHUNK_SIZE": "structuring_chunk", "CONCURRENCY": "concurrency", "EXCLUDE_SECTION_KEYWORDS": "excluded_sections", "SUMMARY_PROMPT": "summary_prompt", "STRUCTURING_WITH_HINT_PROMPT": "structuring_prompt", "TRANSLATION_PROMPT": "translation_prompt", "BOOK_TOC_MAPPING_PROMPT": "toc_prompt", "DEFAULT_MODEL": "model", "BOOK_CHAPTER_CONCURRENCY": "chapter_concurrency", "BOOK_STRUCTURE_PROMPT": "web_toc_prompt", "BOOK_STRUCTURING_PROMPT": "book_structuring_prompt", "BOOK_SUMMARY_PROMPT": "book_summary_prompt", "BOOK_CHAPTER_SUMMARY_PROMPT": "chapter_summary_prompt", "BOOK_TRANSLATION_PROMPT": "book_translation_prompt", "SIMPLE_TRANSLATION_PROMPT": "simple_translation_prompt"}


def load_options(path: str | None = None, **overrides) -> Options:
    """Options from a JSON file; a missing or broken file leaves the defaults."""
    found: dict = {}
    if path:
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
            found = {FILE_KEYS[k]: v for k, v in raw.items() if k in FILE_KEYS} if isinstance(raw, dict) else {}
        except (OSError, ValueError):
            found = {}
    kinds = {f.name: f.default for f in fields(Options)}
    values = {k: tuple(v) if isinstance(kinds[k], tuple) else v for k, v in (found | overrides).items()}
    return replace(Options(), **values)
