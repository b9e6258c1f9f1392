"""Queries without a filter or prefix, against brute force."""

import re
from collections import Counter

import pytest

from foliospark import catalog

TEXT = "The modest mason of Tarika sold seven copper kettles to the widow before the narrow bridge was opened. "


@pytest.fixture
def sf(spark, tmp_path):
    rows = [(1, TEXT * 60, "en"), (2, TEXT, "en"), (3, "Too short.", "de"), (4, "", None), (5, None, "de"), (6, "x\n" * 20, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(text, anchor):
    t, a = (text or "").lower(), anchor.lower().strip()
    if not a or a in t:
        return t.index(a) if a else None
    at = [(distance(a, t[p : p + len(a)]), p) for p in range(len(t)) if t[p : p + 10] == a[:10]] if len(a) > 10 else []
    return min(((d, p) for d, p in at if d <= int(len(a) * 0.3)), default=(0, None))[1]


def test_fuzzy_anchors_of_pages_of_any_length(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in catalog.queries()["fuzzy_anchor"](spark, sf).collect()}
    assert got.keys() == texts.keys() and len(texts[1]) > 4000
    assert {k: r.pos for k, r in got.items()} == {k: brute(texts[k], r.anchor) for k, r in got.items()}
    assert got[1].pos is not None and got[2].pos is not None and [got[k].pos for k in (4, 5)] == [None, None]


def test_a_prompt_holds_the_whole_text(spark, tmp_path):
    rows = [(1, "# A\n\n" + TEXT * 60 + "end"), (2, "short"), (3, None)]
    spark.createDataFrame(rows, "paper_id long, structured_md string").coalesce(1).write.parquet(f"{tmp_path}/paper_pipeline.parquet")
    got = {r.paper_id: r.answer for r in catalog.queries()["model_stub"](spark, str(tmp_path)).collect()}
    assert got == {k: t.replace("\n\n", " ").upper().strip() for k, t in rows if t is not None}


def test_headings_of_every_level_and_language(spark, sf):
    pages = catalog.fixture(spark, sf, "lang").select("md", "lang").collect()
    want = Counter((len(m[1]), r.lang) for r in pages for line in r.md.split("\n") if (m := re.match(r"(#{1,10})\s", line.strip())))
    got = {(r.level, r.lang): r.n for r in catalog.queries()["heading_histogram"](spark, sf).collect()}
    assert got == want and {level for level, _ in got} == {1, 2, 3}
