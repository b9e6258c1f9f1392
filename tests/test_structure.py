"""The column operators against plain folds written from their meaning, on random documents and on edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.sql import register
from foliospark.operators import anchors, assemble, chunks, structure
from foliospark.options import EXCLUDED_SECTIONS, PROTECTED_SECTIONS, REFUSAL_PHRASES

PIECES = ["# A", "## References", "## Notes on x", "### Index terms", "#### Funding", "text", "", "  - item", "\t* x", "1. one", "#tag", "###########eleven", "###### deep", "   ## indented", "##", "## ", "　full width", "+ plus", "---", "> q", "########## ten", "## 抄録 index", "word" * 9]
EDGES = [None, "", "\n", "\n\n", "# ", "#", "no heading", "########## only ten", "## a\r\n## b\rc", "a\x0bb\x0cc\x1cd\x85e f g", "## References\n### kept?\n## Index\n# End", "x" * 5000, "# T\n\nbody", "  # T\nbody", "#　wide\nz"]


def documents(n=150, seed=1):
    r = random.Random(seed)
    return EDGES + ["\n".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(n)]


def run(spark, docs, column):
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t string")
    return [r.x for r in df.select("id", column(F.col("t")).alias("x")).orderBy("id").collect()]


def fold_remove(t, words=EXCLUDED_SECTIONS):
    kept, skip, on = [], 0, False
    for line in (t or "").splitlines():
        m = re.match(r"^(#{1,10})\s+(.*)", line.strip())
        if m:
            title = m[2].lower()
            if any(w in title for w in words) and not any(p in title for p in PROTECTED_SECTIONS):
                on, skip = True, len(m[1])
                continue
            if on and len(m[1]) <= skip:
                on = False
        if not on:
            kept.append(line)
    return "\n".join(kept).strip()


def fold_shift(t):
    t = t or ""
    levels = [len(m[1]) for line in t.splitlines() if (m := re.match(r"^(#{1,10})\s", line))]
    top = min([10, *levels])
    if top == 10 or top == 1:
        return t
    out = []
    for line in t.splitlines():
        m = re.match(r"^(#{1,10})\s", line)
        out.append("#" * (len(m[1]) - top + 1) + " " + line[len(m[1]) :].strip() if m else line)
    return "\n".join(out)


def fold_outline(t):
    out, cur = [], 0
    for line in fold_shift(t).splitlines():
        s = line.strip()
        if not s:
            continue
        if m := re.match(r"^(#{1,10})\s+(.*)", s):
            cur = len(m[1])
            out.append("  " * (cur - 1) + "- " + m[2])
        else:
            lead = len(line) - len(line.lstrip())
            out.append(" " * (2 * cur + lead) + "- " + re.sub(r"^(?:[-*+]|\d+\.)\s+", "", s))
    return "\n".join(out)


def test_lines_and_strip_as_python_has_them(spark):
    docs = documents()
    assert run(spark, docs, lambda c: T.lines(T.nn(c))) == [(d or "").splitlines() for d in docs]
    assert run(spark, docs, lambda c: T.strip(T.nn(c))) == [(d or "").strip() for d in docs]
    assert run(spark, docs, lambda c: T.squeeze(T.nn(c))) == [" ".join((d or "").split()) for d in docs]


def test_remove_sections(spark):
    docs = documents(seed=2)
    assert run(spark, docs, structure.remove_sections) == [fold_remove(d) for d in docs]


def test_shift_and_outline(spark):
    docs = documents(seed=3)
    assert run(spark, docs, structure.shift_headings) == [fold_shift(d) for d in docs]
    assert run(spark, docs, structure.outline) == [fold_outline(d) for d in docs]


def test_outline_hint_keeps_introduction_and_notes(spark):
    resume = "# リサーチ・クエスチョン\n# 核心的主張\n# ## Section：Introduction\n## 中心的な主張\n- x\n# ## Section：References\n# ## Section：Notes\n# ## Section：Abstract\n#tag"
    assert run(spark, [resume, None], structure.outline_hint) == ["# ## Section：Introduction\n# ## Section：Notes\n# ## Section：Abstract\n#tag", ""]


def test_sections_removed_and_resurfacing(spark):
    md = "# T\n## Abstract\na\n## References\n- r\n### Notes inside\nn\n### Index\ni\n### More\nm\n## Notes\nk\n## Appendix\nz"
    got = run(spark, [md], lambda c: structure.remove_sections(c, ["References", "Index", "Appendix"]))[0]
    assert got == fold_remove(md, ["references", "index", "appendix"]) and "### More" in got and "- r" not in got and "## Notes" in got


def test_dedupe_headers(spark):
    docs = documents(seed=4) + ["# a\n" + "x\n" * 40 + "## Introduction to y\n# b\n ## INTRODUCTION\nz"]

    def fold(t):
        out, found = [], False
        for i, line in enumerate((t or "").split("\n")):
            s = line.strip()
            if s.startswith("# "):
                if found:
                    continue
                found = True
            elif s.lower().startswith("## introduction") and i > 30:
                continue
            out.append(line)
        return "\n".join(out)

    assert run(spark, docs, structure.dedupe_headers) == [fold(d) for d in docs]


def test_titles_and_bodies(spark):
    docs = ["# C# x\nbody\n", "  # y\nb", "no", "", None, "# only", "## h\nx"]
    assert run(spark, docs, lambda c: structure.document_title(c, F.lit("stem"))) == ["Cx", "y", "stem", "stem", "stem", "only", "stem"]
    assert run(spark, docs, lambda c: structure.document_title(c, F.lit("stem"), "web"))[:3] == ["C# x", "stem", "stem"]
    assert run(spark, docs, structure.without_title) == ["body", "b", "no", "", "", "", "## h\nx"]
    assert run(spark, docs, lambda c: structure.without_title(c, "web"))[:3] == ["body", "  # y\nb", "no"]


def test_heading_only_and_refusals(spark):
    assert run(spark, ["# a\n  ## b", "", None, " \n", "# a\nb", "#t"], structure.only_headings) == [True, True, True, True, False, True]
    answers = ["申し訳ありませんが、できません。", "good", "x" * 600 + "I cannot translate", None]
    assert run(spark, answers, lambda c: structure.refused_to_empty(c, REFUSAL_PHRASES)) == ["", "good", answers[2], None]
    assert run(spark, ["# a\nb\n#c", None], structure.strip_headings) == ["b", ""]


def fold_split(t, mark):
    out = [[]]
    for i, line in enumerate((t or "").split("\n")):
        if i and line.startswith(mark):
            out.append([])
        out[-1].append(line)
    return ["\n".join(x) for x in out]


def fold_pack(parts, limit, by):
    out, cur, n = [], [], 0
    for p in parts:
        cost = len(p) + len(by)
        if n + cost > limit and cur:
            out.append(cur)
            cur, n = [], 0
        cur.append(p)
        n += cost
    return [by.join(c) for c in [*out, cur] if c]


def fold_hierarchy(t, limit):
    out = fold_split(t, "## ")
    for cut in (lambda c: fold_split(c, "### "), lambda c: fold_split(c, "#### "), lambda c: fold_pack(c.split("\n\n"), limit, "\n\n")):
        out = [y for x in out for y in ([x] if len(x) <= limit else cut(x))]
    return out


def fold_fixed(t, size, more):
    out, start = [], 0
    while start < len(t):
        end = start + size
        if end < len(t) and (k := t.find("\n", end)) != -1 and k - end < more:
            end = k + 1
        out.append(t[start:end])
        start = end
    return out


@pytest.mark.parametrize("limit", [12, 40])
def test_splitters(spark, limit):
    docs = documents(seed=5)
    assert run(spark, docs, lambda c: chunks.at_heading(c, 2)) == [fold_split(d, "## ") for d in docs]
    assert run(spark, docs, lambda c: chunks.by_paragraphs(c, limit)) == [fold_pack((d or "").split("\n\n"), limit, "\n\n") for d in docs]
    assert run(spark, docs, lambda c: chunks.by_hierarchy(c, limit)) == [fold_hierarchy(d, limit) for d in docs]
    assert run(spark, docs, lambda c: chunks.fixed_size(c, limit, 9)) == [fold_fixed(d or "", limit, 9) for d in docs]
    by_length = lambda t: [t] if len(t) <= limit else fold_pack(t.split("\n"), limit, "\n")
    heads = lambda t: re.split(r"\n(?=[^\S\n]*#)", t)
    assert run(spark, docs, lambda c: chunks.at_any_heading(c, limit)) == [[y for x in heads(d or "") for y in by_length(x)] for d in docs]


def test_chapters_at_h1_and_exploding(spark):
    df = spark.createDataFrame([(1, "intro\n# One\nx\n# Two\ny", "k"), (2, "none", "k"), (3, None, "k")], "id long, t string, chunk_no string")
    got = chunks.exploded(df, chunks.chapters_at_h1(F.col("t")), "chunk").select("id", "chunk_no", "chunk.*").orderBy("id", "chunk_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Section 1", "intro"), (1, 1, "One", "# One\nx"), (1, 2, "Two", "# Two\ny"), (2, 0, "Section 1", "none"), (3, 0, "Section 1", "")]
    back = chunks.rejoined(chunks.exploded(df.select("id", "t"), chunks.at_heading(F.col("t"), 1)), ["id"], "chunk_no", "chunk", "\n")
    assert {r.id: r.chunk for r in back.collect()} == {1: "intro\n# One\nx\n# Two\ny", 2: "none", 3: ""}
    assert chunks.exploded(df.limit(0), chunks.at_heading(F.col("t"), 1)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fold_find(text, anchor, ratio=0.3):
    t, a = (text or "").lower(), (anchor or "").lower().strip()
    if not a:
        return None
    if (k := t.find(a)) != -1:
        return k
    if len(a) <= 10:
        return None
    best = None
    k = t.find(a[:10])
    while k != -1:
        d = distance(a, t[k : k + len(a)])
        if d <= int(len(a) * ratio) and (best is None or d < best[0]):
            best = (d, k)
        k = t.find(a[:10], k + 1)
    return best[1] if best else None


def test_fuzzy_find(spark):
    r = random.Random(6)
    rows = [("", "x"), (None, None), ("abc", ""), ("aaaaaaaaaaaaaaab", "aaaaaaaaaaaaab"), ("a.b*c(d)e+f?g then", "a.b*c(d)e+X?g"), ("short", "shart")]
    for _ in range(120):
        t = "".join(r.choice("ab \n") for _ in range(r.randint(20, 200)))
        k = r.randint(0, len(t) - 15)
        a = list(t[k : k + r.randint(5, 25)])
        for _ in range(r.randint(0, 4)):
            a[r.randrange(len(a))] = r.choice("abX ")
        rows.append((t, "".join(a)))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, t string, a string")
    got = [x.p for x in df.select("id", anchors.fuzzy_find(F.col("t"), F.col("a")).alias("p")).orderBy("id").collect()]
    assert got == [fold_find(t, a) for t, a in rows]


def test_chapters_between_keeps_every_entry(spark):
    text = "zero ONE one TWO two THREE three"
    for pos, expected in [
        ([5, 13, 21], [(5, 13, "ONE one"), (13, 21, "TWO two"), (21, 32, "THREE three")]),
        ([None, 13, None], [(0, 13, "zero ONE one"), (13, 32, "TWO two THREE three"), (32, 32, "")]),
        ([13, None, 5], [(13, 5, ""), (5, 5, ""), (5, 32, "ONE one TWO two THREE three")]),
        ([None, None], [(0, 32, text), (32, 32, "")]),
    ]:
        df = spark.createDataFrame([(text, [(f"c{i}", p) for i, p in enumerate(pos)])], "t string, p array<struct<title:string,pos:int>>")
        got = df.select(anchors.chapters_between(F.col("t"), F.col("p")).alias("c")).first().c
        assert [(c.start, c.end, c.text) for c in got] == expected


def test_toc_json(spark):
    good = '[{"chapter_title":"Introduction","anchor_text":"This book"},{"chapter_title":"Index","anchor_text":"A"},7,{"chapter_title":"x"},{"chapter_title":"Chapter 1","anchor_text":" In 1900 "}]'
    for response in (good, f"```json\n{good}\n```", f"```\n{good}```", f"```json\n{good}"):
        got = spark.createDataFrame([(response,)], "r string").select(anchors.parse_toc(F.col("r")).alias("c")).first().c
        assert [tuple(x) for x in got] == [("Introduction", "This book"), ("Chapter 1", "In 1900")]
    for bad in ("{}", "nonsense", "[]", None, '[{"chapter_title":"Index","anchor_text":"x"}]'):
        assert spark.createDataFrame([(bad,)], "r string").select(anchors.parse_toc(F.col("r")).alias("c")).first().c is None


def test_web_anchors(spark):
    text = "Contents\nOne\nTwo\n\nOne\nfirst words of the  chapter one go on\nTwo\nother words are here"
    toc = [("One", "first words of the chapter"), ("Missing", ""), ("Two", "nothing like it at all there"), ("Gone (x", "")]
    df = spark.createDataFrame([(text, toc), ("plain", []), (None, [("a", "")])], "t string, c array<struct<title:string,start_snippet:string>>")
    got = df.select(anchors.chapters_forward(F.col("t"), F.col("c")).alias("c")).collect()
    assert [(c.id, c.title, c.text[:9]) for c in got[0].c] == [(1, "One", "One"), (2, "Two", "Two\n\nOne\n")]
    assert [(c.title, c.text) for c in got[1].c] == [("Full Text", "plain")] and [(c.title, c.text) for c in got[2].c] == [("Full Text", "")]
    found = df.select(anchors.anchor_position(F.col("t"), F.lit("nope"), F.lit("FIRST words of the chapter"))["strategy"].alias("s")).first().s
    assert found == "snippet"


def test_chapter_node(spark):
    df = spark.createDataFrame([("Chapter 1", "- a\n- b", "# T\n- x\n- y")], "t string, s string, b string")
    got = df.select(assemble.chapter(F.col("t"), F.col("s"), F.col("b")).alias("x")).first().x
    assert got == "  - Chapter 1\n    - 章レジュメ\n      - a\n      - b\n    - x\n    - y"


def test_paper_and_books(spark):
    df = spark.createDataFrame([("stem", "# S\ns", "# Title\n## H\nx", "# 題\n## 見\n本文"), ("stem", None, "x", None)], "n string, s string, e string, b string")
    paper = assemble.paper(F.col("n"), F.col("s"), F.col("e"), F.col("b"))
    assert [r.x for r in df.select(paper.alias("x")).collect()] == ["- Title\n  - レジュメ (Resume)\n    - S\n      - s\n  - 見\n    - 本文", "- stem\n  - レジュメ (Resume)\n\n"]
    chapters = spark.createDataFrame([(1, 1, "B", None, "t"), (1, 0, "A", "- s\n\n", None)], "k long, no int, title string, summary string, translated string")
    books = spark.createDataFrame([(1, "book", "- all"), (2, "bare", "")], "k long, name string, summary string")
    web = {r.k: r.outline for r in assemble.web_book(chapters, books, "k", "no").collect()}
    assert web[1] == "- Book Summary\n  - all\n- A\n  - Summary\n    - s\n  - Translation / Body\n    - (翻訳なし)\n- B\n  - Summary\n    (要約なし)\n  - Translation / Body\n    - t"
    assert assemble.book(chapters, books, "k", "no", F.col("title")).where("k = 1").first().outline == "- book\n  - 全体レジュメ\n    - all\nA\nB"
    assert assemble.joined_markdown(chapters.fillna("z"), "k", "no", "translated").first().markdown == "z\n\n---\n\nt"


def test_sql_functions(spark):
    assert "heading_level" in register(spark)
    assert spark.sql("select heading_level('  ## x') a, squeeze(' a \n b ') b, size(split_at_heading('x\n## y', 2)) c").first()[:] == (2, "a b", 2)
