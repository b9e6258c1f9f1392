import json
import os

import pytest
from pyspark.sql import functions as F

from foliospark.operators import assemble, model
from foliospark.options import Options, load_options
from foliospark.plans import pipelines
from foliospark.sources import files
from foliospark.streaming import outlines

FAST = Options(first_delay_s=0.0)


def test_retry_doubles_its_delays_and_gives_up():
    calls, slept = [], []

    def flaky(prompt):
        calls.append(prompt)
        return "" if len(calls) < 3 else "ok"

    assert model.attempt(flaky, "p", Options(), slept.append) == "ok" and slept == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        model.attempt(lambda p: "", "p", Options(), slept.append)
    assert slept == [2.0, 4.0, 2.0, 4.0]


def test_filled_is_one_literal_pass(spark):
    df = spark.createDataFrame([("{b} $1 \\", None)], "a string, b string")
    assert df.select(model.filled("{{x}} {a}|{b}", a=F.col("a"), b=F.col("b")).alias("x")).first().x == "{x} {b} $1 \\|"
    with pytest.raises(KeyError):
        model.filled("{missing}", a=F.lit(""))


def test_error_modes_and_clashing_columns(spark):
    def failing(prompt):
        raise ValueError("down")

    def echo(prompt):
        return f"<{prompt}>"

    df = spark.createDataFrame([(1, "chunk", "old"), (2, None, "old")], "id long, t string, answer string")
    ask = lambda mode: {r.id: r.answer for r in model.called(df, F.col("t"), failing, Options(first_delay_s=0.0, on_error=mode), "answer", "t").collect()}
    assert ask("passthrough")[1] == "chunk\n\n(翻訳エラー)" and ask("marker")[1].startswith("[翻訳処理中にエラーが発生しました: ")
    with pytest.raises(Exception, match="down"):
        ask("fail")
    assert {r.id: r.answer for r in model.called(df.fillna("n"), F.col("t"), echo, FAST, "answer").collect()} == {1: "<chunk>", 2: "<n>"}
    assert model.called(df.limit(0), F.col("t"), echo, FAST, "answer").count() == 0


def test_paper_pipeline(spark):
    answers = {"S": "# 要約\n## 方法", "T": "# Title\n## Abstract\none\n## References\nr\n## Methods\ntwo", "U": "訳"}

    def backend(prompt):
        return answers[prompt[0]] if prompt[0] != "U" else prompt.split("|")[1].replace("one", "一").replace("two", "二")

    options = Options(first_delay_s=0.0, summary_prompt="S{text}", structuring_prompt="T{summary_hint}{raw_text}", translation_prompt="U|{chunk_text}|{summary_content}{glossary_content}")
    docs = spark.createDataFrame([("a", "raw"), ("b", "")], "name string, text string")
    got = {r.name: r for r in pipelines.paper(docs, backend, options).collect()}
    assert got["a"].outline == "- Title\n  - レジュメ (Resume)\n    - 要約\n      - 方法\n  - Abstract\n    - 一\n  - Methods\n    - 二"
    assert "References" in got["a"].structured and set(got) == {"a", "b"}


def test_book_pipelines(spark):
    text = "Opening\nOne\nfirst chapter text\nTwo\nsecond chapter text"

    def backend(prompt):
        if prompt.startswith("TOC"):
            return json.dumps([{"chapter_title": "One", "anchor_text": "One\nfirst"}, {"chapter_title": "Two", "anchor_text": "Two\nsecond"}])
        return prompt

    options = Options(first_delay_s=0.0, toc_prompt="TOC{full_text}", structuring_prompt="{raw_text}", translation_prompt="{chunk_text}")
    docs = spark.createDataFrame([("b", text)], "name string, text string")
    got = pipelines.book(docs, backend, options).first().outline
    assert got.startswith("- b\n  - 全体レジュメ\n    - Opening") and "\n  - One\n    - 章レジュメ\n      - One\n      - first chapter text\n    - One\n" in got
    assert pipelines.chapters_of(docs.limit(0).withColumn("toc", F.lit(None).cast("array<struct<chapter_title:string,anchor_text:string>>")), F.col("toc")).count() == 0
    chapters = spark.createDataFrame([("b", 1, "T", "# h\nbody")], "name string, chapter_no int, title string, chapter string")
    web = Options(dialect="web", on_error="passthrough", first_delay_s=0.0, book_structuring_prompt="{chapter_text}", book_translation_prompt="{chunk_text}", simple_translation_prompt="{chunk_text}")
    assert pipelines.simple_book(chapters, backend, web).first().outline == "- T\n  - Summary\n    - h\n      - body\n  - Full Text (Translation)\n    - body"
    assert pipelines.web_book(docs, chapters, backend, web).first().outline.endswith("- T\n  - Summary\n    # h\n    body\n  - Translation / Body\n    - h\n      - body")


def test_the_whole_web_book(spark):
    text = "Opening\nOne\nfirst chapter text goes here\nTwo\nsecond chapter text goes there"
    asked = []

    def backend(prompt):
        asked.append(prompt)
        kind, rest = prompt.split("|", 1)
        if kind == "TOC":
            return '```json\n{"chapters": [{"title": "One", "start_snippet": "first chapter text goes here", "section_type": "body"}, {"title": "Two", "start_snippet": "second chapter text goes there", "section_type": "notes"}]}\n```'
        if kind == "STRUCTURE" and "Section Type: notes" in rest:
            raise ValueError("down")
        return {"STRUCTURE": "# One\n# again\n" + rest, "BOOK": f"all of {len(rest)}", "CHAPTER": "sum", "TRANSLATE": rest}[kind]

    web = Options(dialect="web", on_error="passthrough", first_delay_s=0.0, web_toc_prompt="TOC|{text}", book_structuring_prompt="STRUCTURE|{overall_summary}|{chapter_text}", book_summary_prompt="BOOK|{text}", chapter_summary_prompt="CHAPTER|{text}", book_translation_prompt="TRANSLATE|{chunk_text}\n({overall_summary}, {chapter_summary})")
    docs = spark.createDataFrame([(7, "same", text), (8, "same", "no chapters")], "id long, name string, text string")
    chapters = {(r.id, r.chapter_no): r for r in pipelines.web_chapters(docs, backend, web, "id").collect()}
    assert {k: (r.title, r.chapter) for k, r in chapters.items()} == {(7, 1): ("One", "One\nfirst chapter text goes here"), (7, 2): ("Two", "Two\nsecond chapter text goes there"), (8, 1): ("Full Text", "no chapters")}
    got = {r.id: r.outline for r in pipelines.web_book(docs, None, backend, web, key="id").collect()}
    assert got[7].startswith("- Book Summary\n  - all of ") or got[7].startswith("- Book Summary\n  all of ")
    assert "- One\n  - Summary\n    sum\n" in got[7] and "Section Type: body" in got[7] and got[7].count("again") == 0
    assert "- Two\n  - Summary\n" in got[7] and "second chapter text goes there" in got[7] and "(all of" in got[7] and "Full Text" in got[8]


def test_parts_say_which_they_are_and_templates_what_they_lack(spark):
    docs = spark.createDataFrame([("a", "x" * 25, "h"), ("b", " ", "h")], "name string, text string, hint string")
    options = Options(first_delay_s=0.0, structuring_chunk=10, structuring_extension=0, structuring_prompt="{context_guide}|{raw_text}")
    got = {r.name: r.structured for r in pipelines.structured_in_parts(docs, ["name"], "text", "hint", lambda p: p, options, F.lit("guide")).collect()}
    assert got == {"a": "guide (Part 1/3)|xxxxxxxxxx\n\nguide (Part 2/3)|xxxxxxxxxx\n\nguide (Part 3/3)|xxxxx", "b": ""}
    unknown = Options(translation_prompt="{chunk_text}{other}")
    assert pipelines.translated(docs, "name", "text", "hint", F.lit(""), model.stub, unknown, refusals=True).first().translated == "[システムエラー: プロンプトの変数が一致しません: 'other']"
    with pytest.raises(KeyError):
        pipelines.translated(docs, "name", "text", "hint", F.lit(""), model.stub, unknown)


def test_documents_of_one_name_and_the_archived_web_paper(spark):
    docs = spark.createDataFrame([(1, "n", "one"), (2, "n", "two")], "id long, name string, text string")
    got = {r.id: r.outline for r in pipelines.paper(docs, model.stub, FAST, key="id").collect()}
    assert set(got) == {1, 2} and "ONE" in got[1] and "ONE" not in got[2]
    web = Options(dialect="web", on_error="passthrough", first_delay_s=0.0, translation_prompt="{chunk_text}")
    old = pipelines.paper(docs.where("id = 1"), model.stub, web, key="id", label=assemble.WEB_SUMMARY, hinted=False).first().outline
    assert old == "- n\n  - 要約 (Summary)\n    - ONE\n  - ONE"


def test_calls_of_a_job_are_bounded_and_only_keys_go_along(spark):
    assert [model.slots(Options(concurrency=n)) for n in (1, 3, 4, 8, 30)] == [(1, 1), (1, 3), (1, 4), (2, 4), (7, 4)]
    df = spark.range(40).selectExpr("id", "repeat('t', 5) as text", "'old' as answer").repartition(8)
    got = model.called(df, F.concat(F.lit("p"), F.col("id")), lambda p: p.upper(), FAST, "answer", "text", ["id"])
    assert {r.id: (r.text, r.answer) for r in got.collect()} == {k: ("ttttt", f"P{k}") for k in range(40)}
    failing = model.called(df, F.col("text"), lambda p: "", Options(first_delay_s=0.0, attempts=1, on_error="source"), "answer", "text", ["id"])
    assert {r.answer for r in failing.collect()} == {"ttttt"}


def test_options(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"MAX_TRANSLATION_CHUNK_SIZE": 40000, "EXCLUDE_SECTION_KEYWORDS": ["x"], "OTHER": 1}))
    assert load_options(str(path)).translation_chunk == 40000 and load_options(str(path)).excluded_sections == ("x",)
    path.write_text("{broken")
    assert load_options(str(path)) == load_options(str(tmp_path / "none.json")) == Options()
    with pytest.raises(ValueError):
        load_options(dialect="other")


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.b.txt").write_bytes("x\r\ny\rz".encode())
    docs = files.read_documents(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in docs.collect()] == [("a.b", "x\ny\nz")]
    files.write_documents(docs, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.b_output.txt").read_text() == "x\ny\nz" and os.listdir(tmp_path / "out") == ["a.b_output.txt"]
    for name in ("same.txt", "same.md"):
        (tmp_path / "in" / name).write_text(name)
    files.write_documents(files.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out2"))
    assert sorted(os.listdir(tmp_path / "out2")) == ["a.b_output.txt", "same.md_output.txt", "same.txt_output.txt"]
    files.write_partitioned(docs, str(tmp_path / "parts"), "name", "text")
    assert spark.read.text(str(tmp_path / "parts")).where("name = 'a.b'").count() == 3


def test_glossary(spark):
    content = 'Term,Translation\n"a, ""b""",訳\nlone\nx,\n c , d ,extra\n"two\nlines",e\n'
    df = spark.createDataFrame([("f", content, 2), ("g", None, 1), ("h", "", None), ("g", "q,r", 1)], "name string, content string, at long")
    assert df.where("name = 'f'").select(files.glossary_text(F.col("content")).alias("t")).first().t == 'Term: Translation\na, "b": 訳\nx: \nc: d\ntwo\nlines: e'
    assert [r.t for r in df.where("name in ('g', 'h')").select(files.glossary_text(F.col("content")).alias("t")).orderBy("t").collect()] == ["", "", "q: r"]
    last = {r.name: r.content for r in files.upserted(df, spark.createDataFrame([("f", "new", 3)], df.schema), "name", "at").collect()}
    assert last == {"f": "new", "g": "q,r", "h": ""}
    assert files.deleted(df, df.where("name = 'g'"), "name").count() == 2
    assert files.compiled(files.latest(df, "name", "at"), "name", "content", "at").first().glossary == content.strip() + "\nq,r\n"


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# A\n## References\nr\n## B\nx")
    for name in ("b", "c"):
        outlines.start(outlines.outlines(outlines.documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        (tmp_path / "in" / f"{name}.txt").write_text("plain")
    got = {r.name: r.outline for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "- A\n  - B\n    - x", "b": "- plain"}


def test_command_line_and_progress(spark, tmp_path):
    from foliospark.__main__ import MODES, main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two")
    (tmp_path / "g.csv").write_text("t,u\n")
    main(["P", f'"{tmp_path}/in"', str(tmp_path / "out"), "--glossary", str(tmp_path / "g.csv")])
    assert sorted(os.listdir(tmp_path / "out")) == ["a_output.txt", "a_structured_eng.md"] and (tmp_path / "out" / "a_output.txt").read_text().startswith("- a\n")
    assert set(MODES.values()) == {"paper", "book"}
    with pytest.raises(SystemExit):
        main(["p", str(tmp_path / "none"), str(tmp_path / "out")])
    store = spark.createDataFrame([("dict_a", 1), ("other", 9), ("dict_b", 5), ("dict_c", None)], "name string, at long")
    assert [r.name for r in files.listed(store, "name", "at", "dict_").collect()] == ["dict_b", "dict_a", "dict_c"]
    df, seen = files.observed(files.pasted(spark, "x y"), "read")
    assert df.collect()[0].name == "Direct Input" and seen.get == {"rows": 1, "characters": 3, "blank": 0}
    assert files.pasted(spark, " ").count() == 0
