import itertools
import random
import re
import unicodedata

import pandas as pd
import pytest

pytest.importorskip("foliospark.llm")
from foliospark.llm import copies, pieces, tokens  # noqa: E402


def brute_key(a, b):
    def plain(s):
        return "".join(c for c in s.upper().lower() if not c.isspace() and unicodedata.category(c)[0] not in "PZ")

    if a is None or b is None or not plain(a) or not plain(b):
        return None
    return tuple(sorted((plain(a), plain(b))))


def brute_copies(rows):
    groups = {}
    for i, a, b in rows:
        if (k := brute_key(a, b)) is not None and i is not None:
            groups.setdefault(k, set()).add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


ROWS = [
    (1, "Old bridge", "古い橋"), (2, "古い橋", "OLD–BRIDGE"), (3, "old bridge 2", "古い橋"), (4, None, "x"), (5, "x", None),
    (6, "...", "橋"), (7, "", ""), (8, "Old bridge", "古い橋"), (8, "Old bridge", "古い橋"), (9, "C+", "c"), (10, "C", "c"),
    (11, "résumé", "履歴"), (12, "resume", "履歴"), (13, "Straße", "道"), (14, "STRASSE", "道"), (15, "a", "b"), (16, "b", "a　"), (17, "x" * 50_000, "長"), (18, "X" * 50_000 + "!", "長"),
]


def test_copies_against_brute_force(spark):
    rows = ROWS + [(100 + k, f"Term {k % 7}", "語" + "。" * (k % 3)) for k in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, term string, translation string, h128 string")
    got = {tuple(r) for r in copies.copies(df, "id", ["term", "translation"]).distinct().collect()}
    assert got == brute_copies(rows)
    n = {r.kept_id: r.n_copies for r in copies.counted(df, "id", ["term", "translation"]).collect()}
    assert n[1] == 3 and n[15] == 2 and n[17] == 2 and not {4, 5, 6, 7} & set(n)


def test_copies_with_a_hot_record_and_of_nothing(spark):
    rows = [(k, "Hot  term" if k % 3 else f"t{k}", "熱い") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, term string, translation string")
    got = {tuple(r) for r in copies.copies(df, "id", ["term", "translation"]).collect()}
    assert got == brute_copies(rows) and len(got) == 1999
    assert copies.copies(df.limit(0), "id", ["term", "translation"]).count() == 0


def test_colliding_hashes_stay_apart_and_are_reported(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = copies.keyed
    monkeypatch.setattr(copies, "keyed", lambda *a: real(*a).withColumn("h128", F.lit(b"same")))
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "B", "A")], "id long, term string, translation string")
    assert {tuple(r) for r in copies.counted(df, "id", ["term", "translation"]).collect()} == {(1, 2, True), (2, 1, True)}
    assert [tuple(r) for r in copies.copies(df, "id", ["term", "translation"]).collect()] == [(1, 3)]


def check_spans(text, limit, overlap):
    out = pieces.spans(text, limit, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for (s, e, _), (s2, _, _) in itertools.pairwise(out):
        assert 0 < e - s <= limit and s2 == e - overlap and s2 > s
    assert out[-1][1] - out[-1][0] <= limit
    assert text[: out[0][1]] + "".join(text[s + overlap : e] for s, e, _ in out[1:]) == text
    return out


@pytest.mark.parametrize("seed", range(30))
def test_spans_are_bounded_and_whole(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "x" * r.randint(1, 90), ". ", "\n", "\n\n", "文。", "é"]) for _ in range(r.randint(0, 400)))
    check_spans(text, r.randint(30, 300), r.randint(0, 14))


def test_spans_take_the_best_boundary():
    text = "a" * 30 + ". " + "b" * 30 + "\n\n" + "c" * 20 + "\n" + "d" * 60
    assert pieces.spans(text, 100, 10)[0][1:] == (64, "paragraph")
    assert pieces.spans("x" * 250, 100, 10) == [(0, 100, "hard"), (90, 190, "hard"), (180, 250, "end")]
    assert pieces.spans("a " * 10, 20, 5) == [(0, 20, "end")] and pieces.spans("", 20, 5) == [(0, 0, "end")]
    words = re.findall(r"\S+\s*", "one two. three four five six")
    assert [("one two. three four five six")[s:e] for s, e, _ in pieces.spans("".join(words), 3, 1, words)] == ["one two. ", "two. three four ", "four five six"]
    with pytest.raises(ValueError):
        pieces.spans("x", 5, 5)


def test_pieces_of_a_table(spark):
    long = "One sentence here. " * 400
    df = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (2, "", "k"), (3, None, "k"), (4, "é" * 5000, "k")], "id long, text string, piece string")
    got = pieces.cut(df, ["id"], "text").toPandas()
    assert got[got.id == 2].piece.tolist() == [""] and not (got.id == 3).any() and got.piece.str.len().max() <= 4000
    one = got[got.id == 1].drop_duplicates().sort_values("piece_no").piece.tolist()
    assert one[0] + "".join(p[200:] for p in one[1:]) == long and all(b[:200] == a[-200:] for a, b in itertools.pairwise(one))
    assert pieces.cut(df.limit(0), ["id"], "text").count() == 0


def test_pieces_of_tokens(spark):
    words = "The quick, brown fox met. Then it ran\n\nand ran and ran."
    df = spark.createDataFrame([(1, words), (2, "x" * 90), (3, None)], "id long, text string")
    got = pieces.cut(df, ["id"], "text", 4, 1, lambda t: re.findall(r"\S+\s*", t)).orderBy("id", "piece_no").collect()
    one = [r.piece for r in got if r.id == 1]
    assert all(len(re.findall(r"\S+", p)) <= 4 for p in one) and one[0] == "The quick, brown fox " and one[1].startswith("fox ")
    assert [r.piece for r in got if r.id == 2] == ["x" * 90] and {r.id for r in got} == {1, 2}


def test_copies_of_repeated_rows(spark):
    rows = [(1, "a b", "c"), (2, "C", "A-b"), (2, "C", "A-b"), (1, "a b", "c")] + [(k, "hot", "x") for k in range(10, 4000)] * 2
    df = spark.createDataFrame(rows, "id long, term string, translation string")
    got = sorted(tuple(r) for r in copies.copies(df, "id", ["term", "translation"]).collect())
    assert got == sorted(brute_copies(rows)) and got[0] == (1, 2)


def test_pieces_of_delivered_copies_come_once(spark, tmp_path):
    long = "One sentence here. " * 400
    rows = [(1, long), (1, long), (2, "é" * 5000), (None, long), (None, long)]
    spark.createDataFrame(rows, "chapter_id long, raw_text string").repartition(3).write.parquet(f"{tmp_path}/chapters.parquet")
    spark.createDataFrame([(1, long)], "paper_id long, structured_md string").write.parquet(f"{tmp_path}/paper_pipeline.parquet")
    got = pieces.p6_pieces(spark, str(tmp_path)).collect()
    n = len(pieces.spans(long))
    assert sum(r.src == "chapters" and r.row_id == 1 for r in got) == n == sum(r.src == "paper_pipeline" for r in got) and sum(r.row_id is None for r in got) == 2 * n


TEXTS = ["", None, "plain words, don't 12½", "日本語 ａｂｃ é́ 👍🏽", "\x1c\x1d a\x85b　c  d\n\n e", " \n \n  \xa0 \x85 a", "<|endoftext|>", "x" * 3000, "a" * 40 + " " * 40]


def plain_bpe(ranks, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_ids_against_plain_merging_and_the_public_library():
    e = tokens.encoder()
    r = random.Random(5)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 18))).encode() for _ in range(400)] + ["日本語".encode(), b"aaaaaaa", b"\xff\x00"]
    assert all(e.word(w) == plain_bpe(e.ranks, w) for w in words)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    for t in filter(None, TEXTS):
        assert e.ids(t) == library.encode(t, add_special_tokens=False).ids and e.decode(e.ids(t)) == t


def test_encode_a_table(spark):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS, "ids": "clash"}), "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id").collect()}
    assert got == {i: tokens.encoder().ids(t) for i, t in enumerate(TEXTS)} and got[0] == got[1] == []
    assert all(r.decoded == (TEXTS[r.doc_id] or "") for r in tokens.decode(tokens.encode(df, "doc_id")).collect())
    assert tokens.encode(df.limit(0), "doc_id").count() == 0
