"""Models are fitted on all texts, of any length, the same as on one list of them."""

import random

import pytest

pytest.importorskip("foliospark.llm")
from foliospark.llm import align, grams, lexicon, pairs, residue  # noqa: E402

NOUNS = {"bridge": "橋", "market": "市場", "harvest": "収穫", "ritual": "儀礼", "archive": "文書館", "museum": "博物館", "river": "河川", "kitchen": "台所"}
LONG = {"lighthouse": "灯台", "railway": "鉄道", "teacher": "教師", "forest": "森林"}


def pair(nouns, seed, n):
    """A text of n sentences with years, and its translation."""
    r, en, ja = random.Random(seed), [], []
    for _ in range(n):
        (a, x), (b, y), year = *r.sample(sorted(nouns.items()), 2), r.randint(1100, 1990)
        en.append(f"In {year}, the {a} changed the {b}.")
        ja.append(f"{year}年、{x}が{y}を変えたのである。")
    return "\n\n".join(en), "\n\n".join(ja)


@pytest.fixture(scope="module")
def texts():
    """Many short pairs and one of over 60,000 characters, which alone has some words."""
    long = pair(LONG, 1, 2000)
    assert len(long[0]) > 60_000
    return [pair(NOUNS, k, 6) for k in range(100, 800)] + [long]


def table(spark, texts):
    return spark.createDataFrame([(k, *t) for k, t in enumerate([*texts, (None, "x。"), ("A b.", None), ("", "")])], "paper_id long, en string, ja string")


def test_the_lexicon_is_that_of_all_texts(spark, texts):
    got, wanted = lexicon.fit_all(table(spark, texts).repartition(5), "en", "ja"), lexicon.fit(texts)
    assert got.pieces == wanted.pieces and (got.weights == wanted.weights).all() and got.words.keys() == wanted.words.keys() >= {"lighthouse", "forest", "bridge"}
    assert all((x == y).all() for w in got.words for x, y in zip(got.words[w], wanted.words[w]))
    empty = lexicon.fit_all(table(spark, []), "en", "ja")
    assert not empty.words and not empty.pieces and not lexicon.fit([]).words


def test_words_of_long_texts_alone_link_sentences(spark, texts):
    """Sentences without numbers and names, by words that only one text of over 60,000 characters teaches."""
    last = ("The lighthouse changed the teacher.\nThe railway changed the forest.", "鉄道が森林を変えた。\n灯台が教師を変えた。")
    df = table(spark, [*texts, last])
    got = {(r.src_no, r.tgt_no) for r in align.align(df, "paper_id", "en", "ja").where(f"paper_id = {len(texts)}").collect()}
    assert got == {(0, 1), (1, 0)}


def test_the_judge_is_that_of_all_calls(spark, texts):
    """Of long calls too: sentences, ends and the language of most answers."""
    calls = [*texts, *(("A prompt of the village archive.", f"Les gens du village se souviennent du marché et de la rivière {k}.") for k in range(5))]
    got, wanted = pairs.judge_all(table(spark, calls).repartition(5), "en", "ja"), pairs.Judge([*calls, (None, "x。"), ("A b.", None), ("", "")])
    assert got.wanted == wanted.wanted == "ja" and got.ends.whole == wanted.ends.whole and got.ends.cut == wanted.ends.cut and got.ends.n == wanted.ends.n
    for c in pairs.DECLINED:
        a, b = got.kinds[c].bayes, wanted.kinds[c].bayes
        assert got.kinds[c].sure == wanted.kinds[c].sure and (a.grams == b.grams).all() and (a.ratio == b.ratio).all()
    known = set(got.kinds["en"].bayes.grams.tolist())
    assert set(grams.counted(["lighthouse"])[0].tolist()) - set(grams.counted(["l", "e"])[0].tolist()) & known
    assert got.words.words.keys() == wanted.words.words.keys() >= {"lighthouse", "bridge"}
    assert pairs.defects(table(spark, []).limit(0), "paper_id", "en", "ja").count() == 0


def test_the_models_of_residue_are_those_of_all_pages(spark):
    """Residue that long pages alone teach is found in others."""
    r = random.Random(4)
    prose = [" ".join(r.choice("the mill of this town was sold by its owner on Monday for seven shillings".split()) for _ in range(60)) for _ in range(3100)]
    unseen = "Please enable JavaScript to view this page. Qwyx vbrk zzorp ghlim wexu bnarl otyp dresk."
    pages = [*prose, *(" ".join(prose[k : k + 80]) + "\n" + unseen for k in range(3)), None, ""]
    assert max(len(t or "") for t in pages) > residue.LONGEST
    df = spark.createDataFrame([(k, t) for k, t in enumerate(pages)], "doc_id long, text string").repartition(5)
    got, wanted = residue.fit_all(df, "text"), residue.fit(pages)
    assert (got == wanted).all()
    seen = residue.slots(residue.folded(prose[0])), residue.slots(residue.folded("vbrk zzorp ghlim"))
    assert got[-1][seen[0]].mean() < -1 and (got[:, seen[1]] != 0).any()
    assert residue.residue(df.limit(0), "doc_id").count() == 0
