"""Alignment and pair defects on small invented bilingual texts."""

import random

import numpy as np
import pytest

pytest.importorskip("foliospark.llm")
from foliospark.llm import align, grams, lexicon, pairs  # noqa: E402

NOUNS = {"bridge": "橋", "market": "市場", "harvest": "収穫", "ritual": "儀礼", "archive": "文書館", "museum": "博物館", "river": "河川", "kitchen": "台所"}
NAMES = {"Mayaho": "マヤホ", "Goko": "ゴコ", "Sorato": "ソラト", "Vihoya": "ヴィホヤ", "Rebite": "レビテ"}


def both(r):
    a, b = r.sample(list(NOUNS), 2)
    name, year = r.choice(list(NAMES)), r.randint(1800, 1990)
    ja = r.choice([str(year), "".join("〇一二三四五六七八九"[int(c)] for c in str(year))])
    return r.choice([
        (f"In {year}, the {a} changed the {b} in {name}.", f"{ja}年、{NAMES[name]}では{NOUNS[a]}が{NOUNS[b]}を変えたのである。"),
        (f"{name} argues that the {a} limited the {b}.", f"{NAMES[name]}は、{NOUNS[a]}が{NOUNS[b]}を制限したと論じている。"),
        (f"We counted {year % 500 + 10} cases of {a} near {name}.", f"私たちは{NAMES[name]}の近くで{NOUNS[a]}の事例を{year % 500 + 10}件数えた。"),
        (f"The {a} is not the opposite of the {b}.", f"{NOUNS[a]}は{NOUNS[b]}の反対ではない。"),
    ])


def texts(seed, n=12):
    r = random.Random(seed)
    return [both(r) for _ in range(n)]


def page(sentences):
    return "\n\n".join(" ".join(sentences[i : i + 4]) for i in range(0, len(sentences), 4))


@pytest.fixture(scope="module")
def words():
    return lexicon.fit([(page([a for a, _ in t]), page([b for _, b in t]).replace(" ", "")) for t in map(texts, range(120))])


def test_sentences_are_numbered_as_stated():
    assert lexicon.sentences_en("# T\n\nOne two. Three?\n- Four! five\n\nMr. X") == ["One two.", "Three?", "Four!", "five", "Mr.", "X"]
    assert lexicon.sentences_ja("# 題\n一つ。二つ。\n- 三つ\n\n四。 ") == ["一つ。", "二つ。", "三つ", "四。"]


def test_keys():
    assert lexicon.keys_en("In 1,912 Vihoya saw 97.50") >= {"1912", "vihoya", "97.5"}
    assert lexicon.keys_ja("一九一二年、ヴィホヤは百二十三と97.5、１８") >= {"1912", "vihoya", "123", "97.5", "18"}
    assert lexicon.keys_en("") == set() == lexicon.keys_ja("")


def test_the_plan_keeps_its_masses():
    r = np.random.default_rng(1)
    cost, a, b = r.random((7, 5)), r.random(7) + 0.5, r.random(5) + 0.5
    rows, cols = (x.ravel() for x in np.mgrid[0:7, 0:5])
    p = align.plan(rows, cols, cost.ravel(), a, b).reshape(7, 5)
    full = np.full((8, 6), align.NULL_COST)
    full[:7, :5], full[7, 5] = cost, 0.0
    kernel, u, v = np.exp(-full / align.EPSILON), np.ones(8), np.ones(6)
    for _ in range(align.ROUNDS):  # the dense scaling
        u = np.append(a, b.sum()) / (kernel @ v)
        v = np.append(b, a.sum()) / (kernel.T @ u)
    dense = u[:, None] * kernel * v[None, :]
    assert np.allclose(dense.sum(axis=1)[:7], a, atol=1e-3) and np.allclose(dense.sum(axis=0)[:5], b, atol=1e-3)
    assert np.allclose(p, dense[:7, :5], atol=1e-4) and (p >= 0).all()


def test_held_out_pairs_moved_left_out_and_merged(words):
    right = wrong = wanted = 0
    for seed in range(1000, 1030):
        r, t = random.Random(seed), texts(seed)
        target, truth = [], set()
        for i, (_, b) in enumerate(t):
            if i % 6 == 5:
                continue  # left out
            target.append((i, b))
        r.shuffle(target)
        ja, k = [], 0
        while k < len(target):
            if k + 1 < len(target) and r.random() < 0.15:  # merged
                ja.append(target[k][1][:-1] + "が、" + target[k + 1][1])
                truth |= {(target[k][0], len(ja) - 1), (target[k + 1][0], len(ja) - 1)}
                k += 2
            else:
                ja.append(target[k][1])
                truth.add((target[k][0], len(ja) - 1))
                k += 1
        got = {(i, j) for i, j, _ in align.links([a for a, _ in t], ja, words)}
        right, wrong, wanted = right + len(got & truth), wrong + len(got - truth), wanted + len(truth)
    assert right / wanted >= 0.9 and right / (right + wrong) >= 0.9, (right / wanted, right / (right + wrong))


def test_links_do_not_depend_on_the_block(words, monkeypatch):
    """Long documents with their parts in reverse order keep their links, whatever is compared at once."""
    t = texts(5, 240)
    en, ja = [a for a, _ in t], [b for _, b in t[160:] + t[80:160] + t[:80]]
    whole = {(i, j) for i, j, _ in align.links(en, ja, words)}
    for block in (7, 50):
        monkeypatch.setattr(align, "BLOCK", block)
        assert {(i, j) for i, j, _ in align.links(en, ja, words)} == whole
    right = {(i, (i + 160) % 240 if i < 80 else i if i < 160 else i - 160) for i in range(240)}
    text_of = lambda i, j: (en[i], ja[j])  # noqa: E731  (sentences come more than once: what they say counts)
    assert len({text_of(*x) for x in right} & {text_of(*x) for x in whole}) >= 0.9 * len({text_of(*x) for x in right})
    assert align.links([], ja, words) == [] == align.links(en, [], words)


def test_alignment_of_a_table(spark, words):
    t = texts(3)
    rows = [(1, page([a for a, _ in t]), page([b for _, b in t]), "k"), (2, None, "x。", "k"), (3, "A b.", None, "k"), (4, "", "", "k"), (5, "Only this.", "[error 500]", "k")]
    df = spark.createDataFrame(rows, "paper_id long, en string, ja string, kind string")
    got = align.align(df, "paper_id", "en", "ja", words).collect()
    assert {r.paper_id for r in got} == {1} and sum(r.src_no == r.tgt_no for r in got) >= 8
    assert align.align(df.limit(0), "paper_id", "en", "ja", words).count() == 0


@pytest.fixture(scope="module")
def judge():
    return pairs.Judge([(page([a for a, _ in t]), page([b for _, b in t]).replace(" ", "")) for t in (texts(s, 5) for s in range(300))])


def test_defects(judge):
    t = texts(77, 6)
    en, ja = page([a for a, _ in t]), page([b for _, b in t])
    cases = {
        "empty": [None, "", " \n　", "N/A", "null", "-", "```markdown\n```", "（なし）"],
        "refusal": ["申し訳ありませんが、この文章を翻訳することはできません。", "I'm sorry, but I can't translate this passage.", "## 方法\n\nUnfortunately I must decline to translate this material."],
        "copy": [en, en.lower(), "翻訳：\n" + en, "```markdown\n" + en + "\n```", "> " + en],
        "language": ["Le conseil a décidé que le marché coûterait 22 francs. On annonce que le pont sera fermé dès l'année 1856.", "저자는 시장 연구가 철도 연구와 분리될 수 없다고 주장한다.", "## 背景\n\nDer Gemeinderat hat über die Schule beraten.", "这里的语言改变了人们的生活。作者认为市场与传统之间的关系并不简单。"],
        "truncated": ["".join(b for _, b in t[:2]), ja[: len(ja) - 9], ja[:-9] + "…", ja[:-14] + "、"],
        None: [ja, ja.replace("。\n", "。\n\n"), "".join(b for i, (_, b) in enumerate(t) if i != 2)],
    }
    for wanted, answers in cases.items():
        for a in answers:
            assert judge.defect(en, a) == wanted, (wanted, a)
    assert judge.defect(en + "\n\n- bridge\n- river", ja + "\n\n- 橋\n- 河川") is None
    assert judge.defect(en + "\n\n- bridge\n- river\n- market", ja + "\n\n- 橋") == "truncated"
    assert judge.defect(None, ja) is None and judge.defect("", "") == "empty"


# Sentences that the seeds don't hold.
NOVEL_REFUSALS = [
    "I'm not comfortable rendering this excerpt into Japanese.",
    "I regret that translation of this excerpt is not something I can offer.",
    "Sorry, that goes against my usage rules.",
    "This request can't be processed because it contains disallowed content.",
    "I don't have access to the text you mention, so a translation isn't possible.",
    "Apologies, but this is outside my capabilities.",
    "As a large language model I'm not in a position to reproduce this material.",
    "It looks like you forgot to include the text. Please share it so I can translate it.",
    "回答を差し控えます。",
    "ご質問にはお答えすることができません。",
    "翻訳をお引き受けすることは難しいです。",
    "当方ではこの文書の訳出に対応いたしかねます。",
    "申し訳ないのですが、その依頼は受けられません。",
    "原文が添付されていないようです。再度お送りください。",
    "ガイドラインにより、この内容は処理できません。",
    "私は言語モデルであり、その作業は行えません。",
    "Es ist mir leider nicht möglich, diesen Abschnitt zu übertragen.",
    "Ich kann Ihnen bei dieser Bitte nicht weiterhelfen.",
    "Désolé, il m'est impossible de traduire ce passage.",
    "Je ne suis pas autorisé à reproduire ce contenu.",
    "Lo lamento, pero no me es posible traducir este pasaje.",
    "No estoy en condiciones de ayudar con esto.",
    "对不起，我不能翻译这个内容。",
    "很抱歉，无法完成您的翻译请求。",
    "죄송합니다만 이 요청은 처리할 수 없습니다.",
    "Niestety nie mogę przetłumaczyć tego fragmentu.",
    "К сожалению, я не могу выполнить перевод этого фрагмента.",
]
NOVEL_LANGUAGES = [
    "Rada gminy zdecydowała wczoraj, że szkoła zostanie zamknięta na dwa miesiące. Most zbudowano w 1897 roku.",
    "A községi tanács tegnap úgy döntött, hogy az iskolát két hónapra bezárják. A hidat 1897-ben építették.",
    "Το δημοτικό συμβούλιο αποφάσισε χθες να κλείσει το σχολείο για δύο μήνες. Η γέφυρα χτίστηκε το 1897.",
    "The town council decided yesterday to shut the school for two months, as was reported by several papers of the district.",
    "El ayuntamiento decidió ayer cerrar la escuela durante dos meses. El puente se construyó en 1897 y no se ha reparado nunca.",
    "Le conseil municipal a décidé hier de fermer l'école pendant deux mois. Le pont n'a jamais été réparé.",
    "Der Stadtrat hat gestern beschlossen, die Schule zwei Monate lang zu schließen. Die Brücke ist nicht repariert worden.",
    "市议会昨天决定关闭学校两个月。这座桥建于1897年，从来没有修过。",
    "시의회는 어제 학교를 두 달 동안 닫기로 했다. 이 다리는 1897년에 세워졌다.",
    "Городской совет вчера решил закрыть школу на два месяца. Мост построили в 1897 году и никогда не ремонтировали.",
    "Kommunfullmäktige beslutade i går att stänga skolan i två månader. Bron byggdes 1897.",
    "Belediye meclisi dün okulun iki ay kapatılmasına karar verdi. Köprü 1897'de yapıldı.",
    "Udhëheqësit e fshatit vendosën dje ta mbyllnin shkollën për dy muaj.",
    "Bæjarstjórnin ákvað í gær að loka skólanum í tvo mánuði. Brúin var byggð 1897.",
    "Գյուղի խորհուրդը երեկ որոշեց փակել դպրոցը երկու ամսով։",
    "Het gemeentebestuur besloot gisteren de school twee maanden te sluiten. De brug is nooit hersteld.",
    "A câmara decidiu ontem fechar a escola durante dois meses. A ponte nunca foi reparada.",
    "Il consiglio comunale ha deciso ieri di chiudere la scuola per due mesi. Il ponte non è mai stato riparato.",
    "Hội đồng thành phố hôm qua quyết định đóng cửa trường học trong hai tháng.",
]


def test_refusals_and_languages_that_the_seeds_do_not_hold(judge):
    """Recall and precision of both kinds on held-out sentences are at least 0.9."""
    seeds = set(pairs.LANGUAGES.values()) | {s for c in pairs.DECLINED for s in pairs.declined(c)}
    assert not seeds & {*NOVEL_REFUSALS, *NOVEL_LANGUAGES}
    t = texts(79, 6)
    en = page([a for a, _ in t])
    refused, other = ([judge.defect(en, x) for x in xs] for xs in (NOVEL_REFUSALS, NOVEL_LANGUAGES))
    for kind, got, wrong in (("refusal", refused, other), ("language", other, refused)):
        hits = got.count(kind)
        assert hits >= 0.9 * len(got) and hits >= 0.9 * (hits + wrong.count(kind))


def test_all_of_a_long_prompt_is_read(judge):
    t = texts(80, 6)
    ja = "".join(b for _, b in t)
    assert judge.defect("x. " * 700 + page([a for a, _ in t]), "Rada gminy zdecydowała wczoraj, że szkoła zostanie zamknięta.") == "language"
    assert judge.posterior(ja)["ja"] > 0.99 and judge.posterior("")[""] > 0.01


def test_unfamiliar_text_is_no_evidence():
    b = grams.Bayes({"a": ["red roses", "red tulips"], "b": ["blue skies", "blue seas"]})
    assert b.scores("Ѫѫѭ")[0] == b.scores("Ѫѫѭ")[1] and b.scores("red")[0] > 0 > b.scores("red")[1]
    assert (b.parts(["red", "", "blue sky"]).argmax(axis=1) == [0, 0, 1]).all() and grams.Bayes({"a": [], "b": [""]}).scores("red").tolist() == [0.0, 0.0]


def test_defects_of_a_table(spark, judge):
    t = texts(78, 4)
    en, ja = page([a for a, _ in t]), page([b for _, b in t])
    df = spark.createDataFrame([(1, en, ja, "k"), (2, en, None, "k"), (2, en, None, "k"), (3, en, en, "k"), (4, None, ja, "k")], "call_id long, p string, r string, defect string")
    assert sorted((r.call_id, r.defect or "") for r in pairs.defects(df, "call_id", "p", "r", judge).collect()) == [(1, ""), (2, "empty"), (2, "empty"), (3, "copy"), (4, "")]
    assert pairs.defects(df.limit(0), "call_id", "p", "r", judge).count() == 0
