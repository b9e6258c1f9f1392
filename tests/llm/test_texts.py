"""Forms, scans, residue and leaks: small texts with known results, brute force where there is one, and edge cases."""

import os
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

pytest.importorskip("foliospark.llm")
from pyspark.sql import functions as F  # noqa: E402

from foliospark.llm import corpus, forms, leaks, residue, scans  # noqa: E402

WORDS = {"Chapter": 90, "explorer": 40, "the": 500, "Monument": 20, "copy": 30, "café": 12, "cafe": 2, "XXI": 5}
SAME = [
    ("Ｃｈａｐｔｅｒ ２", "Chapter 2"), ("Сhарter", "Chapter"), ("eхplоrеr", "explorer"), ("Μοnumеnt", "Monument"), ("café", "café"), ("the​ ﻿copy", "the copy"),
    ("ﾊﾞｷﾏ　は", "バキマ は"), ("が", "が"), ("oﬃce", "office"), ("сору", "copy"), ("ХХI", "XXI"), ("zоrk", "zork"), ("λόγος и слово", "λόγος и слово"), ("「引用」、。", "「引用」、。"), ("chee¬\nred", "chee¬\nred"), ("soft­\nend", "soft­\nend"), ("so­ft", "soft"), ("", ""), (None, None), ("plain", "plain"),
]


def test_consistent_forms():
    trie = forms.Trie(WORDS)
    for given, wanted in SAME:
        assert forms.consistent(given, trie) == wanted
        assert forms.consistent(wanted, trie) == wanted  # the form is stable
        assert bool(given and re.search(forms.SUSPECT, given)) or given == wanted


def test_the_automaton_allows_edits_within_its_budget():
    trie = forms.Trie(WORDS)
    walk = lambda token, budget: trie._walk(forms.letters_of(token), budget)
    assert walk("explоrer", 0.0) == ("explorer", 40) and walk("explоrr", 0.5) is None and walk("саfe", 0.0) == ("cafe", 2)
    assert walk("explоrr", 1.0) == ("explorer", 40) and trie.spelling("explоrr") is None  # looks different, and no common word
    common = forms.Trie(WORDS | {"explorer": 400})
    assert common.spelling("explоrr") == ("explorer", 400) and common.spelling("Еxplоrr") is None


def test_the_automaton_walks_what_is_written():
    trie = forms.Trie(WORDS | {"office": 9, "Mayaho": 7, "Mayahi": 900, "wonderful": 50})
    for token, wanted in (("ｅｘｐｌｏｒｅｒ", "explorer"), ("o\ufb03ce", "office"), ("cafe\u0301", "café"), ("ex\u200bpl\u00adorer", "explorer"), ("Mаyaho", "Mayaho"), ("wonderfuʟ", "wonderful"), ("wоnderfսl", "wonderful"), ("wondeɼful", "wonderful")):
        assert trie.spelling(token)[0] == wanted and forms.consistent(token, trie) == wanted, token
    assert forms.consistent("Mаyahe", trie) == "Mayahe"  # a name that isn't known stays as it looks
    assert trie.spelling("слово") is None


def test_forms_of_a_table(spark):
    rows = [(i, a, "x") for i, (a, _) in enumerate(SAME)]
    df = spark.createDataFrame(rows, "id long, value string, before string")
    got = {r.id: r.value for r in forms.unified(df, ["value"], WORDS).collect()}
    assert got == {i: b for i, (_, b) in enumerate(SAME)}
    assert forms.unified(df.limit(0), ["value"]).count() == 0
    assert forms.vocabulary(spark.createDataFrame([("the the cat", "the"), (None, "сat")], "a string, b string"), ["a", "b"]) == {"the": 3}


def test_common_words_are_bounded_and_whole(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(50)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    exact = Counter(w for t in texts for w in t.split())
    count = lambda t, c: c.update(t.split())
    assert corpus.common_words(df, ["t"], count, str, 1000) == {w: n for w, n in exact.items() if n > 1}
    few = corpus.common_words(df, ["t"], count, str, 12)
    assert few.left_out == max(n for w, n in exact.items() if w not in few) and corpus.common_words(df, ["t"], count, str, 1000).left_out == 1
    assert 0 < len(few) <= 12 and all(exact[w] == n for w, n in few.items()) and min(few.values()) >= max(n for w, n in exact.items() if w not in few)
    assert corpus.common_words(df.limit(0), ["t"], count, str, 12) == {}


def test_samples_are_bounded(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("text "), "id").alias("t"))
    got = corpus.sample(df, "id", {"t": 9}, 100)
    assert got.num_rows == 100 and max(map(len, got.column("t").to_pylist())) == 9 and corpus.sample(df.limit(3), "id", {"t": 9}, 100).num_rows == 3
    assert set(corpus.sample(df, "id", {"t": 6}, 5000).column("t").to_pylist()) == {f"text {k}" for k in range(10)}


BODY = "The expedition was surrounded by the carpenter and the old-fashioned library . Every committee needs a newly-built station . The carpenter of the library was completed in 1895 . "


@pytest.fixture(scope="module")
def language():
    counts = Counter()
    scans.count_words(BODY.replace("\n", " ") * 60, counts)
    return scans.Language({p: n for w, n in counts.items() if (p := scans.plain(w))})


SCAN = """The Old Library

The expeditiori was surrounded by thc car-
penter and the old-
fashioned library. Every com¬

— 245 —
THE OLD LIBRARY
mittee needs a newly-built station. The carpenter
of the lib-
Review of Library Studies 13 (4)  l79
rary was completed in l895.

    Every committee needs a station - a stati0n
needs Mr. Rabaya and ccxcvii sheep.
"""


def test_defects_of_a_scan(language):
    found, paragraphs = scans.repaired(SCAN, [], language)
    assert found == [
        (2, "misread", "expedition"), (2, "misread", "the"), (3, "hyphen", "carpenter"), (4, "hyphen", "old-fashioned"), (6, "page_no", ""), (7, "header", ""), (5, "hyphen", "committee"),
        (10, "header", ""), (9, "hyphen", "library"), (11, "misread", "1895"), (13, "misread", "station"),
    ] or sorted(found) == sorted([(2, "misread", "expedition"), (2, "misread", "the"), (2, "hyphen", "carpenter"), (3, "hyphen", "old-fashioned"), (4, "hyphen", "committee"), (6, "page_no", ""), (7, "header", ""), (9, "hyphen", "library"), (10, "header", ""), (11, "misread", "1895"), (13, "misread", "station")])
    assert paragraphs == [
        "The Old Library",
        "The expedition was surrounded by the carpenter and the old-fashioned library. Every committee needs a newly-built station. The carpenter of the library was completed in 1895.",
        "Every committee needs a station - a station needs Mr. Rabaya and ccxcvii sheep.",
    ]


def test_nothing_to_repair(language):
    assert scans.repaired("", [], language) == ([], [""])
    clean = "Every committee needs a station.\nThe library was completed."
    assert scans.repaired(clean, [], language) == ([], [clean.replace("\n", " ")])
    long = "thecarpenterofthelibrary" * 3000
    assert scans.repaired(long, [], language)[1] == [" ".join(["the carpenter of the library"] * 3000)]
    assert language.cut("thecarpenterofthelibrary")[1] == ["the", "carpenter", "of", "the", "library"]
    assert language.segmented("The car penter ofthe lib rary, and Mr. Rabaya zzz.".split()) == "The carpenter of the library, and Mr. Rabaya zzz.".split()
    assert scans.repaired("日本語の行。\n次の行。", [], language)[1] == ["日本語の行。次の行。"]


def test_one_decoding_of_the_stream(language):
    """Defects and paragraphs come from one path: misread words that fell apart or together, across lines and hyphens."""
    text = "Every committee needs the expc\ndition of thc carpenter and the car-\npen ter ofthclibrary was completed."
    found, paragraphs = scans.repaired(text, [], language)
    assert sorted(found) == sorted([(0, "misread", "expedition"), (1, "misread", "the"), (1, "hyphen", "carpenter"), (2, "misread", "the")])
    assert paragraphs == ["Every committee needs the expedition of the carpenter and the carpenter of the library was completed."]


def test_confusions_of_the_corpus_are_learned():
    r = random.Random(2)
    words = {"".join(r.choice("aeioultzkdg") for _ in range(9)): 4000 for _ in range(60)}
    read = {w.replace("z", "7", 1): 2 for w in words if "z" in w} | {w.replace("k", "lc", 1): 2 for w in words if "k" in w}
    assert scans.learned(words | read) == {("z", "7"), ("k", "lc")} and scans.learned({}) == set() == scans.learned(words)
    w = next(w for w in words if "z" in w)
    assert scans.Language(words | read).decode(w.replace("z", "7", 1)) == w


def test_words_broken_without_a_hyphen(language):
    found, paragraphs = scans.repaired("Every committee needs the expe\ndition of the carpenter and the lib\n\nrary was\ncompleted in the library.", [], language)
    assert found == [(0, "hyphen", "expedition"), (1, "hyphen", "library")]
    assert paragraphs[0].startswith("Every committee needs the expedition of the carpenter and the library was completed")


def test_words_left_out_of_the_counts_are_not_taken_for_misread_ones():
    words = corpus.Words({"carpenter": 150, "the": 9000})
    assert scans.Language(words).decode("carpcnter") == "carpenter"
    words.left_out = 30
    assert scans.Language(words).decode("carpcnter") is None


def test_confusions_keep_the_sum():
    for printed, read in scans.CONFUSIONS:
        assert scans.confusion_sum(printed) == scans.confusion_sum(read)
    assert scans.confusion_sum("library") != scans.confusion_sum("carpenter")


def test_defects_of_a_table_come_from_the_path(spark):
    text = "The carpenter of the libraiy and the car-\npen ter ofthclibrary was completed."
    df = spark.createDataFrame([("chapters", 1, None, text)], "src string, row_id long, title string, text string")
    counts = Counter()
    scans.count_words(BODY * 60, counts)
    vocab = {p: n for w, n in counts.items() if (p := scans.plain(w))}
    got = {(r.line_no, r.defect, r.word) for r in scans.repair(df, "defects", vocab).collect()}
    assert got >= {(0, "hyphen", "carpenter"), (1, "misread", "the")}


def test_scans_of_a_table(spark):
    rows = [("chapters", 1, "The Old Library", SCAN + BODY * 60, "k"), ("chapters", 1, "The Old Library", SCAN + BODY * 60, "k"), ("chapters", 2, None, None, "k"), ("chapters", 3, None, "", "k")]
    df = spark.createDataFrame(rows, "src string, row_id long, title string, text string, word string")
    got = scans.repair(df, "defects").distinct().collect()
    assert {(r.line_no, r.defect, r.word) for r in got} >= {(2, "hyphen", "carpenter"), (3, "hyphen", "old-fashioned"), (6, "page_no", ""), (2, "misread", "expedition")} and {r.row_id for r in got} == {1}
    assert scans.repair(df.where("row_id = 3"), "paragraphs").collect()[0].paragraph == ""
    assert scans.repair(df.limit(0), "defects").count() == 0


PROSE = ["The %s of the %s was opened by %s on Monday, and the price of corn rose to %d shillings." % (a, b, c, n) for n, (a, b, c) in enumerate((a, b, c) for a in ("mill", "bridge", "church", "tannery") for b in ("town", "parish", "county") for c in ("Mr. Rabaya", "Captain Tomu", "Miss Dosako"))]
RESIDUE = ["Lorem ipsum dolor sit amet. Aliqua velit nostrud in labore et dolore.", "HTTP Error 404 - Not Found. Please go\nback and try again, or contact the administrator.", "Please enable JavaScript in your browser to use this viewer.", "xxxx blah text text words blah Text xxxx words", "Veuillez activer JavaScript pour\nafficher cette page."]
CLEAN = ['The clerk answered "page not found" when the magistrate asked for the old register.', "The printer's boy set lorem ipsum upon the trial sheet, said the foreman.", "The form asks for [name illegible] and the town.", "Shares closed 3% up at Rehomi and 5% down elsewhere.", "The actor followed the script {so the prompter swore} to the last word.", "Messrs. <late of Tokabe> beg to announce a sale.", "", None, "  \n "]
UNFILLED = ["Boys {{ town | upper }} seen", "%first_name% spoke", "[INSERT ISSUE\nDATE HERE]", "${byline} began", "<%= date %>", "@@CAPTION@@ x", "a __PRICE__ b", "[[section]]", "{% block body %}", "#street#", "<<headline>>", "<SECTION> of", "{editor} wrote", "[Your town]"]


def test_residue():
    rows = PROSE * 30 + CLEAN[:6] * 20
    table = residue.fit([r for r in rows if r])
    assert [residue.judge(t, table)[0] for t in RESIDUE] == ["filler", "error", "scripts", "filler", "scripts"]
    assert [residue.judge(t, table)[0] for t in CLEAN + PROSE] == [None] * (len(CLEAN) + len(PROSE))
    assert all(residue.judge(t, table)[0] == "placeholder" for t in UNFILLED)
    inside = " ".join(PROSE[:9]) + "\n" + RESIDUE[1] + "\n" + " ".join(PROSE[9:20])
    kind, cover, spans = residue.judge(inside, table)
    assert kind == "error" and inside[spans[0][0] : spans[-1][1]].strip().startswith("HTTP") and cover < 120


# Residue that the seeds don't hold, and prose of other times, matters and languages than the sample's.
NOVEL_RESIDUE = [
    "Sorry, the page you are trying to reach does not exist on this server. Please go back to the home page.",
    "We are having trouble loading this article. Please refresh the page and try again.",
    "This website needs JavaScript to be turned on in your browser. Please enable scripts and reload.",
    "Your login session has timed out. Please log in again to view this document.",
    "The requested URL /scan/123 was not found on this server. Error 404.",
    "Internal server error: the request could not be completed. Contact the administrator.",
    "Warning: could not connect to the database server. Please try again later.",
    "Lorem ipsum dolor sit amet, sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat.",
    "Dummy text dummy text, to be replaced by the author before printing.",
    "[Caption to come] Article text will be added here later.",
    "asdf asdf qwerty asdf test test foo bar test qwerty asdf",
    "Cookies and JavaScript must be enabled to display this content in your browser.",
    "An unexpected error has occurred while processing the request. Error code: 99ab12cd.",
    "Access to this image is restricted. Please sign in with a subscriber account.",
    "Die angeforderte Seite wurde nicht gefunden. Bitte kehren Sie zur Startseite zurück.",
    "Cette page est introuvable. Veuillez retourner à l'accueil.",
    'Traceback (most recent call last): File "load.py", line 31, in open; ValueError: bad page',
    "The service is down for maintenance and will be back in 20 minutes.",
    "Your browser has scripts disabled, so the viewer cannot be shown. Turn them on and refresh.",
    "Hier steht demnächst der richtige Artikel. Dies ist nur ein Platzhalter.",
]
MODERN_PROSE = [
    "The committee reviewed the budget for the museum and agreed that visitor numbers had risen sharply since the new wing opened last spring. Staff asked for more funding to extend opening hours.",
    "Researchers measured soil moisture at forty sites across the valley and found that irrigation changed the timing of the harvest by almost two weeks.",
    "El consejo municipal aprobó ayer el presupuesto para la reparación del puente, que llevaba cerrado desde el invierno pasado por razones de seguridad.",
    "昨日、市議会は橋の修理のための予算を承認した。橋は昨年の冬から安全上の理由で閉鎖されていた。住民は長い間この決定を待っていた。",
    "She opened the laptop, checked the train times and wrote a short message to her brother before leaving the office in the rain.",
    "The orchestra will perform two symphonies on Friday, followed by a discussion with the conductor about the history of the hall.",
    "Der Verein lädt am Samstag zu einem Konzert ein; die Einnahmen kommen der Renovierung der Schule zugute, wie der Vorsitzende mitteilte.",
    "Photosynthesis converts light energy into chemical energy, storing it in the bonds of sugars that the plant later uses for growth.",
    "Quarterly revenue rose four percent on strong demand for software, though the company warned that higher wages would weigh on margins.",
    "Les chercheurs ont montré que la température de la mer influence la migration des oiseaux le long de la côte atlantique.",
    "My grandmother kept her recipes in a tin box, and every Sunday we argued about how much salt the bread really needed.",
    "The patient was discharged after three days with instructions to rest, drink plenty of water and return for a checkup.",
    "Городской совет утвердил бюджет на ремонт моста, который был закрыт с прошлой зимы по соображениям безопасности.",
    "Football fans gathered in the square long before kickoff, singing songs and waving scarves while police watched from the corners.",
    "Install the bracket with four screws, then hang the shelf and check with a level that it sits straight along the wall.",
    "The senator argued that the bill would place an unfair burden on small farms and called for a vote to be delayed until autumn.",
    "Het bestuur besloot gisteren dat de brug in het voorjaar wordt hersteld, omdat het verkeer sinds de winter moet omrijden.",
    "In chess, control of the center gives the pieces more room to move and often decides the game before the endgame begins.",
    "The novel follows three sisters who inherit a lighthouse and slowly learn why their father never spoke about the war.",
    "Add the onions to the pan, stir until golden, then pour in the stock and let the soup simmer for half an hour.",
    "The librarian explained that the old catalog could not be searched online, so readers must ask at the desk for each volume.",
    "The clerk said that the page was missing from the register and that nobody knew who had removed it.",
    "He typed the sample sentence again and handed the paper to the editor, who shook his head.",
    "The database of the census lists every family that came to the town before the railway was built.",
]


def test_residue_that_the_seeds_do_not_hold():
    """Recall of unseen residue and precision against unseen prose are at least 0.9: what is unfamiliar isn't residue."""
    pages = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(pages):
        pytest.skip("no test tables")
    table = residue.fit([t for t in pq.read_table(pages, columns=["text"]).column("text").to_pylist() if t and len(t) <= residue.LONGEST])
    hits = sum(residue.judge(t, table)[0] is not None for t in NOVEL_RESIDUE)
    wrong = [t for t in MODERN_PROSE if residue.judge(t, table)[0]]
    assert hits >= 0.9 * len(NOVEL_RESIDUE) and len(wrong) <= 0.1 * hits, (hits, wrong)
    every = " ".join(residue.seeds().values())
    assert not any(t in every for t in NOVEL_RESIDUE)


def test_brackets_are_placeholders_by_what_they_hold():
    for t in ("Boys {first_name} seen", "the {town} fair", "[INSERT HEADLINE HERE]", "[TODO: caption]", "%LAST_NAME%", "<ISSUE_DATE> of", "#photo_url# by"):
        assert residue.placeholder(t), t
    for t in ("he said {so they swore} it", "[Laughter and applause] he went", "[Inserted by request.] A notice", "rose 3% and fell 4% later", "No. #4 and #5 sold", "[Your humble servant, A. B.]"):
        assert not residue.placeholder(t), t


def test_residue_of_a_table(spark):
    texts = PROSE * 6 + RESIDUE + CLEAN + RESIDUE[:1]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r.doc_id for r in residue.residue(df, "doc_id").where("kind is not null").collect()}
    n = len(PROSE) * 6
    assert got == {*range(n, n + len(RESIDUE)), len(texts) - 1}
    assert residue.residue(df.limit(0), "doc_id", table=residue.fit(PROSE)).count() == 0


ITEM = "Read the notice and answer the question below. The modest mason of Tarika sold seven copper kettles to the widow before the narrow bridge was opened by Captain Moro in 1893. What was the sum given?"
OTHERS = [(k, f"Read the notice and answer the question below. {s} What was the sum given?") for k, s in enumerate(("Unlike the fire the public lamp belongs to nobody in the parish of Narino and never did before the war.", "Three times Miss Kimofa wrote to the umbrella maker and thirty six days passed before any answer came back.", "Too short."), 2)]
LEAK = "The modest mason of Tarika sold seven copper kettles to the widow before the narrow bridge"


def brute_words(text, item):
    """The most words in a row of the item that stand in the text in order, both in lower case without signs."""
    norm = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    words, whole, best = item.split(), norm(text), 0
    for i in range(len(words)):
        for j in range(i + best + 1, len(words) + 1):
            if norm(" ".join(words[i:j])) in whole:
                best = j - i
            else:
                break
    return best


def test_leaks():
    items = leaks.items_of([(1, ITEM), *OTHERS, (9, None), (10, "")])
    assert [i.key for i in items] == [1, 2, 3]
    seeds = leaks.automaton(items)
    lines = ["Rain fell for nine hours. The modest mason", "of Tarika sold seven cop-", "WANTED, a cook. Apply to Mrs. Dobe.", "per kettles to tbe wid0w before", "Seen from Kona the mill was small.", "the narrow bridge and so on."]
    text = "\n".join(lines)
    found = leaks.leaks(text, items, seeds)
    assert [(k, n) for k, n, _, _ in found] == [(1, 16)] and text[found[0][2] :].startswith("The modest") and text[: found[0][3]].rstrip().endswith("bridge")
    for k in range(9, 17):
        part = " ".join(LEAK.split()[:k])
        got = leaks.leaks(f"Some words {part} quite another end", items, seeds)
        assert bool(got) == (k >= 12) and (not got or got[0][1] == brute_words(part, ITEM) == k)
    assert leaks.leaks("Read the notice and answer the question below. What was the sum given?", items, seeds) == [] == leaks.leaks("", items, seeds)


def test_shared_text_inside_an_item_counts():
    """Only the instruction and the question are left out; an item isn't cut at 'Dr.' nor where items share words."""
    rang = "When the colonel rang, Dr. {} left the {} and ran to the {} before the others."
    rows = [(k, f"Read the notice and answer the question below. The {b} stood near the {c} for years. {rang.format(a, b, c)} What was the sum given?") for k, (a, b, c) in enumerate((("Kitobo", "quarry", "cattle"), ("Nakori", "minister", "regiment"), ("Sekupo", "shipment", "railwayman")), 1)]
    same = "The warehouse of Mineka had cost its owner ninety three crowns before the fair. Nobody in the parish would say why it was so dear."
    rows += [(k, f"{same} Is this {x}?") for k, x in enumerate(("true", "false", "known"), 11)]
    items = leaks.items_of(rows)
    assert [(i.key, len(i.starts)) for i in items[:3]] == [(1, 25), (2, 25), (3, 25)] and [i.key for i in items[3:]] == [11, 12, 13]
    seeds = leaks.automaton(items)
    assert [(k, n) for k, n, _, _ in leaks.leaks(f"Some page. {' '.join(rang.format('Kitobo', 'quarry', 'cattle').split()[:14])} and so on", items, seeds)] == [(1, 14)]
    assert [k for k, *_ in leaks.leaks(same, items, seeds)] == [11, 12, 13]
    assert leaks.leaks("Read the notice and answer the question below. What was the sum given?", items, seeds) == []


SHARED = "The warehouse of Mineka had cost its owner ninety three crowns before the fair and nobody would say why."


def test_passages_that_many_items_share_leak_for_each(spark, monkeypatch):
    rows = [(k, f"The {a} of {b} rose early that day. {SHARED} Was it {c}?") for k, (a, b, c) in enumerate((("mayor", "Koda", "true"), ("miller", "Sato", "false"), ("baker", "Rimo", "known"), ("clerk", "Tano", "told"), ("judge", "Bodo", "sold")))]
    pages = spark.createDataFrame([(1, f"Some page. {SHARED} And so on.")], "doc_id long, text string")
    tests = spark.createDataFrame([*rows, (9, "An item of its own that shares nothing with the rest but must be found in its block.")], "item_id long, text string")
    for block in (20_000_000, 250, 10):
        monkeypatch.setattr(leaks, "BLOCK", block)
        got = leaks.leaked(pages, "doc_id", "text", tests, "item_id", "text").collect()
        assert sorted((r.item_id, r.words) for r in got) == [(k, 19) for k in range(5)]


def test_equal_items_leak_alike():
    items = leaks.items_of([(k, ITEM) for k in range(4)] + OTHERS)
    assert [k for k, *_ in leaks.leaks(LEAK, items, leaks.automaton(items))] == [0, 1, 2, 3]


def test_common_edges_are_a_share_of_all_items(spark):
    rows = [(k, f"Read it. {'x' * (k + 1)} is here.") for k in range(400)] + [(1000 + k, f"Seldom read so. {'y' * (k + 1)} is here.") for k in range(5)]
    assert leaks.common_edges(rows) == {"f" + leaks.folded("Read it.")}
    assert leaks.common_of(spark.createDataFrame(rows, "i long, text string"), "text") == leaks.common_edges(rows)


def test_leaks_in_any_script():
    texts = {
        1: "村の市場では毎年秋になると新しい橋の建設をめぐって住民と役人とのあいだに激しい議論が起こった。",
        2: "Старый мельник из деревни каждую осень продавал семь медных котлов вдове перед открытием узкого моста.",
        3: "Der müde Müller aus Tübingen verkaufte jeden Herbst sieben große kupferne Kessel an die ärmste Witwe der Straße.",
        4: "Le meunier âgé vendait chaque été sept chaudrons de cuivre à la veuve près de l'étroit pont où l'on péchait.",
    }
    items = leaks.items_of(list(texts.items()))
    seeds = leaks.automaton(items)
    assert len(items) == 4
    for k, t in texts.items():
        for page in (t, f"x\n{t[:30]}\n{t[30:]}\nあれ y", t.upper()):
            found = leaks.leaks(page, items, seeds)
            assert [i for i, *_ in found] == [k] and page[found[0][2] :].startswith(t.split()[0][:2].upper() if page == t.upper() else t[:2])


def test_an_item_goes_on_at_the_head_of_another_column():
    items = leaks.items_of([(1, ITEM), *OTHERS])
    seeds = leaks.automaton(items)
    words = LEAK.split()
    other = [f"Line {k} of another matter altogether" for k in range(40)]
    text = "\n".join([" ".join(words[8:16]), *other, " ".join(words[:8])])
    assert [(k, n) for k, n, _, _ in leaks.leaks(text, items, seeds)] == [(1, 16)]
    assert leaks.leaks("\n".join([" ".join(words[9:16]), *other, " ".join(words[:8])]), items, seeds) == []


def test_leaks_of_a_table(spark):
    pages = spark.createDataFrame([(1, LEAK, "c"), (1, LEAK, "c"), (2, None, "c"), (3, "", "c"), (4, OTHERS[0][1] + " " + LEAK.upper() + " x" * 50_000, "c")], "doc_id long, text string, words string")
    tests = spark.createDataFrame([(1, ITEM), *OTHERS, (7, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaked(pages, "doc_id", "text", tests, "item_id", "text").collect())
    assert got == [(1, 1), (1, 1), (4, 1), (4, 2)]
    assert leaks.leaked(pages.limit(0), "doc_id", "text", tests, "item_id", "text").count() == 0 == leaks.leaked(pages, "doc_id", "text", tests.limit(0), "item_id", "text").count()
