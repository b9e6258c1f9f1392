"""Broken prompt and response pairs: which translations don't serve, and why.

Character n-gram naive Bayes gives each part of a response a posterior over languages and over being a refusal, to be
held against the prompt. An n-gram model of how sound answers end, and of how sentences are cut, gives the likelihood
ratio of truncation at the end of the text; where the end itself is sound, the last sentences of prompt and response are
compared by the lexicon fitted on the pairs, for an answer may stop after a sentence.

Null and empty responses are `empty`. A null or empty prompt is no defect by itself. One defect at most, in the order
empty, copy, refusal, language, truncated. Calls delivered twice come out once.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import lexicon
from foliospark.llm.grams import Bayes, Counts, counted, summed
from foliospark.session import spread, stage, table

#: Sentences, or n-grams, that are held before they are counted.
HELD, HELD_GRAMS = 4000, 4_000_000
#: Least Japanese letters of an answer whose end, and whose words, teach the models.
LEAST_JAPANESE = 21
#: Part of the answer's words that are the prompt's in a copy.
COPIED = 0.5
#: By how many nats a character a sentence must be more like refusals than like plain sentences: in languages that plain
#: sentences of the corpus are known of, and in the others.
SURE, SURE_OTHER = 0.3, 1.0
#: Least log-ratio of cut to whole at the end of a text.
CUT = 0.0

# Written forms of no answer, after white space and punctuation are left out.
NOTHING = frozenset("na null none nil nan undefined void empty noanswer noresponse notavailable notranslation なし 無し 該当なし 無回答 未翻訳 空欄 無".split())
# Seed sentences of languages, on the same everyday matters.
LANGUAGES = {
    "ja": "この論文では、村の歴史と市場の関係について論じている。しかし、当時の記録によれば、人々は土地を離れた。私たちは事例を数え、調査を行った。それは記憶の一つの形になっていた。カタカナの名前も多く含まれる。住民はその儀礼を覚えている。",
    "en": "The people of the village remember the market and the river. This article is about the history of the archive, and what it means. According to the records, the price rose after the war. We counted cases and visited the town. It explains how one thing is tied to another. The author looks at the question in and around the city. Here is a brief summary of the passage. She thinks that there will be more of them when they have been asked.",
    "de": "Die Leute im Dorf erinnern sich an den Markt und an den Fluss. Dieser Aufsatz handelt von der Geschichte des Archivs und davon, was sie bedeutet. Nach den Akten stieg der Preis nach dem Krieg. Wir haben die Fälle gezählt und die Stadt besucht. Sie glaubt, dass es mehr werden, wenn man sie fragt. Für die Bürger wäre das nicht schlecht, aber auch nicht möglich.",
    "fr": "Les gens du village se souviennent du marché et de la rivière. Cet article traite de l'histoire des archives et de ce qu'elle signifie. D'après les registres, le prix a augmenté après la guerre. Nous avons compté les cas et visité la ville. Elle pense qu'il y en aura davantage quand on les aura interrogés. Où étaient-ils passés, et pourquoi ne l'a-t-on pas dit ?",
    "es": "La gente del pueblo recuerda el mercado y el río. Este artículo trata de la historia de los documentos y de lo que significa. Según los registros, el precio subió después de la guerra. Hemos contado los casos y visitado la ciudad. Ella cree que habrá más cuando se les pregunte. ¿Por qué no lo dijo nadie en aquel año?",
    "it": "La gente del villaggio ricorda il mercato e il fiume. Questo articolo tratta della storia dei documenti e di ciò che significa. Secondo i registri il prezzo è aumentato dopo la guerra. Abbiamo contato i casi e visitato la città. Lei pensa che ce ne saranno di più quando verranno interrogati. Perché nessuno lo ha detto?",
    "pt": "As pessoas da aldeia lembram-se do mercado e do rio. Este artigo trata da história dos documentos e do que ela significa. Segundo os registos, o preço subiu depois da guerra. Contámos os casos e visitámos a cidade. Ela acha que haverá mais quando lhes perguntarem. Não foi possível, mas também não houve razões.",
    "nl": "De mensen in het dorp herinneren zich de markt en de rivier. Dit artikel gaat over de geschiedenis van het archief en wat die betekent. Volgens de stukken steeg de prijs na de oorlog. Wij hebben de gevallen geteld en de stad bezocht. Zij denkt dat het er meer worden als men het hun vraagt. Waarom heeft niemand dat gezegd?",
    "sv": "Människorna i byn minns marknaden och floden. Den här artikeln handlar om arkivets historia och vad den betyder. Enligt handlingarna steg priset efter kriget. Vi räknade fallen och besökte staden. Hon tror att det blir fler när man frågar dem. Varför har ingen sagt något om det?",
    "da": "Menneskene i landsbyen husker markedet og floden. Denne artikel handler om arkivets historie og hvad den betyder. Ifølge papirerne steg prisen efter krigen. Vi talte tilfældene og besøgte byen. Hun tror, at der bliver flere, når man spørger dem. Hvorfor har ingen sagt noget om det?",
    "no": "Menneskene i landsbyen husker markedet og elva. Denne artikkelen handler om arkivets historie og hva den betyr. Ifølge papirene steg prisen etter krigen. Vi talte tilfellene og besøkte byen. Hun tror at det blir flere når man spør dem. Hvorfor har ingen sagt noe om det?",
    "fi": "Kylän ihmiset muistavat torin ja joen. Tämä artikkeli käsittelee arkiston historiaa ja sen merkitystä. Asiakirjojen mukaan hinta nousi sodan jälkeen. Laskimme tapaukset ja kävimme kaupungissa. Hän uskoo, että niitä on enemmän, kun heiltä kysytään. Miksi kukaan ei ole sanonut siitä mitään?",
    "pl": "Mieszkańcy wsi pamiętają targ i rzekę. Ten artykuł dotyczy historii archiwum i tego, co ona znaczy. Według dokumentów cena wzrosła po wojnie. Policzyliśmy przypadki i odwiedziliśmy miasto. Ona sądzi, że będzie ich więcej, kiedy się ich zapyta. Dlaczego nikt o tym nie powiedział? Nie było to jednak możliwe.",
    "cs": "Lidé z vesnice si pamatují trh a řeku. Tento článek pojednává o dějinách archivu a o tom, co znamenají. Podle záznamů cena po válce stoupla. Spočítali jsme případy a navštívili město. Myslí si, že jich bude víc, až se jich zeptáme. Proč to nikdo neřekl? Přesto to nebylo možné.",
    "hu": "A falu lakói emlékeznek a piacra és a folyóra. Ez a cikk a levéltár történetéről szól, és arról, hogy mit jelent. A feljegyzések szerint az ár a háború után emelkedett. Megszámoltuk az eseteket, és meglátogattuk a várost. Úgy gondolja, hogy többen lesznek, ha megkérdezik őket. Miért nem mondta ezt senki?",
    "ro": "Oamenii din sat își amintesc de târg și de râu. Acest articol tratează istoria arhivei și ce înseamnă ea. Potrivit registrelor, prețul a crescut după război. Am numărat cazurile și am vizitat orașul. Ea crede că vor fi mai mulți când vor fi întrebați. De ce nu a spus nimeni?",
    "tr": "Köyün insanları pazarı ve nehri hatırlıyor. Bu makale arşivin tarihini ve bunun ne anlama geldiğini ele alıyor. Kayıtlara göre fiyat savaştan sonra yükseldi. Vakaları saydık ve şehri ziyaret ettik. Onlara sorulduğunda daha çok olacağını düşünüyor. Bunu neden kimse söylemedi?",
    "id": "Orang-orang di desa itu masih ingat pasar dan sungainya. Artikel ini membahas sejarah arsip dan apa artinya. Menurut catatan, harga naik setelah perang. Kami menghitung kasus dan mengunjungi kota. Dia mengira akan ada lebih banyak lagi jika mereka ditanya. Mengapa tidak ada yang mengatakannya?",
    "vi": "Người dân trong làng vẫn nhớ khu chợ và dòng sông. Bài viết này nói về lịch sử của kho lưu trữ và ý nghĩa của nó. Theo sổ sách, giá đã tăng sau chiến tranh. Chúng tôi đã đếm các trường hợp và đến thăm thành phố. Cô ấy nghĩ rằng sẽ có nhiều hơn khi họ được hỏi.",
    "ru": "Жители деревни помнят рынок и реку. Эта статья посвящена истории архива и тому, что она означает. Согласно записям, цена выросла после войны. Мы подсчитали случаи и посетили город. Она думает, что их станет больше, когда их спросят. Почему никто этого не сказал?",
    "uk": "Мешканці села пам'ятають ринок і річку. Ця стаття присвячена історії архіву та тому, що вона означає. Згідно із записами, ціна зросла після війни. Ми порахували випадки й відвідали місто. Вона вважає, що їх стане більше, коли їх запитають. Чому ніхто цього не сказав?",
    "el": "Οι άνθρωποι του χωριού θυμούνται την αγορά και το ποτάμι. Αυτό το άρθρο αφορά την ιστορία του αρχείου και τη σημασία της. Σύμφωνα με τα έγγραφα, η τιμή ανέβηκε μετά τον πόλεμο. Μετρήσαμε τις περιπτώσεις και επισκεφθήκαμε την πόλη. Γιατί δεν το είπε κανείς;",
    "ar": "يتذكر أهل القرية السوق والنهر. تتناول هذه المقالة تاريخ الأرشيف وما يعنيه. ووفقا للسجلات ارتفع السعر بعد الحرب. لقد أحصينا الحالات وزرنا المدينة. وهي تعتقد أن عددهم سيزداد عندما يسألون. لماذا لم يقل أحد ذلك؟",
    "he": "אנשי הכפר זוכרים את השוק ואת הנהר. המאמר הזה עוסק בתולדות הארכיון ובמשמעותו. לפי הרישומים, המחיר עלה אחרי המלחמה. ספרנו את המקרים וביקרנו בעיר. היא חושבת שיהיו עוד כאשר ישאלו אותם.",
    "hi": "गाँव के लोग बाज़ार और नदी को याद करते हैं। यह लेख अभिलेखागार के इतिहास और उसके अर्थ के बारे में है। अभिलेखों के अनुसार युद्ध के बाद कीमत बढ़ी। हमने मामलों की गिनती की और शहर का दौरा किया।",
    "th": "ชาวบ้านในหมู่บ้านยังจำตลาดและแม่น้ำได้ บทความนี้กล่าวถึงประวัติของหอจดหมายเหตุและความหมายของมัน ตามบันทึก ราคาสูงขึ้นหลังสงคราม เราได้นับกรณีต่าง ๆ และไปเยี่ยมเมือง",
    "zh": "村里的人们还记得那个集市和那条河。本文讨论档案馆的历史及其意义。根据记录，战争之后价格上涨了。我们统计了这些案例，并且访问了这座城市。她认为，如果去问他们，就会有更多的人。为什么没有人说过呢？村裡的人們還記得那個市集。本文討論檔案館的歷史與意義，為什麼沒有人說過這個問題？",
    "ko": "마을 사람들은 시장과 강을 기억하고 있다. 이 글은 문서고의 역사와 그 의미를 다룬다. 기록에 따르면 전쟁이 끝난 뒤에 값이 올랐다. 우리는 사례를 세고 도시를 찾아갔다. 그는 사람들에게 물으면 더 많아질 것이라고 생각한다. 왜 아무도 말하지 않았을까?",
}
# What refusals are made of, by language: lists of which one of each is taken in turn, and whole sentences.
DECLINED = {
    "en": (
        (("I'm sorry, but", "Sorry,", "I apologize, but", "Unfortunately,", "Regrettably,", "My apologies, but", "I'm afraid", "As an AI,", "As a language model,", "At this time,", "Under my guidelines,", ""),
         ("I can't", "I cannot", "I am unable to", "I'm not able to", "I won't be able to", "I must decline to", "it is not possible for me to", "I am not permitted to", "I have to refuse to", "I can not", "I will not", "it would be inappropriate for me to", "I do not feel comfortable to", "I could not"),
         ("translate", "help you with", "assist with", "complete", "fulfil", "process", "provide a translation of", "continue with", "comply with", "respond to", "render", "work on", "produce", "give you"),
         ("the text.", "this section.", "your request.", "what you sent.", "such content.", "the document you gave.", "the paragraph above.", "it as asked.", "copyrighted works.", "anything of this kind.", "a full version of it.", "the source, which seems cut off.", "material that may be harmful.")),
        (("No text was given to translate.", "There is nothing here to translate.", "Please paste the source you want translated.", "Could you send me the original text?", "Please try another section instead.", "This may go against the content policy.", "The passage seems to be missing or incomplete, so no translation can be given.", "I would be glad to give a short summary instead.", "My guidelines do not allow this.", "That request falls outside of what I can do.", "I don't have the ability to do so.")),
    ),
    "ja": (
        (("申し訳ありませんが、", "申し訳ございませんが、", "恐縮ですが、", "すみませんが、", "恐れ入りますが、", "残念ながら、", "あいにくですが、", "AIとしては、", "AIアシスタントである私は、", "言語モデルのため、", "規約により、", "著作権の都合により、", ""),
         ("この文章", "ご依頼の件", "本文", "ご要望", "こちらの内容", "提供された資料", "原文の全体", "この種の話題", "そのご質問", "お送りいただいた部分", "ご指示"),
         ("を翻訳することはできません。", "には対応できません。", "の翻訳はお引き受けできません。", "にはお応えできかねます。", "の訳出は控えさせていただきます。", "についての回答を差し控えます。", "はお手伝いできません。", "の翻訳は辞退いたします。", "をお断りいたします。", "は扱えません。", "を訳すことが許可されていません。", "の翻訳はいたしかねます。", "に関してはご協力できかねます。", "の提供は遠慮させていただきます。")),
        (("翻訳する文章が入力されていません。", "テキストが見つかりませんので、翻訳できません。", "原文をもう一度お送りください。", "翻訳したい文をご提示いただけますでしょうか。", "別の箇所であれば対応いたします。", "要約でしたらお作りできます。", "方針に反するおそれがあります。", "対象の文が含まれていないようです。", "ご了承ください。")),
    ),
    "de": ((("Es tut mir leid, aber", "Leider", "Entschuldigung, aber", "Als KI-Modell"), ("kann ich", "darf ich", "werde ich"), ("diesen Text nicht übersetzen.", "dabei nicht helfen.", "diese Anfrage nicht bearbeiten.", "den Inhalt nicht wiedergeben.")), ("Bitte senden Sie mir den Text, der übersetzt werden soll.", "Ich muss die Übersetzung ablehnen.")),
    "fr": ((("Je suis désolé, mais", "Malheureusement,", "Désolé,", "En tant qu'IA,"), ("je ne peux pas", "je ne suis pas en mesure de", "il m'est impossible de"), ("traduire ce texte.", "vous aider avec cela.", "répondre à cette demande.", "fournir cette traduction.")), ("Veuillez m'envoyer le texte à traduire.", "Je dois refuser cette traduction.")),
    "es": ((("Lo siento, pero", "Lamentablemente,", "Disculpe,", "Como modelo de lenguaje,"), ("no puedo", "no me es posible", "no estoy autorizado a"), ("traducir este texto.", "ayudar con esa solicitud.", "responder a esta petición.", "dar esa traducción.")), ("Por favor, envíe el texto que desea traducir.", "Debo rechazar la traducción.")),
    "it": ((("Mi dispiace, ma", "Purtroppo", "Spiacente,"), ("non posso", "non sono in grado di", "non mi è possibile"), ("tradurre questo testo.", "aiutare con questa richiesta.", "rispondere alla domanda.")), ("Si prega di inviare il testo da tradurre.",)),
    "pt": ((("Desculpe, mas", "Infelizmente,", "Lamento, mas"), ("não posso", "não consigo", "não me é possível"), ("traduzir este texto.", "ajudar com esse pedido.", "responder a esta solicitação.")), ("Por favor, envie o texto que deseja traduzir.",)),
    "nl": ((("Het spijt me, maar", "Helaas", "Sorry, maar"), ("kan ik", "mag ik"), ("deze tekst niet vertalen.", "hier niet bij helpen.", "dit verzoek niet uitvoeren.")), ("Stuur mij de tekst die vertaald moet worden.",)),
    "sv": ((("Jag är ledsen, men", "Tyvärr", "Ursäkta, men"), ("kan jag inte", "får jag inte"), ("översätta den här texten.", "hjälpa till med detta.", "svara på denna begäran.")), ()),
    "pl": ((("Przepraszam, ale", "Niestety", "Przykro mi, ale"), ("nie mogę", "nie jestem w stanie"), ("przetłumaczyć tego tekstu.", "pomóc w tej sprawie.", "spełnić tej prośby.")), ()),
    "hu": ((("Sajnálom, de", "Sajnos", "Elnézést, de"), ("nem tudom", "nem áll módomban"), ("lefordítani ezt a szöveget.", "segíteni ebben a kérésben.", "teljesíteni ezt.")), ()),
    "tr": ((("Üzgünüm ama", "Maalesef", "Özür dilerim,"), ("bu metni çeviremem.", "bu konuda yardımcı olamıyorum.", "bu isteği yerine getiremiyorum.")), ()),
    "ru": ((("Извините, но", "К сожалению,", "Простите, но"), ("я не могу", "у меня нет возможности"), ("перевести этот текст.", "помочь с этим запросом.", "выполнить эту просьбу.")), ("Пожалуйста, пришлите текст для перевода.",)),
    "zh": ((("抱歉，", "很遗憾，", "对不起，", "非常抱歉，"), ("我无法", "我不能", "我没有办法"), ("翻译这段文字。", "协助您的请求。", "提供这段内容的译文。", "回答这个问题。")), ("请提供需要翻译的文本。", "抱歉，我無法翻譯這段文字。")),
    "ko": ((("죄송하지만", "유감스럽게도", "미안하지만"), ("이 글을", "이 내용을", "요청하신 것을"), ("번역할 수 없습니다.", "도와드릴 수 없습니다.", "처리할 수 없습니다.")), ("번역할 글을 보내 주세요.",)),
}
# Polite words around an answer that are no answer.
COURTESY = {
    "en": "Let me know if you need anything further. I hope that helps. Feel free to ask questions. Here is the translation: Sure, here it is. Below is the translated text. Thank you for your understanding. Is there anything else that I can help you with?",
    "ja": "以下が翻訳です。 翻訳： ご不明な点がございましたらお申し付けください。 ご理解のほどよろしくお願いいたします。 何かあればお知らせください。 他にご用があればお知らせください。 ほかに手伝えることがあればお申し付けください。 お役に立てば幸いです。 翻訳結果は次のとおりです。",
}


def declined(language: str) -> list[str]:
    """Refusals made of the language's parts: each part with its neighbours in turn, and the whole sentences."""
    parts, whole = DECLINED[language]
    by = "" if language in ("ja", "zh") else " "
    n = 12 * max(map(len, parts))
    return [by.join(p[(k * (2 * j + 1) + k // len(p)) % len(p)] for j, p in enumerate(parts)).strip() for k in range(n)] + [w for w in whole for _ in range(max(1, n // 24))]


# What is written where a text is cut.
MARKS = ("", "", "", "…", "...", "、", "（", "「")

HEADING = re.compile(r"^\s*(?:>\s*)*#{1,10}\s.*$", re.M)
FENCE = re.compile(r"^\s*```\w*\s*$", re.M)
PARTS = re.compile(r"[^。．.!?！？\n]+[。．.!?！？]*|[。．.!?！？]+")
LATIN = re.compile(r"[a-zà-ɏ0-9']+")
KANJI = re.compile("[㐀-鿿々]")
JAPANESE = re.compile("[぀-ヿ㐀-鿿々]")
KANA = re.compile("[ぁ-ゖァ-ヺ]")


class Ends:
    """How likely a text ends so, by the n-grams of its last characters, whole against cut. Texts are given by what `end`
    says of them and how many end so."""

    def __init__(self, whole: Counter, cut: Counter):
        self.whole, self.cut = (self.count(ends) for ends in (whole, cut))
        self.n = (max(1, whole.total()), max(1, cut.total()))

    @staticmethod
    def end(s: str) -> str:
        """Whether the last characters stand in a list, a bracket or a sentence, and three of them."""
        t = s.rstrip()
        last = t.rpartition("\n")[2]
        kind = "L" if re.match(r"\s*[-*•]\s", last) else "B" if re.match(r"\s*[（(]", last) else "S"
        return kind + re.sub(r"[ァ-ヴー]", "ア", re.sub(r"[0-9一二三四五六七八九〇]", "0", t[-3:]))

    @staticmethod
    def features(end: str) -> list[str]:
        """The last characters, the longest stretch first, with where they stand."""
        kind, t = end[0], end[1:]
        sort = "kanji" if KANJI.match(t[-1:]) else "letter" if t[-1:].isalnum() else t[-1:]
        return [f"{kind}{k}{t[-k:]}" for k in (3, 2, 1) if len(t) >= k] + [f"{kind}:{sort}", kind]

    def count(self, ends: Counter) -> Counter:
        out: Counter = Counter()
        for end, n in ends.items():
            for f in self.features(end):
                out[f] += n
        return out

    def ratio(self, end: str) -> float:
        """Log-likelihood of cut over whole by the longest ending that was met before."""
        for f in self.features(end):
            if self.cut[f] + self.whole[f] >= 3:
                return math.log((self.cut[f] + 0.1) / (self.n[1] + 1)) - math.log((self.whole[f] + 0.1) / (self.n[0] + 1))
        return 0.0


class Kinds:
    """Plain sentences of one language, refusals and polite words."""

    def __init__(self, language: str, plain: Counts | None = None):
        own = counted([LANGUAGES[language]])
        self.sure = SURE_OTHER if plain is None else SURE
        self.bayes = Bayes({"plain": own if plain is None else summed([own, plain]), "refusal": declined(language), "polite": [COURTESY.get(language, "")]})

    def of(self, sentences: list[str]) -> tuple[list[bool], list[bool]]:
        """Of each sentence whether it declines, and whether it is polite words."""
        if not sentences:
            return [], []
        plain, refusal, polite = self.bayes.parts(sentences).T
        n = np.array([len(s) for s in sentences])
        no = (refusal - plain > self.sure * n) & (refusal > polite)
        return no.tolist(), (~no & (polite - plain > self.sure * n)).tolist()


class Seeds:
    """The models that are made of the seeds alone."""

    def __init__(self):
        self.languages = sorted(LANGUAGES)
        self.spoken = Bayes({c: [LANGUAGES[c], *sorted(set(declined(c)))[::4]] if c in DECLINED else [LANGUAGES[c]] for c in self.languages})
        self.kinds = {c: Kinds(c) for c in DECLINED}


class Tally:
    """What pairs of texts say of the models: n-grams of plain sentences by language, languages of answers, ends of whole
    answers and of cut ones."""

    def __init__(self, seeds: Seeds):
        self.seeds = seeds
        self.plain: dict[str, list[Counts]] = {"en": [], "ja": []}
        self.spoken, self.whole, self.cut = Counter(), Counter(), Counter()
        self.sentences: list[str] = []
        self.answers: list[str] = []

    def add(self, prompt: str | None, answer: str | None) -> None:
        for t in (prompt, answer):
            self.sentences += [s for s in PARTS.findall(HEADING.sub("", t or "")) if len(s) > 12]
        if answer and answer.strip():
            self.answers.append(HEADING.sub("", answer))
            if teaches(answer):
                self.whole[Ends.end(answer)] += 1
                i = zlib.crc32(answer.encode("utf-8", "surrogatepass"))
                cut = answer[: int(len(answer) * (0.35 + 0.55 * (i % 97) / 97))].rstrip() + MARKS[i % len(MARKS)]
                if cut[-1:] not in ("。", ""):
                    self.cut[Ends.end(cut)] += 1
        if len(self.sentences) > HELD:
            self.count()

    def count(self) -> None:
        """Counts what is held. Sentences are plain ones of their language; those that the seeds take for refusals stay
        out, kana are of one language only."""
        own: dict[str, list[str]] = {"en": [], "ja": [s for s in self.sentences if KANA.search(s)]}
        if others := [s for s in self.sentences if not KANA.search(s)]:
            for s, k in zip(others, self.seeds.spoken.parts(others).argmax(axis=1).tolist()):
                if (c := self.seeds.languages[k]) in own:
                    own[c].append(s)
        for c, parts in own.items():
            if parts:
                refused = self.seeds.kinds[c].of(parts)[0]
                self.plain[c].append(counted(s for s, r in zip(parts, refused) if not r))
                if sum(len(g) for g, _ in self.plain[c][1:]) > HELD_GRAMS:
                    self.plain[c] = [summed(self.plain[c])]
        if self.answers:
            scores = self.seeds.spoken.parts(self.answers)
            self.spoken.update(self.seeds.languages[k] if x > 0 else "" for k, x in zip(scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()))
        self.sentences.clear(), self.answers.clear()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(kind, gram, x, n) of all counts."""
        self.count()
        for kind, parts in self.plain.items():
            if parts:
                g, n = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.nulls(len(g), pa.string()), pa.array(n)], names=["kind", "gram", "x", "n"])
        for kind, counts in (("spoken", self.spoken), ("whole", self.whole), ("cut", self.cut)):
            # characters that UTF-8 can't write are of no use as an end
            xs = [(x.encode("utf-8", "replace").decode(), n) for x, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(xs), pa.string()), pa.nulls(len(xs), pa.int64()), pa.array([x for x, _ in xs], pa.string()), pa.array([n for _, n in xs], pa.int64())], names=["kind", "gram", "x", "n"])


def teaches(answer: str) -> bool:
    return len(JAPANESE.findall(answer)) >= LEAST_JAPANESE


class Judge:
    """All models of this module, fitted on a list of pairs, or on their summed tally and the lexicon."""

    def __init__(self, pairs: list[tuple[str, str]] | pa.Table, seeds: Seeds | None = None, words: lexicon.Lexicon | None = None):
        seeds = seeds or Seeds()
        if isinstance(pairs, list):
            tally = Tally(seeds)
            for p, a in pairs:
                tally.add(p, a)
            words = lexicon.fit([(p, a) for p, a in pairs if p and a and teaches(a)])
            pairs = pa.Table.from_batches(tally.rows())
        kind = np.array(pairs.column("kind").to_pylist(), object)
        of = lambda k, c: pairs.column(c).filter(pa.array(kind == k))
        plain = {c: (of(c, "gram").to_numpy().view(np.uint64), of(c, "n").to_numpy()) for c in ("en", "ja")}
        spoken, whole, cut = (Counter(dict(zip(of(k, "x").to_pylist(), of(k, "n").to_pylist()))) for k in ("spoken", "whole", "cut"))
        self.languages, self.spoken, self.words = seeds.languages, seeds.spoken, words
        self.kinds = seeds.kinds | {c: Kinds(c, p) for c, p in plain.items() if len(p[0])}
        # the language that answers are to have: that of most of them
        self.wanted = min(spoken, key=lambda c: (-spoken[c], c)) if spoken else "ja"
        self.ends = Ends(whole, cut)
        self.ends = Ends(Counter({e: n for e, n in whole.items() if self.ends.ratio(e) < 0}), cut)

    def posterior(self, text: str) -> dict[str, float]:
        """The posterior of each language, and of none of them ("")."""
        x = np.append(self.spoken.scores(text), 0.0).astype(np.float64)
        x = np.exp(x - x.max())
        return dict(zip([*self.languages, ""], x / x.sum()))

    def language(self, text: str) -> str:
        p = self.posterior(text)
        return max(p, key=p.get)

    def defect(self, prompt: str | None, answer: str | None) -> str | None:
        if answer is None:
            return "empty"
        letters = sum(map(str.isalpha, answer))
        if letters <= 4 * max(map(len, NOTHING)):
            bare = "".join(c for c in unicodedata.normalize("NFKC", FENCE.sub("", answer)) if unicodedata.category(c)[0] in "LNS").lower()
            if not bare or bare in NOTHING:
                return "empty"
        prompt = prompt or ""
        body = FENCE.sub("", HEADING.sub("", answer)).strip()
        ours = LATIN.findall(answer.lower())
        latin = sum(len(w) for w in ours if not w.isdigit())
        if latin > 0.4 * letters and ours:
            theirs = LATIN.findall(prompt.lower())
            threes = {tuple(theirs[i : i + 3]) for i in range(len(theirs) - 2)}
            mine = [tuple(ours[i : i + 3]) for i in range(len(ours) - 2)]
            if mine and threes and sum(g in threes for g in mine) >= COPIED * len(mine):
                return "copy"
        if not body:
            return "truncated" if prompt and HEADING.sub("", prompt).strip() else None
        refused, rest = self.refusal(body)
        if refused:
            return "refusal"
        spoken = self.posterior(rest or body)
        if spoken[self.wanted] < 0.5:
            asked = self.posterior(prompt)
            if asked[self.wanted] < 0.5 or max(spoken, key=spoken.get) != max(asked, key=asked.get):
                return "language"
        return "truncated" if self.truncated(prompt, answer) else None

    def refusal(self, body: str) -> tuple[bool, str]:
        """Whether the answer declines, and what is left without polite words."""
        parts = [s for s in PARTS.findall(body) if s.strip()]
        if not parts:
            return False, ""
        tongues: dict[str, list[int]] = {}
        others = []
        for k, s in enumerate(parts):  # kana are of one language only
            (tongues.setdefault("ja", []) if KANA.search(s) else others).append(k)
        if others:
            scores = self.spoken.parts([parts[k] for k in others])
            for k, best, c in zip(others, scores.max(axis=1).tolist(), scores.argmax(axis=1).tolist()):
                tongues.setdefault(self.languages[c] if best > 0 else "", []).append(k)
        refused, kept, rest = 0, 0, list(parts)
        for lang, own in tongues.items():
            which = [k for k in own if len(parts[k]) >= 4]
            kept += sum(len(parts[k]) for k in which)
            if which and lang in self.kinds:
                for k, no, polite in zip(which, *self.kinds[lang].of([parts[k] for k in which])):
                    if no or polite:
                        kept -= len(parts[k])
                        refused += len(parts[k]) if no else 0
                        rest[k] = "" if polite else rest[k]
        return refused > kept, "".join(rest)

    def truncated(self, prompt: str, answer: str) -> bool:
        if self.ends.ratio(Ends.end(answer)) > CUT:
            return True
        en, ja = lexicon.sentences_en(prompt), lexicon.sentences_ja(answer)
        if not en:
            return False
        if not ja:
            return True
        # lists and notes at the end are told by their marks, sentences by what they say
        items = [sum(line.lstrip().startswith(("- ", "* ")) for line in t.split("\n")) for t in (prompt, answer)]
        tail_listed = prompt.rstrip().rpartition("\n")[2].lstrip().startswith(("- ", "* "))
        if tail_listed:
            return items[1] < items[0]
        sim = self.words.similarity(en, ja, 2)  # of the last two sentences
        last = sim[-1].max()
        if last >= 0.3:
            return False
        # the last sentence isn't there; was the one before the last the end of the answer?
        best = sim.max(axis=1)
        return bool(last < 0.2 or (len(en) > 1 and int(sim[-2].argmax()) == len(ja) - 1 and best[-2] > last + 0.15) or len(ja) < 0.7 * len(en))


def judge_all(df: DataFrame, prompt: str, answer: str) -> Judge:
    """The judge of all pairs of df, the same as that of one list of them. Each task tallies its rows; the sums come to the
    driver, as large as the different n-grams of up to four characters of all plain sentences."""
    seeds = Seeds()
    shared = df.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shared.value)
        for batch in batches:
            for p, a in zip(batch.column(0), batch.column(1)):
                tally.add(p.as_py(), a.as_py())
        yield from tally.rows()

    tallies = df.select(prompt, answer).mapInArrow(run, "kind string, gram bigint, x string, n bigint")
    total = tallies.groupBy("kind", "gram", "x").agg(F.sum("n").alias("n")).toArrow()
    return Judge(total, seeds, lexicon.fit_all(df.where(F.regexp_count(answer, F.lit(JAPANESE.pattern)) >= LEAST_JAPANESE), prompt, answer))


def defects(df: DataFrame, key: str, prompt: str, answer: str, judge: Judge | None = None) -> DataFrame:
    """(key, defect) of each row, null where the answer serves. Narrow; the models are broadcast. Unless given, they are
    fitted on all rows, which are written once as they are read several times."""
    df = df.select(F.col(key), F.col(prompt), F.col(answer))
    if judge is None:
        df = stage(df, "calls")
        judge = judge_all(df, prompt, answer)
    shared = df.sparkSession.sparkContext.broadcast(judge)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.defect(p, a) for p, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, "defect"])

    return df.mapInArrow(run, f"`{key}` {kind}, defect string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call that is delivered twice is judged twice, alike, and its small row is kept once."""
    calls = spread(table(spark, sf_dir, "translation_chunks").select("call_id", "clean_markdown", "res_text"))
    return defects(calls, "call_id", "clean_markdown", "res_text").where("defect is not null").distinct()


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
