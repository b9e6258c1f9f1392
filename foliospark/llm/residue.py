"""Template residue and error-page text: unfilled placeholders, filler, error messages, notices that ask for scripts.

A character n-gram model is fitted for each kind of residue, from sentences made of the parts below and then from what
they find in the pages, and one for natural prose, from the rest of all pages. All models share a
background, so n-grams that none of them has say nothing: what is merely unfamiliar is no residue. Windows over each
whole text give the likelihood ratio of residue to prose; windows in favour of residue are joined to spans, and a page
is residue if its spans cover enough characters, so that an article that quotes a few such words isn't. What stands in
single brackets is a placeholder if it is likelier a field's name than prose; template marks always are.

Null, empty and blank texts are no residue. Each row has a result; repeated rows have equal ones.
"""

from __future__ import annotations

import builtins
import random
import re
from collections.abc import Callable, Iterator
from functools import cache
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.grams import Bayes
from foliospark.session import spread, table

#: Characters of a long page, and slots that are held before they are counted.
LONGEST, HELD = 20_000, 1_000_000
#: Rounds of the fit.
ROUNDS = 3
#: Length of n-grams, slots of the hashed tables, characters in a window, and the mean log-ratio that makes it residue.
N, SLOTS, WINDOW, RATIO = 5, 1 << 18, 20, 0.8
#: Part of the background in each model, and the most that one n-gram says, in nats.
BACKGROUND, MOST = 0.05, 3.0
#: Part of the pages up to which n-grams of the seeds don't count as prose at first.
RARE = 0.02
#: What brackets around one word say for a field's name, in nats.
TIGHT = 12.0
#: Least characters of a span, and least characters of all spans of a page; of a span that teaches the models more.
LEAST_SPAN, LEAST_COVER, TEACHES = 14, 24, 40

# What filler is made of.
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa
qui officia deserunt mollit anim id est laborum""".split()
KEYS = [["xxxx", "xxx", "blah", "text", "Text", "words", "word", "foo", "bar"], ["asdf", "asdfgh", "qwer", "qwerty", "zxcv", "jkl;", "test", "test123", "foo", "bar"]]
# Parts of filler, of error messages and of notices about scripts, each list by place in the sentence.
FILLER = (
    (("This is", "Please insert", "Replace", "Add", "Insert", "Enter", "Type", "Here goes", "Placeholder:", "Draft:"),
     ("sample text", "dummy text", "dummy copy", "a placeholder", "placeholder text", "your own text", "this paragraph", "the body text", "the headline", "some filler copy", "a caption", "the title of the article"),
     ("to fill the page layout.", "for layout purposes only.", "with the real article.", "with your own content.", "goes here.", "here.", "to come.", "to follow.", "until the final copy arrives.", "that will be supplied later by the author.", "to be added by the editor.")),
    (("Text", "Headline", "Copy", "Caption", "Body text", "Article", "Photo", "Summary"), ("to come.", "to follow.", "goes here.", "will be supplied.", "will be added later.", "to be confirmed.", "is a placeholder.")),
    (("Dies ist ein", "Hier steht ein", "Das ist nur ein"), ("Blindtext,", "Platzhalter,", "Mustertext,", "Beispieltext,"), ("der nur das Layout füllt.", "bis der Artikel kommt.", "der später ersetzt wird.", "ohne Inhalt.")),
    (("Hier", "An dieser Stelle"), ("steht später", "folgt noch", "kommt bald", "erscheint später"), ("der Text.", "der Artikel.", "der Titel.", "die Überschrift.")),
    (("Ceci est un", "Voici un"), ("faux texte", "texte provisoire", "texte de remplissage", "texte factice", "exemple de texte"), ("pour la mise en page.", "en attente de l'article.", "à remplacer par la rédaction.", "sans signification.")),
    (("Le texte", "L'article", "Le titre"), ("viendra ici.", "sera ajouté plus tard.", "sera fourni par la rédaction.")),
)
ERRORS = (
    (("The page", "This page", "The page image", "The article", "The file", "The document", "The address", "The scan", "The resource", "The issue", "Your session", "The link", "The server", "This service", "The archive", "The database", "The site"),
     ("you requested", "you are looking for", "that you asked for", "", "", ""),
     ("could not be found.", "was not found on this server.", "does not exist.", "no longer exists.", "has been moved or deleted.", "has expired.", "has timed out.", "is temporarily unavailable.", "is unavailable due to maintenance.", "is down for maintenance.", "is currently not available.", "could not be loaded.", "failed to load.", "returned an error.", "encountered an unexpected error.", "will be back in 30 minutes.", "cannot be reached.")),
    (("Please", "You may", "Try to", "Kindly"), ("go back", "try again later", "return to the home page", "reload the page", "sign in again", "log in", "check the address", "contact the administrator", "contact support", "refresh the page"),
     ("and try again.", "to continue.", "or contact the webmaster.", "if the problem persists.", "with a valid account.", "to continue reading.", "to view this page.")),
    (("Error", "An error", "Something", "A problem", "A fatal error", "Oops! Something", "An unexpected error", "Sorry, an error"), ("occurred", "went wrong", "has happened"), ("while loading the page.", "while processing your request.", "on the server.", "while opening the file.", "in the application.")),
    (("Access denied.", "Permission denied.", "Access to this page is restricted.", "You do not have permission to", "You are not authorized to", "Subscribers only: log in to"), ("view this page.", "open this image.", "access this resource on the server.", "see the full article.")),
    (("Error establishing", "Failed to establish", "Lost", "Could not open", "Timeout while making"), ("a connection to", "the connection with"), ("the database.", "the server.", "the host.", "the archive.")),
    (("Error code:", "Reference:", "Request:", "Request ID", "Error number", "Incident"), ("3f0dc7fe.", "0x80004005.", "7c2a1632.", "66efeab6", "a1b2c3d4.")),
    (("Fatal error:", "Warning:", "Exception:", "Unhandled exception:", "Notice:"), ("Uncaught exception in", "Call to undefined function in", "Undefined variable in", "Maximum execution time exceeded in", "Out of memory in", "null pointer in"), ("render_page", "index.php", "app.js", "main.py", "view.jsp"), ("on line 12.", "at line 739.", "(line 40).", "Stack trace: #0 main()", "thrown in main.")),
    (("Traceback (most recent call last):", "Exception in thread main:"), ('File "app.py", line 12, in main', 'File "view.py", line 88, in load', "at Main.run(Main.java:42)"), ("@",)),
    (("Seite", "Die Seite", "Die Ausgabe", "Die Datei", "Der Artikel"), ("nicht gefunden.", "wurde nicht gefunden.", "existiert nicht mehr.", "konnte nicht geladen werden.", "ist derzeit nicht erreichbar.", "die Sie angefordert haben, existiert nicht."), ("Fehler 404.", "Bitte versuchen Sie es später erneut.", "Zurück zur Startseite.", "Es ist ein Fehler aufgetreten.")),
    (("La page", "La page demandée", "Le fichier", "L'article", "Le document demandé"), ("est introuvable.", "n'existe plus.", "n'a pas été trouvée.", "ne peut pas être affiché.", "est momentanément indisponible."), ("Erreur 404.", "Retour à l'accueil.", "Veuillez réessayer plus tard.", "Une erreur est survenue.")),
)
SCRIPTS = (
    (("Please", "You need to", "You must", "To continue,", "You have to", "Kindly"), ("enable", "activate", "turn on", "switch on", "allow"), ("JavaScript", "scripts", "JavaScript and cookies", "active scripting", "cookies"),
     ("in your browser", "in your browser settings", "", "for this site"), ("to use this site.", "to view this page.", "to run this app.", "to run the viewer.", "to see the images.", "and reload the page.", "to open the article.", "to use the archive.", "and refresh.")),
    (("JavaScript", "Active scripting", "Scripting", "JavaScript support"), ("is disabled.", "is turned off.", "is not enabled in your browser.", "is required to view this content.", "seems to be switched off."), ("This page requires it to work properly.", "The viewer needs it to load.", "The image cannot be shown without it.", "Turn it on and refresh.", "Reload the page afterwards.")),
    (("This site", "This page", "This viewer", "The archive", "The tool", "This app"), ("requires JavaScript", "needs JavaScript", "does not work without scripts", "stays blank without JavaScript", "needs cookies and scripts"), ("to work properly.", "to be displayed.", "switched on.", "in order to run.")),
    (("Your browser does not support", "Your browser has disabled", "Your browser blocks"), ("scripts,", "JavaScript,", "this feature,"), ("so the page cannot be displayed.", "so this viewer cannot start.", "so the image stays blank.", "so some content is missing.")),
    (("Noscript:", "No script:", "Without scripts,", "Without JavaScript,", "Without active scripting,"), ("the page", "this viewer", "the image", "the tool", "the archive"), ("stays blank.", "cannot be shown.", "will not load."), ("See your browser settings.", "Check the settings of your browser.", "")),
    (("Checking your browser", "Verifying your browser"), ("before opening", "before loading", "before you can enter"), ("the page.", "the site.", "the article."), ("This needs JavaScript and cookies.", "Please wait.")),
    (("Bitte", "Sie müssen"), ("aktivieren Sie", "JavaScript", "schalten Sie"), ("JavaScript in Ihrem Browser,", "im Browser aktivieren,", "Skripte ein,"), ("um die Seite anzuzeigen.", "um fortzufahren.", "um den Inhalt zu sehen.", "damit das Archiv funktioniert.")),
    (("Veuillez", "Vous devez", "Merci de"), ("activer JavaScript", "autoriser les scripts", "activer les cookies"), ("dans votre navigateur", "", ""), ("pour afficher cette page.", "pour continuer.", "pour utiliser ce site.", "pour voir le contenu.")),
)
# How templates write what is to be filled in, marks that prose doesn't have and such as it may have.
NAME = r"[A-Za-z][\w.]*(?:-?\n?[\w.]+)*"
TEMPLATE = re.compile("|".join((r"\{\{[^{}]{1,80}\}\}", r"\{%[^{}]{1,80}%\}", r"<%[^<>]{1,80}%>", r"<<[^<>]{1,80}>>", r"\[\[[^\[\]]{1,80}\]\]", r"\$\{[^{}]{1,80}\}", r"@@[^@]{1,60}@@", r"(?<!\w)__[A-Za-z][^\n]{0,40}?__(?!\w)")))
BRACKETS = re.compile("|".join((rf"\{{{NAME}\}}", r"<[A-Z][A-Z_0-9]+(?:-?\n[A-Z_0-9]+)?>", rf"(?<![\w%])%{NAME}%(?![\w%])", rf"(?<![\w#])#{NAME}#(?![\w#])", r"\[[A-Z][^\[\]]{1,120}\]")))
# Words of fields' names, and of what asks to fill them in.
FIELDS = "name first last full author editor byline title headline subtitle caption section category issue number no date day month year time town city street address zip country phone email price amount total currency body text summary content link url image photo page user id customer company product order signature".split()
ASKS = "INSERT Insert YOUR Your ENTER Enter ADD Add TODO TBD TBC PLACEHOLDER Placeholder FILL Fill".split()
KINDS = ("filler", "error", "scripts")
#: Characters that scanning confuses are made equal, digits too, white space is one blank.
FOLD = str.maketrans({"\n": " ", "\t": " ", "¬": "-", "0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "j": "i", "2": "8", "3": "8", "4": "8", "7": "8", "|": "l"})


def folded(text: str) -> str:
    return text.lower().translate(FOLD)


def slots(s: str) -> np.ndarray:
    """The slot of the n-gram that begins at each character."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(c) - N + 1), np.uint64)
    for k in range(N):
        h = h * np.uint64(0x9E3779B1) + c[k : len(c) - N + 1 + k]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def made(parts: tuple, rounds: int = 3) -> list[str]:
    """Sentences of one part of each list: each part with its neighbours in turn, each at least so many times."""
    n = rounds * max(map(len, parts))
    return [" ".join(x for j, p in enumerate(parts) if (x := p[(k * (2 * j + 1) + k // len(p)) % len(p)])).replace(" @", "") for k in range(n)]


def seeds() -> dict[str, str]:
    """What the models of residue are first fitted on. The names of HTTP's states and of exceptions come from the
    standard library; filler of loose words comes in many orders."""
    r = random.Random(7)
    loose = [" ".join(r.choice(LOREM) + ("." if not k % 9 else "") for k in range(12 * len(LOREM)))]
    loose += [" ".join(r.choice(ws) for _ in range(900)) for ws in KEYS]
    states = [f"{a}{int(s)} {b}{s.phrase}." for s in HTTPStatus if s >= 400 for a, b in (("", ""), ("HTTP ", ""), ("HTTP Error ", "- "), ("Error ", ": "))]
    raised = [f"{e.__name__}: '{x}'" for e in vars(builtins).values() if isinstance(e, type) and issubclass(e, Exception) for x in ("page", "key")]
    kinds = {"filler": FILLER, "error": ERRORS, "scripts": SCRIPTS}
    out = {k: " ".join(s for parts in v for s in made(parts)) for k, v in kinds.items()}
    return out | {"filler": " ".join([out["filler"], "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", *loose]), "error": " ".join([out["error"], *states, *raised])}


def counted(text: str) -> np.ndarray:
    return np.bincount(slots(folded(re.sub(r"\s+", " ", text))), minlength=SLOTS).astype(np.float32)


def log_ratios(counts: list[np.ndarray], prose: np.ndarray) -> np.ndarray:
    """Log-ratios of each kind of residue to prose. All are mixed with one background, in which each has an equal part:
    slots that none has give zero."""
    damped = [np.where(c > 0, 1 + np.log1p(c), 0.0) for c in counts]
    shares = [(c / max(1.0, c.sum())).astype(np.float32) for c in (*damped, prose)]
    back = (0.5 * sum(shares[:-1]) / len(counts) + 0.5 * shares[-1]) * BACKGROUND + 1e-12
    plain = np.log((1 - BACKGROUND) * shares[-1] + back)
    return np.array([np.clip(np.log((1 - BACKGROUND) * s + back) - plain, -MOST, MOST) for s in shares[:-1]], np.float32)


class Tally:
    """Counts of slots in pages, for one round of the fit: of prose, of pages that have each slot of the seeds in the first
    round, when there is no table yet, and of residue of each kind in the others."""

    def __init__(self, table: np.ndarray | None, seeded: np.ndarray):
        self.table, self.seeded, self.texts, self.size = table, seeded, 0, 0
        self.plain, self.pages = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.taught = np.zeros((len(KINDS), SLOTS), np.int64)
        self.held: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        if not text:
            return
        self.texts += 1
        t = folded(text)
        s = slots(t)
        if self.table is None:
            self.pages[np.unique(s[self.seeded[s]])] += 1
        elif (found := spans(t, self.table, s))[0]:
            keep = np.ones(len(s), bool)
            for (a, b), k in zip(*found):
                keep[max(0, a - N) : b] = False
                if b - a >= TEACHES:
                    np.add.at(self.taught[k], s[a : max(a, b - N + 1)], 1)
            s = s[keep]
        self.held.append(s)
        self.size += len(s)
        if self.size > HELD:
            self.count()

    def count(self) -> None:
        if self.held:
            self.plain += np.bincount(np.concatenate(self.held), minlength=SLOTS)
            self.held.clear()
            self.size = 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(kind, slot, n) of what isn't zero."""
        self.count()
        for kind, n in enumerate((np.array([self.texts]), self.pages, self.plain, *self.taught)):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["kind", "slot", "n"])


def fit_rounds(tallied: Callable[[np.ndarray | None, np.ndarray], pa.Table], rounds: int) -> np.ndarray:
    """Log-ratios of residue to prose, one row per kind and one of the greatest, one column per slot, from the summed
    tallies of each round.

    The pages hold residue itself: at first n-grams of the seeds that few pages have don't count as prose; then what the
    models find in a page is left out of prose, and its longer spans, to the line's end, are residue of their kind."""
    counts = [counted(t) for t in seeds().values()]
    seeded = sum(c > 0 for c in counts) > 0
    table = None
    for _ in range(rounds):
        total = np.zeros((3 + len(KINDS), SLOTS), np.int64)
        rows = tallied(table, seeded)
        np.add.at(total, (rows.column("kind").to_numpy(), rows.column("slot").to_numpy()), rows.column("n").to_numpy())
        plain = total[2].astype(np.float64)
        if table is None:  # what seeds have in common with few pages may be residue in them
            plain[seeded & (total[1] <= max(2, RARE * total[0, 0]))] = 0
        table = log_ratios([c + x for c, x in zip(counts, total[3:])], plain)
        table = np.vstack([table, table.max(axis=0)])
    return table


def fit(prose: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """The models of a list of pages."""

    def tallied(table: np.ndarray | None, seeded: np.ndarray) -> pa.Table:
        tally = Tally(table, seeded)
        for t in prose:
            tally.add(t)
        return pa.Table.from_batches(tally.rows())

    return fit_rounds(tallied, rounds)


def fit_all(df: DataFrame, text: str, rounds: int = ROUNDS) -> np.ndarray:
    """The models of all pages of df, the same as `fit` of one list of them. Each round reads df once; what comes to the
    driver are the sums of fixed tables."""

    def tallied(table: np.ndarray | None, seeded: np.ndarray) -> pa.Table:
        shared = df.sparkSession.sparkContext.broadcast((table, seeded))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally = Tally(*shared.value)
            for batch in batches:
                for t in batch.column(0):
                    tally.add(t.as_py())
            yield from tally.rows()

        total = df.select(text).mapInArrow(run, "kind int, slot int, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        return total

    return fit_rounds(tallied, rounds)


@cache
def names() -> Bayes:
    """Names of fields against prose, as both stand in brackets."""
    r = random.Random(3)
    fields = []
    for _ in range(600):
        words = r.sample(FIELDS, r.choice((1, 2, 2, 3)))
        fields += [r.choice(("_", ".", "")).join(words), "_".join(words).upper(), words[0] + "".join(w.title() for w in words[1:]), f"{r.choice(ASKS)} {' '.join(words)}", f"{r.choice(ASKS)} {' '.join(words).upper()} HERE"]
    plain = "so the prompter swore to the last word; name illegible; the late mayor of this place; we regret to say; Signed; Laughter; Applause; Cheers; Copyright; Advertisement; Continued on page two; From our own correspondent; To the public; it is said; per cent; in the original; sic; Registered; Hear, hear; as follows; Only one penny; he paused; a Monday; corrected; see above; from the French; Mr. Mayor; For the ladies; Latest telegrams".split("; ")
    return Bayes({"field": fields, "prose": [*plain, *(w.lower() for w in plain)] * 20})


def placeholder(text: str) -> re.Match | None:
    """The first unfilled placeholder: template marks, or brackets around what is likelier a field's name than prose."""
    first = TEMPLATE.search(text)
    for m in BRACKETS.finditer(text, 0, first.start() if first else len(text)):
        inside = re.sub(r"-?\n", "", m[0][1:-1]) if "_" in m[0] else m[0][1:-1]
        field, prose = names().scores(inside)
        asked = m[0][0] == "["
        if field + (0.0 if asked else TIGHT) > max(prose, 0.0) and (not asked or inside.split()[0].rstrip(":") in ASKS):
            return m
    return first


def spans(s: str, table: np.ndarray, g: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of a folded text that residue explains better, and the kind of each."""
    g = slots(s) if g is None else g
    if not len(g):
        return [], []
    half = WINDOW // 2
    at = np.arange(len(g))
    low, high = np.maximum(at - half, 0), np.minimum(at + half, len(g))

    def windows(scores: np.ndarray) -> np.ndarray:
        sums = np.zeros((*scores.shape[:-1], len(g) + 1))
        np.cumsum(scores, axis=-1, out=sums[..., 1:], dtype=np.float64)
        return (sums[..., high] - sums[..., low]) / (high - low)

    if not (windows(table[-1][g]) > RATIO - 1e-6).any():  # no kind says more than the greatest
        return [], []
    means = windows(table[:-1][:, g])
    best = means.max(axis=0)
    hit = best > RATIO
    if not hit.any():
        return [], []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    out, kinds = [], []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a + N - 1 >= LEAST_SPAN:
            out.append((a, b + N - 1))
            kinds.append(int(means[:, a:b].sum(axis=1).argmax()))
    return out, kinds


def judge(text: str | None, table: np.ndarray) -> tuple[str | None, int, list[tuple[int, int]]]:
    """(kind, covered characters, spans) of a text; kind is null if it is no residue."""
    if not text or not text.strip():
        return None, 0, []
    found, kinds = spans(folded(text), table)
    cover = sum(b - a for a, b in found)
    if m := placeholder(text):
        return "placeholder", cover + m.end() - m.start(), [*found, m.span()]
    if cover >= LEAST_COVER:
        by = [sum(b - a for (a, b), k in zip(found, kinds) if k == i) for i in range(len(KINDS))]
        return KINDS[by.index(max(by))], cover, found
    return None, cover, found


def residue(df: DataFrame, key: str, text: str = "text", table: np.ndarray | None = None) -> DataFrame:
    """(key, kind, covered, share, spans) of each row. Narrow; the tables, fitted on all rows unless given and of fixed
    size, are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(fit_all(df, text) if table is None else table)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(1).to_pylist()
                kinds, covers, found = zip(*(judge(t, table) for t in texts))
                at = pa.array([[{"from": a, "to": b} for a, b in f] for f in found], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
                shares = pa.array([c / len(t) if t else 0.0 for c, t in zip(covers, texts)], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kinds, pa.string()), pa.array(covers, pa.int32()), shares, at], names=[key, "kind", "covered", "share", "spans"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, kind string, covered int, share double, spans array<struct<`from`:int,`to`:int>>")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id").where("kind is not null").select("doc_id")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id").where("kind is not null").select("doc_id", "kind", "covered", "spans")


QUERIES = {"p9_found": p9_found, "p9_kinds": p9_kinds}
SQL: dict[str, str] = {}
