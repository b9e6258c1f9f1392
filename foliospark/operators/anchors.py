"""Finding chapters in a text: exact and fuzzy anchors, tables of contents, chapters between anchors.

Positions are 0-based as the results have them; missing ones are null. All narrow: the text travels in its row, a table
of contents is an array in it. Null texts, anchors and titles count as empty and are never found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import contains_any, escape_regex, let, nn, squeeze, strip
from foliospark.options import EXCLUDED_SECTIONS

#: Characters of an anchor that must match exactly for a fuzzy hit.
SEED = 10
TOC_TYPE = "array<struct<chapter_title:string,anchor_text:string>>"
WEB_TOC_TYPE = "array<struct<chapter_number:int,title:string,start_snippet:string,is_numbered:boolean,section_type:string,page_hint:int>>"


def fuzzy_find(text: Column, anchor: Column, ratio: float = 0.3) -> Column:
    """Where the anchor is in the text: exactly, else the window at a place of its first letters with the least edit
    distance, the first of equals, if that is within the ratio. Letter case is ignored."""
    return let(F.lower(nn(text)), lambda t: let(strip(F.lower(nn(anchor))), lambda a: _found(t, a, ratio)))


def _found(t: Column, a: Column, ratio: float) -> Column:
    exact = F.call_function("locate", a, t)
    most = F.floor(F.length(a) * ratio).cast("int")
    seed = F.substring(a, 1, SEED)
    # the pieces between the places of the seed, overlapping places too; their lengths add up to the places
    parts = F.split(t, F.concat(F.lit("(?="), escape_regex(seed), F.lit(")")))
    ends = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        lambda s: s["out"],
    )
    window = lambda p: F.substring(t, p + 1, F.length(a))
    hits = F.filter(ends, lambda p: F.substring(t, p + 1, F.length(seed)) == seed)
    near = F.transform(hits, lambda p: F.struct(F.call_function("levenshtein", a, window(p), most).alias("d"), p.alias("p")))
    best = F.array_min(F.filter(near, lambda x: x["d"] >= 0))
    return F.when(a == "", F.lit(None).cast("int")).when(exact > 0, exact - 1).when(F.length(a) > SEED, best["p"])


def parse_toc(response: Column, keywords=EXCLUDED_SECTIONS) -> Column:
    """The entries of a model's table of contents, as an array; null if it is no JSON array or has no valid entry.

    Entries that are no objects or lack a key are skipped, and those with an excluded word in their title."""
    get = lambda x, k: strip(F.try_variant_get(x, f"$.{k}", "string"))

    def unfenced(bare: Column) -> Column:
        fenced = strip(F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1))
        return F.when(F.startswith(bare, F.lit("```")), F.when(F.contains(F.substring(bare, 4, 1 << 30), F.lit("```")), fenced).otherwise(strip(F.regexp_replace(bare, "```json|```", "")))).otherwise(bare)

    def entries(raw: Column) -> Column:
        rows = F.transform(raw, lambda x: F.struct(get(x, "chapter_title").alias("chapter_title"), get(x, "anchor_text").alias("anchor_text")))
        kept = lambda r: r["chapter_title"].isNotNull() & r["anchor_text"].isNotNull() & let(F.lower(r["chapter_title"]), lambda t: ~contains_any(t, [k.lower() for k in keywords]))
        return F.filter(rows, kept)

    raw = let(let(strip(nn(response)), unfenced), lambda t: F.from_json(F.when(F.startswith(t, F.lit("[")), t), "array<variant>"))
    return let(let(raw, entries), lambda valid: F.when(F.size(valid) > 0, valid))


def parse_web_toc(response: Column) -> Column:
    """The chapters of a fenced object, of the widest braces, or of a bare array."""
    t = nn(response)
    fenced, braces = F.regexp_extract(t, r"(?s)```json\s*(.*?)```", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    text = F.when(fenced != "", strip(fenced)).when(F.startswith(strip(t), F.lit("[")), strip(t)).when(braces != "", braces).otherwise(t)
    listed = F.from_json(F.when(F.startswith(text, F.lit("[")), text), WEB_TOC_TYPE)
    return F.coalesce(listed, F.from_json(text, f"struct<chapters:{WEB_TOC_TYPE}>")["chapters"])


def toc_positions(text: Column, toc: Column) -> Column:
    """(title, pos) of each entry: by its anchor, else by its title, else null."""
    find = lambda t, x: let(strip(F.lower(nn(x))), lambda a: _found(t, a, 0.3))
    placed = lambda t: F.transform(toc, lambda e: F.struct(e["chapter_title"].alias("title"), F.coalesce(find(t, e["anchor_text"]), find(t, e["chapter_title"])).alias("pos")))
    return let(F.lower(nn(text)), placed)


def chapters_between(text: Column, positions: Column) -> Column:
    """(title, text, start, end) per entry in the order of the table of contents; none is dropped.

    A chapter ends where the next found one starts; one that isn't found starts where the one before ends."""
    return let(nn(text), lambda t: let(positions, lambda p: _between(t, F.length(t), p)))


def _between(t: Column, n: Column, positions: Column) -> Column:
    after = lambda i: F.coalesce(F.get(F.filter(F.transform(F.slice(positions, i + 2, F.size(positions)), lambda p: p["pos"]), lambda p: p.isNotNull()), F.lit(0)), n)
    ends = F.transform(positions, lambda p, i: F.struct(p["title"].alias("title"), p["pos"].alias("pos"), after(i).alias("end")))

    def made(e: Column) -> Column:
        starts = F.transform(e, lambda p, i: F.struct(p["title"].alias("title"), F.coalesce(p["pos"], F.when(i == 0, 0).otherwise(F.get(e, i - 1)["end"])).alias("start"), p["end"].alias("end")))
        text = lambda c: strip(F.substring(t, c["start"] + 1, F.greatest(c["end"] - c["start"], F.lit(0))))
        return F.transform(starts, lambda c: F.struct(c["title"].alias("title"), text(c).alias("text"), c["start"].alias("start"), c["end"].alias("end")))

    return let(ends, made)


def anchor_position(text: Column, title: Column, snippet: Column) -> Column:
    """(pos, strategy) in a text: title, up to 500 characters and five words of the snippet; ten words of the snippet, if
    there are five; the title. White space and letter case don't matter. pos is 1-based and 0 if nothing is found."""
    words = lambda c, k: F.slice(F.filter(F.split(squeeze(nn(c)), " "), lambda w: w != ""), 1, k)
    pattern = lambda ws: F.array_join(F.transform(ws, escape_regex), r"\s+")
    t, s5, s10 = words(title, 1000), words(snippet, 5), words(snippet, 10)
    flags = F.lit("(?iuU)")
    find = lambda p: F.regexp_instr(text, F.concat(flags, p))
    a = F.when((F.size(t) > 0) & (F.size(s5) > 0), find(F.concat(F.lit("(?:"), pattern(t), F.lit(r")[\s\S]{0,500}?"), pattern(s5)))).otherwise(0)
    b = F.when(F.size(s10) >= 5, find(pattern(s10))).otherwise(0)
    c = F.when(F.size(t) > 0, find(pattern(t))).otherwise(0)
    made = lambda pos, name: F.struct(pos.alias("pos"), F.lit(name).alias("strategy"))
    return F.when(a > 0, made(a, "title and snippet")).when(b > 0, made(b, "snippet")).when(c > 0, made(c, "title")).otherwise(made(F.lit(0), "none"))


def chapters_forward(text: Column, chapters: Column, kinds: bool = False) -> Column:
    """(id, title, section_type, text) with a cursor that only goes forward; what isn't found is dropped, nothing found is
    the whole. kinds: the chapters have a section_type; else it is null."""
    return let(nn(text), lambda t: _forward(t, chapters, kinds))


def _forward(t: Column, chapters: Column, kinds: bool) -> Column:
    found_type = "array<struct<title:string,section_type:string,pos:int>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(found_type).alias("out"))
    kind = lambda e: (e["section_type"] if kinds else F.lit(None)).cast("string")

    def step(s: Column, e: Column) -> Column:
        title = F.when(nn(e["title"]) == "", "Unknown Chapter").otherwise(e["title"])
        hit = anchor_position(F.substring(t, s["at"] + 1, F.length(t)), title, e["start_snippet"])["pos"]

        def moved(h: Column) -> Column:
            pos = s["at"] + h - 1
            one = F.struct(e["title"].alias("title"), kind(e).alias("section_type"), pos.cast("int").alias("pos"))
            return F.when(h > 0, F.struct((pos + 1).alias("at"), F.array_append(s["out"], one).alias("out"))).otherwise(s)

        return let(hit, moved)

    def cut(found: Column) -> Column:
        end = lambda i: F.coalesce(F.get(found, i + 1)["pos"], F.length(t))
        return F.transform(found, lambda c, i: F.struct((i + 1).alias("id"), c["title"].alias("title"), c["section_type"].alias("section_type"), strip(F.substring(t, c["pos"] + 1, end(i) - c["pos"])).alias("text")))

    whole = F.array(F.struct(F.lit(1).alias("id"), F.lit("Full Text").alias("title"), F.lit(None).cast("string").alias("section_type"), strip(t).alias("text")))
    found = F.coalesce(F.aggregate(chapters, state, step, lambda s: s["out"]), F.array().cast(found_type))
    return let(let(found, cut), lambda c: F.when(F.size(c) > 0, c).otherwise(whole))
