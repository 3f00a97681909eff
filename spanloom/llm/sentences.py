"""Sentence units of posts in any language, by cascading tables of break and no-break rules.

A text is read in three steps. *Layout* takes away markup and invisible characters (keeping for
every remaining character its place in the text), quote marks, list marks and signature openers,
and cuts the text into blocks no unit may cross: paragraphs, list entries, headings, runs of one
quote depth, attribution lines, signature lines. *Quotes* finds speech set in quotation marks.
*Rules* goes through the candidate positions of a block; at each the tables are asked in order,
language before script before common, and the first rule whose pattern before and pattern after
the position both match decides. Where no rule matches there is no break.

Rows with a null or blank text have no units. Repeated rows are treated one by one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import spread

# ---------------------------------------------------------------- layout

_HARD, _SOFT = "\x1e", "\x0b"  # edge no unit crosses; line break written as markup
_MARK = re.compile(
    r"(?P<head>^[ \t]*\[b\](?=[^\n\[]*\[/b\][ \t]*$))|(?P<tail>(?<=\S)\[/b\](?=[ \t]*$))"
    r"|(?P<soft><br\s*/?>)"
    r"|(?P<hard></?(?:p|div|blockquote|h[1-6]|ul|ol|li|table|tr|td|th|pre|hr)\b[^<>\n]*>|\[/?quote(?:[=\s][^\]\n]*)?\])"
    r"|(?P<tag></?[a-z][a-z0-9]*(?:\s[^<>\n]*)?/?>|<!--.*?-->|\[/?(?:b|i|u|s|url|img|code|size|color|font|center|list|spoiler|email|\*)(?:=[^\]\n]*)?\])"
    r"|(?P<ent>&(?:\#\d{1,7}|\#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,7});)"
    r"|(?P<hide>[­​‎‏⁠﻿‪-‮⁦-⁩]+)",
    re.I | re.M,
)
_QUOTE_MARKS = re.compile(r"(?:[ \t]*[>|])+[ \t]?")
_OPENER = re.compile(r"--|_{3,}")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]+")
_BULLET = re.compile(r"[ \t]*[*\-•‣◦+][ \t]+(?=\S)")
_NUMBER = re.compile(r"[ \t]*(\d{1,3})[.)][ \t]+(?=\S)")


def _strip_markup(text: str) -> tuple[str, array]:
    """The text without markup and, for each of its characters, the end of its place in ``text``."""
    out, at, last, bold = [], array("l"), 0, False
    for m in _MARK.finditer(text):
        kind = m.lastgroup
        sign = ""
        if kind == "head":
            sign, bold = _HARD, True
        elif kind == "tail":
            sign, bold = (_HARD if bold else ""), False
        elif kind == "hard":
            sign = _HARD
        elif kind == "soft":
            sign = _SOFT
        elif kind == "ent":
            sign = html.unescape(m.group())
            if len(sign) != 1:
                continue  # no entity after all: it stays as text
            sign = " " if sign.isspace() else sign
        out.append(text[last : m.start()])
        at.extend(range(last + 1, m.start() + 1))
        if sign:
            out.append(sign)
            at.append(m.end())
        last = m.end()
    out.append(text[last:])
    at.extend(range(last + 1, len(text) + 1))
    return "".join(out), at


def _blocks(clean: str) -> Iterator[tuple[bool, list[tuple[int, int]]]]:
    """(may be split, pieces) of every block; a piece is a range of ``clean``, one per line."""
    lines = []
    start = 0
    for raw in clean.split("\n"):
        m = _QUOTE_MARKS.match(raw)
        lead = m.end() if m else 0
        depth = sum(raw.count(c, 0, lead) for c in ">|")
        lines.append((depth, start + lead, start + len(raw), raw[lead:]))
        start += len(raw) + 1
    block: list[tuple[int, int]] = []
    depth_now, signature, number = -1, False, 0

    def flush():
        nonlocal block
        done, block = block, []
        return [(True, done)] if done else []

    for i, (depth, a, b, body) in enumerate(lines):
        bare = body.strip().strip(_HARD + _SOFT).strip()
        if not bare:
            if _HARD in body:
                block.append((a, b))
            yield from flush()
            signature, number = False, 0
            continue
        if depth != depth_now:
            yield from flush()
            depth_now, signature, number = depth, False, 0
        if signature:
            yield False, [(a, b)]
            continue
        if _OPENER.fullmatch(body.strip()):
            yield from flush()
            signature = True
            continue
        if (m := _HEADING.match(body)) is not None:
            yield from flush()
            yield False, [(a + m.end(), b)]
            continue
        if (m := _BULLET.match(body)) is not None:
            yield from flush()
            block = [(a + m.end(), b)]
            continue
        m = _NUMBER.match(body)
        if m is not None and (int(m[1]) == number + 1 and (number or not block)):
            yield from flush()
            number = int(m[1])
            block = [(a + m.end(), b)]
            continue
        deeper = i + 1 < len(lines) and lines[i + 1][0] > depth and lines[i + 1][3].strip() != ""
        if deeper and (bare.endswith((":", "：")) or bare.startswith("Quote by ")):
            yield from flush()
            yield False, [(a, b)]
            continue
        block.append((a, b))
    yield from flush()


# ---------------------------------------------------------------- quotes

_SPEECH = re.compile(
    r"„[^“”„]*[“”]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|《[^《》]*》"
    r'|(?<![^\s(\[{—–>*_])"(?=\S)[^"]*(?<=\S)"(?![\w"])'
    r"|(?<![\w'])'(?=\w)(?:[^']|(?<=\w)'(?=\w))*(?<=[.!?…,])'(?!\w)"
)

# ---------------------------------------------------------------- rules

_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
_THAI, _DEVA, _ARAB = "฀-๿", "ऀ-ॿ", "؀-ۿ"
# Signs of the scripts that end a sentence wherever they stand (Devanagari, Arabic, Urdu,
# Armenian, Ethiopic, Burmese, Khmer, Mongolian, Tibetan, Syriac, Canadian, Ol Chiki, Lisu, Vai, Meetei).
_FULL_STOPS = "।॥؟۔։።፧፨။។៕᠃᠉༎܀܁܂᙮᱾᱿꓿꘎꘏꫰꯫"
_END = rf"(?:\.(?:[ ]\.)+|[.!?…‽⸮‼⁇⁈⁉。！？｡．{_FULL_STOPS}]+)"
_CLOSE = r"[\"'”’“»›)\]」』》〉）】]*"
_QUOTED = r"[\"'”’“»›」』》〉]"
_CANDIDATE = re.compile(rf"{_END}(?:[\"'”’»›)\]」』》〉）】]|(?<=[.!?…])“(?=[\s.,;)\x1e]|$))*")


def _of_category(*kinds: str) -> str:
    """The inside of a character class: all characters of the Unicode categories, as ranges."""
    out, start, last = [], None, None
    for k in (*(k for k in range(0x20000) if unicodedata.category(chr(k)) in kinds), -9):
        if last is not None and k != last + 1:
            out.append(f"\\U{start:08x}" + (f"-\\U{last:08x}" if last > start else ""))
            start = k
        start, last = (k if start is None else start), k
    return "".join(out)


_UPPER, _LOWER = _of_category("Lu", "Lt"), _of_category("Ll")
#: Letters of scripts without case; Georgian has capitals that running text does not use.
_CASELESS = _of_category("Lo").replace("\\U000000aa", "").replace("\\U000000ba", "") + "\u10d0-\u10ff"
_GAP = r"[ \t\n\x0b 　 - ]"
_OPENS = r"[\"'“„«‘(\[{*_`~¿¡]*"

# Abbreviations and months of the languages. "never": no sentence ends here;
# "open": one may, if what follows does not go on; "number": only before a number.
ABBREVIATIONS = {
    "en": {
        "never": "Mr Mrs Ms Dr Prof St Rev Hon Gen Sen Rep Gov Lt Col Sgt Capt Messrs vs cf viz i.e e.g approx ca esp",
        "open": "etc Inc Ltd Co Corp Bros al a.m p.m A.M P.M Jr Sr Ph.D U.K U.S U.N U.S.A E.U D.C",
        "number": "No Nos no fig figs Fig Figs p pp vol Vol ch Ch sec eq art Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    },
    "de": {
        "never": "Dr Prof Hr Hrn Fr Nr St bzw ca vgl z.B d.h u.a o.g i.d.R v.a bzgl evtl ggf inkl sog Str Abb Bd Kap Mio Mrd z d u o v",
        "open": "usw etc u.s.w o.ä",
        "number": "S Art Abs Nr Bd",
    },
    "es": {
        "never": "Sr Sra Srta Sres Dr Dra Dn Avda Av aprox pág págs núm p.ej p art cap vol tel Ud Uds",
        "open": "etc EE.UU EE.VV",
        "number": "pág núm n",
    },
    "fr": {
        "never": "M MM Mme Mmes Mlle Mlles Me Dr Pr St Ste Mgr c.-à-d env av apr bd cf p.ex",
        "open": "etc J.-C Cie S.A.R.L",
        "number": "p pp n no art chap vol fig tél",
    },
    "it": {
        "never": "sig dott prof ing avv Sig Sigg Dott Dott.ssa Prof Prof.ssa Ing Avv On Rag Geom Egr Gent Spett p.es ad.es cfr ca S",
        "open": "ecc a.C d.C S.p.A S.r.l",
        "number": "n nn p pp pag pagg art artt cap vol fig tel",
    },
    "pt": {
        "never": "Sr Sra Srta Srs Dr Dra Prof Profa Eng Exmo Exma Av R aprox p.ex",
        "open": "etc a.C d.C Ltda Cia S.A",
        "number": "p pp pág págs n nº art cap vol fig tel",
    },
    "pl": {
        "never": "prof dr hab mgr inż ks św ul al pl os np m.in tzn tzw tj por zob ok ppłk płk gen im",
        "open": "itd itp r w zł godz tys mln mld p.n.e n.e",
        "number": "nr s str art ust pkt t rozdz rys tab godz",
    },
    "cyrl": {
        "never": "им ул пл просп пер наб проф акад доц т.е т.к т.н напр см ср гр гос св о-в тел",
        "open": "т.д т.п др пр г гг в вв руб коп тыс млн млрд н.э р км м ч мин сек",
        "number": "с стр рис табл гл п пп кв корп д ст",
    },
    "el": {"never": "κ κα κ.κ δρ καθ π.χ δηλ λ.χ αγ", "open": "κ.λπ κ.ά κτλ κλπ π.Χ μ.Χ", "number": "σελ αρ τηλ σ"},
    "he": {"never": "ד\"ר פרופ' גב' עמ'", "open": "וכו' וגו'", "number": "עמ מס ס"},
    "hi": {"never": "कि.मी कि.ग्रा डॉ श्री श्रीमती प्रो पं कु नं रु सं", "open": "", "number": ""},
    "ar": {"never": "", "open": "", "number": ""},
}
MONTHS_DE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"
#: Words that carry on a sentence after quoted speech, an abbreviation or dots of omission.
CARRY_ON = {
    "quote": "but so and or then und y e o pero entonces luego aber da dann doch कहा बोला बोली बोले पूछा और लेकिन पर तो ثم قال قالت و لكن فقال",
    "open": "and or also which who that today tomorrow yesterday und auch y también e o der die das",
    "dots": "and or well but so then not und oder also y o pero",
}


def _any(words: str) -> str:
    return "(?:" + "|".join(re.escape(w).replace(r"\.", r"\.[ ]?") for w in sorted(words.split(), key=len, reverse=True)) + ")"


def _abbreviations(lang: str, lower: bool) -> list[tuple[bool, str, str]]:
    a, rules = ABBREVIATIONS[lang], []
    if a["number"]:
        rules.append((False, rf"(?<![\w.]){_any(a['number'])}\.$", rf"{_GAP}+\d"))
    if a["never"]:
        rules.append((False, rf"(?<![\w.]){_any(a['never'])}\.$", rf"{_GAP}+\S"))
    if a["open"]:
        goes_on = _any(CARRY_ON["open"]) + r"\b" if lower else rf"[{_LOWER}]"
        rules.append((False, rf"(?<![\w.]){_any(a['open'])}\.$", rf"{_GAP}+{goes_on}"))
    return rules


def _table(lang: str, lower: bool) -> list[tuple[bool, str, str]]:
    """The rules (breaks, before, after) of one language or script, in order."""
    if lang in ("en", "es"):
        first = [(False, r"(?<![\w.])EE\.$", rf"{_GAP}+[A-Z]{{2}}\.")] if lang == "es" else []
        return first + _abbreviations(lang, lower)
    if lang == "de":
        months = "(?:" + MONTHS_DE.replace(" ", "|") + r")\b"
        return [
            (False, r"(?<![\w.,])\d{1,2}\.$", rf"{_GAP}+(?:{months}|\d{{1,2}}\.)"),
            (False, r"(?<![\w.,])\d{1,2}\.[ \n]\d{1,2}\.$", rf"{_GAP}+[a-zß-ÿ\d]"),
            *_abbreviations(lang, lower),
        ]
    if lang in ("hi", "fr", "it", "pt", "pl", "cyrl", "he"):
        return _abbreviations(lang, lower)
    if lang == "el":  # the Greek question mark looks like a semicolon
        return [*_abbreviations(lang, lower), (True, rf"[;\u037e]{_CLOSE}$", rf"{_GAP}+{_OPENS}(?:[{_UPPER}]|\d)")]
    if lang == "ko":  # what was said, taken up by a particle
        return [(False, rf"[.!?…]{_QUOTED}$", rf"{_GAP}*(?:이?라고|이?라며|이?라는|하고|하며|고\b|며\b)")]
    if lang == "ar":
        return [(False, rf"(?<!\w)[{_ARAB}]\.$", rf"{_GAP}+\S")]
    if lang == "cjk":
        return [
            (False, rf"[{_CJK}、，][.…]+$", r"[\s\S]"),
            (False, r"^[.…]+$|[^.!?。！？｡][.…]+$", rf"[{_CJK}]"),
            (False, rf"[。！？｡!?]{_QUOTED}$", r"[的地得之这這那是と、，はがをにのもで]|って|という"),
            (True, rf"[。！？｡][!?！？。｡]*{_CLOSE}$", r"[\s\S]"),
            (True, rf"[{_CJK}][.!?]+{_CLOSE}$", rf"[{_CJK}]"),
        ]
    if lang == "thai":
        near = r"[0-9A-Za-z๐-๙ๆ]"
        return [
            (False, near + "$", rf"{_GAP}+\S"),
            (False, r"\S$", rf"{_GAP}+[0-9A-Za-z๐-๙ๆ]"),
            (True, r"\S$", rf"{_GAP}*[ \t 　]{_GAP}*\S"),
        ]
    # common
    letter = r"[^\W\d_]"
    upper = rf"[{_UPPER}]"
    caseless = rf"[{_CJK}{_THAI}{_DEVA}{_ARAB}{_CASELESS}]"
    dots = r"(?:\.[ ]?\.(?:[ ]?\.)*|…+)"
    rules: list[tuple[bool, str, str]] = [
        (False, r"[\s\S]$", rf"{_GAP}*[,;:，、；]"),
        (False, rf"(?<![\w.]){upper}\.$", rf"{_GAP}+{upper}"),
        (False, dots + r"$", rf"{_GAP}+{_any(CARRY_ON['dots'])}\b"),
        (False, rf"{_END}\)?{_QUOTED}+\)?$", rf"{_GAP}+{_any(CARRY_ON['quote'])}(?!\w)"),
        (True, rf"{letter}{{2}}[.!?…]+{_CLOSE}$", rf"{_OPENS}{upper}{letter}|[¿¡(«„“]"),
        (True, rf"[{_FULL_STOPS}!]+{_CLOSE}$", rf"{_GAP}*{letter}"),
        (True, rf"{_END}{_CLOSE}$", rf"{_GAP}+{_OPENS}(?:{upper}|\d|{caseless})"),
        (True, rf"{_END}{_CLOSE}$", rf"{_GAP}+(?:[(¿¡„«]|[^\w\s\x1e,;:.!?…)\]}}>&%=+*/|~^-])"),
    ]
    if lower:
        # text written without capitals: any word starts a sentence
        names = r"(?:cfg|txt|example|com|org|net|html?|php|js|py|md|exe|zip|ini|log|json|xml|csv|pdf|io|de|es|co|uk|me)"
        rules += [
            (True, rf"(?<![\w./@:-]){letter}{{2,}}[.!?…]+{_CLOSE}$", rf"(?!{names}\b){letter}{{2,}}(?![\w./@:])"),
            (True, rf"{_END}{_CLOSE}$", rf"{_GAP}+{_OPENS}[{_LOWER}]"),
        ]
    return rules


@lru_cache(maxsize=64)
def _cascade(key: tuple[str, ...], lower: bool) -> list[tuple[bool, re.Pattern, re.Pattern]]:
    return [(b, re.compile(x), re.compile(y)) for lang in key for b, x, y in _table(lang, lower)]


# Frequent words that tell the languages in Latin letters apart.
_COMMON_WORDS = {
    "en": {"the", "and", "with", "this", "that", "for", "was", "is", "we", "they", "of", "to", "but", "never", "always"},
    "de": {"der", "die", "das", "und", "nicht", "mit", "ist", "wir", "sie", "ein", "eine", "oder", "immer", "jetzt", "nach"},
    "es": {"el", "la", "los", "y", "de", "que", "con", "sin", "una", "un", "por", "pero", "siempre", "muy", "ahora"},
}
# Words that speak for further languages; their tables are asked only where they fit best.
_TELLING_WORDS = {
    "fr": {"le", "les", "des", "et", "est", "une", "dans", "pour", "qui", "sur", "pas", "avec", "du", "nous", "vous", "à", "au", "elle", "ce", "cette"},
    "it": {"il", "di", "che", "è", "per", "non", "sono", "della", "gli", "anche", "più", "nel", "alla", "del", "questo"},
    "pt": {"os", "não", "uma", "com", "em", "do", "da", "é", "ele", "ela", "muito", "são", "você", "mas", "isso"},
    "pl": {"nie", "się", "jest", "że", "przez", "jak", "ale", "oraz", "są", "był", "była", "tylko", "już", "także", "mały"},
}
_SCRIPTS = {"cjk": _CJK, "thai": _THAI, "hi": _DEVA, "ar": _ARAB, "cyrl": "\u0400-\u052f", "el": "\u0370-\u03ff\u1f00-\u1fff", "he": "\u0590-\u05ff", "ko": "\uac00-\ud7a3"}
_HAS = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}
#: Characters before a run of end marks that the rules look at: the longest abbreviation and some room.
_REACH = 32 + max(len(w) for a in ABBREVIATIONS.values() for k in a.values() for w in k.split()) * 2
_GREEK_CANDIDATE = re.compile(rf"[;\u037e]{_CLOSE}(?=\s)")
_WORD = re.compile(r"[^\W\d_]+")
_CASED = re.compile(rf"[{_UPPER}{_LOWER}]")
_START = re.compile(rf"(?<=[^\W\d_]{{2}})[.!?]+{_CLOSE}{_GAP}+{_OPENS}([{_UPPER}{_LOWER}])")
_NOT_START = re.compile(rf"(?<![\w.])(?:{'|'.join(_any(a[k]) for a in ABBREVIATIONS.values() for k in a if a[k])})\.[\"'”’“»›)\]]*$")


def _languages(block: str) -> tuple[str, ...]:
    """The tables to ask, in order: scripts first seen in the block, then the likeliest language."""
    scripts = [k for k, p in _HAS.items() if p.search(block)] if not block.isascii() else []
    words = set(_WORD.findall(block.lower())) if _CASED.search(block) else set()
    latin = sorted(_COMMON_WORDS, key=lambda k: -len(words & _COMMON_WORDS[k])) if words else []
    if words:
        hits = {k: len(words & w) for k, w in _TELLING_WORDS.items()}
        if max(hits.values()) > len(words & _COMMON_WORDS[latin[0]]):
            latin = [*(k for k in hits if hits[k] == max(hits.values())), *latin]
    return (*latin, *scripts, "common")


def _without_capitals(block: str) -> bool:
    first = _CASED.search(block)
    if not first or not first.group().islower():
        return False
    low = high = 0
    for m in _START.finditer(block):
        marks = m.group()[:-1].rstrip(" \t\n\x0b\xa0(\"'“„«")
        if _NOT_START.search(block, max(0, m.start() - _REACH), m.start() + len(marks)):
            continue
        if any(q in m.group() for q in "\"'”“»"):
            continue
        if m.group(1).islower():
            low += 1
        else:
            high += 1
    return low >= high


def _split_block(block: str) -> list[int]:
    """Ends of the units of a block (without the last)."""
    ends = []
    key = _languages(block)
    rules = _cascade(key, _without_capitals(block))
    speech = [(m.start(), m.end()) for m in _SPEECH.finditer(block)] if not block.isascii() or '"' in block or "'" in block else []
    starts = [s for s, _ in speech]

    def in_speech(p: int) -> bool:
        i = bisect_right(starts, p - 1) - 1
        return i >= 0 and speech[i][0] < p < speech[i][1]

    spots = {m.end(): m.start() for m in _CANDIDATE.finditer(block)}
    if "el" in key:
        spots |= {m.end(): m.start() for m in _GREEK_CANDIDATE.finditer(block)}
    if "thai" in key:
        gaps = (m.start() for m in re.finditer(rf"(?<=\S){_GAP}+(?=\S)", block) if re.match(f"[{_THAI}]", block[m.start() - 1]) or re.match(f"[{_THAI}]", block[m.end()]))
        spots |= {p: p for p in gaps if p not in spots}
    for p in sorted(spots):
        if p >= len(block) or in_speech(p):
            continue
        reach = max(0, spots[p] - _REACH)  # marks, however many, and what may stand before them
        for breaks, x, y in rules:
            if y.match(block, p) and x.search(block, reach, p):
                if breaks:
                    ends.append(p)
                break
    return ends


def unit_ends(text: str | None) -> list[int]:
    """For each sentence unit, the code points up to and including its last visible character."""
    if not text or text.isspace():
        return []
    clean, at = _strip_markup(text.replace("\r", " ") if "\r" in text else text)
    out: list[int] = []
    for splits, pieces in _blocks(clean):
        body = "\n".join(clean[a:b] for a, b in pieces)
        place = array("l")
        for k, (a, b) in enumerate(pieces):
            if k:
                place.append(0)
            place.extend(at[a:b])
        start = 0
        for part in body.split(_HARD):
            inner = _split_block(part) if splits else []
            last = 0
            for e in (*inner, len(part)):
                visible = len(part[:e].rstrip())
                if visible > last and part[last:visible].strip():
                    out.append(place[start + visible - 1])
                last = e
            start += len(part) + 1
    return out


def sentence_units(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, unit_no, end_pos[, unit])`` for every sentence unit of every document.

    Runs row by row in Arrow batches, without a shuffle (but for an input in fewer splits than
    there are cores). ``end_pos`` counts code points; ``unit`` is the text between the end of the
    unit before and this one, trimmed. Null and blank texts give no row, other columns are ignored,
    a text of any length is read whole.
    """
    schema = "_id string, unit_no int, end_pos int" + (", unit string" if with_text else "")
    id_type = dict(df.dtypes)[doc_id]

    def run(batches):
        for b in batches:
            ids, nos, ends, units = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = unit_ends(t)
                ids.extend([i] * len(found))
                nos.extend(range(1, len(found) + 1))
                ends.extend(found)
                if with_text:
                    units.extend(t[a:e].strip() for a, e in zip([0, *found], found))
            cols = [pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(ends, pa.int32())]
            names = ["_id", "unit_no", "end_pos"]
            if with_text:
                cols.append(pa.array(units, pa.string()))
                names.append("unit")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = spread(df.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_t"))).mapInArrow(run, schema)
    return rows.select(F.col("_id").cast(id_type).alias(doc_id), *rows.columns[1:])


__all__ = ["sentence_units", "unit_ends", "ABBREVIATIONS"]
