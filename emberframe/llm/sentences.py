"""Sentence boundaries across languages and scripts, by cascading rule tables (problem 9).

A paragraph (text between blank lines) is read for terminators. At each one, unless it stands inside a quotation or
bracket, the tables of the paragraph's language are tried in order: its own, those of its script, those for all. A rule
is (decision, before, after): two regular expressions, matched backwards from the end of the terminator and its
closing quotes, and forwards from there. The first rule that matches both decides the position.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

BREAK, STAY = True, False

_TERMINATORS = re.compile("[.!?…。！？．｡।॥؟۔]+(?:[ \u00a0\u202f](?=[!?]))?[.!?…。！？．｡।॥؟۔]*")
_BLANK_LINE = re.compile("\r?\n[^\\S\n]*\n\\s*| ")
_OPENERS = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "‹": "›", "‘": "’", "‚": "‘’", "〈": "〉", "《": "》", "»": "«"}
_BRACKETS = {"(": ")", "[": "]", "（": "）", "【": "】", "［": "］", "〔": "〕"}
_MARKS = re.compile("[\"'«»“”„‘’‚「」『』‹›〈〉《》()\\[\\]（）【】［］〔〕]")
_CLOSING = set("\"'»”“«’‘」』›〉》)]）】］〕")


# A rule's left side is matched backwards from the terminator, on the reversed paragraph, and its right side forwards,
# so that both see as far as they need, back to the sentence's start and on to the paragraph's end, and cost no more
# than what they match. Possessive quantifiers keep long runs of blanks linear.
_EDGE = r"(?=[\s(\[\"'«“„‘¿¡/-]|\Z)"
_MARK = "[̀-ͯ]*+"


def _reversed(name: str) -> str:
    """A name as it stands in reversed text, with accents composed or not; a blank in it may be missing or wide."""
    forms = dict.fromkeys(unicodedata.normalize(f, name)[::-1] for f in ("NFC", "NFD"))
    return "|".join(re.escape(x).replace(r"\ ", r"\s*+") for x in forms)


def _names(*names: str) -> str:
    """One of the names as a whole word."""
    return f"(?:{'|'.join(map(_reversed, names))}){_EDGE}"


def _abbreviations(*names: str) -> str:
    return r"\." + _names(*names)


_DIGIT = r"\s*+[\dIVXivx]"
_WORD_AFTER = r"\s++\S"

# Common abbreviations by language. Those of the first kind precede a name or word and never end a
# sentence, those of the second stay with a number after them.
_TITLES = {
    "en": "Dr Mr Mrs Ms Prof St Mt Ft Capt Lt Sgt Col Gen Rev Hon Sen Rep Gov Maj Cmdr Adm Cpl Pvt Supt Insp Messrs e.g i.e cf vs viz ca approx".split(),
    "es": ["Sr", "Sra", "Srta", "Sres", "Dr", "Dra", "Dres", "Ing", "Lic", "Arq", "Prof", "Gral", "Cap", "Cnel", "Tte", "Sto", "Sta", "Ud", "Uds", "Vd", "D", "Dña", "aprox", "p. ej", "ej", "máx", "mín", "Av", "Avda", "dpto"],
    "de": ["Dr", "Prof", "Hr", "Hrn", "Fr", "Hptm", "Ltn", "Lt", "Ofw", "Gen", "St", "Dipl", "Ing", "ca", "bzw", "vgl", "bspw", "evtl", "ggf", "inkl", "exkl", "max", "min", "sog", "u. a", "z. B", "d. h", "z. T", "o. ä", "i. d. R", "s. o", "s. u", "v. a", "u. U"],
    "fr": ["M", "MM", "Mme", "Mlle", "Mmes", "Dr", "Pr", "Me", "Mgr", "St", "Ste", "env", "p. ex", "cf", "av", "bd", "c.-à-d", "Cdt", "Cne", "Col", "Gal", "Lt"],
    "pt": ["Sr", "Sra", "Srta", "Exmo", "Exma", "Ilmo", "Ilma", "Dr", "Dra", "Prof", "Profa", "Eng", "Gen", "Cap", "Cel", "Ten", "Sgt", "D", "Av", "p. ex", "aprox", "máx", "mín"],
    "it": ["sig", "Sig", "sigg", "Sigg", "dott", "ing", "avv", "Dott", "Prof", "Ing", "Avv", "Arch", "Gen", "Col", "Cap", "Ten", "On", "Mons", "ad es", "p. es", "ca", "cfr", "max", "min"],
    "nl": ["Dhr", "dhr", "Mevr", "mevr", "Dr", "dr", "Prof", "prof", "Ir", "ir", "Mr", "mr", "Drs", "drs", "St", "bijv", "bv", "d.w.z", "o.a", "ca", "max", "min", "resp"],
    "tr": ["Dr", "Prof", "Doç", "Sn", "Av", "Alb", "Yzb", "örn", "bkz"],
    "hi": ["डॉ", "श्री", "श्रीमती", "प्रो", "पं", "सु", "कु", "स्व"],
    "ar": ["د", "أ", "أ.د", "م", "ص", "ج", "ت"],
    "ru": ["г", "гг", "им", "ул", "д", "кв", "проф", "акад", "т. е", "т. д", "т. п", "тов", "гр"],
}
_NUMBERED = {
    "en": "No Nos Fig Figs Sec Secs Ch Vol p pp Art Eq Tab Ref App Para Pt Nr".split(),
    "es": "pág págs p pp núm núms art arts fig figs cap vol n nº tel".split(),
    "de": "Nr Nrn Abb Abs Art Tab Kap Bd S Anm Anl Tel Str".split(),
    "fr": "p pp art fig n no nº vol chap ch réf tél al".split(),
    "pt": "pág págs p pp núm n nº art fig cap vol tel".split(),
    "it": "pag pagg p pp n nn art fig cap vol tel".split(),
    "nl": "nr nrs blz p art fig hfdst tel".split(),
    "tr": "No no s sf md".split(),
    "ru": "рис стр с гл п см табл".split(),
}
# Words that begin a sentence and are no names, so that a letter or title with an article before it, as in
# "a D. Then", ended one; and articles, which a name of a person doesn't follow.
_STARTERS = {
    "en": "The Then They We This These Those That It He She But And If When There".split(),
    "es": "El Ella Ellos Luego Después Pero Se Nadie Cuando Entonces Hay".split(),
    "de": "Der Die Das Dann Wir Sie Er Es Aber Und Wenn Danach Niemand".split(),
    "fr": "Il Elle Ils Elles On Puis Nous Mais Cette Ensuite Quand Personne".split(),
}
_ARTICLES = {"en": "the a an".split(), "es": "el la un una los las".split(), "de": "der die das den dem ein eine".split(), "fr": "le la un une les".split()}
#: Abbreviations of the first kind that are no titles; a starter may follow them within the sentence.
_LINKING = {*"e.g i.e cf vs viz ca approx ej aprox c.-à-d env bzw vgl bspw evtl ggf inkl exkl sog".split(), "p. ej", "p. ex", "u. a", "z. B", "d. h", "z. T", "o. ä", "i. d. R", "s. o", "s. u", "v. a", "u. U"}

_START = r"\s*+[\"'«“„‘‚「『‹(\[（¿¡—–-]*+\s*+"
_UPPER = rf"{_START}(?:[A-ZÀ-ÖØ-ÞĀ-ŽͰ-ϿЀ-Я\d]|(?<=[¿¡]))"
_LOWER = r"\s*+[\"'»”’)\]]*+\s*+[a-zß-öø-ÿа-я]"

#: Languages told apart by function words; _TABLED have a table besides and count where they are stated.
_LATIN = ("en", "es", "de", "fr")
_TABLED = ("pt", "it", "nl", "tr")
#: Where neither words nor the stated language tell, all of these are tried.
_NEUTRAL = "neutral"

RULES: dict[str, list[tuple[bool, str, str]]] = {
    lang: [
        (STAY, _abbreviations(*_TITLES.get(lang, ["\0"])), _WORD_AFTER),
        (STAY, _abbreviations(*_NUMBERED.get(lang, ["\0"])), _DIGIT),
    ]
    for lang in {*_TITLES, *_NUMBERED}
}
for _lang, _words in _STARTERS.items():
    _next = rf"\s++(?:{'|'.join(_words)})\b"
    _article = rf"\s++{_names(*_ARTICLES[_lang])}"
    _sure = "|".join(_reversed(t) for t in _TITLES[_lang] if t not in _LINKING)
    RULES[_lang].insert(0, (BREAK, rf"\.(?:{_sure}|{_MARK}[A-ZÀ-ÖØ-Þ]){_article}", _next))
_DE_BEFORE = "der die das dem den des am vom zum zur im ab bis seit jede jeder jeden jedes ein eine einem einen einer".split()
RULES["de"] += [
    # An ordinal: after an article or preposition, or before the name of a month.
    (STAY, rf"\.\d{{1,3}}\s++(?i:{'|'.join(map(_reversed, _DE_BEFORE))})(?=\s|\Z)", r"\s++\w"),
    (STAY, r"\.\d{1,2}(?!\w)", r"\s++(?:Januar|Februar|M(?:ä|ä)rz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert)\b"),
]
RULES["latin"] = [
    # The first part of an abbreviation of several letters.
    (STAY, rf"\.{_MARK}[a-zäöü](?=[\s(,]|\Z)", r"\s*+[A-Za-z]{1,2}\.(?!\w)"),
    # Initials of a name, and letters with dots in a row, before a name.
    (STAY, rf"\.{_MARK}[A-ZÀ-ÖØ-Þ](?=[\s(\[\"'«“„‘.-]|\Z)", r"\s++[A-ZÀ-ÖØ-Þ]"),
    (STAY, r"", _LOWER),
    (BREAK, r"", _UPPER),
]
RULES["ja"] = [(STAY, r"[」』”]", r"\s*+(?:と|って|との|という|など|の|を|は|が|に|で|も)")]
RULES["zh"] = [(STAY, r"[”」』]", r"\s*+(?:的|地|，|、|；)")]
RULES["unspaced"] = [
    (STAY, r"…", r"\s*+[，、,；;：:]"),
    (STAY, r"[.]", r"\S"),
    (BREAK, r"", r""),
]
RULES["any"] = [
    # A dot with something right behind it belongs to a number, a name or a file.
    (STAY, r"[.]", r"\S"),
    (STAY, r"[!?…]", r"[,;:]"),
    (BREAK, r"", r""),
]

#: In Thai a blank between words; the sign of repetition after a blank goes on with the word.
_THAI_BLANK = re.compile(r"(?<![\d\s])[^\S\n]++(?![\d\s])")
_REPEATED = re.compile("\\s*+ๆ")

_TABLES: dict[str, list] = {}


def _table(lang: str) -> list:
    """The cascade of a language: its own table, that of its script, and all's. Without a language all Latin tables are tried."""
    if lang not in _TABLES:
        if lang in _LATIN or lang in _TABLED:
            names = [lang, "latin", "any"]
        elif lang == _NEUTRAL:
            names = [*_LATIN, *_TABLED, "latin", "any"]
        elif lang in ("ja", "zh"):
            names = [lang, "unspaced"]
        elif lang == "ru":
            names = ["ru", "latin", "any"]
        else:
            names = [lang, "any"]
        early = [RULES["any"][0]] if names[-1] == "any" else []
        rules = early + [r for n in names for r in RULES.get(n, [])]
        # Rules in a row that decide alike may be tried in any order, so those with the same right side become one.
        merged: list[tuple[bool, list[str], str]] = []
        for d, b, a in rules:
            at = next((i for i in range(len(merged) - 1, -1, -1) if merged[i][0] != d), -1)
            same = next((m for m in merged[at + 1 :] if m[2] == a and b and m[1][0]), None)
            if same:
                same[1].append(b)
            else:
                merged.append((d, [b], a))
        _TABLES[lang] = [(d, re.compile("|".join(b)).match if b[0] else None, re.compile(a).match if a else None) for d, b, a in merged]
    return _TABLES[lang]


_SCRIPTS = (
    ("th", re.compile("[฀-๿]+")),
    ("hi", re.compile("[ऀ-ॿ]+")),
    ("ar", re.compile("[؀-ۿ]+")),
    ("ja", re.compile("[぀-ヿ]+")),
    ("zh", re.compile("[㐀-鿿]+")),
    ("ru", re.compile("[Ѐ-ӿ]+")),
)

_OTHER_SCRIPTS = re.compile("|".join(r.pattern[:-1] for _, r in _SCRIPTS))

# Frequent function words by which Latin-script paragraphs are told apart.
_WORDS = {
    "en": set("the of and to a in is was at by for on with that this from were near not did who we then it an or but had into".split()),
    "es": set("el la los las de del que en y un una se con por para según su al hay como a desde hacia más pero fue sobre".split()),
    "de": set("der die das und den dem des ein eine ist nicht mit von vom zu auf am im bei wer es nach für aus sich bis nur".split()),
    "fr": set("le la les de des du et un une est dans pour sur qui que à au il selon près a en ce cette pas ne vers depuis par avec".split()),
}
_LETTERS = re.compile(r"[^\W\d_]+")
#: Codes of languages in Latin script whose function words aren't listed, so that a text stated to be in one isn't taken for another.
_KNOWN = set("pt it nl tr ca gl eu ro pl cs sk sl hr bs sq hu fi et lv lt sv da nb nn no is ga cy mt vi id ms tl sw af az uz eo la ko".split())
_LANGUAGES_OF = {w: [k for k, v in _WORDS.items() if w in v] for v in _WORDS.values() for w in v}


def language(paragraph: str, lang: str | None) -> str:
    """The language whose rules a paragraph gets: by its script and, in Latin script, its function words.

    The stated language decides only between languages of the paragraph's own script. One that function words don't tell, but
    that has a table, or none ("neutral"), gets it unless the words clearly speak for another.
    """
    stated = (lang or "").strip().lower()[:2]
    if _OTHER_SCRIPTS.search(paragraph):
        letters = sum(map(str.isalpha, paragraph)) or 1
        counts = {name: len("".join(r.findall(paragraph))) for name, r in _SCRIPTS}
        if counts["ja"] and counts["ja"] + counts["zh"] > 0.3 * letters:
            return "ja"
        if counts["zh"] > 0.3 * letters:
            return "ja" if stated == "ja" else "zh"
        best = max(counts, key=counts.get)
        if counts[best] > 0.3 * letters:
            return best
    seen = _LETTERS.findall((paragraph if paragraph.isascii() else unicodedata.normalize("NFC", paragraph)).lower())
    score = dict.fromkeys(_WORDS, 0)
    for w in seen:
        for k in _LANGUAGES_OF.get(w, ()):
            score[k] += 1
    if stated not in _LATIN and stated in _KNOWN and 4 * max(score.values()) < len(seen):
        return stated if stated in _TABLED else _NEUTRAL
    top = max(score, key=lambda k: (score[k], k == stated, k == "en"))
    if score[top] > 1 or score[top] and top == stated:
        return top
    return stated if stated in _LATIN and not score[top] else _NEUTRAL


def _pairs(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Quotations and brackets as (opening, closing) positions; marks without a partner in the paragraph are ignored."""
    quotes, brackets, stack = [], [], []
    # Where in the stack each closing mark is waited for; so a text of marks without partners costs no more than others.
    waits: dict[str, list[int]] = {}

    def push(i: int, closes: str) -> None:
        for c in closes:
            waits.setdefault(c, []).append(len(stack))
        stack.append((i, closes))

    for m in _MARKS.finditer(text, lo, hi):
        c, i = m[0], m.start()
        before = text[i - 1] if i > lo else " "
        after = text[i + 1] if i + 1 < hi else " "
        depth = waits[c][-1] if waits.get(c) else None
        if c in "'’" and before.isalnum() and after.isalnum():
            continue
        if c in "'\"" and (depth is None or before.isspace()):
            # A straight mark opens where a word begins and none of its kind is open.
            opens = not after.isspace() and (before.isspace() or not before.isalnum())
            if depth is None:
                if opens:
                    push(i, c)
                continue
        if depth is not None:
            o, closes = stack[depth]
            while len(stack) > depth:
                for x in stack.pop()[1]:
                    waits[x].pop()
            (brackets if closes in _BRACKETS.values() else quotes).append((o, i))
        elif c in _OPENERS and not (c == "»" and before.isalnum()):
            push(i, _OPENERS[c])
        elif c in _BRACKETS:
            push(i, _BRACKETS[c])
    return quotes, brackets


# Verbs that name a speaker after a quotation, when the next word is written with a capital.
_SPEECH = re.compile(
    r"(?i)(?:\S++\s++){0,4}?(?:said|says|asked|shouted|replied|cried|wrote|told|answered|added|warned|called|sagte|fragte|rief|schrieb|meinte|antwortete"
    r"|dijo|preguntó|gritó|respondió|anotó|añadió|demanda|dit|répondit|cria|lança|écrivit|ajouta)\b"
)


def segment(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points; end is behind its last character, white space not counted."""
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        _paragraph(text, at, end, lang, out)
        at = m.end() if m else end
    return out


def _paragraph(text: str, lo: int, hi: int, lang: str | None, out: list[tuple[int, int]]) -> None:
    while lo < hi and text[lo].isspace():
        lo += 1
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    if lo == hi:
        return
    name = language(text[lo:hi], lang)
    rules = _table(name)
    quotes, brackets = _pairs(text, lo, hi)
    closing = {b: a for a, b in [*quotes, *brackets]}
    quoted = {a for a, _ in quotes}
    # Openings in order, and how far the spans that opened up to each of them reach.
    spans = sorted(quotes + brackets)
    openings, reach = [o for o, _ in spans], list(accumulate((c for _, c in spans), max))
    start, back = lo, None
    ends = [(m.start(), m.end(), False) for m in _TERMINATORS.finditer(text, lo, hi)]
    if name == "th":
        ends += [(m.start(), m.start(), True) for m in _THAI_BLANK.finditer(text, lo, hi)]
        ends.sort()
    for a, e, blank in ends:
        if a < start:
            continue
        # Closing marks that belong to the sentence, behind a space as well where the script sets one.
        end, first = e, None
        while end < hi and not blank and closing:
            k = end
            while k < hi and text[k] in " \u00a0\u202f" and k - end < 1:
                k += 1
            if k < hi and text[k] in _CLOSING and k in closing and closing[k] < a:
                end = k + 1
                if closing[k] in quoted:
                    first = closing[k] if first is None else min(first, closing[k])
                continue
            break
        within = bisect_left(openings, a)
        if within and reach[within - 1] >= end:
            continue
        if end >= hi:
            break
        if first is not None and _opens(text, start, first) and _names_speaker(text, end, hi, name):
            continue
        if blank:
            decision = not _REPEATED.match(text, end, hi)
        else:
            if back is None:
                back = text[lo:hi][::-1]
            decision = STAY
            for verdict, left, right in rules:
                if (right is None or right(text, end, hi)) and (left is None or left(back, hi - end, hi - start)):
                    decision = verdict
                    break
        if decision:
            out.append((start, end))
            start = end
            while start < hi and text[start].isspace():
                start += 1
    if start < hi:
        out.append((start, hi))


def _opens(text: str, start: int, quote: int) -> bool:
    """Whether only opening marks stand between the sentence's start and its quotation."""
    return all(text[i] in "¿¡([（—–- \"'«“„‘「『" for i in range(start, quote))


def _names_speaker(text: str, end: int, hi: int, name: str) -> bool:
    """Whether what follows a quotation goes on with it: not another opening mark and, where case tells, no new sentence."""
    while end < hi and text[end].isspace():
        end += 1
    if end >= hi or text[end] in "\"'«“„‘「『(（¿¡":
        return False
    if name in _LATIN or name in _TABLED or name in (_NEUTRAL, "ru"):
        return text[end].islower() or text[end] in ",;:—–-" or _SPEECH.match(text, end, hi) is not None
    return True


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, start_char, end_char) of every sentence of docs (doc_id, text, lang), numbered from 1.

    Characters are code points of the text as stored. A blank line ends a sentence or heading, a single line
    break doesn't; nothing ends inside a quotation. Empty, blank and null texts have no sentences; a null or
    wrong lang is replaced by what script and function words tell. A repeated row is split each time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (doc, n, a, b)
                for doc, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"])
                if text
                for n, (a, b) in enumerate(segment(text, lang), 1)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "sentence_no", "start_char", "end_char"])

    rows = docs.select("doc_id", "text", "lang")
    return rows.mapInPandas(run, "doc_id long, sentence_no int, start_char int, end_char int")
