"""Sentence boundaries across languages and scripts (problem 1).

The rules are those of the Unicode sentence break algorithm.  Its character
property (Sentence_Break: STerm, ATerm, Close, Sep) gives the end marks and
closing marks of all scripts.  There are three additions: abbreviations of the
language that the text is in do not end a sentence, a quotation or bracket
inside a running sentence does not, however long, and emoji after an end mark
belong to the sentence before them.

The language comes from a function that is asked only where the word before a
full stop is an abbreviation in some language; words in a script of one
language need none.  Without it, the abbreviations that all share are left.

``split`` returns (start, end) pairs, counted from 1 in code points, both
included.  Null, empty and blank texts have no sentence; a text without any end
mark is one.  Texts of any length are read whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import regex

# Abbreviations by language, and under "" those that all share; they never end a sentence.
ABBREVIATIONS = {
    "": "dr prof mr mrs ms e.g i.e cf vs approx nr no tel v ver vol p pp",
    "en": "st jr sr esp nos ch fig sec dept est ext inc ltd co corp al viz",
    "de": "z.b z b d.h d h u.a u a ca bzw nr evtl ggf vgl hr fr str sog inkl bspw o.ä s.o abs tel",
    "fr": "p.ex p ex env mme mlle mm m cf av réf tél art pl bd",
    "es": "p.ej p ej aprox sr sra srta dr dra ud uds ee pág núm tel av",
    "id": "no jl hlm bpk yth sdr tlp dr prof ir hj h",
    "tr": "örn bkz sn dr prof doç av no tel mah cad sok",
    "ru": "т.е т е т.п ок г ул рис стр см напр др тел им проф",
    "hi": "डॉ श्री प्रो सं",
    "bn": "ডা ড মো মোঃ প্রো",
    "ar": "د م أ ص ت ج",
    "ur": "ڈاکٹر پ",
}
# Titles that are abbreviations only with a capital, before a name.
TITLES = frozenset("Rev Gen Sen Hon Capt Sgt Col Lt".split())
# Abbreviations that may also end a sentence; they do before a capital.
MAY_END = "etc a.m p.m am pm min hrs hr sec in ft lb oz mi km u.s u.k uu usw min std jh dll dsb dst tsb vb vs д т мин сек руб млн тыс др etc".split()
# Abbreviations only when a number follows.
BEFORE_NUMBER = frozenset("no nos nr tel v ver vol ch pp p art fig sec pág núm hlm № стр".split())
AFTER_NUMBER = frozenset("in min hrs hr sec ft lb oz mi km мин сек руб".split())
# Words that open sentences; a capitalised one after "U.S." starts a new one.
OPENERS = frozenset("the i it we my they he she this that there please why when is are did do does and but".split())

# Words that are abbreviations only with a number or in other rules, whatever the language.
_OTHERWISE = frozenset("no nos art fig sec ch co al est ext h m fr str ir im".split())
_NEVER = {lang: frozenset(words.split()) - _OTHERWISE for lang, words in ABBREVIATIONS.items()}
_SOMEWHERE = frozenset(w for ws in _NEVER.values() for w in ws)
_MAY = frozenset(MAY_END)
#: Words before a full stop that some rule is about.
_RULED = _SOMEWHERE | _MAY | _OTHERWISE | BEFORE_NUMBER | AFTER_NUMBER | frozenset(t.lower() for t in TITLES)

_ALL = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
#: The end marks of all scripts, with the ellipsis, which reviewers end sentences with.
ATERMS = "".join(regex.findall(r"\p{SB=ATerm}", _ALL))
TERMS = "".join(regex.findall(r"\p{SB=STerm}", _ALL)) + ATERMS + "…"
#: Closing marks: those of the property but for opening brackets and the quotation marks that only open.
CLOSERS = "".join(regex.findall(r"[\p{SB=Close}--[\p{Ps}«‹‛‟]]", _ALL, flags=regex.V1))
del _ALL
_CLOSING = frozenset(CLOSERS)
_STOPS = frozenset(ATERMS) | {"…"}
_EMOJI = r"(?:[\U0001F1E6-\U0001F1FF\U0001F300-\U0001FAFF☀-➿⬀-⯿⌀-⏿](?:[️‍⃣\U0001F3FB-\U0001F3FF]|[\U0001F300-\U0001FAFF☀-➿](?<=‍.))*)"
_CAND = regex.compile(
    rf"(?P<nl>[\r\n\x85  ])|(?P<term>[{regex.escape(TERMS)}]+(?:‍|️)?)|(?P<emoji>{_EMOJI}(?:[  ]*{_EMOJI})*)|(?<=[ก-๛])(?P<thai>[      　]+)(?=\p{{L}})"
)
_CLOSE = regex.compile(rf"[{regex.escape(CLOSERS, special_only=False)}]*")
_LINE = regex.compile(r"(?:(?![.!?…]+\s+\p{Lu})[^\r\n])*")
_NUMBER_BEFORE = regex.compile(r"\d\s*$")
_TAIL = regex.compile(rf"(?:[^\S\r\n]*{_EMOJI})+")
_SPACE = regex.compile(r"[^\S\r\n]*")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}.№]+$")
_QUOTES = {'"': '"', "“": "”", "«": "»", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", "„": "“", "‹": "›", "[": "]"}
_OPEN = regex.compile(r"[\"“«‘「『(（„‹\[]")
_HAS = regex.compile(r"[\p{L}\p{N}]")
_IGNORE = "​‎‏﻿⁠­‌‍"
_FAST = regex.compile(r"[^.!?…\n\r\"“«„‘「(\[]*[^\S\n]*[.!?]?\s*")


def _enclosed(line: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that open and close in one line."""
    out, i, n = [], 0, len(line)
    while True:
        m = _OPEN.search(line, i)
        if not m:
            return out
        a, q = m.start(), m.group()
        close = _QUOTES[q]
        if a and (q == '"' and line[a - 1].isdigit() or q == "‘" and line[a - 1].isalnum()):
            i = a + 1  # an inch mark, an apostrophe
            continue
        b = line.find(close, a + 1)
        if q == "„" and b < 0:
            b = line.find("”", a + 1)
        while q == "‘" and b > 0 and b + 1 < n and line[b + 1].isalpha():
            b = line.find(close, b + 1)  # an apostrophe inside the quotation
        if b < 0:
            i = a + 1
            continue
        out.append((a, b))
        i = b + 1


# Scripts of one language of the list; a word in one of them needs no language of the text.
_SCRIPT_OF = ((0x400, 0x530, ("ru",)), (0x900, 0x980, ("hi",)), (0x980, 0xA00, ("bn",)), (0x600, 0x700, ("ar", "ur")))


def _abbreviated(low: str, text: str, start: int, dot: int, language: Callable[[str], str | None] | None) -> bool:
    """Whether a word is an abbreviation in the language around it."""
    if low in _NEVER[""]:
        return True
    if low not in _SOMEWHERE:
        return False
    o = ord(low[0])
    for lo, hi, langs in _SCRIPT_OF:
        if lo <= o < hi:
            return any(low in _NEVER[lang] for lang in langs)
    if not language:
        return False
    # texts may change their language: the sentence so far with the next words of the line, and the text around it
    near = text[max(start, dot - 120) : dot] + _LINE.match(text, dot + 1, dot + 60).group()
    return any(low in _NEVER.get(language(piece) or "", ()) for piece in (near, text[max(0, dot - 300) : dot + 300]))


def _no_stop(text: str, start: int, dot: int, nxt: str, gap: bool, after: int, language: Callable[[str], str | None] | None = None) -> bool:
    """Whether a single full stop at ``dot`` belongs to an abbreviation, a number or an address."""
    piece = text[max(start, dot - 40) : dot].split()
    token = piece[-1] if piece and not text[dot - 1].isspace() else ""
    if not token.isalnum():
        m = _WORD_BEFORE.search(token)
        token = m.group() if m else ""
    first = dot - len(token)
    for c in _IGNORE:
        token = token.replace(c, "")
    low = token.lower().strip(".")
    if not gap:
        if nxt and (nxt.isdigit() or nxt.islower() or nxt in "/_@-,;:"):
            return True
        if len(low) == 1 and nxt.isalpha():
            return True  # U.S., т.е.
        if nxt.isupper() and ("." in token or token.isupper()):
            return True
        return False
    if not nxt:
        return False
    if low in BEFORE_NUMBER:
        if nxt.isdigit():
            return True
        if low in ("v", "p", "pp", "ch", "tel", "nr"):
            return True
        return False
    if low in ("u.s", "u.k"):
        word = regex.match(r"\p{L}+", text[after : after + 20])
        return nxt.islower() or bool(word) and word.group().lower() not in OPENERS
    if low in _MAY:
        if low in AFTER_NUMBER and not regex.search(r"\d[\s\-]*\p{L}*$", text[max(start, dot - 12) : dot]):
            return False
        return not (nxt.isupper() or nxt.isdigit()) if nxt.lower() != nxt.upper() or nxt.isdigit() else False
    if token and nxt.isupper() and token.strip("." + _IGNORE) in TITLES:
        return True
    if low and not _NUMBER_BEFORE.search(text, max(start, first - 3), first) and _abbreviated(low, text, start, dot, language):
        return True  # after a number it is a unit
    if len(low) == 1 and low.isalpha():
        # an initial, or part of a spaced abbreviation
        return token.isupper() and nxt.isupper() or nxt.islower()
    if low.isdigit() and len(low) <= 2 and nxt.isupper() and regex.search(r"\b(?:am|der|den|dem|vom|zum|bis)\s+\d+$", text[max(start, dot - 12) : dot]):
        return True  # German ordinals
    return False


def split(text: str | None, language: Callable[[str], str | None] | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, from 1, both included; see the module's docstring.

    ``language`` gives the two-letter code of a piece of text, or None.
    """
    if not text or not _HAS.search(text):
        return []
    n = len(text)
    if text.isascii() and _FAST.fullmatch(text):
        a = n - len(text.lstrip())
        return [(a + 1, len(text.rstrip()))]
    cuts: list[int] = []
    enclosed: list[tuple[int, int]] | None = None
    start = pos = 0
    while pos < n:
        m = _CAND.search(text, pos)
        if not m:
            break
        i, end = m.span()
        pos = end
        kind = m.lastgroup
        if kind == "nl":
            cuts.append(i)
            cuts.append(end)
            start = end
            continue
        if kind == "thai":
            cuts.append(end)
            start = end
            continue
        if kind == "emoji":
            k = _SPACE.match(text, end).end()
            nxt = text[k : k + 1]
            if k > end and nxt and nxt.isalpha() and _HAS.search(text, start, i):
                if nxt.islower() and len(text[start:i].split()) < 5:
                    continue
                cuts.append(k)
                start = k
            continue
        # end marks
        if enclosed is None:
            enclosed = [] if not _OPEN.search(text) else [(a + o, b + o) for o, line in _lines(text) for a, b in _enclosed(line)]
        if not enclosed and end + 1 < n and text[end] == " " and text[end + 1].isalpha():
            # most stops: one mark after a word that no rule is about, a blank, a letter
            word = text[text.rfind(" ", start, i) + 1 : i]
            if m.group() == "." and len(word) > 1 and word.isalpha() and word.lower() not in _RULED or end - i == 1 and text[i] in "!?":
                cuts.append(end + 1)
                start = pos = end + 1
                continue
        at = bisect_left(enclosed, (i,)) - 1  # spans do not overlap
        inside = enclosed[at] if at >= 0 and i < enclosed[at][1] else None
        close = _CLOSE.match(text, end).end() if end < n and text[end] in _CLOSING else end
        if close > end and text[end] in "“‘" and not inside:
            close = end  # an opening mark
        if close > end and text[end] in "\"'" and not inside and close - end == 1 and at + 1 < len(enclosed) and enclosed[at + 1][0] == end:
            close = end  # a quotation starts right after the end mark
        if inside and not (close > end and inside[1] < close):
            continue  # a stop in the middle of a quotation
        tail = _TAIL.match(text, close)
        stop = tail.end() if tail else close
        k = _SPACE.match(text, stop).end()
        gap = k > stop
        nxt = text[k : k + 1]
        j = k
        while nxt and nxt in "\"“«‘„「『([¿¡'-–—•" + _IGNORE and j < n:
            j += 1
            nxt = text[j : j + 1]
        if not nxt or nxt in "\r\n":
            continue
        marks = m.group()
        if close > end and inside:
            # the quotation ended with an end mark: the sentence goes on unless a capital follows
            if not (gap or tail) or not nxt.isupper():
                continue
        elif marks in ATERMS and not tail:
            if _no_stop(text, start, i, nxt, gap, j, language):
                continue
        elif _STOPS.issuperset(marks) and not tail and nxt.islower():
            before = text[start:i].split()
            if not gap or len(before) < 4 or not before[-1][-1:].isalpha():
                continue  # Well... so it goes on
        elif not gap and not tail:
            if marks[-1] in "!?" and not (nxt.isupper() or nxt.upper() == nxt.lower() and nxt.isalpha()):
                continue
        if nxt in ",;:)" or not (nxt.isalnum() or j > k or nxt in "@#*\"") and not gap:
            continue
        cuts.append(k)
        start = pos = k if k > pos else pos
    out = []
    a = 0
    for c in [*cuts, n]:
        piece = text[a:c]
        s = piece.strip()
        if s and _HAS.search(s):
            lead = len(piece) - len(piece.lstrip())
            out.append((a + lead + 1, a + lead + len(s)))
        elif s and out and "\n" not in text[out[-1][1] : a] and "\r" not in text[out[-1][1] : a]:
            out[-1] = (out[-1][0], a + len(piece.rstrip()))  # marks and emoji alone belong to the sentence before
        a = c
    return out


def _lines(text: str):
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1
