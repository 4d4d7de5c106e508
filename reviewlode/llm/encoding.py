"""Garbled text from a wrong character encoding (problem 6).

A text is damaged when its bytes were once read with the wrong code page.  The
operator is a noisy-channel decoder in two steps.

*Candidates* (``is_damaged``): the characters are turned back into bytes under
every code page that may have been used by mistake.  Spans whose bytes form
UTF-8, or a word of another single or double byte code page, may be damaged.
Replacement characters (U+FFFD), C1 controls and runs of question marks in place
of letters are lost bytes.

*Decoding* (``Restorer``): a span was written as it stands, or was written
otherwise and read with a wrong code page, or comes from no writing at all.
Every reading is scored by the character pairs and the word frequencies of the
corpus, and the likeliest wins.  Lost bytes make a lattice of bytes with
wildcards, which a Viterbi search goes through.  They stay marked where no
reading is a known word that is more probable than all others together.  A text
is damaged where the decoder takes another reading than the text itself, or
where bytes are lost.

Null, empty and clean texts give no span.  Texts of any length are read whole.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import regex

# Code pages that are used by mistake in practice (WRONG), and
# those that texts were really written in (RIGHT).
WRONG_SINGLE = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1250", "cp1253", "cp1254", "cp1256", "cp874")
WRONG_DOUBLE = ("gbk", "cp932", "cp949", "big5")
RIGHT_OVER_LATIN = ("cp1251", "koi8_r", "cp1256", "cp1254", "cp874", "cp932", "gbk", "cp949", "big5", "cp1253")
RIGHT_OVER_CYRILLIC = ("koi8_r", "cp866")

# Characters of ordinary writing, as ranges.
PLAUSIBLE = (
    r"\x09\x0A\x0D\x20-\x7E¡-¬®-±´-·»-ÄÆ-ÏÑ-ÖÙ-Üß-äæ-ïñ-öù-ü"
    r"ŒœĞğİıŞşŸЁА-яё"
    r"،؛؟ء-غـ-ٕ٠-٬ٱٹپچڈڑژکگںھۀ-ۃیے-۔۰-۹"
    r"ऀ-ঃঅ-৾ก-ฺ฿-๛"
    r"‌‍‐-―‘-„†-•…‰‹›₨€₹₽₺№™←-⇿☀-➿⭐⭕"
    r"、-】ぁ-ゖ゙-ヿ一-鿿️！-～\U0001F1E6-\U0001F1FF\U0001F300-\U0001FAFF"
)
_PLAIN_ONLY = regex.compile(f"[{PLAUSIBLE}]*")
_NON_ASCII = regex.compile(r"[^\x00-\x7F]")
_LOST = regex.compile(r"�|[\x80-\x84\x86-\x9F]|")
# Question marks in place of letters: two groups that stand alone, or one of four or more.
_QGROUP = regex.compile(r"(?<![^\s\"'(«“‘])\?+(?=[\s.,!;:\"')»”’\-–।۔]|$)")


def _reverse(codec: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)  # read as a control character by lenient readers
        out.setdefault(c, b)
        if codec == "cp1252" and 0x80 <= b < 0xA0:
            out.setdefault(chr(b), b)
    return out


REVERSE = {w: _reverse(w) for w in WRONG_SINGLE}


def _class(chars: str) -> str:
    return "[" + "".join(regex.escape(c, special_only=False) for c in chars) + "]"


def _utf8_pattern(w: str):
    by = {b: c for c, b in REVERSE[w].items()}
    cls = lambda lo, hi: "".join(c for c, b in REVERSE[w].items() if lo <= b <= hi)
    cont = _class(cls(0x80, 0xBF) + "�" + (" " if by.get(0xA0) == " " else ""))
    lead2, lead3, lead4 = _class(cls(0xC2, 0xDF)), _class(cls(0xE0, 0xEF)), _class(cls(0xF0, 0xF4))
    return regex.compile(f"(?:{lead2}{cont}|{lead3}{cont}{cont}|{lead4}{cont}{cont}{cont})+")


UTF8_IN = {w: _utf8_pattern(w) for w in WRONG_SINGLE}
#: Characters by which a code page shows; a text without any of them needs no search under it.
_HINT = {w: regex.compile(_class("".join(c for c, b in REVERSE[w].items() if 0xC2 <= b <= 0xF4))) for w in WRONG_SINGLE}


#: Code pages whose letters are those of a script in use.
NATIVE = ("cp1256", "cp874", "cp1253", "koi8_r", "cp866")
_RUN = regex.compile(r"[^\x00-\x7F]+")


def back_to_bytes(text: str, w: str) -> bytes | None:
    """The bytes that reading with code page ``w`` turned into ``text``; None if there are none."""
    table = REVERSE[w]
    out = bytearray()
    for c in text:
        o = ord(c)
        if o < 128:
            out.append(o)
        elif c in table:
            out.append(table[c])
        else:
            return None
    return bytes(out)


def _script(c: str) -> str:
    o = ord(c)
    if not c.isalpha():
        return "mark" if unicodedata.category(c)[0] == "M" else ""
    if o < 0x250:
        return "Latn"
    if 0x400 <= o < 0x530:
        return "Cyrl"
    if 0x600 <= o < 0x700:
        return "Arab"
    if 0x900 <= o < 0x980:
        return "Deva"
    if 0x980 <= o < 0xA00:
        return "Beng"
    if 0xE00 <= o < 0xE80:
        return "Thai"
    if 0x3040 <= o < 0x3100:
        return "Kana"
    return "Hani" if 0x3400 <= o < 0xA000 else "other"


@lru_cache(20_000)
def _decoded_ok(span: str, w: str) -> str | None:
    """What a span reads as in UTF-8, if that is plausible writing and the span itself is not."""
    data = back_to_bytes(span.replace(" ", " ") if " " in REVERSE[w] else span, w)
    if data is None:
        return None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not _PLAIN_ONLY.fullmatch(text):
        again = _decoded_ok(text, "cp1252") if w in ("cp1252", "latin-1") else None  # read wrongly twice
        return text if again is not None else None
    scripts = [s for s in map(_script, text.replace("\uFE0F", "")) if s]
    if scripts and set(scripts) - {"Latn"} and len(scripts) < 2:
        return None  # one letter of another script by itself
    if len(text) == 1 and w not in ("cp1252", "latin-1") and not scripts and ord(text) < 0x2000:
        return text if text in "°£¿¡«»§±·´" and w in ("mac_roman", "cp437", "cp850", "cp1251") else None
    return text


def utf8_spans(text: str):
    """(start, end, restored, code page) of the spans that are UTF-8 read with one byte code pages."""
    best = []
    for w in WRONG_SINGLE:
        if not _HINT[w].search(text):
            continue
        found = []
        for m in UTF8_IN[w].finditer(text):
            span = m.group()
            if "�" in span:
                found.append((m.start(), m.end(), None, w))
                continue
            ok = _decoded_ok(span.rstrip(" "), w) or _decoded_ok(span, w)
            if ok is not None:
                found.append((m.start(), m.end() - (len(span) - len(span.rstrip(" "))), ok, w))
        if w in NATIVE:  # letters of a living script: only if every run beyond ASCII reads as UTF-8
            found = [x for x in found if x[1] - x[0] >= 4 and _RUN.fullmatch(text, x[0], x[1]) and not (x[0] and ord(text[x[0] - 1]) > 127) and not (x[1] < len(text) and ord(text[x[1]]) > 127)]
        n = sum(e - s for s, e, _, _ in found)
        if n > sum(e - s for s, e, _, _ in best):
            best = found
    return best


_CJKISH = regex.compile(r"[　-ヿ㐀-鿿가-힣-｡-ﾟ�][\x20-\x7E　-ヿ㐀-鿿가-힣-｡-ﾟ� -ÿͰ-ӿ‐-⛿?]*")


@lru_cache(20_000)
def _double_ok(span: str) -> tuple[str, str] | None:
    for w in WRONG_DOUBLE:
        try:
            data = span.encode(w, "ignore")
        except UnicodeError:
            continue
        good = bad = 0
        text = data.decode("utf-8", "replace")
        for c in text:
            if c == "�" or not _PLAIN_ONLY.fullmatch(c):
                bad += 1
            elif ord(c) > 127:
                good += 1
        # two or three characters of two bytes may be chance: common words of Chinese read as Cyrillic
        if good >= (2 if any(ord(c) >= 0x800 and c != "\uFFFD" for c in text) else 4) and bad <= good / 2:
            return text, w
        if good == 1 and not bad and ord(max(text)) >= 0x2010 and len(span.strip(" .,!?")) <= 3:
            return text, w
    return None


_HIDDEN = regex.compile(r"[\u00AD\u200B-\u200F\u2060\uFEFF]")


def double_spans(text: str):
    out = []
    for m in _CJKISH.finditer(text):
        ok = None if _HIDDEN.search(m.group()) else _double_ok(m.group())
        if ok:
            out.append((m.start(), m.end(), ok[0], ok[1]))
    return out


_HIGH_LATIN = regex.compile(r"[\u0080-ÿŒœŠšŸŽžƒˆ˜–-…‰‹›€™]")
_LATIN_RUN = regex.compile(r"(?<![A-Za-z])[À-ÿ]{3,}(?![A-Za-z])")
_HIGH_RUN = regex.compile(r"(?=[\u00A1-ÿ]*[À-ÿ])(?=[\u00A1-ÿ]*[\u00A2-\u00BE])[\u00A1-ÿ]{4,}")
_TURKISH = regex.compile(r"(?<=[A-Za-zÀ-ÿ])[ýþðÝÞÐ]|[ýþðÝÞÐ](?=[a-zà-ÿ])")
_TURNED_CASE = regex.compile(r"\b[а-яё][А-ЯЁ]{2,}\b")
_CYR_CAPS = regex.compile(r"[А-ЯЁ]{3,}")


_TWO_BYTE_RUN = regex.compile(r"[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘-„†‡•…‰‹›€™][\x40-\x7E\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘-„†‡•…‰‹›€™]{5,}")


def _japanese(text: str) -> bool:
    """A run of marks and letters that is Japanese in its double byte code page."""
    for m in _TWO_BYTE_RUN.finditer(text):
        data = back_to_bytes(m.group(), "cp1252")
        if data is None or sum(b > 127 for b in data) * 2 < len(data):
            continue
        t = data.decode("cp932", "replace")
        good = sum(s in ("Kana", "Hani") for s in map(_script, t))
        if good >= 3 and good >= 0.6 * len(t) and any(_script(c) == "Kana" for c in t) and _PLAIN_ONLY.fullmatch(t.rstrip("\uFFFD")):
            return True
    return False


def _legacy(text: str) -> str:
    """'latin' / 'turkish' / 'cyrillic' if the text looks like one code page read as another, else ''."""
    run = _LATIN_RUN.search(text)
    if run:
        n = len(regex.findall(r"[À-ÿ]", text))
        if n >= 4 or n >= len(text.strip()) / 2:
            # French and Turkish capitals do not come in words that are all accents
            return "latin"
    if _HIGH_RUN.search(text) or _japanese(text):
        return "latin"
    if _TURKISH.search(text):
        return "turkish"
    if len(_TURNED_CASE.findall(text)) >= 1 and len(_CYR_CAPS.findall(text)) >= 1:
        return "cyrillic"
    return ""


def lost_marks(text: str) -> bool:
    """Question marks stand in for lost letters."""
    if "??" not in text and " ? " not in text:
        return False
    groups = _QGROUP.findall(text)
    if not groups:
        return False
    long = [g for g in groups if len(g) >= 2]
    return len(long) >= 2 or any(len(g) >= 4 for g in groups)


# Texts made up of these alone cannot be damaged; they need no search.
_SAFE = regex.compile(
    r"(?:[\x00-\x7F‘’“”„–—…¿¡°€£₹«»،-۹ऀ-৿‌‍️❤⭐-]|[\U0001F300-\U0001FAFF]"
    r"|[À-ÖØ-ÜßàâäáçèéêëíìîïñóôöòúùûüœğışĞİŞ](?=[\x00-\x7F’“”»…])|[А-яё](?![Ђ-Џѐ-ӿ°±²³µ¶·¸№»«])|[А-яё](?=[»]))*"
)
_CYR_PAIRS = regex.compile(r"(?:[РС][а-яёА-Я]){3}")
_BOXED = regex.compile(r"\p{L}[─-▟]\p{L}|[─-▟]\p{L}[─-▟]")


def is_damaged(text: str | None) -> bool:
    """Whether a text, wholly or in part, was damaged by a wrong character encoding.  Null and clean texts: False."""
    if not text:
        return False
    if "??" in text and lost_marks(text):
        return True
    if text.isascii():
        return False
    if _SAFE.fullmatch(text) and not _TURNED_CASE.search(text) and not _CYR_PAIRS.search(text):
        return False
    return _damaged(text)


@lru_cache(50_000)
def _damaged(text: str) -> bool:
    if _LOST.search(text) or _BOXED.search(text):
        return True
    return bool(utf8_spans(text) or double_spans(text) or _legacy(text))


N_BUCKETS = 1 << 18


def bucket(s: str) -> int:
    """Stable bucket of a word or a pair of characters; must agree with ``model_counts``."""
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % N_BUCKETS


class Model:
    """Corpus statistics of a fixed size: word counts and character-pair counts, each in ``N_BUCKETS`` buckets."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.words, self.pairs = words, pairs
        self.letter = _Letters()
        self.total = float(pairs.sum()) + 1.0

    @lru_cache(100_000)  # noqa: B019 - one model lives as long as its worker
    def pair(self, a: str, b: str) -> float:
        return math.log((self.pairs[bucket(a + b)] + 0.02) / self.total)

    @lru_cache(100_000)  # noqa: B019
    def word(self, w: str) -> float:
        return math.log(self.words[bucket(w)] + 0.05)

    def text(self, t: str) -> float:
        """Mean log likelihood of the characters of a text."""
        t = " " + t.lower() + " "
        return sum(self.pair(a, b) for a, b in zip(t, t[1:])) / (len(t) - 1)

    def in_words(self, t: str) -> float:
        """Mean log frequency of the words of a text."""
        found = _WORD.findall(t.lower())
        return sum(map(self.word, found)) / len(found) if found else 0.0


_WORD = regex.compile(r"[\p{L}\p{M}]+")


class _Letters(dict):
    """Of each character what it is as the last or the first letter of a pair; None for what is no letter."""

    def __missing__(self, c: str):
        self[c] = got = c.lower()[-1] if _WORD.fullmatch(c) else None
        return got


_LATIN = "abcdefghijklmnopqrstuvwxyzàâäáçèéêëíìîïñóôöòúùûüğışßœ"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
_letters = lambda lo, hi: "".join(c for c in map(chr, range(lo, hi)) if unicodedata.category(c)[0] in "LM" and _PLAIN_ONLY.fullmatch(c))
#: The letters that a lost one may be, by the script of the word.
ALPHABETS = {"Latn": _LATIN, "Cyrl": _CYRILLIC, "Arab": _letters(0x620, 0x700), "Deva": _letters(0x900, 0x980), "Beng": _letters(0x980, 0xA00), "Thai": _letters(0xE00, 0xE80), "Kana": _letters(0x3040, 0x3100), "Hani": _letters(0x3400, 0xA000)}
#: Code pages of one byte a character under which a lost byte is a lost letter.
SINGLE = ("cp1252", "cp1254", "cp1251", "koi8_r", "cp1256", "cp874")


_TOKEN = regex.compile("[^ \t\r\n“”\"]*�[^ \t\r\n“”\"]*")
#: In place of a code page: one mark of loss stands for a whole character, as decoders put it.
WHOLE = "whole"


def _encoded(c: str, page: str) -> bytes | tuple[int] | None:
    if page == WHOLE:
        return (ord(c),)
    try:
        return c.encode(page)
    except UnicodeEncodeError:
        return None


@lru_cache(64)
def _alphabet(page: str, scripts: frozenset) -> dict[int, list[tuple[bytes | tuple[int], str]]]:
    """The letters of some scripts by their number of bytes under a code page."""
    out: dict[int, list[tuple[bytes | tuple[int], str]]] = {}
    for c in sorted({c for s in scripts for c in ALPHABETS[s]}):
        b = _encoded(c, page)
        if b:
            out.setdefault(len(b), []).append((b, c))
    return out


class _Many(tuple):
    """Very many characters, known by their identity, with the checksums that their pairs' buckets come from."""

    __slots__ = ()
    __hash__ = object.__hash__

    def __eq__(self, other):
        return self is other


@lru_cache(512)
def _checksums(options: _Many) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """By their number of bytes: one of the characters, the places of all and their checksums."""
    by: dict[int, list[int]] = {}
    coded = [c.encode() for c in options]
    for i, b in enumerate(coded):
        by.setdefault(len(b), []).append(i)
    return [(coded[at[0]], np.array(at), np.array([zlib.crc32(coded[i]) for i in at], dtype=np.int64)) for at in by.values()]


@lru_cache(20_000)
def _options(cell: tuple, page: str, scripts: frozenset) -> tuple[str, ...]:
    """The characters that some bytes, None for a lost one, may be under a code page."""
    if None not in cell:
        try:
            c = chr(cell[0]) if page == WHOLE else bytes(cell).decode(page)
        except UnicodeDecodeError:
            return ()
        return (c,) if len(c) == 1 and _PLAIN_ONLY.fullmatch(c) else ()
    if len(cell) > 2 and set(cell) == {None} and "Hani" in scripts:
        return ()  # one of thousands
    found = [c for b, c in _alphabet(page, scripts).get(len(cell), ()) if all(x is None or x == y for x, y in zip(cell, b))]
    return tuple(found) if len(found) <= 200 else _Many(found)


#: Log odds that a span whose bytes are valid in another encoding was read wrongly, before its letters are looked at.
CHANNEL = 8.0
#: Log likelihood of a blank or an ordinary mark, and of any other sign.
MARK, SIGN = -3.0, -12.0
# Marks beyond ASCII that are ordinary.
_USUAL = frozenset("’‘“”–—…«»¿¡،؟।。、！？")
#: Mean log likelihood of a character of no writing at all.
NO_WRITING = -12.0


@lru_cache(256)
def _runs_under(w: str) -> regex.Pattern:
    """Runs of characters that a code page gives, from the first one beyond ASCII."""
    high = _class("".join(REVERSE[w]))
    return regex.compile(f"{high}(?:{high}|[\\x20-\\x7E])*")


class Restorer:
    """Decodes damaged texts: a lattice of bytes or characters with wildcards, searched by Viterbi under corpus counts.

    ``beam``: most paths that are kept at a place of the lattice.
    """

    def __init__(self, model: Model, beam: int = 24):
        self.model, self.beam = model, beam

    def likelier(self, text: str, start: int, end: int, good: str) -> bool:
        """Whether a span was more probably written as ``good`` and read wrongly than written as it stands."""
        before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
        return self.total(f"{before}{good}{after}") + CHANNEL > self.total(f"{before}{text[start:end]}{after}")

    def total(self, t: str) -> float:
        """Log likelihood of a text by its pairs of letters; marks count as the blank beside a letter, and for themselves ``MARK`` or ``SIGN``."""
        letters = [self.model.letter[c] or " " for c in t]
        marks = sum(MARK if c.isascii() or c in _USUAL else SIGN for c, x in zip(t, letters) if x == " ")
        return marks + sum(self.model.pair(x, y) for x, y in zip(letters, letters[1:]) if x != " " or y != " ")

    def settle(self, text: str) -> str:
        """A text with the spans restored whose other reading is likelier."""
        for _ in range(3):  # texts may have been read wrongly more than once
            spans = utf8_spans(text) or double_spans(text)
            spans = [s for s in spans if s[2] is not None and self.likelier(text, s[0], s[1], s[2])]
            if not spans:
                break
            out, at = [], 0
            for start, end, good, _w in spans:
                out += [text[at:start], good]
                at = end
            text = "".join(out) + text[at:]
        how = _legacy(text)
        return (self.legacy(text, how) or text) if how else text

    def legacy(self, text: str, how: str) -> str | None:
        """The most likely reading of spans whose code page was mistaken for another one byte code page; None if they stand better as they are."""
        rights = {"latin": RIGHT_OVER_LATIN, "turkish": ("cp1254",), "cyrillic": RIGHT_OVER_CYRILLIC}[how]
        wrongs = ("cp1252", "cp1254") if how != "cyrillic" else ("cp1251", "koi8_r")
        best, score = None, -math.inf
        for w in wrongs:
            spans = [m for m in _runs_under(w).finditer(text)]
            if not spans:
                continue
            old = " ".join(m.group() for m in spans)
            was = self.model.text(old) + 0.2 * self.model.in_words(old)
            for r in rights if how != "cyrillic" or w == "cp1251" else ("cp1251",):
                pieces = [(back_to_bytes(m.group(), w) or b"").decode(r, "replace") or m.group() for m in spans]
                new = " ".join(pieces)
                if "�" in new or new == old:
                    continue
                if self.model.text(new) + 0.2 * self.model.in_words(new) - was > 0.3:
                    out, at = [], 0
                    for m, piece in zip(spans, pieces):
                        out += [text[at : m.start()], piece]
                        at = m.end()
                    whole = "".join(out) + text[at:]
                    value = self.model.text(whole) + 0.2 * self.model.in_words(whole)
                    if value > score:
                        best, score = whole, value
        return best

    def no_writing(self, text: str) -> bool:
        """Whether the characters beyond ASCII of a text are such as no writing has."""
        runs = [text[max(0, m.start() - 1) : m.end() + 1].lower() for m in _RUN.finditer(text)]
        pairs = [self.model.pair(x, y) for t in runs for x, y in zip(t, t[1:])]
        return bool(pairs) and min(sum(self.model.pair(x, y) for x, y in zip(t, t[1:])) / max(1, len(t) - 1) for t in runs) < NO_WRITING

    def _paths(self, data: list[int | None], page: str, scripts: frozenset, base: bool) -> list[tuple[float, str]]:
        """Viterbi over a lattice of bytes, None for a lost one: the likeliest texts under a code page with their pair likelihoods."""
        n = len(data)
        at: list[list[tuple[float, str]]] = [[] for _ in range(n + 1)]
        at[0] = [(0.0, "")]
        for i in range(n):
            if not at[i]:
                continue
            beam = sorted(at[i], reverse=True)[: self.beam]
            for k in range(1, min(4 if page == "utf-8" else 1, n - i) + 1):
                options = _options(tuple(data[i : i + k]), page, scripts)
                many = options.__class__ is _Many
                if not base and data[i] is None and not many:
                    options = tuple(c for c in options if not c.isascii())
                letter, pair, put = self.model.letter, self.model.pair, at[i + k].append
                for p, t in beam:
                    last = (letter[t[-1]] if t else None) or " "
                    for c in self._after(last, options) if many else options:
                        low = letter[c]
                        put((p + pair(last, low) if low else p, t + c))
        return sorted(at[n], reverse=True)[: self.beam]

    @lru_cache(50_000)  # noqa: B019
    def _after(self, a: str, options: _Many) -> tuple[str, ...]:
        """Of very many characters those that follow another one most often in the corpus, as many as paths are kept.

        No other one could lead to a path that is kept.  The checksum of a pair
        differs from that of its second character by what the first one gives.
        """
        first = a.encode()
        found: list[tuple[float, int]] = []
        for one, places, sums in _checksums(options):
            n = self.model.pairs[(sums ^ (zlib.crc32(first + one) ^ zlib.crc32(one))) % N_BUCKETS]
            top = np.argsort(-n, kind="stable")[: self.beam]
            found += [(float(n[i]), int(places[i])) for i in top if n[i] > 0]
        return tuple(options[i] for _, i in sorted(found, key=lambda x: (-x[0], x[1]))[: self.beam])

    def _known(self, t: str) -> bool:
        """Whether every word of a text and every pair of its letters is in the corpus."""
        found = _WORD.findall(t.lower())
        return bool(found) and all(self.model.words[bucket(w)] > 0 and all(self.model.pairs[bucket(a + b)] > 0 for a, b in zip(f" {w} ", f"{w} ")) for w in found)

    def fill(self, token: str, base: bool = False) -> str | None:
        """A token with lost bytes as it was most probably written, or None if no reading wins; ``base``: a letter of ASCII may be lost as well."""
        lattices = []
        for w in WRONG_SINGLE:  # UTF-8 that was read with a code page
            if any("�" in m.group() for m in UTF8_IN[w].finditer(token)):
                data = [None if c == "�" else ord(c) if ord(c) < 128 else REVERSE[w].get(c, -1) for c in token]
                if -1 not in data:
                    lattices += [(data, "utf-8", frozenset([s])) for s in ALPHABETS]
        own = frozenset(s for s in map(_script, token) if s in ALPHABETS)
        if own & {"Kana", "Hani"}:
            own |= {"Kana", "Hani"}
        for page in ("utf-8", WHOLE, *SINGLE):  # bytes that were lost when the text was read
            data = []
            for c in token:
                b = [None] if c == "�" else _encoded(c, page)
                if b is None:
                    break
                data += b
            else:
                if own:
                    lattices.append((data, page, own))
        found: dict[str, float] = {}
        for data, page, scripts in lattices:
            for p, t in self._paths(data, page, scripts, base):
                if self._known(t):
                    found[t] = max(found.get(t, -1e9), p + 2.0 * self.model.in_words(t))
        if not found:
            return None
        best = max(found, key=found.get)
        if sum(math.exp(p - found[best]) for p in found.values()) > 2:
            return None  # others together are as probable
        return best.upper() if len(best) == len(token) and token.isupper() and sum(map(str.isalpha, token)) > 1 else best

    def restore(self, text: str) -> tuple[bool, str | None]:
        """(damaged, restored text or None where nothing can be known any more), as the decoder has it."""
        if not is_damaged(text):
            return False, None
        if "??" in text and lost_marks(text):
            return True, None
        lost = _LOST.search(text) is not None or _BOXED.search(text) is not None
        new, how = self.settle(text), _legacy(text)
        other = self.legacy(text, how) if how else None
        if other and other != new:  # a word of a code page may be UTF-8 by chance
            other = self.settle(other)
            value = lambda t: self.model.text(t) + 0.2 * self.model.in_words(t)
            new = max(new, other, key=value)
        if "�" in new:
            lost = True
            new = regex.sub(r"(?<=\p{L})�(?=(?:s|t|re|d|m|ll)(?!\p{L}))|(?<=\b(?i:i|we|you|they|could|should|would|might|must|who))�(?=ve(?!\p{L}))", "’", new)
            new = regex.sub(r"(?<!\S)�(\p{L}[^�\n]{0,40}\p{L})�(?=[\s.,!?]|$)", "“\\1”", new)
            new = _TOKEN.sub(lambda m: self.fill(m.group()) or m.group(), new)
            # decoders lose no letter of ASCII: only where nothing else is known, and not at the end, where a mark may have been
            new = _TOKEN.sub(lambda m: regex.search(r"�(?!\p{L})", m.group()) is None and self.fill(m.group(), True) or m.group(), new)
        if new != text:
            return True, new
        return lost or self.no_writing(text), None
