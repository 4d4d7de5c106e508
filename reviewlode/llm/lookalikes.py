"""Visually identical text with different characters (problem 3).

Every token of a text that has a character with another meaning at no cost (a
look-alike, a form kept for compatibility, an uncomposed or a hidden character)
walks a trie of the corpus vocabulary, in all scripts, together with a weighted
edit automaton.  Look-alikes and hidden characters cost nothing; a letter of a
script that no word mixes with costs one edit, of which ``EDITS`` are allowed.
The most frequent spelling wins; tokens without one are mapped by table.  A text
is odd where its form differs from the text.

What a token of look-alikes alone means hangs on the text: a Cyrillic one between
Latin words is Latin if the vocabulary has its Latin spelling, and the reverse.
Null, empty and plain texts stay as they are.  Joiners in Indic words and emoji,
full width marks beside Chinese and Japanese, both spellings of Indic letters
with a dot, and typographic marks are plain.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

# Cyrillic and Greek letters that look like a Latin letter.
CYRILLIC = dict(zip("авекмнорстухіјѕԁԛԝһ", "abekmhopctyxijsdqwh")) | dict(zip("АВЕКМНОРСТУХІЈЅԌԚԜҺЗ", "ABEKMHOPCTYXIJSGQWH3"))
CYRILLIC |= {"в": "b", "н": "h", "к": "k", "м": "m", "т": "t", "ѵ": "v", "ԍ": "g", "ь": "b"}
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγεικνορτυχ", "ABEZHIKMNOPTYXayeikvoptux"))
# The letters of these that pass for the Latin letter in running text.
LOOK = {c: CYRILLIC[c] for c in "аеорсухіјѕԁԛԝһАВЕКМНОРСТУХІЈЅԚԜҺ"} | {c: GREEK[c] for c in "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικαυρ"}
LOOK |= {"ɑ": "a", "ɡ": "g", "ⅼ": "l", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ℓ": "l", "ʀ": "R", "ɩ": "i", "ƽ": "s"}
TO_LATIN = {ord(k): v for k, v in LOOK.items()}


# Characters that show nothing, but for joiners and variation selectors.
_HIDDEN = "­͏؜ᅟᅠ឴឵᠋-᠎​‎‏‪-‮⁠-⁤⁦-⁯﻿︀-︎￹-￻ㅤﾠ\U000E0000-\U000E007F\x00-\x08\x0B\x0E-\x1F\x7F"
# Blanks other than the ordinary one.
_BLANKS = "\u00A0\u1680\u2000-\u200A\u202F\u205F"
# Forms kept for compatibility that look like another character.
_FORMS = "０-９Ａ-Ｚａ-ｚｦ-ﾟﾡ-ￜ⺀-⻳⼀-⿕豈-﫿ﬀ-ﬆﭐ-﷏ﹰ-ﻼ\U0001D400-\U0001D7FFⅠ-ⅿℂℊ-ℓℕℙ-ℝℤℬℭℯ-ℴ;·․ǃꞌ∶"
_CJK = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ、-】⼀-⿕"
_HARD = regex.compile(f"[{_HIDDEN}{_BLANKS}{_FORMS}]")
_WIDE_MARK = regex.compile(f"(?<![{_CJK}！-｠\\s])[！-／：-＠［-｀｛-｠](?![{_CJK}])|(?<![{_CJK}！-｠])　(?![{_CJK}！-｠])")
_JOINER = regex.compile("[‌‍]")
_VIRAMA = "्্੍્୍்్್്"
_JOINS_HERE = regex.compile(rf"(?<=[{_VIRAMA}])[‌‍]|[‌‍](?=[{_VIRAMA}])|(?<=[\p{{So}}\p{{Sk}}️])‍(?=\p{{So}})")
_VS16 = regex.compile("(?<![\\p{So}\\p{Sk}\\p{Sm}\\p{Po}0-9#*⃣])️")
_ALIKE = "".join(LOOK)
_MIXED = regex.compile(
    rf"[A-Za-zÀ-ɏ][\p{{M}}’']?[{_ALIKE}]|[{_ALIKE}][\p{{M}}’']?[A-Za-zÀ-ɏ]|\p{{Greek}}[{''.join(CYRILLIC)}]|[а-яёА-Я][{''.join(GREEK)}]"
)
_ANY_ALIKE = regex.compile(f"[{_ALIKE}]")
_LATIN_IN_CYRILLIC = regex.compile(r"(?<=[а-яё])[aceopxyABCEHKMOPTXiI](?![a-zA-Z])|(?<![a-zA-Z])[aceopxyABCEHKMOPTX](?=[а-яё])")
#: Letters and nukta as one character; both spellings are plain, the second is the common one.
_NUKTA = {0x0958 + i: s for i, s in enumerate(["क़", "ख़", "ग़", "ज़", "ड़", "ढ़", "फ़", "य़"])} | {0x09DC: "ড়", 0x09DD: "ঢ়", 0x09DF: "য়"}
# Letters of Arabic and of Urdu that look alike.
ARABIC_TO_URDU = str.maketrans({"ي": "ی", "ك": "ک", "ى": "ی"})
URDU_TO_ARABIC = str.maketrans({"ی": "ي", "ک": "ك"})
_URDU_ONLY = regex.compile(r"[ٹپچڈڑژگںھہے]")
_ARABIC_ONLY = regex.compile(r"[ةإأؤ]")
_ARABIC_WORD = regex.compile(r"[ء-ۓ]+")
_PLAIN_SPAN = regex.compile("[\\x09\\x0A\\x0D\\x20-\\x7E‘’“-„«»–—…¡¿°©®™€£À-ÖØ-öø-ÿŒœĞğİıŞş\U0001F300-\U0001FAFF❤⭐️]*")
_STANDALONE_VS = regex.compile("(?<![❤⭐\U0001F300-\U0001FAFF☀-➿])️")



def is_odd(text: str | None) -> bool:
    """Whether a text has a character that looks like plain writing, or shows nothing, but is another one.

    Null, empty and plain texts: False.  Joiners in Indic words and emoji, full
    width marks beside Chinese and Japanese, and typographic marks are plain.
    """
    if not text:
        return False
    if text.isascii():
        return text.isprintable() is False and bool(_HARD.search(text))
    if _PLAIN_SPAN.fullmatch(text):
        return "\uFE0F" in text and bool(_STANDALONE_VS.search(text))
    if _HARD.search(text):
        return True
    if ("\u200D" in text or "\u200C" in text) and len(_JOINER.findall(text)) > len(_JOINS_HERE.findall(text)):
        return True
    if not unicodedata.is_normalized("NFC", text):
        t = text.translate(_NUKTA)
        if unicodedata.normalize("NFC", t) != t:
            return True
    if _ANY_ALIKE.search(text) and _MIXED.search(text):
        return True
    if _LATIN_IN_CYRILLIC.search(text):
        return True
    if _WIDE_MARK.search(text):
        return True
    if "\uFE0F" in text and _VS16.search(text):
        return True
    return _wrong_arabic(text)


def _wrong_arabic(text: str) -> bool:
    """A word that has letters of Urdu alone beside look-alikes of Arabic, or the reverse."""
    if not ("ي" in text or "ك" in text or "ی" in text or "ک" in text or "ى" in text):
        return False
    for w in _ARABIC_WORD.findall(text):
        if _URDU_ONLY.search(w):
            if "ي" in w or "ك" in w:
                return True
        elif _ARABIC_ONLY.search(w) and ("ی" in w or "ک" in w) and "ۂ" not in w:
            if "ئ" not in w and "ؤ" not in w:
                return True
    return False


_FORM = regex.compile(f"[{_FORMS}]")
_HIDE = regex.compile(f"[{_HIDDEN}]")
_BLANK = regex.compile(f"[{_BLANKS}]")
_LATIN = regex.compile(r"[A-Za-zÀ-ɏ]")
_OWN_CYRILLIC = regex.compile(f"(?![{''.join(k for k in LOOK if k in CYRILLIC)}])[а-яёА-ЯЁ]")
_TO_CYRILLIC = {ord(v): k for k, v in CYRILLIC.items() if k in "аеорсухАВЕКМНОРСТХ"}


def by_table(token: str) -> str:
    """A token with every look-alike, form and hidden character replaced by the plain one."""
    t = token.translate(_NUKTA)
    t = _FORM.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t)
    t = _HIDE.sub("", t)
    if "\u200C" in t or "\u200D" in t:
        keep = {m.start() for m in _JOINS_HERE.finditer(t)}
        t = "".join(c for i, c in enumerate(t) if c not in "\u200C\u200D" or i in keep)
    t = unicodedata.normalize("NFC", t)
    if _wrong_arabic(t):
        t = t.translate(ARABIC_TO_URDU if _URDU_ONLY.search(t) else URDU_TO_ARABIC)
    latin = len(_LATIN.findall(t))
    cyrillic = len(_OWN_CYRILLIC.findall(t))
    if latin and cyrillic <= 0:
        t = t.translate(TO_LATIN)
    elif cyrillic > 0 and latin:
        t = t.translate(_TO_CYRILLIC)
    return t


_ALONE = regex.compile(f"(?<=[A-Za-z][ ,.'’]{{1,2}})[{_ALIKE}]+(?!\\p{{L}})|(?<!\\p{{L}})[{_ALIKE}]+(?=[ ,'’]+[a-z])")


def alone_by_table(text: str) -> str:
    """Words made of look-alikes alone, beside words in Latin letters, as Latin ones."""
    return _ALONE.sub(lambda m: m.group().translate(TO_LATIN), text)


class Trie:
    """Vocabulary of plain spellings with their counts."""

    __slots__ = ("root",)

    def __init__(self, counted):
        self.root: dict = {}
        for word, n in counted:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n

    def count(self, word: str) -> int:
        """How often a word occurs; 0 for words that are not in the trie."""
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return 0
        return node.get("", 0)

    def spell(self, token: str, limit: float = 0.0) -> str | None:
        """The most frequent word within ``limit`` of a token; look-alikes, case and hidden characters cost nothing, other edits one.

        Walks the trie and the weighted edit automaton of the token together.
        """
        letters = [_alternatives(c) for c in token]
        best, stack, seen = None, [(self.root, 0, 0.0, "")], set()
        while stack:
            node, i, cost, word = stack.pop()
            if (id(node), i) in seen and limit == 0.0:
                continue
            seen.add((id(node), i))
            if i == len(letters):
                n = node.get("")
                if n and (best is None or (-cost, n) > best[0]):
                    best = ((-cost, n), word)
                continue
            alternatives = letters[i]
            if not alternatives:
                stack.append((node, i + 1, cost, word))
                continue
            for a in alternatives:
                end = node
                for c in a:
                    end = end.get(c)
                    if end is None:
                        break
                if end is not None:
                    stack.append((end, i + 1, cost, word + a))
            if cost + 1 <= limit:
                stack.append((node, i + 1, cost + 1, word))
                for c, end in node.items():
                    if c:
                        stack += [(end, i + 1, cost + 1, word + c), (end, i, cost + 1, word + c)]
        return best[1] if best else None


@lru_cache(50_000)
def _alternatives(c: str) -> tuple[str, ...]:
    """What a character may stand for at no cost; nothing for a hidden one."""
    if _HIDE.match(c) or c in "\u200C\u200D\uE00C\uE00D":
        return ()
    plain = unicodedata.normalize("NFKC", c).lower()
    out = {plain, c.lower()}
    for x in (c, c.lower()):
        if x in LOOK:
            out.add(LOOK[x].lower())
    back = [k for k, v in LOOK.items() if v == plain and k in CYRILLIC]
    if c in "يیى":
        out |= {"ي", "ی"}
    elif c in "كک":
        out |= {"ك", "ک"}
    return (*out, *[b.lower() for b in back])


_TOKEN = regex.compile(f"[\\p{{L}}\\p{{M}}\\p{{N}}\\uE00C\\uE00D{_HIDDEN}\u200C\u200D{_FORMS}]+")
#: Edits that a token may need beside look-alikes and hidden characters.
EDITS = 1.0
#: Tokens whose form a worker remembers.
KEPT = 200_000
_FOREIGN = regex.compile(r"(?<=[A-Za-z])[\u1D00-\u1D7F\u0250-\u02AF\p{Coptic}\p{Cherokee}\p{Lisu}\p{Armenian}\p{Georgian}\p{Deseret}](?=[A-Za-z]|$)|^[\u1D00-\u1D7F\p{Coptic}\p{Cherokee}\p{Lisu}\p{Armenian}\p{Deseret}](?=[A-Za-z]{3})")
_ALL_ALIKE = regex.compile(f"[{_ALIKE}]+")
_ALL_LATIN_ALIKE = regex.compile(r"[aceopxy]+|[ABCEHKMOPTX][aceopxy]+")
_OWN_LATIN = regex.compile(r"[bdfghjklmnqrstuvwzDFGIJLNQRSUVWYZ]")
_OWN_GREEK = regex.compile(f"(?![{_ALIKE}])\\p{{Greek}}")
_TO_CYRILLIC_SMALL = {ord(a): b for a, b in zip("aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ")}


class Speller:
    """The form of tokens under a vocabulary; without one, tokens are mapped by table alone."""

    def __init__(self, trie: Trie | None = None):
        self.trie = trie
        self.known: dict[tuple[str, str], str] = {}

    def form(self, token: str, among: str) -> str:
        """A token's form among words that are Latin ('L'), Cyrillic ('C') or mixed ('')."""
        key = (token, among)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > KEPT:
                self.known.clear()
            got = self.known[key] = self._form(token, among)
        return got

    def _form(self, t: str, among: str) -> str:
        trie = self.trie
        if is_odd(t):
            word = trie.spell(unicodedata.normalize("NFC", t)) if trie else None
            return by_table(t) if word is None else _cased(word, by_table(t))
        if trie is None:
            return t
        if among == "L" and _ALL_ALIKE.fullmatch(t):
            plain_ = t.translate(TO_LATIN)
            return _cased(plain_.lower(), plain_) if trie.spell(plain_) == plain_.lower() else t
        if among == "C" and _ALL_LATIN_ALIKE.fullmatch(t):
            plain_ = t.translate(_TO_CYRILLIC_SMALL)
            return plain_ if trie.count(plain_.lower()) > trie.count(t.lower()) else t
        if len(t) > 3 and _FOREIGN.search(t):
            # letters that look like nothing in the tables: one edit from a word of the vocabulary
            word = trie.spell(unicodedata.normalize("NFC", t), EDITS)
            if word and len(word) == len(t):
                return _cased(word, word.upper() if t.isupper() else word.capitalize() if t[:1].isupper() else word)
        return t


def _cased(word: str, table: str) -> str:
    """A word of the vocabulary with the capitals that the table gives."""
    if table.isupper() and len(table) > 1:
        return word.upper()
    return table[:1] + word[1:] if table[:1].lower() == word[:1] else word


def _among(text: str) -> str:
    if _OWN_CYRILLIC.search(text):
        return "" if _OWN_LATIN.search(text) else "C"
    return "L" if _OWN_LATIN.search(text) and not _OWN_GREEK.search(text) else ""


def is_plain(text: str) -> bool:
    """Whether no character of a text could mean another one."""
    if text.isascii():
        return text.isprintable() or not _HARD.search(text)
    return _PLAIN_SPAN.fullmatch(text) is not None and not ("\uFE0F" in text and _STANDALONE_VS.search(text))


def plain(text: str | None, speller: Speller | Trie | None = None) -> str | None:
    """A text in its one consistent form; null stays null, plain texts stay as they are."""
    if not text or is_plain(text):
        return text
    if not isinstance(speller, Speller):
        speller = Speller(speller)
    among = _among(text)
    # joiners that are needed step aside for a while
    joined = "\u200C" in text or "\u200D" in text
    t = _JOINS_HERE.sub(lambda m: "\uE00C" if m.group() == "\u200C" else "\uE00D", text) if joined else text
    form = speller.form
    t = _TOKEN.sub(lambda m: form(m.group(), among), t)
    if joined:
        t = t.replace("\u200C", "").replace("\u200D", "").replace("\uE00C", "\u200C").replace("\uE00D", "\u200D")
    t = _HIDE.sub("", _VS16.sub("", t) if "\uFE0F" in t else t)
    t = _BLANK.sub(" ", t)
    if _MIXED.search(text):
        t = alone_by_table(t)
    t = _WIDE_MARK.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t)
    t = _FORM.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t)
    if t != text or not unicodedata.is_normalized("NFC", text):
        same = text.translate(_NUKTA)
        t = unicodedata.normalize("NFC", t)
        if t == text or t.translate(_NUKTA) == same and unicodedata.normalize("NFC", same) == same:
            return text
    return t
