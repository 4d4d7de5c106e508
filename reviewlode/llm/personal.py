"""Personal information inside free text (problem 7).

Generators with high recall propose spans that may overlap: e-mail addresses,
numbers, street addresses and names.  Boosted trees, one for each kind, judge
every span by its format and its context; thresholds calibrated on examples of
held-out phrases select the spans to replace, and of spans that overlap the
surer kind stays.  The trees are fitted on examples made from the phrase lists
below; how often a word is part of a user's name, and with how many partners, is
counted over all rows.  Names are proposed where a word is counted, where the
words before introduce one, and by their form: capitalised words in a row.

Null, empty and plain texts have no span.  Texts are read whole; full width
digits, look-alikes and hidden characters count as the plain ones.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib

import numpy as np
import regex

from reviewlode.llm.boosting import Boosted
from reviewlode.llm.lookalikes import TO_LATIN

KINDS = ("email", "phone", "id_number", "address", "name")
#: Buckets of the counts of name words.
BUCKETS = 1 << 18

# Words that go with each kind, over the languages.
PHONE_CUES = """call phone tel telephone number whatsapp mobile cell desk hotline ring sms text nummer telefon telefonnummer handy rufen anrufen téléphone numéro appelez
teléfono número llámenme móvil nomor telp telepon hp hubungi wa telefonum numaram arayın номер телефон звоните फोन फ़ोन नंबर मोबाइल ফোন নম্বর মোবাইল هاتفي هاتف جوال جوالي رقم رقمي اتصلوا
فون نمبر موبائل رابطہ โทร เบอร์ 电话 手机 号码 電話 番号""".split()
ID_CUES = """id passport national identity nid ssn aadhaar cnic iqama pan ausweis ausweisnummer personalausweis reisepass pass identité passeport carte cni dni cédula pasaporte identidad
nik ktp paspor kimlik pasaport tc паспорт паспорта снилс инн удостоверение आधार पहचान पासपोर्ट পরিচয়পত্র পরিচয়পত্র জাতীয় পাসপোর্ট هوية هويتي الهوية بطاقة جواز شناختی کارڈ شناخت บัตร ประชาชน 身份证 护照 パスポート マイナンバー 身分証""".split()
OTHER_CUES = """order invoice error code build version ver v receipt ticket bill ref reference android ios release verses bestellung rechnung fehler commande facture erreur pedido factura pesanan faktur
kesalahan sipariş fatura hata sürüm versi versión заказ счёт ошибка код версия версией сборка ऑर्डर संस्करण অর্ডার সংস্করণ طلب فاتورة الإصدار ورژن آرڈر 订单 版本 注文 バージョン paid fee price costs gb mb km""".split()
NAME_CUES = """name i'm am regards yours wishes hello hi dear salam sincerely thanks registered ask daughter son wife husband brother sister mother father teacher friend signed cheers greetings
heiße heisse bin m'appelle appelle llamo soy adım ben saya bernama зовут меня नाम নাম اسمي أنا نام ชื่อ 我叫 名前""".split()
HONORIFICS = "mr mrs ms dr prof sir madam imam sheikh shaykh mufti hazrat prophet brother sister bruder schwester frau herr bapak ibu pak bu bey hanım".split()
NOT_NAMES = """surah sura surat sure sourate sūrah prophet nabi month ramadan shaban rajab muharram safar asr fajr dhuhr zuhr maghrib isha quran app version android google samsung apple
prayer tracker january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday""".split()
STREET_WORDS = """street st road rd avenue ave lane ln drive dr close court ct square place boulevard blvd terrace crescent way house tower towers villa building apartments rue avenue impasse
allée straße strasse str weg platz gasse calle avenida plaza carrera paseo jl jalan gang sok sokak cad caddesi mah mahallesi bulvarı""".split()
# Words that follow an introduction or stand in user names and are no names.
COMMON = """team everyone everybody there all folks developers developer dev support user users customer customers guys sir madam muslim student teacher happy sad glad new sorry sure please great good nice love anonymous guest deleted account
reader night bird owl fan store the this that it we you very just using still back old best app apps not no yes hope thanks thank will our your my reviewer friend community brothers sisters brother sister equipo team équipe kunde nutzer
لا غير ليس لم لن ما مسلم سعيد مستخدم أستخدم أحب في من على هذا التطبيق غلط نہیں صحیح مسلمان गलत नहीं सही मुस्लिम खुश ভুল নেই না ঠিক মুসলিম не нет неправильно мусульманин ไม่ ผิด""".split()
_COMMON = frozenset(COMMON)
_SETS = [frozenset(s) for s in (PHONE_CUES, ID_CUES, OTHER_CUES, NAME_CUES, HONORIFICS, NOT_NAMES, STREET_WORDS)]

_AT = r"\s*(?:[\[({<]\s*(?:at|arroba|arobase|ät|et)\s*[\])}>]|＠|@)\s*"
_DOT = r"\s*(?:[\[({<]\s*(?:dot|punkt|point|punto|nokta|titik|\.)\s*[\])}>]|\.(?=\S))\s*"
#: Anything that may be an e-mail address: with a sign or a word for "at" between two words.
MAIL_LIKE = regex.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*|(?<![\w.+-])[A-Za-z0-9][\w.+-]* at [A-Za-z0-9-]+ dot [A-Za-z]+(?: dot [A-Za-z]+)*", regex.I)
EMAIL = regex.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT.replace(chr(92) + 's*', chr(92) + 's?')}[A-Za-z]{{2,}}|(?<![\w.+-])[A-Za-z0-9][\w.+-]* at [A-Za-z0-9-]+ dot [A-Za-z]{{2,}}(?: dot [A-Za-z]{{2,}})*", regex.I)
NUMBER = regex.compile(r"(?<![\p{L}\p{N}])(?:[A-Za-z]{1,3}-?(?=\d{5}))?[+(]{0,2}\d(?:\d|[ ().\-/–]{1,2}(?=[\d(]))*\d(?![\p{L}\p{N}])")
_STREET_EN = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|drive|close|court|square|place|boulevard|blvd\.?|terrace|crescent|row|walk|mews|gardens?|hills?|nagar|colony|villas?|tower|house|view|mill|way)"
ADDRESS = regex.compile(
    rf"""\b\d{{1,5}}[A-Za-z]?,?\s+(?:[\p{{Lu}}][\p{{L}}'’.-]+\s+){{1,3}}(?i:{_STREET_EN})\b
    |\b(?:Flat|Apt\.?|Apartment|House|Unit|Plot|Suite|Room|Villa|H\.?\s?No\.?)\s+(?:No\.?\s*)?\d+[A-Za-z]?(?:[,/]?\s+(?:[\p{{Lu}}\d][\w'’.-]*,?\s*){{1,5}})?
    |\b(?:\d+,?\s+)?(?:bis\s+)?(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Ii]mpasse|[Aa]ll[ée]e|[Cc]hemin|[Qq]uai|[Pp]lace)\s+(?:d(?:e|u|es)\s+(?:la\s+|l['’])?|l['’])?[\p{{Lu}}][\p{{L}}'’-]+
    |\b[\p{{Lu}}][\p{{L}}-]*(?:straße|strasse|str\.|weg|platz|gasse|allee)\s+\d+[a-z]?
    |\b(?:[Cc]alle|[Aa]venida|[Aa]v(?:da)?\.|[Pp]laza|[Cc]arrera|[Pp]aseo)\s+(?:de\s+(?:la\s+|los\s+)?|del\s+)?[\p{{Lu}}][\p{{L}}'’ -]*?(?:,?\s*(?:n\.?\s?[ºo°]\.?\s*|núm\.?\s*|No\.?\s*)?\d+)
    |\b(?:Jl\.|Jln\.|Jalan|Gang|Gg\.)\s+[\p{{Lu}}][\p{{L}}]*(?:\s+[\p{{Lu}}][\p{{L}}]*)*(?:,?\s+(?:No\.?|Nomor|Blok)\s*[:.]?\s*\w+)?
    |\b(?:[\p{{Lu}}][\p{{L}}]*\s+)+(?:Sok(?:ak|ağı)?|Cad(?:desi)?|Mah(?:allesi)?|Bulvarı|Apt)\b\.?(?:,?\s+No\.?\s*[:.]?\s*\d+)?
    |(?:ул\.|улиц[аеуы]|пр\.|пр-т|проспект|пер\.|переулок|шоссе|наб\.)\s+\p{{Lu}}[\p{{L}}-]+(?:,?\s*(?:д\.|дом)?\s*\d+)?
    |(?:شارع|حي)\s+[\p{{Arabic}}]+(?:\s+[\p{{Arabic}}]+)?\s*(?:،|رقم|مبنى)*\s*\d*
    |(?:مکان|گھر|گلی|فلیٹ|سڑک|روڈ)\s*(?:نمبر)?\s*\d+|\p{{Arabic}}+\s+(?:روڈ|سٹریٹ|اسٹریٹ|گلی)\b
    |(?:मकान|घर|फ्लैट|फ़्लैट|गली|प्लॉट)\s*(?:नं\.?|नंबर|संख्या|क्रमांक)?\s*\d+|[\p{{Devanagari}}]+\s+(?:रोड|मार्ग|गली|सड़क|स्ट्रीट|एवेन्यू|नगर)\b
    |(?:বাড়ি|বাড়ি|বাসা|ফ্ল্যাট|হোল্ডিং|রোড|সড়ক|সড়ক)\s*(?:নং|নম্বর)?\s*\d+|[\p{{Bengali}}]+\s+(?:রোড|সড়ক|সড়ক|লেন|গলি|স্ট্রিট)\b
    |[\p{{Han}}]{{1,8}}(?:路|街|巷|弄|大道)\s*\d+\s*[号號]|[\p{{Han}}\p{{Katakana}}\p{{Hiragana}}]*\d+\s*(?:丁目|番地)|บ้านเลขที่\s*\d+|ถนน\p{{Thai}}+|(?:ซอย|หมู่)\s*\d+""",
    regex.X,
)
_NAMEWORD = r"(?:\p{Lu}\p{Ll}[\p{L}'’-]*|\p{Lu}{2,}|\p{Lu}\.)"
NAME = regex.compile(rf"(?<![\p{{L}}@#._]){_NAMEWORD}(?:\s+{_NAMEWORD}){{0,3}}|(?<![\p{{L}}\p{{M}}])\p{{Lo}}[\p{{Lo}}\p{{M}}]+(?:\s+\p{{Lo}}[\p{{Lo}}\p{{M}}]+)*")
# What introduces a name, and what introduces something else.
_INTRO = regex.compile(r"(?i)(?:name is|i am|i'm|this is|hei(?:ß|ss)e|appelle|me llamo|soy|adım|nama saya|saya|зовут|اسمي|أنا|نام|नाम|নাম|regards,|yours,|wishes,|cheers,|hello|\bhi|dear|salam|ask|registered as|[–—-]|signed|thanks to|my (?:daughter|son|wife|husband|sister|brother|mother|father|friend|teacher))\s*$")
_STATES = r"name\s+is|name['’]s|call\s+me|hei(?:ß|ss)e|name\s+ist|m['’]appelle|me\s+llamo|nombre\s+es|adım|ismim|nama\s+saya|bernama|зовут|мо[её]\s+имя"
_STATES_LO = r"[إا]سمي(?:\s+هو)?|(?:میرا|میرے)\s+نام|मेरा\s+नाम|আমার\s+নাম|ชื่อ"
_STATES_CJK = r"我叫|我的名字[是叫]|名前は"
_STATED = regex.compile(rf"(?i)(?:{_STATES}|{_STATES_LO}|{_STATES_CJK})[\s:：]*$")
_LO = r"\p{Lo}[\p{Lo}\p{M}]+"
_CJK = r"[\p{Han}\p{Katakana}\p{Hiragana}ー]"
#: What introduces a name, with the words after it that are shaped like one.
INTRODUCED = regex.compile(
    rf"""\b(?i:{_STATES}|i\s+am|i['’]m|this\s+is|soy|saya|regards,|yours,|wishes,|cheers,|hello|hi|dear|salam|ask|registered\s+as|signed|thanks\s+to|my\s+(?:daughter|son|wife|husband|sister|brother|mother|father|friend|teacher))[\s:]+({_NAMEWORD}(?:[^\S\n]+{_NAMEWORD}){{0,3}})
    |(?<![\p{{L}}\p{{M}}])(?:{_STATES_LO})[\s:]+({_LO}(?:[^\S\n]+{_LO})?)
    |(?:{_STATES_CJK})\s*({_CJK}{{1,8}}?(?:[\s・]{_CJK}{{1,8}}?)?)(?=です|といい|と言|と申|だ|[\p{{P}}\s]|$)""",
    regex.X,
)
_AGAINST = regex.compile(r"(?i)(?:s[uo]u?ra[ht]?e?|surat|prophet|month of|prayer of|near|in|at|the|сура|سورة|سورۃ|सूरह|সূরা)\s*$")
_FOLLOW = regex.compile(r"(?i)\s*(?:here\b|from\b|, tel|, id\b|, support|says|wrote|and i\b|et j|und brauche|ve yard|dan saya|y necesito|uses)")
_PLACE = regex.compile(r"(?i)\s*(?:street|st\b|road|avenue|lane|house|mosque|masjid|city|hills|nagar|park|app\b|version|weg|stra)")
_WORDS = regex.compile(r"[\p{L}\p{M}'’]+")
_MAY_NAME = regex.compile(r"\p{Lu}[\p{L}'’-]+|\p{Lo}[\p{Lo}\p{M}]+")
_HIDE = regex.compile("[­​-‏‪-‮⁠-⁤﻿]")


_NEEDS_FLAT = regex.compile(r"[\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000！-～]|[\p{Nd}--[0-9]]|[A-Za-z][аеорсухіοναικυ]|[аеорсухіοναικυ][A-Za-z]", regex.V1)
_ALIKE = regex.compile(r"[A-Za-z][аеорсухіοναικυ]|[аеорсухіοναικυ][A-Za-z]")
_SAYS_AT = regex.compile(r"(?i)[\[({<]\s*(?:at|arroba|arobase|ät|et)\s*[\])}>]|\bat [a-z0-9-]+ dot ")
_DIGIT = regex.compile(r"\d")
#: Digits of the shortest number that is a candidate.
LEAST_DIGITS = 5
_SEVEN = regex.compile(rf"(?:\d[ ().\-/–]*+){{{LEAST_DIGITS}}}")
#: Capitalised words in a row, after a word of the same sentence.
_FORM_NAME = regex.compile(r"(?<=[\p{L}\p{M}] )\p{Lu}\p{Ll}[\p{L}'’-]*(?: \p{Lu}\p{Ll}[\p{L}'’-]*){1,2}(?![\p{L}\p{N}])")
_BIG_ADDRESS = regex.compile(r"(?i)rue|jl\.|jalan|sok|cad|شارع|روڈ|रोड|मार्ग|রোড|সড়ক|ул|ถนน")

#: Words in Cyrillic, or in Latin letters with no two accented ones in a row.
_ONE_SCRIPT = regex.compile(r"(?:[А-ЯЁ][а-яё-]{2,} ?)+|(?:(?:[A-Za-z'’ -]|(?<![^\x00-\x7F’])[À-ɏ])+)")


def flat(text: str) -> tuple[str, list[int] | None]:
    """A text with plain digits and letters for full width and look-alike ones and without hidden characters; places in the original."""
    if text.isascii() or not _NEEDS_FLAT.search(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if c.isascii():
            out.append(c)
        elif _HIDE.match(c):
            continue
        else:
            if c.isdigit() and c.isdecimal():
                c = str(unicodedata.digit(c))
            elif "！" <= c <= "～":
                c = chr(ord(c) - 0xFEE0)
            elif unicodedata.category(c) == "Zs":
                c = " "
            out.append(c)
        at.append(i)
    t = "".join(out)
    if _ALIKE.search(t):
        t = t.translate(TO_LATIN)
    return t, at


def may_email(t: str) -> bool:
    """Whether a flat text may hold an e-mail address; false only where EMAIL matches nothing."""
    return "@" in t or ("(" in t or "[" in t or "{" in t or "<" in t or " dot " in t.lower()) and _SAYS_AT.search(t) is not None


def may_number(t: str) -> bool:
    """Whether a flat text may hold a number of ``LEAST_DIGITS`` digits."""
    digit = _DIGIT.search(t)
    return digit is not None and _SEVEN.search(t, digit.start()) is not None


# The words without which no pattern of a street or house matches, and those without which nothing introduces a name.
_ADDRESS_WORDS = frozenset("""street st road rd avenue ave lane drive close court square place boulevard blvd terrace crescent row walk mews garden gardens hill hills nagar colony villa villas tower house view mill way flat apt apartment unit plot suite room h hno
rue impasse allee chemin quai calle avenida av avda plaza carrera paseo jl jln jalan gang gg sok sokak cad caddesi mah mahallesi""".split())
_ADDRESS_ALONE_NATIVE = ("شارع", "روڈ", "रोड", "मार्ग", "রোড", "সড়ক", "সড়ক", "ул", "ถนน")
_ADDRESS_NATIVE = (*_ADDRESS_ALONE_NATIVE, *"""пр. пр-т проспект пер. переулок шоссе наб. حي مکان گھر گلی فلیٹ سڑک سٹریٹ اسٹریٹ मकान घर फ्लैट फ़्लैट गली प्लॉट सड़क स्ट्रीट एवेन्यू नगर
বাড়ি বাড়ি বাসা ফ্ল্যাট হোল্ডিং লেন গলি স্ট্রিট 路 街 巷 弄 道 丁目 番地 บ้านเลขที่ ซอย หมู่ allée bulvarı sokağı mahallesi""".split())
_ADDRESS_ALONE = ("rue", "jl.", "jalan", "sok", "cad")
_INTRO_WORDS = frozenset("""name names call heisse heissen heiss appelle llamo nombre nama bernama am m soy saya this regards yours wishes cheers hello hi dear salam ask registered signed thanks
daughter son wife husband sister brother mother father friend teacher heiße heißen heiß adım ismim зовут имя""".split())
_INTRO_PARTS = ("سمي", "نام", "नाम", "নাম", "ชื่อ", "我叫", "我的名字", "名前は")


def may_address(t: str, words: list[str] | None = None) -> bool:
    """Whether a flat text may hold a street address; ``words``: its words in lower case.  False only where ADDRESS matches nothing that counts."""
    words = _WORDISH.findall(t.lower()) if words is None else words
    low = t.lower()
    if any([x in low for x in _ADDRESS_ALONE]):
        return True
    if _DIGIT.search(t) is None:
        return not t.isascii() and any([x in low for x in _ADDRESS_ALONE_NATIVE])
    if not _ADDRESS_WORDS.isdisjoint(words) or _STREET_SUFFIX.search(low) is not None:
        return True
    return not t.isascii() and any([x in low for x in _ADDRESS_NATIVE])


def may_introduce(t: str, words: list[str] | None = None) -> bool:
    """Whether a flat text may introduce a name; false only where INTRODUCED matches nothing."""
    if not _INTRO_WORDS.isdisjoint(_WORDISH.findall(t.lower()) if words is None else words):
        return True
    return not t.isascii() and any([x in t for x in _INTRO_PARTS])


# Patterns of the features, compiled once.
_WORDISH = re.compile(r"\w+")
_MAIL_AT = regex.compile(rf"{_AT}|\\bat\\b", regex.I)
_MAIL_DOT = regex.compile(rf"{_DOT}|\\bdot\\b|\\s+", regex.I)
_STREET_SUFFIX = regex.compile(r"(?:straße|strasse|str\.|weg|platz|gasse|allee)(?!\p{L})")
_PLACED = regex.compile(r"(?i)\\b(?:in|at|near|on|of|the)\\s*$")
_LIVES = regex.compile(r"(?i)\\b(?:live|lives|address|adresse|deliver|send|visit|office|wohne|habite|vivo|alamat|adres(?:im|imiz)?|dirección|адрес|живу)\\b")
_P0 = regex.compile(r"\d+")
_P1 = regex.compile(r"(?:19|20)\d{6}")
_P2 = regex.compile(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}-\d\d-\d\d")
_P3 = regex.compile(r"\d+(?:\.\d+){1,3}")
_P4 = regex.compile(r"\d{3}-\d\d-\d{4}|\d{5}-\d{7}-\d|\d{6}-\d\d-\d{4}|\d{4} \d{4} \d{4}")
_P5 = regex.compile(r"[\p{L}\p{M}'’-]+")
_P6 = regex.compile(r"\p{Lu}\.")
_P7 = regex.compile(r"\p{Ll}")
_P8 = regex.compile(r"[\s,]+")
_P9 = regex.compile(r"\p{Lu}[\p{L}\p{M}'’-]*\.?|\p{Lo}[\p{Lo}\p{M}]*")
_P10 = regex.compile(r"[\p{L}\p{M}]+")
_P11 = regex.compile(r"\S+")


def name_bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS


def _near(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    before = _WORDS.findall(text[max(0, a - 60) : a].lower())[-5:]
    after = _WORDS.findall(text[b : b + 40].lower())[:4]
    return before, after


def _cues(before: list[str], after: list[str]) -> list[float]:
    """For each cue list: how near before the span a word of it stands, and whether one follows."""
    out = []
    for s in _SETS:
        d = next((i + 1 for i, w in enumerate(reversed(before)) if w in s or w.replace("’", "'") in s), 9)
        out.append(float(d))
        out.append(float(any(w in s for w in after)))
    return out


def number_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    digits = [c for c in s if c.isdigit()]
    groups = [len(g) for g in _P0.findall(s)]
    before, after = _near(text, a, b)
    prev = text[max(0, a - 1) : a]
    return [
        float(len(digits)), float(s.startswith("+")), float("(" in s), float(s.count("-")), float(s.count(" ")), float(s.count(".")), float(s.count("/")),
        float(len(groups)), float(max(groups)), float(min(groups)), float(digits[0] == "0"), float(s[:1].isalpha()), float(prev in "-#:"),
        float(bool(_P1.fullmatch(s))), float(bool(_P2.fullmatch(s))),
        float(bool(_P3.fullmatch(s) and len(digits) < 7)), float(bool(_P4.fullmatch(s))),
        *_cues(before, after),
    ]


def mail_features(text: str, a: int, b: int) -> list[float]:
    """Format and context of what may be an e-mail address."""
    s = text[a:b].lower()
    m = _MAIL_AT.search(s)
    local, domain = (s[: m.start()], s[m.end() :]) if m else (s, "")
    labels = [x for x in _MAIL_DOT.split(domain) if x]
    before, after = _near(text, a, b)
    return [
        float(len(local)), float(len(labels)), float(len(labels[-1]) if labels else 0), float(bool(labels) and labels[-1].isalpha()), float("@" in s or "＠" in s), float(" " in s),
        float(any(c.isdigit() for c in local)), float("." in local), float(local.isdigit()), float(bool(EMAIL.fullmatch(text[a:b]))), float(text[a - 1 : a] in ("/", ":", "@")),
        *_cues(before, after),
    ]


def address_features(text: str, a: int, b: int) -> list[float]:
    """Format and context of what may be a street address."""
    s = text[a:b]
    before, after = _near(text, a, b)
    words = _P10.findall(s)
    numbers = _P0.findall(s)
    return [
        float(len(words)), float(len(numbers)), float(max(map(len, numbers)) if numbers else 0), float(s[:1].isdigit()), float(s[-1:].isdigit()), float(bool(_BIG_ADDRESS.search(s))),
        float(sum(w[:1].isupper() for w in words)), float("," in s), float(not s.isascii()), float(bool(_STREET_SUFFIX.search(s))), float(any(w.lower().rstrip(".") in _SETS[6] for w in words)), float(bool(_PLACED.search(text[max(0, a - 30) : a]))), float(bool(_LIVES.search(text[max(0, a - 40) : a]))),
        *_cues(before, after),
    ]


def name_features(text: str, a: int, b: int, given: np.ndarray, family: np.ndarray, whole: bool, partners: np.ndarray) -> list[float]:
    s = text[a:b]
    words = _P5.findall(s)
    before, after = _near(text, a, b)
    g = [math.log1p(float(given[name_bucket(w)])) for w in words] or [0.0]
    f = [math.log1p(float(family[name_bucket(w)])) for w in words] or [0.0]
    both = [max(x, y) for x, y in zip(g, f)]
    with_ = [math.log1p(float(partners[name_bucket(w)])) for w in words] or [0.0]
    prev = text[:a].rstrip()[-1:]
    first = words[0].lower() if words else ""
    return [
        float(len(words)), max(both), min(both), g[0], f[-1], sum(x > 1 for x in both) / len(both), float(a == 0 or prev in ".!?\n"), float(s.isupper()),
        float(bool(_P6.search(s))), float(first in _SETS[5] or first in _SETS[6]), float(any(w.lower() in _SETS[6] for w in words)),
        float(bool(_INTRO.search(text[max(0, a - 24) : a]))), float(bool(_AGAINST.search(text[max(0, a - 16) : a]))), float(bool(_FOLLOW.match(text[b : b + 16]))), float(bool(_PLACE.match(text[b : b + 12]))),
        float(whole), float(prev == ","), float(text[b : b + 1] in ",.!"), float(bool(_P7.search(s) is None and not s.isupper())),
        max(with_), min(with_), float(bool(_STATED.search(text[max(0, a - 24) : a]))), float(any(w.lower() in _COMMON for w in words)),
        *_cues(before, after),
    ]


class Detector:
    """Candidate generators with one boosted model for numbers and names of each kind, and calibrated thresholds."""

    def __init__(self, models: dict, given: np.ndarray, family: np.ndarray, partners: np.ndarray | None = None):
        """``partners``: with how many others a name word goes; without it, every counted word with several."""
        self.models, self.given, self.family = models, given, family
        self.partners = np.where(np.maximum(given, family) > 0, 5, 0) if partners is None else partners
        self.known: dict[str, float] = {}

    def spans(self, text: str | None, whole_name: bool = False) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the selected spans of a text, without overlaps, in order; ``whole_name`` for a field of names."""
        if not text:
            return []
        t, at = flat(text)
        found: list[tuple[float, int, int, str]] = []
        if may_email(t):
            found += [(2.0 + p, a, b, "email") for a, b, p in self._judged("email", t, MAIL_LIKE, mail_features)]
        words = _WORDISH.findall(t.lower())
        if may_address(t, words):
            found += [(1.5 + p / 2, a, b, "address") for a, b, p in self._judged("address", t, ADDRESS, address_features)]
        if may_number(t):
            for m in NUMBER.finditer(t):
                a, b = m.span()
                if sum(c.isdigit() for c in m.group()) < LEAST_DIGITS:
                    continue
                row = number_features(t, a, b)
                p, k = max((self.models[k][0].one(row), k) for k in ("phone", "id_number"))
                if p >= self.models[k][1]:
                    found.append((1.0 + p / 4, a, b, k))
        found += self._names(t, whole_name, [(a, b) for _, a, b, _ in found], words)
        out: list[tuple[int, int, str]] = []
        for _, a, b, kind in sorted(found, key=lambda x: (-x[0], x[1])):
            if not any(x < b and a < y for x, y, _ in out):
                out.append((a, b, kind))
        out.sort()
        return out if at is None else [(at[a], at[b - 1] + 1, k) for a, b, k in out]

    def _judged(self, kind: str, t: str, generator, features) -> list[tuple[int, int, float]]:
        """The candidates of a generator that the trees of a kind accept."""
        model, cut = self.models[kind]
        out = []
        for m in generator.finditer(t):
            p = model.one(features(t, m.start(), m.end()))
            if p >= cut:
                out.append((m.start(), m.end(), p))
        return out

    def _names(self, t: str, whole: bool, taken, words) -> list[tuple[float, int, int, str]]:
        out = []
        if whole:
            s = t.strip()
            if taken or not s:
                return []
            a = t.index(s)
            parts = [w for w in _P8.split(s) if w]
            shaped = all(_P9.fullmatch(w) for w in parts) and len(parts) <= 4 and not any(c.isdigit() or c in "_&@" for c in s)
            if not shaped:
                low = [w for w in parts if _P10.fullmatch(w)]
                if len(low) != len(parts) or not 2 <= len(parts) <= 3 or not all(self._known(w) > 3 for w in parts):
                    return []
            p, cut = self._score(t, a, a + len(s), True)
            return [(p, a, a + len(s), "name")] if p >= cut else []
        for m in _FORM_NAME.finditer(t):
            a, b = m.span()
            if _ONE_SCRIPT.fullmatch(m.group()) and not any(x < b and a < y for x, y in taken):
                p, cut = self._score(t, a, b, False)
                if p >= cut:
                    out.append((p, a, b, "name"))
        for m in INTRODUCED.finditer(t) if may_introduce(t, words) else ():
            a = m.start(m.lastindex)
            ends = [a + w.end() for w in _P11.finditer(m[m.lastindex])]
            for b in reversed(ends):  # the longest first: it wins where scores are equal
                if any(x < b and a < y for x, y in taken):
                    continue
                p, cut = self._score(t, a, b, False)
                if p >= cut:
                    out.append((p, a, b, "name"))
        if not any(self._known(w.rstrip("'’")) > 0.7 for w in _MAY_NAME.findall(t)):
            return out
        for m in NAME.finditer(t):
            a, b = m.span()
            if any(x < b and a < y for x, y in taken):
                continue
            # the words of a run that may be a name, judged together and then without the first
            words = [(a + w.start(), a + w.end()) for w in _P11.finditer(m.group())]
            known = [self._known(t[x:y].strip(".,'’")) for x, y in words]
            i = 0
            while i < len(words):
                if known[i] < 0.7 and not (_P6.fullmatch(t[words[i][0] : words[i][1]]) and i + 1 < len(words) and known[i + 1] > 0.7):
                    i += 1
                    continue
                j = i + 1
                while j < len(words) and (known[j] > 0.7 or _P6.fullmatch(t[words[j][0] : words[j][1]])):
                    j += 1
                x, y = words[i][0], words[j - 1][1]
                p, cut = self._score(t, x, y, False)
                if p >= cut:
                    out.append((p, x, y, "name"))
                i = j
        return out

    def _known(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            b = name_bucket(w)
            got = self.known[w] = math.log1p(float(max(self.given[b], self.family[b])))
        return got

    def _score(self, t, a, b, whole):
        model, cut = self.models["name"]
        return model.one(name_features(t, a, b, self.given, self.family, whole, self.partners)), cut

    def redact(self, text: str | None, whole_name: bool = False) -> str | None:
        """A text with typed placeholders for the spans; the rest stays as it is."""
        spans = self.spans(text, whole_name)
        if not spans:
            return text
        out, at = [], 0
        for a, b, kind in spans:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join(out) + text[at:]


# --------------------------------------------------------------------------- examples
# Made-up words for the examples; real ones come from the corpus counts.
_GIVEN = "Alda Bron Cyra Dovan Elka Fenn Gerta Hale Ivo Jessa Korin Luma Marek Neva Osric Petra Quin Rolf Sanna Tilo".split()
_FAMILY = "Abernash Brikwell Corvand Dalmore Estrand Fallowin Grimsell Harvand Ilmari Jorwick Keldan Lorenth Mordane Nerwick Oslund".split()
# Fixed pairs, words of fixed pairs that are no names, and names that nothing counts.
_PAIR_GIVEN = "Orsel Tamsin Видана Ясмира نورين سهيمة তামিমা सुरेखा".split()
_PAIR_FAMILY = "Wendrake Ashgrove Корленова Тальмина بنداري قطلاني মণ্ডলিয়া भारद्वानी".split()
_PAIR_WORDS = "Happy Traveller Silent Garden Golden Lantern Morning Breeze Blue Harbour".split()
_NEW_GIVEN = "Ulvar Mirel Радомир Зарема ماجدين هديلة শিউলিনা किरनिका".split()
_NEW_FAMILY = "Tessing Holloran Ветлугова Шарымова الزرقان خليلوف চৌধরিনা मल्होरिया".split()
_PHONES = ["+44 20 ddd dddd", "+1 ddd ddd dddd", "+9dd dd ddd dddd", "+ddddddddddd", "0dddddddddd", "0dddd dddddd", "0ddd-ddddddd", "(ddd) ddd-dddd", "ddd.ddd.dddd", "ddd-ddd-dddd", "+dd ddd-dddd-dddd", "+90 5dd ddd dd dd", "01ddd-dddddd", "00dd ddd dddddd", "0ddddddddd", "+dd (d) ddd ddd dd"]
_IDS = ["ddddddddddd", "dddd dddd dddd", "ddddd-ddddddd-d", "ddd-dd-dddd", "dddddd-dd-dddd", "ZZddddddd", "dddddddddd", "Addddddd", "dddddddddddddddd", "dd.ddd.ddd-d", "ABddddddd", "ddddddddd", "dddd-dddd-dddd", "0ddddddddd", "0dddddddddd"]
_OTHERS = ["dddddddd", "20ddddddd", "2024dddd", "dd/dd/2024", "2024-0d-1d", "d.dd.d", "dddd-dddd-dd", "2024-dddddd", "dd.dd.dddd", "dddddddddd", "ddd.ddd.ddd", "dddd dddd", "dd-ddddd-dd", "ddddddddddd"]
_PHONE_TEXT = ["Call me on {}", "my number is {} and", "phone: {}", "tel. {}", "whatsapp {} please", "reach our desk on {} now", "Meine Nummer ist {} und", "Mon numéro est le {} et", "Mi teléfono es {} y", "Nomor saya {} dan", "Telefonum {} ve", "Мой номер {}, код", "رقم هاتفي هو {} وأنتظر", "میرا نمبر {} ہے", "मेरा नंबर {} है", "আমার ফোন নম্বর {}", "{}", "我的电话是{}", "電話番号は{}です", "the answer came from {} today", "Our desk answers on {}", "เบอร์ {}", "text {} any time", "ring {}"]
_ID_TEXT = ["passport no. {} for", "my national ID {} before", "ID {}, but", "I typed {} as my ID number", "ID number {}", "NIK saya {} selalu", "Kimlik numaram {} kabul", "Meine Ausweisnummer {} wird", "Mon numéro de carte d'identité {}", "Mi DNI {} no", "Мой паспорт {} не", "رقم هويتي {} مرفوض", "میرا شناختی کارڈ نمبر {} ہے", "मेरा आधार नंबर {} है", "আমার জাতীয় পরিচয়পত্র নম্বর {}", "your request for ID {}", "my SSN {} was", "我的身份证号码{}", "パスポート番号 {} が", "Registered, ID {}, but", "CNIC {} rejected"]
_OTHER_TEXT = ["Order {} was charged", "Invoice {} says", "Error code {} appears", "Build {} is", "order number {} never", "ticket {} closed", "version {} is", "receipt {} came", "Bestellung {} fehlt", "commande {} perdue", "pedido {} no", "Ref {} pending", "invoice number {}", "error {} on start", "It counts {} verses", "the code {} fails", "Sipariş {} yok", "Заказ {} пропал", "since {} it", "score {} of"]
_NAME_TEXT = ["My name is {} and I", "I am {} from Xville", "Regards, {}.", "{} here, my mail", "Ask {}, tel. 1", "Hello {}! Your", "Dear {}, thanks", "Yours, {}", "Best wishes, {} from", "My daughter {} uses", "Registered as {}, ID", "Ich heiße {} und", "Je m'appelle {} et", "Me llamo {} y", "Benim adım {} ve", "Nama saya {} dan", "Меня зовут {}, и", "اسمي {} وأحتاج", "میرا نام {} ہے", "मेरा नाम {} है", "আমার নাম {} এবং", "– {}, support team", "Salam {}, may", "Thanks to {} for help", "{} from support wrote", "my wife {} likes it", "{} says hello", "Hi {}, please"]
_STATED_TEXT = ["My name is {} and I", "My name is {}.", "Меня зовут {}, и", "Меня зовут {}, помогите", "اسمي {} وأحتاج", "میرا نام {} ہے", "मेरा नाम {} है", "আমার নাম {} এবং", "Me llamo {} y", "Ich heiße {} und", "Je m'appelle {}, et", "Benim adım {}."]
_FORM_TEXT = ["I met {} yesterday", "We asked {} for help", "and {} called me", "it was {} who answered", "the letter from {} said", "my neighbour {} has it", "then {} wrote back", "gave it to {}, who"]
_FORM_NOT_TEXT = ["the new {} is slow", "The {} page is gone", "open {} at dawn", "in {} we pray", "an app like {} has", "the {} button", "with {} on my phone", "from {} to {}", "Please {} now", "use {} instead of", "update {} and", "the city of {} is", "and {} do not", "to 12 Mill Road in {} again", "near {} we wait", "the mosque of {} is"]
_FORM_NOT = ["Prayer Times", "Night Mode", "Google Play", "Dark Theme", "Home Widget", "Hijri Calendar", "Old Town", "New Harbour", "Help Center", "Customer Service", "Middle East", "Smart Watch", "Fix This", "North City", "Quick Start", "Surah Korin", "Surah Neva", "Surah Petra", "Prophet Ivo", "Imam Fenn", "Masjid Luma", "South Oslund", "Kotal Nagar", "Port Estrand", "Old Mordane"]
_MAILS = ["{l}@{d}.org", "{l}@mail.{d}.com", "{l} (at) {d} (dot) net", "{l}[at]{d}[.]net", "{l} @ {d}.com", "{l} at {d} dot com", "{l}＠{d}.org", "{l} [at] {d}.example", "{l}(@){d}.net", "{l}@{d}.co.uk", "{l} <at> {d} <dot> org"]
_NO_MAILS = ["{n}@{n}", "{n} @ home", "5@{d}", "{d}@home", "{n} @ {n} pm", "look (at) {d}", "work (at) home", "x@y", "{d} [at] night", "me@work"]
_MAIL_TEXT = ["write to {} please", "my mail is {}", "{}", "contact {} for help", "Mein Postfach {} und", "mon adresse {} merci", "correo {} gracias", "e-posta {} ile", "kirim ke {} ya", "почта {} жду", "بريدي {} شكرا", "reply at {} soon"]
_NO_MAIL_TEXT = ["it rings {} each day", "prayer {} is late", "I {} it", "we pray {} always", "price {} now", "please {} again", "see {} there", "{} only"]
_STREETS = [*[f"{{n}} {{c}} {w}" for w in ("Street", "St.", "Road", "Rd.", "Avenue", "Ave.", "Lane", "Drive", "Close", "Court", "Square", "Terrace", "Crescent", "Hill", "Gardens", "View", "Way", "Place")], "{n} {c} Street, {d}", "{n} {c} Avenue, {d}", "{n} {c} Road, {d}", "Flat {n}, {c} Road", "House {n}, {c} Avenue", "House No. {n}, {c}",
    "Plot {n}, {c} Nagar", "Villa {n}, {c}", "Apt. {n}, {c} St.", "{n} rue de {c}", "{n}, boulevard {c}", "rue {c}", "Avenue {c}, {n}", "{c}straße {n}", "{c}weg {n}", "{c}platz {n}", "Calle {c} {n}", "Calle {c}, {n}", "Avenida {c} {n}", "Jl. {c} No. {n}", "Jalan {c} No. {n}", "Jl. {c}", "{c} Sok. No: {n}", "{c} Cad. No: {n}", "{c} Mah.",
    "ул. Лесная, д. {n}", "улица Мира {n}", "شارع النور {n}", "شارع النور، مبنى {n}", "मकान नं. {n}", "गली {n}", "वेलमूर रोड", "বাড়ি নং {n}", "রোড নং {n}", "مکان نمبر {n}", "روڈ {n}", "人民路 {n}号", "中山路{n}號", "{n}番地", "บ้านเลขที่ {n}"]
_NO_STREETS = ["Room {n}", "House {n} of", "Unit {n}", "Suite {n}", "Place {n}", "Villa {n} of", "Plot {n} of", "Apartment {n} of"]
_STREET_TEXT = ["I live at {}, thanks", "Deliver to {} again", "my address is {} and", "Ich wohne in der {} hier", "Ich wohne im {} und", "Sie ist im {} seit", "J'habite {}, merci", "Vivo en {} y", "Alamat saya {} dan", "Adresim {} ve", "Мой адрес {}, и", "عنواني {} وأنتظر", "मेरा पता {} है", "আমার ঠিকানা {} এবং", "{} is my home", "our office at {}", "send it to {}", "{}", "it came to {}.", "near {} is none", "from {} to work", "the shop in {} knows", "visit us at {} soon"]
_NO_STREET_TEXT = ["the tab {} of the game", "step {} fails", "in {} of the manual", "level {} is hard", "the screen {} is", "it shows {} there", "open {} and play"]
_NOT_NAME_TEXT = ["Surah {} and Surah {} do", "Sourate {} ne", "the prayer of {}", "Prophet {} said", "near {} Avenue is", "{} Street is", "the {} House app", "{} Mosque is", "in {} City we", "{} Hills is missing", "Sura {} fehlt", "Surat {} tidak", "Surah {}"]


def _digits(pattern: str, r: random.Random) -> str:
    return "".join(str(r.randrange(10)) if c == "d" else c for c in pattern)


def examples(kind: str, n: int = 2400, seed: int = 7) -> tuple[list[list[float]], list[int], np.ndarray, np.ndarray, list[int]]:
    """Features and labels of made-up spans for one model, counts of name words, and the number of the phrase that each span stands in; made ``n`` times."""
    r = random.Random(seed)
    phrases: list[int] = []
    given, family, partners = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for w in _GIVEN + _FAMILY:
        partners[name_bucket(w)] = r.choice([2, 4, 12, 40])
    for a, b in zip(_PAIR_GIVEN + _PAIR_WORDS[::2], _PAIR_FAMILY + _PAIR_WORDS[1::2]):
        given[name_bucket(a)] = family[name_bucket(b)] = r.choice([3, 20, 200, 3000])
        partners[name_bucket(a)] = partners[name_bucket(b)] = 1
    for w in _GIVEN:
        given[name_bucket(w)] = r.choice([3, 20, 200, 3000])
    for w in _FAMILY:
        family[name_bucket(w)] = r.choice([3, 20, 200, 3000])
    x, y = [], []
    for _ in range(n):
        if kind in ("email", "address"):
            good = r.random() < 0.6
            form, template = r.choice((_MAILS if good else _NO_MAILS) if kind == "email" else (_STREETS if good else _NO_STREETS)), r.choice((_MAIL_TEXT if good else _NO_MAIL_TEXT) if kind == "email" else (_STREET_TEXT if good else _NO_STREET_TEXT))
            local = r.choice(_GIVEN).lower() + r.choice(["", ".x", "_99", "77", "+app", "-q"])
            value = form.format(n=r.randrange(1, 300), c=r.choice([r.choice(_FAMILY), f"{r.choice(_GIVEN)} {r.choice(_FAMILY)}"]), d=r.choice(_FAMILY)) if kind == "address" else form.format(l=local, d=r.choice(["example", "site", "my-host", "box9"]), n=r.randrange(1, 300))
            text = flat(template.replace("{}", value))[0]
            for m in (MAIL_LIKE if kind == "email" else ADDRESS).finditer(text):
                x.append((mail_features if kind == "email" else address_features)(text, m.start(), m.end()))
                y.append(int(good))
                phrases.append(zlib.crc32(template.encode()))
            continue
        if kind == "name":
            good = r.random() < 0.5
            a, b = r.choice(_GIVEN), r.choice(_FAMILY)
            value = r.choice([f"{a} {b}", a, f"{a[0]}. {b}", b, f"{a} {b[0]}.", f"{a} {b}".upper()])
            whole = r.random() < 0.25
            kind_of = r.random()  # a name that is counted with several partners, one in a fixed pair, one that is not counted
            if kind_of < 0.3:
                k = r.randrange(len(_PAIR_GIVEN))
                a, b = (_PAIR_GIVEN[k], _PAIR_FAMILY[k]) if kind_of < 0.15 else (_NEW_GIVEN[k], _NEW_FAMILY[k])
                value = f"{a} {b}" if whole else r.choice([f"{a} {b}", f"{a} {b}", a])
            if whole and good and r.random() < 0.3:
                value = r.choice(["سلمى", "করিম", "健二", "सीमा"]) + " " + r.choice(["درويش", "সরকার", "山田", "वर्मा"])
            if whole:
                value = value if good else r.choice(["Anonymous", "Guest", "Happy Bird", "Night Owl", "Deleted Account", "Reader", "Google User", "A Fan", "PixelFox", "SilentFan", "Moonlit"])
                value = f"{b}, {a}" if good and r.random() < 0.2 else value
                text, at = value, 0
            else:
                template = r.choice((_NAME_TEXT if kind_of >= 0.3 else _STATED_TEXT + _NAME_TEXT[:12]) if good else _NOT_NAME_TEXT)
                if not good and r.random() < 0.3:
                    # ordinary capitalised words that happen to be in no list of names
                    value, template = r.choice([*_PAIR_WORDS, "Please", "Android", "Version", "Morning", "Kaaba", "Quillbury"]), r.choice(["{} works well", "on {} it fails", "We like {} a lot", "{}, why"])
                elif not good and r.random() < 0.3:
                    value, template = r.choice(COMMON).capitalize(), r.choice(_NAME_TEXT + _STATED_TEXT)
                if not whole and r.random() < 0.25:  # by their form alone
                    a, b = (r.choice(_NEW_GIVEN[:2] + _GIVEN), r.choice(_NEW_FAMILY[:2] + _FAMILY)) if r.random() < 0.5 else ("Wil" + r.choice(["ram", "bert", "helm", "frid"]), r.choice(["Stege", "Tor", "Hal", "Brand"]) + r.choice(["mann", "vik", "dane", "sson"]))
                    value, template = (f"{a} {b}", r.choice(_FORM_TEXT)) if good else (r.choice(_FORM_NOT), r.choice(_FORM_NOT_TEXT))
                text = template.replace("{}", value)
                at = text.index(value)
            phrases.append(zlib.crc32((text if whole else template).encode()))
            x.append(name_features(text, at, at + len(value), given, family, whole, partners))
            y.append(int(good))
        else:
            which = r.choice(["phone", "id_number", "other"])
            form, text = {"phone": (_PHONES, _PHONE_TEXT), "id_number": (_IDS, _ID_TEXT), "other": (_OTHERS, _OTHER_TEXT)}[which]
            value = _digits(r.choice(form), r)
            template = r.choice(text)
            phrases.append(zlib.crc32(template.encode()))
            text = ("" if r.random() < 0.5 else r.choice(["It broke again. ", "Dear team, ", "Why? "])) + template.format(value)
            t = flat(text)[0]
            at = t.index(value)
            x.append(number_features(t, at, at + len(value)))
            y.append(int(which == kind))
    return x, y, given, family, phrases


def train() -> dict[str, tuple[Boosted, float]]:
    """A boosted model and a threshold for each kind that has one; thresholds are the best F1 on the examples of a held-out third of the phrases."""
    out = {}
    for kind in KINDS:
        x, y, _, _, phrases = examples(kind)
        x, y = np.array(x), np.array(y, dtype=float)
        held = np.array(phrases) % 3 == 0
        model = Boosted().fit(x[~held], y[~held])
        p = np.array([model.one(r) for r in x[held]])
        best = max(((2 * ((p >= c) & (y[held] == 1)).sum() / max(1, (p >= c).sum() + (y[held] == 1).sum()), -abs(c - 0.5), c) for c in np.arange(0.2, 0.81, 0.05)))
        out[kind] = (Boosted().fit(x, y), float(best[2]))
    return out
