"""Sentences, encodings, look-alikes, tokens, personal data and leaks on literal texts."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlode.llm import encoding, leaks, levels, lookalikes, personal, sentences, tokens


def guess(piece):
    """The language of the examples by a word."""
    return "fr" if "Minuten" not in piece and "est" in piece.split() else "de" if "dauert" in piece else "en"


def cut(t):
    return [t[a - 1 : b] for a, b in sentences.split(t, guess)] if t else sentences.split(t)


@pytest.mark.parametrize(
    "t, want",
    [
        ("It works. It fails!", ["It works.", "It fails!"]),
        ("Some prayers, e.g. Asr, are shown. The alarm rings at 5.34 a.m. instead.", ["Some prayers, e.g. Asr, are shown.", "The alarm rings at 5.34 a.m. instead."]),
        ("It differs by 12 min. Surah plays. See ch. 3, pp. 12–14, please.", ["It differs by 12 min.", "Surah plays.", "See ch. 3, pp. 12–14, please."]),
        ("The U.S. consulate is near.Nice one", ["The U.S. consulate is near.", "Nice one"]),
        ('It says "No signal! Try again." and closes. Ok', ['It says "No signal! Try again." and closes.', "Ok"]),
        ("It froze (again!!) during use", ["It froze (again!!) during use"]),
        ("They call it ‘Pro. Plus.’ but no", ["They call it ‘Pro. Plus.’ but no"]),
        ("Great! 🙏🏽 Thanks", ["Great! 🙏🏽", "Thanks"]),
        ("one\n\n two \nthree", ["one", "two", "three"]),
        ("已经坏了。为什么？！好", ["已经坏了。", "为什么？！", "好"]),
        ("「お待ちください。」と出てから閉じます。はい", ["「お待ちください。」と出てから閉じます。", "はい"]),
        ("काम नहीं करता। अच्छा है", ["काम नहीं करता।", "अच्छा है"]),
        ("کام نہیں کرتا۔ کیوں؟", ["کام نہیں کرتا۔", "کیوں؟"]),
        ('يظهر "انتظر!" ثم يغلق. لماذا؟', ['يظهر "انتظر!" ثم يغلق.', "لماذا؟"]),
        ("แอปดีมาก ใช้ทุกวัน", ["แอปดีมาก", "ใช้ทุกวัน"]),
        ("4 мин., т. е. много. Плохо", ["4 мин., т. е. много.", "Плохо"]),
        ("Das dauert ca. 3 Min., z. B. am Abend. Gut", ["Das dauert ca. 3 Min., z. B. am Abend.", "Gut"]),
        ("Works with v. 4.20.0 but not apps.example.com/v2.", ["Works with v. 4.20.0 but not apps.example.com/v2."]),
        ("Version 6.7.4... no thanks.", ["Version 6.7.4... no thanks."]),
        ("Is it broken?? yes!!! Bye", ["Is it broken??", "yes!!!", "Bye"]),
        (None, []),
        ("", []),
        ("  \n ", []),
        ("👍👍", []),
    ],
)
def test_sentences(t, want):
    assert cut(t) == want


@pytest.mark.parametrize(
    "t, n",
    [
        ("ខ្ញុំចូលចិត្តវា។ វាល្អណាស់។", 2),  # Khmer
        ("ကောင်းပါတယ်။ ကြိုက်ပါတယ်။", 2),  # Myanmar
        ("ܛܒ ܗܘ܀ ܫܦܝܪ ܗܘ܀", 2),  # Syriac
        ("ጥሩ ነው። አመሰግናለሁ።", 2),  # Ethiopic
        ("Լավ է։ Շատ լավ։", 2),  # Armenian
        ("The strap is 12 mm. Next one is fine.", 2),
        ("He was a cad. She left at once.", 2),
        ("See the rev. It works now.", 2),
        ("Rev. Smith wrote. It works now.", 2),
        ("It reads “" + "We go now. " * 30 + "Fine.” and closes.", 1),
    ],
)
def test_sentences_of_all_scripts(t, n):
    assert len(sentences.split(t, lambda _: "en")) == n


@pytest.mark.parametrize("lang, n", [("fr", 1), ("en", 2), (None, 2)])
def test_abbreviations_go_by_the_language(lang, n):
    assert len(sentences.split("Bonjour mme. Dupont est ici", lambda _: lang)) == n


def test_a_hundredfold_text_is_cut_alike():
    once = "Dr. Who said “Stop. Now!” twice. It cost approx. 3.50. ថ្ងៃ។ Ok?"
    n = len(cut(once))
    assert len(cut((once + "\n") * 100)) == 100 * n


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab A.!?\"'()\n…。।5🙏 é", max_size=60))
def test_sentences_cover_in_order(t):
    spans = sentences.split(t)
    assert all(1 <= a <= b <= len(t) for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    covered = {i for a, b in spans for i in range(a - 1, b)}
    assert all(i in covered for i, c in enumerate(t) if c.isalnum())
    assert all(t[a - 1 : b] == t[a - 1 : b].strip() for a, b in spans)


def test_long_texts_are_read_whole():
    assert len(sentences.split("It works well. " * 20_000)) == 20_000


TEXTS = ["naïve café – “quoted”", "Пожалуйста, верните всё", "لماذا الإعلانات كثيرة", "কাজ করে না", "सब ठीक है", "我们城市的礼拜时间晚了", "Çalışmıyor artık, şaşırdım", "thanks 🙏 it’s fine"]


@pytest.mark.parametrize("t, w", [(t, w) for t, w in itertools.product(TEXTS, ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437")) if not (w == "cp1251" and t[0] in "nÇ")])
def test_utf8_read_wrongly_is_found_and_restored(t, w):
    table = {b: c for c, b in encoding.REVERSE[w].items()}
    wrong = "".join(chr(b) if b < 128 else table.get(b, chr(b)) for b in t.encode())
    assert encoding.is_damaged(wrong)
    model = encoding.Model(np.zeros(encoding.N_BUCKETS), np.ones(encoding.N_BUCKETS))
    assert encoding.Restorer(model).restore(wrong) == (True, t)


@pytest.mark.parametrize("t", [*TEXTS, None, "", "????", "Why?? Really?", "TRÈS DÉÇU, ÇA PLANTE À CHAQUE DÉMARRAGE", "Dice «¡Espere!» y", "«Подождите!» и всё", "12–14, costs £5 · ok", "ขอบคุณ", "کیا آپ", "谢谢", "谢谢你们！", "谢谢\ufeff你们"])
def test_clean_texts_are_not_damaged(t):
    assert encoding.is_damaged(t) == (t == "????")


@pytest.mark.parametrize("t", ["Oraci�n", "????? ?? ???", "Ñóõóð è èôòàð", "kapanýyor yazýlar", "жБЕРЮ ЙПЮЯХБШЕ"])
def test_other_damage(t):
    assert encoding.is_damaged(t)


def corpus(*texts):
    words, pairs = np.zeros(encoding.N_BUCKETS), np.zeros(encoding.N_BUCKETS)
    for w in " ".join(texts).lower().split():
        words[encoding.bucket(w)] += 50
        for a, b in zip(f" {w} ", f"{w} "):
            pairs[encoding.bucket(a + b)] += 50
    return encoding.Restorer(encoding.Model(words, pairs))


def test_the_decoder_decides():
    r = corpus("لماذا تطلبون إذن الموقع كل مرة", "café très", "сухур и ифтар")
    assert r.restore("Привет áãÇÐÇ ÊØáÈæä ÅÐä") == (True, "Привет لماذا تطلبون إذن")  # UTF-8 by chance inside a code page
    assert r.restore("Ñóõóð è èôòàð") == (True, "Сухур и ифтар")
    assert r.restore("The cafÃ© costs ВЈ3") == (True, "The café costs £3") or r.restore("The cafÃ©") == (True, "The café")
    assert r.restore("café très") == (False, None)
    sure = corpus("ýþð " * 30 + "ýþðýþ")  # a corpus in which such words are ordinary
    assert sure.restore("ýþð ýþðýþ") == (False, None)


def test_successors_of_very_many_characters_equal_counting_all():
    r = corpus("祈祷时间 我们城市 每天使用")
    options = encoding._options((None,), encoding.WHOLE, frozenset({"Hani", "Kana"}))
    assert options.__class__ is encoding._Many
    for a in "祈时我 天":
        n = {c: r.model.pairs[encoding.bucket(a + c)] for c in options}
        best = sorted((c for c in options if n[c] > 0), key=lambda c: (-n[c], options.index(c)))[: r.beam]
        assert list(r._after(a, options)) == best


def test_lost_characters_come_from_the_corpus():
    words, pairs = np.zeros(encoding.N_BUCKETS), np.zeros(encoding.N_BUCKETS)
    for w, n in (("oración", 50), ("fácil", 30)):
        words[encoding.bucket(w)] += n
        for a, b in zip(f" {w} ", f"{w} "):
            pairs[encoding.bucket(a + b)] += n
    assert encoding.Restorer(encoding.Model(words, pairs)).restore("Oraci�n F�cil") == (True, "Oración Fácil")


@pytest.mark.parametrize(
    "t, want",
    [
        ("الص�اة", "الصلاة"),  # a letter
        ("الص��اة", "الصلاة"),  # or its two bytes
        ("ন�মাজ", "নামাজ"),
        ("प्र�र्थना", "प्रार्थना"),
        ("мол�тва", "молитва"),
        ("O�ación", "Oración"),
        ("祈祷�间", "祈祷时间"),
        ("OraciÃ�n", "Oración"),
        ("Ð¼Ð¾Ð»Ð¸Ñ�Ð²Ð°", "молитва"),
        ("ج��ق�", None),
        ("���", None),
    ],
)
def test_lost_bytes_come_back_in_their_own_script(t, want):
    words, pairs = np.zeros(encoding.N_BUCKETS), np.zeros(encoding.N_BUCKETS)
    for w in ("الصلاة", "নামাজ", "प्रार्थना", "молитва", "oración", "祈祷时间"):
        words[encoding.bucket(w)] += 50
        for a, b in zip(f" {w} ", f"{w} "):
            pairs[encoding.bucket(a + b)] += 50
    assert encoding.Restorer(encoding.Model(words, pairs)).restore(t) == (True, want)


@pytest.mark.parametrize("t", ["ｍｕｃｈ", "cοver", "Му whоlе", "th​at", "a b", "ofﬂine", "été", "⽤了", "ｱﾌﾟﾘ", "wid­get", "версиa", "ميں ہے", "no﻿t"])
def test_odd_texts(t):
    assert lookalikes.is_odd(t)
    assert not lookalikes.is_odd(lookalikes.plain(t))


@pytest.mark.parametrize("t", [None, "", "plain", "naïve – “x” …", "র‍্যাম", "👩‍👧 ❤️", "您好！好，是？", "क़िताब", "Çalışmıyor artık", "всё", "١٢٣ نعم", "it’s 40°"])
def test_plain_texts_stay(t):
    assert not lookalikes.is_odd(t) and lookalikes.plain(t) == t


def test_trie_spells_look_alikes():
    trie = lookalikes.Trie([("cover", 5), ("pay", 9), ("раз", 3)])
    assert trie.spell("cοvеr") == "cover" and trie.spell("co​ver") == "cover" and trie.spell("рау") == "pay" and trie.spell("zzz") is None
    assert trie.spell("covar", 1.0) == "cover"
    assert lookalikes.plain("Ｃｏｖｅｒ it", trie) == "Cover it"


def test_the_automaton_decides_what_tokens_of_look_alikes_mean():
    trie = lookalikes.Trie([("too", 9), ("many", 8), ("with", 7), ("с", 9), ("нами", 3), ("ہے", 4), ("کی", 4), ("cover", 5), ("नमाज", 5)])
    for t, want in (
        ("Τοο many ads", "Too many ads"),
        ("это c нами", "это с нами"),  # a Latin c between Cyrillic words
        ("это с нами", "это с нами"),
        ("и а к", "и а к"),
        ("vitamin C is here", "vitamin C is here"),
        ("cᴏver it with me", "cover it with me"),  # a small capital: one edit
        ("cᴏvᴇr it with me", "cᴏvᴇr it with me"),  # two edits are too many
        ("नमा\u200bज है", "नमाज है"),
        ("co\u0301ver", "cóver"),
        (None, None),
        ("", ""),
    ):
        assert lookalikes.plain(t, trie) == want
    # without the vocabulary these stay as they are
    assert lookalikes.plain("Τοο many ads") == "Τοο many ads" and lookalikes.plain("cᴏver it with me") == "cᴏver it with me"
    assert lookalikes.plain("Τοο mаny ads " * 500, trie) == "Too many ads " * 500


@pytest.mark.parametrize("t", ["naïve café – “quoted” ’s", "Пожалуйста, а я", "لماذا الإعلانات كثيرة", "कार्य क्‍ष", "我们，城市！", "👩‍👧 ok ❤️", "ড়", "ড\u09bc", "Ünlü İstanbul ışık", "αβγ δοκιμή"])
def test_plain_texts_stay(t):
    assert lookalikes.plain(t, lookalikes.Trie([("ok", 1)])) == t


@pytest.fixture(scope="module")
def encoder():
    path = tokens.tokenizer_path()
    try:
        return tokens.Encoder(path)
    except OSError:
        pytest.skip("no vocabulary files here")


def test_tokens_equal_the_public_tokenizer(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={t: i for i, t in enumerate(encoder.tokens)}, special_tokens={})
    texts = [*TEXTS, "<|endoftext|> <unk>", " \t\n ", "a" * 3000, "x" + "▁" * 3, "\x00\x01"]
    assert encoder.encode_batch(texts) == [own.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(t=st.text(max_size=80))
def test_tokens_round_trip(encoder, t):
    t = t.encode("utf-8", "ignore").decode()
    assert encoder.decode(encoder.encode_batch([t])[0]) == t


def test_tokens_of_nothing(encoder):
    assert encoder.encode_batch([None, ""]) == [[], []]


VOC = [f"w{i}" for i in range(400)]


def items(n=30, seed=1):
    r = random.Random(seed)
    return [(i, "Read the case and answer. " * (i % 3 == 0) + " ".join(r.sample(VOC, 45)) + ".") for i in range(n)]


@pytest.mark.parametrize("words, edits, want", [(18, 0, True), (17, 0, False), (18, 2, True), (27, 3, True), (45, 0, True), (12, 0, False)])
def test_leaks(words, edits, want):
    its = items()
    ix = leaks.Index(its)
    r = random.Random(3)
    for i, text in its:
        ws = leaks.plain_words(text.split("answer. ")[-1])
        span = ws[5 : 5 + words]
        for k in range(edits):
            span[3 + 8 * k] = "changed"
        doc = [r.choice(["the", "a", "other", "text"]) for _ in range(90)] + span + [r.choice(["more", "of", "it"]) for _ in range(70)]
        got = {ix.ids[k] for k in ix.carried(doc)}
        assert got == ({i} if want else set())


def test_shared_instruction_is_not_counted():
    ix = leaks.Index(items())
    assert ix.carried(leaks.plain_words("Read the case and answer. " * 20)) == {}


@pytest.mark.parametrize("n", [3, 100, 400])
def test_a_long_instruction_of_three_items_is_not_counted_among_any_number(n):
    r = random.Random(6)
    say = "Please " + " ".join(f"say{i}" for i in range(23)) + ". "
    its = [(i, (say if i < 3 else "") + " ".join(r.sample(VOC, 45)) + ".") for i in range(n)]
    assert leaks.Index(its).carried(leaks.plain_words("noise " * 30 + say + " more" * 30)) == {}


def test_retrieval_equals_verifying_every_pair():
    its = items(25, 4)
    ix = leaks.Index(its, {w: 3 for w in VOC[:200]}, 50)
    r = random.Random(9)
    for _ in range(120):
        ws = list(r.choice(ix.words))
        a = r.randrange(len(ws) - 20)
        span = ws[a : a + r.randrange(14, 40)]
        for _k in range(r.randrange(4)):
            at = r.randrange(len(span))
            span[at : at + 1] = r.choice([[], ["odd"], [span[at], "put"]])
        doc = r.choices(VOC, k=r.randrange(70)) + span + r.choices(VOC, k=r.randrange(70))
        brute = {k for k in range(len(ix.ids)) if leaks.overlap(doc, ix.words[k], ix.grams[k])}
        assert set(ix.carried(doc)) == brute


def test_wand_loses_nothing():
    its = items(60, 2)
    ix = leaks.Index(its)
    r = random.Random(5)
    for _ in range(150):
        terms = set(r.sample(VOC, 40)) | set(r.choice(ix.words)[:15])
        terms = {t for t in terms if t in ix.top}
        brute = [k for k in range(len(ix.ids)) if sum(ix.impact[k].get(t, 0.0) for t in terms) >= 1.0]
        assert sorted(ix.search(terms)) == brute


def test_markup_case_and_look_alikes_do_not_matter():
    assert leaks.plain_words("<p>The <b>Cat</b>&amp; d​оg’s") == ["the", "cat", "dogs"]
    assert leaks.plain_words(None) == [] and leaks.Index([]).carried(["a"] * 50) == {}


@pytest.fixture(scope="module")
def detector():
    given_, family = np.zeros(personal.BUCKETS), np.zeros(personal.BUCKETS)
    for w in ("nadia", "omar", "maryam", "yusuf"):
        given_[personal.name_bucket(w)] = 90
    for w in ("velmoor", "okrambe"):
        family[personal.name_bucket(w)] = 90
    return personal.Detector(personal.train(), given_, family)


@pytest.mark.parametrize(
    "t, want",
    [
        ("Write to a.b+c@mail.example.org please", {"email"}),
        ("reach me at nadia-q (at) mail (dot) example (dot) org", {"email"}),
        ("mail x [at] y.example for help", {"email"}),
        ("Call me on +44 20 7946 0958 please.", {"phone"}),
        ("My number is (202) 555-0163 and I get no code.", {"phone"}),
        ("رقم هاتفي هو ٠٥٠٠٠٠٠٧٩٠ وأنتظر", {"phone"}),
        ("I typed 00000-1851579-8 as my ID number", {"id_number"}),
        ("my passport no. ZZ0616776 for a compass", {"id_number"}),
        ("Deliver to 65 Weaver Avenue again", {"address"}),
        ("Ich wohne in der Lindenstraße 12 hier", {"address"}),
        ("My name is Nadia Velmoor and I need help", {"name"}),
        ("Hello Omar! Your feedback helps", {"name"}),
        ("Order GPX-2024-008111 was charged. Error code 4471-0092-33. Build 20240617. Invoice 00022771 says 12/03/2024.", set()),
        ("Surah Maryam and Surah Yusuf do not play. I follow @dawnreminders.", set()),
        ("Version 10.2.3 costs 12.50 since Ramadan", set()),
        (None, set()),
        ("", set()),
    ],
)
def test_personal(detector, t, want):
    assert {k for *_, k in detector.spans(t)} == want


def test_names_of_fixed_pairs_and_names_that_nothing_counts():
    given_, family, partners = (np.zeros(personal.BUCKETS) for _ in range(3))
    for a, b in (("ольга", "муршанова"), ("يوسف", "بنصرال"), ("happy", "traveller")):
        given_[personal.name_bucket(a)] = family[personal.name_bucket(b)] = 250
        partners[personal.name_bucket(a)] = partners[personal.name_bucket(b)] = 1
    d = personal.Detector(personal.train(), given_, family, partners)
    for t, want in (
        ("Меня зовут Ольга Муршанова, помогите мне.", "Ольга Муршанова"),
        ("اسمي يوسف بنصرال وأحتاج إلى مساعدة.", "يوسف بنصرال"),
        ("My name is Torvik Halmedan and I need help.", "Torvik Halmedan"),
    ):
        assert [(t[a:b], k) for a, b, k in d.spans(t)] == [(want, "name")]
    for t in ("I met Ulrich Stegemann yesterday", "Dear John Smith", "My name is Ulrich Stegemann"):
        assert [k for *_, k in personal.Detector(personal.train(), *(np.zeros(personal.BUCKETS) for _ in range(3))).spans(t)] == ["name"]
    for t in ("Happy with it. Please help", "Hello Everyone, it works well", "اسمي لا يظهر"):
        assert not d.spans(t)


@pytest.mark.parametrize(
    "t, generator, gate",
    [
        ("leila.ost (at) example (dot) net", personal.EMAIL, personal.may_email),
        ("prayer.fan[at]example[.]net", personal.EMAIL, personal.may_email),
        ("leila ＠ example.net", personal.EMAIL, personal.may_email),
        ("leila at example dot net", personal.EMAIL, personal.may_email),
        ("LEILA AT EXAMPLE DOT NET", personal.EMAIL, personal.may_email),
        ("leila At example Dot net", personal.EMAIL, personal.may_email),
        ("(0441) (12) 3456", personal.NUMBER, personal.may_number),
        ("+44 20 7946 0958", personal.NUMBER, personal.may_number),
        ("H.No. 45", personal.ADDRESS, personal.may_address),
        ("Av. Juárez 12", personal.ADDRESS, personal.may_address),
        ("Lindenweg  12", personal.ADDRESS, personal.may_address),
        ("переулок Лесной 4", personal.ADDRESS, personal.may_address),
        ("人民路 12号", personal.ADDRESS, personal.may_address),
        ("House 12", personal.ADDRESS, personal.may_address),
        ("H.No. 45", personal.ADDRESS, personal.may_address),
        ("at 5 Old Mill View", personal.ADDRESS, personal.may_address),
        ("Lindenstr.  12", personal.ADDRESS, personal.may_address),
        ("Bergstrasse\n4", personal.ADDRESS, personal.may_address),
        ("My name's Ann", personal.INTRODUCED, personal.may_introduce),
        ("I'm Ann", personal.INTRODUCED, personal.may_introduce),
        ("Mein Name ist Ann", personal.INTRODUCED, personal.may_introduce),
        ("Je m'appelle Ann", personal.INTRODUCED, personal.may_introduce),
        ("this is Ann", personal.INTRODUCED, personal.may_introduce),
        *[(t, personal.INTRODUCED, personal.may_introduce) for t in ("Ich heiße Ann", "Benim adım Ann", "ismim Ann", "Меня зовут Анна", "моё имя Анна", "اسمي يوسف", "میرا نام یوسف", "मेरा नाम सीमा", "আমার নাম করিম", "我叫王明。", "名前は山田です", "ชื่อ สมชาย")],
        ("my wife Ann", personal.INTRODUCED, personal.may_introduce),
    ],
)
def test_matches_of_the_generators_pass_the_gates(t, generator, gate):
    flat = personal.flat(t)[0]
    assert generator.search(flat) and gate(flat)


def test_redaction_keeps_the_rest(detector):
    assert detector.redact("Call me on ０３００-0000097 now") == "Call me on [PHONE] now"
    assert detector.spans("Nadia Velmoor", True) and not detector.spans("pixelmoon42", True) and not detector.spans("Anonymous", True)


def test_boosting_is_accurate_on_held_out_examples():
    trained = personal.train()
    for kind in personal.KINDS:
        x, y, *_ = personal.examples(kind, 1500, seed=99)
        model, cut_ = trained[kind]
        guess = np.array([model.one(r) >= cut_ for r in x])
        assert (guess == np.array(y)).mean() > 0.93


@pytest.mark.parametrize("kind", personal.KINDS)
def test_thresholds_hold_on_phrases_that_the_trees_never_saw(kind):
    x, y, _g, _f, phrases = personal.examples(kind)
    x, y, held = np.array(x), np.array(y), np.array(phrases) % 3 == 0
    assert set(np.array(phrases)[held]).isdisjoint(np.array(phrases)[~held])
    model = personal.Boosted().fit(x[~held], y[~held].astype(float))
    guess = np.array([model.one(r) >= 0.5 for r in x[held]])
    assert (guess == y[held]).mean() > 0.85


def test_trees_judge_mail_and_addresses(detector):
    for t in ("we meet 5 @ home", "score 3 @ 5 pm now"):
        assert not [k for *_, k in detector.spans(t) if k == "email"]
    assert not [k for *_, k in detector.spans("the tab Unit 4 of the game") if k == "address"]


def test_long_sentences_are_one_unit_and_runs_keep_every_word():
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(47)]
    for end in (".", "?", "!”"):
        assert levels.units(" ".join(words) + end) == [(1, words)]
    runs = [ws for _, ws in levels.units(" ".join(words))]
    assert len(runs) == 3 and sum(runs, []) == words
