"""The operators on Spark frames: nulls, empties, long texts, repeats, clashing columns; languages and levels."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reviewlode.llm import encoding_ops, language_ops, leaks, levels, lookalike_ops, personal_ops, queries, sentence_ops, tokens
from reviewlode.llm import languages as L

DATA = "/root/testdata/sf0.001"
EN = ["My whole family depends on the compass every day", "They moved the player behind a subscription", "The letters are too small for my mother", "Please bring back the old calendar", "Why does it reset every night"]
FR = ["Toute ma famille utilise cette application chaque jour", "Les lettres sont beaucoup trop petites pour ma mère", "Pourquoi les réglages disparaissent chaque nuit", "Merci de remettre le calendrier comme avant"]
RU = ["Почему настройки сбрасываются каждую ночь", "Верните старый календарь пожалуйста", "Вся наша семья пользуется каждый день"]
TR = ["Neden her gece ayarlar sıfırlanıyor", "Lütfen eski takvimi geri getirin", "Yazılar çok küçük ama renkler güzel"]


@pytest.fixture(scope="module")
def counts():
    rows = [(lang, " ".join(r.sample(ts, 2))) for lang, ts in (("en", EN), ("fr", FR), ("ru", RU), ("tr", TR)) for r in [random.Random(4)] for _ in range(60)]
    rows += [("fr", EN[0])] * 3  # wrong labels
    return L.fit(rows)


@pytest.mark.parametrize(
    "t, want",
    [
        (EN[0] + ".", ["en"]), (FR[1] + "!", ["fr"]), (RU[0] + "?", ["ru"]), (EN[1] + ". " + FR[2] + "?", ["en", "fr"]), (FR[0] + ", " + EN[3], ["fr", "en"]),
        (EN[0] + ". " + RU[1] + ". " + EN[2], ["en", "ru", "en"]), ("Му whоlе fаmіlу dереnds оn thе соmраss", ["en"]), ("Neden her gece ayarlar sÄ±fÄ±rlanÄ±yor", ["tr"]),
        ("12 / 5 👍", []), (None, []), ("", []), ((EN[2] + ". ") * 3000, ["en"]),
    ],
)
def test_languages(counts, t, want):
    got = L.stretches(t, L.Ngrams(counts))
    assert [lang for lang, _ in got] == want and all(0 < c <= 1.0001 for _, c in got)


@pytest.mark.parametrize("times", [5, 50, 1000])
def test_one_foreign_sentence_is_kept_at_any_length(counts, times):
    many = (EN[0] + ". ") * (times // 2)
    assert [lang for lang, _ in L.stretches(many + FR[0] + ". " + many, L.Ngrams(counts))] == ["en", "fr", "en"]


def test_the_bound_loses_no_language(counts):
    """A text that the bound calls monolingual gets no second language from the mixture either."""
    m, r = L.Ngrams(counts), random.Random(3)
    for _ in range(200):
        ws = [w for t in r.sample(EN + FR + TR, 2) for w in t.lower().split() if r.random() < 0.6] or ["the"]
        like = m.words(ws)
        k, rivals = L._rivals(like.copy(), None)
        units = L.np.add.reduceat(like, list(range(0, len(ws), L.UNIT)), axis=0)
        for j in set(range(len(L.LANGS))) - set(rivals) - {k}:
            assert L.mixture(units[:, [k, j]])[1] - units[:, k].sum() <= L.PENALTY


def test_packed_models_are_the_same(counts):
    m, n = L.Ngrams(counts), L.Ngrams.unpacked(L.Ngrams(counts).packed())
    assert (m.words(["family", "xyz", "ночь"]) == n.words(["family", "xyz", "ночь"])).all()


@pytest.mark.parametrize("label, want", [("en_GB", "en"), ("EN", "en"), ("eng", "en"), ("in", "id"), ("ger", "de"), ("zh-Hans", "zh"), ("??", None), ("", None), (None, None), ("und", None), ("ms", None)])
def test_labels(label, want):
    assert L.canonical(label) == want


def test_mixture_proportions(counts):
    m = L.Ngrams(counts)
    ws = L.tokens(EN[0])[0] + L.tokens(FR[0])[0]
    pi = dict(zip(L.LANGS, L.mixture(m.words(ws))[0]))
    assert pi["en"] > 0.3 and pi["fr"] > 0.3 and pi["en"] + pi["fr"] > 0.85


ROWS = [(1, None, "x", 1), (2, "", "x", 1), (3, "Fine. Ok!", "y", 2), (3, "Fine. Ok!", "y", 2), (4, "long text here. " * 5000, None, None), (5, "It’s brokÃ©n", "z", 3)]
SCHEMA = "row_id bigint, content string, lang string, label int"


def test_sentences_frame(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sentence_ops.sentences(df, "row_id", "content").groupBy("row_id").count().collect()
    assert {r.row_id: r["count"] for r in got} == {3: 4, 4: 5000}
    assert sentence_ops.sentences(df.limit(0), "row_id", "content").count() == 0


def test_encoding_frame(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    counts_ = encoding_ops.model_counts(df.select(F.col("content").alias("text")))
    assert [(r.row_id, r.restored) for r in encoding_ops.restore(df, ["row_id"], "content", counts_).collect()] == [(5, "It’s brokén")]
    empty = encoding_ops.model_counts(df.limit(0).select(F.col("content").alias("text")))
    assert encoding_ops.restore(df.limit(0), ["row_id"], "content", empty).count() == 0


def test_lookalike_frame(spark):
    df = spark.createDataFrame([(1, "th​at", None), (2, None, "ｏｋ"), (3, "plain", ""), (4, "itâ€™s x", None)], "row_id bigint, content string, replyContent string")
    got = {(r.row_id, r.field_name): r.normalised for r in lookalike_ops.normalise(df, "row_id", ["content", "replyContent"], ("content",)).collect()}
    assert got == {(1, "content"): "that", (2, "replyContent"): "ok"}


def test_language_frame(spark, counts):
    df = spark.createDataFrame([(1, EN[0], "en"), (1, EN[0], "en"), (2, None, "en"), (3, EN[0] + ". " + FR[0], None)], "row_id bigint, content string, lang string")
    got = [(r.row_id, r.seg_no, r.lang) for r in language_ops.segments(df.withColumn("label", F.col("lang")), ["row_id"], "content", "lang", counts).collect()]
    assert sorted(got) == [(1, 1, "en"), (1, 1, "en"), (3, 1, "en"), (3, 2, "fr")]


def test_name_counts_need_partners(spark):
    df = spark.createDataFrame([("Nadia Velmoor",), ("Nadia Okrambe",), ("Omar Velmoor",), ("Happy Bird",), ("Happy Bird",), (None,), ("",)], "userName string")
    given, family = personal_ops.name_counts(df, "userName")
    from reviewlode.llm.personal import name_bucket

    assert given[name_bucket("Nadia")] == 2 and family[name_bucket("VELMOOR")] == 2 and given[name_bucket("happy")] == 0


def test_name_statistics_keep_fixed_pairs(spark):
    df = spark.createDataFrame([("Nadia Velmoor",), ("Nadia Okrambe",), ("Ольга Муршанова",), ("Ольга Муршанова",)], "userName string")
    given, family, partners = personal_ops.name_statistics(df, "userName")
    from reviewlode.llm.personal import name_bucket

    assert given[name_bucket("Ольга")] == 2 and family[name_bucket("муршанова")] == 2
    assert partners[name_bucket("Ольга")] == 1 and partners[name_bucket("Nadia")] == 2


def test_lower_case_texts_reach_the_generators(spark, tmp_path):
    rows = [(1, "write to prayer.fan[at]example[.]net", None, "leila.ost (at) example (dot) net"), (2, "mail leila ＠ example.net", "", "nadia velmoor")]
    names = [(10 + i, None, None, f"{a} {b}") for i, (a, b) in enumerate([("Nadia", "Velmoor"), ("Nadia", "Okrambe"), ("Omar", "Velmoor")] * 20)]
    spark.createDataFrame(rows + names, "row_id long, content string, replyContent string, userName string").write.parquet(f"{tmp_path}/reviews.parquet")
    got = {tuple(r) for r in personal_ops.p7_found(spark, str(tmp_path)).where("row_id < 10").collect()}
    assert got == {(1, "content", "email"), (1, "userName", "email"), (2, "content", "email"), (2, "userName", "name")}


def test_token_frame(spark):
    if not os.path.exists(tokens.tokenizer_path()):
        pytest.skip("no vocabulary files here")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id bigint, text string")
    got = sorted((r.doc_id, len(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect())
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    r = random.Random(8)
    voc = [f"w{i}" for i in range(300)]
    its = [(i, " ".join(r.sample(voc, 40))) for i in range(12)]
    items = spark.createDataFrame([*its, (99, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, "noise " * 30 + t + " tail" * 30, 0) for i, t in its] + [(100, None, 0), (101, "", 0)], "doc_id bigint, text string, item_id int")
    want = [(i, i) for i in range(12)]
    assert sorted((x.doc_id, x.item_id) for x in leaks.leaks(docs, items).collect()) == want
    monkeypatch.setattr(leaks, "ITEMS_AT_ONCE", 5)
    assert sorted((x.doc_id, x.item_id) for x in leaks.leaks(docs, items).collect()) == want


def test_instructions_are_found_over_all_blocks(spark, monkeypatch):
    r = random.Random(8)
    say = "Please " + " ".join(f"say{i}" for i in range(23)) + ". "
    items = spark.createDataFrame([(i, (say if i % 4 == 0 else "") + " ".join(r.sample([f"w{j}" for j in range(300)], 40))) for i in range(12)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, say + say)], "doc_id bigint, text string")
    for n in (100, 2):
        monkeypatch.setattr(leaks, "ITEMS_AT_ONCE", n)
        assert leaks.leaks(docs, items).count() == 0


def test_ranks(spark):
    counted = spark.createDataFrame([("en", "the", 3), ("en", "cat", 3), ("en", "epistemological", 1), ("fr", "le", 1)], "lang string, w string, n bigint")
    assert {(r.lang, r.w): r.rank for r in levels.ranks(counted).collect()} == {("en", "the"): 2, ("en", "cat"): 2, ("en", "epistemological"): 3, ("fr", "le"): 1}


def level_tables(spark):
    r = random.Random(2)
    easy, hard = "the cat sat on a mat and ran to me".split(), [f"consideration{chr(97 + i)}tional" for i in range(26)]

    def text(level):
        return " ".join(" ".join(r.choices(easy if level == 1 else hard, k=9)) + "." for _ in range(6))

    docs = spark.createDataFrame([(i, text(1 + i % 2), "en") for i in range(40)] + [(90, None, "en"), (91, " ", "en"), (92, "5 / 7", None)], "doc_id bigint, text string, lang string")
    graded = spark.createDataFrame([(i, "en", 1 + i % 2, text(1 + i % 2)) for i in range(20)], "passage_id bigint, lang string, reading_level int, text string")
    items = spark.createDataFrame([(i, " ".join(r.choices(hard, k=30))) for i in range(6)] + [(9, None)], "item_id bigint, text string")
    return docs, graded, items


def test_levels_are_the_same_with_any_size_of_vocabulary_and_blocks(spark, monkeypatch):
    docs, graded, items = level_tables(spark)
    want = {i: 1 + i % 2 for i in range(40)}
    for most, block in ((1000, 1000), (4, 1000), (0, 2)):
        monkeypatch.setattr(levels, "ITEMS_AT_ONCE", block)
        assert {r.doc_id: r.reading_level for r in levels.grade(docs, graded, items, most).collect()} == want
    assert levels.grade(docs.limit(0), graded, items.limit(0)).count() == 0


def test_measures_with_rare_words_joined_are_the_same(spark):
    docs, _g, _i = level_tables(spark)
    shared = spark.sparkContext.broadcast(("t", L.Ngrams(L.fit([("en", "the cat sat on a mat and ran to me")] * 9)).packed()))
    ranked = levels.ranks(levels.word_counts(docs, "text", shared, ["en"]))
    got = []
    for most in (1000, 5, 0):
        m = levels.measures(docs, ["doc_id"], "text", None, levels.Vocabulary(ranked, most), shared, ["en"], (frozenset(), frozenset()))
        got.append(sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in m.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def test_headings_and_test_passages_do_not_count():
    grams = frozenset([tuple("one two three four five six".split())])
    voc = frozenset(w for g in grams for w in g)
    got = levels.units("A Heading\n\nThe cat sat here. One, two three four five six seven.\n- A bullet works too.", grams, voc)
    assert got == [(1, ["the", "cat", "sat", "here"]), (3, ["a", "bullet", "works", "too"])]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() >= 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_levels_of_the_graded_passages(spark):
    g = spark.read.parquet(f"{DATA}/graded_passages.parquet")
    docs = g.select(F.col("passage_id").alias("doc_id"), "text", "lang")
    got = levels.grade(docs, g, spark.read.parquet(f"{DATA}/eval_items.parquet"))
    got = spark.createDataFrame(got.collect(), "passage_id bigint, found int")
    right = got.join(g, "passage_id").select((F.col("found") == F.col("reading_level")).cast("int").alias("ok")).agg(F.avg("ok"), F.count("ok")).first()
    assert right[0] > 0.9 and right[1] >= 210
