"""Reading level of each document (problem 10).

Words are ranked by their frequency over all documents of a language.  The
coverage rank is the smallest rank r so that the r most frequent words cover
``SHARE`` of the tokens.  The level asked for is that of most sentences, so it is
taken of every sentence, not of the document.
Coverage rank and the complexity of the sentence (length of its words, share of
long words, mean logarithm of the ranks) are calibrated in SQL on the graded
passages: for each language and level the median and the spread of every
measure.  A sentence has the level it fits best, a document the level of most of
its sentences.

The documents are read twice and never written: once for their languages and
word counts, which are combined where the documents are, and once for the
measures.  Words beyond the vocabulary that is sent to the documents are looked
up by a join; these are rare by nature, so that no key is hot.

Null, blank and letterless texts and texts in other languages have no level;
headings and passages of the test items do not count.  Texts are read whole; a
text without end marks is judged in runs of words.  Words that no document has
rank after all others.  Passages without a level, language or text calibrate
nothing.  A repeated document has one row by its id; ties go to the
level that its sentences fit better.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.llm import languages as L
from reviewlode.llm.common import map_rows, table
from reviewlode.llm.language_ops import labelled_sample
from reviewlode.llm.leaks import RUN, marked_items, plain_words
from reviewlode.llm.sentences import split

#: Share of a sentence's tokens that the vocabulary has to cover.
SHARE = 0.8
#: Words of a run where a text has no end marks.
RUN_WORDS = 14
#: Most words of the vocabulary that is sent to the documents, the most frequent ones; others are joined.
BROADCAST_WORDS = 500_000
#: Test items whose runs are sent to the documents at once; more are taken in blocks of this size.
ITEMS_AT_ONCE = 20_000
#: Letters of a long word.
LONG = 7
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000

_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*")
_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,200}>")
_BULLET = regex.compile(r"^[\s\-*•#>\d.)]+")
_END = regex.compile(r"[.!?…:;。！？।॥؟۔]['\"”’»)\]]*\s*$")


def units(text: str, grams: frozenset = frozenset(), voc: frozenset = frozenset(), lang: str | None = None) -> list[tuple[int, list[str]]]:
    """(number, words) of every sentence that counts; ``voc`` has the words of ``grams``.

    Sentences that hold a run of ``grams`` do not count; their numbers stay free.
    """
    if "<" in text:
        text = _TAG.sub(" ", text)
    out = []
    lines = "\n" in text
    no = 0
    for a, b in split(text, (lambda _: lang) if lang else None):
        s = text[a - 1 : b]
        words = _WORD.findall((_BULLET.sub("", s) if not s[0].isalpha() else s).lower())
        if not words:
            continue
        if lines and len(words) <= 8 and not _END.search(s) and (b >= len(text) or text[b : b + 1] in "\r\n"):
            continue  # a heading
        no += 1
        if grams and (not s.isascii() or "-" in s or len([w for w in words if w in voc]) >= RUN - 2):
            p = plain_words(s)
            if any(tuple(p[i : i + RUN]) in grams for i in range(len(p) - RUN + 1)):
                continue  # of a test item
        if len(words) > 3 * RUN_WORDS and not _END.search(s):
            starts = list(range(0, len(words) - RUN_WORDS // 2, RUN_WORDS))
            out += [(no, words[i:j]) for i, j in zip(starts, [*starts[1:], len(words)])]  # a short rest goes with the last run
        else:
            out.append((no, words))
    return out


def language(counted: Counter, model: L.Ngrams) -> str | None:
    """The likeliest language of a document's words, each as often as it occurs."""
    if not counted:
        return None
    return L.LANGS[int((np.array(list(counted.values())) @ model.words(list(counted))).argmax())]


def word_counts(docs: DataFrame, text: str, shared, langs: list[str]) -> DataFrame:
    """lang, w, n of all documents in one of ``langs``; counted where the documents are, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, packed = shared.value
        model = L.worker_model(token, packed)
        counts = {lang: Counter() for lang in langs}

        def hand_on():
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            for c in counts.values():
                c.clear()
            for i in range(0, len(rows), 10_000):
                part = rows[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.int64())], names=["lang", "w", "n"])

        for batch in batches:
            for t in batch.columns[0].to_pylist():
                c = Counter(_WORD.findall((_TAG.sub(" ", t) if "<" in t else t).lower()))
                lang = language(c, model)
                if lang in counts:
                    counts[lang].update(c)
            if sum(map(len, counts.values())) > COUNTED:
                yield from hand_on()
        yield from hand_on()

    some = docs.where(F.col(text).rlike(r"\p{L}")).select(text)
    return some.mapInArrow(run, "lang string, w string, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("n"))


def ranks(counted: DataFrame) -> DataFrame:
    """lang, w, rank of every word: the number of words of the language that are at least as frequent.

    The running sum goes over the distinct counts of a language, which are few
    whatever the corpus, not over its words.
    """
    counted.createOrReplaceTempView("p10_words")
    return counted.sparkSession.sql("""
        WITH by_count AS (SELECT lang, n, count(*) AS words FROM p10_words GROUP BY lang, n),
             running AS (SELECT lang, n, sum(words) OVER (PARTITION BY lang ORDER BY n DESC) AS rank FROM by_count)
        SELECT p.lang, p.w, r.rank FROM p10_words p JOIN running r ON p.lang = r.lang AND p.n = r.n""")


class Vocabulary:
    """The ranked words of each language: the most frequent ones to send, and all of them to join."""

    def __init__(self, ranked: DataFrame, most: int = BROADCAST_WORDS):
        self.ranked = ranked
        sizes = {r.lang: r.n for r in ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
        #: The rank of a word that no document has.
        self.last = {lang: n + 1 for lang, n in sizes.items()}
        self.whole = sum(sizes.values()) <= most
        rows = (ranked if self.whole else ranked.orderBy("rank", "lang", "w").limit(most)).collect()  # at most ``most``
        self.table: dict[str, dict[str, int]] = {}
        for r in rows:
            self.table.setdefault(r.lang, {})[r.w] = r.rank


def _measured(k: int, rank: list[int]) -> tuple[float, float]:
    """Logarithm of the coverage rank, and mean logarithm of the ranks."""
    rank.sort()
    return math.log(rank[math.ceil(SHARE * k - 1e-9) - 1]), sum(map(math.log, rank)) / k


def measures(rows: DataFrame, keys: list[str], text: str, lang: str | None, voc: Vocabulary, shared, langs: list[str], grams: tuple[frozenset, frozenset]) -> DataFrame:
    """keys, lang, sent_no and the measures m1..m4 of every sentence that counts."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, voc.table, voc.last, voc.whole, grams))

    def make():
        token, packed = shared.value
        model = L.worker_model(token, packed)
        _, known, last, whole, (g, words_of) = sent.value

        def one(*values):
            *ids, t, of = values
            if of is None:
                of = language(Counter(_WORD.findall((_TAG.sub(" ", t) if "<" in t else t).lower())), model)
                if of not in langs:
                    return ()
            table_, end = known.get(of, {}), last.get(of, 1)
            out = []
            for no, words in units(t, g, words_of, of):
                k = len(words)
                sizes = [*map(len, words)]
                m2, m3 = sum(sizes) / k, sum([x >= LONG for x in sizes]) / k
                if whole:
                    m1, m4 = _measured(k, [table_.get(w, end) for w in words])
                    out.append((*ids, of, no, m1, m2, m3, m4))
                else:
                    rank = [table_[w] for w in words if w in table_]
                    if len(rank) == k:
                        m1, m4 = _measured(k, rank)
                        out.append((*ids, of, no, m1, m2, m3, m4, None, None))
                    else:
                        out.append((*ids, of, no, None, m2, m3, None, rank, [w for w in words if w not in table_]))
            return out

        return one

    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", lang string, sent_no int, m1 double, m2 double, m3 double, m4 double" + ("" if voc.whole else ", known_ array<bigint>, rare_ array<string>")
    of = F.col(lang) if lang else F.lit(None).cast("string")
    got = map_rows(rows.where(F.col(text).rlike(r"\p{L}")).select(*keys, text, of.alias("of_")), schema, make)
    plain = [*keys, "lang", "sent_no", "m1", "m2", "m3", "m4"]
    if voc.whole:
        return got.select(*plain)
    last = F.create_map(*[F.lit(x) for kv in voc.last.items() for x in kv])
    rare = got.where("rare_ IS NOT NULL").withColumn("id_", F.monotonically_increasing_id())
    ranked = rare.select(*keys, "lang", "sent_no", "m2", "m3", "known_", "id_", F.explode("rare_").alias("w")).join(voc.ranked, ["lang", "w"], "left")
    one = ranked.groupBy("id_").agg(*[F.first(c).alias(c) for c in (*keys, "lang", "sent_no", "m2", "m3", "known_")], F.collect_list(F.coalesce("rank", last[F.col("lang")], F.lit(1))).alias("more_"))
    all_ = F.array_sort(F.concat("known_", "more_"))
    at = F.ceil(F.lit(SHARE) * F.size(all_) - F.lit(1e-9)).cast("int")
    done = one.withColumns({"m1": F.log(F.element_at(all_, at).cast("double")), "m4": F.aggregate(all_, F.lit(0.0), lambda x, y: x + F.log(y.cast("double"))) / F.size(all_)})
    return got.where("rare_ IS NULL").select(*plain).unionByName(done.select(*plain))


#: Median and spread of each measure by language and level; the spread is the median distance, with a floor.
CALIBRATE = """
    WITH m AS (SELECT lang, reading_level, stack(4, 'm1', m1, 'm2', m2, 'm3', m3, 'm4', m4) AS (name, x) FROM p10_graded),
         med AS (SELECT lang, reading_level, name, percentile(x, 0.5) AS mid FROM m GROUP BY lang, reading_level, name)
    SELECT m.lang, m.reading_level, m.name, any_value(med.mid) AS mid,
           greatest(percentile(abs(m.x - med.mid), 0.5), CASE m.name WHEN 'm3' THEN 0.05 ELSE 0.25 END) AS spread
    FROM m JOIN med ON m.lang = med.lang AND m.reading_level = med.reading_level AND m.name = med.name
    GROUP BY m.lang, m.reading_level, m.name"""

#: Fit of every sentence with every level where the sentences are, then the level of most sentences of each document.
#: The levels are sent to the sentences: a row for each language, of which there are few.
GRADE = """
    WITH wide AS (SELECT lang, reading_level, sum(ln(spread)) AS c,
                      max(CASE name WHEN 'm1' THEN mid END) AS a1, max(CASE name WHEN 'm1' THEN spread END) AS s1, max(CASE name WHEN 'm2' THEN mid END) AS a2, max(CASE name WHEN 'm2' THEN spread END) AS s2,
                      max(CASE name WHEN 'm3' THEN mid END) AS a3, max(CASE name WHEN 'm3' THEN spread END) AS s3, max(CASE name WHEN 'm4' THEN mid END) AS a4, max(CASE name WHEN 'm4' THEN spread END) AS s4
                  FROM p10_calibrated GROUP BY lang, reading_level),
         levels AS (SELECT lang, collect_list(struct(*)) AS levels FROM wide GROUP BY lang),
         best AS (SELECT /*+ BROADCAST(l) */ doc_id, array_max(transform(l.levels, v -> struct(
                      - least(abs(m1 - v.a1) / v.s1, 8.0) - least(abs(m2 - v.a2) / v.s2, 8.0) - least(abs(m3 - v.a3) / v.s3, 8.0) - least(abs(m4 - v.a4) / v.s4, 8.0) - v.c AS score,
                      v.reading_level AS level))) AS top
                  FROM p10_measured m JOIN levels l ON m.lang = l.lang),
         votes AS (SELECT doc_id, top.level AS level, count(*) AS n, sum(top.score) AS total FROM best GROUP BY doc_id, top.level)
    SELECT doc_id, max_by(level, struct(n, total)) AS reading_level FROM votes GROUP BY doc_id"""


def item_runs(items: DataFrame) -> Iterator[tuple[frozenset, frozenset]]:
    """The runs of ``RUN`` words of all test items and their words, in blocks of ``ITEMS_AT_ONCE``; instructions are left out."""
    n = items.count()
    blocks = max(1, -(-n // ITEMS_AT_ONCE))
    marked = marked_items(items)
    for b in range(blocks):
        part = marked if blocks == 1 else marked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        grams = set()
        for r in part.toLocalIterator():
            ws = plain_words(r.text.partition(". ")[2] if r.shared else r.text)
            grams.update(tuple(ws[i : i + RUN]) for i in range(len(ws) - RUN + 1))
        yield frozenset(grams), frozenset(w for g in grams for w in g)


def _masked(docs: DataFrame, shared, langs: list[str], grams: tuple[frozenset, frozenset]) -> DataFrame:
    """doc_id, sent_no of the sentences that hold a run of one further block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def make():
        token, packed = shared.value
        model = L.worker_model(token, packed)
        g, words_of = sent.value

        def one(k, t):
            of = language(Counter(_WORD.findall((_TAG.sub(" ", t) if "<" in t else t).lower())), model)
            if of not in langs:
                return ()
            left = {no for no, _ in units(t, g, words_of, of)}
            return [(k, no) for no, _ in dict.fromkeys((no, None) for no, _ in units(t, lang=of)) if no not in left]

        return one

    return map_rows(docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, sent_no int", make)


def grade(docs: DataFrame, graded: DataFrame, items: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, reading_level of every document in a language of the graded passages."""
    spark = docs.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    langs = sorted({r.lang for r in graded.select("lang").distinct().collect() if r.lang in L.LANGS})
    sample = labelled_sample(docs, "doc_id", "text", "lang", L.SAMPLE_DOCUMENTS) + labelled_sample(graded, "passage_id", "text", "lang", L.SAMPLE_DOCUMENTS)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, L.Ngrams(L.fit(sample)).packed()))
    docs = docs.select("doc_id", "text")
    ranked = ranks(word_counts(docs, "text", shared, langs))
    if spark.sparkContext.getCheckpointDir():
        ranked = ranked.checkpoint()  # words and ranks alone, no texts
    voc = Vocabulary(ranked, most)
    none = (frozenset(), frozenset())
    known = graded.select("passage_id", "reading_level", "text", "lang").where(F.col("lang").isin(langs) & F.col("reading_level").isNotNull())
    measures(known, ["passage_id", "reading_level"], "text", "lang", voc, shared, langs, none).createOrReplaceTempView("p10_graded")
    table_ = spark.sql(CALIBRATE)
    # four rows for each language and level
    spark.createDataFrame(table_.collect(), table_.schema).createOrReplaceTempView("p10_calibrated")
    first, *more = item_runs(items)
    measured = measures(docs, ["doc_id"], "text", None, voc, shared, langs, first)
    for grams in more:
        measured = measured.join(_masked(docs, shared, langs, grams), ["doc_id", "sent_no"], "left_anti")
    measured.createOrReplaceTempView("p10_measured")
    return spark.sql(GRADE)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return grade(table(spark, d, "documents"), table(spark, d, "graded_passages"), table(spark, d, "eval_items")).select("doc_id", F.col("reading_level").cast("int").alias("reading_level"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and level."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return p10_found(spark, d).join(docs, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_documents"))
