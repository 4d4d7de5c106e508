"""The roles of the analytics pipeline on the test tables: reviews, sentences, aspects, demand, features.

The SQL of the same roles is in ``BASE_SQL``, written independently.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.functions import scalars, text
from reviewlode.operators import absa, delivery, demand, patterns, promise
from reviewlode.operators.patterns import Aspect
from reviewlode.scorers import NEGATIVE, POSITIVE, LexiconScorer

# A small lexicon for the test tables; users bring their own file.
LEXICON = [
    Aspect("ads", ["ads", "too many ads"]),
    Aspect("battery", ["battery"]),
    Aspect("prayer_times", ["prayer times", "monthly timetable"]),
    Aspect("qibla", ["qibla compass"]),
    Aspect("reminders", ["adhan sound", "reminder", "dawn alarm"], promise_keywords=["adhan sound", "reminder", "dawn alarm", "alarm"]),
    Aspect("subscription", ["subscription", "pay for it"]),
    Aspect("tracker", ["prayer tracker", "streak", "fasting log"]),
    Aspect("travel", ["mosque map", "location search", "wrong city"]),
    Aspect("ui", ["letters too small", "design", "night theme"]),
    Aspect("widgets", ["home widget", "watch face"]),
]
if os.environ.get("REVIEWLODE_LEXICON"):  # a YAML file with aspects of one's own
    from reviewlode.sources.readers import read_lexicon

    LEXICON = read_lexicon(os.environ["REVIEWLODE_LEXICON"])
PATTERNS = patterns.compile_lexicon(LEXICON)
PROMISES = patterns.compile_lexicon(LEXICON, promise=True)
STOPWORDS = "the and for are was with this that you your has have had not but all can its our from they too very which when".split()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """One row for each identifier, the first delivered, with cleaned text and flags; the reader's identity is not kept.

    Only identifiers and places are shuffled; texts are filtered by the keep
    vectors while they are read.
    """
    once = delivery.KeepVectors.build(spark, f"{d}/reviews.parquet", "reviewId", "row_id", F.col)
    r = once.keep(["row_id", "reviewId", "app_dir", "content", "score", "at", "repliedAt", "replyContent", "thumbsUpCount", "reviewCreatedVersion"])
    r = once.spread(r.where("reviewId IS NOT NULL"), "row_id").withColumnsRenamed({"app_dir": "app", "reviewCreatedVersion": "version"})
    # as a generator the text is made once; as a column, filters on it would make it again where the rows are read
    r = r.select("*", F.explode(F.array(text.clean("content"))).alias("text")).withColumn("n_words", text.n_words("text"))
    flagged = r.withColumns(
        {
            "has_reply": F.coalesce(F.trim("replyContent") != "", F.lit(False)),
            "days_to_reply": scalars.days_between("at", "repliedAt"),
            "corpus_text": (F.col("n_words") >= 5) & (F.col("text") != ""),
            "label": F.when(F.col("n_words") >= 5, text.star_label("score")),
        }
    )
    return flagged


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return absa.sentences(reviews(spark, d).where("corpus_text"), "reviewId", "text")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return absa.handle_requests(absa.tag_sentences(sentences(spark, d), PATTERNS))


def scores(pairs_: DataFrame) -> DataFrame:
    return absa.once_per_text(pairs_, "sentence", LexiconScorer()).drop("sentiment_model")


def aspects(spark: SparkSession, d: str) -> DataFrame:
    """Aspect rows with sentiment, and request rows without; one scan, and one aggregation over the tagged sentences.

    The scorer is an expression, so there is nothing to gain from scoring each
    distinct sentence once; with a model use ``absa.once_per_text``.
    """
    s = absa.sentences(reviews(spark, d).where("corpus_text"), "reviewId", "text", ("app", "score"))
    p = LexiconScorer()(absa.handle_requests(absa.tag_sentences(s, PATTERNS)))
    return absa.aspect_table(p, "reviewId", ("app", "score"))


def demands(spark: SparkSession, d: str) -> DataFrame:
    return demand.mine(reviews(spark, d).where("corpus_text"), "reviewId", "text", PATTERNS, ("app", "score"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each app and aspect with an annotation for apps that name a price; the sheet itself is not among the tables."""
    m = table(spark, d, "app_metadata")
    cells = promise.matrix(m, "app_dir", "description", PROMISES).withColumnRenamed("app_dir", "app")
    priced = m.select(F.col("app_dir").alias("app"), F.col("free").isNotNull().alias("priced_"))
    note = F.when(F.col("priced_"), ((F.length("app") * 7 + F.length("aspect")) % 3 != 0).cast("double"))
    return promise.combine(cells.join(priced, "app").withColumn("csv_annotated", note).drop("priced_"))


# --------------------------------------------------------------------------- SQL
_BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}\p{So}]"


def _rex(words: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _kw(words: list[str]) -> str:
    return "|".join(w.replace(" ", r"\s+") for w in words)


ASPECT_SQL = ", ".join(f"CASE WHEN regexp_matches(low, '{_q(_rex(_kw(a.keywords)))}') THEN '{a.name}' END" for a in LEXICON)
PROMISE_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(segment), '{_q(_rex(_kw(a.promise_keywords or a.keywords)))}') THEN '{a.name}' END" for a in LEXICON)
# The vocabularies as the SQL states them, apart from those of the operators.
_THING = "add|include|make|provide"
SQL_FAMILIES = {
    "request": r"wish|wishes|wished|hopes?\s+(you|they|to\s+see|for)|hoped\s+(you|they|to\s+see|for)|please\s+(add|include|provide|make|give|implement)|(pls|plz)\s+(add|include|make|give)|kindly\s+(add|include|provide|make)"
    r"|should\s+(have|add|include|support|be\s+able)|would\s+be\s+(nice|better|great|good|helpful|perfect)\s+if|it\s+would\s+be\s+(nice|better|great|good|helpful)"
    rf"|(can|could|would)\s+(you|u)\s+({_THING})|(can|could|would)\s+(you|u)\s+please\s+({_THING})"
    r"|needs?\s+(a|an|to\s+have|more|better)|missing|no\s+option\s+(for|to)|suggest|suggestions?|lack|lacks|lacking|request|requesting|want(ed)?\s+(a|an|to\s+see)|hopefully\s+(you|they|add)",
    "absence": r"does\s?n[o']?t\s+(have|support|include|offer|work\s+with)|do\s+not\s+(have|support|include|offer)|did\s?n[o']?t\s+(have|find|see)|there(\s+is|'s|s)\s+no|has\s+no|with\s?out\s+(a|an|any)|(could|can)\s?n[o']?t\s+find|unable\s+to\s+find|not\s+(available|supported)",
    "churn": r"uninstall|uninstalled|uninstalling|delet(e|ed|ing)\s+(this|the\s+app|it)|switch(ed|ing)?\s+to|mov(ed|ing)\s+to|(going|went)\s+back\s+to|better\s+than\s+(this|the\s+other)|found\s+(a\s+)?better|remov(ed|ing)\s+(this|the\s+app|it)|looking\s+for\s+(another|an\s+alternative)",
    "preference": r"that'?s\s+why\s+i\s+(use|keep|chose|prefer)|only\s+app\s+(that|which|with)|no\s+other\s+app|the\s+(only\s+)?reason\s+i\s+(use|chose|keep|downloaded)|best\s+app\s+(for|because|that)|better\s+than\s+(all\s+)?(other|the\s+rest)|i\s+(use|chose|prefer)\s+this\s+(app\s+)?because|unlike\s+other\s+apps|what\s+(sets|makes)\s+(this|it)\s+apart",
    "tenure": r"using\s+(this|it|the\s+app)\s+(for\s+)?(the\s+(past|last)\s+)?[0-9]+\s*(\+\s*)?(years?|yrs?|months?|mos?)|since\s+20[0-9][0-9]|for\s+(the\s+)?(past|last)\s+[0-9]+\s*(years?|yrs?|months?|mos?)|[0-9]+\s*(\+\s*)?years?\s+(of\s+)?(use|using|now)",
}
SQL_REQUEST = (
    r"wish|wishes|wished|hope|hopes|hoped|(please|pls|plz|kindly)\s+add|should\s+(have|add|include|be)|would\s+be\s+(nice|better|great|good)\s+if|it\s+would\s+be\s+(nice|better|great|good)|can\s+(you|u)\s+(please\s+)?add|could\s+you\s+add|needs?\s+(a|an|to|more)"
    r"|missing|no\s+option|suggest|suggestion|lacks?|lacking|request|requesting|add\s+(a|an|more|the)|want(ed)?\s+(a|an|to\s+see)|looking\s+forward\s+to"
)
SQL_NEGATION = r"(does|do|did|is|are)n'?t|(does|do|did|is|are)\s+not|(ca|could|wo)n'?t|cannot|no|not|never|without|lacks?"
SQL_DEVOTIONAL = r"\b(?:may\s+(?:allah|god)\b|(?:allah|god)\s+(?:bless|reward|grant|guide|accept|protect)|jazak\s*[au]?\s*allah|barak\s*allah)[^.!?,;\n]*|\b(?:(?:masha|subhan|insha)\s*allah|tabarakallah|(?:alhamdulil+|hamdulill)ah|bismillah|assalam\w*|salam\s*alaikum|walaikum\w*|ameen|aameen|jannah|jannat|akhirah|hereafter|highest\s+rank)\b"
FAMILY_SQL = ", ".join(f"CASE WHEN regexp_matches(low, '{_q(_rex(p))}') THEN '{n}' END" for n, p in SQL_FAMILIES.items())
_POS, _NEG = (", ".join(f"'{w}'" for w in ws) for ws in (POSITIVE, NEGATIVE))
_STRIPPED = f"CASE WHEN regexp_matches(coalesce(content, ''), '[\\x{{2501}}-\\x{{10FFFF}}]') THEN regexp_replace(coalesce(content, ''), '{_EMOJI}', '', 'g') ELSE coalesce(content, '') END"

BASE_SQL = rf"""
WITH first_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reviewId ORDER BY row_id) AS rn FROM reviews WHERE reviewId IS NOT NULL) WHERE rn = 1),
cleaned AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({_STRIPPED}, '(?:https?://|www\.)[^\s]+', ' ', 'g'),
    '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}', ' ', 'g'), '{_BLANK}+', ' ', 'g')) AS text FROM first_rows),
r AS (SELECT row_id, reviewId, app_dir AS app, content, score, "at" AS ts, repliedAt, replyContent, thumbsUpCount, reviewCreatedVersion AS version, text, n_words,
    coalesce(trim(replyContent) <> '', FALSE) AS has_reply,
    CASE WHEN repliedAt >= "at" THEN epoch_us(repliedAt - "at") / 86400000000.0 END AS days_to_reply,
    n_words >= 5 AND text <> '' AS corpus_text,
    CASE WHEN n_words >= 5 THEN CASE WHEN score <= 2 THEN 'Negative' WHEN score = 3 THEN 'Neutral' WHEN score >= 4 THEN 'Positive' END END AS label
  FROM (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\s+')) END AS n_words FROM cleaned)),
s AS (SELECT reviewId, CAST(i - 1 AS INT) AS sentence_index, parts[i] AS sentence FROM (
    SELECT reviewId, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT reviewId, list_filter(list_transform(string_split(regexp_replace(text, '([.!?।؟])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM r WHERE corpus_text))),
tagged AS (SELECT reviewId, sentence_index, sentence, low, unnest(list_filter([{ASPECT_SQL}], lambda x: x IS NOT NULL)) AS aspect FROM (SELECT *, lower(sentence) AS low FROM s)),
pairs AS (SELECT reviewId, sentence_index, sentence, aspect, 'lexicon' AS match_method,
    regexp_matches(low, '{_q(_rex(SQL_REQUEST))}') AS is_request, regexp_matches(low, '{_q(_rex(SQL_NEGATION))}') AS has_negation
  FROM tagged WHERE length(regexp_replace(low, '[^\p{{L}}]', '', 'g')) > 0
   AND length(regexp_replace(regexp_replace(low, '{SQL_DEVOTIONAL}', '', 'g'), '[^\p{{L}}]', '', 'g')) >= 0.5 * length(regexp_replace(low, '[^\p{{L}}]', '', 'g'))),
counted AS (SELECT sentence, len(list_filter(w, lambda x: x IN ({_POS})))::DOUBLE AS pos, len(list_filter(w, lambda x: x IN ({_NEG})))::DOUBLE AS neg
  FROM (SELECT DISTINCT sentence, string_split_regex(lower(sentence), '[^a-z]+') AS w FROM pairs)),
scores AS (SELECT sentence, neg / (pos + neg + 1) AS p_neg, 1 / (pos + neg + 1) AS p_neu, pos / (pos + neg + 1) AS p_pos FROM counted),
weighted AS (SELECT p.*, p_neg, p_neu, p_pos, greatest(1 - p_neu, 0.05) AS w FROM pairs p LEFT JOIN scores USING (sentence) WHERE NOT is_request),
scored AS (SELECT reviewId, aspect, sum(p_neg * w) / sum(w) AS prob_neg, sum(p_neu * w) / sum(w) AS prob_neu, sum(p_pos * w) / sum(w) AS prob_pos, count(*) AS n_sentences,
    array_to_string(list(sentence ORDER BY sentence_index)[1:3], ' || ') AS triggering_sentence, min(match_method) AS match_method, bool_or(has_negation) AS has_negation
  FROM weighted GROUP BY reviewId, aspect),
a AS (SELECT z.*, r.app, r.score FROM (
    SELECT reviewId, aspect, prob_neg, prob_neu, prob_pos, n_sentences, triggering_sentence, match_method, has_negation,
      CASE WHEN prob_neg >= prob_neu AND prob_neg >= prob_pos THEN 'Negative' WHEN prob_neu >= prob_pos THEN 'Neutral' ELSE 'Positive' END AS sentiment_label, FALSE AS is_request FROM scored
    UNION ALL SELECT reviewId, aspect, NULL, NULL, NULL, count(*), array_to_string(list(sentence ORDER BY sentence_index)[1:3], ' || '), min(match_method), bool_or(has_negation), NULL, TRUE
      FROM pairs WHERE is_request GROUP BY reviewId, aspect) z LEFT JOIN r USING (reviewId)),
clauses AS (SELECT reviewId, clause, lower(clause) AS low FROM (
    SELECT reviewId, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?।؟])\s+', '\1' || chr(31), 'g'), ',\s+(but|and|however|though)($|[^\p{{L}}\p{{N}}_])', chr(31) || '\1\2', 'g'), chr(31))) AS c0 FROM r WHERE corpus_text) x,
    LATERAL (SELECT trim(c0) AS clause) y WHERE clause <> '' AND len(regexp_split_to_array(clause, '\s+')) >= 3),
fam AS (SELECT reviewId, clause, low, unnest(list_filter([{FAMILY_SQL}], lambda x: x IS NOT NULL)) AS request_type FROM clauses),
demand AS (SELECT DISTINCT reviewId, clause AS evidence_sentence, request_type, aspect FROM (
    SELECT reviewId, clause, request_type, unnest(CASE WHEN len(hits) > 0 THEN hits ELSE [NULL] END) AS aspect FROM (
      SELECT *, list_filter([{ASPECT_SQL}], lambda x: x IS NOT NULL) AS hits FROM fam))),
d AS (SELECT demand.*, r.app, r.score FROM demand JOIN r USING (reviewId)),
segs AS (SELECT app_dir AS app, i AS pos, parts[i] AS segment FROM (SELECT app_dir, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT app_dir, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(description, ''), '([.!?।؟])\s+', '\1' || chr(10), 'g'), '\n+|\s*[•●▪✓✔►]\s*'),
      lambda x: trim(regexp_replace(x, '^[\s\-*•●▪✓✔►:]+|[\s\-*•●▪✓✔►:]+$', '', 'g'))), lambda x: len(regexp_split_to_array(x, '\s+')) >= 3) AS parts FROM app_metadata))),
claims AS (SELECT app, aspect, min_by(segment, pos) AS e, count(*) AS n FROM (SELECT app, pos, segment, unnest(list_filter([{PROMISE_SQL}], lambda x: x IS NOT NULL)) AS aspect FROM segs) GROUP BY app, aspect),
cells AS (SELECT m.app_dir AS app, u.aspect, e IS NOT NULL AS description_claimed, substring(e, 1, 300) AS description_evidence, coalesce(n, 0) AS n_segments,
    CASE WHEN m.free IS NOT NULL THEN CASE WHEN (length(m.app_dir) * 7 + length(u.aspect)) % 3 <> 0 THEN 1.0 ELSE 0.0 END END AS csv_annotated
  FROM app_metadata m, (SELECT unnest([{", ".join(repr(a.name) for a in LEXICON)}]) AS aspect) u LEFT JOIN claims c ON c.app = m.app_dir AND c.aspect = u.aspect),
f AS (SELECT *, coalesce(csv_annotated, CASE WHEN description_claimed THEN 1.0 ELSE 0.0 END) AS feature_present, CASE WHEN csv_annotated IS NOT NULL THEN 'csv' ELSE 'description' END AS promise_source,
    CASE WHEN csv_annotated IS NOT NULL THEN (csv_annotated >= 1) = description_claimed END AS source_agreement FROM cells)
"""
