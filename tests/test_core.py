"""Text, relational, pattern and delivery operators on literal frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from reviewlode.functions import scalars, text
from reviewlode.operators import absa, demand, patterns, relational, temporal
from reviewlode.operators.delivery import KeepVectors, message_id
from reviewlode.operators.patterns import Aspect
from reviewlode.scorers import LexiconScorer, canonical_order, with_backoff
from reviewlode.sources import readers


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("o")).first().o


@pytest.mark.parametrize(
    "t, want",
    [("nice 👍", "nice"), ("© alone", "© alone"), ("© 👍", ""), ("see https://a.b/c now", "see now"), ("mail a@b.co ok", "mail ok"), ("", ""), (None, ""), (" a  b ", "a b")],
)
def test_clean(spark, t, want):
    assert one(spark, t, text.clean("t")) == want


def test_words_and_sentences(spark):
    assert one(spark, "", text.n_words("t")) == 0
    assert one(spark, "a b  c", text.n_words("t")) == 3
    assert one(spark, "No. 1 is ok! Why? Yes", text.sentence_array("t")) == ["No.", "1 is ok!", "Why?", "Yes"]
    assert one(spark, None, text.sentence_array("t")) == []
    assert one(spark, "it is good, but the ads are bad", text.clause_array("t")) == ["it is good", "but the ads are bad"]
    assert one(spark, "• one two three\n- x", text.segment_array("t")) == ["one two three"]
    long = "word " * 50_000
    assert one(spark, long, F.size(text.sentence_array("t"))) == 1


def test_scripts_and_names(spark):
    assert [one(spark, t, text.script_guess("t")) for t in ("ভালো", "جيد", "ok", "12", None)] == ["bn", "ar", "en", "unk", "unk"]
    assert one(spark, "Crescent – Daily", text.brand_lead("t")) == "crescent"
    assert one(spark, "A b/c: d", text.safe_dirname("t")) == "A_bc_d"
    assert one(spark, 5_000_000, text.install_tier("t"), "bigint") == "1M+"
    assert one(spark, "x", text.looks_translated(F.lit("س"), "t")) is True


def test_scalars(spark):
    assert one(spark, "Mar 19, 2024", scalars.lenient_timestamp("t")) == dt.datetime(2024, 3, 19)
    assert one(spark, "nonsense", scalars.lenient_timestamp("t")) is None
    a, b = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    assert one(spark, "", scalars.days_between(b, a)) == 0.5
    assert one(spark, "", scalars.days_between(a, b)) is None
    lab = scalars.argmax_label(F.lit(0.4), F.lit(0.2), F.lit(0.4))
    assert one(spark, "", lab) == "Negative"


def test_keep_first_takes_hot_keys_ties_and_nulls(spark):
    rows = [("k", i, f"v{i}") for i in range(300)] + [("a", 1, "x"), (None, 0, "n")]
    got = relational.keep_first(spark.createDataFrame(rows, "key string, o int, extra string"), ["key"], ["o"]).collect()
    assert {(r.key, r.extra) for r in got} == {("k", "v0"), ("a", "x")}
    empty = spark.createDataFrame([], "key string, o int")
    assert relational.keep_first(empty, ["key"], ["o"]).count() == 0


def test_one_to_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(relational.NotUnique):
        relational.one_to_one(a, a, ["k"])


def test_samplers_cover_and_do_not_repeat(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    got = [r.id for r in relational.stratified(df, "g", "id", 70).collect()]
    assert len(got) == len(set(got)) == 70
    per = {r.g: r["count"] for r in relational.round_robin(df, "g", "id", 14).groupBy("g").count().collect()}
    assert per == dict.fromkeys(range(7), 2)
    parts = {r.part: r["count"] for r in relational.overlap_split(df.limit(300), "id", 100).groupBy("part").count().collect()}
    assert parts == {"shared": 100, "first": 100, "second": 100}


def test_label_merge_fills_only_blanks(spark):
    s = spark.createDataFrame([(1, ""), (2, "kept"), (3, None)], "k int, label string")
    b = spark.createDataFrame([(1, "old"), (2, "other"), (1, "old2")], "k int, label string")
    assert {r.k: r.label for r in relational.label_merge(s, b, ["k"], ["label"]).collect()} == {1: "old", 2: "kept", 3: None}


def test_resolver_never_guesses(spark):
    known = spark.createDataFrame([("p1", "sunprayer", "sun"), ("p2", "sunprayerpro", "sun"), ("p3", "moonlight", "moon")], "package string, key string, lead string")
    names = spark.createDataFrame([("given", "zzz", "zzz", "p2"), ("exact", "moonlight", "q", None), ("sub", "mymoonlightapp", "q", None), ("two", "sunprayerprox", "sun", None), ("none", "qqqqq", "", None)], "name string, key string, lead string, package string")
    assert {r.name: r.resolved for r in relational.resolve_names(names, known).collect()} == {"given": "p2", "exact": "p3", "sub": "p3", "two": None, "none": None}


LEX = patterns.compile_lexicon([Aspect("ads", ["ad", "ads"]), Aspect("compass", ["qibla compass"]), Aspect("stem", ["motivat"]), Aspect("raw", [], ["heavy|slow"]), Aspect("nothing")])


@pytest.mark.parametrize("t, want", [("adhan is fine", []), ("Ads cover the  qibla   compass", ["ads", "compass"]), ("motivated", []), ("slowly", ["raw"]), (None, []), ("", [])])
def test_tagging(spark, t, want):
    assert (one(spark, t, patterns.tags(F.lower("t"), LEX)) or []) == want


def test_promise_variant_falls_back():
    a = Aspect("x", ["review word"], [], ["promise word"])
    assert "promise" in patterns.compile_aspect(a, True) and "review" in patterns.compile_aspect(a)
    assert patterns.compile_aspect(Aspect("y", ["only"]), True) == patterns.compile_aspect(Aspect("y", ["only"]))


def test_absa_chain(spark):
    r = spark.createDataFrame([("1", "I wish it had a qibla compass. The ads are bad! Ads again. Ads more. Ads last."), ("2", "Masha Allah, but the ads are broken"), ("3", "Masha Allah ad"), ("4", None)], "reviewId string, text string")
    p = absa.handle_requests(absa.tag_sentences(absa.sentences(r, "reviewId", "text"), LEX))
    scores = absa.once_per_text(p, "sentence", LexiconScorer()).drop("sentiment_model")
    rows = {(x.reviewId, x.aspect): x for x in absa.aspect_rows(p, scores, "reviewId").collect()}
    assert rows["1", "ads"].n_sentences == 4 and rows["1", "ads"].triggering_sentence == "The ads are bad! || Ads again. || Ads more."
    assert ("2", "ads") in rows and ("3", "ads") not in rows
    req = absa.request_rows(p, "reviewId").collect()
    assert [(x.reviewId, x.aspect, x.sentiment_label) for x in req] == [("1", "compass", None)]


def test_demand_keeps_null_aspects(spark):
    r = spark.createDataFrame([("1", "Could you add a thing please, but I uninstalled it"), ("2", "add it")], "reviewId string, text string")
    got = {(x.request_type, x.aspect) for x in demand.mine(r, "reviewId", "text", LEX).collect()}
    assert got == {("request", None), ("churn", None)}


def test_monthly_rolls_rows_not_calendar(spark):
    rows = [("a", dt.datetime(2024, m, 1), 5, "Negative" if m == 1 else None, False, 6) for m in (1, 2, 5) for _ in range(2)]
    df = spark.createDataFrame(rows, "app string, at timestamp_ntz, score int, label string, has_reply boolean, n_words int")
    got = temporal.monthly(df).orderBy("month").collect()
    assert [x.mean_score_roll3 for x in got] == [None, 5.0, 5.0] and got[1].pct_negative == 0.0 and got[0].pct_negative == 1.0 and got[1].mean_sentiment is None


def test_event_month_counts_as_before(spark):
    df = spark.createDataFrame([("1", dt.datetime(2020, 11, 20), 1, None), ("2", dt.datetime(2020, 12, 1), 1, None)], "reviewId string, at timestamp_ntz, score int, label string")
    got = temporal.interrupted(df, df.limit(1), "reviewId", 2020, 11).orderBy("month").collect()
    assert [(x.period, x.months_from_event) for x in got] == [("pre", 0), ("post", 1)]


U = "0a1b2c3d-0000-4000-8000-00000000000{}"


def test_delivery_once(spark, tmp_path):
    ids = [U.format(1), U.format(1).upper(), "{" + U.format(1) + "}", U.format(1).replace("-", ""), " urn:uuid:" + U.format(1) + "\n", U.format(2), None, " ", "", "not-a-uuid", "NOT-A-UUID", U.format(2)]
    rows = [(i, x, "w" * 10, None) for i, x in enumerate(ids)] + [(100 + i, U.format(3), "hot", i) for i in range(500)]
    path = str(tmp_path / "m.parquet")
    spark.createDataFrame(rows, "row_id bigint, reviewId string, payload string, keep_ int").repartition(5).write.parquet(path)
    k = KeepVectors.build(spark, path, "reviewId", "row_id")
    again = {r.row_id for r in k.repeated(["row_id"]).collect()}
    assert again == {1, 2, 3, 4, 10, 11, *range(101, 600)}
    kept = k.keep(["row_id", "payload"]).collect()
    assert {r.row_id for r in kept} == {0, 5, 6, 7, 8, 9, 100} and all(r.payload for r in kept)


def test_delivery_in_groups_of_files(spark, tmp_path, monkeypatch):
    from reviewlode.operators import delivery

    path = str(tmp_path / "m.parquet")
    spark.range(0, 2000).select(F.col("id").alias("row_id"), F.concat(F.lit("m"), (F.col("id") % 700).cast("string")).alias("reviewId")).repartition(6).write.parquet(path)
    monkeypatch.setattr(delivery, "BROADCAST_BYTES", 8192)
    got = sorted(r.row_id for r in KeepVectors.build(spark, path, "reviewId", "row_id").repeated(["row_id"]).collect())
    assert got == list(range(700, 2000))


def test_delivery_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "m.parquet")
    spark.createDataFrame([], "row_id bigint, reviewId string").write.parquet(path)
    k = KeepVectors.build(spark, path, "reviewId", "row_id")
    assert k.repeated(["row_id"]).count() == 0 and k.keep(["row_id"]).count() == 0


def test_message_id_null_for_blank(spark):
    assert one(spark, "  ", message_id("t")) is None and one(spark, None, message_id("t")) is None


def test_scorer_helpers():
    assert canonical_order(["positive", "NEGATIVE", "neutral"]) == [1, 2, 0]
    with pytest.raises(ValueError):
        canonical_order(["good", "bad", "ugly"])
    calls = []

    def run(texts):
        calls.append(len(texts))
        if len(texts) > 16:
            raise MemoryError
        return [t.upper() for t in texts]

    items = [str(i) * (i % 5) for i in range(100)]
    assert with_backoff(run, items, 64) == [t.upper() for t in items] and max(c for c in calls if c <= 16) == 16
    with pytest.raises(ValueError):
        with_backoff(lambda x: x[:-1], items)


def test_review_files(spark, tmp_path):
    head = "reviewId,userName,userImage,content,score,thumbsUpCount,reviewCreatedVersion,at,replyContent,repliedAt,appVersion\n"
    for app, body in (("B_app", 'r1,u,i,"second",5,1,,2024-01-02 00:00:00,,,\n'), ("A_app", 'r1,u,i,"two\nlines ""q""",x,1,,bad date,thanks,2024-01-01 00:00:00,\nr2,u,i,,3,0,,2024-01-02 00:00:00,no,2024-01-01 00:00:00,\n')):
        (tmp_path / app).mkdir()
        (tmp_path / app / "reviews.csv").write_text("﻿" + head + body, encoding="utf-8")
    got = {r.reviewId: r for r in readers.typed_reviews(readers.read_reviews(spark, f"{tmp_path}/*/reviews.csv")).collect()}
    assert got["r1"].app_dir == "A_app" and got["r1"].content == 'two\nlines "q"' and got["r1"].score is None and got["r1"].at is None
    assert got["r2"].days_to_reply is None and "userName" not in got["r2"].asDict()


def test_metadata_and_sheets(spark, tmp_path):
    (tmp_path / "App_1").mkdir()
    (tmp_path / "App_1" / "metadata.json").write_text(json.dumps({"appId": "a.b", "released": "Mar 19, 2024", "histogram": [1, 2]}))
    m = readers.read_metadata(spark, f"{tmp_path}/*/metadata.json").first()
    assert (m.app_name, m.free, m.adSupported, m.released_dt) == ("App_1", True, False, dt.datetime(2024, 3, 19))
    sheet = tmp_path / "sheet.csv"
    sheet.write_text(",,\n,,\n,,\nApp Name,F1,F2\nOne,✓,\nTwo,x,Google Maps\nThree,,\n,✓,✓\n")
    got = {r.app_name: (r.F1, r.F2) for r in readers.read_feature_sheet(spark, str(sheet), ["F1", "F2"]).collect()}
    assert got == {"One": (1.0, 0.0), "Two": (0.0, 1.0), "Three": (None, None)}
    sheet.write_text(",,\n,,\n,,\nApp Name,Rating,Rating Count,Downloads,package name,Link,F1\nOne,3.9`,12,1M+,,https://s.example/d?hl=en&id=a.b&gl=us,✓\nTwo,4.5,,,c.d,,\n")
    got = {r.app_name: r for r in readers.read_feature_sheet(spark, str(sheet), ["F1"]).collect()}
    assert (got["One"].package, got["One"].rating, got["One"].downloads, got["One"].is_annotated) == ("a.b", None, "1M+", True)
    assert (got["Two"].package, got["Two"].rating, got["Two"].is_annotated, got["Two"].F1) == ("c.d", 4.5, False, None)
    lex = tmp_path / "lex.yaml"
    lex.write_text("ads:\n  keywords: [ads]\n  csv_column: null\nempty: {}\n")
    assert [a.name for a in readers.read_lexicon(str(lex))] == ["ads", "empty"]


def test_cache_scores_new_texts_only(spark, tmp_path):
    seen = []

    def score(df):
        seen.append(df.count())
        return df.withColumn("v", F.length("t").cast("double"))

    c = readers.ScoreCache(spark, str(tmp_path / "cache"), {"model": "m"})
    a = spark.createDataFrame([("x",), ("yy",), ("x",), (None,)], "t string")
    assert {r.t: r.v for r in c.scored(a, "t", "v double", score).collect()} == {"x": 1.0, "yy": 2.0}
    assert {r.t: r.v for r in c.scored(a.union(spark.createDataFrame([("zzz",)], "t string")), "t", "v double", score).collect()} == {"x": 1.0, "yy": 2.0, "zzz": 3.0}
    assert seen == [2, 1]
    c.keep_only(a.where("t = 'x'"), "t", "v double")
    assert [r.v for r in c.stored("v double").collect()] == [1.0]
    c.clear()
    assert c.stored("v double").count() == 0


def test_sheets_manifest_and_require(spark, tmp_path):
    import pandas as pd

    p = str(tmp_path / "s.csv")
    readers.write_sheet(pd.DataFrame({"k": [1], "label": [""]}), p, ["label"])
    pd.DataFrame({"k": [1], "label": ["human"]}).to_csv(p, index=False)
    with pytest.raises(readers.LabelsPresent):
        readers.write_sheet(pd.DataFrame({"k": [2], "label": [""]}), p, ["label"])
    assert readers.write_sheet(pd.DataFrame({"k": [2], "label": [""]}), p, ["label"], force=True)
    with readers.manifest(str(tmp_path / "m.jsonl"), "s") as facts:
        facts["n"] = 3
    assert json.loads((tmp_path / "m.jsonl").read_text())["facts"] == {"n": 3}
    with pytest.raises(readers.MissingInput):
        readers.require(spark, str(tmp_path / "none"), "nobody")
    with pytest.raises(readers.MissingInput):
        readers.require_columns(spark.range(1), ["id", "other"], "nobody")


def test_streamed_windows(spark, tmp_path):
    from reviewlode.streaming import trends

    rows = [(dt.datetime(2024, 1, 1, h), "a", 1 + h % 5) for h in range(0, 24, 3)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "at timestamp, app string, score int").write.parquet(src)
    s = spark.readStream.schema("at timestamp, app string, score int").parquet(src)
    q = trends.windowed(s, "at", ["app"], "score").writeStream.format("memory").queryName("w_").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("w_").collect()
    assert [(r.app, r.n) for r in got] == [("a", 8)]


@pytest.mark.parametrize(
    "t, kept",
    [
        ("May Allah reward you", False),
        ("May Allah reward you, but the qibla ads are off", True),
        ("Masha Allah, but the ads are broken today", True),
        ("Vitamin ads are everywhere", True),
        ("Jazakallah khair for the ads", False),
    ],
)
def test_devotional_clauses_end_at_commas(spark, t, kept):
    r = spark.createDataFrame([("1", t)], "reviewId string, text string")
    p = absa.handle_requests(absa.tag_sentences(absa.sentences(r, "reviewId", "text"), LEX))
    assert (p.count() > 0) == kept or "ads" not in t


@pytest.mark.parametrize(
    "t, want",
    [
        ("it is missing an option", {"request"}),
        ("it lacks a compass", {"request"}),
        ("kindly add the compass now", {"request"}),
        ("there is no compass here", {"absence"}),
        ("I uninstalled it after the update", {"churn"}),
        ("this is the only app that works", {"preference"}),
        ("than the other one was", set()),
        ("using it for 3 years now", {"tenure"}),
        ("since 2019 every single day", {"tenure"}),
        ("I wish there is no ads", {"request", "absence"}),
    ],
)
def test_demand_families(spark, t, want):
    c = spark.createDataFrame([(t,)], "clause string")
    assert {r.request_type for r in demand.families(c).collect()} == want


def test_draws_are_cut_before_the_shuffle(spark):
    rows = [(str(i), "hot" if i % 3 else f"g{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, g string")
    assert relational.stratified(df, "g", "k", 20).count() == 20
    drawn = [r.g for r in relational.round_robin(df, "g", "k", 12, floor=2).collect()]
    assert all(drawn.count(g) == 2 for g in set(drawn)) and len(drawn) == 12
