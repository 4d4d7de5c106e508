"""Statistics against brute force, and their invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlode.operators import gaps, topics
from reviewlode.stats import agreement, linear, small
from reviewlode.stats.pelt import kernel, pelt


def frame(spark, x, y):
    return spark.createDataFrame(list(zip(x, y)), "x string, y string")


def test_kappa_conventions(spark):
    k = lambda x, y: [r[0] for r in agreement.kappa(frame(spark, x, y), "x", "y", []).collect()]
    assert k("aabb", "aabb") == [1.0]
    assert k("aaaa", "aaaa") == [None]
    assert k("aaaa", "aabb") == [0.0]
    assert abs(k("aabb", "abab")[0]) < 1e-12
    assert k("aab", "abb") == k("abb", "aab")


def test_krippendorff_and_ari(spark):
    a = agreement.krippendorff(frame(spark, "aabbc", "aabbc"), "x", "y").first()
    assert (a.n, a.alpha) == (5, 1.0)
    assert agreement.adjusted_rand(frame(spark, "aabb", "ccdd"), "x", "y").first().ari == 1.0
    assert agreement.adjusted_rand(frame(spark, "aabb", "abab"), "x", "y").first().ari == pytest.approx(-0.5)


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k int, n int")
    lo, hi = agreement.wilson(F.col("k"), F.col("n"))
    got = [(r.lo, r.hi) for r in df.select(lo.alias("lo"), hi.alias("hi")).collect()]
    assert got[0] == (0.0, 1.0) and all(-1e-9 <= a <= b <= 1 + 1e-9 for a, b in got) and got[1][0] == pytest.approx(0.2366, abs=1e-4)


def test_bh_is_monotone(spark):
    rows = [(f"t{i}", "primary", p) for i, p in enumerate([0.001, 0.02, 0.03, 0.5])] + [("n", "primary", None), ("e", "exploratory", 0.001)]
    got = {r.term: r.q_value for r in agreement.benjamini_hochberg(spark.createDataFrame(rows, "term string, family string, p_value double")).collect()}
    assert got["n"] is None and got["e"] is None
    assert [got[f"t{i}"] for i in range(4)] == pytest.approx([0.004, 0.04, 0.04, 0.5])


def test_cluster_ols_and_mixed_match_dense(spark):
    r = np.random.default_rng(1)
    g = np.repeat(np.arange(30), 20)
    u = r.normal(0, 1.0, 30)
    x = r.normal(size=600)
    y = 1 + 2 * x + u[g] + r.normal(0, 0.5, 600)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(y, x, g)], "y double, x double, g int")
    m = linear.moments(df, "y", ["x"], "g")
    ols = linear.cluster_ols(m)
    d = np.column_stack([np.ones(600), x])
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    assert ols.estimate == pytest.approx(beta.tolist())
    e = y - d @ beta
    s = np.array([d[g == k].T @ e[g == k] for k in range(30)])
    inv = np.linalg.inv(d.T @ d)
    v = inv @ (s.T @ s) @ inv * (30 / 29) * (599 / 598)
    assert ols.std_error == pytest.approx(np.sqrt(np.diag(v)).tolist())
    fit = linear.mixed(m)
    assert fit.estimate[1] == pytest.approx(2, abs=0.1) and 0.3 < fit.extra["group_variance"] < 2.5 and fit.extra["residual_variance"] == pytest.approx(0.25, rel=0.3)


def test_models_that_cannot_be_estimated(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (2.0, 1.0, 0)], "y double, x double, g int")
    assert linear.cluster_ols(linear.moments(df, "y", ["x"], "g")).note == "not estimable"
    assert linear.mixed(linear.moments(df.limit(0), "y", ["x"], "g")).note == "not estimable"
    assert linear.drop_sparse(df, ["x"], 3) == [] and linear.drop_sparse(df, ["x"], 2) == ["x"]
    assert linear.ordered_logit([], 3) is None


def test_ordered_logit_sign():
    cells = [((0.0,), y, n) for y, n in enumerate((10, 20, 70))] + [((1.0,), y, n) for y, n in enumerate((60, 25, 15))]
    assert linear.ordered_logit(cells, 3)["coef"][0] < -1


@given(*[st.integers(0, 12)] * 4)
def test_fisher_against_enumeration(a, b, c, d):
    _, p = small.fisher_exact(a, b, c, d)
    r1, r2, c1 = a + b, c + d, a + c
    if r1 and r2 and c1 and b + d:
        prob = {x: math.comb(r1, x) * math.comb(r2, c1 - x) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
        want = sum(v for v in prob.values() if v <= prob[a]) / sum(prob.values())
        assert p == pytest.approx(want, rel=1e-6)
    else:
        assert p == 1.0


def test_resampling_and_dip():
    d, lo, hi = small.bootstrap_difference({5.0: 90, 1.0: 10}, {5.0: 10, 1.0: 90})
    assert d == pytest.approx(3.2) and lo < d < hi
    assert small.bootstrap_difference({}, {1.0: 1}) is None
    assert small.bimodality({1.0: 50, 5.0: 50}) > 0.9 > small.bimodality({1.0: 10, 2.0: 40, 3.0: 80, 4.0: 40, 5.0: 10})
    assert small.bimodality({3.0: 9}) is None
    assert small.dip({1.0: 50, 3.0: 5, 5.0: 50}) > small.dip({1.0: 10, 3.0: 80, 5.0: 10})
    assert small.weighted_precision_interval([]) is None


def optimal(x, penalty, least):
    """Exhaustive optimal partition."""
    k = kernel(x)

    def cost(a, b):
        return np.trace(k[a:b, a:b]) - k[a:b, a:b].sum() / (b - a)

    best = {0: (-penalty, [])}
    for e in range(least, len(x) + 1):
        options = [(best[s][0] + cost(s, e) + penalty, best[s][1] + [s]) for s in best if e - s >= least]
        if options:
            best[e] = min(options)
    return [c for c in best[len(x)][1] if c]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False), min_size=12, max_size=30), st.sampled_from([0.5, 1.5, 3.0]))
def test_pelt_against_exhaustive(values, penalty):
    x = np.array(values)
    k = kernel(x)

    def total(cuts):
        e = [0, *cuts, len(x)]
        return sum(np.trace(k[a:b, a:b]) - k[a:b, a:b].sum() / (b - a) for a, b in zip(e, e[1:])) + penalty * len(cuts)

    assert total(pelt(x, penalty, 3)) == pytest.approx(total(optimal(x, penalty, 3)), abs=1e-6)


def test_pelt_finds_a_step():
    assert pelt(np.r_[np.zeros(20), np.ones(20) * 5], 3.0, 6) == [20] and pelt(np.zeros(3)) == []


def test_gap_bounds(spark):
    f = spark.createDataFrame([("a", "x", 1.0, "csv"), ("b", "x", 1.0, "csv"), ("c", "x", 1.0, "csv"), ("d", "x", None, "csv")], "app string, aspect string, feature_present double, promise_source string")
    rows = [("a", i, "Negative" if i < 13 else "Positive") for i in range(30)] + [("b", i, "Negative" if i < 12 else "Positive") for i in range(30)] + [("c", i, "Negative") for i in range(29)]
    a = spark.createDataFrame([(f"{app}{i}", app, "x", lab, False) for app, i, lab in rows], "reviewId string, app string, aspect string, sentiment_label string, is_request boolean")
    d = spark.createDataFrame([("r", "d", "x", "request"), ("r2", "d", None, "request")], "reviewId string, app string, aspect string, request_type string")
    got = {r.app: r for r in gaps.gap_matrix(f, a, d).collect()}
    assert (got["a"].broken_promise, got["b"].broken_promise, got["c"].broken_promise) == (True, False, False)
    assert not got["d"].promised and got["d"].neg_rate is None and got["d"].demand_signals == 1


def test_topics(spark):
    e = spark.createDataFrame([(i, [float(i % 2) * 9 + i / 100, 1.0]) for i in range(40)], "id int, v array<double>")
    t = topics.cluster(e, "id", "v", 2, outlier=1.0).collect()
    assert len({r.topic_id for r in t if r.id % 2}) == 1
    lab = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, vector array<double>")
    it = spark.createDataFrame([(1, [2.0, 0.1])], "item int, vector array<double>")
    assert [r.label for r in topics.nearest(it, lab, 2).orderBy("rank").collect()] == ["a", "b"]


def test_topic_helpers(spark):
    t = spark.createDataFrame([(1, "compass map"), (2, "zzz")], "topic int, words string")
    assert [r.tags for r in topics.tag_topics(t, "words", {"a": ["Compass"], "b": ["map", "x"], "c": []}).orderBy("topic").collect()] == ["a|b", ""]
    short = spark.createDataFrame([(1, "a"), (1, "b")], "item int, label string")
    gold = spark.createDataFrame([(1, "a"), (2, "a")], "item int, label string")
    assert topics.prefilter_recall(short, gold).first().recall == 0.5 and topics.prefilter_recall(short, gold.limit(0)).first().recall is None
    e = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(20)], "id int, v array<double>")
    assert topics.submodels(e, "id", "v", {"small": e.limit(3)}, 2, 10) is None
    assert topics.submodels(e, "id", "v", {"all": e}, 2, 10).count() == 20


def test_trend_band():
    got = small.trend_band([1, 2, 3, 4, 5], [1, 2, 3, 4, 5.5], [3.0])
    assert got[0][1] <= got[0][0] <= got[0][2] and small.trend_band([1, 1, 1], [1, 2, 3], [1.0]) is None


def test_routing_and_backstop(spark):
    from reviewlode.scorers import LexiconScorer, Routed, backstop

    other = LexiconScorer(["bon"], ["lent"])
    other.name = "fr"
    s = spark.createDataFrame([("good", "en"), ("bon", "fr"), ("x", None)], "sentence string, lang string")
    got = {r.sentence: (r.sentiment_model, r.p_pos > 0) for r in Routed({"fr": other}, LexiconScorer())(s).collect()}
    assert got == {"good": ("lexicon", True), "bon": ("fr", True), "x": ("lexicon", False)}
    u = spark.createDataFrame([("one two three",), ("short",)], "sentence string")
    kept = backstop(u, lambda df: df.withColumn("aspect", F.lit("a")).withColumn("zeroshot_score", F.lit(0.75))).collect()
    assert [r.sentence for r in kept] == ["one two three"]


def test_valences_follow_the_published_rules():
    from reviewlode.scorers import valences

    lex = {"good": 1.9, "bad": -2.5, "great": 3.1}
    c = lambda t: valences(t, lex)["compound"]
    assert c("") == 0 and c("it is here") == 0
    assert abs(c("good") - 1.9 / (1.9**2 + 15) ** 0.5) < 1e-12
    assert c("very good") > c("good") > c("slightly good") and c("good!!!") > c("good") and c("it is GOOD") > c("it is good")
    assert c("not good") < 0 < c("good") and c("doesn't look good") < 0 and abs(c("not good")) < c("good")
    assert c("good but bad") < c("bad good")
    v = valences("the app is good and bad", lex)
    assert abs(v["neg"] + v["neu"] + v["pos"] - 1) < 1e-9


def test_scores_as_columns(spark):
    from reviewlode.scorers import compound_scorer

    df = spark.createDataFrame([("good",), (None,), ("",)], "sentence string").withColumn("s", compound_scorer({"good": 1.9}))
    got = [r.s for r in df.collect()]
    assert got[0].pos == 1.0 and got[1].compound is None and got[2].compound == 0.0


def test_zero_shot_scores_each_text_once(spark):
    from reviewlode.scorers import ZeroShot, backstop

    def load():
        return lambda texts, says: [(0.0, 0.0, 3.0 if s.split()[-1] in t else -3.0) for t, s in zip(texts, says)]

    z = ZeroShot("fake", load, {"qibla": "about the qibla", "ads": "about ads"})
    s = spark.createDataFrame([("the qibla is off",), ("the qibla is off",), ("too many ads here",), (None,)], "sentence string")
    got = {(r.sentence, r.aspect) for r in backstop(s, z, 0.75).collect()}
    assert got == {("the qibla is off", "qibla"), ("too many ads here", "ads")}


def test_weighted_fit_and_p_values(spark):
    import numpy as np

    from reviewlode.stats import linear

    r = np.random.default_rng(1)
    x, w = r.normal(size=30), r.integers(1, 9, 30).astype(float)
    y = 2 + 3 * x + r.normal(size=30)
    got = linear.weighted_fit(spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)], "x double, y double, w double"), "y", ["x"], "w")
    a = np.column_stack([np.ones(30), x])
    beta = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    assert np.allclose([g[1] for g in got], beta)
    # published quantiles: 2.228 at 10 and 1.960 at very many degrees of freedom leave 5 %
    assert abs(linear.student_p(2.2281388520, 10) - 0.05) < 1e-6 and abs(linear.student_p(1.959964, 10**7) - 0.05) < 1e-4 and linear.student_p(0.0, 5) == 1.0
    assert linear.interval(1.0, None) == (None, None) and linear.interval(1.0, 1.0) == (1.0 - 1.96, 1.0 + 1.96)
