"""Sentiment scorers: a protocol, and a default that needs no model.

A scorer maps a DataFrame with a ``sentence`` column to one with ``p_neg``,
``p_neu`` and ``p_pos``; ``sentiment_model`` names the scorer.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    name: str

    def __call__(self, sentences: DataFrame) -> DataFrame: ...


# A small general vocabulary of judgement.
POSITIVE = "good great best love helpful accurate pretty elegant clean calm reliable nice works useful perfect excellent easy blessed".split()
NEGATIVE = "bad worst broken slow noisy clumsy confusing outdated careless useless missing late wrong small waste crash crashes stopped uninstalled drains ads".split()


class LexiconScorer:
    """Shares of positive and negative words with one neutral pseudo-count; columns only, no Python workers."""

    name = "lexicon"

    def __init__(self, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE):
        self.positive, self.negative = positive, negative

    def __call__(self, sentences: DataFrame) -> DataFrame:
        words = F.split(F.lower("sentence"), "[^a-z]+")
        pos = F.size(F.filter(words, lambda w: w.isin(self.positive))).cast("double")
        neg = F.size(F.filter(words, lambda w: w.isin(self.negative))).cast("double")
        total = pos + neg + 1.0
        return sentences.withColumns({"p_neg": neg / total, "p_neu": F.lit(1.0) / total, "p_pos": pos / total, "sentiment_model": F.lit(self.name)})


def guess_language(text: str):
    """(language, confidence) by script: the default of a language scorer; empty text is unknown with no confidence."""
    from reviewlode.functions import text as T

    empty = F.coalesce(F.col(text), F.lit("")) == ""
    return F.when(empty, "unk").otherwise(T.script_guess(text)), F.when(empty, 0.0).otherwise(0.5)


def canonical_order(labels: list[str]) -> list[int]:
    """Where Negative, Neutral and Positive stand among a model's labels; raises if one is missing."""
    found = {}
    for i, label in enumerate(labels):
        low = label.lower()
        for k, names in enumerate((("neg", "label_0", "1 star"), ("neu", "label_1", "3 star"), ("pos", "label_2", "5 star"))):
            if low.startswith(names):
                found.setdefault(k, i)
    if len(found) != 3:
        raise ValueError(f"no three sentiment labels in {labels}")
    return [found[k] for k in range(3)]


def with_backoff(run: Callable[[list[str]], list], items: list[str], batch: int = 512, smallest: int = 8) -> list:
    """Results of ``run`` over batches sorted by length, in the items' order; a batch that runs out of memory is halved.

    Raises if a batch gives another number of results than items.
    """
    order = sorted(range(len(items)), key=lambda i: len(items[i]))
    out: list = [None] * len(items)
    at = 0
    while at < len(order):
        part = order[at : at + batch]
        try:
            got = run([items[i] for i in part])
        except MemoryError:
            if batch <= smallest:
                raise
            batch = max(smallest, batch // 2)
            continue
        if len(got) != len(part):
            raise ValueError(f"{len(got)} results for {len(part)} items")
        for i, g in zip(part, got):
            out[i] = g
        at += len(part)
    return out


class ModelScorer:
    """A model loaded lazily once a worker, over Arrow batches; ``load`` gives a function of texts to (labels, probability rows)."""

    def __init__(self, name: str, load: Callable[[], tuple[list[str], Callable[[list[str]], list]]]):
        self.name, self.load = name, load

    def __call__(self, sentences: DataFrame) -> DataFrame:
        load, name = self.load, self.name

        def score(frames):
            labels, run = load()
            neg, neu, pos = canonical_order(labels)
            for f in frames:
                p = with_backoff(run, f["sentence"].fillna("").tolist())
                yield f.assign(p_neg=[x[neg] for x in p], p_neu=[x[neu] for x in p], p_pos=[x[pos] for x in p], sentiment_model=name)

        schema = sentences.schema.simpleString()[7:-1].replace(":", " ") + ", p_neg double, p_neu double, p_pos double, sentiment_model string"
        return sentences.mapInPandas(score, schema)


def cutoff_label(compound, at: float = 0.05):
    """Label of a compound score: positive from +at, negative to -at, else neutral."""
    c = F.col(compound) if isinstance(compound, str) else compound
    return F.when(c >= at, "Positive").when(c <= -at, "Negative").when(c.isNotNull(), "Neutral")


def valence_lexicon(path: str) -> dict[str, float]:
    """Words and valences of a tab-separated lexicon file that the user supplies."""
    frame = pd.read_csv(path, sep="\t", header=None, usecols=[0, 1], names=["w", "v"], quoting=3)
    return dict(zip(frame.w, frame.v.astype(float)))


# Words that strengthen or weaken the one after them, and words that turn it round.
BOOSTERS = dict.fromkeys("absolutely amazingly completely considerably deeply enormously entirely especially exceptionally extremely fully greatly highly hugely incredibly intensely particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably utterly very".split(), 0.293) | dict.fromkeys("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split(), -0.293)
NEGATIONS = frozenset("aint arent cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither never none nope nor not nothing nowhere shouldnt wasnt werent without wont wouldnt rarely seldom despite no".split())
#: What an upper-case word among others adds, what a negation does, and the weight of words further back.
SHOUT, TURN, BACK = 0.733, -0.74, (1.0, 0.95, 0.9)


def valences(text: str, lexicon: dict[str, float]) -> dict[str, float]:
    """neg, neu, pos and compound of a text by the published rules: boosters, capitals, negation, contrast and end marks."""
    words = [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or x for x in text.split()) if len(w) > 1 or w in lexicon]
    low = [w.lower() for w in words]
    plain = [w.replace("'", "").replace("’", "") for w in low]
    some_shout = any(w.isupper() for w in words) and not all(w.isupper() for w in words)
    got = []
    for i, w in enumerate(low):
        v = 0.0 if w in BOOSTERS else lexicon.get(w, 0.0)
        if v:
            if some_shout and words[i].isupper():
                v += SHOUT if v > 0 else -SHOUT
            for back in range(min(3, i)):
                p = i - back - 1
                if low[p] in lexicon and low[p] not in BOOSTERS and plain[p] not in NEGATIONS:
                    continue
                boost = BOOSTERS.get(low[p], 0.0)
                if boost:
                    boost += (SHOUT if boost > 0 else -SHOUT) if some_shout and words[p].isupper() else 0.0
                    v += (boost if v > 0 else -boost) * BACK[back]
                if plain[p] in NEGATIONS:
                    v *= TURN
        got.append(v)
    if "but" in low:
        at = low.index("but")
        got = [v * 0.5 if i < at else v * 1.5 if i > at else v for i, v in enumerate(got)]
    marks = min(text.count("!"), 4) * 0.292
    asks = text.count("?")
    marks += 0.0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96
    total = sum(got)
    total += marks if total > 0 else -marks if total < 0 else 0.0
    pos, neg, neu = sum(v + 1 for v in got if v > 0), sum(v - 1 for v in got if v < 0), sum(v == 0 for v in got)
    if pos > abs(neg):
        pos += marks
    elif pos < abs(neg):
        neg -= marks
    whole = pos + abs(neg) + neu
    share = lambda x: abs(x) / whole if whole else 0.0
    return {"neg": share(neg), "neu": share(neu), "pos": share(pos), "compound": max(-1.0, min(1.0, total / math.sqrt(total * total + 15))) if total else 0.0}


def compound_scorer(lexicon: dict[str, float], text: str = "sentence"):
    """neg, neu, pos and compound of a text column as a struct, by ``valences``; null text gives nulls.  For distinct texts."""

    @F.pandas_udf("neg double, neu double, pos double, compound double")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = [valences(t, lexicon) if isinstance(t, str) else dict.fromkeys(("neg", "neu", "pos", "compound")) for t in texts]
        return pd.DataFrame(rows, columns=["neg", "neu", "pos", "compound"], dtype=float)

    return score(F.col(text))


class Routed:
    """Scores sentences with the scorer of their language, the others with a default; languages come from a column."""

    def __init__(self, by_language: dict[str, Scorer], default: Scorer, column: str = "lang"):
        self.by_language, self.default, self.column = by_language, default, column

    def __call__(self, sentences: DataFrame) -> DataFrame:
        lang = F.coalesce(F.col(self.column), F.lit(""))
        out = self.default(sentences.where(~lang.isin(*self.by_language)) if self.by_language else sentences)
        for code, scorer in self.by_language.items():
            out = out.unionByName(scorer(sentences.where(lang == code)))
        return out


class ZeroShot:
    """Labels for sentences by entailment: distinct sentences, each with a shortlist of labels, scored as pairs.

    ``load`` gives a function of (sentences, hypotheses) to rows of logits
    (contradiction, neutral, entailment); a label's score is the share of
    entailment against contradiction.  ``shortlist`` maps distinct sentences to
    (sentence, label); without it every label of ``labels`` is tried.  Off by
    default: nothing calls it unless a model is supplied.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[list[str], list[str]], list]], labels: dict[str, str], shortlist: Callable[[DataFrame], DataFrame] | None = None):
        """``labels``: label to hypothesis, a list of a few dozen."""
        self.name, self.load, self.labels, self.shortlist = name, load, labels, shortlist

    def __call__(self, sentences: DataFrame) -> DataFrame:
        """sentence, aspect, zeroshot_score of every pair, to be joined back on the text."""
        once = sentences.select("sentence").where(F.col("sentence").isNotNull()).distinct()
        if self.shortlist:
            pairs = self.shortlist(once).select("sentence", F.col("label").alias("aspect"))
        else:
            pairs = once.select("sentence", F.explode(F.array(*map(F.lit, self.labels))).alias("aspect"))
        load, says = self.load, dict(self.labels)

        def score(frames):
            run = load()
            for f in frames:
                items = [f"{s}\x1f{says[a]}" for s, a in zip(f["sentence"], f["aspect"])]
                logits = with_backoff(lambda part: list(run(*map(list, zip(*[x.split("\x1f", 1) for x in part])))), items)
                yield f.assign(zeroshot_score=[1.0 / (1.0 + math.exp(no - yes)) for no, _, yes in logits])

        return pairs.mapInPandas(score, "sentence string, aspect string, zeroshot_score double")


def backstop(unmatched: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = 0.75, least_words: int = 3) -> DataFrame:
    """Aspects for sentences that no pattern matched: ``score`` adds aspect and zeroshot_score; scores at or over the threshold stay."""
    long = unmatched.where(F.size(F.split(F.trim("sentence"), r"\s+")) >= least_words)
    return score(long).where(F.col("zeroshot_score") >= threshold).withColumn("match_method", F.lit("zero_shot"))
