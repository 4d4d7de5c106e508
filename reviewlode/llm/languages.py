"""Language of every stretch of a text (problem 2).

Each language has a character n-gram model fitted on a bounded sample of
labelled texts, with the rows whose label the model contradicts taken out once.
A text is a mixture of languages: expectation-maximisation estimates their
proportions from the n-gram likelihoods of its units (sentences, clauses and runs
of at most ``UNIT`` words), and the set of languages is grown as long as the
likelihood of the mixture gains more than a penalty.  No language is left out by
its share, so one sentence in a thousand is found.  A Viterbi path over the
words, with dear switches inside a sentence and cheap ones between sentences,
gives the stretches.  Borrowed words and names are too short to pay for a switch.

Where no second language could gain the penalty even if it took every word that
is likelier in it (an upper bound of what the mixture can gain), the mixture has
one language and needs no estimation.

Null, empty and letterless texts have no stretch.  Texts are read whole.  A text
in none of the languages gets the likeliest of them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import regex

from reviewlode.llm import encoding
from reviewlode.llm.lookalikes import alone_by_table, by_table, is_odd

# The languages and the usual spellings of their codes (ISO 639-1, 639-2 and former ones).
CODES = {
    "ar": "ar ara arb",
    "bn": "bn ben",
    "de": "de deu ger",
    "en": "en eng",
    "es": "es spa",
    "fr": "fr fra fre",
    "hi": "hi hin",
    "id": "id ind in",
    "ja": "ja jpn",
    "ru": "ru rus",
    "th": "th tha",
    "tr": "tr tur",
    "ur": "ur urd",
    "zh": "zh zho chi cmn",
}
LANGS = tuple(CODES)
_CANON = {c: k for k, v in CODES.items() for c in v.split()}
#: Rows of the labelled sample, whose whole texts are read: of short texts, and of documents.
SAMPLE = 8_000
SAMPLE_DOCUMENTS = 2_000
#: Log odds that a stretch must gain: inside a sentence, after a comma or colon, after a sentence.
SWITCH = {"": 16.0, ",": 7.0, ".": 4.0}
#: Penalty of the mixture's log likelihood for each language beyond the first.
PENALTY = 6.0
#: Words of a unit of the mixture where no mark ends it.
UNIT = 6
LABEL_PRIOR = 2.0
#: Words whose likelihoods a worker remembers.
KEPT = 100_000
#: Weight of a capitalised word inside a sentence, which may be a name.
NAMED = 0.25


@lru_cache(10_000)
def canonical(label: str | None) -> str | None:
    """The two-letter code that a label means in any usual spelling, else None."""
    if not label:
        return None
    return _CANON.get(regex.split(r"[-_.@ ]", label.strip().lower())[0])


_SKIP = regex.compile(r"[\w.+-]+\s*[\[(]\s*at\s*[\])]\s*[\w-]+(?:\s*(?:[\[(]\s*dot\s*[\])]|\.)\s*[\w-]+)*|https?://\S+|\S+@\S+|[@#]\w+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|test|example|io|app)\b[/\w.]*")
_TOKEN = regex.compile(
    r"(?P<th>[฀-๿]+)|(?P<cj>[々-〇぀-ヿ㐀-鿿]+)|(?P<w>[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*)|(?P<end>[.!?…。！？؟۔।\n]|[\U0001F300-\U0001FAFF☀-➿⭐])|(?P<mid>[,:;،，、؛(])"
)
_MAY_SKIP = regex.compile(r"[@#]|://|[\[(]\s*at\s*[\])]|\w\.[a-z]{2}")
_RUN = regex.compile(r"[^\s]+")
_WORDS = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_NO_BLANKS = regex.compile(r"[฀-๿々-〇぀-ヿ㐀-鿿]")
_LETTER = regex.compile(r"\p{L}")


def tokens(text: str, named: list[int] | None = None) -> tuple[list[str], list[str]]:
    """Words in lower case, and what stands before each one: '' / ',' / '.'; ``named`` gets the places of likely names."""
    words, before = [], []
    mark = "."
    if _MAY_SKIP.search(text):
        text = _SKIP.sub(" ", text)
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "end":
            mark = "."
        elif kind == "mid":
            if mark != ".":
                mark = ","
        else:
            w = m.group().lower()
            if kind != "w" and len(w) > 12:  # scripts without blanks: pieces
                for i in range(0, len(w), 8):
                    words.append(w[i : i + 8])
                    before.append(mark)
                    mark = ""
                continue
            words.append(w)
            before.append(mark)
            if mark != "." and named is not None and kind == "w" and m.group().istitle() and len(w) > 1:
                named.append(len(words) - 1)
            mark = ""
    return words, before


# The scripts that the languages are written in, with the languages of each.
SCRIPTS = (
    ("[a-zà-ɏ]", "de en es fr id tr"),
    ("[\\u0400-\\u052F]", "ru"),
    ("[\\u0600-\\u06FF]", "ar ur"),
    ("[\\u0900-\\u097F]", "hi"),
    ("[\\u0980-\\u09FF]", "bn"),
    ("[\\u0E00-\\u0E7F]", "th"),
    ("[\\u3040-\\u30FF]", "ja"),
    ("[\\u3400-\\u9FFF]", "ja zh"),
)
_BY_SCRIPT = [(regex.compile(p), np.array([lang not in ls.split() for lang in LANGS])) for p, ls in SCRIPTS]
#: How much less likely a word is in a language that isn't written in its script.
FOREIGN = 18.0


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Ngrams:
    """Log likelihood of words under each language: trigrams, backed off to pairs and single characters."""

    def __init__(self, counts: list[dict[str, Counter]]):
        """``counts[k][lang]``: counts of k+1-grams."""
        uni, bi, tri = counts
        self.uni = self._table(uni, None)
        self.bi = self._table(bi, self.uni)
        self.tri = self._table(tri, self.bi)
        self._ready()

    def _ready(self):
        self.floor = np.full(len(LANGS), -13.0, dtype=np.float32)
        #: Rows of words seen, by word; the matrix grows up to ``KEPT`` rows and then starts anew.
        self.place: dict[str, int] = {}
        self.seen = np.empty((1024, len(LANGS)), dtype=np.float64)

    def packed(self) -> list:
        """The tables as keys and matrices, small to send."""
        return [(list(t), np.array(list(t.values()), dtype=np.float32)) for t in (self.uni, self.bi, self.tri)]

    @staticmethod
    def unpacked(parts: list) -> Ngrams:
        m = Ngrams.__new__(Ngrams)
        m.uni, m.bi, m.tri = ({k: v for k, v in zip(keys, rows)} for keys, rows in parts)
        m._ready()
        return m

    @staticmethod
    def _table(by: dict[str, Counter], lower) -> dict[str, np.ndarray]:
        keys = {g for c in by.values() for g in c}
        head = {lang: Counter() for lang in LANGS}
        kinds = {lang: Counter() for lang in LANGS}
        for lang in LANGS:
            for g, n in by[lang].items():
                head[lang][g[:-1]] += n
                kinds[lang][g[:-1]] += 1
        out = {}
        for g in keys:
            row = np.empty(len(LANGS), dtype=np.float32)
            back = lower.get(g[1:]) if lower is not None else None
            for k, lang in enumerate(LANGS):
                n, total, t = by[lang].get(g, 0), head[lang].get(g[:-1], 0), kinds[lang].get(g[:-1], 0)
                p0 = math.exp(float(back[k])) if back is not None else 2e-6
                row[k] = math.log((n + 2.0 * t * p0 + 2.0 * p0) / (total + 2.0 * t + 2.0)) if total + t else math.log(p0) - 1.0
            out[g] = row
        return out

    def word(self, w: str) -> np.ndarray:
        rows = []
        for g in grams(w):
            row = self.tri.get(g)
            if row is None:
                row = self.bi.get(g[1:])
                row = row - 1.0 if row is not None else self.uni.get(g[2:])
                if row is None:
                    row = self.floor
            rows.append(row)
        got = np.sum(rows, axis=0)
        for pattern, others in _BY_SCRIPT:
            if pattern.search(w):
                got = np.where(others, got[~others].max() - FOREIGN, got)
                break
        return np.maximum(got, got.max() - (FOREIGN if len(w) > 2 else FOREIGN / 3))  # one odd word decides nothing

    def language(self, piece: str) -> str | None:
        """The likeliest language of a piece of text; None without words."""
        ws = _WORDS.findall(piece.lower())
        return LANGS[int(self.words(ws).sum(0).argmax())] if ws else None

    def words(self, ws: list[str]) -> np.ndarray:
        place = self.place
        try:
            return self.seen[[place[w] for w in ws]]
        except KeyError:
            pass
        if len(place) > KEPT:
            place.clear()
        for w in ws:
            if w not in place:
                n = len(place)
                if n == len(self.seen):
                    self.seen = np.concatenate([self.seen, np.empty_like(self.seen)])
                self.seen[n] = self.word(w)
                place[w] = n
        return self.seen[[place[w] for w in ws]].reshape(len(ws), len(LANGS))


_MODELS: dict[str, Ngrams] = {}


def worker_model(token: str, parts: list) -> Ngrams:
    """The model of a worker; tasks of the same query share it."""
    if token not in _MODELS:
        _MODELS.clear()
        _MODELS[token] = Ngrams.unpacked(parts)
    return _MODELS[token]


def count_grams(rows: list[tuple[str, str]]) -> list[dict[str, Counter]]:
    """Counts of characters, pairs and trigrams by language of (language, text)."""
    words: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        words[lang].update(tokens(text)[0])
    out = [{lang: Counter() for lang in LANGS} for _ in range(3)]
    for lang, c in words.items():
        for w, n in c.items():
            for g in grams(w):
                for k in (1, 2, 3):
                    out[k - 1][lang][g[3 - k :]] += n
    return out


def fit(rows: list[tuple[str, str]]) -> list[dict[str, Counter]]:
    """Counts of the sample after rows whose label the first model contradicts were taken out."""
    rows = [r for r in rows if not encoding.is_damaged(r[1]) and not is_odd(r[1])]
    kept = rows
    for _ in range(1):
        model = Ngrams(count_grams(kept))
        nxt = []
        for lang, text in rows:
            ws = tokens(text)[0]
            if ws:
                s = model.words(ws)
                if LANGS[int(s.sum(0).argmax())] == lang and (s.argmax(1) == LANGS.index(lang)).mean() > 0.6:
                    nxt.append((lang, text))
        kept = nxt
    return count_grams(kept)


def repaired(text: str, model: Ngrams) -> str:
    """A damaged text as far as it can be read again, chosen by the likelihood of its words in any language."""
    for _ in range(3):
        spans = [s for s in (encoding.utf8_spans(text) or encoding.double_spans(text)) if s[2] is not None]
        if not spans:
            break
        out, at = [], 0
        for a, b, good, _w in spans:
            out += [text[at:a], good]
            at = b
        text = "".join(out) + text[at:]
    how = encoding._legacy(text)
    if how:
        best, score = text, _score(text, model)
        rights = {"latin": encoding.RIGHT_OVER_LATIN, "turkish": ("cp1254",), "cyrillic": encoding.RIGHT_OVER_CYRILLIC}[how]
        for w in ("cp1252", "cp1254") if how != "cyrillic" else ("cp1251", "koi8_r"):
            for r in rights if w != "koi8_r" else ("cp1251",):
                new = regex.sub(r"[^\x00-\x7F][^Ā-őƀ-￿]*" if how != "cyrillic" else r"[А-яЁё─-╬][А-яЁё \x21-\x7E─-╬]*", lambda m, w=w, r=r: (encoding.back_to_bytes(m.group(), w) or b"").decode(r, "replace") or m.group(), text)
                if "�" not in new:
                    s = _score(new, model)
                    if s > score:
                        best, score = new, s
        text = best
    return text


def _score(text: str, model: Ngrams) -> float:
    ws = tokens(text)[0]
    return float(model.words(ws).max(1).sum()) / max(1, sum(map(len, ws))) if ws else -99.0


def mixture(like: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Proportions of the languages of a text by expectation-maximisation over its units' log likelihoods, and its log likelihood."""
    top = like.max(1, keepdims=True)
    p = np.exp(like - top)
    pi = np.full(like.shape[1], 1.0 / like.shape[1])
    last = -np.inf
    for _ in range(steps):
        r = p * pi
        each = r.sum(1, keepdims=True)
        total = float(np.log(each).sum())
        if total - last < 0.05:
            break
        last = total
        pi = (r / each).mean(0)
    return pi, total + float(top.sum())


def choose(units: np.ndarray, best: int, rivals: list[int]) -> list[int]:
    """The set of languages with the best penalised likelihood of the mixture, grown from the best single one."""
    langs = [best]
    have = float(units[:, best].sum())
    while True:
        gain, pick = PENALTY, None
        for k in rivals:
            if k not in langs:
                g = mixture(units[:, [*langs, k]])[1] - have
                if g > gain:
                    gain, pick = g, k
        if pick is None:
            return langs
        langs.append(pick)
        have += gain


def _rivals(like: np.ndarray, prior: str | None) -> tuple[int, list[int]]:
    """The likeliest language of a text alone, and those that could gain the penalty beside it, by the sum of all words that are likelier in them."""
    if prior:
        like[0, LANGS.index(prior)] += LABEL_PRIOR
    k = int(like.sum(0).argmax())
    gain = np.maximum(like - like[:, k : k + 1], 0).sum(0)
    return k, [int(j) for j in np.flatnonzero(gain > PENALTY)]


def _alone(like: np.ndarray, k: int) -> tuple[str, float]:
    total = like.sum(0)
    return LANGS[k], float(1.0 / np.exp(np.minimum(total - total[k], 50)).sum())


def _plain_run(m) -> str:
    w = m.group()
    return w if w.isascii() or not is_odd(w) else by_table(w)


def stretches(text: str | None, model: Ngrams, prior: str | None = None) -> list[tuple[str, float]]:
    """(language, confidence) of each longest stretch of one language, in text order."""
    if not text or not _LETTER.search(text):
        return []
    plain = text.isascii()
    if not plain and encoding.is_damaged(text):
        text = repaired(text, model)
        plain = text.isascii()
    if not plain and is_odd(text):
        text = _RUN.sub(_plain_run, text)
        text = alone_by_table(text)
    if plain or not _NO_BLANKS.search(text):
        # most texts are in one language; these need neither marks nor names
        fast = _WORDS.findall((_SKIP.sub(" ", text) if _MAY_SKIP.search(text) else text).lower())
        if not fast:
            return []
        like = model.words(fast)
        k, rivals = _rivals(like, prior)
        if not rivals:
            return [_alone(like, k)]
    named: list[int] = []
    ws, before = tokens(text, named)
    if not ws:
        return []
    like = model.words(ws)
    if named:
        like[named] *= NAMED
    k, rivals = _rivals(like, prior)
    if not rivals:
        return [_alone(like, k)]
    starts, run = [], 0
    for i, mark in enumerate(before):
        if mark or run == UNIT:
            starts.append(i)
            run = 0
        run += 1
    langs = choose(np.add.reduceat(like, starts, axis=0), k, rivals)
    if len(langs) == 1:
        return [_alone(like, k)]
    e = like[:, langs]
    score = e[0].copy()
    back = np.zeros(e.shape, dtype=int)
    for i in range(1, len(ws)):
        cost = SWITCH[before[i]]
        top = int(score.argmax())
        moved = score[top] - cost
        stay = score >= moved
        back[i] = np.where(stay, np.arange(len(langs)), top)
        score = np.where(stay, score, moved) + e[i]
    path = [int(score.argmax())]
    for i in range(len(ws) - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    out: list[list] = []
    for i, s in enumerate(path):
        if out and out[-1][0] == s:
            out[-1][1].append(i)
        else:
            out.append([s, [i]])
    res: list[tuple[str, float]] = []
    for s, idx in out:
        sums = e[idx].sum(0)
        conf = float(1.0 / np.exp(np.clip(sums - sums[s], -50, 50)).sum())
        lang = LANGS[langs[s]]
        if res and res[-1][0] == lang:
            continue
        res.append((lang, conf))
    return res
