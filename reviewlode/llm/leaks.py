"""Evaluation texts leaking into training text (problem 9).

Test items form a BM25 inverted index with a maximum for every block of
postings.  Scores are taken relative to the item's own threshold, the least
score that a passage holding ``MIN_WORDS`` words of it can have after the
allowed edits, so that one threshold prunes for all items and retrieval loses
nothing.  Each passage of a document (spans of ``SPAN`` words, joined where they
overlap) is a query; block-max WAND gives every item above the threshold.  Retrieved pairs are verified word by
word against the item, question and answer alike.

An opening sentence that at least ``SHARED_BY`` different items share is an
instruction and not counted; openings are counted over all items, whatever the
blocks.  Case, punctuation, blanks, markup and look-alike letters do not matter.
Null, empty and short texts carry nothing; items without an id are left out, as
nothing could name them, and repeated items are one.  Repeated documents are each
reported; a document may carry several items, each once.
"""

from __future__ import annotations

import html
import math
import unicodedata
import uuid
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.llm.common import map_rows, once_a_worker, table, words
from reviewlode.llm.lookalikes import TO_LATIN

#: Words in a row that make a leak, and the words of these per one that may be changed, added or left out.
MIN_WORDS = 18
PER_EDIT = 9
#: Different items that share an instruction.
SHARED_BY = 3
#: Words of a text that hold MIN_WORDS of an item and those added to them; most words of a passage, which is made of such spans.
SPAN = MIN_WORDS + MIN_WORDS // PER_EDIT
PASSAGE = 48
K1, B = 1.2, 0.75
BLOCK = 16
#: Items indexed at once; more are taken in blocks of this size.
ITEMS_AT_ONCE = 20_000

_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,200}>")
_DROP = regex.compile(r"[­​-‏‪-‮⁠-⁤﻿\p{Mn}]")


class _Plain(dict):
    """Characters to their plain lower-case form: look-alikes and compatibility forms to letters, marks and hidden ones to nothing, others to blanks."""

    def __missing__(self, o: int):
        c = chr(o)
        if c in "'’":
            got = None
        else:
            new = _DROP.sub("", unicodedata.normalize("NFKD", c)).translate(TO_LATIN).lower()
            got = "".join(x if x.isalnum() else " " for x in new) or None
        self[o] = got
        return got


_PLAIN = _Plain()


def plain_words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup and look-alikes."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text.lower().translate(_PLAIN).split()


def opening(text: str | None) -> str:
    """The first sentence of an item as plain words; empty where it is the whole item."""
    head, _, rest = (text or "").partition(". ")
    return " ".join(plain_words(head)) if rest else ""


class Index:
    """BM25 inverted index of test items, with block maxima, as plain lists."""

    def __init__(self, items: list[tuple], seen: dict[str, int] | None = None, n_docs: int = 0):
        """``items``: id, text and whether its opening is an instruction; without the third, openings are counted over these items.

        ``seen`` has the number of corpus documents of each word, of ``n_docs``;
        without it, items alone give the weights.
        """
        if items and len(items[0]) < 3:
            heads = Counter(opening(t) for t in {t for _, t in items})
            items = [(i, t, bool(opening(t)) and heads[opening(t)] >= SHARED_BY) for i, t in items]
        self.ids, self.words = [], []
        for i, text, shared in sorted(items, key=lambda x: x[0]):
            self.ids.append(i)
            self.words.append(plain_words((text or "").partition(". ")[2] if shared else text))
        n = max(1, len(self.ids))
        self.grams = []
        for ws in self.words:
            at = defaultdict(list)
            for i in range(len(ws) - RUN + 1):
                at[tuple(ws[i : i + RUN])].append(i)
            self.grams.append(dict(at))
        mean = max(1.0, sum(map(len, self.words)) / n)
        df = Counter(w for ws in self.words for w in set(ws))
        if seen is not None:
            df.update(seen)
            n += n_docs
        #: Of each item the share of its threshold that a word gives.
        self.impact: list[dict[str, float]] = []
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        edits = MIN_WORDS // PER_EDIT
        for k, ws in enumerate(self.words):
            if len(ws) < MIN_WORDS:
                self.impact.append({})
                continue
            tf = Counter(ws)
            norm = K1 * (1 - B + B * len(ws) / mean)
            imp = {w: math.log(1 + max(0.0, n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) + 1e-9 for w, c in tf.items()}
            need = math.inf
            for a in range(len(ws) - MIN_WORDS + 1):
                xs = sorted(imp[w] for w in set(ws[a : a + MIN_WORDS]))
                need = min(need, sum(xs[:-edits] if len(xs) > edits else xs))
            rel = {w: x / need * (1 + 1e-9) for w, x in imp.items()}
            self.impact.append(rel)
            for w, x in rel.items():
                postings[w].append((k, x))
        self.top = {w: max(x for _, x in p) for w, p in postings.items()}
        self.docs = {w: [k for k, _ in p] for w, p in postings.items()}
        self.blocks = {w: [max(x for _, x in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for w, p in postings.items()}

    def search(self, terms: set[str]) -> list[int]:
        """Numbers of all items that reach their own threshold, by block-max WAND."""
        docs, top, blocks, impact = self.docs, self.top, self.blocks, self.impact
        place = dict.fromkeys(terms, 0)
        cursors = sorted((docs[w][0], w) for w in terms)
        out = []
        while cursors:
            bound, pivot = 0.0, -1
            for i, (_, w) in enumerate(cursors):
                bound += top[w]
                if bound >= 1.0:
                    pivot = i
                    break
            if pivot < 0:
                break
            k = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == k:
                pivot += 1
            block, end = 0.0, math.inf
            for at, w in cursors[: pivot + 1]:
                d = docs[w]
                j = place[w] if at >= k else bisect_left(d, k, place[w])
                if j < len(d):
                    block += blocks[w][j // BLOCK]
                    end = min(end, d[min(len(d), (j // BLOCK + 1) * BLOCK) - 1])
            if block < 1.0:
                # no item up to the nearest block end can score enough
                if pivot + 1 < len(cursors):
                    end = min(end, cursors[pivot + 1][0] - 1)
                to = max(end, k) + 1
                moved = pivot + 1
            elif cursors[0][0] == k:
                imp = impact[k]
                if sum(imp[w] for _, w in cursors[: pivot + 1]) >= 1.0:
                    out.append(k)
                to, moved = k + 1, pivot + 1
            else:
                to, moved = k, bisect_left(cursors, (k,))
            gone, cursors = cursors[:moved], cursors[moved:]
            for _, w in gone:
                d = docs[w]
                j = place[w] = bisect_left(d, to, place[w])
                if j < len(d):
                    insort(cursors, (d[j], w))
        return out

    def carried(self, words: list[str]) -> dict[int, tuple[int, int]]:
        """Item number -> (first, last) word of the document that carries it."""
        n = len(words)
        if n < MIN_WORDS - MIN_WORDS // PER_EDIT:
            return {}
        top = self.top
        weight = list(accumulate((top.get(w, 0.0) for w in words), initial=0.0))
        out: dict[int, tuple[int, int]] = {}
        if weight[-1] < 1.0:
            return out
        # a leak lies within SPAN words, so passages are cut where no SPAN words in a row could reach a threshold
        sums = np.array(weight)
        width = min(SPAN, n)
        starts = np.flatnonzero(sums[width:] - sums[:-width] >= 1.0 - 1e-6).tolist()
        at = 0
        while at < len(starts):
            a = starts[at]
            z = a + width
            while at < len(starts) and starts[at] <= z and starts[at] + width - a <= PASSAGE:
                z = starts[at] + width
                at += 1
            terms = {w for w in words[a:z] if w in top}
            if sum([top[w] for w in terms]) < 1.0:
                continue
            for k in self.search(terms):
                if k in out:
                    continue
                lo, hi = max(0, a - PASSAGE), min(n, z + PASSAGE)
                span = overlap(words[lo:hi], self.words[k], self.grams[k])
                if span:
                    out[k] = (lo + span[0], lo + span[1])
        return out


#: MIN_WORDS with the allowed edits always hold an exact run of so many words.
RUN = (MIN_WORDS - MIN_WORDS // PER_EDIT) // (MIN_WORDS // PER_EDIT + 1) + 1


def _reach(words: list[str], item: list[str], j: int, i: int, step: int, most: int) -> list[tuple[int, int]]:
    """For each number of edits, the most item words (and document words) that go on from (j, i); the last one matches."""
    far = {0: 0}  # diagonal -> item words passed
    out = []
    best = (0, 0)
    for edits in range(most + 1):
        new: dict[int, int] = {}
        for d, x in far.items():
            y = x + d
            s = x
            while 0 <= i + step * x < len(item) and 0 <= j + step * y < len(words) and item[i + step * x] == words[j + step * y]:
                x += 1
                y += 1
            if x > s and x > best[0]:
                best = (x, y)
            for dd, xx in ((d, x + 1), (d - 1, x + 1), (d + 1, x)):
                if xx > new.get(dd, -1):
                    new[dd] = xx
        out.append(best)
        far = new
    return out


def overlap(words: list[str], item: list[str], grams: dict[tuple, list[int]]) -> tuple[int, int] | None:
    """Where a text holds at least MIN_WORDS words in a row of an item, with an edit for every PER_EDIT of them; both ends match.

    ``grams`` has the places of the item's runs of RUN words.
    """
    seen = set()
    most = len(item) // PER_EDIT
    best = None
    for j in range(len(words) - RUN + 1):
        for i in grams.get(tuple(words[j : j + RUN]), ()):
            if (j - 1, i - 1) in seen:
                seen.add((j, i))
                continue  # the same run
            seen.add((j, i))
            left = _reach(words, item, j - 1, i - 1, -1, most)
            right = _reach(words, item, j, i, 1, most)
            for a, (li, lj) in enumerate(left):
                for b, (ri, rj) in enumerate(right):
                    n = li + ri
                    if n >= MIN_WORDS and a + b <= n // PER_EDIT and (best is None or lj + rj > best[1] - best[0] + 1):
                        best = (j - lj, j + rj - 1)
    return best


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each word of the test items occurs, and the number of documents; over all documents.

    The words of a block of items are sent to the documents, whose words are
    counted where they are; only the counts are shuffled.
    """
    wanted = docs.sparkSession.createDataFrame([(t,) for t in terms], "w string")
    per = docs.select(F.explode(F.array_distinct(words("text"))).alias("w")).join(F.broadcast(wanted), "w", "left_semi")
    rows = per.groupBy("w").agg(F.count(F.lit(1)).alias("n")).toPandas()
    return dict(zip(rows.w, map(int, rows.n))), docs.count()


def marked_items(items: DataFrame) -> DataFrame:
    """item_id, text, shared: whether at least ``SHARED_BY`` different items of all begin with its opening sentence."""
    items = items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    heads = map_rows(items, f"item_id {dict(items.dtypes)['item_id']}, text string, head string", lambda: lambda i, t: [(i, t, opening(t))])
    common = heads.where("head <> ''").select("head", "text").distinct().groupBy("head").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= SHARED_BY)
    return heads.join(common, "head", "left").select("item_id", "text", F.col("n_").isNotNull().alias("shared"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word of each document with each item it carries."""
    spark = docs.sparkSession
    n = items.count()
    blocks = max(1, -(-n // ITEMS_AT_ONCE))
    marked = marked_items(items)
    out = None
    for b in range(blocks):
        part = marked if blocks == 1 else marked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text, r.shared) for r in part.toLocalIterator()]
        terms = sorted({w for _, t, _ in rows for w in plain_words(t)})
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows, *document_frequencies(docs, terms)))

        def make(shared=shared):
            token, *parts = shared.value
            index = once_a_worker(token, lambda: Index(*parts))

            def one(k, text):
                found = {index.ids[i]: span for i, span in sorted(index.carried(plain_words(text)).items(), reverse=True)}
                return [(k, i, *span) for i, span in sorted(found.items())]

            return one

        found = map_rows(docs.select("doc_id", "text"), "doc_id bigint, item_id bigint, first_word int, last_word int", make)
        out = found if out is None else out.unionByName(found)
    return out


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the words of the document that carry them."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked test item with the number of documents that carry it."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
