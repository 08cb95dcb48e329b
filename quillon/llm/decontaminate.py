"""Benchmark decontamination (operator 7): a BM25 index of test items, queried by every training passage with block-max WAND.

The items are the indexed documents, a training passage is the query. An item's impacts are divided by the least score that
a passage can have which holds `least` of the item's word shingles (the shingles lost cost at most so many of its heaviest
words), so one threshold, 1, loses no true match for any item. Passages are windows of 9/8 of the longest item's words
that move by 1/8, so every copy of an item lies whole in one.

As in WAND, lists that cannot lift an item above the threshold are not opened: of each item's words the most frequent ones, as far as
their impacts come to no more than half the threshold, are left out of the lists that are read first. Stretches of a text in which no
item can reach the rest of its threshold by the others have no passage to search; their cost follows the lengths of the lists that are
read, not the number of items. All other passages go through the pivot loop with block maxima, which finds all items above the threshold. What is
retrieved is verified on word shingles (five words): of the whole item, of its question and of its answer (its last
sentence). Counted on the distinct words of a passage, the retrieval is exact; nothing is capped.

The items are a stated query set. They are collected and broadcast in parts of at most PART items, whose size bounds what a
broadcast holds; further parts are further passes. Document frequencies and the mean length are those of all items, so scores are the same for any PART.

Defined results: a null or empty text or item matches nothing; an item of fewer than five words is one shingle; repeated
rows come back as often as they occur; several items of an item_id are items of their own; an empty table gives an empty
result; only doc_id and text and item_id, text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded, give_back, table, with_types

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SHINGLE, LEAST, PART_OVERLAP = 5, 0.8, 0.2
PART, BLOCK = 20_000, 8
K1, B = 1.2, 0.75
FOUND = "array<struct<item_id: long, overlap: double, question_overlap: double, answer_overlap: double, score: double>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


class Item:
    """An item's shingles; those that touch its last sentence belong to the answer, those that touch the rest to the question."""

    def __init__(self, item_id: int | None, text: str | None) -> None:
        self.item_id, self.words = item_id, words_of(text)
        parts = [p for p in SENTENCE.split((text or "").strip()) if words_of(p)]
        split = len(self.words) - len(words_of(parts[-1])) if len(parts) > 1 else 0
        places = _shingles(self.words)
        self.all = set(places)
        self.question = {s for i, s in enumerate(places) if i < split}
        self.answer = {s for i, s in enumerate(places) if i + SHINGLE > split}

    def overlaps(self, passage: set[tuple[str, ...]]) -> tuple[float, float, float]:
        share = lambda s: len(s & passage) / len(s) if s else 1.0
        return share(self.all), share(self.question), share(self.answer)


class Statistics:
    """Document frequencies and the mean length of all items, whatever part of them an index holds."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        self.n, self.df, total = 0, Counter(), 0
        for text in texts:
            if words := words_of(text):
                self.n += 1
                total += len(words)
                self.df.update(set(words))
        self.mean = total / max(1, self.n)

    def impacts(self, words: list[str]) -> dict[str, float]:
        b = K1 * (1 - B + B * len(words) / self.mean)
        return {w: math.log((self.n - self.df[w] + 0.5) / (self.df[w] + 0.5) + 1) * n * (K1 + 1) / (n + b) for w, n in Counter(words).items()}


class Index:
    def __init__(self, items: list[tuple[int | None, str | None]], least: float = LEAST, block: int = BLOCK, statistics: Statistics | None = None, spare: float = 0.5) -> None:
        found = sorted((x for x in (Item(i, t) for i, t in items) if x.words), key=lambda x: (x.words, x.item_id is None, x.item_id))
        self.items, self.least, self.block = found, least, block
        stats = statistics or Statistics(t for _, t in items)
        self.terms = {w: k for k, w in enumerate(sorted({w for x in found for w in x.words}))}
        docs: list[list[int]] = [[] for _ in self.terms]
        values: list[list[float]] = [[] for _ in self.terms]
        first: list[list[tuple[int, float]]] = [[] for _ in self.terms]  # the lists that are read first
        self.need = np.ones(len(found))
        self.first_of: list[dict[int, float]] = []
        for d, x in enumerate(found):
            impact = stats.impacts(x.words)
            lost = math.floor((1 - least) * len(x.all) + 1e-9)
            heaviest = sorted(impact.values(), reverse=True)
            bound = max(sum(heaviest[lost:]) if lost < len(heaviest) else heaviest[-1], 1e-12)
            rest, mine = 0.0, {}
            for w in sorted(impact, key=lambda w: (-stats.df[w], w)):
                t, v = self.terms[w], impact[w] / bound
                docs[t].append(d)
                values[t].append(v)
                if not mine and rest + v <= spare:
                    rest += v
                else:
                    mine[t] = v
                    first[t].append((d, v))
            self.need[d] = 1 - rest
            self.first_of.append(mine)
        self.docs, self.values = docs, values
        self.most = [max(v) for v in values]
        self.upper: list[dict[int, float]] = [{} for _ in self.terms]  # block maxima
        for t, (ds, vs) in enumerate(zip(docs, values, strict=True)):
            for d, v in zip(ds, vs, strict=True):
                self.upper[t][d // block] = max(self.upper[t].get(d // block, 0.0), v)
        self.sizes = np.array([len(x) for x in first], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first_items = np.array([d for x in first for d, _ in x], np.int64)
        self.first_values = np.array([v for x in first for _, v in x])
        longest = max([32, *(len(x.words) for x in found)])
        self.step = max(4, longest // 8)
        self.width = longest + self.step

    def search(self, terms: list[int], least: float = 1 - 1e-9) -> list[tuple[int, float]]:
        """All items of score `least` or more, by block-max WAND: lists are moved to a pivot only where block maxima allow a hit."""
        lists = [[self.docs[t][0], 0, t] for t in terms]  # the item that a list stands at, its place, the term
        out, size = [], self.block
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += self.most[x[2]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == d:
                pivot += 1
            if sum(self.upper[x[2]].get(d // size, 0.0) for x in lists[: pivot + 1]) >= least:
                if lists[0][0] == d:
                    score = sum(self.values[x[2]][x[1]] for x in lists[: pivot + 1])
                    if score >= least:
                        out.append((d, score))
                    goal = d + 1
                else:
                    goal = d
            else:
                goal = (d // size + 1) * size  # no item of this block can reach the threshold with these lists
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0])
                goal = max(goal, d + 1)
            ended = False
            for x in lists[: pivot + 1]:
                if x[0] < goal:
                    post = self.docs[x[2]]
                    x[1] = bisect_left(post, goal, x[1])
                    x[0] = post[x[1]] if x[1] < len(post) else -1
                    ended = ended or x[0] < 0
            if ended:
                lists = [x for x in lists if x[0] >= 0]
        return out

    def matches(self, texts: list[str | None], tokens: int = 1 << 18) -> list[list[dict]]:
        """For each text the items that it holds."""
        out: list[dict[int, dict]] = [{} for _ in texts]
        held, n = [], 0
        for k, text in enumerate(texts if self.items else ()):
            words = words_of(text)
            if len(words) > 0:
                held.append((k, words))
                n += len(words)
            if n >= tokens:
                self._passages(held, out)
                held, n = [], 0
        self._passages(held, out)
        return [list(x.values()) for x in out]

    def _hopeful(self, ids: np.ndarray, bucket: np.ndarray) -> dict[int, list[int]]:
        """Buckets (stretches of `width` words) in which a passage can begin that holds an item above its threshold, with these items.

        A passage lies in two buckets, so an item's impacts on the first lists in both bound its score there.
        """
        known = ids >= 0
        pairs = np.unique(bucket[known] * len(self.sizes) + ids[known])  # a word counts once a bucket
        at, term = np.divmod(pairs, max(1, len(self.sizes)))
        size = self.sizes[term]
        place = np.arange(size.sum()) + np.repeat(self.starts[term] - (np.cumsum(size) - size), size)
        n = len(self.items)
        key = np.repeat(at, size) * n + self.first_items[place]
        order = np.argsort(key, kind="stable")
        key, value = key[order], self.first_values[place][order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        key, total = key[new], np.add.reduceat(value, new) if len(new) else np.zeros(0)
        item = key % n

        def beside(by: int) -> np.ndarray:
            k = np.searchsorted(key, key + by * n).clip(max=max(0, len(key) - 1))
            return total + np.where(key[k] == key + by * n, total[k], 0.0) if len(key) else total

        out: dict[int, list[int]] = {}
        for by in (1, -1):
            for k in np.flatnonzero(beside(by) >= self.need[item] - 1e-6):
                out.setdefault(int(key[k] // n) + min(by, 0), []).append(int(item[k]))
        return out

    def _passages(self, held: list[tuple[int, list[str]]], out: list[dict[int, dict]]) -> None:
        if not held:
            return
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for _, words in held for w in words), np.int64)
        sizes = np.array([len(words) for _, words in held])
        begins = np.cumsum(sizes) - sizes
        spans = -(-sizes // self.width) + 2  # a free bucket before and behind each text
        firsts = np.cumsum(spans) - spans + 1
        bucket = np.repeat(firsts, sizes) + (np.arange(len(ids)) - np.repeat(begins, sizes)) // self.width
        for c, items in self._hopeful(ids, bucket).items():
            h = int(np.searchsorted(firsts, c, "right")) - 1
            if h < 0 or c < firsts[h]:
                continue
            (k, words), lo = held[h], int(begins[h])
            n = len(words)
            begin = (c - int(firsts[h])) * self.width
            starts = [a for a in range(-(-begin // self.step) * self.step, begin + self.width, self.step) if a < max(1, n - self.width + self.step)]
            if not starts:
                continue
            region = ids[lo + begin : lo + min(n, begin + 2 * self.width)].tolist()
            good = np.zeros(len(starts), bool)
            edges = np.array([(a - begin, min(n, a + self.width) - begin) for a in starts])
            for d in set(items):
                mine = self.first_of[d]
                sums = np.cumsum([0.0, *(mine.get(t, 0.0) for t in region)])
                good |= sums[edges[:, 1]] - sums[edges[:, 0]] >= self.need[d] - 1e-6
            for a in (a for a, g in zip(starts, good, strict=True) if g):
                terms = np.unique(ids[lo + a : lo + min(n, a + self.width)])
                got = self.search(terms[terms >= 0].tolist())
                if got:
                    passage = words[a : a + self.width]
                    shingles = set(_shingles(passage))
                    for d, score in got:
                        self._verify(d, shingles, passage, score, out[k])

    def _verify(self, d: int, passage: set, words: list[str], score: float, found: dict[int, dict]) -> None:
        item = self.items[d]
        if len(item.words) < SHINGLE:
            n = len(item.words)
            passage = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        whole, question, answer = item.overlaps(passage)
        if whole < self.least or min(question, answer) < PART_OVERLAP:
            return
        if d not in found or (found[d]["overlap"], found[d]["score"]) < (whole, score):
            found[d] = {"item_id": item.item_id, "overlap": whole, "question_overlap": question, "answer_overlap": answer, "score": score}


def _matcher(shared):
    @F.pandas_udf(FOUND)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.matches(list(batch)))
            give_back()

    return run


def with_matches(docs: DataFrame, items: DataFrame, name: str = "leaks", text: str = "text", part: int = PART) -> DataFrame:
    """Adds an array of the items that each text holds."""
    spark = docs.sparkSession
    items = with_types(items, item_id="long", text="string")
    parts = max(1, -(-items.count() // part))
    statistics = Statistics(r["text"] for r in items.select("text").toLocalIterator())
    found = []
    for k in range(parts):
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        shared = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows.collect()], statistics=statistics))
        found.append(_matcher(shared)(F.col(text).cast("string")))
    return bounded(docs).withColumn(name, F.array_sort(F.concat(*found) if parts > 1 else found[0]))


def op7_bm25_blockmax_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_types(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    x = with_matches(docs, table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", F.explode("leaks").alias("m")).select("doc_id", "m.item_id", "m.overlap", "m.question_overlap", "m.answer_overlap", F.round("m.score", 6).alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    x = with_matches(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text")), table(spark, sf_dir, "benchmark"), "_leaks", "_text")
    return x.where(F.size("_leaks") == 0).select("_doc.*")
