"""Quality classifier (operator 2): Bradley-Terry pairwise ranking.

Each text has features that are counted over the whole of it: shares of characters, words and lines, and what a model of its words and
letters says. That model is learned: from labelled texts come the frequencies of hashed words and of hashed runs of three bytes in good
and in bad ones, and a text's features are its mean log ratios and its mean surprise to the model of the good ones. From the same texts come preference pairs (a good text over a
bad one); the logistic loss on the feature difference of each pair gives a linear score, as in the Bradley-Terry model. So that no text
is judged by frequencies that it gave itself, the texts are two folds, and each is measured by the other's frequencies. The
threshold is a quantile of the labelled texts' scores: the one that leaves as large a share below it as the labels call bad.
The score shown is the logistic function of the distance to that threshold, so it is at least 0.5 just for the predicted
good ones. Labels, language, source and doc_id are never inputs of a score; doc_id only says which rows are held out.

The fit uses at most SAMPLE labelled texts (the documented bound; the rows with the smallest hash of doc_id), whose
features, a few numbers each, and the tables of frequencies (WORDS and GRAMS numbers a class) come to the driver. Scoring reads every whole text once, without a shuffle.

Defined results: a null or empty text has all features 0 and a score like any other; a label for a doc_id that is not there
has no effect; of several labels of a doc_id the largest counts, of several rows the text with the smallest hash; a row without a doc_id is not held out; without labels of
both kinds every score is 0.5 and every prediction 1; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded, give_back, table, with_types

SAMPLE = 6000
PAIRS = 60_000
FEATURES = ("log_words", "upper", "digit", "symbol", "pipe", "white", "mean_word", "unique_words", "top_word", "repeats", "words_with_symbols", "end_marks", "log_longest", "line_repeats", "word_ratio", "gram_ratio", "gram_surprise")
WORDS, GRAMS = 1 << 14, 1 << 12

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 white, 5 mark, 6 symbol, 7 from 128 on
for _c in range(256):
    _CLASS[_c] = 1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 else 3 if 48 <= _c <= 57 else 4 if _c in (9, 10, 11, 12, 13, 32) else 5 if _c in b".,;:'-" else 7 if _c >= 128 else 6 if 33 <= _c < 127 else 0


def lexical(raw: bytes, words: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of different words, their counts, counts of all hashed runs of three bytes)."""
    names = np.fromiter((zlib.crc32(w) % WORDS for w in words), np.int64, len(words))
    times = np.fromiter(words.values(), np.int64, len(words))
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    grams = (((x[:-2] * 31 + x[1:-1]) * 31 + x[2:]) * np.uint32(2654435761)) >> np.uint32(20) if len(x) > 2 else x[:0]
    return names, times, np.bincount(grams, minlength=GRAMS)


class Lexicon:
    """Log ratios of hashed words and grams between good and bad texts, and the surprise of grams to the good ones. counts: two rows, of bad and good texts."""

    def __init__(self, counts: np.ndarray) -> None:
        log = lambda x: np.log((x + 0.5) / (x.sum(axis=1, keepdims=True) + 0.5 * x.shape[1]))
        word, gram = log(counts[:, :WORDS].astype(float)), log(counts[:, WORDS:].astype(float))
        self.word, self.gram, self.surprise = word[1] - word[0], gram[1] - gram[0], -gram[1]


def features(text: str | None, lexicon: Lexicon | None) -> list[float]:
    """Shares of characters, words and lines, and the means of the lexicon over all words and grams."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=hist, minlength=8)
    n, w = len(raw), len(words)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    shout = sum(c for x, c in counts.items() if x.isupper() and len(x) > 1) if by[1] else 0
    odd = sum(c for x, c in counts.items() if x[-1] in b"#$%&*!|" and len(x) > 1) if by[6] else 0
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    told = [0.0, 0.0, 0.0]
    if lexicon is not None:
        names, times, grams = lexical(raw, counts)
        told = [float(lexicon.word[names] @ times) / w, float(lexicon.gram @ grams) / max(1, n - 2), float(lexicon.surprise @ grams) / max(1, n - 2)]
    return [
        math.log1p(w), shout / w, by[3] / n, by[6] / n, counts.get(b"|", 0) / w, by[4] / n, (n - by[4]) / w / 10, len(counts) / w,
        max(counts.values()) / w if w > 9 else 0.0, repeats / w, odd / w, by[5] / n, math.log1p(max(map(len, words))), 1 - len(set(lines)) / max(1, len(lines)), *told,
    ]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, steps: int = 25) -> dict | None:
    """Bradley-Terry by Newton steps on pairs (good, bad) that a fixed seed draws."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / std, -6, 6)
    rng = np.random.default_rng(0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        move = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge / 1000 * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge / 1000 * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    s = z @ w
    low, high = np.sort(s[bad]), np.sort(s[good])
    below = np.sort(s)
    k = len(bad)
    cut = (below[k - 1] + below[min(k, len(below) - 1)]) / 2  # the quantile that the labels give
    spread = max(1e-6, (np.median(high) - np.median(low)) / 6)
    return {"mean": mean, "std": std, "w": w, "cut": float(cut), "spread": float(spread)}


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    s = np.clip((x - model["mean"]) / model["std"], -6, 6) @ model["w"]
    return 1 / (1 + np.exp(-np.clip((s - model["cut"]) / model["spread"], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """labels: doc_id, quality. Uses only rows that are not held out."""
    known = with_types(labels, doc_id="long", quality="int").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))
    rows = bounded(with_types(docs, doc_id="long", text="string")).join(F.broadcast(known), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, WORDS + GRAMS), np.int64)
        for batch in batches:
            for text, quality, fold in zip(batch["text"], batch["quality"], batch["fold"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                names, times, grams = lexical(raw, Counter(raw.split()))
                np.add.at(total[2 * fold + quality], names, times)
                total[2 * fold + quality, WORDS:] += grams
        at, place = np.nonzero(total)
        yield pd.DataFrame({"at": at, "place": place, "times": total[at, place]})

    got = rows.mapInPandas(count, "at long, place long, times long").groupBy("at", "place").agg(F.sum("times").alias("times")).toPandas()
    total = np.zeros((4, WORDS + GRAMS), np.int64)
    total[got["at"], got["place"]] = got["times"]
    other = [Lexicon(total[2:]), Lexicon(total[:2])]  # for the texts of a fold the other's

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t, other[f]) for t, f in zip(batch["text"], batch["fold"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "h": batch["h"], "x": x})

    each = rows.withColumn("h", F.xxhash64("text")).mapInPandas(run, "doc_id long, quality int, h long, x array<double>")
    got = each.groupBy("doc_id", "quality").agg(F.min_by("x", "h").alias("x")).toPandas()  # at most `sample` rows, a few numbers each
    if not len(got):
        return None
    got = got.sort_values("doc_id")
    model = fit(np.array(got["x"].tolist()), got["quality"].to_numpy())
    return model and model | {"lexicon": Lexicon(total[:2] + total[2:])}


def judge(model: dict | None, texts: Iterable[str | None]) -> np.ndarray:
    """Scores of texts."""
    lexicon = model and model["lexicon"]
    return score(model, np.array([features(t, lexicon) for t in texts]).reshape(-1, len(FEATURES)))


def scored(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Adds score to all columns of docs."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 200 KB

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(judge(shared.value, batch))
            give_back()

    return bounded(docs).withColumn("score", run(F.col(text).cast("string")))


def op2_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    x = scored(with_types(docs, doc_id="long", text="string"), model)
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on labels among them, predicts to be good."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    x = scored(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text")), model, "_text")
    return x.where("score >= 0.5").select("_doc.*")
