"""Mixing sources to target weights (operator 3): iterative proportional fitting.

Documents fall in cells by source, language and topic; a cell's weight is its number of tokens. Raking multiplies the cells of each
level by target / present share, dimension by dimension, until all marginals meet their targets. A cell's raked weight is its own times
one factor for its source, one for its language and one for its topic; their product is its calibration factor. A document's
probability is its cell's factor times one scale, at most 1, where the scale makes the expected tokens meet the budget. A hash of the
document decides, so the same input gives the same sample.

Topics are learned: each text is a vector of hashed words, and k-means over the vectors of all texts, in rounds that each are one
aggregate, gives TOPICS centres (the first ones are chosen among SEEDS texts with the smallest hash, as far apart as can be). A text's topic is its nearest centre.

Targets are shares by dimension and level; a dimension without any is tempered (shares to the power ALPHA, renormalised).
Targets of levels that do not occur are dropped and the rest renormalised; levels without a target share what the targets
leave below 1 in proportion, or get 0.

Sources may be many: they stay a table, and a round of raking is one aggregate over it that gives the driver a number for each pair of
a language and a topic. Those two dimensions are short lists, of LEVELS pairs at most, else an error is raised. The same steps hold for all sizes.

Defined results: null and empty levels are one level, ""; a null or empty text has no tokens, topic 0 and probability 0;
repeated rows share their fate; an empty table gives an empty result; columns beside doc_id, text, source and lang pass
through a sample untouched; the stage's struct is named mix, or mix_ with as many _ as it takes where docs has such a column.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded, counted, give_back, salted_join, table

DIMENSIONS = ("source", "lang", "topic")
TOPICS, ALPHA, BUDGET, LEVELS = 8, 0.5, 0.5, 1_000_000
ROUNDS, NEAR = 200, 1e-9
SIZE, SEEDS, PASSES = 64, 256, 8
BROADCAST = 100_000  # sources whose factors are broadcast; those of more are joined by a shuffle

#: The targets of the query and the stage: languages as given here, topics alike, sources tempered.
TARGETS = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": {str(k): 1 / TOPICS for k in range(TOPICS)}}


def vector(text: str | None) -> tuple[int, np.ndarray]:
    """(tokens, hashed words): of the different words of four bytes or more the roots of their counts, with signs, at length 1."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    counts = {w: n for w, n in Counter(words).items() if len(w) > 3}
    h = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts))
    weight = np.sqrt(np.fromiter(counts.values(), float, len(counts))) * (1 - 2 * (h >> 31))
    v = np.bincount(h % SIZE, weights=weight, minlength=SIZE) if len(h) else np.zeros(SIZE)
    return len(words), v / (np.linalg.norm(v) or 1.0)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(centres):
        return np.zeros(len(vectors), np.int64)
    return np.argmax(2 * vectors @ centres.T - (centres * centres).sum(axis=1), axis=1)


def learn_topics(texts: DataFrame, topics: int = TOPICS, passes: int = PASSES) -> np.ndarray:
    """Centres of k-means over a table with h, vector."""
    rows = texts.where("tokens > 0").orderBy("h").select("vector").limit(SEEDS).collect()
    seeds = np.unique(np.array([r["vector"] for r in rows]).reshape(-1, SIZE), axis=0)
    chosen = seeds[:1]
    while 0 < len(chosen) < min(topics, len(seeds)):
        away = ((seeds[:, None, :] - chosen[None, :, :]) ** 2).sum(axis=2).min(axis=1)
        chosen = np.concatenate((chosen, seeds[[int(away.argmax())]]))
    for _ in range(passes if len(chosen) else 0):
        now = chosen

        def run(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(now), SIZE + 1))
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["vector"].to_numpy())
                    at = nearest(x, now)
                    np.add.at(total, at, np.concatenate((x, np.ones((len(x), 1))), axis=1))
            k, d = np.nonzero(total)
            yield pd.DataFrame({"k": k, "d": d, "v": total[k, d]})

        got = texts.where("tokens > 0").select("vector").mapInPandas(run, "k long, d long, v double").groupBy("k", "d").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros((len(now), SIZE + 1))
        total[got["k"], got["d"]] = got["v"]
        chosen = np.round(np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(1, total[:, -1:]), now), 6)  # so that the order of additions decides nothing
    return chosen


def _level(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _base(docs: DataFrame) -> DataFrame:
    x = bounded(docs).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _level(F.col("source")).alias("source"), _level(F.col("lang")).alias("lang"))
    return x.withColumn("h", F.xxhash64("doc_id", "text"))


def vectorized(docs: DataFrame) -> DataFrame:
    """doc_id, h, source, lang, tokens, vector of each row."""

    @F.pandas_udf("tokens long, vector array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [vector(t) for t in batch]
            yield pd.DataFrame({"tokens": [n for n, _ in rows], "vector": [v.astype(np.float32) for _, v in rows]})
            give_back()

    return _base(docs).withColumn("m", run("text")).select("doc_id", "h", "source", "lang", "m.tokens", "m.vector")


def _topic(centres: np.ndarray):
    """The topics of vectors."""

    @F.pandas_udf("string")
    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            yield pd.Series(nearest(np.stack(batch.to_numpy()), centres)).astype(str) if len(batch) else pd.Series([], dtype=str)

    return run


def shares(present: Mapping[str, float], wanted: Mapping[str, float] | None, alpha: float = ALPHA) -> dict[str, float]:
    """Target shares of the levels that occur."""
    total = sum(present.values())
    if not wanted:
        powers = {k: (v / total) ** alpha for k, v in present.items()}
        return {k: v / sum(powers.values()) for k, v in powers.items()}
    known = {k: wanted[k] for k in present if k in wanted}
    rest = {k: v for k, v in present.items() if k not in wanted}
    left = max(0.0, 1 - sum(known.values())) if rest else 0.0
    out = known | {k: left * v / sum(rest.values()) for k, v in rest.items()}
    return {k: v / (sum(out.values()) or 1.0) for k, v in out.items()}


def _source_targets(present: DataFrame, wanted: Mapping[str, float] | None, total: float) -> DataFrame:
    """(source, goal): as shares() has them, of a table source, tokens."""
    now = F.col("tokens") / total
    if not wanted:
        power = F.pow(now, F.lit(ALPHA))
        return present.select("source", (power / present.agg(F.sum(power)).first()[0]).alias("goal"))
    told = present.join(F.broadcast(present.sparkSession.createDataFrame(list(wanted.items()), "source string, told double")), "source", "left")
    known, rest = told.agg(F.sum("told"), F.sum(F.when(F.col("told").isNull(), now))).first()
    left = max(0.0, 1 - (known or 0.0)) if rest else 0.0
    return told.select("source", (F.coalesce("told", now * (left / rest if rest else 0.0)) / ((known or 0.0) + left or 1.0)).alias("goal"))


@dataclass(frozen=True)
class Calibration:
    """factors: (source, factor) of sources; lang and topic: factors by level; scale: what factors are multiplied by."""

    factors: DataFrame
    lang: dict[str, float]
    topic: dict[str, float]
    scale: float
    few: bool

    def applied(self, x: DataFrame) -> DataFrame:
        """Adds factor and probability to a table with source, lang, topic, tokens."""
        level = lambda c, by: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in by.items() for v in kv]), F.col(c)), F.lit(0.0)) if by else F.lit(0.0)
        side = self.factors.withColumnRenamed("factor", "_a")
        joined = x.join(F.broadcast(side), "source", "left") if self.few else salted_join(x, side, "source", counted(x, "source"), "left")
        factor = F.when(F.col("tokens") > 0, F.coalesce("_a", F.lit(0.0)) * level("lang", self.lang) * level("topic", self.topic)).otherwise(0.0)
        return joined.withColumn("factor", factor).withColumn("probability", F.least(F.lit(1.0), F.col("factor") * self.scale)).drop("_a")


def calibrate(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float, scratch: Scratch, rounds: int = ROUNDS, near: float = NEAR) -> Calibration | None:
    """Rakes a table source, lang, topic, tokens; None if it is empty."""
    pairs = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(LEVELS + 1).collect()
    if not pairs:
        return None
    if len(pairs) > LEVELS:
        raise ValueError(f"languages and topics have more than {LEVELS} pairs")
    total = float(sum(r["tokens"] for r in pairs))
    names = {d: sorted({r[d] for r in pairs}) for d in ("lang", "topic")}
    goals = {}
    for d, levels in names.items():
        wanted = shares({n: float(sum(r["tokens"] for r in pairs if r[d] == n)) for n in levels}, targets.get(d))
        goals[d] = np.array([wanted[n] for n in levels])
    known = cells.sparkSession.createDataFrame([(r["lang"], r["topic"], names["lang"].index(r["lang"]) * len(names["topic"]) + names["topic"].index(r["topic"])) for r in pairs], "lang string, topic string, at int")
    sources = cells.join(F.broadcast(known), ["lang", "topic"]).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.collect_list(F.struct("at", (F.col("tokens") / total).alias("w"))).alias("cells"))
    present = scratch.keep(sources)  # a row for each source, at most as long as the pairs are many
    told = scratch.keep(present.join(_source_targets(present.select("source", "tokens"), targets.get("source"), total), "source").select("source", "goal", F.col("cells.at").alias("at"), F.col("cells.w").alias("w")))
    shape = (len(names["lang"]), len(names["topic"]))
    b, c = np.ones(shape[0]), np.ones(shape[1])

    def aggregated(b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """By language and topic the weights that sources have once they meet their targets, without the factors b and c."""
        by = np.outer(b, c).ravel()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = np.zeros(len(by))
            for batch in batches:
                for goal, at, w in zip(batch["goal"], batch["at"], batch["w"], strict=True):
                    own = float((w * by[at]).sum())
                    if own > 0:
                        m[at] += goal / own * w
            at = np.flatnonzero(m)
            yield pd.DataFrame({"at": at, "m": m[at]})

        got = told.select("goal", "at", "w").mapInPandas(run, "at long, m double").groupBy("at").agg(F.sum("m").alias("m")).toPandas()
        out = np.zeros(len(by))
        out[got["at"]] = got["m"]
        return out.reshape(shape)

    ratio = lambda goal, now: np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
    for _ in range(rounds):
        m = aggregated(b, c)
        now = m * b[:, None] * c[None, :]
        off = max(np.abs(now.sum(axis=1) - goals["lang"]).max(), np.abs(now.sum(axis=0) - goals["topic"]).max())
        if off < near:
            break
        b = ratio(goals["lang"], (m * c[None, :]).sum(axis=1))
        c = ratio(goals["topic"], (m * b[:, None]).sum(axis=0))
    by = np.outer(b, c).ravel()

    @F.pandas_udf("factor double, tokens array<double>, factors array<double>")
    def finish(goal: pd.Series, at: pd.Series, w: pd.Series) -> pd.DataFrame:
        own = [float((x * by[i]).sum()) for i, x in zip(at, w, strict=True)]
        a = [g / o if o > 0 else 0.0 for g, o in zip(goal, own, strict=True)]
        return pd.DataFrame({"factor": a, "tokens": [x * total for x in w], "factors": [f * by[i] for f, i in zip(a, at, strict=True)]})

    done = scratch.keep(told.select("source", finish("goal", "at", "w").alias("f")).select("source", "f.*"))
    each = done.select(F.explode(F.arrays_zip("tokens", "factors")).alias("x")).select(F.col("x.tokens").alias("t"), F.col("x.factors").alias("f"))
    goal, scale, full = budget * total, 0.0, -1.0
    while True:  # cells that reach 1 stay there as the scale grows, so this ends after a few steps
        at_one = F.col("f") * scale >= 1
        capped, rest = each.agg(F.sum(F.when(at_one, F.col("t")).otherwise(0.0)), F.sum(F.when(at_one, 0.0).otherwise(F.col("t") * F.col("f")))).first()
        if capped <= full or rest <= 0:
            break
        scale, full = max(scale, (goal - capped) / rest), capped
    few = done.count() <= BROADCAST
    return Calibration(done.select("source", "factor"), dict(zip(names["lang"], b.tolist(), strict=True)), dict(zip(names["topic"], c.tolist(), strict=True)), float(scale), few)


@dataclass(frozen=True)
class Mixture:
    """rows: doc_id, h, source, lang, topic, tokens of all texts; centres of topics; calibration of cells."""

    rows: DataFrame
    centres: np.ndarray
    calibration: Calibration | None

    def decided(self, x: DataFrame) -> DataFrame:
        """Adds factor, probability and kept to a table with h, source, lang, topic, tokens."""
        out = self.calibration.applied(x) if self.calibration else x.withColumns({"factor": F.lit(0.0), "probability": F.lit(0.0)})
        u = F.pmod(F.col("h"), F.lit(1 << 53)) / float(1 << 53)
        return out.withColumn("u", u).withColumn("kept", F.col("u") < F.col("probability"))


def fitted(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> Mixture:
    """Reads all texts once: topics, cells and their calibration."""
    scratch = Scratch(docs.sparkSession)
    texts = scratch.keep(vectorized(docs))
    centres = learn_topics(texts)
    rows = texts.withColumn("topic", _topic(centres)("vector")).select("doc_id", "h", "source", "lang", "topic", "tokens")
    cells = scratch.keep(rows.where("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    return Mixture(rows, centres, calibrate(cells, targets or {}, budget, scratch, rounds))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, h, source, lang, topic, tokens, factor, probability, u (a number in [0, 1) that decides) and kept for every row."""
    found = fitted(docs, targets, budget, rounds)
    return found.decided(found.rows)


def op3_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mixed(table(spark, sf_dir, "documents"), TARGETS)
    return x.select("doc_id", "source", "lang", "topic", "tokens", F.round("factor", 9).alias("factor"), F.round("probability", 9).alias("probability"), "kept")


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of docs, with tokens, topic, factor and probability in a struct. Texts are read a second time, not shuffled."""
    found = fitted(docs, targets, budget)
    centres = found.centres

    @F.pandas_udf("tokens long, topic string")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [vector(t) for t in batch]
            at = nearest(np.array([v.astype(np.float32) for _, v in rows]).reshape(-1, SIZE), centres)
            yield pd.DataFrame({"tokens": [n for n, _ in rows], "topic": at.astype(str)})
            give_back()

    x = _base(docs).withColumn("m", measure("text")).select("row", "h", "source", "lang", "m.tokens", "m.topic")
    name = "mix"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return found.decided(x).where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns], F.struct("tokens", "topic", "factor", "probability").alias(name))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their tokens, topic and probability in a struct named mix."""
    return sampled(docs, TARGETS)
