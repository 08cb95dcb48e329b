"""SimHash near-duplicates (operator 9): fingerprints searched by vantage-point trees.

A tree over all 64 bits prunes little at a radius of 4: unrelated fingerprints lie 32 +- 4 bits from any vantage point, so
one split keeps some 57 % of the pairs. The upper level of the search is therefore a forest over parts of the fingerprint:
the bits are cut in b blocks, and a tree for each choice of b - radius blocks partitions by the Hamming distance on those
blocks. Two fingerprints that differ in at most `radius` bits agree (distance 0) on one of these choices, so there the
triangle bound needs no overlap and a shard is a value of the chosen blocks. Shards with too many fingerprints are split
again by their own vantage points over all 64 bits into shells that overlap by the radius; inside a shard a vantage-point
tree with the same overlap leads to leaves that are compared exactly. Every pair within the radius meets in a leaf, so no
link is lost; what leaves a shard is a spanning forest of its links, never all pairs.

Defined results: a null or empty text has fingerprint 0, which is linked like any other; repeated rows come back as often
as they occur; a component of rows that all lack a doc_id has a null component_id; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded, components, counted, give_back, salted_join, sifted, table, with_types

RADIUS = 4
LEAF = 256
#: A shard with more fingerprints than this is split further before one task gets it.
SHARD = 100_000
SHELL = 6


def fingerprint(text: str | None, words: int = 4, seed: int = 42, step: int = 1 << 15) -> int:
    """Majority of the bits of XXH64 over word shingles, repeats included. Splits at ASCII white space, lower-cases A-Z only."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, step):
        h = np.array([digest(whole[a:b], seed) for a, b in zip(starts[k : k + step], ends[k : k + step], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _row(docs: DataFrame):
    """The hash that a row of documents is known by."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, row, fp): the fingerprint as a signed long; row is a hash of doc_id and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "fp": fp.view(np.int64)})
            give_back()

    x = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _row(docs).alias("row"))
    return bounded(x).mapInPandas(run, "doc_id long, row long, fp long")


def _walk(x: np.ndarray, radius: int, near) -> list[tuple[int, int]]:
    """Spanning forest of a set by breadth-first search; what is reached leaves the set. near(frontier, rest) -> matrix of links."""
    out, rest, front = [], x, x[:0]
    while len(rest) or len(front):
        if not len(front):
            front, rest = rest[:1], rest[1:]
        now, front = front[:64], front[64:]
        if len(rest):
            m = near(now, rest)
            hit = m.any(axis=0)
            if hit.any():
                out += zip(now[m[:, hit].argmax(axis=0)].tolist(), rest[hit].tolist(), strict=True)
                front, rest = np.concatenate((front, rest[hit])), rest[~hit]
    return out


def tree_links(x: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Links between distinct fingerprints (uint64) that join all that lie within the radius, found by a vantage-point tree.

    A node keeps its vantage point's distances d and median mu; a pair within the radius has |d - d'| <= radius, so it lies
    in {d <= mu + a} or in {d >= mu + a + 1 - radius}; any other branch is pruned.
    """
    out: list[tuple[int, int]] = []
    todo = [(x, 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) < 2:
            continue
        near = lambda a, b: np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
        if len(part) <= leaf:
            m = near(part, part)
            if m.sum() > len(part):
                out += _walk(part, radius, near)
            continue
        d = np.bitwise_count(part ^ part[(depth * 7919 + len(part) // 2) % len(part)]).astype(np.int64)
        edge = int(np.median(d)) + radius // 2
        inner, outer = part[d <= edge], part[d > edge - radius]
        if max(len(inner), len(outer)) > 0.95 * len(part):  # too dense for a split to help
            out += _walk(part, radius, near)
        else:
            todo += [(inner, depth + 1), (outer, depth + 1)]
    return out


def masks(n: int, radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each tree of the forest. The number of blocks follows the number of fingerprints: more blocks cost more rows, fewer cost larger shards."""

    def cost(b: int) -> float:
        kept = bits * (b - radius) // b
        return comb(b, radius) * (n * 2e-6 + n * n / 2**kept * 1e-9)

    b = min(range(radius + 1, radius + 5), key=cost)
    at = [bits * i // b for i in range(b + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(at, at[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for chosen in combinations(blocks, b - radius) for m in [sum(chosen)]]


def _split(shards: DataFrame, most: int, radius: int, scratch: Scratch) -> DataFrame:
    """Splits shards of more than `most` fingerprints by vantage points of their own, into shells of distances that overlap by the radius.

    It ends when all shards are small, or when the largest no longer shrinks: fingerprints that lie so close are linked to most of the others.
    """
    ready, k, before = None, 0, None
    while True:
        sizes = shards.groupBy("tree", "key").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias("v")).where(F.col("n") > most)
        largest = sizes.agg(F.max("n")).first()[0]
        if largest is None or before is not None and largest > 0.95 * before:
            break
        hot = scratch.keep(shards.join(sizes, ["tree", "key"]))
        cold = shards.join(sizes, ["tree", "key"], "left_anti")
        ready = cold if ready is None else ready.union(cold)
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
        home = F.floor(d / SHELL).cast("long")
        shells = F.when(d >= (home + 1) * SHELL - radius, F.array(home, home + 1)).otherwise(F.array(home))
        shards = scratch.keep(hot.select("tree", F.xxhash64("key", "v", F.lit(k)).alias("up"), "fp", F.explode(shells).alias("shell")).select("tree", F.xxhash64("up", "shell").alias("key"), "fp"))
        k, before = k + 1, largest
    return shards if ready is None else ready.union(shards)


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints, a column fp: enough of them to join every pair within the radius."""
    x = fps.select("fp").distinct()
    trees = masks(max(1, x.count()), radius)
    shards = x.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(trees)])).alias("s")).select("s.tree", "s.key", "fp")
    shards = _split(shards, shard, radius, scratch or Scratch(fps.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(parts: list[pd.DataFrame]) -> pd.DataFrame:
            t, k, x = (np.concatenate([p[c].to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for c in ("tree", "key", "fp"))
            at = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            pairs = [p for group in np.split(x.view(np.uint64), at) if len(group) > 1 for p in tree_links(np.unique(group), radius)]
            got = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

        held: list[pd.DataFrame] = []
        for batch in batches:  # sorted by shard: all but the last shard of a batch are whole
            if not len(batch):
                continue
            same = ((batch["tree"] == batch["tree"].iloc[-1]) & (batch["key"] == batch["key"].iloc[-1])).to_numpy()
            if same.all() and held and tuple(held[0][["tree", "key"]].iloc[-1]) == tuple(batch[["tree", "key"]].iloc[0]):
                held.append(batch)  # one shard over several batches
                continue
            yield found([*held, batch[~same]])
            held = [batch[same]]
        yield found(held)

    return shards.repartition("tree", "key").sortWithinPartitions("tree", "key").mapInPandas(run, "a long, b long")


def grouped(docs: DataFrame, radius: int = RADIUS, words: int = 4, shard: int = SHARD, scratch: Scratch | None = None) -> DataFrame:
    """(fp, doc_id, row, root, component_id) for every row; root is the smallest fingerprint of the component."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs, words))
    first = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = scratch.keep(components(links(first, radius, shard, scratch), scratch=scratch))
    known = scratch.keep(first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.keep(salted_join(known.select("root", "fp"), ids, "root", counted(known, "root")).select("fp", "root", "component_id"))
    return salted_join(rows, named, "fp", first.select("fp", "n"))  # a third of all rows may have one fingerprint


def op9_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: of those with the smallest doc_id the one whose fingerprint, then text, has the smallest hash.

    A doc_id may stand in several rows: only those that are near copies are one group. Rows equal in doc_id and text are one document;
    where other columns differ, the row with the smallest hash of all columns stays. Rows without a doc_id come last in a group.
    """
    scratch = Scratch(spark)
    rows = scratch.keep(grouped(docs, scratch=scratch).select("doc_id", "fp", "row", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "fp", "row")
    firsts = scratch.keep(rows.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias("stays")).distinct())
    each = rows.groupBy("row").agg(F.count("*").alias("times"))
    marked = each.join(firsts, each["row"] == firsts["stays"], "left")
    gone = scratch.keep(marked.where("stays is null").select("row"))
    again = scratch.keep(marked.where("stays is not null and times > 1").select("row"))
    scratch.drop(rows, firsts)
    x = docs.select(F.struct(*docs.columns).alias("_doc"), _row(docs).alias("row"))
    x = sifted(x, "row", gone.union(again))
    some = x.where("maybe").join(gone, "row", "left_anti")  # other texts are not shuffled
    single = some.join(again, "row", "left_anti")
    least = Window.partitionBy("row").orderBy(F.xxhash64("_doc"))
    twice = some.join(again, "row", "left_semi").withColumn("k", F.row_number().over(least)).where("k = 1")
    return x.where("not maybe").select("_doc.*").union(single.select("_doc.*")).union(twice.select("_doc.*"))
