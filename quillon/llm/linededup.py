"""Line dedup (operator 6): fuzzy lines by MinHash.

A line (trimmed of spaces) is the set of its shingles of eight characters in lower case, one from every character on; a line of
fewer characters is one shingle. Forty independent minima over the set make its signature, ten bands of four its keys: two
lines with a Jaccard index of 0.8 share a key with probability 0.995, of 0.85 with 0.999, whatever their lengths. Lines that
share a key are candidates, but for those whose signatures agree in fewer than half of their places (one in 10^5 of such pairs). All lines of a bucket are compared with its first one, by exact Jaccard on the whole sets, and
verified links go to a distributed union-find; then those lines of a bucket that are still in different components are
compared with each other, in blocks. So every candidate pair is verified or already joined, no bucket of near copies emits its
pairs, and no large bucket lands in one task. Of each component the first line by (doc_id, line number) stays.

Many lines of a bucket are near, but not alike. Such pairs are told by the sizes of their sets and by bitmaps of them, which bound what two sets
have in common and so exclude no pair that is alike; the sets of the pairs that are left are compared.

All of it is DataFrame operations: a line's characters are made four bytes wide, rows carry the hashes of sixteen shingles each, and
minima are aggregates of generated code. The sets of a pair are made where the pair is. A line is known by a 64-bit hash of its text: n different
lines have a chance of n^2 / 2^65 that two are mixed up; shingles are compared by 64 bits. The functions over lists (signatures, band_keys, alike,
Comparer) are the same method in numpy, for the driver and tests; no query uses them.

Defined results: lines of white space only always stay; a null text stays null and an empty one empty; rows that repeat a
doc_id count as one document, so repeated rows stay alike; a null doc_id is a document of its own, the first in order; of
rows of one doc_id that hold equal lines at one place, none loses it to another; an empty table gives an empty result;
columns beside doc_id and text pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, components, counted, salted_join, sifted, table

BANDS, ROWS, LEAST, WIDTH = 10, 4, 0.8, 8
BLOCK = 256  # lines of one bucket that are compared at once
CHUNK = 1 << 17  # characters whose shingles are hashed at once
SEEN = 1 << 18  # pairs that a Comparer remembers to have compared
STEP = 16  # shingles whose hashes one row carries
WORDS = 32  # of 64 bits each, of a line's bitmap

_MULTIPLIERS = [int(x) | 1 for x in np.random.default_rng(6).integers(1, 1 << 32, 256)]


def _windows(lines: list[str], kind: type, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the shingle from each character on, first shingle, number of shingles) of lines of `width` characters or more."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind)
    step = 1
    for a in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[: width.bit_length() - 1]:
        h = h[:-step] * kind(a & np.iinfo(kind).max) + h[step:]
        step *= 2
    for by, a in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)) if kind is np.uint32 else ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h ^= h >> kind(by)
        h *= kind(a)
    return h, np.cumsum(sizes) - sizes, sizes - width + 1


def _chunks(lines: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of lines that hold about `most` characters together."""
    start = size = 0
    for k, x in enumerate(lines):
        size += len(x)
        if size >= most or k - start >= 60_000:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(lines):
        yield start, len(lines)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _short(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 7)


def signatures(lines: list[str], size: int = BANDS * ROWS, width: int = WIDTH) -> np.ndarray:
    """Minima of `size` hash functions over the shingles of lines in lower case, one row for each line. Those of a line of one shingle are that one's hash."""
    out = np.empty((len(lines), size), np.uint32)
    long_ = [k for k, x in enumerate(lines) if len(x) >= width]
    if len(long_) < len(lines):
        for k in set(range(len(lines))).difference(long_):
            out[k] = _short(lines[k]) >> 32
    for a, b in _chunks([lines[k] for k in long_]):
        at = long_[a:b]
        h, start, n = _windows([lines[k] for k in at], np.uint32, width)
        ends = np.stack((start, start + n), axis=1).ravel()
        h = np.append(h, np.uint32(0))  # so that the last end is a place
        t, least = np.empty_like(h), np.empty((size, len(at)), np.uint32)
        for i in range(size):
            np.multiply(h, np.uint32(_MULTIPLIERS[i]), out=t)
            least[i] = np.minimum.reduceat(t, ends)[::2]
        out[at] = least.T
    return out


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> np.ndarray:
    """Keys of lines in lower case, one row for each line, one column for each band. A line of one shingle has one key in all columns."""
    least = signatures(lines, bands * rows, width).reshape(len(lines), bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = _mixed(key ^ least[:, :, r]) + np.uint64(r + 1)
    for k, x in enumerate(lines):
        if len(x) < width:
            key[k] = _short(x)
    return key


def shingle_sets(lines: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the distinct shingles of lines in lower case, in order; hashes of 48 bits."""
    owners, hashes = [], []
    for a, b in _chunks(lines):
        at = [k for k in range(a, b) if len(lines[k]) >= width]
        keys = [np.array([((k - a) << 48) | (_short(lines[k]) >> 16) for k in range(a, b) if len(lines[k]) < width], np.uint64)]
        if at:
            h, start, n = _windows([lines[k] for k in at], np.uint64, width)
            place = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
            keys.append((h[place] >> np.uint64(16)) | np.repeat((np.array(at) - a).astype(np.uint64) << np.uint64(48), n))
        each = np.concatenate(keys)
        each.sort()
        each = each[np.append(True, each[1:] != each[:-1])[: len(each)]]
        owners.append((each >> np.uint64(48)).astype(np.int64) + a)
        hashes.append(each & np.uint64((1 << 48) - 1))
    return (np.concatenate(owners), np.concatenate(hashes)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def likely(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Whether signatures agree in 5/8 as many places as two sets with a Jaccard index of `least` do on average (half of forty). Of such sets one in 10^5 does not."""
    return (a == b).sum(axis=1) >= 0.625 * least * a.shape[1]


def likely_pairs(a: np.ndarray, b: np.ndarray, open_: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the signatures a[i] and b[j] that likely() lets through, where the matrix open_ holds."""
    i, j = np.nonzero(open_)
    if len(i) <= 1024:
        good = likely(a[i], b[j], least)
        return i[good], j[good]
    same = np.zeros(open_.shape, np.uint8)
    for k in range(a.shape[1]):
        same += a[:, k, None] == b[None, :, k]
    return np.nonzero(open_ & (same >= 0.625 * least * a.shape[1]))


def alike(a: list[str], b: list[str], least: float = LEAST) -> np.ndarray:
    """For each pair of lines whether their sets have a Jaccard index of `least` or more: exactly, for those that their signatures do not exclude."""
    a, b = [x.lower() for x in a], [x.lower() for x in b]
    names: dict[str, int] = {}
    ia, ib = (np.array([names.setdefault(x, len(names)) for x in side], np.int64) for side in (a, b))
    signed = signatures(list(names)) if names else np.zeros((0, BANDS * ROWS), np.uint32)
    out = likely(signed[ia], signed[ib], least)
    open_ = np.flatnonzero(out)
    for lo, hi in _chunks([a[k] + b[k] for k in open_]):
        now = open_[lo:hi]
        n = len(now)
        sides = [shingle_sets([side[k] for k in now]) for side in (a, b)]
        size = sum(np.bincount(owner, minlength=n) for owner, _ in sides)
        keys = np.concatenate([(owner.astype(np.uint64) << np.uint64(48)) | h for owner, h in sides])
        keys.sort()
        both = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(48)).astype(np.int64), minlength=n)
        out[now] = both >= size * (least / (1 + least)) - 1e-9  # both / (size - both) >= least
    return out


def common(h: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of `left` has in common with each of `right`, as a matrix, by products of incidence matrices. Set k is h[bounds[k] : bounds[k + 1]]."""

    def cells(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = bounds[side + 1] - bounds[side]
        place = np.arange(size.sum()) + np.repeat(bounds[side] - (np.cumsum(size) - size), size)
        return np.repeat(np.arange(len(side)), size), h[place]

    (la, ha), (lb, hb) = cells(left), cells(right)
    both = np.intersect1d(ha, hb)
    out, wide = np.zeros((len(left), len(right)), np.float32), max(64, (1 << 20) // max(len(left), len(right)))
    sides = []
    for owner, x in ((la, ha), (lb, hb)):
        at = np.searchsorted(both, x).clip(max=max(0, len(both) - 1))
        known = np.flatnonzero(both[at] == x) if len(both) else np.zeros(0, np.int64)
        order = known[np.argsort(at[known], kind="stable")]
        sides.append((owner[order], at[order]))
    for k in range(0, len(both), wide):
        m = []
        for n, (owner, at) in zip((len(left), len(right)), sides, strict=True):
            lo, hi = np.searchsorted(at, (k, k + wide))
            x = np.zeros((n, min(wide, len(both) - k)), np.float32)
            x[owner[lo:hi], at[lo:hi] - k] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


class Comparer:
    """Compares the lines of buckets that are in different components, each two of them once as far as it remembers."""

    def __init__(self, least: float = LEAST, most: int = SEEN, many: int = 256) -> None:
        self.least, self.most, self.many, self.done = least, most, many, set()

    def links(self, key: np.ndarray, side: np.ndarray, ids: np.ndarray, roots: np.ndarray, lines: list[str], same: np.ndarray) -> list[tuple[int, int]]:
        """Links between roots. Rows are sorted by key, the number of a bucket's pair of blocks; same: whether both are one block."""
        names, first, at = np.unique(ids, return_index=True, return_inverse=True)
        low = [lines[k].lower() for k in first]
        signed, few, out, sets = signatures(low), [], set(), None
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)], strict=True):
            left = np.arange(a, b) if same[a] else a + np.flatnonzero(side[a:b] == 0)
            right = left if same[a] else a + np.flatnonzero(side[a:b] == 1)
            open_ = roots[left][:, None] != roots[right][None, :]
            i, j = likely_pairs(signed[at[left]], signed[at[right]], np.triu(open_) if same[a] else open_, self.least)
            if len(i) <= self.many:
                i, j = left[i], right[j]
                few += zip(at[i].tolist(), at[j].tolist(), roots[i].tolist(), roots[j].tolist(), strict=True)
                continue
            if sets is None:  # many pairs of few lines: all at once
                owner, h = shingle_sets(low)
                sets = h, np.searchsorted(owner, np.arange(len(low) + 1))
            size = np.diff(sets[1])
            both = common(*sets, at[left], at[right])[i, j]
            i, j = left[i], right[j]
            good = both >= (size[at[i]] + size[at[j]]) * (self.least / (1 + self.least)) - 1e-9
            out.update(zip(roots[i[good]].tolist(), roots[j[good]].tolist(), strict=True))
        pairs = {(min(p, q), max(p, q)): (r, t) for p, q, r, t in few}
        known = lambda p, q: (int(names[p]) * 0x9E3779B97F4A7C15 ^ int(names[q])) & ((1 << 64) - 1)
        fresh = {p: r for p, r in pairs.items() if known(*p) not in self.done}
        if len(self.done) > self.most:
            self.done.clear()
        self.done.update(known(*p) for p in fresh)
        good = alike([low[p] for p, _ in fresh], [low[q] for _, q in fresh], self.least)
        out.update(r for r, g in zip(fresh.values(), good, strict=True) if g)
        return list(out)


def lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, id, line): the lines that take part, trimmed; pos counts all lines from 0."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    return each.select("doc", "pos", F.trim("line").alias("line")).where(F.col("line").rlike(r"\S")).select("doc", "pos", F.xxhash64("line").alias("id"), "line")


def shingle_rows(texts: DataFrame, *by: str) -> DataFrame:
    """(by, last, h0, h1, ...): hashes of the shingles of each line, STEP of them a row; the end of the last row repeats the last one. texts: by, line.

    Characters are four bytes wide, so the shingle from any of them on is a slice; `last` is where the last begins.
    """
    x = texts.select(*by, F.encode(F.lower("line"), "UTF-32").alias("wide")).select(*by, "wide", F.expr(f"greatest(octet_length(wide) - {4 * WIDTH - 1}, 1)").alias("last"))
    x = x.select(*by, "wide", "last", F.explode(F.expr(f"sequence(1, last, {4 * STEP})")).alias("at"))
    return x.select(*by, "last", *[F.xxhash64(F.expr(f"substring(wide, least(at + {4 * k}, last), {4 * WIDTH})")).alias(f"h{k}") for k in range(STEP)])


def signed(texts: DataFrame, size: int = BANDS * ROWS) -> DataFrame:
    """(id, single, signature): minima of `size` hash functions over the shingles of each line, and whether it has one place for a shingle only."""
    low = [F.col(f"h{k}").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"h{k}") for k in range(STEP)]
    hashed = lambda k, by: (F.col(f"h{k}") * F.lit(by)).bitwiseAND(F.lit(0x7FFFFFFF))
    least = [F.min(F.least(*[hashed(k, _MULTIPLIERS[i] >> 1 | 1) for k in range(STEP)])).alias(f"m{i}") for i in range(size)]
    x = shingle_rows(texts, "id").select("id", "last", *low).groupBy("id").agg(F.max("last").alias("last"), *least)
    return x.select("id", (F.col("last") == 1).alias("single"), F.array(*[F.col(f"m{i}").cast("int") for i in range(size)]).alias("signature"))


def line_keys(signs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, id): the keys of each line; of one of a single shingle the first."""
    keys = [F.xxhash64(F.lit(b), *[F.get("signature", F.lit(b * rows + r)) for r in range(rows)]) for b in range(bands)]
    return signs.select(F.explode(F.when(F.col("single"), F.array(keys[0])).otherwise(F.array(*keys))).alias("key"), "id")


def _near(least: float, size: int = BANDS * ROWS) -> Column:
    """Whether the signatures of a and b agree in as many places as likely() asks for."""
    return sum((F.get("signaturea", F.lit(i)) == F.get("signatureb", F.lit(i))).cast("int") for i in range(size)) >= 0.625 * least * size


def _paired(pairs: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b, ...) with this column of both lines, its name followed by a or b. Many pairs may share an a, so that side is salted."""
    side = lambda c: known.select(F.col("id").alias(c), F.col(column).alias(column + c))
    return salted_join(pairs.join(side("b"), "b"), side("a"), "a", counted(pairs, "a"))


def _set(line: str) -> Column:
    """The distinct hashes of the shingles of a line, those of shingle_rows(), in one row. The outer function holds the line's wide form, which else were made for each shingle."""
    hashes = f"transform(sequence(1, greatest(octet_length(w) - {4 * WIDTH - 1}, 1), 4), i -> xxhash64(substring(w, i, {4 * WIDTH})))"
    return F.get(F.expr(f"transform(array(encode(lower({line}), 'UTF-32')), w -> array_distinct({hashes}))"), F.lit(0))


def _enough(both: Column, na: Column, nb: Column, least: float) -> Column:
    return both >= (na + nb) * (least / (1 + least)) - 1e-9  # both / (na + nb - both) >= least


def _alike(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b, ...) of line ids whose sets are alike, exactly. The sets are made where the pair is, in its row: no set is shuffled, sorted or spilled."""
    x = _paired(pairs, known, "line").repartition("a", "b")
    sides = F.array(F.struct(_set("linea").alias("a"), _set("lineb").alias("b")))  # each set once
    return x.where(F.exists(sides, lambda s: _enough(F.size(F.array_intersect(s["a"], s["b"])), F.size(s["a"]), F.size(s["b"]), least))).select(*pairs.columns)


def marks(known: DataFrame, size: int = BANDS * ROWS) -> DataFrame:
    """(id, n, spare, s0, ..., w0, ...): what a pair of lines is judged by before its sets are made. known: id, line, signature.

    n is the size of the line's set, w its bitmap (each shingle sets one of 64 * WORDS bits), spare how many shingles found their bit set; two sets have
    no more in common than bits in common and the lesser spare. s holds seven bits of each minimum, seven to a number.
    """
    each = known.select("id", F.explode(_set("line")).alias("h"))
    bit = F.expr("shiftleft(1L, cast(shiftright(h, 16) & 63 as int))")
    words = [F.bit_or(F.when(F.col("h").bitwiseAND(WORDS - 1) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)]
    maps = each.groupBy("id").agg(F.count("*").cast("int").alias("n"), *words)
    maps = maps.select("id", "n", (F.col("n") - sum(F.bit_count(f"w{i}") for i in range(WORDS))).alias("spare"), *[f"w{i}" for i in range(WORDS)])
    packed = [F.expr(" | ".join(f"shiftleft(cast(coalesce(get(signature, {7 * j + r}), 0) & 127 as bigint), {8 * r})" for r in range(7))).alias(f"s{j}") for j in range(-(-size // 7))]
    return maps.join(known.select("id", *packed), "id")


def _possible(least: float, size: int = BANDS * ROWS) -> Column:
    """Whether rows of marks(), suffixed a and b, may be alike: their sizes, their signatures as likely() asks, and their bitmaps allow it. Only the signatures may err, once in 10^5."""
    c = lambda name, side: F.col(f"{name}{side}")
    sizes = F.least(c("n", "a"), c("n", "b")) >= F.greatest(c("n", "a"), c("n", "b")) * least - 1e-9
    other = sum(F.bit_count((c(f"s{j}", "a").bitwiseXOR(c(f"s{j}", "b")) + F.lit(0x7F7F7F7F7F7F7F)).bitwiseAND(F.lit(0x80808080808080))) for j in range(-(-size // 7)))
    both = sum(F.bit_count(c(f"w{i}", "a").bitwiseAND(c(f"w{i}", "b"))) for i in range(WORDS)) + F.least(c("spare", "a"), c("spare", "b"))
    return sizes & (other <= size - 0.625 * least * size) & _enough(both, c("n", "a"), c("n", "b"), least)


def _verified(pairs: DataFrame, known: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Those pairs (a, b) of line ids whose sets are alike, but for those that their signatures exclude."""
    some = scratch.keep(_paired(pairs, known, "signature").where(_near(least)).select("a", "b"))
    return _alike(some, known, least)


def _apart(open_: DataFrame, least: float, block: int = BLOCK, known: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) between roots, of lines of one bucket in different components. open_: key, id, root, and line if `known` is not given.

    A bucket of many lines is dealt out in blocks: each pair of blocks is a key of its own.
    """
    scratch = scratch or Scratch(open_.sparkSession)
    if known is None:
        texts = open_.groupBy("id").agg(F.first("line").alias("line"))
        known = scratch.keep(texts.join(signed(texts), "id"))
    told = scratch.keep(marks(known.join(open_.select("id").distinct(), "id", "left_semi")))
    names = told.columns[1:]
    n = open_.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    x = open_.select("key", "id", "root").join(n, "key").withColumn("b", F.pmod(F.col("id"), F.col("k")).cast("int"))
    x = x.join(told, "id")
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    x = x.select("key", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") <= F.col("o")).alias("left"), "id", "root", *names)
    at = ["key", "lo", "hi"]
    side = lambda rows, c: rows.select(*at, F.col("id").alias(c), F.col("root").alias("r" + c), *[F.col(m).alias(m + c) for m in names])
    left, right = side(x.where("left"), "a"), side(x.where("not left or lo = hi"), "b")
    met = left.join(right, at).where((F.col("ra") != F.col("rb")) & ((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b"))) & _possible(least))
    first = F.col("a") < F.col("b")
    pairs = scratch.keep(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(first, F.col("ra")).otherwise(F.col("rb")).alias("ra"), F.when(first, F.col("rb")).otherwise(F.col("ra")).alias("rb")).distinct())
    scratch.drop(told)
    return _alike(pairs, known, least).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def buckets(keys: DataFrame) -> DataFrame:
    """(key, low, id): the lines of each key that has several, and the smallest of them. keys: each line of a key once."""
    one = Window.partitionBy("key")
    return keys.select("key", F.min("id").over(one).alias("low"), "id", F.max("id").over(one).alias("high")).where("low <> high").select("key", "low", "id")


def line_links(docs: DataFrame, scratch: Scratch, bands: int = BANDS, rows: int = ROWS, least: float = LEAST) -> DataFrame:
    """(node, root): components of different lines that are alike, by the ids of lines."""
    once = lambda x: x.groupBy("id").agg(F.first("line").alias("line"))
    signs = scratch.keep(signed(once(lines(docs).select("id", "line")), bands * rows))
    members = scratch.keep(buckets(line_keys(signs, bands, rows)))
    stars = scratch.keep(members.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
    wanted = scratch.keep(members.select("id").distinct())
    some = once(sifted(lines(docs).select("id", "line"), "id", wanted).where("maybe")).join(wanted, "id", "left_semi")
    known = scratch.keep(some.join(sifted(signs, "id", wanted).where("maybe").select("id", "signature"), "id"))
    scratch.drop(signs)
    links = scratch.keep(_verified(stars, known, least, scratch))
    roots = scratch.keep(components(links, scratch=scratch))
    placed = members.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = scratch.keep(placed.join(mixed, "key", "left_semi").select("key", "id", "root"))
    more = scratch.keep(_apart(open_, least, known=known, scratch=scratch).distinct())
    merged = scratch.keep(components(more, scratch=scratch))  # of components, so a small graph
    above = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    out = scratch.keep(above.union(merged.join(roots, "node", "left_anti").select("node", "root")))
    scratch.drop(members, stars, wanted, known, links, roots, open_, more, merged)
    return out


def dropped(docs: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """(doc, gone): for each document that loses lines the array of (pos, id) of those."""
    roots = line_links(docs, scratch, least=least)
    known = scratch.keep(lines(docs).select("doc", "pos", "id"))
    again = known.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id")
    shared = scratch.keep(again.union(roots.select("node")))
    some = sifted(known, "id", shared).where("maybe").drop("maybe")  # other lines stand once and are like no other
    classed = scratch.keep(salted_join(some, roots.withColumnRenamed("node", "id"), "id", counted(some, "id"), how="left").select("doc", "pos", "id", F.coalesce("root", "id").alias("root")))
    keep = classed.groupBy("root").agg(F.min(F.struct("doc", "pos")).alias("keep"), F.max(F.struct("doc", "pos")).alias("last")).where(~F.col("keep").eqNullSafe(F.col("last")))
    gone = salted_join(classed, scratch.keep(keep.select("root", "keep")), "root", counted(classed, "root")).where(~F.struct("doc", "pos").eqNullSafe(F.col("keep")))
    out = scratch.keep(gone.groupBy("doc").agg(F.collect_set(F.struct("pos", "id")).alias("gone")))
    scratch.drop(roots, known, shared, classed)
    return out


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """All columns of docs in a struct row, and of its text: n_lines, lost (lines) and text (what stays)."""
    whole = F.col("whole")
    n_lines = F.coalesce(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines")
    gone = dropped(docs, Scratch(docs.sparkSession), least)
    x = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("whole"))
    x = sifted(x.withColumn("hash", F.xxhash64("id")), "hash", gone.select(F.xxhash64("doc").alias("hash"))).drop("hash")
    some = x.where("maybe")  # only texts that may lose lines are shuffled and taken apart
    some = some.join(gone, some["id"].eqNullSafe(gone["doc"]), "left").select("row", n_lines, "whole", "gone", F.split("whole", "\n").alias("every"))
    some = some.withColumn("goes", F.expr("transform(filter(gone, g -> xxhash64(trim(get(every, g.pos))) = g.id), g -> g.pos)"))  # of rows of one doc_id those that hold the line there
    some = some.withColumn("stays", F.expr("array_except(sequence(0, size(every) - 1), goes)"))
    lost = F.coalesce(F.size("every") - F.size("stays"), F.lit(0)).cast("long").alias("lost")
    some = some.select("row", "n_lines", F.when(F.col("stays").isNull(), 0).otherwise(lost).cast("long").alias("lost"), F.when(F.col("stays").isNull(), whole).otherwise(F.expr("array_join(transform(stays, k -> get(every, k)), '\n')")).alias("text"))
    return x.where("not maybe").select("row", n_lines, F.lit(0).cast("long").alias("lost"), whole.alias("text")).union(some)


def op6_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = deduplicated(table(spark, sf_dir, "documents"))
    return x.select(F.col("row.doc_id").alias("doc_id"), "n_lines", F.col("lost").alias("n_dropped"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand elsewhere first. A document that lost lines is gone if only white space is left: all of it is elsewhere."""
    x = deduplicated(docs).where((F.col("lost") == 0) | F.col("text").rlike(r"\S"))
    return x.select(*[F.col("text").alias(c) if c == "text" else F.length("text").cast(t).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c, t in docs.dtypes])
