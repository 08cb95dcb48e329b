"""Personal data (operator 5): base patterns and bootstrapped contextual extraction.

The spans of the base patterns are the seed entities. Their contexts (the word before, the two words before, the word after, and the words on both sides) are lexical
patterns, whatever the shape of the entity, so a context learnt from seeds finds values of other shapes. Spark scores the graph of patterns and instances in rounds, for each kind of
entity apart: an instance is as sure to be of a kind as the surest of its patterns, a pattern as sure as the share of instances that are, among all that it matches, with
smoothing; seeds count as sure, and a pattern needs support from different seeds. Patterns that end up above the threshold
extract identifiers that no base pattern knows, with the kind that their seeds have, and those that stand in sure contexts anywhere carry their confidence to
further patterns in the next round. So a word that stands before all kinds of things, like an article, is trusted for none.

An instance is any run of non-space characters with a digit or an @ in it, a row of numbers with a space between them
(030 1234567) or an address spelt with (at), stripped of punctuation at its ends, that no base
span overlaps. Only such places with their contexts leave the scan, values as 64-bit hashes; texts are not shuffled. Joins are salted where a pattern or a value is in many rows.

Defined results: a null or empty text has no span; repeated rows come back as often as they occur; an empty table gives an
empty result; only doc_id and text are read. A place that several kinds claim has the kind of the greatest confidence, of equal ones the first in KINDS.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded, counted, salted_join, table, with_types

KINDS = ("email", "ip", "card", "phone")

# A run of characters that cannot begin a match cannot begin one further on either, so each run is tried once: the
# look-behind keeps long runs linear. After a match the search goes on inside a run, hence the plain form for that place.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
EMAIL_AT, EMAIL = re.compile(_EMAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL)
IP = re.compile(r"(?<![0-9])" + _IP)
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
NUMBER = re.compile(r"[0-9().+/-]+")
AT, ADDRESS = re.compile(r"[\[({]at[\])}]", re.I), re.compile(r"(?<!\S)\S+? ?[\[({]at[\])}] ?\S+(?: ?[\[({]dot[\])}] ?\S+)*", re.I)
WORD, LETTER = re.compile(r"\S+"), re.compile(r"\w")
EDGE = "\"'`()[]{}<>.,;:!?#$%&*|=~^/\\"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := (EMAIL_AT.match(text, at) if at else None) or EMAIL.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order of start and then of KINDS."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        out += [(a, b, "email") for a, b in _emails(text)]
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdecimal() and c.isascii() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Contexts:
    """Words around places of a text."""

    def __init__(self, text: str) -> None:
        self.text, self.words = text, [m.span() for m in WORD.finditer(text)]
        self.starts = [a for a, _ in self.words]

    def _word(self, a: int, b: int) -> str:
        return self.text[a:b].lower().strip(EDGE) or self.text[a:b]

    def _before(self, a: int) -> tuple[str, int]:
        """The last word that ends before a place, with where it begins; marks without a letter or digit are passed over, three at most."""
        k = bisect_right(self.starts, a - 1) - 1
        for k in range(k, max(-1, k - 4), -1):
            lo, hi = self.words[k][0], min(a, self.words[k][1])
            if LETTER.search(self.text, lo, hi):
                return self._word(lo, hi), lo
        return "^", 0

    def of(self, a: int, b: int) -> list[str]:
        left, at = self._before(a)
        second = self._before(at)[0] if at else "^"
        k = bisect_right(self.starts, b) - 1
        right = self._word(b, self.words[k][1]) if k >= 0 and b < self.words[k][1] else "$"
        if (right == "$" or not LETTER.search(right)) and k + 1 < len(self.words):
            right = self._word(*self.words[k + 1])
        return [f"L:{left}", f"R:{right}", f"LL:{second} {left}", f"LR:{left} {right}"]


def _disjoint(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b, *_ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _free(found: list[tuple[int, int]], taken: list[list[int]]) -> list[tuple[int, int]]:
    """Those spans, in order, that overlap none of the taken ones."""
    out, k = [], 0
    for a, b in found:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            out.append((a, b))
    return out


def _stripped(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    values = [(a, text[a:b], text[a:b].strip(EDGE)) for a, b in spans]
    return [(a + whole.index(v), a + whole.index(v) + len(v)) for a, whole, v in values if v]


def candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of what may be an identifier beside the base spans."""
    taken = _disjoint(spans)
    spelt = _free(_stripped(text, [m.span() for m in ADDRESS.finditer(text)]), taken) if AT.search(text) else []
    single = [m.span() for m in TOKEN.finditer(text)]
    rows: list[tuple[int, int]] = []
    number = False
    for a, b in _free(single, _disjoint([*taken, *spelt])):
        was, number = number, bool(NUMBER.fullmatch(text, a, b))
        if was and number and text[rows[-1][1] : a] == " " and text[a - 2] != ".":
            rows[-1] = rows[-1][0], b
        else:
            rows.append((a, b))
    return sorted(spelt + _stripped(text, rows))


def mentions(text: str) -> tuple[list[tuple[int, int, str]], list[dict]]:
    """The base spans, and all mentions with their contexts: seeds, which have a kind, and candidates."""
    spans = base_spans(text)
    found: list[tuple[int, int, str | None]] = list(spans)
    if "@" in text or DIGIT.search(text) or AT.search(text):
        found += [(a, b, None) for a, b in candidates(text, spans)]
    around = Contexts(text) if found else None
    name = lambda v: xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63)
    return spans, [{"start": a, "end": b, "value": name(text[a:b]), "kind": kind, "contexts": around.of(a, b)} for a, b, kind in found]


MENTION = "struct<start: long, end: long, value: long, kind: string, contexts: array<string>>"


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base array<struct<start, end, kind>>, found array of mentions) for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [mentions(t or "") for t in batch["text"]]
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"), "base": [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s, _ in rows], "found": [m for _, m in rows]})

    x = with_types(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    return bounded(x).mapInPandas(run, f"row long, doc_id long, base array<struct<start: long, end: long, kind: string>>, found array<{MENTION}>")


def patterns(seen: DataFrame, scratch: Scratch, rounds: int = 3, least: float = 0.5, support: int = 3) -> DataFrame:
    """(pattern, kind, confidence) above the threshold, by rounds over the graph of patterns and instances.

    seen: value, kind (of seeds), pattern. For a kind, confidence = sum of its instances' scores / (number of the pattern's instances + 1), over different instances; patterns
    with fewer than `support` sure instances are not trusted. Every round is an aggregate by instance and one by pattern.
    """
    graph = scratch.keep(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    sizes = scratch.keep(counted(graph, "pattern"))
    degrees = scratch.keep(counted(graph, "value"))
    seeds = scratch.keep(graph.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score")))

    def trusted(scores: DataFrame) -> DataFrame:
        by = salted_join(graph.select("pattern", "value"), scores, "value", degrees).groupBy("pattern", "kind").agg(F.sum("score").alias("all"), F.sum((F.col("score") >= least).cast("long")).alias("sure"))
        by = by.join(sizes, "pattern").withColumn("confidence", F.col("all") / (F.col("n") + 1))
        return by.where((F.col("confidence") >= least) & (F.col("sure") >= support)).select("pattern", "kind", "confidence")

    scores = seeds
    for _ in range(rounds):
        by = scratch.keep(trusted(scores))
        reached = salted_join(graph.where("kind is null").select("pattern", "value"), by, "pattern", sizes).groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        scores = scratch.keep(seeds.unionByName(reached))
    return scratch.keep(trusted(scores))


def found_spans(docs: DataFrame, rounds: int = 3, least: float = 0.5, support: int = 3) -> DataFrame:
    """(doc_id, base, more): for each row the base spans and those that trusted patterns add (start, end, confidence, kind)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(scanned(docs))
    each = scratch.keep(rows.where(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.start", "m.end", "m.value", "m.kind", F.explode("m.contexts").alias("pattern")))
    trusted = patterns(each.select("value", "kind", "pattern"), scratch, rounds, least, support)
    open_ = each.where("kind is null").select("row", "start", "end", "pattern")
    order = F.struct(F.col("confidence"), *[(F.col("kind") == k).alias(k) for k in KINDS], "kind")
    more = salted_join(open_, trusted, "pattern", counted(open_, "pattern")).groupBy("row", "start", "end").agg(F.max(order).alias("m"))
    more = more.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "m.confidence", "m.kind"))).alias("more"))
    return rows.select("row", "doc_id", "base").join(more, "row", "left").drop("row")


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that the method adds have the kind context_email, context_ip, context_card or context_phone."""
    x = found_spans(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    kinds = (*KINDS, *[f"context_{k}" for k in KINDS])
    place = F.create_map(*[y for k, v in enumerate(kinds) for y in (F.lit(v), F.lit(k))])
    span = lambda s, kind: F.struct(s["start"].alias("start"), place[kind].alias("k"), s["end"].alias("end"), kind.alias("kind"))
    added = F.transform("more", lambda s: span(s, F.concat(F.lit("context_"), s["kind"])))
    full = F.concat(F.transform("base", lambda s: span(s, s["kind"])), F.coalesce(added, F.expr("cast(array() as array<struct<start: long, k: int, end: long, kind: string>>)")))
    return x.select(
        "doc_id",
        *[number(k) for k in KINDS],
        F.sha2(F.array_join(F.transform("base", text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(full), text), ",").alias("spans"),
    )


def base_digest(text: str | None) -> str:
    """What the query's base_sha256 is of a text."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base_spans(text or "")).encode()).hexdigest()
