"""Media columns (operator 1): signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a blob. At each hit the validator of that
format walks the structure and confirms it, which yields the exact length; so a wrong declared type is corrected and media
that lie inside other bytes are carved out. Validators read lengths that the file states and never scan without a bound
other than the blob's own end.

Defined results: a null blob is treated as empty; an empty blob has no segment and type application/octet-stream; equal
blobs give equal results; rows are independent, so repeated rows, empty tables and further columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded, table, with_types

UNKNOWN = "application/octet-stream"

# Magic bytes, where they stand in a file of the format, and the media type.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS\x00", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
    (b"BM", 0, "image/bmp"),
)


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[at + 8 : at + 12])
    if kind is None or end > len(b):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        n = struct.unpack_from("<I", b, p + 4)[0]
        seen.add(b[p : p + 4])
        p += 8 + n + (n & 1)
    if p < end or p > end + 1 or kind == "audio/wav" and not {b"fmt ", b"data"} <= seen:
        return None
    return kind, end - at


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, tag = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first and tag != b"IHDR" or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if tag == b"IEND":
            return "image/png", p - at
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if mark in (0xD8, 0xD9) or n < 2:
            return None
        p += 2 + n
        if mark == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return "image/jpeg", p + 2 - at
                if b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7:
                    break  # the next scan's tables
                p += 2
            if p < 0:
                return None
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _pdf(b: bytes, at: int) -> tuple[str, int] | None:
    """Up to the last end mark of the file: each update of it appends a startxref and an end mark of its own."""
    other, end, p = b.find(b"%PDF-", at + 5), None, at
    while (mark := b.find(b"%%EOF", p, other if other >= 0 else len(b))) >= 0 and b.find(b"startxref", p, mark) >= 0:
        end = p = mark + 5
    return ("application/pdf", end - at) if end else None


def _zip(b: bytes, at: int) -> tuple[str, int] | None:
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        n, start, note = struct.unpack_from("<IIH", b, end + 12)
        if at + start + n == end and end + 22 + note <= len(b):
            return "application/zip", end + 22 + note - at
        end = b.find(b"PK\x05\x06", end + 4)
    return None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    p = at + 4
    while p + 4 <= len(b):
        head, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if p == at + 4 and (head & 0x7F or n != 34):
            return None
        p += 4 + n
        if head & 0x80:
            return ("audio/flac", len(b) - at) if p <= len(b) else None  # frames state no length: the rest is taken
    return None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    p = at
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b) and p + 27 + b[p + 26] <= len(b):
        last, size = b[p + 5] & 4, 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
        if p + size > len(b):
            return None
        p += size
        if last:
            return "audio/ogg", p - at
    return None


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    p, seen = at, set()
    while p + 8 <= len(b):
        n, tag = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if n < 8 or p + n > len(b) or not tag.isalnum():
            break
        seen.add(tag)
        p += n
    return ("video/mp4", p - at) if {b"ftyp", b"moov"} <= seen else None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 30 > len(b):
        return None
    n, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    good = zero == 0 and head in (40, 108, 124) and 14 + head <= start <= n <= len(b) - at and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", n) if good else None


VALIDATORS = {"riff": _riff, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "application/pdf": _pdf, "application/zip": _zip, "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4, "image/bmp": _bmp}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, shift, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), shift, kind))
    found.make_automaton()
    return found


def sniff(blob: bytes, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Confirmed segments (start, length, type), outermost first, none inside another that begins earlier."""
    out, end = [], 0
    dead: set[tuple[str, int]] = set()  # whole-rest searches that failed once need no second try further on
    for last, (n, shift, kind) in machine.iter(blob.decode("latin-1")):
        at = last + 1 - n - shift
        if at < end or at < 0 or (kind, 0) in dead:
            continue
        if got := VALIDATORS[kind](blob, at):
            out.append((at, got[1], got[0]))
            end = at + got[1]
        elif kind in ("application/pdf", "application/zip") and blob.find({"application/pdf": b"%%EOF", "application/zip": b"PK\x05\x06"}[kind], at) < 0:
            dead.add((kind, 0))
    return out


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as the 8-bit samples of a one-channel PCM file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + (len(payload) & 1), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) & 1)


def wav_samples(media: bytes) -> bytes:
    p = 12
    while p + 8 <= len(media):
        n = struct.unpack_from("<I", media, p + 4)[0]
        if media[p : p + 4] == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def sniffed(df: DataFrame, blob: str = "blob", declared: str | None = None) -> DataFrame:
    """Adds media_type, corrected (whether the declared type was wrong) and segments, an array of (start, length, type, bytes)."""

    @F.pandas_udf("media_type string, segments array<struct<start: long, length: long, type: string, bytes: binary>>")
    def find(blobs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for batch in blobs:
            rows = []
            for b in batch:
                got = sniff(b := bytes(b or b""), machine)
                rows.append((got[0][2] if got and got[0][0] == 0 else UNKNOWN, [{"start": s, "length": n, "type": t, "bytes": b[s : s + n]} for s, n, t in got]))
            yield pd.DataFrame(rows, columns=["media_type", "segments"])

    said = F.lit(None).cast("string") if declared is None else F.col(declared).cast("string")
    return bounded(df).withColumn("_found", find(F.col(blob))).withColumns({"media_type": F.col("_found.media_type"), "segments": F.col("_found.segments")}).withColumn("corrected", ~F.col("media_type").eqNullSafe(said)).drop("_found")


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_segments long"


def stored_texts(docs: DataFrame, declared: str = UNKNOWN) -> DataFrame:
    """Each text's bytes, padded, stored as sound, found again by its signature and read back. The stored form lives for one row only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
                media = wav(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
                found = sniff(media, machine)
                start, length, kind = found[0]
                payload = wav_samples(media[start : start + length])
                inside = sniff(payload, machine) if any(m[0] in payload for m in MAGIC) else []
                counts: dict[str, int] = {}
                for _, _, t in inside:
                    counts[t] = counts.get(t, 0) + 1
                feature = json.dumps({"type": kind, "samples": len(payload), "embedded": counts}, sort_keys=True)
                rows.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, kind != declared, 1 + len(inside)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return bounded(with_types(docs, doc_id="long", text="string")).mapInPandas(run, RESULT)


def op1_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents"))
