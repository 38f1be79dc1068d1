"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over RUN bytes ends a chunk wherever its low bits are all ones;
so boundaries depend on nearby bytes only and survive insertions. The block size
is the least power of two that gives at most LETTERS chunks. A fingerprint is
"exponent:chunks:chunks at twice the block size", with one letter (6 bits of a
CRC-32) for each chunk. Two fingerprints are compared where their block sizes
meet, by edit distance between the letters; at sizes that do not meet the
likeness is 0.

Each document is also compared with an edited version (its last third replaced
by the beginning of the next document, in descending doc_id) and with the next
document. One shuffle deals the texts by ranges of doc_id; the first and last
document of each partition are boundary records, matched in a second small step.

Defined cases: a null text is empty; empty texts are alike (1.0); rows with the
same doc_id follow each other by text, a null doc_id comes last; a single row is
its own next document; an empty table gives no row; other columns are ignored."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import documents, saved, slices, workers

RUN = 7
LETTERS = 64
LEAST_EXPONENT = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODE = np.full(128, 0, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(64)


def _triggers(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte, of the RUN bytes that end there."""
    value = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    total = value.copy()
    for _ in range(RUN - 1):
        total[1:] = total[:-1] * np.uint32(2246822519)
        total += value
    total ^= total >> np.uint32(15)
    total *= np.uint32(3266489917)
    return total ^ (total >> np.uint32(13))


def fingerprints(texts: list[bytes]) -> list[str]:
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    joined = b"".join(texts)
    hashes = _triggers(np.frombuffer(joined, np.uint8)) if joined else np.zeros(0, np.uint32)
    low = np.uint32((1 << LEAST_EXPONENT) - 1)
    place = np.flatnonzero((hashes & low) == low)
    ones = hashes[place]
    level = np.log2((~ones & (ones + np.uint32(1))).astype(np.float64), where=ones != np.uint32(0xFFFFFFFF), out=np.full(len(ones), 32.0)).astype(np.int64)
    span = np.searchsorted(place, start + RUN - 1), np.searchsorted(place, start + size - 1)  # neither beyond the text's start nor at its last byte
    out = []
    for text, s, a, b in zip(texts, start.tolist(), *(x.tolist() for x in span), strict=True):
        at, lv = place[a:b] - s + 1, level[a:b]
        k = LEAST_EXPONENT
        while len(at) >= LETTERS:
            k += 1
            at, lv = at[lv >= k], lv[lv >= k]
        out.append(f"{k}:{_letters(text, at)}:{_letters(text, at[lv > k])}")
    return out


def _letters(text: bytes, ends: np.ndarray) -> str:
    if not text:
        return ""
    cuts = [0, *ends.tolist(), len(text)]
    view = memoryview(text)
    return "".join([ALPHABET[zlib.crc32(view[a:b]) & 63] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    flat = _CODE[np.frombuffer("".join(words).encode(), np.uint8)]
    out = np.zeros((len(words), LETTERS), np.int64)
    out[np.arange(LETTERS) < size[:, None]] = flat
    return out, size


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distance of each pair, all pairs at once: one bit of a 64-bit
    number for each letter of `left` (at most 64), one step for each letter of `right`."""
    (p, m), (t, n) = _codes(left), _codes(right)
    rows, one = np.arange(len(left)), np.uint64(1)
    has = np.zeros((len(left), 64), np.uint64)
    for i in range(int(m.max(initial=0))):
        some = np.flatnonzero(m > i)
        has[some, p[some, i]] |= one << np.uint64(i)
    plus, minus = np.full(len(left), ~np.uint64(0)), np.zeros(len(left), np.uint64)
    top, score = (np.maximum(m, 1) - 1).astype(np.uint64), m.copy()
    for j in range(int(n.max(initial=0))):
        eq = has[rows, t[:, j]]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus), plus & xh
        step = ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
        score += np.where(j < n, step, 0)
        up, down = (up << one) | one, down << one
        plus, minus = down | ~(xv | up), up & xv
    return np.where(m == 0, n, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out, which, x, y = np.zeros(len(left)), [], [], []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a == b:
            out[i] = 1
            continue
        (ka, a1, a2), (kb, b1, b2) = a.split(":"), b.split(":")
        apart = int(ka) - int(kb)
        for p, q in {0: [(a1, b1), (a2, b2)], 1: [(a1, b2)], -1: [(a2, b1)]}.get(apart, []):
            which.append(i)
            x.append(p)
            y.append(q)
    if which:
        longest = np.array([max(len(p), len(q), 1) for p, q in zip(x, y, strict=True)])
        np.maximum.at(out, which, 1 - edit_distances(x, y) / longest)
    return out


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_WORKED = f"kind int, part int, {_OUT}, text string"
_NAMES = [x.split()[0] for x in _WORKED.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _WORKED.split(", ")])


def _compared(part: int, ids: list, texts: list[str], prints: list[str], after: list[str], after_prints: list[str]) -> pa.RecordBatch:
    new = [edited(t, a).encode() for t, a in zip(texts, after, strict=True)]
    new_prints = fingerprints(new)
    n = len(ids)
    columns = [[0] * n, [part] * n, ids, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in new], prints, new_prints, likeness(prints, new_prints), likeness(prints, after_prints), [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _boundary(kind: int, part: int, doc_id, text: str, print_: str) -> pa.RecordBatch:
    row = {"kind": kind, "part": part, "doc_id": doc_id, "fingerprint": print_, "text": text}
    return pa.RecordBatch.from_pylist([{k: row.get(k) for k in _NAMES}], _SCHEMA)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: kind 0 is a finished document, 1 the first of the partition, 2 the last, whose next is elsewhere."""
    part, last = TaskContext.get().partitionId(), None
    for batch in slices(batches, "text", 2 << 20):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        prints = fingerprints([t.encode() for t in texts])
        if last is None:
            yield _boundary(1, part, ids[0], texts[0], prints[0])
        else:
            ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
        last = ids[-1], texts[-1], prints[-1]
        if len(ids) > 1:
            yield _compared(part, ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
    if last is not None:
        yield _boundary(2, part, *last)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda name: batch.column(name).to_pylist()  # noqa: B023, E731
        if batch.num_rows:
            yield _compared(0, get("doc_id"), get("text"), get("fingerprint"), get("next_text"), get("next_fingerprint")).select(_NAMES[2:-1])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row for each document, with the columns of _OUT."""
    workers(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    worked = saved(dealt.mapInArrow(_walk, _WORKED), "fingerprints")
    # one number for each partition that has rows
    parts = sorted(r.part for r in worked.where("kind = 1").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    heads = worked.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    tails = worked.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(after, "part").join(heads, "next")
    names = _NAMES[2:-1]
    return worked.where("kind = 0").select(*names).union(tails.mapInArrow(_close, _OUT).select(*names))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(documents(spark, sf_dir))
