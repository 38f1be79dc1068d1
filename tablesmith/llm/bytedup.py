"""Removal of repeated byte strings, found by run-length indexes.

A byte of a document goes if a string of WINDOW bytes over it also starts in a document
with a smaller doc_id. Every string has an anchor, the least hash of the GRAM-byte grams
inside it; neighbouring strings mostly share theirs, and equal strings have equal
anchors. So whatever the corpus has of one string meets under one anchor:

1. Whole copies (equal SHA-256) need no search: all their bytes go, if they have WINDOW.
2. The other documents' anchors are dealt by hash in packed batches. Those of one
   document alone go. An anchor that stands in several documents of a batch is known to
   be shared at once, and only one row of it is dealt, so a hot anchor counts once a batch.
3. The passages (up to MOST_STRINGS strings in a row with one shared anchor) become rows. Equal passages
   are one, with its first and last document, before they are gathered.
4. Passages are gathered by anchor, up to INDEX_BYTES at a time, in a run-compressed
   Burrows-Wheeler index with sampled run ends (`runindex`). Their matching statistics
   are streamed through it; matches of WINDOW bytes or more give the least document of
   each string. An anchor with more than MOST_BYTES of different passages is cut into its
   strings instead, and those are grouped by their bytes, so no task holds it all.
5. Strings with an earlier document are joined back to the passages' documents, merged to
   spans, and cut out.

Defined cases: a null or empty text has no bytes; fewer bytes than a string keep all;
strings that repeat within one document, or in rows of one doc_id, stay; a null doc_id
keeps its bytes and removes none; repeated rows get the same result each; a cut may
split a character, as bytes are what counts; a text of any length is handled block by
block, but is in memory whole; an empty table gives no row; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import documents, least, member_filter, raw, release_shuffles, rolling, saved, slices, text_key, without, workers
from tablesmith.llm.runindex import END, WINDOW, RunIndex

GRAM = 20
#: Strings of one passage: periodic text has one anchor for as long as it goes on.
MOST_STRINGS = 64
#: Bytes of a text that are hashed at once: arrays of so many numbers stay in a core's cache and below the size from
#: which each new one is mapped from the system page by page.
BLOCK = 1 << 15
#: Anchors of one packed group, on average.
GROUP_ANCHORS = 1 << 18
#: Groups below 0, so many that batches hardly share one: what is in them only passes through.
KNOWN_GROUPS = 1 << 30
#: About one anchor for so many bytes of text.
SPACING = 14
#: Bytes of different passages in one index, on average, and for one anchor at most.
INDEX_BYTES = 1 << 18
MOST_BYTES = 1 << 21


# -- anchors -------------------------------------------------------------------


def _blocks(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts, some BLOCK bytes together: document and first byte of each place, and the bytes. A piece reaches
    WINDOW - 1 bytes into the next, so that each string is in one piece."""
    held, size = [], 0
    for doc, text in enumerate(texts):
        for begin in range(0, len(text) - WINDOW + 1, BLOCK):
            piece = text[begin : begin + BLOCK + WINDOW - 1]
            held.append((doc, begin, piece))
            size += len(piece)
            if size >= BLOCK:
                yield _together(held)
                held, size = [], 0
    if held:
        yield _together(held)


def _together(pieces: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = [len(p) + 1 for *_, p in pieces]
    close = np.array([END], np.uint8)
    data = np.concatenate([x for *_, p in pieces for x in (p, close)])
    doc = np.repeat([d for d, *_ in pieces], size)
    place = np.concatenate([np.arange(b, b + n) for (_, b, _), n in zip(pieces, size, strict=True)])
    return doc, place, data


def _letters(data: np.ndarray) -> np.ndarray:
    return data.astype(np.uint64) + np.uint64(1)


def _stretches(data: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings in a row with one anchor: the first one's place in data, their number, the anchor. hashes: of all grams."""
    anchors = least(hashes, WINDOW - GRAM + 1)
    closed = np.cumsum(data == END)
    whole = np.flatnonzero(closed[WINDOW - 1 :] == np.concatenate([[0], closed[:-WINDOW]]))
    mine = anchors[whole]
    new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (whole[1:] != whole[:-1] + 1)]) if len(whole) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    within = np.arange(len(whole)) - np.repeat(begin, np.diff(begin, append=len(whole)))
    begin = np.flatnonzero(within % MOST_STRINGS == 0)
    return whole[begin], np.diff(begin, append=len(whole)), mine[begin]


def _planes(anchors: np.ndarray) -> bytes:
    """The anchors' lowest bytes, then their next ones, and so on: of anchors in order, one group's, the upper bytes hardly
    change, so that a shuffle's compression takes them away."""
    return anchors.view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _anchors(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors and the row keys that have them, packed by group. Those that several rows of the batch have are in a group
    below 0; their own group has such an anchor once, with row key 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys = batch.column("row_key").to_numpy()
            found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, _, data in _blocks(raw(batch.column("text"))):
                at, _, anchor = _stretches(data, rolling(_letters(data), GRAM))
                found.append(anchor)
                owner.append(doc[at])
            found, owner = np.concatenate(found), np.concatenate(owner)
            order = np.argsort(found)
            found, owner = found[order], owner[order]
            alike = found[1:] == found[:-1]
            tied = np.flatnonzero(np.concatenate([[False], alike]) | np.concatenate([alike, [False]])) if len(found) else order
            owner[tied] = owner[tied][np.lexsort((owner[tied], found[tied]))]
            once = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])[: len(found)]
            found, owner = found[once], owner[once]
            first = np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]
            times = np.diff(np.flatnonzero(first), append=len(found))
            several = np.repeat(times > 1, times)
            dealt = found[first]
            marked = np.where(times > 1, 0, keys[owner[first]])
            # anchors in order are in order of their group too
            group = ((dealt >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
            ends = [*begin[1:], len(group)]
            known = -1 - int(keys[0]) % KNOWN_GROUPS
            rows = [(known, found[several], keys[owner[several]])] + [(int(group[a]), dealt[a:b], marked[a:b]) for a, b in zip(begin, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, *_ in rows], pa.int32()), pa.array([_planes(x) for _, x, _ in rows], pa.binary()), pa.array([x.tobytes() for *_, x in rows], pa.binary())], ["group", "anchors", "keys"])

    return run


def _shared(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    """Of a group: the anchors of more than one row, with their row keys."""
    anchors = np.concatenate([_of_planes(x) for x in table.column("anchors").to_pylist()])
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64)
    if key[0].as_py() >= 0:
        order = np.argsort(anchors)
        anchors, keys = anchors[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])[: len(anchors)])
        times = np.diff(first, append=len(anchors))
        marked = np.add.reduceat(keys == 0, first) > 0 if len(first) else np.zeros(0, bool)
        kept = np.repeat((times > 1) | marked, times) & (keys != 0)
        anchors, keys = anchors[kept], keys[kept]
    return pa.table({"row_key": keys, "anchor": anchors.view(np.int64)})


# -- passages ------------------------------------------------------------------


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a document whose anchor is listed."""
    for batch in slices(batches, "text"):
        lists = batch.column("listed")
        listed, bounds = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        listed = [np.sort(listed[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for doc, place, data in _blocks(raw(batch.column("text"))):
            hashes = rolling(_letters(data), GRAM)
            at, number, anchor = _stretches(data, hashes)
            owner = doc[at]
            ends = np.searchsorted(owner, np.arange(owner[0], owner[-1] + 2)) if len(owner) else []
            hit = [np.zeros(0, np.int64)]
            for d, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True), owner[0] if len(owner) else 0):
                mine = listed[d]
                if len(mine):
                    hit.append(a + np.flatnonzero(mine[np.minimum(np.searchsorted(mine, anchor[a:b]), len(mine) - 1)] == anchor[a:b]))
            hit = np.concatenate(hit)
            size = number[hit] + WINDOW - 1
            flat = np.repeat(at[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            content = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[flat]))])
            row = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(place[at[hit]]), pa.array(anchor[hit].view(np.int64)), content], ["doc_id", "text_key", "begin", "anchor", "content"])


def _sides(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which passages can be a source, as one with their anchor has a later document, and which can lose bytes, as one
    has an earlier document."""
    order = np.argsort(anchor)
    begin = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])[: len(order)])
    latest, earliest = np.empty_like(last), np.empty_like(first)
    if len(order):
        size = np.diff(begin, append=len(order))
        latest[order] = np.repeat(np.maximum.reduceat(last[order], begin), size)
        earliest[order] = np.repeat(np.minimum.reduceat(first[order], begin), size)
    return first < latest, last > earliest


def _matched(table: pa.Table) -> pa.Table:
    """Runs of strings with one least document, earlier than the passage's last, of each passage of an index. Only
    passages that can be a source are in the index, and only those that can lose bytes are streamed through it."""
    anchor, first, last = (table.column(c).to_numpy() for c in ("anchor", "first", "last"))
    sources, losers = (np.flatnonzero(x) for x in _sides(anchor, first, last))
    index = RunIndex(table.column("content").take(pa.array(sources)).to_pylist(), first[sources])
    table, last = table.take(pa.array(losers)), last[losers]
    contents = table.column("content").to_pylist()
    place, source = index.least_document(contents)
    size = np.array([len(x) for x in contents], np.int64)
    begin = np.cumsum(size) - size
    passage = np.searchsorted(begin, place, side="right") - 1
    some = source < last[passage]
    place, source, passage = place[some], source[some], passage[some]
    new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (passage[1:] != passage[:-1]) | (source[1:] != source[:-1])])[: len(place)]
    at = np.flatnonzero(new)
    p = passage[at]
    return pa.table({"anchor": table.column("anchor").take(pa.array(p)), "content_key": table.column("content_key").take(pa.array(p)), "offset": (place[at] - begin[p]).astype(np.int32), "n": np.diff(at, append=len(place)).astype(np.int32), "source": source[at]})


def _content_key() -> Column:
    """With the anchor 128 bits, by which matches come back to a passage."""
    return F.xxhash64("content").alias("content_key")


_MATCH = "anchor long, content_key long, offset int, n int, source long"


def _by_strings(passages: DataFrame) -> DataFrame:
    """The same for anchors with very many different passages: their strings, grouped by bytes."""
    strings = passages.select("anchor", _content_key(), "first", "last", F.explode(F.sequence(F.lit(0), F.length("content") - WINDOW)).alias("offset"), "content")
    strings = strings.withColumn("string", F.substring("content", F.col("offset") + 1, F.lit(WINDOW))).drop("content")
    sources = strings.groupBy("string").agg(F.min("first").alias("source"))
    return strings.join(sources, "string").where("source < last").select("anchor", "content_key", "offset", F.lit(1).alias("n"), "source")


def _matches(passages: DataFrame) -> DataFrame:
    """passages (anchor, content, first, last), different ones of an anchor: _MATCH."""
    passages = passages.withColumn("size", F.length("content"))
    large = saved(passages.groupBy("anchor").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > MOST_BYTES).select("anchor"), "large")
    whole = passages.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = max(1, -(-whole // INDEX_BYTES))
    indexed = lambda df: df.select(F.pmod("anchor", F.lit(groups)).alias("group"), "anchor", "content", "first", "last", _content_key()).groupBy("group").applyInArrow(_matched, _MATCH)
    if large.isEmpty():
        return indexed(passages)
    return indexed(passages.join(large, "anchor", "left_anti")).union(_by_strings(passages.join(large, "anchor")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        removed, spans, shas = [], [], []
        for text, found in zip(raw(batch.column("text")), batch.column("found"), strict=True):
            change = np.zeros(len(text) + 1, np.int32)
            begin, n = (found.values.field(c).to_numpy().astype(np.int64) for c in ("begin", "n"))
            np.add.at(change, begin, 1)
            np.add.at(change, begin + n + WINDOW - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"begin": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(shas, pa.string())], ["doc_id", "text_key", "n_removed", "removed", "kept_sha256"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, removed (ranges of bytes, end exclusive), kept_sha256."""
    workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("text_key", text_key())
    measured = saved(keyed.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "measured")
    able = measured.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= WINDOW))
    copied = saved(able.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "copied")
    copies = saved(able.join(copied, "sha").where("doc_id > first").select("doc_id", "text_key").distinct(), "copies")

    row_key = F.xxhash64("doc_id", "text_key").bitwiseOR(F.lit(1))  # never 0
    kept = without(rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)), copies)
    kept = kept.withColumn("text_key", text_key()).withColumn("row_key", row_key)
    groups = max(1, (able.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]) // (SPACING * GROUP_ANCHORS))
    packed = kept.select("row_key", "text").mapInArrow(_anchors(groups), "group int, anchors binary, keys binary")
    shared = packed.groupBy("group").applyInArrow(_shared, "row_key long, anchor long")
    listed = saved(shared.groupBy("row_key").agg(F.collect_set("anchor").alias("listed")), "shared")
    release_shuffles(docs.sparkSession)

    found = kept.where(member_filter(listed, "row_key")).join(listed, "row_key").select("doc_id", "text_key", "text", "listed")
    found = found.mapInArrow(_passages, "doc_id long, text_key long, begin long, anchor long, content binary")
    found = saved(found, "passages")
    release_shuffles(docs.sparkSession)
    different = saved(found.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "different")
    release_shuffles(docs.sparkSession)
    matches = saved(_matches(different), "matches")
    release_shuffles(docs.sparkSession)
    spans = found.select("doc_id", "text_key", "begin", "anchor", _content_key()).join(matches, ["anchor", "content_key"]).where("source < doc_id")
    spans = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct((F.col("begin") + F.col("offset")).alias("begin"), "n")).alias("found"))
    spans = saved(spans, "spans")
    release_shuffles(docs.sparkSession)

    hit = keyed.where(member_filter(spans, "text_key")).join(spans, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    cut = hit.select("doc_id", "text_key", "text", "found").mapInArrow(_cut, "doc_id long, text_key long, n_removed long, removed array<struct<begin:long,end:long>>, kept_sha256 string")
    out = measured.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "text_key"], "left").join(cut, ["doc_id", "text_key"], "left")
    whole, nothing = F.col("copy").isNotNull(), F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("removed", nothing)).alias("removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeated_bytes(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
