"""Packing: concatenate and cut.

All documents, each closed by an end id, form one long row of ids. The first
pass tokenizes and writes each document's ids with its place among the ids of
its input partition. The totals of the partitions, one row each, give every
partition's global offset by a prefix sum. The second pass cuts the row at each
multiple of the window: a document that crosses a cut gives a piece on either
side. Only the very last sequence can be short.

Defined cases: a null or empty text gives the end id alone; repeated rows are
packed one by one; a text of any length is cut as often as needed; an empty
table gives no piece; other columns are ignored."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import documents, saved, slices, workers

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: A letter and the signs that end a chunk never share a token.
_TAIL = r"(\p{L})([,.!?*$&%#;:]+)$"
#: Pieces of one word or one run of signs, which can be encoded many at a time.
_SIMPLE = r"^(\p{L}+|[,.!?*$&%#;:|]+)$"
_GROUP = 200


def _take(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin[c] : begin[c] + size[c]] for each c of code, joined; and where each ends."""
    each = size[code]
    ends = np.cumsum(each)
    return flat[np.repeat(begin[code] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)], ends


class WordEncoder:
    """Ids of whole texts by a word-level BPE tokenizer that drops white space.
    White-space-separated chunks never share a token, so each distinct chunk of a
    slice is encoded once and its ids are gathered for every place where it stands."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = bool(suffix) and token.endswith(suffix)

    def _one_by_one(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: flat, and each one's begin and size."""
        simple = pc.match_substring_regex(pieces, _SIMPLE).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        some = pieces.filter(pa.array(simple)).to_pylist()
        groups = [some[i : i + _GROUP] for i in range(0, len(some), _GROUP)]
        flat, sizes = [], []
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group) and len(ids) == ends[-1]:
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:  # the tokenizer sees other words than the pattern does
                each = self._one_by_one(group)
                flat += each
                sizes.append(np.array([len(x) for x in each]))
        each = self._one_by_one(pieces.filter(pa.array(~simple)).to_pylist())
        flat += each
        sizes.append(np.array([len(x) for x in each], np.int64))
        size = np.zeros(len(pieces), np.int64)
        begin = np.zeros(len(pieces), np.int64)
        size[order] = np.concatenate(sizes)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), begin, size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, each text closed by end_id, and each text's number of ids."""
        if pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are found before anything else, in their own letter case
            each = [np.append(x, np.uint32(end_id)) for x in self._one_by_one(texts.to_pylist())]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = parts.flatten().dictionary_encode()
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(words.dictionary, _TAIL, r"\1 \2"))
        pieces = split.flatten().dictionary_encode()
        by_chunk, at = _take(*self._pieces(pieces.dictionary), pieces.indices.to_numpy())
        # ids of each distinct chunk are those of its pieces
        at = np.concatenate([[0], at])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        body, ends = _take(by_chunk, at[:-1], np.diff(at), words.indices.to_numpy())
        offsets = parts.offsets.to_numpy()
        counts = np.diff(np.concatenate([[0], ends])[offsets - offsets[0]]) + 1
        out = np.full(len(body) + len(texts), end_id, np.uint32)
        kept = np.ones(len(out), bool)
        kept[np.cumsum(counts) - 1] = False
        out[kept] = body
        return out, counts


_encoders: dict[str, WordEncoder] = {}


def _tokenize(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder, part, before = _encoders[path], TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", SLICE):
            ids, counts = encoder.encode(batch.column("text"), end_id)
            ends = np.cumsum(counts)
            data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part, np.int32)), batch.column("doc_id"), pa.array(before + ends - counts), pa.array(counts), data], ["part", "doc_id", "at", "doc_tokens", "ids"])
            before += int(ends[-1])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id,
    offset and `ids`, the piece's ids as little-endian unsigned 32-bit numbers."""
    workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = saved(rows.mapInArrow(_tokenize(tokenizer_path, end_id), "part int, doc_id long, at long, doc_tokens long, ids binary"), "ids")
    # One row for each input partition, whatever the number of documents.
    totals = sorted((r.part, r.n) for r in coded.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    offsets = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    first = docs.sparkSession.createDataFrame([(p, int(o)) for (p, _), o in zip(totals, offsets)], "part int, base long")  # noqa: B905
    placed = coded.join(F.broadcast(first), "part").withColumn("g", F.col("base") + F.col("at"))
    cuts = F.sequence(F.expr(f"g div {window}"), F.expr(f"(g + doc_tokens - 1) div {window}"))
    pieces = placed.withColumn("sequence_id", F.explode(cuts))
    start = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * window - F.col("g"))
    stop = F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * window - F.col("g"))
    pieces = pieces.withColumn("start", start).withColumn("length", stop - F.col("start"))
    return pieces.select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id",
        (F.col("g") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
        F.expr("substring(ids, cast(4 * start as int) + 1, cast(4 * length as int))").alias("ids"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir), tokenizer_path()))
