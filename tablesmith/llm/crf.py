"""Quality classifier: a linear-chain conditional random field over lines.

Each line of a document is good or bad. A line's features are its own shape
(character classes, word length, common and distinct words, equality with its
neighbours) and the same features of the line before and after it. The lines'
labels are hidden: a label is known for the document alone and tells of each line
what AGREE says. Training maximizes the likelihood of the document labels: its
slope is the features and transitions expected under the document's label, less
those expected without it, so that a bad document's good lines are learned as good
ones next to bad ones. It begins with lines by themselves, as a chain that learns
from whole documents at once never tells their lines apart. A document's score is the mean of its lines' forward-backward
marginals of "good", weighted by their length in bytes.

The model is fitted on at most TRAIN_EACH labelled documents of either label, those
with the smallest hash of doc_id, as far as they have no more than TRAIN_LINES
lines together, of at most TRAIN_LONGEST lines each; all documents are scored.

Defined cases: a null or empty text is one empty line; blank lines count with
weight 1; a null label is no label, a label that is repeated counts once, and a
document labelled both ways is not trained on; without labelled documents every
score is 0.5; a text of any length is scored whole, in one worker: features are
made for BLOCK lines at a time, and what is kept takes about 80 bytes a line;
repeated rows are scored one by one; an empty table gives no row; other columns
are ignored. Inputs of a score are the text alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import Words, documents, ragged, saved, slices, table, text_key, workers

#: Labelled documents of either label that the model is fitted on, at most; their lines, and those of each.
TRAIN_EACH, TRAIN_LINES, TRAIN_LONGEST = 2000, 120_000, 2000
THRESHOLD = 0.3
#: Steps that fit lines by themselves, first labelled as their document, then with hidden labels, and those that fit the chain.
SURE_STEPS, LINE_STEPS, CHAIN_STEPS, RATE = 100, 100, 120, 0.1
#: Weight decay of features, and of transitions, which would else tie all lines of a document together.
SHRINK, SHRINK_TURNS = 1e-5, 0.005
#: What a document's label tells of each of its lines, as log odds of "good": lines of a good document are good, but a bad
#: one may have good lines too.
AGREE = (4.0, -0.5)
#: Lines whose features are made at once.
BLOCK = 50_000

COMMON = frozenset(
    "the of and to in a is that for was on are with as be this at by from or "
    "le la les de des du et un une est que qui dans en pour par sur au pas avec "
    "der die das und den von zu mit sich auf im dem nicht ein eine als "
    "el los las y se no por con su para como al lo del".split()
)
_MARKS = {"blank": b" \t\v\f", "sentence": b".,;:?'\"()-", "shout": b"!", "bar": b"|", "symbol": b"#*$%&<>@=+^~{}[]\\/_`"}
_SHAPES = 10


def _table() -> np.ndarray:
    out = np.full(256, 8, np.int64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    for i, marks in enumerate(_MARKS.values()):
        out[list(marks)] = 3 + i
    out[0x80:] = 9
    return out


FEATURES = _SHAPES + 14


def text_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines, and each text's number of lines."""
    parts = pc.split_pattern(texts, "\n")
    return parts.flatten(), np.diff(parts.offsets.to_numpy())


def line_features(lines: pa.Array, first: np.ndarray) -> np.ndarray:
    """Features of consecutive lines; first: which of them begin a text. The lines at either end have no neighbour there."""
    n = len(lines)
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + n + 1]
    size = np.diff(at)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    shapes = np.bincount(np.repeat(np.arange(n) * _SHAPES, size) + _table()[raw], minlength=n * _SHAPES).reshape(n, _SHAPES)
    words = Words(lines)
    length = pc.binary_length(words.vocabulary).to_numpy(zero_copy_only=False)[words.code]
    plain = pc.ascii_lower(pc.utf8_trim(words.vocabulary, ".,;:!?|*$%&#")).to_pylist()
    common = np.array([w in COMMON for w in plain], float)[words.code]
    pairs = np.unique(words.row * max(1, len(words.vocabulary)) + words.code) // max(1, len(words.vocabulary))
    per_word = np.maximum(words.count, 1)
    same = lines.dictionary_encode().indices.to_numpy()
    repeats = np.concatenate([[False], same[1:] == same[:-1]]) & ~first
    twice = np.concatenate([[False], (words.code[1:] == words.code[:-1]) & (words.row[1:] == words.row[:-1])])[: len(words.code)]
    shares = shapes / np.maximum(size, 1)[:, None]
    again = np.bincount(words.row[twice], minlength=n) / per_word
    distinct = np.bincount(pairs, minlength=n) / per_word
    body = np.column_stack(
        [
            np.ones(n), shares, np.log1p(size) / 8, size == 0,
            np.bincount(words.row, length, minlength=n) / per_word / 10, np.bincount(words.row, common, minlength=n) / per_word,
            distinct, np.log1p(words.count) / 6, repeats,
            again, again > 0.2, (distinct < 0.5) & (words.count > 4), shares[:, 1] > 0.3, shares[:, 6] > 0.03, shares[:, 7] > 0.05,
        ]
    ).astype(np.float32)
    before, after = np.zeros_like(body), np.zeros_like(body)
    before[1:], after[:-1] = body[:-1], body[1:]
    before[first] = 0
    after[np.concatenate([first[1:], [True]])[:n]] = 0
    return np.hstack([body, before, after])


def line_blocks(lines: pa.Array, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Features of all lines, a block at a time; a block is made with the two lines before it and the one after it."""
    first = np.zeros(len(lines) + 1, bool)
    first[np.cumsum(counts) - counts] = True
    for begin in range(0, len(lines), BLOCK):
        a, b = max(begin - 2, 0), min(begin + BLOCK + 1, len(lines))
        x = line_features(lines.slice(a, b - a), first[a:b])
        yield x[begin - a : begin - a + BLOCK]


def line_weights(lines: pa.Array) -> np.ndarray:
    return pc.binary_length(lines).to_numpy(zero_copy_only=False) + 1.0


def _both(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[..., 0], a[..., 1])


def marginals(good: np.ndarray, step: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" for each line, and expected transitions (2 x 2, summed).

    good: each line's score of "good" over "bad"; step: transition scores;
    counts: lines of each document. All documents advance line by line together."""
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    left = counts[order]
    emit = np.column_stack([np.zeros_like(good), good])
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    longest = int(left[0]) if len(left) else 0
    running = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")  # documents with more than t lines
    if longest:
        ahead[begin] = emit[begin]
    for t in range(1, longest):
        at = begin[: running[t]] + t
        ahead[at] = _both(np.swapaxes(ahead[at - 1][:, :, None] + step, 1, 2)) + emit[at]
    for t in range(longest - 2, -1, -1):
        at = begin[: running[t + 1]] + t
        back[at] = _both(step + (emit[at + 1] + back[at + 1])[:, None, :])
    total = _both(ahead + back)
    each = np.exp((ahead + back)[:, 1] - total)
    inner = np.ones(len(good), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    moves = np.exp(ahead[at - 1][:, :, None] + step + (emit[at] + back[at])[:, None, :] - total[at][:, None, None])
    return each, moves.sum(0)


def _share_of(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores by gradient ascent with adaptive steps; label: of each document."""
    weights, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    if not len(counts):
        return weights, step
    truth = np.repeat(label, counts).astype(float)
    told = np.where(truth == 1, *AGREE)
    size = len(truth)
    shrink = np.concatenate([np.full(x.shape[1], SHRINK), np.full(4, SHRINK_TURNS)])
    at = np.zeros(len(weights) + 4)
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for i in range(1, SURE_STEPS + LINE_STEPS + CHAIN_STEPS + 1):
        good = x @ weights
        if i <= SURE_STEPS + LINE_STEPS:  # each line by itself
            known, p, turns = truth if i <= SURE_STEPS else _share_of(good + told), _share_of(good), np.zeros((2, 2))
        else:
            (known, turns), (p, moves) = marginals(good + told, step, counts), marginals(good, step, counts)
            turns = turns - moves
        slope = np.concatenate([x.T @ (known - p), turns.ravel()]) / size - shrink * at
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        at = at + RATE * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
        weights, step = at[:-4], at[-4:].reshape(2, 2)
    return weights, step


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lines, counts = text_lines(batch.column("text"))
        x = np.vstack(list(line_blocks(lines, counts)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), ragged(x.ravel(), counts * x.shape[1], pa.float32())], ["doc_id", "quality", "x"])


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> DataFrame:
    """(doc_id, text, quality) of the documents that the model is fitted on."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = known.where("quality = 0").orderBy(*order).limit(each).union(known.where("quality = 1").orderBy(*order).limit(each))
    # at most 2 * each rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key")).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "text_key"])
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = saved(rows.select("doc_id", "text_key", n.alias("n")).where(F.col("n") <= TRAIN_LONGEST), "sizes")
    total = F.sum("n").over(Window.orderBy(*order, "text_key"))  # over the rows of this bounded table
    fit_in = saved(sizes.withColumn("total", total).where(F.col("total") <= TRAIN_LINES).select("doc_id", "text_key"), "fitted")
    return rows.join(F.broadcast(fit_in), ["doc_id", "text_key"]).select("doc_id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> tuple[np.ndarray, np.ndarray]:
    rows = training_rows(docs, labels, each)
    # at most TRAIN_LINES lines
    got = rows.mapInArrow(_training, "doc_id long, quality int, x array<float>").toArrow().sort_by("doc_id").combine_chunks()
    width = 3 * FEATURES
    if not len(got):
        return np.zeros(width), np.zeros((2, 2))
    lists = got["x"].combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
    return fit(x, got["quality"].to_numpy(), pc.list_value_length(lists).to_numpy() // width)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_lines, score."""
    workers(docs.sparkSession)
    weights, step = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines, counts = text_lines(batch.column("text"))
            weight = line_weights(lines)
            good, _ = marginals(np.concatenate([x @ weights for x in line_blocks(lines, counts)]), step, counts)
            start = np.cumsum(counts) - counts
            score = np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(np.clip(score, 0, 1))], ["doc_id", "n_lines", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_lines long, score double")


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
