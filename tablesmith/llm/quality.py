"""Quality rules: distribution divergence.

Each document gets two histograms: code points by character class, and words by
common word (one bin for all others). A language's reference is the sum of the
histograms of all its documents that pass the base rules, however many there are;
a table of references fitted elsewhere (`references` on trusted documents) can be
given instead, as a corpus that is mostly junk is its own measure otherwise. A
document is rejected when the Jensen-Shannon distance (base 2, 0 to 1) to its
language's reference is over a threshold; texts under a minimum length are not
held to that, as short histograms are far from any reference by chance. Base rules
come first: too few words, or too many words in repeated three-word windows.

Defined cases: a null or empty text has no words and fails the base rules; a null
or empty `lang` is a language of its own; a language without a reference has no
distances, and its documents are held to the base rules alone; of a language
without a list of common words nearly all words fall in the last bin, so that the
character classes decide; repeated rows are judged one by one; a text of any
length is measured whole, in one worker, which needs about 20 bytes for each of
its bytes; an empty table gives no row; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import Words, documents, ragged, saved, slices, text_key, workers

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Texts below these lengths are not compared with a reference: characters for the classes, words for the common words.
MIN_COMPARED_CHARS, MIN_COMPARED_WORDS = 200, 150
#: Chosen on the labelled documents: clean ones stay below, by more the longer they are.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.27
#: Bytes of a text whose characters are classed at once.
BLOCK = 1 << 20

COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are with as be this at by from or have an not but".split(),
    "fr": "le la les de des du et un une est que qui dans en pour par sur au aux pas avec il elle ne se".split(),
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split(),
    "es": "el la los las de que y en un una ser se no por con su para como al lo del más o es pero".split(),
}
WORD_BINS = {w: i for i, w in enumerate(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))}

#: Character classes: small letter, capital, digit, blank, line break, sentence sign, symbol, other ASCII, beyond ASCII.
CLASSES = 9
_SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.int64)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[9, 11, 12, 32]] = 3
    table[[10, 13]] = 4
    table[list(b".,;:!?'\"()-")] = 5
    table[list(_SYMBOLS)] = 6
    table[0x80:0xC0] = CLASSES  # the rest of a code point, not counted
    table[0xC0:] = 8
    return table


def _classes(texts: pa.Array) -> np.ndarray:
    """Characters of each class in each text, counted block by block."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends, table, out = ends - ends[0], _class_table(), np.zeros((len(texts), CLASSES + 1), np.int64)
    for begin in range(0, len(raw), BLOCK):
        stop = min(begin + BLOCK, len(raw))
        a, b = int(np.searchsorted(ends, begin, side="right")) - 1, int(np.searchsorted(ends, stop, side="left"))
        row = np.repeat(np.arange(b - a), np.diff(np.clip(ends[a : b + 1], begin, stop)))
        out[a:b] += _histogram(row, table[raw[begin:stop]], b - a, CLASSES + 1)
    return out[:, :CLASSES]


def _histogram(row: np.ndarray, value: np.ndarray, rows: int, bins: int) -> np.ndarray:
    return np.bincount(row * bins + value, minlength=rows * bins).reshape(rows, bins)


def _repeated_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _repeated_words(words: Words, rows: int) -> np.ndarray:
    """Words of each row in a three-word window that occurs again in that row."""
    covered = np.zeros(len(words.code), bool)
    if len(words.code) >= 3:
        code, row = words.code.astype(np.int64), words.row
        n = len(code) - 2
        whole = row[:n] == row[2:]
        size = len(words.vocabulary)
        pair, _ = _numbered(code[:-1] * size + code[1:])
        three, kinds = _numbered(pair[:n] * size + code[2:])
        window, kinds = _numbered(row[:n] * kinds + three)
        window[~whole] = kinds
        again = whole & (np.bincount(window, minlength=kinds + 1)[window] > 1)
        for i in range(3):
            covered[i : n + i] |= again
    return np.bincount(words.row[covered], minlength=rows)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    import pandas as pd

    code, kinds = pd.factorize(values)
    return code, len(kinds)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, n = batch.column("text"), batch.num_rows
        classes = _classes(texts)
        words = Words(texts)
        lengths = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False)
        plain = pc.utf8_lower(pc.utf8_trim(words.vocabulary, ".,;:!?'\"()-")).to_pylist()
        bins = np.array([WORD_BINS.get(w, len(WORD_BINS)) for w in plain], np.int64)
        common = _histogram(words.row, bins[words.code], n, len(WORD_BINS) + 1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("text_key"), batch.column("lang"), pa.array(words.count),
                pa.array(np.bincount(words.row, lengths[words.code], minlength=n).astype(np.int64)),
                pa.array(classes[:, 6].astype(np.int64)), pa.array([_repeated_lines(t) for t in texts.to_pylist()], pa.int64()),
                pa.array(_repeated_words(words, n)), ragged(classes.ravel(), np.full(n, CLASSES), pa.int64()),
                ragged(common.ravel(), np.full(n, common.shape[1]), pa.int64()),
            ],
            names=["doc_id", "text_key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"],
        )


_MEASURED = "doc_id long, text_key long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language of each partition, so that a language with most documents is as cheap as any."""
    sums: dict[str | None, list] = {}
    for batch in batches:
        classes, common = _matrix(batch.column("classes")), _matrix(batch.column("common"))
        langs = batch.column("lang").dictionary_encode()
        code = pc.fill_null(langs.indices, len(langs.dictionary)).to_numpy(zero_copy_only=False)
        for i in np.unique(code):
            key, mine = (langs.dictionary[i].as_py() if i < len(langs.dictionary) else None), code == i
            got = [int(mine.sum()), classes[mine].sum(0), common[mine].sum(0)]
            sums[key] = [a + b for a, b in zip(sums[key], got, strict=True)] if key in sums else got
    if sums:
        yield pa.RecordBatch.from_pylist([{"lang": k, "n": n, "classes": a.tolist(), "common": b.tolist()} for k, (n, a, b) in sums.items()], pa.schema([("lang", pa.string()), ("n", pa.int64()), ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))]))


def _share(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to the same row of q, base 2."""
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"


def _measured(docs: DataFrame) -> DataFrame:
    workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", text_key().alias("text_key"))
    return rows.mapInArrow(_measure, _MEASURED)


def _sums(measured: DataFrame) -> DataFrame:
    some = measured.where(f"not ({_FAILED})").select("lang", "classes", "common")
    parts = some.mapInArrow(_partial_sums, "lang string, n long, classes array<long>, common array<long>")
    total = lambda name, bins: F.array(*[F.sum(F.col(name)[i]) for i in range(bins)]).alias(name)
    return parts.groupBy("lang").agg(total("classes", CLASSES), total("common", len(WORD_BINS) + 1))


def references(docs: DataFrame) -> DataFrame:
    """(lang, classes, common): the histograms of each language's documents that pass the base rules."""
    return _sums(_measured(docs))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column("ref_classes").is_valid().to_numpy(zero_copy_only=False)
        own, words, failed = _matrix(batch.column("classes")), batch.column("n_words").to_numpy(), batch.column("base_failed").to_numpy(zero_copy_only=False)
        long_enough = known & (own.sum(1) >= MIN_COMPARED_CHARS), known & (words >= MIN_COMPARED_WORDS)
        far = []
        for x, name in ((own, "ref_classes"), (_matrix(batch.column("common")), "ref_common")):
            out = np.zeros(len(x))
            if known.any():
                out[known] = distance(_share(x[known].astype(float)), _share(_matrix(batch.column(name).drop_null()).astype(float)))
            far.append(out)
        apart = long_enough[0] & (far[0] > MAX_CLASS_DISTANCE) | long_enough[1] & (far[1] > MAX_WORD_DISTANCE)
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _KEPT), *(pa.array(x, mask=~ok) for x, ok in zip(far, long_enough, strict=True)), pa.array(~failed & ~apart)], names=[*_KEPT, "class_distance", "word_distance", "kept"])


_KEPT = ["doc_id", "text_key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, text_key (hash of the text), lang, base measures, base_failed, both distances (null
    where the text is too short to compare) and kept. known: references of other documents, as `references` gives them."""
    measured = saved(_measured(docs), "quality")
    # one row for each language, written so that its size is known and a language with most documents can be split
    known = saved((_sums(measured) if known is None else known).select(F.col("lang").alias("ref_lang"), F.col("classes").alias("ref_classes"), F.col("common").alias("ref_common")), "references")
    met = measured.join(known, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").withColumn("base_failed", F.expr(_FAILED))
    return met.select(*_KEPT, "classes", "common", "ref_classes", "ref_common").mapInArrow(_judge, _MEASURED.partition(", classes")[0] + ", base_failed boolean, class_distance double, word_distance double, kept boolean")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(documents(spark, sf_dir)).drop("text_key", "lang")
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
