"""What the corpus operators share: shared-folder tables, text slices, word
splitting, a fixed-size membership filter, and connected components.

Rows reach Python through ``mapInArrow`` in Arrow batches; every helper here
works on slices of bounded size, so a worker's memory does not depend on the
length of a partition."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.session import package_on_workers, shared_dir

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 2 << 20
#: Bits of the membership filter, unless spark.tablesmith.filterBits says otherwise: fixed, so what is broadcast does not
#: grow. About 8 bits for each wanted row let some 5 % of the others through; a cluster's session sets it by what it filters for.
FILTER_BITS = 1 << 23
FILTER_HASHES = 3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers(spark: SparkSession) -> None:
    """Settings of Python workers that nobody else has made: smaller Arrow batches,
    as texts can be long, and memory that goes back to the system when it is freed."""
    env, batch = spark.sparkContext.environment, "spark.sql.execution.arrow.maxRecordsPerBatch"
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 20))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    package_on_workers(spark)
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, "2000")


# -- shared folder -----------------------------------------------------------


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again. Cuts the
    lineage: a lost executor costs no more than the stage that reads the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files when the driver's JVM collects the last plan that refers to it; between stages that
    meet in saved tables this asks it to collect now, so that the disk does not hold the files of all stages at once."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def own_listings(spark: SparkSession) -> Iterator[None]:
    """Spark keeps the file listing of every table that is read in a cache of the driver (250 MB), also when nothing refers
    to the table any more. Tables read in this block are listed without it; their DataFrames hold the listing themselves."""
    key = "spark.sql.hive.filesourcePartitionFileCacheSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# -- Arrow slices ------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice has about `most` bytes of text; a longer
    text is a slice by itself. Null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        filled = pc.fill_null(batch.column(at), "")
        batch = batch.set_column(at, text, filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def raw(texts: pa.Array) -> list[np.ndarray | None]:
    """Each text's UTF-8 bytes, without a copy."""
    texts = texts.cast(pa.large_string())
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else []
    return [data[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], texts.is_valid().to_pylist(), strict=True)]


class Words:
    """Words of some texts, split at ASCII white space (\\x20, \\x09-\\x0D):
    `code` has a number for each word in order, `row` the text it stands in,
    `vocabulary` the distinct words, `count` the words of each text."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(texts)
        ends = parts.offsets.to_numpy()
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        code = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends))
        blank = pc.index(self.vocabulary, "").as_py()
        if blank >= 0:  # white space at either end leaves an empty part
            keep = code != blank
            code, row = code[keep], row[keep]
        self.code, self.row = code, row
        self.count = np.bincount(row, minlength=len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every worker."""
        import pandas as pd

        names = self.vocabulary.to_numpy(zero_copy_only=False)
        if not len(names):
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(names, categorize=False).astype(np.uint64)[self.code]


_MULTIPLIER = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: each output bit depends on all input bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of `width` consecutive words: a polynomial in 64
    bits, put together from windows of 1, 2, 4, ... words, then mixed."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    scale = (_MULTIPLIER + 2 * seed) % 2**64
    parts = [(1, words, scale)]
    while 2 * (size := parts[-1][0]) <= width:
        _, have, by = parts[-1]
        parts.append((2 * size, have[:-size] * np.uint64(by) + have[size:], by * by % 2**64))
    total, at = np.full(n, seed, np.uint64), 0
    for size, have, by in reversed(parts):
        if width - at >= size:
            total = total * np.uint64(by) + have[at : at + n]
            at += size
    return mixed(total)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have, size = values, 1
    while 2 * size <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array: counts[i] values for row i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# -- membership filter -------------------------------------------------------


def member_filter(keys: DataFrame, key: str, on: str | None = None, bits: int | None = None) -> Column:
    """A condition on a column of the same name (or `on`): false only where no row of
    `keys` has the value. It is a bitmap of fixed size: one hash chooses a word of 64
    bits, another FILTER_HASHES bits of it. It is built on the executors and read as
    a scalar subquery, so it thins out a scan before a shuffle at any input size; the
    exact join must still follow."""
    spark = keys.sparkSession
    words = (bits or int(spark.conf.get("spark.tablesmith.filterBits", str(FILTER_BITS)))) // 64

    def place(column: str) -> tuple[Column, Column]:
        """Word and mask of a value."""
        h, one = F.xxhash64(F.lit(1), F.col(column)), F.lit(1).cast("long")
        places = [F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int") for i in range(FILTER_HASHES)]
        return F.pmod(F.xxhash64(F.lit(0), F.col(column)), F.lit(words)).cast("int"), reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, x) for x in places])

    word, mask = place(key)
    every = spark.range(0, words, 1, 1).select(F.col("id").cast("int"), F.lit(0).cast("long"))
    filled = keys.select(word.alias("_word"), mask.alias("_mask")).union(every).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    packed = saved(filled.agg(F.sort_array(F.collect_list(F.struct("_word", "_mask"))).getField("_mask").alias("bitmap")), "filter")
    word, mask = place(on or key)
    return F.get(packed.scalar(), word).bitwiseAND(mask) == mask


def text_key() -> Column:
    """A hash of the row's text; with doc_id it tells rows apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def spare(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has such a column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def without(docs: DataFrame, rejected: DataFrame, once: bool = False) -> DataFrame:
    """The documents but the rejected ones, given by doc_id or by doc_id and
    text_key (hash of the text); once: repeated rows (same doc_id and text) stay
    once. Only rows that the membership filter lets through are shuffled."""
    key, gone_id, gone_key = (spare(docs, n) for n in ("_text_key", "_gone_id", "_gone_key"))
    keyed = docs.withColumn(key, text_key())
    gone = saved(rejected.withColumnsRenamed({"doc_id": gone_id, "text_key": gone_key}).distinct(), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col(gone_id))
    if "text_key" in rejected.columns:
        same = same & (F.col(key) == F.col(gone_key))
    suspects = gone.select(F.col(gone_id).alias("doc_id"))
    if once:
        suspects = suspects.union(keyed.groupBy("doc_id", key).agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"))
    maybe = member_filter(suspects, "doc_id")
    some = keyed.where(maybe).join(gone, same, "left_anti")
    if once:
        some = some.dropDuplicates(["doc_id", key])
    return keyed.where(~maybe).select(*docs.columns).union(some.select(*docs.columns))


# -- connected components ----------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the smallest
    node that can be reached. Each round takes the smallest label among a node
    and its neighbours, then follows the label's own label, so a path of n links
    takes about log n rounds. Labels and links stay in shared tables."""
    both = edges.select("a", "b").where("a <> b")
    both = saved(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        moved = saved(stepped.join(jump, "via", "left").select("node", "was", F.coalesce(F.least("via", "far"), "via").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
