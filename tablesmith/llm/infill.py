"""Fill-in-middle: documents are cut at two line ends, and the middle comes last.

The lines of a text are `[^\\n]*\\n|[^\\n]+`; a cut may stand before the first,
between two, or after the last. Where it stands depends on doc_id and seed alone,
so copies of one text are cut at different places but share their line ends.

Distinct-text index: rows with equal 64-bit hashes of the text are grouped, one text
stands for the group, and its line ends are computed once, as an Elias-Fano list (about
2 + log2(chars / lines) bits a line, with the place of every SAMPLE-th entry, so that
one entry is found without unpacking the others). The index is joined back to the rows;
a row takes the list only if its text equals the index's text, so a collision of hashes
costs a list of its own and changes nothing. A text that stands once has its list made
where it is read: texts move only if the filter of repeated hashes lets them through,
and a group of any size is a join with one row, which Spark can split.

Defined cases: a null text is empty; empty texts and those that contain a sentinel stay
plain, and so do those the rate leaves out; a null doc_id is hashed like the empty
string; repeated rows get the same result each; a text of one line can be cut before or
after it; a text of any length is handled whole; an empty table gives no row; other
columns are ignored."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.common import documents, member_filter, raw, saved, workers

SEED = 7
RATE = 100
SPM_PERCENT = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Every so many entries of a list, the place of one in the upper bits is kept.
SAMPLE = 256
_HEAD = struct.Struct("<QQB")


# -- Elias-Fano lists ----------------------------------------------------------


def line_ends(data: np.ndarray) -> np.ndarray:
    """Where the lines of a UTF-8 text end, in code points."""
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    if not len(ends):
        return ends
    followers = np.add.reduceat((data & 0xC0) == 0x80, np.concatenate([[0], ends[:-1]]), dtype=np.int64)
    return ends - np.cumsum(followers)


def packed_list(ends: np.ndarray) -> bytes:
    """An ascending list: number, largest and low width, then sampled places, low bits and unary upper parts."""
    n, most = len(ends), int(ends[-1]) if len(ends) else 0
    width = max(0, (most // n).bit_length() - 1) if n else 0
    low = (ends[:, None] >> np.arange(width)) & 1
    places = (ends >> width) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    bits = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return _HEAD.pack(n, most, width) + places[::SAMPLE].astype("<u8").tobytes() + bits(low) + bits(high)


def list_size(packed: bytes) -> int:
    return _HEAD.unpack_from(packed)[0]


def entry(packed: bytes, k: int) -> int:
    """The k-th entry (from 0): found in the upper bits from the sample before it, completed by its low bits."""
    n, _, width = _HEAD.unpack_from(packed)
    samples = -(-n // SAMPLE)
    low_at = _HEAD.size + 8 * samples
    high_at = low_at + -(-n * width // 8)
    place = struct.unpack_from("<Q", packed, _HEAD.size + 8 * (k // SAMPLE))[0]
    rest, begin = k % SAMPLE, place // 8
    step = 2 * SAMPLE // 8
    skip = place % 8  # the sampled bit itself counts as the first
    while True:
        block = np.unpackbits(np.frombuffer(packed, np.uint8, min(step, len(packed) - high_at - begin), high_at + begin), bitorder="little")
        block[:skip] = 0
        ones = np.flatnonzero(block)
        if rest < len(ones):
            place = 8 * begin + int(ones[rest])
            break
        rest, begin, skip = rest - len(ones), begin + step, 0
    first = k * width
    window = int.from_bytes(packed[low_at + first // 8 : low_at + (first + width + 7) // 8], "little")
    return ((place - k) << width) | ((window >> first % 8) & ((1 << width) - 1))


@F.arrow_udf(T.BinaryType())
def _list(texts: pa.Array) -> pa.Array:
    return pa.array([packed_list(line_ends(x)) for x in raw(texts)], pa.binary())


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("n", "begin", "end")]))
def _cuts(first: pa.Array, second: pa.Array, lists: pa.Array, texts: pa.Array) -> pa.Array:
    """Number of lines and both cuts, in code points; from the text where there is no list."""
    out = []
    for a, b, have, text in zip(first.to_pylist(), second.to_pylist(), lists.to_pylist(), raw(texts), strict=True):
        have = packed_list(line_ends(text)) if have is None else have
        n = list_size(have)
        a, b = sorted((a % (n + 1), b % (n + 1)))
        out.append((n, *(entry(have, k - 1) if k else 0 for k in (a, b))))
    n, begin, end = zip(*out, strict=True) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, begin, end)], ["n", "begin", "end"])


# -- documents -----------------------------------------------------------------


def boundary_index(rows: DataFrame) -> DataFrame:
    """(text_key, o_text, list) for each text_key of rows (text_key, text): the least text, should several have the hash."""
    return rows.groupBy("text_key").agg(F.min("text").alias("o_text")).withColumn("list", _list("o_text"))


def _draw(seed: int, k: int) -> Column:
    """The k-th group of eight digits of the document's hash, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and `output` for each row. rate: percent of
    the documents that are cut; spm_percent: percent of those that have the suffix first."""
    workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    repeated = saved(rows.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key"), "repeated")
    some = member_filter(repeated, "text_key")
    index = saved(boundary_index(rows.where(some)), "boundaries")
    same = F.col("text") == F.col("o_text")
    met = rows.where(some).join(index, "text_key").select("doc_id", "text", F.when(same, F.col("list")).alias("list"))
    alone = rows.where(~some).select("doc_id", "text", F.lit(None).cast("binary").alias("list"))
    own = F.when(F.col("list").isNull(), F.col("text"))
    cut = met.union(alone).withColumn("cut", _cuts(_draw(seed, 0), _draw(seed, 1), F.col("list"), own))
    plain = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (_draw(seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.select("doc_id", "text", "cut.*", form.alias("form"))
    prefix, middle, suffix = F.expr("substring(text, 1, int(begin))"), F.expr("substring(text, int(begin) + 1, int(end - begin))"), F.expr("substring(text, int(end) + 1)")
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id", "n", "form", F.when(moved, F.col("begin")).alias("prefix_chars"), F.when(moved, F.col("end") - F.col("begin")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. No sentinel stands in a cut text, and none can arise where parts meet."""

    def parts(one: str, two: str) -> list[Column]:
        """What stands between the first sentinel and `two`, between that and the last, and after it."""
        body = F.expr(f"substring({output}, {len(one) + 1})")
        a = F.substring_index(body, two, 1)
        rest = F.substring(body, F.length(a) + len(two) + 1, F.length(body))
        b = F.substring_index(rest, MIDDLE, 1)
        return [a, b, F.substring(rest, F.length(b) + len(MIDDLE) + 1, F.length(rest))]

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(F.col(form) == "psm", F.concat(p, m, s)).when(F.col(form) == "spm", F.concat(p2, m2, s2)).otherwise(F.col(output))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(documents(spark, sf_dir))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
