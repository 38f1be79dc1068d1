"""Records of text files that no single character ends: CSV rows whose cells hold line
breaks, elements of one large JSON array.

Spark's text source cuts a file into splits and each split into pieces (at line feeds,
or at commas for JSON), so any number of tasks read a file. Whether a piece's end is
also a record's end depends on all that stands before it: on whether a quoted part is
open there, and how deep brackets are nested. Three steps:

1. Each split is scanned as if it began outside quotes and as if it began inside: what
   holds at its end, and how many pieces end outside quotes at each depth.
2. The splits' results, one small row each, are put together from the first on. That
   gives the true state at each split's beginning, and the records before it.
3. Each split is scanned again from its true state and cut at its first true border.
   Whole records go on as they are; only the pieces of records that reach over a split's
   end are grouped, by file and record number.

A record's number in its file is also the rows' input order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.session import package_on_workers

#: Splits whose states (some 60 bytes each) are broadcast; with more of them, pieces are dealt by split.
MOST_BROADCAST = 200_000


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and where each ends."""
    values = values.cast(pa.large_binary())
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


@dataclass(frozen=True)
class CsvScan:
    """A quote opens a quoted part only where a cell begins; inside, two quotes stand for one. What follows a closing quote
    belongs to the cell up to the next separator."""

    separator: bytes
    cut: str = "\n"

    def _inside(self, line: bytes, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                at = line.find(b'"', at)
                while at >= 0 and line[at + 1 : at + 2] == b'"':
                    at = line.find(b'"', at + 2)
                if at < 0:
                    return True
                inside = False
            elif line[at : at + 1] == b'"':
                inside, at = True, at + 1
                continue
            at = line.find(self.separator, at)
            if at < 0:
                return False
            at += 1

    def after(self, values: pa.Array, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a quoted part is open at the end of each piece, and the depth there (always 0)."""
        data, ends = _flat(values)
        quoted = np.unique(np.searchsorted(ends, np.flatnonzero(data == 34), side="right"))
        out, done = np.empty(len(values), bool), 0
        for i, line in zip(quoted.tolist(), values.take(pa.array(quoted)).to_pylist(), strict=True):
            out[done:i] = inside
            inside = out[i] = self._inside(line, inside)
            done = i + 1
        out[done:] = inside
        return out, np.zeros(len(values), np.int64)

    def root(self, head: bytes) -> int:
        return 0


@dataclass(frozen=True)
class JsonScan:
    """A quote that no backslash escapes opens or closes a string; brackets count outside strings."""

    cut: str = ","

    def after(self, values: pa.Array, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        data, ends = _flat(values)
        quote = data == 34
        if (data == 92).any():
            # of a run of backslashes before a quote, an odd one escapes it
            for m in re.finditer(rb'\\+"', data.tobytes()):
                quote[m.end() - 1] &= (m.end() - m.start()) % 2 == 1
        at = ends - 1
        sums = lambda x, first: first + np.concatenate([[0], np.cumsum(x)])[at + 1]
        within = (np.cumsum(quote) + inside) % 2 == 1
        nested = np.isin(data, (91, 123)).astype(np.int64) - np.isin(data, (93, 125))
        nested[within] = 0
        return sums(quote, int(inside)) % 2 == 1, sums(nested, depth)

    def root(self, head: bytes) -> int:
        """Depth at which commas part the rows: 1 in a list, 2 in an object that has a list for its first value, else 0."""
        if re.match(rb"(?:\xef\xbb\xbf)?\s*\[", head):
            return 1
        return 2 if re.match(rb'(?:\xef\xbb\xbf)?\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\[', head) else 0


Scan = CsvScan | JsonScan


def _pieces(spark: SparkSession, path: str | list[str], scan: Scan) -> DataFrame:
    """file, block, value of each piece, in order within a task."""
    raw = spark.read.option("lineSep", scan.cut).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """File, block, and rows of the batch, for each split in it."""
    file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
    code = file.indices.to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])[: batch.num_rows])
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows], strict=True):
        yield file.dictionary[int(code[a])].as_py(), int(block[a]), a, b


def _summary(scan: Scan):
    """One row for each split: the root's depth by the first piece, and for each beginning its end and the pieces that end
    outside quotes, by depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for batch in batches:
            for file, block, a, b in _spans(batch):
                values = batch.column("value").slice(a, b - a)
                if (file, block) not in found:
                    found[file, block] = [scan.root(values[0].as_py()), [[bool(s), 0, {}] for s in (0, 1)]]
                for state in found[file, block][1]:
                    inside, depth = scan.after(values, *state[:2])
                    state[0], state[1] = bool(inside[-1]), int(depth[-1])
                    for d, n in zip(*np.unique(depth[~inside], return_counts=True), strict=True):
                        state[2][int(d)] = state[2].get(int(d), 0) + int(n)
        rows = [(file, block, root, *[x for s in states for x in (s[0], s[1], list(s[2].items()))]) for (file, block), (root, states) in found.items()]
        names = ["file", "block", "root", "end0", "depth0", "ends0", "end1", "depth1", "ends1"]
        counts = pa.map_(pa.int64(), pa.int64())
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), counts, pa.bool_(), pa.int64(), counts]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


_SUMMARY = "file string, block long, root int, end0 boolean, depth0 long, ends0 map<bigint,bigint>, end1 boolean, depth1 long, ends1 map<bigint,bigint>"


def _records(scan: Scan):
    """Records of splits whose state is known; `part` ones are the beginning, middle or end of a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held, begun = None, (False, 0, 0, 0), [], True
        cut = scan.cut.encode()

        def out(file, block, numbers, values, part, ended):
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array([part] * n, pa.bool_()), pa.array([ended] * n, pa.bool_()), values], ["file", "block", "number", "part", "ended", "value"])

        for batch in batches:
            for file, block, a, b in _spans(batch):
                if now != (file, block):
                    if held:
                        yield out(*now, [state[2]], pa.array([cut.join(held)], pa.binary()), True, False)
                    now, held = (file, block), []
                    state = tuple(batch.column(c)[a].as_py() for c in ("inside", "depth", "number", "border"))
                    # a split may begin within a record
                    begun = block == 0 or (not state[0] and state[1] == state[3])
                values = batch.column("value").slice(a, b - a)
                inside, depth = scan.after(values, *state[:2])
                ends = np.flatnonzero(~inside & (depth == state[3]))
                number, texts = state[2], values.to_pylist() if len(ends) < len(values) or held or not begun else None
                if texts is None:  # each piece is a record
                    yield out(file, block, np.arange(number, number + len(ends)), values.cast(pa.binary()), False, True)
                else:
                    at, whole, numbers = 0, [], []
                    for e in ends.tolist():
                        text = cut.join([*held, *texts[at : e + 1]])
                        held, at = [], e + 1
                        if begun:
                            whole.append(text)
                            numbers.append(number)
                        else:
                            yield out(file, block, [number], pa.array([text], pa.binary()), True, True)
                            begun = True
                        number += 1
                    held += texts[at:]
                    if whole:
                        yield out(file, block, numbers, pa.array(whole, pa.binary()), False, True)
                state = (bool(inside[-1]), int(depth[-1]), state[2] + len(ends), state[3])
        if held:
            yield out(*now, [state[2]], pa.array([cut.join(held)], pa.binary()), True, False)

    return run


def split_states(spark: SparkSession, path: str | list[str], scan: Scan) -> list[tuple] | None:
    """(file, block, inside, depth, number, border) at each split's beginning; None if a file is no list of records. One
    row for each input split comes to the driver, which has planned as many."""
    package_on_workers(spark)
    found = _pieces(spark, path, scan).mapInArrow(_summary(scan), _SUMMARY).collect()
    out, file = [], None
    inside, depth, number, border, commas = False, 0, 0, 0, 0
    for r in sorted(found, key=lambda r: (r.file, r.block)):
        if r.file != file:
            if file is not None and not _is_list(scan, border, depth, commas):
                return None
            file, border = r.file, r.root
            inside, depth, number, commas = False, 0, 0, 0
        out.append((r.file, r.block, inside, depth, number, border))
        ends = r.ends1 if inside else r.ends0
        number += ends.get(border - depth, 0)
        commas += sum(n for d, n in ends.items() if 0 < d + depth < border)
        inside, depth = (r.end1, depth + r.depth1) if inside else (r.end0, depth + r.depth0)
    return out if file is None or _is_list(scan, border, depth, commas) else None


def _is_list(scan: Scan, border: int, depth: int, commas: int) -> bool:
    """A JSON file that is a list, or an object with nothing but a list; any CSV file."""
    return isinstance(scan, CsvScan) or (border > 0 and depth == 0 and commas == 0)


def records(spark: SparkSession, path: str | list[str], scan: Scan, states: list[tuple]) -> DataFrame:
    """file, number, value (bytes), ended (false: the file's last record, up to the end of the file)."""
    known = spark.createDataFrame(states, "file string, block long, inside boolean, depth long, number long, border long")
    pieces = _pieces(spark, path, scan)
    if len(states) <= MOST_BROADCAST:
        ready = pieces.join(F.broadcast(known), ["file", "block"])
    else:
        placed = pieces.withColumn("_at", F.monotonically_increasing_id()).join(known, ["file", "block"])
        ready = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "block").sortWithinPartitions("file", "block", "_at").drop("_at")
    found = ready.mapInArrow(_records(scan), "file string, block long, number long, part boolean, ended boolean, value binary")
    parts = found.where("part").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", F.col("value").cast("string").alias("value")))).alias("parts"), F.bool_or("ended").alias("ended"))
    joined = parts.select("file", "number", F.array_join(F.transform("parts", lambda p: p.value), scan.cut).cast("binary").alias("value"), "ended")
    return found.where("not part").select("file", "number", "value", "ended").union(joined)


def any_open_line(spark: SparkSession, path: str | list[str], separator: str) -> bool:
    """Whether a quoted cell is still open at the end of some line, should the line begin outside quotes; if none is, all
    lines do. Only lines with quotes are looked at, up to the first such line of each task."""
    scan = CsvScan(separator.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(scan._inside(line, False) for line in batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([True])], ["open"])
                return

    package_on_workers(spark)
    lines = spark.read.text(path).where(F.contains("value", F.lit('"'))).select(F.col("value").cast("binary"))
    return not lines.mapInArrow(run, "open boolean").isEmpty()
