"""Merkle manifest of a dataset: one tree a source, one tree over the sources' roots.

H is the lowercase hex SHA-256 of the concatenation of its inputs. A document's leaf
is H of its fields, each `-` if null, else its UTF-8 bytes' number, a colon and the
value. Node j of a level is H of the nodes FANOUT * j .. of the level below, of those
that exist: the last run of a level may be short, down to one node, and is hashed as it
is, without padding. A lone leaf is its own root.

How a tree is built by many tasks:

1. Leaves are dealt by ranges of (source, doc_id) and numbered within their partition;
   a prefix sum over the partitions gives each leaf its index in its tree.
2. A task takes up to RUN consecutive leaves, wherever they begin. A mountain range
   holds, for each level, the nodes that wait for the rest of their run: a node that
   completes its run is carried to the level above in base FANOUT. Completed nodes are
   written as records. What is left at both edges, where a run is shared with a
   neighbour, stays open: some FANOUT nodes a level.
3. Open nodes are merged level band by level band: a group of one merging step covers an
   aligned range of FANOUT ** STEP nodes of the band below, so it has a bound, and
   leaves one open node. A tree of n leaves takes log(n) / STEP steps.
4. For proofs, each run of leaves gets the few nodes beside and above it that other
   tasks made (an equi-join on the open nodes alone), and climbs once more.

Trees of any size, and a source with most rows, are many runs; no group is larger than
RUN leaves or one merging step, and nothing is collected.

Defined cases: a null source is a source of its own, before all others; null doc_ids
come first in their source; rows of one doc_id follow each other by leaf; repeated rows
are leaves one by one; null fields, empty and long texts are hashed like any; an empty
table gives no row; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import documents, saved, workers

FANOUT = 3
#: Consecutive leaves that a task folds at once.
RUN = 1 << 14
#: Levels that one merging step closes.
STEP = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, total long, level int, at long, digest binary, open boolean, made boolean"
_RUN = ["tree", "part", "run"]


def _hash(inputs: list[str]) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def widths(total: int) -> list[int]:
    """Nodes of each level, up to the root's."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


class MountainRange:
    """Nodes of one tree, pushed in the order of their leaves. `nodes` has all that are known, `open` those whose run has
    other nodes that are not here (or that reached `top` or the root), `made` those that were computed here."""

    def __init__(self, total: int, top: int | None = None):
        self.widths = widths(total)
        self.top = len(self.widths) - 1 if top is None else min(top, len(self.widths) - 1)
        self.nodes: dict[tuple[int, int], str] = {}
        self.open: list[tuple[int, int]] = []
        self.made: list[tuple[int, int]] = []
        self.waiting: list[list[int]] = [[] for _ in self.widths]

    def push(self, level: int, at: int, digest: str) -> None:
        self.nodes[level, at] = digest
        while level < self.top:
            run = self.waiting[level]
            if run and (run[-1] + 1 != at or at % FANOUT == 0):
                self._leave(level)
            run.append(at)
            if at % FANOUT != FANOUT - 1 and at != self.widths[level] - 1:
                return  # the rest of the run is still to come
            if run[0] % FANOUT:
                return self._leave(level)  # its beginning is elsewhere
            digest = _hash([self.nodes[level, x] for x in run])
            run.clear()
            level, at = level + 1, at // FANOUT
            self.nodes[level, at] = digest
            self.made.append((level, at))
        self.open.append((level, at))

    def _leave(self, level: int) -> None:
        self.open += [(level, x) for x in self.waiting[level]]
        self.waiting[level].clear()

    def close(self) -> MountainRange:
        for level in range(len(self.waiting)):
            self._leave(level)
        return self

    def records(self, tree: str, total: int) -> pa.Table:
        """Nodes made here, and those that stay open."""
        left, made = set(self.open), set(self.made)
        rows = [*self.made, *[x for x in self.open if x not in made]]
        n = len(rows)
        level, at = zip(*rows, strict=True) if rows else ((), ())
        return pa.Table.from_arrays([
            pa.array([tree] * n, pa.string()), pa.array([total] * n, pa.int64()), pa.array(level, pa.int32()), pa.array(at, pa.int64()),
            pa.array([bytes.fromhex(self.nodes[x]) for x in rows], pa.binary()), pa.array([x in left for x in rows]), pa.array([x in made for x in rows]),
        ], ["tree", "total", "level", "at", "digest", "open", "made"])


def _one(table: pa.Table, column: str):
    return table.column(column)[0].as_py()


def _leaves(table: pa.Table) -> pa.Table:
    return table.sort_by("i")


def _climbed(table: pa.Table) -> MountainRange:
    """A run of leaves, sorted."""
    out = MountainRange(_one(table, "total"))
    first = _one(table, "i")
    for i, digest in enumerate(table.column("leaf").to_pylist(), first):
        out.push(0, i, digest.hex())
    return out.close()


def _climb(table: pa.Table) -> pa.Table:
    table = _leaves(table)
    return _climbed(table).records(_one(table, "tree"), _one(table, "total"))


def _merge(top: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "at", "digest")), strict=True), key=lambda x: x[1] * FANOUT ** x[0])
        out = MountainRange(_one(table, "total"), top)
        for level, at, digest in rows:
            out.push(level, at, digest.hex())
        return out.close().records(_one(table, "tree"), _one(table, "total"))

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and each row's number among those of its tree there."""
    part, last, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        trees = np.array(batch.column("tree").to_pylist(), object)
        new = np.concatenate([[trees[0] != last], trees[1:] != trees[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        at = np.arange(n) + np.where(begin < 0, before, -begin)
        last, before = trees[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at)], [*batch.schema.names, "part", "at"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes beside and above each run of leaves from `first` to `last` that its own leaves do not give."""
    for batch in batches:
        row, levels, places = [], [], []
        for r, (first, last, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("first", "last", "total")), strict=True)):
            width = widths(total)
            low, high = first, last + 1  # nodes of the level that the run gives itself
            for level in range(len(width) - 1):
                unit = FANOUT**level
                a = first // unit // FANOUT * FANOUT
                b = min(last // unit // FANOUT * FANOUT + FANOUT, width[level])
                wanted = [*range(a, low), *range(high, b)] if low < high else range(a, b)
                row += [r] * len(wanted)
                levels += [level] * len(wanted)
                places += wanted
                whole = high == width[level]
                low, high = -(-low // FANOUT), -(-high // FANOUT) if whole else high // FANOUT
        index = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(index) for c in _RUN] + [pa.array(levels, pa.int32()), pa.array(places, pa.int64())], [*_RUN, "level", "at"])


def _prove(keep: list[str], paths: bool):
    """For each leaf: the siblings on its way to the root, and the root that its claimed digest leads to with them."""

    def run(leaves: pa.Table, context: pa.Table) -> pa.Table:
        leaves = _leaves(leaves)
        known = _climbed(leaves)
        width, first = known.widths, _one(leaves, "i")
        for x in _one(context, "nodes") or []:
            known.nodes[x["level"], x["at"]] = x["digest"].hex()
        above = [(x["left"], x["right"]) for x in _one(context, "above") or []]
        way: dict[tuple[int, int], tuple[list, str]] = {}
        ends: dict[tuple[int, int, str], str] = {}

        def path(level: int, at: int) -> tuple[list, str]:
            """Siblings on both sides, level by level, and all of them as one text."""
            if level == len(width) - 1:
                return above, "".join(a + b for a, b in above)
            begin = at // FANOUT * FANOUT
            side = lambda a, b: "".join(known.nodes[level, x] for x in range(a, b))
            left, right = side(begin, at), side(at + 1, min(begin + FANOUT, width[level]))
            parent = level + 1, at // FANOUT
            if parent not in way:
                way[parent] = path(*parent)
            rest, text = way[parent]
            return [(left, right), *rest], left + right + text

        def end(level: int, at: int, digest: str, steps: list) -> str:
            """The root, with `steps` from this node on."""
            if not steps:
                return digest
            up = (level + 1, at // FANOUT, _hash([steps[0][0], digest, steps[0][1]]))
            if up not in ends:
                found = end(*up, steps[1:])
                if known.nodes.get(up[:2]) != up[2]:
                    return found  # a tampered way, of no use to others
                ends[up] = found
            return ends[up]

        proofs, folded, whole = [], [], []
        for i, claimed in enumerate(leaves.column("claimed").to_pylist(), first):
            steps, text = path(0, i)
            proofs.append(_hash([text]))
            folded.append(end(0, i, claimed.hex(), steps))
            whole.append([{"left": a, "right": b} for a, b in steps] if paths else None)
        out = [leaves.column(c) for c in keep] + [pa.array(x, pa.string()) for x in (proofs, folded)]
        names = [*keep, "proof_sha256", "folded_root"]
        if paths:
            out, names = [*out, pa.array(whole, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], [*names, "path"]
        return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names)

    return run


class Forest:
    """Trees over leaves (tree, leaf, claimed, columns of `order` and `keep`), those of a tree in the order of `order`, then
    of leaf. `roots` has (tree, total, digest), `records` all inner nodes."""

    def __init__(self, leaves: DataFrame, order: list[str], keep: list[str], kinds: str):
        self.keep, self.kinds = keep, kinds
        columns = list(dict.fromkeys(["tree", *order, *keep, "leaf", "claimed"]))
        leaves = leaves.select(*columns)
        dealt = leaves.repartitionByRange("tree", *order, "leaf").sortWithinPartitions("tree", *order, "leaf")
        numbered = saved(dealt.mapInArrow(_number, f"{', '.join(f'{n} {k}' for n, k in leaves.dtypes)}, part int, at long"), "leaves")
        sums = numbered.groupBy("tree", "part").agg((F.max("at") + 1).alias("n"))
        tree = Window.partitionBy("tree")
        before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = saved(sums.select("tree", "part", before.alias("base"), F.sum("n").over(tree).alias("total")), "parts")
        placed = numbered.join(parts, ["tree", "part"])
        self.leaves = placed.select(*columns, "part", F.expr(f"at div {RUN}").alias("run"), (F.col("base") + F.col("at")).alias("i"), "total")
        nodes = saved(self.leaves.select(*_RUN, "i", "total", "leaf").groupBy(*_RUN).applyInArrow(_climb, _NODE), "nodes")
        self.edges = nodes.where("open")
        self.records = nodes.where("made")
        left, top = nodes.where("open"), STEP
        unfinished = f"total > power({FANOUT}, level)"  # more than one node on its level
        while not left.where(unfinished).isEmpty():
            low = left.where(f"level < {top} and {unfinished}")
            group = F.expr(f"at div cast(power({FANOUT}, {top} - level) as bigint)").alias("group")
            merged = saved(low.select("*", group).groupBy("tree", "group").applyInArrow(_merge(top), _NODE), "nodes")
            left = left.where(f"level >= {top} or not ({unfinished})").union(merged.where("open"))
            self.edges = self.edges.union(merged.where("made"))
            self.records = self.records.union(merged.where("made"))
            top += STEP
        self.roots = left.select("tree", "total", "digest")

    def prove(self, above: DataFrame | None = None, paths: bool = False) -> DataFrame:
        """keep, proof_sha256, folded_root (and path) for each leaf. above: (tree, above) with each tree's own path further up."""
        runs = saved(self.leaves.groupBy(*_RUN).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.first("total").alias("total")), "runs")
        wanted = runs.mapInArrow(_neighbours, "tree string, part int, run long, level int, at long")
        found = wanted.join(self.edges.select("tree", "level", "at", "digest"), ["tree", "level", "at"])
        found = found.groupBy(*_RUN).agg(F.collect_list(F.struct("level", "at", "digest")).alias("nodes"))
        context = runs.select(*_RUN).join(found, _RUN, "left")
        kind = "array<struct<left: string, right: string>>"
        context = context.join(above, "tree", "left") if above is not None else context.withColumn("above", F.lit(None).cast(kind))
        names = ", ".join(x for x in (self.kinds, "proof_sha256 string, folded_root string", f"path {kind}" if paths else "") if x)
        return self.leaves.groupBy(*_RUN).cogroup(context.groupBy(*_RUN)).applyInArrow(_prove(self.keep, paths), names)


def leaf(text: Column | None = None) -> Column:
    """A document's leaf, as 32 bytes; text: what stands for its text."""

    def field(name: str) -> Column:
        value = F.col(name).cast("string") if name != "text" or text is None else text
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, FIELDS)), 256))


class Manifest:
    """The trees of a dataset: `sources` (one a source), `whole` (over their roots), and `proofs`. claimed: the leaf that each
    row is verified with, by default its own."""

    def __init__(self, docs: DataFrame, claimed: Column | None = None):
        workers(docs.sparkSession)
        own = leaf()
        rows = docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("leaf"), (own if claimed is None else claimed).alias("claimed"))
        self.sources = Forest(saved(rows, "digests"), ["doc_id"], ["tree", "doc_id", "leaf"], "tree string, doc_id long, leaf binary")
        roots = self.sources.roots
        self.whole = Forest(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf"), F.col("digest").alias("claimed")), ["name"], ["name", "leaf"], "name string, leaf binary")

    def root(self) -> DataFrame:
        """One row with the root, none for an empty dataset."""
        return self.whole.roots.select(F.lower(F.hex("digest")).alias("root"))

    def proofs(self, paths: bool = False) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and path) for each row."""
        text = lambda c: F.lower(F.hex(c))
        above = saved(self.whole.prove(paths=True).select(F.col("name").alias("tree"), text("leaf").alias("subroot"), F.col("path").alias("above"), F.col("folded_root").alias("root")), "above")
        done = self.sources.prove(above.select("tree", "above"), paths).join(above.select("tree", "subroot", "root"), "tree")
        done = done.withColumn("leaf", text("leaf")).withColumn("verified", F.col("folded_root") == F.col("root"))
        return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["path"] * paths)


def tampered() -> Column:
    """The leaf of a text without line breaks, where 2 divides the CRC-32 of doc_id; else the document's own."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even, leaf(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf())


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Manifest(documents(spark, sf_dir), tampered()).proofs()
