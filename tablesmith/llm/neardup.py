"""MinHash near-deduplication with bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles, as 63-bit hashes; the k
smallest of them are its sketch. Documents with equal sets (equal 128-bit sums
over the set) form a class, and only one document of a class goes on.

Candidates come from inverted lists of retained values. A pair that is similar
enough shares at least `need` retained values, so it shares one among the
`size - need + 1` that are rarest in the corpus: only those are listed. Values
that many documents hold come last in that order and are listed only for
documents that have little else. The overlap in the sketch of the union
estimates similarity and thins the pairs out; the full sets decide.

Lists up to SHORT_LIST give all their pairs. Documents on longer lists take an
exact way instead, whatever their number: their full sets are ordered by rarity
among them and listed by prefix. Each list is compared with one leader, the
member with the most common shingles; who is not linked to it gets another
leader, and after LEADER_ROUNDS only members that lie in different components
of the links so far are still compared. So a group of near copies costs about
one comparison for each member, and no link between components is lost.

Defined cases: a null, empty or blank text has no set and is linked with
nothing; fewer words than a shingle give one shingle; repeated rows share their
component; rows of one doc_id with different texts are documents of their own;
a null doc_id is linked with nothing and its component is null; a text of any
length has its whole set; an empty table gives no row; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import Words, components, documents, member_filter, mixed, ragged, rolling, saved, slices, text_key, workers

SHINGLE = 5
#: Least similarity in percent.
PERCENT = 85
SKETCH = 64
#: Chance that a pair just similar enough is missed by the inverted lists, and again by the estimate.
MISS = 1e-6
SHORT_LIST = 32
LEADER_ROUNDS = 3


def least_overlap(percent: int, k: int, miss: float = MISS) -> int:
    """The number of values of a union's sketch that a pair at `percent` has in common, but for a chance of `miss`: each of
    the k values is in both sets with that probability."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > miss:
            return c
    return k


def shingle_sets(texts, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    import pyarrow.compute as pc

    words = Words(pc.ascii_lower(texts))
    each = words.hashes()
    whole = rolling(each, width) >> np.uint64(1)
    for i in range(len(texts)):
        a, b = words.start[i], words.start[i + 1]
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            yield rolling(each[a:b], int(b - a), seed=int(b - a)) >> np.uint64(1)
        else:
            yield np.zeros(0, np.uint64)


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, sums, kept = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                sums.append(_set_sums(s))
                kept.append(s[:k])
            a, b = np.array(sums, np.uint64).reshape(-1, 2).T
            values = np.concatenate(kept).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(a.copy().view(np.int64)), pa.array(b.copy().view(np.int64)), ragged(values, [len(x) for x in kept], pa.int64())], ["doc_id", "text_key", "n", "f1", "f2", "sketch"])

    return run


def _set_sums(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return np.add.reduce(mixed(s)), np.add.reduce(mixed(~s))


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), width))
            sums = np.array([_set_sums(s)[0] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums), ragged(np.concatenate(sets).astype(np.int64), [len(s) for s in sets], pa.int64())], ["doc_id", "f1", "items"])

    return run


#: A node of the links: the smallest doc_id of a class, with its set's first sum, as rows of one doc_id may have several texts.
_NODE = "struct<doc_id:bigint,f1:bigint>"


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _sizes_fit(m: str, n: str, percent: int) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def _prefix_lists(reps: DataFrame, percent: int, k: int) -> DataFrame:
    """(value, rep, n) for each retained value among the rarest of its sketch."""
    each = reps.select("rep", F.explode("sketch").alias("value"))
    # aggregates are written before a join, so that both of its sides are dealt by the key and a hot one can be split
    common = saved(each.groupBy("value").agg(F.count("*").alias("df")).where(F.col("df") >= SHORT_LIST), "common")
    held = each.join(common, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    # Up to this size a partner's sketch is its whole set too, so that the least overlap is exact.
    exact = F.col("n") * 100 <= k * percent
    need = F.when(exact, F.ceil(F.col("n") * percent / 100)).otherwise(F.ceil(F.size("sketch") * least_overlap(percent, k) / k))
    values = F.coalesce(F.col("common").getField("value"), F.array().cast("array<bigint>"))
    ordered = F.concat(F.array_except("sketch", values), values)
    prefix = F.slice(ordered, F.lit(1), (F.size("sketch") - need + 1).cast("int"))
    return reps.join(held, "rep", "left").select("rep", "n", F.explode(prefix).alias("value"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("rep").alias("a"), F.col("items").alias("of_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("items").alias("of_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("of_a"), batch.column("of_b")
            xs, ys = (c.flatten().to_numpy(zero_copy_only=False) for c in (x, y))
            xo, yo = (c.offsets.to_numpy() - c.offsets[0].as_py() for c in (x, y))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(check, f"a {_NODE}, b {_NODE}").distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose overlap in the sketch of their union is large enough."""
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("union", union).withColumn("in_both", F.size(F.array_intersect(F.array_intersect("sa", "sb"), "union")))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    # Sets that fit in a sketch are compared in full by the verification; the estimate would cut their union.
    return both.where(whole | (F.col("in_both") >= F.size("union") * least_overlap(percent, k) / k)).where(_sizes_fit("na", "nb", percent)).select("a", "b")


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(item, rep, n, at, weight): the prefix of each full set in the order of rarity."""
    each = sets.select("rep", F.size("items").cast("long").alias("n"), F.explode("items").alias("item"))
    df = saved(each.groupBy("item").agg(F.count("*").alias("df")), "items")
    # a set is there as often as its row is repeated
    ordered = each.join(df, "item").groupBy("rep", "n").agg(F.array_sort(F.collect_set(F.struct("df", "item"))).alias("s"), F.avg("df").alias("weight"))
    prefix = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    return ordered.select("rep", "n", "weight", F.posexplode(prefix).alias("at", "e")).select("rep", "n", "weight", "at", F.col("e.df").alias("df"), F.col("e.item").alias("item")).where("df > 1")


def _may_link(x: str, y: str, percent: int) -> Column:
    """False where a shared item at these places leaves too few items behind it."""
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
    # A pair may meet at several items; the first of them is the earliest in both.
    return left * (100 + percent) >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _dense_links(lists: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links among documents on long lists, enough of them for the components."""
    left, found = lists, []
    for _ in range(LEADER_ROUNDS):
        top = left.groupBy("item").agg(F.max(F.struct("weight", "rep", "n", "at")).alias("top"), F.count("*").alias("members")).where("members > 1")
        top = saved(top.select("item", F.col("top.rep").alias("leader"), F.col("top.n").alias("ln"), F.col("top.at").alias("lat")), "leaders")
        led = saved(left.join(top, "item"), "led")
        fit = (F.least(F.col("n") - F.col("at"), F.col("ln") - F.col("lat")) * (100 + percent) >= percent * (F.col("n") + F.col("ln"))) & (F.col("rep") != F.col("leader"))
        pairs = saved(led.where(fit).select(*_pair("rep", "leader")).distinct(), "pairs")
        if pairs.isEmpty():
            break
        linked = saved(_verify(pairs, sets, percent), "edges")
        found.append(linked)
        edge = linked.select("a", "b", F.lit(True).alias("linked"))
        after = led.where("rep <> leader").select("*", *_pair("rep", "leader")).join(edge, ["a", "b"], "left")
        left = saved(after.where("linked is null").select(*lists.columns), "lists")
    for x in found:
        links = links.union(x)
    label = components(links)
    known = lists.join(label, lists.rep == label.node, "left").select(*lists.columns, F.coalesce("component", "rep").alias("component"))
    known = saved(known, "labelled")
    counted = known.groupBy("item", "component").agg(F.count("*").alias("c"))
    main = counted.groupBy("item").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("kinds")).where("kinds > 1").select("item", F.col("m.component").alias("main"))
    main = saved(main, "main")
    outside = known.join(main, "item").where("component <> main")
    x, y = outside.alias("x"), known.alias("y")
    pairs = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y", percent) & _sizes_fit("x.n", "y.n", percent))
    rest = _verify(saved(pairs.select(*_pair("x.rep", "y.rep")).distinct(), "pairs"), sets, percent)
    return links.union(rest)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """One row for each document: doc_id, text_key (hash of the text), n_shingles, component_id, kept."""
    workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    sketched = saved(rows.mapInArrow(_sketches(width, k), "doc_id long, text_key long, n long, f1 long, f2 long, sketch array<long>"), "sketches")
    some = sketched.where("n > 0 and doc_id is not null")
    classes = some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = saved(classes.select("*", F.struct("doc_id", "f1").alias("rep")).drop("doc_id"), "classes")
    reps = classes.select("rep", "n", "sketch")

    postings = saved(_prefix_lists(reps, percent, k), "postings")
    lengths = saved(postings.groupBy("value").agg(F.count("*").alias("members")).where("members > 1"), "lengths")
    listed = saved(postings.join(lengths, "value"), "listed")
    lists = listed.where(F.col("members") <= SHORT_LIST).groupBy("value").agg(F.collect_list(F.struct("rep", "n")).alias("l"))
    two = lists.select(F.explode("l").alias("x"), "l").select("x", F.explode("l").alias("y")).where("x.rep < y.rep").where(_sizes_fit("x.n", "y.n", percent))
    pairs = saved(two.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "pairs")
    dense = saved(listed.where(F.col("members") > SHORT_LIST).select("rep").distinct(), "dense")

    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
    pairs = saved(_estimated(pairs, reps.where(member_filter(ends, "rep")), percent, k), "estimated")
    needed = pairs.select("a.doc_id").union(pairs.select("b.doc_id")).union(dense.select("rep.doc_id"))
    sets = rows.where(member_filter(needed, "doc_id")).mapInArrow(_full_sets(width), "doc_id long, f1 long, items array<long>")
    sets = saved(sets.select(F.struct("doc_id", "f1").alias("rep"), "items"), "sets")
    links = saved(_verify(pairs, sets, percent), "edges")
    if not dense.isEmpty():
        links = _dense_links(saved(_rare_first(sets.join(dense, "rep"), percent), "prefixes"), sets, links, percent)
    label = components(links)

    member = sketched.join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left").join(label, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component.doc_id", "rep.doc_id")).otherwise(F.col("doc_id"))
    member = member.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return member.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")
