"""Secret scans with a trigram inverted index. DataFrame functions only.

The index of a corpus lists, for every trigram of lower-cased text, the texts that
hold it (by hash of the text, so copies count once). Trigrams in STOP_SHARE of the
texts or more would hardly thin anything out and are not listed; which these are
is found on a sample of SAMPLE_TEXTS texts, those with the smallest hash. The
index stays in its folder: other rules read only its postings and the texts that
these name, and `add` takes further documents.

Each rule's regex is turned into a Boolean query over trigrams: clauses that all
must hold, each a choice of trigram sets of which one must occur whole. Trigrams
that are not listed are taken for present. The postings of a query's trigrams
meet in a join and are counted by text, choice and clause. Texts that fulfil a
query are candidates, which are verified with the regex itself. Rules without
mandatory trigrams that are listed read all texts instead.

Spans are in code points, end exclusive, leftmost and non-overlapping per rule.
Rules with a least length for a run that can't be longer (`{24,}` and the like)
find what the open pattern finds and keeps.

Defined cases: a null or empty text has no spans; repeated rows get the same
spans each; a null doc_id is scanned like any; a text of any length is indexed and
scanned whole; documents that an index given by the caller does not know are only
found by rules that read all texts; an empty table gives no row; other columns are
ignored by `scan` and kept by `redacted`."""

from __future__ import annotations

import functools
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import documents, member_filter, saved, shared_dir, spare, text_key

#: Trigrams in so large a share of the sampled texts are not listed.
STOP_SHARE = 0.02
#: And in so many of them more, as in a few texts any trigram has a large share.
LEAST_COMMON = 10
#: Texts that this is found on.
SAMPLE_TEXTS = 5000
#: Alternatives that a clause may have; a larger choice is no condition.
MOST_CHOICES = 64
#: Letters of a character class that count as alternatives.
MOST_LETTERS = 8
MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    """group and least: the match stands if that group has so many characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]+@"),
)
BASE = ("assign", "access", "hex")


# -- Boolean trigram queries -------------------------------------------------

#: A part of a regex: the letters that one place can have (None: too many), parts in a row, a choice, a repetition.
Part = tuple

_SIGN = re.compile(
    r"""\\x(?P<hex>[0-9a-fA-F]{2}) | \\(?P<named>[a-zA-Z0-9]) | \\(?P<escaped>.) | (?P<open>\((?:\?(?:[a-z]+(?:-[a-z]+)?)?:|\?[=!]|\?<[=!])?) | (?P<close>\))
    | (?P<many>[*+?]|\{\d+(?:,\d*)?\})[?+]? | (?P<set>\[\^?\]?(?:\\.|[^\]\\])*\]) | (?P<bar>\|) | (?P<edge>[\^$]) | (?P<any>\.) | (?P<plain>.)""",
    re.VERBOSE | re.DOTALL,
)


def _parts(regex: str) -> Part:
    """The parts of a regex of the usual signs: letters, sets, groups, choices and repetitions."""
    stack: list[tuple[str, list[list[Part]]]] = [("(", [[]])]
    for m in _SIGN.finditer(regex):
        kind, row = m.lastgroup, stack[-1][1][-1]
        if kind == "open":
            stack.append((m["open"], [[]]))
        elif kind == "close":
            opened, choices = stack.pop()
            if not opened.startswith(("(?=", "(?!", "(?<")):  # what is looked at is no part of the match
                stack[-1][1][-1].append(("choice", [("row", x) for x in choices]))
        elif kind == "bar":
            stack[-1][1].append([])
        elif kind == "many":
            low, _, high = {"*": "0,", "+": "1,", "?": "0,1"}.get(m["many"], m["many"].strip("{}")).partition(",")
            most = int(high) if high else int(low) if "," not in m["many"] and m["many"][0] == "{" else None
            row.append(("many", int(low), most, row.pop()))
        elif kind != "edge":
            row.append(("letter", _letters(m)))
    return ("choice", [("row", x) for x in stack[0][1]])


def _letters(m: re.Match) -> frozenset[str] | None:
    """The letters, in lower case, that one place of a match can have; None if there are many."""
    if m["hex"]:
        return frozenset({chr(int(m["hex"], 16)).lower()})
    if m["set"] is None:
        return None if m["any"] or m["named"] else frozenset({(m["escaped"] or m["plain"]).lower()})
    body = m["set"][1:-1]
    if body.startswith("^"):
        return None
    found: set[str] = set()
    for x in re.finditer(r"(\\?.)-(\\?.)|\\(.)|(.)", body, re.DOTALL):
        if x[1]:
            a, b = ord(x[1][-1]), ord(x[2][-1])
            found |= {chr(c).lower() for c in range(a, min(b, a + MOST_LETTERS) + 1)}
        elif x[3] and x[3].isalnum():
            return None
        else:
            found.add((x[3] or x[4]).lower())
    return frozenset(found) if len(found) <= MOST_LETTERS else None


def _listed(part: Part) -> set[str] | None:
    """All strings that a part matches, or None."""
    match part:
        case ("letter", letters):
            return letters and set(letters)
        case ("row", parts):
            out = {""}
            for p in parts:
                more = _listed(p)
                if more is None or len(out) * len(more) > MOST_CHOICES:
                    return None
                out = {a + b for a in out for b in more}
            return out
        case ("choice", parts):
            found = [_listed(p) for p in parts]
            return None if None in found else set().union(*found)
        case ("many", low, most, p):
            one = _listed(p)
            if one is None or most != 1 and (low != most or low > 3):
                return None
            return one | {""} if low == 0 else _listed(("row", [p] * low))


class _Walk:
    """Collects a regex's clauses. `exact` has all strings that the part read
    since the last open end can match, each in lower case."""

    def __init__(self) -> None:
        self.exact, self.clauses = {""}, []

    def cut(self) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in self.exact}
        if all(sets):
            self.clauses.append(sets)
        self.exact = {""}

    def read(self, part: Part) -> None:
        strings = _listed(part)
        if strings is not None and len(self.exact) * len(strings) <= MOST_CHOICES:
            self.exact = {a + b for a in self.exact for b in strings}
            return
        match part:
            case ("row", parts):
                for p in parts:
                    self.read(p)
            case ("choice", [only]):
                self.read(only)
            case ("many", low, _, p) if low:
                for _ in range(min(low, 3)):
                    self.read(p)
                self.cut()
            case _:
                self.cut()
                self.exact = strings if strings is not None and len(strings) <= MOST_CHOICES else {""}


def trigram_query(regex: str) -> list[set[frozenset[str]]]:
    """Clauses that all hold for a text with a match: of each, one set's trigrams
    all occur in the lower-cased text. Empty: no condition."""
    walk = _Walk()
    walk.read(_parts(regex))
    walk.cut()
    return walk.clauses


# -- index -------------------------------------------------------------------


def _trigrams(docs: DataFrame) -> DataFrame:
    """(text_key, trigram) for the different trigrams of each text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return docs.select(text_key().alias("text_key"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1)))).alias("trigram"))


class TrigramIndex:
    """Postings of a corpus, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, path: str, sample: int = SAMPLE_TEXTS, share: float = STOP_SHARE) -> TrigramIndex:
        index = cls(docs.sparkSession, path)
        keys = docs.select(text_key().alias("text_key")).distinct().orderBy(F.xxhash64("text_key"), "text_key").limit(sample)
        keys = saved(keys, "sample")  # `sample` rows of one number
        some = docs.join(F.broadcast(keys), text_key() == keys.text_key, "left_semi")
        counted = _trigrams(some).distinct().groupBy("trigram").agg(F.count("*").alias("n"))
        counted.where(F.col("n") >= share * keys.count() + LEAST_COMMON).select("trigram").write.parquet(f"{index.path}/common")
        index.add(docs)
        return index

    def add(self, docs: DataFrame) -> None:
        """Lists further documents."""
        common = self.spark.read.schema("trigram string").parquet(f"{self.path}/common")
        postings = _trigrams(docs).join(common, "trigram", "left_anti").distinct()
        postings.select("trigram", "text_key").sortWithinPartitions("trigram").write.mode("append").option("compression", "zstd").parquet(f"{self.path}/postings")

    def candidates(self, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[int]]:
        """(text_key, wanted): texts that fulfil queries, with the numbers of their rules; and the rules that read all texts."""
        queries = {i: trigram_query(r.regex) for i, r in enumerate(rules)}
        needed = {t for q in queries.values() for clause in q for s in clause for t in s}
        common = self.spark.read.schema("trigram string").parquet(f"{self.path}/common")
        free = {r.trigram for r in common.where(F.col("trigram").isin(sorted(needed))).collect()} if needed else set()  # of the rules' own
        listed = {i: [c for clause in q if all(c := {frozenset(s - free) for s in clause})] for i, q in queries.items()}
        # fixed values of the rules, whatever the number of documents
        conditions = [(t, i, c, a, len(s)) for i, q in listed.items() for c, clause in enumerate(q) for a, s in enumerate(sorted(map(sorted, clause))) for t in s]
        query = self.spark.createDataFrame(conditions, "trigram string, rule int, clause int, choice int, needed int")
        clauses = self.spark.createDataFrame([(i, len(q)) for i, q in listed.items() if q], "rule int, clauses int")
        postings = self.spark.read.schema("trigram string, text_key long").parquet(f"{self.path}/postings").where(F.col("trigram").isin(sorted({c[0] for c in conditions})))
        # a text that was added again is listed again
        met = postings.distinct().join(F.broadcast(query), "trigram").groupBy("text_key", "rule", "clause", "choice", "needed").agg(F.count("*").alias("n")).where("n = needed")
        met = met.groupBy("text_key", "rule").agg(F.count_distinct("clause").alias("met")).join(F.broadcast(clauses), "rule").where("met = clauses")
        return met.groupBy("text_key").agg(F.collect_set("rule").alias("wanted")), [i for i, q in listed.items() if not q]


# -- scan --------------------------------------------------------------------


def _spans(text: Column, rule: Rule) -> Column:
    """(start, end) of all matches: the lengths of the parts between matches and of the matches add up."""
    between, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    each = F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.struct(F.length(F.get(between, i)).alias("gap"), F.length(F.get(found, i)).alias("len"), (F.length(F.get(tested, i)) >= rule.least).alias("ok")))
    nothing = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    start, end = lambda acc, x: acc.at + x.gap, lambda acc, x: acc.at + x.gap + x.len
    step = lambda acc, x: F.struct(end(acc, x).alias("at"), F.concat(acc.out, F.array(F.struct(start(acc, x).alias("start"), end(acc, x).alias("end"), x.ok.alias("ok")))).alias("out"))
    each = F.when(F.size(found) > 0, each)
    all_found = F.coalesce(F.aggregate(each, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc.out), nothing)
    return F.transform(F.filter(all_found, lambda x: x.ok), lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))


def _numbered(spans: Column, i: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(i).alias("kind"), s.end.alias("end")))


def _matches(text: Column, rules: list[tuple[int, Rule]], wanted: Column | None = None) -> Column:
    """Spans of the rules, as (start, kind number, end); wanted: numbers of the rules to try."""
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for i, rule in rules:
        if_any = F.rlike(text, F.lit(rule.regex)) if wanted is None else F.array_contains(wanted, i)
        spans = F.when(if_any, _spans(text, rule)).otherwise(nothing)
        parts.append(_numbered(spans, i))
    return functools.reduce(F.concat, parts) if parts else F.array().cast("array<struct<start:int,kind:int,end:int>>")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: TrigramIndex | None = None) -> DataFrame:
    """One row for each document: doc_id, text_key (hash of its text) and spans,
    an array of (start, kind, end) in order; kind is the rule's number. index: one
    that knows the documents; else it is built."""
    index = index or TrigramIndex.build(docs, f"{shared_dir(docs.sparkSession)}/trigrams-{uuid.uuid4().hex}")
    candidates, whole = index.candidates(rules)
    candidates = saved(candidates, "candidates")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key"))
    read = rows.select("doc_id", "text_key", _matches(F.col("text"), [(i, rules[i]) for i in whole]).alias("spans"))
    # written, so that a text with very many copies can be split in the join
    some = rows.where(member_filter(candidates, "text_key")).join(candidates, "text_key").dropDuplicates(["doc_id", "text_key"])
    narrow = [(i, r) for i, r in enumerate(rules) if i not in whole]
    verified = some.select("doc_id", "text_key", _matches(F.col("text"), narrow, F.col("wanted")).alias("more")).where("size(more) > 0")
    out = read.alias("r").join(saved(verified, "verified").alias("v"), F.expr("r.text_key = v.text_key and r.doc_id <=> v.doc_id"), "left")
    more = F.coalesce("v.more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return out.select("r.doc_id", "r.text_key", F.array_sort(F.concat("r.spans", more)).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: TrigramIndex | None = None) -> DataFrame:
    """The documents with their columns; each secret's characters give way to MASK, and n_chars follows."""
    key, found_id, found_key, found_spans = (spare(docs, n) for n in ("_key", "_found_id", "_found_key", "_spans"))
    found = scan(docs, rules, index).where("size(spans) > 0").dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": found_id, "text_key": found_key, "spans": found_spans})
    found = saved(found, "found")
    keyed = docs.withColumn(key, text_key())
    maybe = member_filter(found, found_key, on=key)
    some = keyed.where(maybe).join(found, (F.col(key) == F.col(found_key)) & F.col("doc_id").eqNullSafe(F.col(found_id)), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, s.start - acc.at), F.lit(MASK))).otherwise(acc.out).alias("out"))
    text = F.aggregate(found_spans, start, step, lambda acc: F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, F.length("text"))))
    hit = F.col(found_spans).isNotNull()
    some = some.withColumn("text", F.when(hit, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return keyed.where(~maybe).select(*docs.columns).union(some.select(*docs.columns))


def _text(kinds: list[str], only: tuple[str, ...] | None = None) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    spans = F.col("spans") if only is None else F.filter("spans", lambda s: s.kind.isin([kinds.index(k) for k in only]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in RULES]
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == kinds.index(k))).cast("long").alias(f"n_{k}")
    return scan(documents(spark, sf_dir)).select("doc_id", *map(count, BASE), F.sha2(_text(kinds, BASE), 256).alias("base_sha256"), _text(kinds).alias("spans"))
