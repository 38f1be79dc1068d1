"""Fill-in-middle, repeated bytes and the manifest: plain Python versions, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import bytedup, infill, manifest, runindex
from tablesmith.llm import queries as Q
from tests.llm.conftest import EDGE

SHA = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


# -- plain versions ------------------------------------------------------------


def infilled(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = SHA(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, SHA(text), SHA(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(lines), form, len(p), len(m), SHA(out), SHA(text)


def cut_bytes(rows):
    """(doc_id, text) rows: what is left of each."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49 if i is not None else 0):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49 if i is not None else 0):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def proven(rows):
    """(doc_id, source, lang, n_chars, text) rows: leaf, subroot, root, proof, folded root, verified."""
    leaf = lambda r, text: SHA(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([SHA(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        out = []
        for nodes in tree[:-1]:
            begin = i // 3 * 3
            out.append((nodes[begin:i], nodes[i + 1 : begin + 3]))
            i //= 3
        return out

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for v in by.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r, r[4]) for r in by[s]]) for s in names}
    top, out = levels([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            way = path(trees[s], i) + path(top, k)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for a, b in way:
                node = SHA(*a, node, *b)
            root = top[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, SHA(*[x for a, b in way for x in a + b]), node, node == root))
    return out


# -- whole tables --------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_infill_query(spark, sf_dir, small):
    got = Q.queries()["op11_fill_in_middle"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], *infilled(r[0], r[4])) for r in small)


def test_byte_query(spark, sf_dir, small):
    got = Q.queries()["op12_run_index"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(cut_bytes([(r[0], r[4]) for r in small]))


def test_manifest_query(spark, sf_dir, small):
    got = Q.queries()["op13_manifest"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(proven(small))


# -- defined cases -------------------------------------------------------------


def test_empty_tables(empty):
    assert infill.fill_in_middle(empty).count() == 0
    assert bytedup.repeated_bytes(empty).count() == 0
    tree = manifest.Manifest(empty)
    assert tree.proofs().count() == 0
    assert tree.root().count() == 0


def test_infill_edges(edge):
    got = infill.fill_in_middle(edge).withColumn("back", infill.restored())
    rows = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, SHA(r.output), SHA(r.back)) for r in got.collect())
    assert rows == Counter((i, *infilled(i, t)) for i, t in EDGE)


@pytest.mark.parametrize("text", ["\n", "\n\n\n", "a", "a\n", "é\nß", "x<P>y\n", "<\nP>", "\n<S>", "<S\n>", "a\r\nb", "<P\n<S\n<M\n<", "😀\n" * 700])
def test_infill_texts(spark, text):
    df = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    done = infill.fill_in_middle(df).withColumn("back", infill.restored()).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, SHA(r.output), SHA(r.back)) for r in done if r.form == "plain") == sorted((i, *infilled(i, text)) for i in range(12) if infilled(i, text)[1] == "plain")
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, SHA(r.output), SHA(r.back)) for r in done) == Counter((i, *infilled(i, text)) for i in range(12))


def test_infill_rate_and_collisions(spark, monkeypatch):
    """Fewer documents are cut at a lower rate; texts whose hashes collide keep their own line ends."""
    df = spark.createDataFrame([(i, f"line {i % 7}\n" * (i % 5 + 1)) for i in range(400)], "doc_id long, text string")
    forms = Counter(r.form for r in infill.fill_in_middle(df, rate=30, spm_percent=0).collect())
    assert 60 < forms["psm"] < 180 and not forms["spm"]
    monkeypatch.setattr(infill.F, "xxhash64", lambda *a: F.lit(5).cast("long"))
    got = infill.fill_in_middle(df).collect()
    assert {(r.doc_id, r.n, r.prefix_chars) for r in got} == {(i, infilled(i, t)[0], infilled(i, t)[2]) for i, t in ((i, f"line {i % 7}\n" * (i % 5 + 1)) for i in range(400))}


def test_elias_fano_lists():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 255, 256, 257, 3000):
        for gap in (1, 2, 50, 10_000):
            ends = np.cumsum([rng.randint(1, gap) for _ in range(n)], dtype=np.int64)
            packed = infill.packed_list(ends)
            assert infill.list_size(packed) == n
            assert [infill.entry(packed, k) for k in range(0, n, max(1, n // 90))] == ends[:: max(1, n // 90)].tolist()
    packed = infill.packed_list(np.arange(1, 100_001) * 80)
    assert len(packed) < 100_000 * (2 + 7) / 8 + 8 * 100_000 / infill.SAMPLE + 64


def test_bytes_edges(edge, spark):
    texts = [(i, t) for i, t in EDGE if i not in (6, 7)]  # the long ones are copies: by hand
    got = bytedup.repeated_bytes(edge).collect()
    rows = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in got if r.doc_id not in (6, 7))
    assert rows == Counter(cut_bytes(texts))
    six, seven = (next(r for r in got if r.doc_id == i) for i in (6, 7))
    assert (six.n_removed, seven.n_removed, seven.kept_sha256) == (0, seven.n_bytes, SHA(""))


def test_bytes_of_generated_documents(spark, monkeypatch):
    """Overlaps, nested and repeated passages, split characters; also with blocks, groups and indexes of other sizes."""
    rng = random.Random(5)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.choice([30, 49, 50, 51, 90, 200]))) for _ in range(25)]
    rows = [(rng.randrange(40), "".join(rng.choice([rng.choice(parts), "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6)))) for _ in range(70)]
    tail = "".join(rng.choice("mnop") for _ in range(26))
    for i, gram in enumerate(("q" * 3 + "r" * 21, "qr" * 12, "q" * 24)):  # anchors that stand more than once around one string
        rows += [(60 + 4 * i + j, head + gram + tail + end) for j, (head, end) in enumerate((("", ""), (gram, "x"), (gram[:7], gram), ("z" + gram, "")))]
    rows += [(None, parts[5] * 2), (50, parts[5]), (51, "ab" * 300), (52, "b" + "ab" * 200), rows[3], (53, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter(cut_bytes(rows))
    for block, group, index, most in ((1 << 20, 1 << 21, 1 << 20, 1 << 22), (64, 10, 300, 1 << 22), (200, 1 << 21, 1 << 20, 150)):
        for name, value in (("BLOCK", block), ("GROUP_ANCHORS", group), ("INDEX_BYTES", index), ("MOST_BYTES", most)):
            monkeypatch.setattr(bytedup, name, value)
        got = bytedup.repeated_bytes(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in got) == want
        assert all(sum(x.end - x.begin for x in r.removed) == r.n_removed for r in got)


def test_blocks_give_each_string_once(monkeypatch):
    texts = [np.frombuffer(bytes(random.Random(i).choices(b"abcd", k=n)), np.uint8) for i, n in enumerate((0, 49, 50, 51, 300, 1000))]
    for size in (1, 50, 64, 1 << 20):
        monkeypatch.setattr(bytedup, "BLOCK", size)
        seen = Counter()
        for doc, place, data in bytedup._blocks(texts):
            at, number, _ = bytedup._stretches(data, bytedup.rolling(bytedup._letters(data), bytedup.GRAM))
            for a, n in zip(at, number, strict=True):
                for k in range(a, a + n):
                    assert data[k : k + 50].tobytes() == texts[doc[k]][place[k] : place[k] + 50].tobytes()
                    seen[doc[k], place[k]] += 1
        assert seen == Counter((d, k) for d, t in enumerate(texts) for k in range(len(t) - 49))


def test_blocks_make_small_arrays():
    """A block's arrays of 64-bit numbers stay below the size from which each is mapped anew (common.workers), also for a long text."""
    texts = [np.full(n, 97, np.uint8) for n in (3, 40_000, 200_000, 60, 0)]
    assert max(8 * len(data) for *_, data in bytedup._blocks(texts)) < 1 << 20


def test_index_has_sources_and_losers_only(monkeypatch):
    """One of two passages with an anchor is indexed, the other streamed; the runs are those of an index of all."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abc ") for _ in range(70)).encode() for _ in range(12)]
    rows = []
    for anchor, text in enumerate(base):
        for _ in range(rng.randint(1, 4)):
            docs = sorted(rng.choices(range(9), k=rng.randint(1, 3)))
            at = rng.randrange(70)
            rows.append((anchor, rng.randrange(1 << 60), text[:at] + rng.choice([b"", b"x"]) + text[at:], docs[0], docs[-1]))
    rows += [(99, 1, b"p" * 60, 1, 1), (99, 2, b"p" * 61, 2, 2)]
    rng.shuffle(rows)
    table = pa.Table.from_pylist([dict(zip(("anchor", "content_key", "content", "first", "last"), r, strict=True)) for r in rows])
    held = []

    class Seen(runindex.RunIndex):
        def __init__(self, passages, docs):
            held.append(len(passages))
            super().__init__(passages, docs)

        def least_document(self, texts):
            held.append(len(texts))
            return super().least_document(texts)

    monkeypatch.setattr(bytedup, "RunIndex", Seen)
    strings = lambda t: {(r["anchor"], r["content_key"], r["offset"] + k, r["source"]) for r in t.to_pylist() for k in range(r["n"])}
    want = set()
    for anchor, key, text, _, last in rows:
        for k in range(len(text) - 49):
            source = min(f for _, _, t, f, _ in rows if text[k : k + 50] in t)
            want |= {(anchor, key, k, source)} if source < last else set()
    assert strings(bytedup._matched(table)) == want
    assert max(held) < len(rows)
    held.clear()
    assert len(strings(bytedup._matched(table.filter(pc.equal(table["anchor"], 99))))) == 12
    assert held == [1, 1]
    assert bytedup._matched(table.slice(0, 0)).num_rows == 0


def test_known_anchors_of_batches_are_apart():
    """Anchors that several rows of a batch have only pass through: no group gathers those of many batches."""
    text = "".join(random.Random(6).choices("abcdefgh ", k=400))
    batches = [pa.RecordBatch.from_pydict({"row_key": [2 * i + 1, 2 * i + 1001], "text": [text, text + "!"]}) for i in range(60)]
    groups = Counter(g for b in bytedup._anchors(2)(iter(batches)) for g in b.column("group").to_pylist() if g < 0)
    assert len(groups) == 60


def test_run_index_statistics():
    """Longest matches and least documents against a search of all passages."""
    rng = random.Random(3)
    for _ in range(25):
        letters = rng.choice(["ab", "abcé", "a"])
        base = "".join(rng.choice(letters) for _ in range(400)).encode()
        passages = set()
        for _ in range(rng.randint(1, 25)):
            a = rng.randrange(300)
            p = bytearray(base[a : a + rng.randint(50, 90)])
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = ord("a")
            passages.add(bytes(p))
        passages = list(passages)
        docs = np.array([rng.randrange(10) for _ in passages])
        index = runindex.RunIndex(passages, docs)
        texts = [*passages, bytes(rng.choice(b"abc") for _ in range(80)), b"", b"zzz"]
        flat = b"".join(texts)
        lengths, _ = index.statistics(texts)
        place, least = index.least_document(texts)
        found, at = dict(zip(place.tolist(), least.tolist(), strict=True)), 0
        for t in texts:
            for i in range(len(t)):
                want = next((k for k in range(min(runindex.MOST, len(t) - i), 0, -1) if any(t[i : i + k] in p for p in passages)), 0)
                assert lengths[at + i] == want
                if i + 50 <= len(t):
                    holding = [d for p, d in zip(passages, docs, strict=True) if t[i : i + 50] in p]
                    assert found.get(at + i) == (min(holding) if holding else None)
            at += len(t)
        assert len(flat) == at


def test_run_index_is_small_for_copies():
    base = bytes(random.Random(2).choices(b"abcdefgh ", k=300))
    copies = [base[:100] + bytes([i, i]) + base[100:] for i in range(97, 122)]
    one, many = (runindex.RunIndex(x, np.arange(len(x))) for x in (copies[:1], copies))
    assert len(many.data) == 25 * len(one.data)
    assert len(many.start) < 3 * len(one.start)


def test_manifest_edges(edge):
    rows = [(i, "s", None if i == 4 else "en", len(t or ""), t) for i, t in EDGE]
    got = manifest.Manifest(edge, manifest.tampered()).proofs().collect()
    assert Counter(map(tuple, got)) == Counter(proven(rows))


@pytest.mark.parametrize(("run", "step"), [(1, 1), (4, 2), (7, 6), (1 << 14, 6)])
def test_manifest_of_any_sizes(spark, monkeypatch, run, step):
    """Sources of 1 to 100 rows, null and empty ones, one with most rows; runs that begin anywhere."""
    monkeypatch.setattr(manifest, "RUN", run)
    monkeypatch.setattr(manifest, "STEP", step)
    rng = random.Random(4)
    sizes = {None: 5, "": 1, "é": 2, "z": 3, "hot": 100, "A": 10, "b": 27, "10": 9, "9": 28}
    rows = [(rng.choice([None, rng.randrange(60)]), s, rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", f"text {k}\n"])) for s, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    made = manifest.Manifest(df, manifest.tampered())
    assert sorted(map(repr, map(tuple, made.proofs().collect()))) == sorted(map(repr, proven(rows)))
    widths = {k: manifest.widths(n) for k, n in sizes.items()}
    assert made.sources.records.count() == sum(sum(w[1:]) for w in widths.values())
    assert made.root().first().root == proven(rows)[0][3]


def test_manifest_paths_prove_rows(spark):
    df = spark.createDataFrame([(i, "s" if i % 4 else "t", None, i, f"text {i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    for r in manifest.Manifest(df).proofs(paths=True).collect():
        node = r.leaf
        for x in r.path:
            node = SHA(x.left, node, x.right)
        assert node == r.root and r.verified


def test_mountain_range_leaves_shared_runs_open():
    """Leaves 4 to 10 of 20: 4, 5 and 9, 10 belong to runs of others; 6 to 8 are one."""
    made = manifest.MountainRange(20)
    for i in range(4, 11):
        made.push(0, i, SHA(str(i)))
    made.close()
    assert made.made == [(1, 2)]
    assert sorted(made.open) == [(0, 4), (0, 5), (0, 9), (0, 10), (1, 2)]
