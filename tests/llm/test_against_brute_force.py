"""Registered queries on the small table against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import queries as Q
from tests.llm import brute


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    done = {}

    def get(name):
        if name not in done:
            done[name] = [r.asDict() for r in Q.queries()[name](spark, sf_dir).collect()]
        return done[name]

    return get


def test_all_operators():
    found = {int(n[2:].split("_")[0]) for n in Q.queries() if n.startswith("op")}
    assert found == set(range(1, 14))


def test_quality(rows, texts):
    got = {r["doc_id"]: r for r in rows("op1_quality")}
    assert len(got) == len(texts)
    for i, t in texts.items():
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)
        assert not (r["base_failed"] and r["kept"])


def test_licenses(rows, texts):
    from tablesmith.llm.licenses import PHRASES

    got = {r["doc_id"]: r for r in rows("op2_licenses")}
    for i, t in texts.items():
        places, r = brute.phrases(t, PHRASES), got[i]
        assert (r["n_words"], r["n_base"]) == (len(brute.license_words(t)), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        assert ("apache-2.0" in r["labels"]) == ("Apache License, Version 2.0" in t)


def test_near_duplicates(rows, texts):
    want = brute.components(texts)
    got = {r["doc_id"]: r for r in rows("op4_near_duplicates")}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(brute.shingles(texts[i])) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_packing(rows, texts):
    from tokenizers import Tokenizer

    from tablesmith.llm.packing import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in texts.items()}
    pieces = sorted(rows("op5_packing"), key=lambda r: (r["sequence_id"], r["offset"]))
    at = {i: 0 for i in ids}
    place, sequence = 0, 0
    for p in pieces:
        if p["sequence_id"] != sequence:
            assert place == 4096
            place, sequence = 0, sequence + 1
        assert (p["sequence_id"], p["offset"]) == (sequence, place)
        piece = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(piece) == p["length"] > 0
        assert p["start"] == at[p["doc_id"]]
        assert p["ids_crc32"] == zlib.crc32(piece.tobytes())
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        at[p["doc_id"]] += p["length"]
        place += p["length"]
    assert at == {i: len(x) for i, x in ids.items()}


def test_secrets(rows, texts):
    got = {r["doc_id"]: r for r in rows("op6_secrets")}
    for i, t in texts.items():
        base = brute.secrets(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [base.count(f"{k}:") for k in ("assign", "access", "hex")]


def test_substrings(rows, texts):
    want = brute.substrings(texts)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows("op7_substrings")} == want


def test_crf_accuracy_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"  # the small table has 19 such documents
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r.asDict() for r in Q.queries()["op8_line_crf"](spark, sf_dir).collect()]
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    tested = [r for r in got if r["held_out"] and quality.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == quality[r["doc_id"]] for r in tested]) >= 0.95


def test_mixing_meets_the_targets(rows):
    from tablesmith.llm.mixing import TARGETS

    got = rows("op9_mixing")
    tokens = {d: sum(r["n_tokens"] * r["rate"] * r[f"p_{d}"] for r in got) for d in TARGETS}
    for d, w in TARGETS.items():
        assert abs(tokens[d] / sum(tokens.values()) - w) < 1e-3
    assert all(abs(r["copies"] - r["rate"]) < 1 and r["rate"] >= 0 for r in got)
    assert all(abs(sum(r[f"p_{d}"] for d in TARGETS) - 1) < 1e-9 for r in got)


def test_memberships(spark, sf_dir, rows, texts):
    """Naive Bayes in plain Python on the same training documents and word buckets."""
    from tablesmith.llm import mixing

    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    vocabulary = sorted({w for t in texts.values() for w in brute.words((t or "").lower())})
    hashed = spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.pmod(F.hash("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()
    domains = sorted(mixing.TARGETS)
    trained = [(langs[i], texts[i]) for i in sorted(good) if langs[i] in domains]
    want = brute.bayes(trained, list(texts.values()), {r.w: r.b for r in hashed}, domains, mixing.BUCKETS, mixing.SMOOTHING, mixing.EVIDENCE_WORDS)
    got = {r["doc_id"]: [r[f"p_{d}"] for d in domains] for r in rows("op9_mixing")}
    assert np.allclose([got[i] for i in texts], want, atol=1e-9)


def test_fingerprints(rows, texts):
    got = {r["doc_id"]: r for r in rows("op10_fingerprints")}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        new = brute.edited(texts[i], texts[j])
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert got[i]["n_chars"] == len(texts[i])
        assert [got[i]["fingerprint"], got[i]["edited_fingerprint"]] == [brute.fingerprint(t.encode()) for t in (texts[i], new)]
        assert abs(got[i]["near_edited"] - brute.likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"])) < 1e-9
        assert abs(got[i]["near_next"] - brute.likeness(got[i]["fingerprint"], got[j]["fingerprint"])) < 1e-9
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert np.median([r["near_edited"] for r in long]) > 0.5 > 0.1 > np.median([r["near_next"] for r in long])


def test_pseudonyms(rows, texts):
    import re

    got = {r["doc_id"]: r for r in rows("op3_pseudonyms")}
    pattern = r"[a-z.0-9]+@[a-z0-9.]+\.com|(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)|\+1 \(\d{3}\) \d{3}-\d{4}"
    for i, t in texts.items():
        before, after = re.findall(pattern, t), re.findall(pattern, got[i]["text"])
        assert len(before) == len(after)
        assert not set(before) & set(after)
        assert len(t) == len(got[i]["text"]) or got[i]["n_ip"]
