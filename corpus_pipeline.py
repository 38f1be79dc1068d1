"""Corpus pipeline: five stages over `documents`, each one corpus operator.

Every stage gets all that its predecessor kept, and all but the last return the
columns of `documents`:

1. quality rules: rejected documents go;
2. near duplicates: the document with the smallest doc_id of each group stays;
   rejected ones go by doc_id and text;
3. secret scan: secrets give way to a mask in the text;
4. mixing: documents of languages below their target weight appear again, as
   their rates say; none is left out;
5. packing: pieces of sequences of 4096 ids.

Between stages the documents are written as Parquet in the shared folder.

Defined cases, for all stages: a null or empty text fails the quality rules; later
stages keep it as it is, and it packs to the end id alone. A null doc_id is a row
like any. Repeated rows (same doc_id and text) are judged alike; near_dedup keeps
one of them, even where the group's document is no copy of others. Rows of one
doc_id with different texts are different documents. Texts of any length are
handled whole. An empty table gives an empty table with the same columns, packing
no piece. Without labelled documents mixing takes all memberships for equal and
leaves the documents as they are; a missing table `labels` is an error. Columns
of other names pass through all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablesmith.llm.common import documents, saved, table, without
from tablesmith.llm.mixing import mixed_documents
from tablesmith.llm.neardup import near_duplicates
from tablesmith.llm.packing import digest, pack, tokenizer_path
from tablesmith.llm.quality import quality
from tablesmith.llm.secrets import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, quality(docs).where("not kept").select("doc_id", "text_key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, near_duplicates(docs).where("not kept").select("doc_id", "text_key"), once=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(pack(docs, tokenizer_path()))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("packing", packing)]

#: Word histograms, tokenizer ids and the near-duplicate components have no SQL here; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
