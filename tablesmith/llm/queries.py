"""Registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablesmith.llm.bytedup import op12_run_index
from tablesmith.llm.crf import op8_line_crf
from tablesmith.llm.fingerprints import op10_fingerprints
from tablesmith.llm.infill import op11_fill_in_middle
from tablesmith.llm.licenses import op2_licenses
from tablesmith.llm.manifest import op13_manifest
from tablesmith.llm.mixing import op9_mixing
from tablesmith.llm.neardup import op4_near_duplicates
from tablesmith.llm.oracle_sql import SQL
from tablesmith.llm.packing import op5_packing
from tablesmith.llm.pii import op3_pseudonyms
from tablesmith.llm.quality import op1_quality
from tablesmith.llm.secrets import op6_secrets
from tablesmith.llm.substrings import op7_substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_licenses": op2_licenses, "op3_pseudonyms": op3_pseudonyms,
        "op4_near_duplicates": op4_near_duplicates, "op5_packing": op5_packing, "op6_secrets": op6_secrets, "op7_substrings": op7_substrings,
        "op8_line_crf": op8_line_crf, "op9_mixing": op9_mixing, "op10_fingerprints": op10_fingerprints, "op11_fill_in_middle": op11_fill_in_middle,
        "op12_run_index": op12_run_index, "op13_manifest": op13_manifest}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
