"""The queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollmill.llm import filter_audit, negatives
from tollmill.llm.bpe import op2_bpe
from tollmill.llm.decontamination import op1_decontamination
from tollmill.llm.filter_audit import op11_filter_audit
from tollmill.llm.fingerprints import op7_fingerprints
from tollmill.llm.html import op4_html
from tollmill.llm.jaccard import op10_jaccard
from tollmill.llm.licenses import op9_licenses
from tollmill.llm.lines import op5_lines
from tollmill.llm.negatives import op13_hard_negatives
from tollmill.llm.packing import op12_packing
from tollmill.llm.quality import op8_quality
from tollmill.llm.sharding import op3_sharding
from tollmill.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_html": op4_html,
    "op5_lines": op5_lines,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_jaccard": op10_jaccard,
    "op11_filter_audit": op11_filter_audit,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op11_filter_audit": filter_audit.SQL,
    "op13_hard_negatives": negatives.SQL,
}
