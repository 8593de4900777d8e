"""The registered queries of this subpackage, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import alignment, binary_packing, exact_dedup, html, language, lm, mixing, packing, reshard, simhash, tool_calls, variants, vectors
from folio.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups over all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES["op10_exact_dedup"] = op10_exact_dedup
ORACLES["op10_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES["op4_reshard"] = reshard.op4_reshard
QUERIES["op5_mix_sources"] = mixing.op5_mix_sources
ORACLES["op5_mix_sources"] = mixing.OP5_SQL
QUERIES["op2_simhash"] = simhash.op2_simhash
QUERIES["op7_near_vectors"] = vectors.op7_near_vectors
ORACLES["op7_near_vectors"] = vectors.OP7_SQL
QUERIES["op9_pack_sequences"] = packing.op9_pack_sequences
QUERIES["op1_main_text"] = html.op1_main_text
QUERIES["op8_language_id"] = language.op8_language_id
QUERIES["op3_lm_score"] = lm.op3_lm_score
QUERIES["op6_tool_calls"] = tool_calls.op6_tool_calls
ORACLES["op6_tool_calls"] = tool_calls.OP6_SQL
QUERIES["op11_align_tokens"] = alignment.op11_align_tokens
QUERIES["op12_binary_packing"] = binary_packing.op12_binary_packing
QUERIES["op13_spelling_variants"] = variants.op13_spelling_variants
