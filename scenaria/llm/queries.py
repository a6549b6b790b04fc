"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenaria.llm.brown import op12_lm_scores
from scenaria.llm.collocations import SQL as COLLOCATIONS_SQL
from scenaria.llm.collocations import op13_collocations
from scenaria.llm.decontam import op9_decontamination
from scenaria.llm.html import op6_main_text
from scenaria.llm.manifest import SQL as MANIFEST_SQL
from scenaria.llm.manifest import op11_manifest
from scenaria.llm.packing import op8_packing
from scenaria.llm.passages import op3_repeated_passages
from scenaria.llm.pii import op2_pii
from scenaria.llm.simhash import op1_simhash
from scenaria.llm.tokencount import op10_token_counts
from scenaria.llm.tokenfile import op5_token_output
from scenaria.llm.toxicity import op7_toxicity
from scenaria.llm.vectors import op4_vector_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_vector_links": op4_vector_links,
    "op5_token_output": op5_token_output,
    "op6_main_text": op6_main_text,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_manifest": op11_manifest,
    "op12_lm_scores": op12_lm_scores,
    "op13_collocations": op13_collocations,
}
SQL: dict[str, str] = {"op11_manifest": MANIFEST_SQL, "op13_collocations": COLLOCATIONS_SQL}
