"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclake.llm.audio import op8_audio
from doclake.llm.bpe import op9_bpe
from doclake.llm.chat import OP7_SQL, op7_chat
from doclake.llm.collocations import OP13_SQL, op13_collocations
from doclake.llm.decontaminate import OP11_SQL, op11_decontaminate
from doclake.llm.html_extract import op6_html
from doclake.llm.lm_score import op4_lm_score
from doclake.llm.near_dedup import OP5_SQL, op5_near_dedup
from doclake.llm.packing import op3_packing
from doclake.llm.periodic import op12_periodic_runs
from doclake.llm.pii import op2_pii
from doclake.llm.quality import op10_quality
from doclake.llm.substring_dedup import OP1_SQL, op1_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_lm_score": op4_lm_score,
    "op5_near_dedup": op5_near_dedup,
    "op6_html": op6_html,
    "op7_chat": op7_chat,
    "op8_audio": op8_audio,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_decontaminate": op11_decontaminate,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op5_near_dedup": OP5_SQL, "op7_chat": OP7_SQL, "op11_decontaminate": OP11_SQL, "op13_collocations": OP13_SQL}
