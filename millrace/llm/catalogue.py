"""The training-data queries and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from millrace.llm.ann import op7_ann
from millrace.llm.chat import op8_chat, op8_sql
from millrace.llm.decontaminate import op1_decontamination
from millrace.llm.html import op2_html
from millrace.llm.jaccard import op5_jaccard
from millrace.llm.packing import op3_packing
from millrace.llm.quality import op10_quality
from millrace.llm.sharding import op9_sharding, op9_sql
from millrace.llm.toxicity import op4_toxicity
from millrace.llm.warc import op6_sql, op6_warc


def queries() -> dict:
    return {"op1_decontamination": op1_decontamination, "op2_html": op2_html, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity, "op5_jaccard": op5_jaccard, "op6_warc": op6_warc, "op7_ann": op7_ann, "op8_chat": op8_chat, "op9_sharding": op9_sharding, "op10_quality": op10_quality}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": op6_sql(), "op8_chat": op8_sql(), "op9_sharding": op9_sql()}
