"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm.ann import op4_ann
from millrace.llm.decontaminate import op7_decontaminate
from millrace.llm.lang_id import op2_lang_id
from millrace.llm.licenses import op9_licenses
from millrace.llm.lm_score import OP5_SQL, op5_lm_score
from millrace.llm.mixing import OP6_SQL, op6_mixing
from millrace.llm.near_dup import OP1_SQL, op1_near_dup
from millrace.llm.quality import op3_quality
from millrace.llm.token_counts import op8_token_counts
from millrace.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_lang_id": op2_lang_id,
    "op3_quality": op3_quality,
    "op4_ann": op4_ann,
    "op5_lm_score": op5_lm_score,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op1_near_dup": OP1_SQL, "op5_lm_score": OP5_SQL, "op6_mixing": OP6_SQL, "op10_warc": OP10_SQL}
