"""One query for each operator of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from quillstone.llm.decontamination import OP5_SQL, op5_decontamination
from quillstone.llm.flac import op3_flac
from quillstone.llm.language_id import op4_language_id
from quillstone.llm.lm_scoring import op8_lm_scoring
from quillstone.llm.mixing import OP2_SQL, op2_mixing
from quillstone.llm.near_duplicates import op7_near_duplicates
from quillstone.llm.secrets import op1_secrets
from quillstone.llm.sharding import op10_sharding
from quillstone.llm.toxicity import op6_toxicity
from quillstone.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_mixing": op2_mixing,
    "op3_flac": op3_flac,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
}

SQL = {
    "op2_mixing": OP2_SQL,
    "op5_decontamination": OP5_SQL,
    "op9_warc": OP9_SQL,
}
