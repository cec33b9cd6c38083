"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from graphloom.llm import op01_decontaminate as op1
from graphloom.llm import op03_quality as op3
from graphloom.llm import op07_secrets as op7
from graphloom.llm import op04_token_counts as op4
from graphloom.llm import op09_bpe as op9
from graphloom.llm import op06_token_binary as op6
from graphloom.llm import op05_kd_shards as op5
from graphloom.llm import op08_transport_stream as op8
from graphloom.llm import op02_chat_format as op2
from graphloom.llm import op10_simhash_dedup as op10


def queries() -> dict[str, Callable]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_decontaminate": op1.query,
        "op3_quality": op3.query,
        "op7_secrets": op7.query,
        "op4_token_counts": op4.query,
        "op9_bpe": op9.query,
        "op6_token_binary": op6.query,
        "op5_kd_shards": op5.query,
        "op8_transport_stream": op8.query,
        "op2_chat_format": op2.query,
        "op10_simhash_dedup": op10.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": op2.SQL}
